"""Plain single-process versions of the operators, for comparison."""

from __future__ import annotations

import re


def near_dup(docs):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    owner = {}
    for i in ids:
        for s in sets[i]:
            owner.setdefault(s, []).append(i)
    meet = {}
    for group in owner.values():
        for k, a in enumerate(group):
            for b in group[k + 1:]:
                meet[a, b] = meet.get((a, b), 0) + 1
    for (a, b), n in meet.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (i, len(sets[i]), find(i), find(i) == i) for i in ids}
