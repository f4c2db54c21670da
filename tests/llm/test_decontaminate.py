import hashlib
import re

import pytest

from broadloom.llm import decontaminate

PASSAGE = " ".join(f"p{i}" for i in range(30))
ITEMS = [(1, PASSAGE), (2, "Short one here"), (3, None), (4, "!!!"), (5, "solo"), (6, PASSAGE), (None, " ".join(f"n{i}" for i in range(13)))]
DOCS = [
    (1, "x " * 100 + PASSAGE), (2, PASSAGE.upper()), (3, " ".join(PASSAGE.split()[4:16])), (4, "a-SHORT-one_here b"), (5, None), (6, ""), (7, "?!"),
    (8, "w " * 5000 + " ".join(PASSAGE.split()[:13])), (9, "solo solo solo"), (9, "solo solo solo"), (9, "nothing"), (None, "short one here"),
    (10, "É short one here"), (11, " ".join(f"n{i}" for i in range(14))), (12, PASSAGE + " " + PASSAGE), (13, "p0 " * 40),
]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain(doc, items):
    w, hit, ids = words(doc), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        for win in {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else ():
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) == win:
                    hit |= set(range(p, p + n))
                    ids |= {str(i)} if i is not None else set()
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("most", [200_000, 2])
def test_against_plain_windows(spark, most):
    """Both ways: windows broadcast, and windows too many for that."""
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id bigint, text string, n_hit string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = decontaminate.mark_contaminated(docs, items, max_windows=most)
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i, t, *plain(t, ITEMS)) for i, t in DOCS), key=repr)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS[:2], "doc_id bigint, text string")
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.contaminated for r in decontaminate.mark_contaminated(docs, items).collect()] == [False, False]
    assert decontaminate.mark_contaminated(docs.limit(0), spark.createDataFrame(ITEMS, items.schema)).collect() == []
