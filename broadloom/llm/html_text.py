"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags. A linear classifier (fixed log-odds: enclosing elements, their
class, id and role words, share of link text, length, closing punctuation) gives each block a preference for content
or boilerplate, which becomes its terminal capacity. Neighbouring blocks, and successive blocks of one parent, are tied
by edges that weigh more the closer they stand in the document tree. The minimum cut, found by max-flow after settling
the blocks whose own preference outweighs all their edges, separates content from boilerplate.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from broadloom.llm.common import slices

BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select
summary table tbody td tfoot th thead tr ul button noscript object""".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr frame".split())
#: Their content is no markup: it ends at the first matching end tag.
RAW = frozenset("script style title textarea template iframe xmp noembed noframes svg canvas".split())
#: An opening tag closes an open element of these kinds that is the innermost of its kind's container.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
ENDS_P = BLOCK - {"p", "button", "object", "noscript", "option", "optgroup", "select"}

#: SOFT: a class that only mentions such a part, as has-sidebar does; an article or long text outweighs it.
AGAINST, SOFT, FOR, HINT = -9.0, -1.5, 4.0, 2.0
#: Their class, id and role words say nothing against their text.
ABOVE_WORDS = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
TAG_AGAINST = frozenset("nav header footer aside form fieldset menu dialog select button noscript object search".split())
TAG_FOR = frozenset("article main".split())
WORD_AGAINST = re.compile(r"""(?:^|[\s_-])(?:ads?|adv|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|
overlay|sidebar|menu\w*|nav|navbar|navigation|breadcrumbs?|pagination|pager|header|masthead|footer|comments?|commentlist|disqus|
repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|search\w*|form|widget\w*|toolbar|
contentinfo|complementary|skip)(?=$|[\s_-])""".replace("\n", ""), re.I)
PARTS = re.compile(r"[_-]+")
WORD_FOR = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main|body|text)(?=$|[\s_-])", re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)

#: Smoothness: siblings, further steps through the tree, successive blocks of one parent.
SIBLING, STEP, SAME_PARENT = 1.2, 0.5, 0.6


def _against(words: str) -> float:
    """AGAINST if all parts of a class, id or role are such words (cookie-notice), SOFT if some are (has-sidebar)."""
    if not WORD_AGAINST.search(words):
        return 0.0
    whole = any(all(WORD_AGAINST.fullmatch(part) for part in PARTS.split(word) if part) for word in words.split() if word.strip("_-"))
    return AGAINST if whole else SOFT


def _evidence(elements: list, sizes: list[int]) -> list[tuple[float, float]]:
    """(best for, worst against) of each element and all around it.

    Words, and a form, count for nothing on an element that is not in an article and holds most of the text of all
    articles, or, without any, three quarters of the page's: it is a wrapper.
    """
    held, inside = list(sizes), [False] * len(elements)
    for i, (parent, *_) in enumerate(elements):
        inside[i] = i > 0 and (inside[parent] or elements[i][1] in TAG_FOR)
    told = [size if inside[i] else 0 for i, size in enumerate(sizes)]
    for i in range(len(elements) - 1, 0, -1):
        held[elements[i][0]] += held[i]
        told[elements[i][0]] += told[i]
    out = [(0.0, 0.0)]
    for i, (parent, tag, plus, minus) in enumerate(elements[1:], 1):
        wraps = not inside[i] and (tag == "form" or tag not in TAG_AGAINST) and (
            2 * told[i] > told[0] if told[0] else 4 * held[i] > 3 * held[0])
        out.append((max(out[parent][0], plus), min(out[parent][1], 0.0 if wraps else minus)))
    return out


def blocks_of(page: str) -> list[tuple[str, float, int, int]]:
    """(text, preference for content, parent element, depth) of each non-empty block, in page order."""
    out, pieces, linked, in_link = [], [], 0, False
    stack = [("", 0)]  # tag, number
    elements, sizes = [(0, "", 0.0, 0.0)], [0]  # parent, tag, own evidence for and against; own text
    pos, size = 0, len(page)

    def text(s: str) -> None:
        nonlocal linked
        if s:
            pieces.append(s)
            if in_link:
                linked += len(s)

    def flush() -> None:
        nonlocal linked
        if pieces:
            t = " ".join(html.unescape("".join(pieces)).split())
            if t:
                share = min(1.0, linked / max(1, sum(map(len, pieces))))
                number = stack[-1][1]
                sizes[number] += len(t)
                d = -3.0 * share + min(2.0, len(t) / 80) - 0.7 + (0.5 if t[-1] in ".!?:;…。\"'”»" else 0.0)
                out.append((t, d, number, len(stack)))
            pieces.clear()
        linked = 0

    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            text(page[pos:])
            break
        text(page[pos:at])
        follow = page[at + 1:at + 2]
        if follow == "!" or follow == "?":
            end = page.find("-->", at + 4) + 3 if page.startswith("<!--", at) else page.find(">", at) + 1
            pos = size if end < 3 and page.startswith("<!--", at) or end == 0 else end
            continue
        m = TAG.match(page, at)
        if m is None:
            if follow.isalpha() or follow == "/":  # a broken tag: up to the next bracket
                end = page.find(">", at) + 1
                pos = end or size
            else:
                text("<")
                pos = at + 1
            continue
        pos, closing, tag, attributes = m.end(), m[1], m[2].lower(), m[3]
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                m = re.compile(f"</{tag}[^>]*>", re.I).search(page, pos)
                pos = m.end() if m else size
            text(" ")
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            text(" ")
        elif tag in BLOCK:
            flush()
            names = [e[0] for e in stack]
            if closing:
                in_link = False
                if tag in names:
                    del stack[len(names) - 1 - names[::-1].index(tag):]
                continue
            gone = CLOSES.get(tag, ()) + (("p",) if tag in ENDS_P else ())
            for k in range(len(stack) - 1, 0, -1):
                if names[k] in gone:
                    del stack[k:]
                    break
                if names[k] not in ("p", "li", "dt", "dd", "td", "th", "option"):
                    break
            if tag not in VOID:
                plus = minus = 0.0
                words = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes)) if attributes else ""
                if tag in TAG_AGAINST:
                    minus = AGAINST
                elif words and tag not in ABOVE_WORDS:
                    minus = _against(words)
                if minus > AGAINST:
                    plus = FOR if tag in TAG_FOR else HINT if words and WORD_FOR.search(words) else 0.0
                elements.append((stack[-1][1], tag, plus, minus))
                sizes.append(0)
                stack.append((tag, len(elements) - 1))
    flush()
    evidence = _evidence(elements, sizes)
    return [(t, d + sum(evidence[number]), number, depth) for t, d, number, depth in out]


def smoothness(blocks) -> list[tuple[int, int, float]]:
    """Edges between neighbours, by the steps between their depths, and between successive blocks of one parent."""
    edges, last = [], {}
    for i, (_, _, parent, depth) in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            edges.append((i - 1, i, SIBLING if before[2] == parent else STEP / (1 + abs(before[3] - depth))))
        if last.get(parent, i - 1) != i - 1:
            edges.append((last[parent], i, SAME_PARENT))
        last[parent] = i
    return edges


def minimum_cut(preference: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True on the content side of a minimum cut; a node free to go either way counts as boilerplate."""
    n, d = len(preference), list(preference)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a preference beyond all edges decides alone, and then leans on its neighbours
        i = todo.popleft()
        if side[i] is None and abs(d[i]) > sum(near[i].values()) + 1e-12:
            side[i] = d[i] > 0
            for j, w in near[i].items():
                d[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        reached = _max_flow(rest, d, near)
        for i in rest:
            side[i] = i in reached
    return side


def _max_flow(nodes: list[int], d: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (Dinic: level graphs, blocking flows by iteration)."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes}
    cap[s], cap[t] = {}, {}
    for i in nodes:
        if d[i] > 0:
            cap[s][i] = d[i]
            cap[i][s] = 0.0
        elif d[i] < 0:
            cap[i][t] = -d[i]
            cap[t][i] = 0.0
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for y, c in cap[x].items():
                if c > 1e-12 and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if t not in level:
            return set(level) - {s}
        ways = {x: iter(list(cap[x])) for x in level}
        path = [s]
        while path:
            x = path[-1]
            if x == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for k, (a, b) in enumerate(zip(path, path[1:])):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                full = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= 1e-12)
                for y in path[full + 1:]:  # their edges may carry more
                    if y != t:
                        ways[y] = iter(list(cap[y]))
                del path[full + 1:]
                continue
            for y in ways[x]:
                if cap[x][y] > 1e-12 and level.get(y, -1) == level[x] + 1:
                    path.append(y)
                    break
            else:
                path.pop()


def main_text(page: str | None) -> str:
    """Content blocks of a page, white space folded, joined by line feeds; empty for NULL."""
    if not page:
        return ""
    blocks = blocks_of(page)
    kept = minimum_cut([b[1] for b in blocks], smoothness(blocks))
    return "\n".join(b[0] for b, k in zip(blocks, kept) if k)


def _extract(batches):
    for batch in slices(batches):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.record_batch([*(c for c, n in zip(batch.columns, batch.schema.names) if n != "html"), pa.array(texts, pa.string()),
                               pa.array([len(t) for t in texts], pa.int64())],
                              names=[*(n for n in batch.schema.names if n != "html"), "text", "n_chars"])


def extract_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` without the html, plus text and n_chars (code points).

    One row for each row; a NULL or empty page, or one of boilerplate alone, has an empty text. Columns that
    already bear an added name are replaced. No row leaves its task.
    """
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars", html_column)]
    base = pages.select(*keep, F.col(html_column).alias("html"))
    fields = [f for f in base.schema.fields if f.name != "html"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "text string", "n_chars bigint"])
    return base.mapInArrow(_extract, schema)
