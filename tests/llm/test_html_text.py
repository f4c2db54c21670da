import itertools
import random

from broadloom.llm import html_text
from broadloom.llm.html_text import blocks_of, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- <p>hidden</p> --><article><h1>A&nbsp;Title</h1><p><b>First   paragraph
here.<br><p>Second &lt;one&gt; &amp;amp; a < b.</p><aside>Look elsewhere</aside><form><p>Sign up</p></form><ul><li>Point.</ul>Tail text.
<div class="comments"><article><p>A reader's long comment, which says many things about nothing.</p></article></div></article>
<footer>&copy; nobody</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == "A Title\nFirst paragraph here.\nSecond <one> &amp; a < b.\nPoint.\nTail text."


def test_pages_without_landmarks_go_by_their_text():
    page = "<div><a href=1>Home</a> <a href=2>News</a></div><div><p>" + "A long paragraph of plain text, that goes on. " * 4 + "</p></div>"
    assert main_text(page) == " ".join(("A long paragraph of plain text, that goes on. " * 4).split())


def test_broken_markup():
    for page in ("", None, "<", "<p", "<!--", "<!-- a", "<script>x", "a<b>c", "<p title='x>y", "</", "<p>" * 3000, "<!" * 2000, "<a" * 3000, "&#0;&#x110000;"):
        main_text(page)
    assert main_text("<article><p a='>'>x y z.</p a>") == "x y z."


def test_minimum_cut_against_all_labellings():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 9)
        d = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda side: sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(d, side)) + sum(w for a, b, w in edges if side[a] != side[b])
        best = min(cost(s) for s in itertools.product([True, False], repeat=n))
        assert abs(cost(minimum_cut(d, edges)) - best) < 1e-9


def test_blocks_keep_page_order():
    assert [b[0] for b in blocks_of("x<p>a<p>b<ul><li>c<li>d</ul>e")] == ["x", "a", "b", "c", "d", "e"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, None), (2, "v", "<p>" + "long " * 50000, "q")],
                               "page_id bigint, url string, html string, text string")
    out = html_text.extract_main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = sorted(map(tuple, out.collect()), key=repr)
    assert [r[:2] + r[3:] for r in rows] == [(1, "u", len(main_text(PAGE)))] * 2 + [(2, "v", 249999), (None, None, 0)]
    assert html_text.extract_main_text(df.limit(0)).collect() == []


def test_wrappers_that_mention_a_part_keep_their_article():
    line = "A long paragraph of plain text, that goes on. " * 4
    body = f"<h1>Title</h1><p>{line}</p><section id='related-work'><h2 id='search'>Search</h2><p>{line}</p></section>"
    want = "\n".join(["Title", line.strip(), "Search", line.strip()])
    for page in (f"<body class='has-sidebar'><article>{body}</article></body>", f"<div class='content-sidebar-wrap'><article>{body}</article></div>",
                 f"<article class='post category-social tag-search'>{body}</article>", f"<form><main>{body}</main></form>",
                 f"<div class='search'><article>{body}</article></div><div class='related'><p>Other news.</p></div>"):
        assert main_text(page) == want, page
    assert main_text(f"<form><p>{line}</p></form>") == line.strip()
    assert main_text("<article><p>Let <math><mi>x</mi></math> be.</p></article>") == "Let x be."
    assert main_text(f"<article><p>{line}</p></article><div class='site-footer'><p>Nobody</p></div>") == line.strip()
