from broadloom.llm import url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("Example.com", "/de", "block"), ("a.b.c.d.e", "", "block"), (None, "/", "block"),
         ("x", None, "block")]
URLS = ["http://WWW.Example.NET/en/1", "http://example.net/EN/1", "https://example.net", "http://net/?q", "http://evilnet/", "ftp://a.net:80/x",
        "http://sub.example.com/deutsch#f", "http://example.com/", "http://z.a.b.c.d.e?x", "no scheme", "", None, "://net/", "http:///net/",
        "http://é.net/ü", "http://x/" + "y" * 20000, "http://" + "l." * 3000 + "net/", "http://net/", "http://net/"]


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h) + len(p), h.lower() + p, v) for h, p, v in rules if h is not None and p is not None
            and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_against_plain_rules(spark):
    df = spark.createDataFrame([(i % 15, u, "h", "r") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = url_filter.judge_urls(df, rules)
    assert out.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((i % 15, u, *plain(u, RULES)) for i, u in enumerate(URLS)), key=repr)


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    df = spark.createDataFrame([(1, "http://net/")], "page_id bigint, url string")
    assert [r.verdict for r in url_filter.judge_urls(df, rules).collect()] == ["allow"]
    assert url_filter.judge_urls(df.limit(0), spark.createDataFrame(RULES, rules.schema)).collect() == []
