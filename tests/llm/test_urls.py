from granary.llm.urls import url_verdicts

CANON = '<html><head><LINK href="{}" rel=canonical></head>'
ROWS = [
    (1, "https://a.example.com/en/71?x#y", None, "a.example.com", "/en/71", "example.com/en/7", "allow"),
    (2, "https://a.Example.COM/en/8", "", "a.example.com", "/en/8", "com/en/", "block"),
    (3, "http://x.example.net/de/80", "", "x.example.net", "/de/80", "example.net/de/8", "block"),
    (4, "http://net/de/", "", "net", "/de/", "net/de/", "allow"),
    (5, "http://xnet/de/", "", "xnet", "/de/", None, "allow"),
    (6, None, CANON.format("https://a.example.com/en/8"), "", "", None, "allow"),
    (7, "no scheme", "", "", "", None, "allow"),
    (8, "https://alias.test/p#frag", CANON.format("https://a.example.com/en/8"), "alias.test", "/p", None, "block"),
    (8, "https://alias.test/p", "", "alias.test", "/p", None, "block"),
    (9, "https://far.test/q", '<meta http-equiv="refresh" content="0; url=https://alias.test/p">', "far.test", "/q", None, "block"),
    (10, "https://both.test/", CANON.format("https://b.example.org/es/1"), "both.test", "/", None, "allow"),
    (11, "https://b.example.org/es/1", CANON.format("https://a.example.com/en/7"), "b.example.org", "/es/1", "org/es/", "block"),
    (12, "a://b?c/d", "", "b", "", None, "allow"),
    (None, "https://o.org/es/", "", "o.org", "/es/", "org/es/", "block"),
]


def test_verdicts(spark):
    pages = spark.createDataFrame([(r[0], r[1], r[2], "x") for r in ROWS], "page_id long, url string, html string, host string")
    got = [tuple(r) for r in url_verdicts(pages).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(((r[0], *r[3:]) for r in ROWS), key=key)


def test_every_link_is_an_edge_and_relative_ones_are_resolved(spark):
    two = CANON.format("https://q.test/1") + '<link rel="canonical" href="https://a.example.com/en/8">'
    pages = [
        (1, "https://p.test/a/b.html", two), (2, "https://q.test/1", ""), (3, "https://r.test/x/y/z?q", CANON.format("../w")), (4, "https://r.test/x/w", CANON.format("https://a.example.com/en/9")),
        (5, "https://s.test/d/", CANON.format("e")), (6, "https://s.test/d/e", '<meta http-equiv=refresh content="0;url=?k=1">'), (7, "https://s.test/d/e?k=1", CANON.format("//a.example.com/en/9")),
        (8, "https://t.test", CANON.format("mailto:x@a.example.com")), (9, "https://t.test/", CANON.format("#top")),
    ]
    got = {r.page_id: r.verdict for r in url_verdicts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" for i in range(1, 8)} | {8: "allow", 9: "allow"}


def test_given_edges_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://m.test/a", "")], "page_id long, url string, html string")
    edges = spark.createDataFrame([("http://m.test/a", "http://z.org/es/3"), (None, "http://z.org/es/3")], "src string, dst string")
    assert url_verdicts(pages, edges=edges).first().verdict == "block"
    assert url_verdicts(pages.limit(0)).count() == 0
