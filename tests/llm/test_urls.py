from fathom.llm.queries import URL_RULES
from fathom.llm.urls import alias_edges, judge

PAGES = [
    (1, "http://a.example.com/en/7/x?q=1", ""),
    (2, "HTTP://A.EXAMPLE.COM/en/8#f", ""),
    (3, "http://com/en/", ""),
    (4, "http://notcom/en/", ""),
    (5, "http://b.example.net/de/81", ""),
    (6, "http://example.net/de/9", ""),
    (7, None, None),
    (8, "no scheme", "<a>"),
    (9, "http://x.org/fr/1", '<link rel="canonical" href="http://y.org/es/2">'),
    (10, "http://z.org/", "<meta http-equiv=refresh content='0; url=http://x.org/fr/1'>"),
    (11, "http://free.io/", '<link href="/home" rel="canonical">'),
    (12, "http://free.io/home", ""),
    (13, "http://m.io/", '<link rel="canonical" href="http://n.net/de/1"><meta http-equiv="refresh" content="1;url=http://y.org/es/2">'),
    (14, "ftp://h", ""),
    (15, "://?x", ""),
    (1, "http://a.example.com/en/7/x?q=1", ""),
]
WANT = {
    1: ("a.example.com", "/en/7/x", "example.com/en/7", "allow"), 2: ("a.example.com", "/en/8", "com/en/", "block"), 3: ("com", "/en/", "com/en/", "block"), 4: ("notcom", "/en/", None, "allow"),
    5: ("b.example.net", "/de/81", "example.net/de/8", "block"), 6: ("example.net", "/de/9", "net/de/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
    # 9, 10, 13 and two targets are aliases, of which one is allowed and one blocked
    9: ("x.org", "/fr/1", None, "allow"), 10: ("z.org", "/", None, "allow"), 11: ("free.io", "/", None, "allow"), 12: ("free.io", "/home", None, "allow"), 13: ("m.io", "/", None, "allow"), 14: ("h", "", None, "allow"), 15: ("", "", None, "allow"),
}


def judged(spark, pages):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge(frame, URL_RULES, alias_edges(frame)).collect()), key=str)


def test_rules_and_aliases(spark):
    assert judged(spark, PAGES) == sorted(((p, *WANT[p]) for p, _, _ in PAGES), key=str)


def test_without_an_allowed_alias_the_block_spreads(spark):
    got = {r[0]: r[4] for r in judged(spark, [p for p in PAGES if p[0] != 13])}
    assert got[9] == got[10] == "block" and got[11] == "allow"
    assert judged(spark, []) == []


def test_every_link_and_relative_target_is_an_edge(spark):
    page = "http://a.io/x/y?k=1"
    refresh = '<meta content="0; url=http://b.org/es/1" http-equiv="refresh">'
    two = '<link rel="canonical" href="http://c.io/1"><p><link rel="canonical" href="http://b.org/es/3">'
    cases = {
        refresh: {"http://b.org/es/1"}, two: {"http://c.io/1", "http://b.org/es/3"},
        **{f'<link rel=canonical href="{to}">': {want} for to, want in {
            "es/2": "http://a.io/x/es/2", "../z": "http://a.io/z", "./": "http://a.io/x/", "../../..": "http://a.io/", "?p=1": "http://a.io/x/y?p=1",
            "?to=http://b.io": "http://a.io/x/y?to=http://b.io", "/a/../b?c": "http://a.io/b?c", "#top": page, "//d.io/e": "http://d.io/e",
        }.items()},
        '<link rel=canonical href="mailto:x">': set(),
        '<!-- <link rel=canonical href="/a"> --><script>"<link rel=canonical href=/b>"</script><LINK HREF=\'/c d\' REL="CANONICAL">': {"http://a.io/c d"},
        '<link rel="canonical"\n  href="/e"><title><meta http-equiv=refresh content="0;url=/f"></title>': {"http://a.io/e"},
        '<meta http-equiv="refresh" content="5"><link rel="alternate" href="/g"><!-- <link rel=canonical href=/h>': set(),
    }
    for html, want in cases.items():
        frame = spark.createDataFrame([(1, page, html)], "page_id long, url string, html string")
        assert {r.target for r in alias_edges(frame).collect()} == want, html
    pages = [(1, "http://a.org/x", refresh), (2, "http://m.org/fr/1", '<link rel="canonical" href="../es/2">'), (3, "http://n.org/", two)]
    assert {r[0]: r[4] for r in judged(spark, pages)} == {1: "block", 2: "block", 3: "block"}


def test_the_sql_agrees_on_planted_links(spark, tmp_path):
    import duckdb

    from fathom.llm.queries import ORACLE, op9_redirects

    extra = [(20, "http://a.io/x/y?k=1", f'<link rel=canonical href="{to}">') for to in ("es/2", "../z", "./", "../../..", "?p=1", "?to=http://b.io", "/a/../b?c", "#top", "//d.io/e", "mailto:x")]
    extra += [(30, "http://p.org/fr/1", '<meta content="0; url=../es/9" http-equiv="refresh">'), (31, "http://q.org/fr/1", '<!-- <link rel=canonical href="/es/1"> -->')]
    spark.createDataFrame(PAGES + extra, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(str, (tuple(r) for r in op9_redirects(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect())))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(map(str, db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE['op9_redirects']})").fetchall()))
    assert got == want and any("'block'" in x and "None" in x for x in got)


def test_long_pages_are_read_once(spark):
    import time

    began = time.time()
    texts = ["<link " * 200_000, "<!--" * 200_000, "canonical" + "<link rel=canonical " * 60_000, "<script " * 100_000 + "canonical", "<meta refresh" + " url" * 200_000 + ">"]
    frame = spark.createDataFrame([(k, "http://a.io/", t + " canonical") for k, t in enumerate(texts)], "page_id long, url string, html string")
    assert alias_edges(frame).collect() == []
    assert time.time() - began < 60
