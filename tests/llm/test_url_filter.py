import re

from factloom.llm.url_filter import RULES, judge_urls


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    return (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")


def rule(url):
    host, path, _ = parts(url)
    fit = [(len(h + p), h + p, v) for v, h, p in RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(pages, links):
    node = lambda u: "".join(parts(u)) if parts(u)[0] else None
    group = {}
    for a, b in links:
        if node(a) and node(b):
            both = group.get(node(a), {node(a)}) | group.get(node(b), {node(b)})
            for x in both:
                group[x] = both
    said = {}
    for u in [u for _, u in pages] + [u for pair in links for u in pair]:
        if rule(u)[1]:
            said.setdefault(node(u), set()).add(rule(u)[1])
    out = set()
    for page, u in pages:
        host, path, _ = parts(u)
        name, verdict = rule(u)
        near = set().union(*(said.get(x, set()) for x in group.get(node(u), ()))) if node(u) in group else set()
        out.add((page, host, path, name, verdict or ("allow" if "allow" in near else "block" if "block" in near else "allow")))
    return out


def test_aliases_against_brute_force(spark):
    link = '<html><link rel="canonical" href="{}">'.format
    refresh = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [
        (1, "http://x.org/a", link("http://b.net/es/1")),  # blocked through its canonical target
        (2, "https://x.org/b#top", link("/a")),  # and its aliases
        (3, "http://x.org/c", refresh("http://x.org/b")),
        (4, "http://www.example.com/en/ok", link("http://x.org/d")),
        (5, "http://X.org/d", link("http://c.net/fr/9")),  # an allow in the component goes first
        (6, "http://example.com/en/no", None),
        (7, "http://a.example.com/en/no", link("")),
        (8, "http://free.org/1", link("http://free.org/2")),
        (9, "http://m.net/es/", link("http://www.example.com/en/ok")),  # its own rule
        (10, "ftp://com", ""),
        (11, "http://com/", ""),
        (12, None, link("http://b.net/es/1")),
        (13, "no scheme", link("http://b.net/es/1")),
        (14, "http://x.org/dir/page?q=1", link("other")),
        (15, "http://x.org/dir/other", link("http://z.net/fr/")),
        (16, "http://evilexample.com.org/en/", None),
    ]
    links = [("http://x.org/a", "http://b.net/es/1"), ("https://x.org/b", "http://x.org/a"), ("http://x.org/c", "http://x.org/b"), ("http://www.example.com/en/ok", "http://x.org/d"), ("http://x.org/d", "http://c.net/fr/9"), ("http://free.org/1", "http://free.org/2"), ("http://m.net/es/", "http://www.example.com/en/ok"), ("http://x.org/dir/page?q=1", "http://x.org/dir/other"), ("http://x.org/dir/other", "http://z.net/fr/")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, node string")
    got = {tuple(r) for r in judge_urls(df).collect()}
    assert got == brute([r[:2] for r in rows], links)
    verdicts = {r[0]: r[4] for r in got}
    assert verdicts[1] == verdicts[2] == verdicts[3] == verdicts[14] == "block" and verdicts[5] == verdicts[12] == "allow"


def test_redirect_table_and_chain(spark):
    chain = [(f"http://s.org/{k}", f"http://s.org/{k + 1}") for k in range(40)] + [("http://s.org/40", "http://q.net/es/x"), (None, "http://s.org/1")]
    pages = [(k, f"http://s.org/{k}", None) for k in range(41)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {tuple(r) for r in judge_urls(df, redirects=spark.createDataFrame(chain, "from_url string, to_url string")).collect()}
    assert got == brute([p[:2] for p in pages], chain) and {r[4] for r in got} == {"block"}


def test_empty_tables_and_repeats(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/", None), (1, "http://a.net/es/", None), (None, None, None)], "page_id long, url string, html string")
    assert judge_urls(df).count() == 3
    assert judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in judge_urls(df, rules=df.sparkSession.createDataFrame([], "verdict string, host string, path string")).collect()} == {"allow"}


HREFS = [
    ("http://b.org/p", "/login?next=http://a.net/es/x", "allow"),  # a url in a query names no host
    ("http://b.org/q#http://a.net/es/x", "#http://a.net/es/x", "allow"),
    ("http://b1.org/p", "//a.net/es/x", "block"),
    ("http://b2.org/p", "HTTP://A.net/es/x", "block"),
    ("http://b3.org/x/y/p", "../../go/./to/../es", "allow"),
    ("http://b4.org/p", "mailto:http://a.net/es/x", "allow"),
    ("http://b5.org/p?a=1", "?page=2&amp;ref=1", "block"),  # b5.org/p?page=2&ref=1 is redirected to a.net below
    ("http://b5.org/p?page=2&ref=1", "http://a.net/es/x", "block"),
    ("http://b6.org", "x", "block"),
    ("http://b6.org/x", "http://a.net/fr/", "block"),
    ("http://b7.org/d/p", "./e", "block"),
    ("http://b7.org/d/e", "http://a.net/es/x/../y", "block"),
    ("http://b8.org/d/p", "..", "block"),
    ("http://b8.org/", "http://a.net/es/x", "block"),
    ("http://b9.org/d/p", "javascript:void(0)", "allow"),
]


def test_references_by_the_rules_for_urls(spark, tmp_path):
    import html
    from urllib.parse import urljoin

    import duckdb

    from factloom.llm.url_filter import OP8_SQL, op8_url_filter

    links = []
    for url, href, _ in HREFS:
        to = urljoin(url, html.unescape(href))
        if to.startswith(("http:", "HTTP:")):
            links.append((url, to))
    rows = [(k, url, f"<link href=\"\" rel='canonical'><head><LINK rel=canonical href='{href}' data-x>") for k, (url, href, _) in enumerate(HREFS)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {tuple(r) for r in op8_url_filter(spark, str(tmp_path)).collect()}
    assert {r[0]: r[4] for r in got} == {k: v for k, (_, _, v) in enumerate(HREFS)}
    assert got == brute([r[:2] for r in rows], links)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == {(r[0], r[1], r[2], r[3], r[4]) for r in duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({OP8_SQL})").fetchall()}


def test_long_hosts_and_unclosed_tags_take_no_time(spark):
    import time

    hosts = ["a." * 8000 + "example.com", "." * 16000 + "com", "b." * 8000 + "org"]
    pages = [
        (1, "http://" + hosts[0] + "/en/x", ""), (2, "http://" + hosts[1] + "/", ""), (3, "http://" + hosts[2] + "/", "<link " * 180_000), (4, "http://c.org/", "<meta http-equiv=refresh " * 40_000),
        (5, "http://d.org/", "<link " * 50_000 + "<link rel=canonical href='http://x.net/fr/1'>"), (6, "http://e.org/", "<link rel=canonical " + "x " * 400_000), (7, "http://f.org/", "<link " + "rel " * 200_000 + ">"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    judge_urls(df.limit(0)).collect()
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(df).collect()}
    assert time.time() - began < 60
    assert got[1] == ("example.com/en/", "block") and got[2] == ("com/", "allow") and got[5] == (None, "block") and got[3] == got[4] == got[6] == got[7] == (None, "allow")
