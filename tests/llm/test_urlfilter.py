from lamella.llm import urlfilter
from pyspark.sql import functions as F

RULES = urlfilter.RULES


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


URLS = [
    None,
    "",
    "no scheme",
    "http://Example.ORG/en/1?x=1#y",
    "http://example.org/en/2",
    "https://a.b.example.org/es/",
    "http://badexample.org/es/1",
    "http://x.com/de/1",
    "http://x.com/fr/1",
    "http://com/de/",
    "http://x.net/a",
    "http://x.net",
    "http://x.net?q=/de/",
    "ftp://É.org/é#/x",
    "http://a.net/p://com/de/",
]


def run(spark, rows, redirects=None, spellings=True):
    pages = spark.createDataFrame([(*r, "extra", "h") for r in rows], "page_id long, url string, html string, component string, host string")
    moved = None if redirects is None else spark.createDataFrame(redirects, "source string, target string")
    out = urlfilter.verdicts(pages, urlfilter.rules_frame(spark), moved, spellings).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}, out


def test_rules_against_plain_parsing(spark):
    got, _ = run(spark, [(i, u, None) for i, u in enumerate(URLS)])
    for i, u in enumerate(URLS):
        rule, verdict = rule_of(*split(u))
        assert got[i] == (*split(u), rule, verdict or "allow"), u


def test_blocks_reach_aliases(spark):
    link = '<html><head><LINK href="http://x.com/de/9" rel=canonical></head>'
    meta = "<meta http-equiv='refresh' content='0; url=//www.mid.net/hop'>"
    rows = [
        (1, "http://one.net/a", link),  # declares a blocked page canonical
        (2, "http://one.net/a/", None),  # usual spelling of 1
        (3, "http://www.one.net/a.html?utm_source=q#f", ""),  # another one
        (4, "http://two.org/z", link),  # an explicit allow stands
        (5, "http://three.net/r", meta),  # redirects to a page that redirects to a blocked one
        (6, "http://mid.net/hop", None),
        (7, "http://clean.net/a?id=1", "<p>canonical</p>"),
        (8, "http://clean.net/a?id=2", None),
        (9, "http://one.net/b", '<link rel="stylesheet" href="http://x.com/de/9">'),
    ]
    got, _ = run(spark, rows, [("https://mid.net/hop", "http://x.com/de/1"), (None, "http://x.com/de/1")])
    assert {k: v[3] for k, v in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow", 9: "allow"}
    assert got[4][2] == "org/" and got[1][2] is None
    got, _ = run(spark, rows, [("https://www.MID.net/hop", "http://x.com/de/1#there")], spellings=False)
    assert {k for k, v in got.items() if v[3] == "block"} == {1}  # other spellings prove nothing
    got, _ = run(spark, rows, [("http://www.MID.net/hop", "HTTP://x.com/de/1#there")], spellings=False)
    assert {k for k, v in got.items() if v[3] == "block"} == {1, 5}


def test_links_are_resolved(spark):
    cases = {
        "/a/../b/./c": "http://h.net/b/c",
        "../x": "http://h.net/p/x",
        "../../../x/.": "http://h.net/x/",
        "..": "http://h.net/p/",
        "y?u=1&amp;v=2#f": "http://h.net/p/q/y?u=1&v=2",
        "?n=2": "http://h.net/p/q/r?n=2",
        "//o.net/z": "http://o.net/z",
        "HTTPS://o.net": "HTTPS://o.net",
        "mailto:a@b": None,
        "#top": None,
    }
    rows = spark.createDataFrame([("http://h.net/p/q/r?k=1#g", link) for link in cases], "base string, link string")
    got = [r[0] for r in rows.select(urlfilter.absolute(F.col("base"), F.col("link"))).collect()]
    assert got == list(cases.values())


def test_repeats_hot_url_and_empty(spark):
    rows = [(i % 50, "http://m.hot.net/x", None) for i in range(400)] + [(99, "http://hot.net/x", '<link rel="canonical" href="http://a.com/de/">')]
    got, out = run(spark, rows)
    assert len(out) == 401 and {v[3] for v in got.values()} == {"block"}
    assert run(spark, [])[1] == []


def test_exact_urls_are_nodes_of_their_own(spark):
    """A redirect to a url with a fragment says nothing of the url without it if urls are taken as written."""
    rows = [(1, "http://a.net/x#top", ""), (2, "http://a.net/x", ""), (3, "http://example.org/es/1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://example.org/es/1", "http://a.net/x#top")], "source string, target string")
    got = lambda **how: {r.page_id: r.verdict for r in urlfilter.verdicts(pages, urlfilter.rules_frame(spark), moved, **how).collect()}
    assert got() == {1: "block", 2: "block", 3: "block"}
    assert got(exact=True) == {1: "block", 2: "allow", 3: "block"}
