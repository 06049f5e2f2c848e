"""Probing of sites: result links, learned patterns, detail pages, yields, the choice of a template and errors."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import probing


def one(spark, f, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(f(*map(F.col, names)).alias("x")).first().x


LISTS = "".join(f'<a href="/topics/list/sort_id/{k}">c</a>' for k in range(1, 20))
VIEWS = "".join(f'<a href="/topics/view/{700000 + k}_Some_Title_{k}.html">d</a>' for k in range(3))


@pytest.mark.parametrize(
    "page, n",
    [
        ('<a href="/about">a</a><a href="/amazound-ppg-storm-for-kontakt/">1</a><a href="/luftrum-luftrum-34-for-omnisphere-3/">2</a>', 2),
        ('<a href="/a/123"><a href="https://x.com/a/123"><a href="/static/1234.html"><a href="/x.HTM"><a href="/Movie/a"><a href="/12">', 3),
        ('<a href="/POST/1"><a href="/comic/santi_x"><a href="/a b c">', 2),
        ("", 0),
    ],
)
def test_result_links(spark, page, n):
    assert one(spark, probing.result_links, page) == n


def test_patterns(spark):
    """The commonest links are a list, the likeliest are detail pages: both are tried."""
    found = one(spark, probing.result_patterns, LISTS + VIEWS, "share.dmhy.org")
    assert found[0] == r"https://share\.dmhy\.org/[a-z0-9_-]+/[a-z0-9_-]+/\d+_[a-z0-9_-]+\.html" and found[1].endswith(r"/\d+") and len(found) == 2
    assert one(spark, probing.result_patterns, '<a href="/about">x</a>', "x.com") == []
    urls = one(spark, probing.detail_urls, LISTS + VIEWS + '<a href="https://SHARE.dmhy.org/topics/view/1_x.html!">', found[0])
    assert urls == ["https://SHARE.dmhy.org/topics/view/1_x.html", *(f"https://share.dmhy.org/topics/view/{700000 + k}_Some_Title_{k}.html" for k in range(3)), "https://share.dmhy.org/topics/view/1_x.html"]


def test_resources(spark):
    count = lambda page: one(spark, probing.resources, page)
    assert count('<a href="https://www.google.com">x</a>') == 0
    assert count('<a href="https://pan.quark.cn/s/abc">a</a> https://pan.quark.cn/s/abc。<a href="/ebooks/x.epub">') == 2
    assert count(f'https://x.com/a.pdf?b magnet:?xt=urn:btih:{"a" * 40}&dn=b <a href="/f.zip"><a href="b.torrent#x">') == 3
    assert one(spark, lambda c: probing.resources(F.nullif(c, F.lit("x"))), "x") == 0


PAGE = "".join(f'<a href="/page-{k}/">' for k in ("aaa", "bbb", "ccc", "ddd"))
MANY = "".join(f'<a href="/t/{1000 + k}.html">' for k in range(25))
SHARES = '<a href="https://pan.quark.cn/s/abc123">x</a> https://pan.baidu.com/s/1AbCd'


def probed(spark, homes, searches, details, **options):
    h = spark.createDataFrame(homes, "domain string, http_status int, error string")
    s = spark.createDataFrame(searches, "domain string, place int, template string, http_status int, html string, noise_status int, noise_html string, real int")
    d = spark.createDataFrame(details, "url string, http_status int, html string, n int")
    return {r.domain: r for r in probing.probe(h, s, d, **options).collect()}


def test_probe(spark):
    homes = [("good.example", 200, None), ("https://full.example/", 200, ""), ("play.example", 200, None), ("same.example", 200, None), ("none.example", 200, None), ("shut.example", 503, None), ("gone.example", None, "ConnectError")]
    searches = [
        ("good.example", 0, "/a", 500, PAGE, 200, "", 1), ("good.example", 1, "/b", 200, PAGE, 404, PAGE, 1), ("good.example", 2, "/c", 200, PAGE, 200, "", 1),
        ("https://full.example/", 0, "/few", 200, PAGE, 200, None, 1), ("https://full.example/", 1, "/sure", 200, MANY, 200, "", 1), ("https://full.example/", 2, "/more", 200, MANY + PAGE, 200, "", 1),
        ("play.example", 0, "/a", 200, PAGE, 200, "", 1), ("same.example", 0, "/a", 200, PAGE, 200, PAGE, 1), ("none.example", 0, "/a", 200, None, 200, None, 1),
        ("shut.example", 0, "/a", 200, PAGE, 200, "", 1),
    ]
    details = [("https://good.example/page-aaa/", 200, SHARES, 1), ("https://good.example/page-aaa/", 200, "x", 1), ("https://good.example/page-bbb/", 404, SHARES, 1), ("https://full.example/t/1001.html", 200, SHARES, 1)]
    details += [("https://full.example/page-aaa/", 200, SHARES, 1), ("https://play.example/page-aaa/", 200, "play", 1), ("https://shut.example/page-aaa/", 200, SHARES, 1), (None, 200, None, 1)]
    got = probed(spark, homes, searches, details)
    good, full = got["good.example"], got["https://full.example/"]
    assert good.ok and (good.template, good.real_hits, good.noise_hits, good.link_yield, good.error) == ("/b", 4, 0, 2, "") and good.result_re == r"https://good\.example/[a-z0-9_-]+/"
    # The first sure search ends it, though a later one finds more.
    assert (full.template, full.real_hits, full.link_yield, full.result_re) == ("/sure", 25, 2, r"https://full\.example/[a-z0-9_-]+/\d+\.html")
    assert {d: r.error for d, r in got.items() if not r.ok} == {"play.example": "no-share-links", "same.example": "no-pattern", "none.example": "no-pattern", "shut.example": "http:503", "gone.example": "ConnectError"}
    assert probed(spark, homes, searches, details, sure=(99, 99))["https://full.example/"].template == "/more"


def test_pattern_with_most(spark):
    """The list comes second by likeness but first by yield; a pattern with enough ends the trial."""
    page = LISTS + VIEWS
    many = SHARES + "".join(f" https://pan.quark.cn/s/k{k}" for k in range(4))
    details = [("https://x.example/topics/list/sort_id/1", 200, many, 1), ("https://x.example/topics/view/700000_Some_Title_0.html", 200, SHARES, 1)]
    args = [("x.example", 200, None)], [("x.example", 0, "/a", 200, page, 200, "", 1)]
    assert probed(spark, *args, details)["x.example"].result_re.endswith(r"/\d+")
    assert probed(spark, *args, details, enough=2)["x.example"].result_re.endswith(r"\.html")
    assert probed(spark, *args, [])["x.example"].error == "no-share-links"


def test_empty(spark):
    assert probed(spark, [], [], []) == {}
