"""Scans that stop at a quota, site searches, and what became of a search's hits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.operators import quota
from weftline.plans import search


@pytest.mark.parametrize(("most", "chunk"), [(2, 1), (3, 4), (0, 2), (50, 5)])
def test_scan(spark, most, chunk):
    rng = random.Random(most)
    rows = [(g, k, rng.random() < 0.3 if rng.random() < 0.9 else None) for g in "abc" for k in range(rng.randrange(1, 30))]
    got = {(r.g, r.place) for r in quota.scan(spark.createDataFrame(rows, "g string, place int, ok boolean"), "g", "place", F.col("ok"), most, chunk).collect()}
    want = set()
    for g in "abc":
        own, n = [r for r in rows if r[0] == g], 0
        for at in range(0, len(own), chunk):
            if n >= most:
                break
            want |= {(g, r[1]) for r in own[at : at + chunk]}
            n += sum(bool(r[2]) for r in own[at : at + chunk])
    assert got == want


def link(k):
    return f'<a href="https://pan.quark.cn/s/{k}">x</a>'


def test_site_search(spark):
    """Pages with a word in their URL first; those whose title has no word don't count; links once, where they come first."""
    sites = spark.createDataFrame([("one", "https://one.cn/?s={q}", r"https://one\.cn/[a-z0-9-]+\.html", 0), ("two", "https://two.cn/{q}", r"https://two\.cn/\d+", 1), ("three", "https://three.cn/{q}", "https://three.cn/x", 2)], "site string, search string, result_re string, place int")
    first = link("direct") + "".join(f'<a href="/{p}.html">' for p in ("new", "tag-x", "serum-b", "old", "serum-a")) + '<a href="/tag/serum.html"><a href="/new.html">'
    searches = [("https://one.cn/?s=Serum", 200, first), ("https://two.cn/Serum", 503, first)]
    details = [
        ("https://one.cn/serum-b.html", 200, f"<title>Serum B</title>{link('b')}{link('direct')}"), ("https://one.cn/serum-a.html", 200, f"<title>Other</title> serum {link('a')}"),
        ("https://one.cn/new.html", 200, f"serum without a title {link('n')}"), ("https://one.cn/old.html", 200, f"<title>Serum old</title>{link('o')}"), ("https://one.cn/tag-x.html", 404, link("t")),
    ]
    frame = lambda rows: spark.createDataFrame(rows, "url string, http_status int, html string")
    hits, report = quota.site_search(sites, frame(searches), frame(details), "Serum", 2, 1)
    assert {(r.url[-1], r.page, r.title) for r in hits.collect()} == {("t", -1, None), ("b", 0, "Serum B"), ("n", 3, None)}
    assert {(r.site, r.error, r["read"], r.relevant, r.hits) for r in report.collect()} == {("one", None, 4, 2, 3), ("two", "http:503", 0, 0, 0), ("three", "no-answer", 0, 0, 0)}
    every, _ = quota.site_search(sites, frame(searches), frame(details), "Serum", 9, 2)
    assert {r.url[-1] for r in every.collect()} == set("tbno")


HITS = [
    (0, "a", "tg", "https://pan.quark.cn/s/k1", None, "三体 全集"), (1, "b", "api", "https://pan.quark.cn/s/k1", None, "三体"), (2, "a", "tg", "https://pan.baidu.com/s/1abc", "ab12", "三体 4k"),
    (3, "porn-x", "tg", "https://pan.quark.cn/s/k3", None, "三体"), (4, "a", "tg", "https://pan.quark.cn/s/k4", None, "黑夏"), (5, "a", "tg", "https://pan.quark.cn/s/k5", None, "网盘 下载"),
]


def hits(spark):
    rows = spark.createDataFrame(HITS, "seq long, source string, kind string, url string, pwd string, title string")
    empty = {"size": "string", "shared_at": "timestamp", "origin": "string"}
    return rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), F.lit(False).alias("relaxed"), F.lit("三体").alias("query"), F.lit(0).alias("rank"))


def test_outcome(spark):
    """Rows as the search has them, and counts of all, taken by one job."""
    cache = spark.createDataFrame([("quark:pan.quark.cn/s/k1", "dead"), ("quark:pan.quark.cn/s/k5", "alive")], "cache_key string, status string").select("cache_key", "status", F.lit(None).cast("string").alias("pwd"), F.lit(False).alias("pwd_verified"), F.lit(None).cast("string").alias("title_hint"), F.current_timestamp().alias("checked_at"))
    options = {"cache": cache, "drop_sources": ["porn"]}
    o = search.outcome(hits(spark), "三体", 1, **options)
    assert [r.key for r in o.rows] == [r.key for r in search.search(hits(spark), "三体", limit=1, **options).collect()]
    assert {k: o.counts[k] for k in ("raw_hits", "adult_pruned", "dedup_count", "irrelevant_pruned", "kept", "alive")} == {"raw_hits": 6, "adult_pruned": 1, "dedup_count": 4, "irrelevant_pruned": 1, "kept": 2, "alive": 1}
    assert o.pruned == 1 and o.by("type") == {"quark": 3, "baidu": 1} and o.by("status") == {"dead": 1, "alive": 1, "unchecked": 1} and o.slowest in ("plan", "run")
    assert search.Outcome("x", [], {}, {}, []).slowest == ""


def test_json(spark, tmp_path, capsys):
    hits(spark).write.parquet(f"file://{tmp_path}/hits")
    assert cli.main(["search", "三体", "--hits", f"file://{tmp_path}/hits", "--json", "-n", "2"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["raw_hits"] == 6 and len(told["results"]) == 2 and told["types"] == {"quark": 4, "baidu": 1} and told["pruned"] == 0
