"""Upkeep, federation, extraction by configuration: literals and plain versions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import html, links, urls
from weftline.operators import evaluation, liveness, maintain
from weftline.plans import federation
from weftline.sources import captured, sinks


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_nearest_codes():
    """Against all pairs in order."""
    rng = random.Random(2)
    for _ in range(300):
        spans, at = [], 0
        for _ in range(rng.randrange(1, 7)):
            at += rng.randrange(1, 90)
            spans.append((at, at + rng.randrange(5, 40)))
            at = spans[-1][1]
        codes = sorted(c for c in (rng.randrange(0, at + 60) for _ in range(rng.randrange(6))) if not any(a <= c < b for a, b in spans))
        pairs = sorted((c - b if c >= b else a - c + 20, i, k) for i, c in enumerate(codes) for k, (a, b) in enumerate(spans) if (c - b if c >= b else a - c + 20) <= 120)
        taken, spent = {}, set()
        for _, i, k in pairs:
            if k not in taken and i not in spent:
                taken[k] = i
                spent.add(i)
        assert links.nearest_codes(spans, codes) == taken


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("https://pan.baidu.com/share/init?surl=AbC&pwd=12ab", ("https://pan.baidu.com/share/init?surl=AbC&pwd=12ab", "12ab")),
        ("pan.baidu.com/share/init?surl=AbC", ("https://pan.baidu.com/share/init?surl=AbC", None)),
        ("https://pan.quark.cn/login", None), ("two words", None), ("", None), ("https://example.com/s/1", None),
    ],
)
def test_single_link(text, expected):
    got = links.find_or_single(text)
    assert (got[0]["url"], got[0]["pwd"]) == expected if expected else got == []


def test_code_before_link():
    assert [(r["url"], r["pwd"]) for r in links.find("密码 http://pan.quark.cn/s/a 提取码 zz11")] == [("http://pan.quark.cn/s/a", "zz11")]
    many = " ".join(f"https://pan.quark.cn/s/k{i} 提取码：{i:04d}" for i in range(3000))
    got = links.find(many)
    assert len(got) == 3000 and all(r["pwd"] == f"{i:04d}" for i, r in enumerate(got))


def test_forms():
    page = '<form action=search.php><input type=hidden name=a><input NAME="req"></form><form method="POST"><input name="q"></form><form><input type="text"></form>'
    assert html.find_search_forms(page, "https://a.org") == ["https://a.org/search.php?req={q}"]
    assert html.find_search_forms(None, "x") == [] and html.find_search_forms("<form action='/f?x=1'><input name=k>", "https://a.org/") == ["https://a.org/f?x=1&k={q}"]


def test_magnets(spark):
    page = '<tr><td><a href="/1">Long name</a></td><td><a href="magnet:?xt=urn:btih:' + "a" * 40 + '&amp;dn=[S] X&amp;tr=t">m</a></td></tr>'
    got = federation.magnet_hits(rows(spark, [(1, "u", page), (2, "u", page), (3, "u", None), (4, "u", "")], "seq long, url string, html string")).collect()
    assert [(r.seq, r.url, r.title) for r in got] == [(1, "magnet:?xt=urn:btih:" + "a" * 40 + "&dn=%5BS%5D", "[S]")]


def test_items(spark):
    page = '<a href="/e/1"> One  <b>x</b></a><a href="https://o.org/2">Two</a><a href="/e/1">again</a>'
    (r,) = rows(spark, [(page,)], "p string").select(html.items(F.col("p"), r'<a href="([^"]+)">(?:.*?)</a>', "https://s.org").alias("x")).collect()
    assert [tuple(i) for i in r.x] == [("https://s.org/e/1", "One x"), ("https://o.org/2", "Two")]


def test_frames(spark):
    rng = random.Random(4)
    arrivals, expected = [], []
    for s in range(5):
        at = hits = 0
        shown = None
        for _ in range(40):
            at, hits = at + rng.randrange(1, 300), hits + rng.randrange(0, 20)
            arrivals.append((s, at, hits))
            if shown is None or hits - shown[1] >= 25 or at - shown[0] >= 400:
                shown = (at, hits)
                expected.append((s, *shown))
    rng.shuffle(arrivals)
    got = federation.frames(rows(spark, arrivals, "search long, at_ms long, hits long")).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_plans(spark, tmp_path):
    some = rows(spark, [("a", True), ("b", False), ("c", None)], "name string, enabled boolean")
    assert sorted(r.name for r in federation.planned(some).collect()) == ["a", "c"] and [r.name for r in federation.planned(some, ["a", "b"]).collect()] == ["a"]
    assert federation.types_of("百度，quark", ["baidu", "quark"], {"百度": "baidu"}) == ["baidu", "quark"]
    with pytest.raises(ValueError, match="known: baidu"):
        federation.types_of("odd", ["baidu"])
    (tmp_path / "c.yaml").write_text("sources:\n  - name: a\n    enabled: true\n")
    assert federation.config(spark, f"file://{tmp_path}/c.yaml") == {"sources": [{"name": "a", "enabled": True}]}


def test_pages(spark):
    pages = rows(spark, [("https://a.org/dune-2", "<title>Dune</title><p>https://pan.quark.cn/s/a 提取码 ab12</p>"), ("https://a.org/x", "<title>Other</title>https://pan.quark.cn/s/b")], "url string, html string")
    chosen = federation.by_slug(rows(spark, [(1, "https://a.org/x"), (2, "https://a.org/dune-2")], "seq long, url string"), "dune", 5)
    assert [r.seq for r in chosen.collect()] == [2, 1]
    got = federation.page_hits(chosen, pages, "dune", "site", "forum").collect()
    assert [(r.url, r.pwd, r.title, r.origin) for r in got] == [("https://pan.quark.cn/s/a", "ab12", "Dune", "https://a.org/dune-2")]
    jobs = federation.engine_jobs(rows(spark, [("e", "https://e.org/?q={q}")], "engine string, url string"), rows(spark, [("{kw} 网盘",)], "template string"), "沙丘").collect()
    assert [r.url for r in jobs] == ["https://e.org/?q=%E6%B2%99%E4%B8%98%20%E7%BD%91%E7%9B%98"]


def test_video_texts(spark):
    found = rows(spark, [(1, "t", "known words"), (2, "u", "x")], "video long, title string, text string")
    got = federation.video_texts(found, rows(spark, [(1, "known"), (2, "more")], "video long, description string"), rows(spark, [(2, "said")], "video long, text string")).collect()
    assert sorted((r.video, r.text, r.stage) for r in got) == [(1, "known words", "field"), (2, "more", "detail"), (2, "said", "comment"), (2, "x", "field")]


def test_early(spark):
    early = [("k", None, "alive", 1), ("k", None, "dead", 2), ("k", "ab12", "need_pwd", 1)]
    got = federation.with_early(rows(spark, [("k", None), ("k", "ab12"), ("o", None)], "key string, pwd string"), rows(spark, early, "key string, pwd string, status string, checked_at long")).collect()
    assert {(r.key, r.pwd): r.early_status for r in got} == {("k", None): "dead", ("k", "ab12"): "need_pwd", ("o", None): None}


def test_annotate_latest(spark):
    """Two cached rows of a key give one resource, with what was checked last."""
    at = [datetime.datetime(2024, 1, 30, 20 + h) for h in range(3)]
    cache = rows(spark, [("k", None, "alive", at[0], False, None, 1), ("k", None, "need_pwd", at[1], True, "hint", 2), ("k", "x", "dead", at[2], False, None, 3)], "cache_key string, pwd string, status string, checked_at timestamp, pwd_verified boolean, title_hint string, event_id long")
    resources = rows(spark, [("k", None, None), ("k", "y", "t")], "key string, pwd string, title string")
    got = liveness.annotate(resources, cache, F.lit(datetime.datetime(2024, 1, 31))).collect()
    assert sorted((r.pwd or "", r.status, r.title, r.pwd_verified) for r in got) == [("", "need_pwd", "hint", True), ("y", "unchecked", "t", False)]


def test_upkeep(spark, tmp_path):
    clock = [1_000_000.0]
    files = maintain.Files(spark, f"file://{tmp_path}/run", lambda: clock[0])
    assert maintain.run(files, lambda: {"checked": 1}) == {"checked": 1} and files.read("state.json")["runs"] == 1
    assert maintain.run(files, lambda: {})["skipped"] == "interval"
    clock[0] += 7 * 3600
    assert files.acquire() and maintain.run(files, lambda: {}) == {"skipped": "locked"}
    clock[0] += 4 * 3600  # the lock was left behind
    assert maintain.run(files, lambda: {"checked": 2}) == {"checked": 2} and files.read("state.json")["runs"] == 2
    with pytest.raises(ZeroDivisionError):
        maintain.run(files, lambda: {"x": 1 / 0}, force=True)
    assert files.acquire() and files.read("none.json") == {}


def test_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    for k, at in enumerate(("2024-01-01", "2024-01-03", "2024-01-02")):
        sinks.append_log(spark, path, "ab"[k % 2], 3, at)
    assert [(r.kw, r.times) for r in sinks.read_log(spark, path, 5).collect()] == [("b", 1), ("a", 2)]


def test_batch_round_trip(spark, tmp_path):
    checked = rows(spark, [("https://a/s/1", "ab12", "=x", "alive", "ok"), ("https://b/s/2", None, None, "dead", None)], "url string, pwd string, title string, status string, note string")
    sinks.write_csv(sinks.batch_rows(checked), f"file://{tmp_path}/b")
    assert sorted((r.url, r.pwd, r.title) for r in captured.batch_csv(spark, f"file://{tmp_path}/b").collect()) == [("https://a/s/1", "ab12", "=x"), ("https://b/s/2", None, None)]
    text = "[" + ",".join(r.value for r in sinks.batch_document(checked).collect()) + "]"
    assert sorted((r.url, r.pwd, r.title) for r in captured.batch_json(spark, text).collect()) == [("https://a/s/1", "ab12", "=x"), ("https://b/s/2", None, None)]
    sites = rows(spark, [("b", "b.org", ["x"], ""), ("a", "a.org", ["x"], "n"), ("c", "c.org", [], "")], "name string, domain string, verticals array<string>, note string")
    assert [r.line for r in sinks.catalogue_lines(sites).collect()] == ['{"name":"c","domain":"c.org"}', '{"name":"a","domain":"a.org","verticals":["x"],"note":"n"}', '{"name":"b","domain":"b.org","verticals":["x"]}']


def test_hosts(spark):
    hosts = ["bing.com", "www.bing.com", "box.com", "google.de", "notbing.com", "site.cn"]
    got = rows(spark, [(h,) for h in hosts], "h string").select("h", urls.is_noise(F.col("h"), ["bing.com", "x.com", "google."]).alias("n"), urls.is_chinese_site(F.col("h")).alias("c")).collect()
    assert [r.n for r in got] == [True, True, False, True, False, False] and [r.c for r in got] == [False] * 5 + [True]


def test_query_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("# all\nmovie\t沙丘 2 # x\nodd\n\nmusic\tserum\n")
    assert [tuple(r) for r in evaluation.query_file(spark, f"file://{tmp_path}/q.txt").collect()] == [("movie", "沙丘 2"), ("music", "serum")]
    assert evaluation.subject_of("沙丘 2 电影") == "沙丘"


def test_direct_in_batches(spark):
    answers = rows(spark, [("k", None, "direct", 200, "")], "key string, pwd string, endpoint string, http_status int, body string")
    assert [liveness.decide(answers, F.current_timestamp(), d).first().status for d in ("alive", "unsupported")] == ["alive", "unsupported"]
