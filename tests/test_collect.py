"""Collecting from captured answers, on literals."""

import datetime

from pyspark.sql import functions as F

from weftline.operators import collect

AT = datetime.datetime(2024, 1, 1, 12)


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_mirrors(spark):
    mirrors = rows(spark, [("a", 0), ("b", 1), ("c", 2)], "name string, place int")
    failed = rows(spark, [("a", AT - datetime.timedelta(seconds=60)), ("b", AT - datetime.timedelta(seconds=600))], "name string, failed_at timestamp")
    turns = {r.name: r.turn for r in collect.by_health(mirrors, failed, F.lit(AT)).collect()}
    assert turns == {"b": 0, "c": 1, "a": 2}
    answers = [("q", "b", 0, 5000, True), ("q", "c", 1, 100, True), ("r", "b", 0, 10, False), ("r", "a", 2, 10, True), ("s", "b", 0, 10, False)]
    got = collect.hedged(rows(spark, answers, "query string, mirror string, turn int, latency_ms int, ok boolean"), 800).collect()
    assert {(r.query, r.mirror, r.came_ms) for r in got} == {("q", "c", 900), ("r", "a", 1610)}


def test_crawl(spark):
    messages = [(c, p, 100 - 10 * p - k) for c in "ab" for p in range(6) for k in range(10)]
    fresh, state = collect.crawl(rows(spark, messages, "channel string, page int, msg_id long"), rows(spark, [("a", 75)], "channel string, newest long"), 4)
    got = {(r.channel, r.msg_id) for r in fresh.collect()}
    assert got == {("a", m) for m in range(76, 101)} | {("b", m) for m in range(61, 101)}
    assert {tuple(r) for r in state.collect()} == {("a", 100, 71, 30, True), ("b", 100, 61, 40, False)}


def test_harvest(spark):
    pages = rows(spark, [("movies", '<a href="https://t.me/Alpha_1">x</a> https://t.me/s/alpha_1'), ("ads", "https://t.me/spammer"), ("books", None)], "category string, html string")
    got = collect.harvest(pages, rows(spark, [("movies", "movie"), ("books", "ebook")], "category string, vertical string")).collect()
    assert [(r.vertical, r.channel) for r in got] == [("movie", "Alpha_1")]


def test_sites(spark):
    sites = rows(spark, [("A.org", "https://s.a.org/?q={q}", "ok yield=12 x", ["game"]), ("b.org", None, None, ["general"])], "domain string, search string, note string, verticals array<string>")
    assert [(r.host, r["yield"]) for r in collect.load_sites(sites).collect()] == [("s.a.org", 12), ("b.org", 0)]
    assert [r.domain for r in collect.for_verticals(sites, ["movie"]).collect()] == ["b.org"] and collect.for_verticals(sites, [], every=True).count() == 2


def test_answers(spark):
    got = collect.result_pages(rows(spark, [("e", 0, 200, '<a href="https://a.org/1">https://a.org/1</a> https://b.org'), ("e", 1, 429, "https://c.org"), ("e", 2, 200, "https://d.org"), ("f", 0, 500, "https://x.org")], "engine string, seq int, http_status int, html string"))
    assert [(r.engine, r.url) for r in got.orderBy("engine", "seq", "pos").collect()] == [("e", "https://a.org/1"), ("e", "https://b.org")]
    body = lambda *ids: '{"code":0,"data":{"result":[' + ",".join(f'{{"bvid":"{i}","title":"t{i}"}}' for i in ids) + "]}}"
    found = collect.site_videos(rows(spark, [("x", 0, body("1", "2")), ("x", 1, '{"code":-412}'), ("x", 2, body("3")), ("y", 0, body("2", "4")), ("z", 0, "no")], "template string, page int, body string"))
    assert sorted((r.video, r.template, r.title) for r in found.collect()) == [("1", "x", "t1"), ("2", "x", "t2"), ("4", "y", "t4")]


def test_cells(spark):
    cells = [(1, "https://pan.quark.cn/s/a 提取码 ab12", "zz99", "t"), (2, "https://pan.quark.cn/s/b 提取码 ab12", "", None), (3, "none", None, None), (4, "none", None, None), (5, None, None, None)]
    hits, rejects = collect.cell_hits(rows(spark, cells, "line int, url string, pwd string, title string"))
    assert sorted((r.line, r.pwd, r.title) for r in hits.collect()) == [(1, "zz99", "t"), (2, "ab12", None)]
    assert sorted((r.text, r.line) for r in rejects.collect()) == [("(empty)", 5), ("none", 3)]


def test_small(spark):
    assert collect.noise_word(8, 1) == collect.noise_word(8, 1) and len(collect.noise_word(8)) == 8
    assert collect.anchor(["a", "b", "c"], [5, 2, 0], 10) == "b" and collect.anchor(["a"], [0], 10) == "a" and collect.anchor([], [], 0) is None
    assert collect.snapshot("f/", "q").startswith("f/") and len(collect.snapshot("f", "q")) == 18
    table = collect.keyword_table()
    assert all(len(a) >= len(b) for words in table.values() for a, b in zip(words, words[1:]))
    one = rows(spark, [("alive", "quark", "k"), ("odd", "xunlei", "k")], "status string, kind string, key string")
    got = one.select(collect.known_status(F.col("status")).alias("s"), collect.can_check(F.col("kind")).alias("c"), collect.cache_key(2, F.col("kind"), F.col("key")).alias("k")).collect()
    assert [tuple(r) for r in got] == [("alive", True, "v2:quark:k"), ("unknown", False, "v2:xunlei:k")] and collect.alive_only(one).count() == 1
    links = rows(spark, [('[{"pos":1,"url":"https://a","pan_type":"quark","pwd":null}]',), (None,)], "j string").select(collect.decode_links(F.col("j")).alias("l"))
    assert [len(r.l) for r in links.collect()] == [1, 0] and '"url":"https://a"' in links.select(collect.encode_links(F.col("l")).alias("j")).first().j
    assert rows(spark, [(0,)], "s long").select(collect.epoch(F.col("s")).cast("string").alias("t")).first().t == "1970-01-01 00:00:00"
    health = rows(spark, [("a", 1), ("b", 2)], "domain string, fails int")
    assert collect.reset(health).count() == 0 and [r.domain for r in collect.reset(health, rows(spark, [("a",)], "domain string")).collect()] == ["b"]
