"""URLs, texts, links, queries on literals."""

import random

import pytest
from pyspark.sql import functions as F

from weftline import session
from weftline.functions import html, links, text, urls
from weftline.operators import liveness, ranking, resolve, tables
from weftline.plans import query, search
from weftline.sources import captured, sinks


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def test_urls(spark):
    cases = [
        ("https://pan.baidu.com/s/1AbC?pwd=12aB", "baidu", "1AbC", "12aB", "baidu:1AbC"),
        ("https://pan.baidu.com/share/init?surl=AbC", "baidu", "AbC", None, "baidu:AbC"),
        ("https%3A%2F%2Fpan.baidu.com%2Fs%2F1xyz", "other", "1xyz", None, None),
        ("https://pan.quark.cn/s/k1/#zz99", "quark", None, "zz99", "quark:pan.quark.cn/s/k1"),
        ("https://notpan.quark.cn.evil.com/s/1", "other", None, None, None),
        ("magnet:?xt=urn:btih:ABC123&dn=a&tr=x", "magnet", None, None, "magnet:abc123"),
        ("http://|file|x:2026|", "other", None, None, None),
        ("https://libgen.rs/b/1", "direct", None, None, "direct:libgen.rs/b/1"),
    ]
    u = F.col("url")
    got = rows(spark, [(c[0],) for c in cases], "url string").select("url", urls.provider(u).alias("p"), urls.share_token(u).alias("t"), urls.code_in_url(u).alias("c"), urls.resource_key(urls.provider(u), u, F.when(urls.provider(u) == "baidu", urls.share_token(u))).alias("k"))
    for r, (_, p, t, c, k) in zip(got.collect(), cases):
        assert (r.p, r.t, r.c) == (p, t, c), r
        assert k is None or r.k == k
    one = rows(spark, [("magnet:?xt=urn:btih:A&dn=n%20m&tr=t1&tr=t2",)], "url string").select(urls.without_display_name(u).alias("a"), urls.magnet_name(u).alias("b")).first()
    assert tuple(one) == ("magnet:?xt=urn:btih:A&tr=t1&tr=t2", "n m")
    shape = rows(spark, [("/a-b.html",), ("/archives/1234",), ("/-/",)], "p string").select(urls.path_shape(F.col("p")).alias("s")).collect()
    assert [r.s for r in shape] == [r"/[a-z0-9_-]+\.html", r"/[a-z0-9_-]+/\d+", None]


def test_links():
    found = links.find("A https://pan.quark.cn/s/k1 提取码: ab12 B 备用 pan.baidu.com/s/1zz 密码 9x8y magnet:?xt=urn:btih:" + "a" * 40)
    assert [(r["url"], r["pwd"]) for r in found[:2]] == [("https://pan.quark.cn/s/k1", "ab12"), ("https://pan.baidu.com/s/1zz", "9x8y")]
    assert found[2]["pan_type"] == "magnet"
    assert links.find("https://pan.quark.cn/login 和 https://drive.uc.cn/s/abc我用") == [{"pos": 29, "url": "https://drive.uc.cn/s/abc", "pan_type": "uc", "pwd": None}]
    assert links.find(None) == [] and links.find("") == []
    assert links.nearest_codes([(0, 10), (30, 40)], [12, 42]) == {0: 0, 1: 1}


def test_text(spark):
    t = F.col("t")
    got = rows(spark, [("Ｃ＃ ÄB",), (None,), ("Plain",)], "t string").select(text.folded(t).alias("x")).collect()
    assert [r.x for r in got] == ["c# äb", None, "plain"]
    tokens = rows(spark, [("沙丘 预言",), ("沙丘 4k",), ("单",)], "t string").select(text.mixed_tokens(t).alias("x")).collect()
    assert [r.x for r in tokens] == [["沙丘", "丘预", "预言"], ["沙丘", "4k"], ["单"]]
    safe = rows(spark, [("=1+1",), ("+1",), ("-2",), ("@S",), ("\tx",), ("ok",)], "t string").select(t, text.csv_plain(text.csv_safe(t)).alias("b"), text.csv_safe(t).alias("s")).collect()
    assert all(r.t == r.b for r in safe) and sum(r.s != r.t for r in safe) == 5
    assert rows(spark, [("提取码：ab12",), ("（zz99）",), ("x",)], "t string").select(text.code_in_text(t).alias("c")).collect() == [("ab12",), ("zz99",), (None,)]
    page = rows(spark, [("<title> A &amp; <b>B</b></title><p>x<br>y</p><script>z</script>",)], "t string").select(html.title(t).alias("a"), html.text(t).alias("b")).first()
    assert page.a == "A & B" and "z" not in page.b and "A & B" in page.b


@pytest.mark.parametrize(("asked", "forms"), [("沙丘 4K HDR", ["沙丘"]), ("沙丘 2", ["沙丘"]), ("2 沙丘", ["沙丘"]), ("1 2", []), ("沙丘", []), ("", [])])
def test_relaxed(asked, forms):
    assert query.relaxed(asked) == forms


def test_query():
    q = query.analyse("AutoCAD破解版 电影 第二季")
    assert q.terms == ("autocad", "破解版", "电影", "第二季") and q.required == ("autocad",)
    assert query.aliases("大气合成器") == ["Omnisphere"] and query.verticals("vst 音源")[0] == "audio-tool"
    assert query.peel("HDMI") == ["HDMI"]


def fold(hits):
    """The grouping as a plain loop, in order of seq."""
    out = {}
    for h in sorted(hits, key=lambda h: h["seq"]):
        r = out.setdefault(h["url"], {"n": 0, "pwd": None, "title": None, "sources": []})
        r["n"] += 1
        r["pwd"] = r["pwd"] or h["pwd"]
        if h["title"] and len(h["title"]) > len(r["title"] or ""):
            r["title"] = h["title"]
        if h["source"] not in r["sources"]:
            r["sources"].append(h["source"])
    return out


def test_resolve_any_order(spark):
    rng = random.Random(3)
    hits = [{"seq": k, "source": f"s{rng.randrange(4)}", "kind": "tg", "url": f"https://pan.quark.cn/s/{rng.randrange(5)}", "pwd": rng.choice([None, "ab12", "cd34"]), "title": rng.choice([None, "a", "bb", "cc", "ddd"]), "size": None, "shared_at": None, "origin": None, "relaxed": False, "query": "q", "rank": k} for k in range(60)]
    expected = fold(hits)
    rng.shuffle(hits)
    got = resolve.resolve(rows(spark, [tuple(h.values()) for h in hits], search.HIT).repartition(7)).collect()
    assert {r.url: {"n": r.hit_count, "pwd": r.pwd, "title": r.title, "sources": r.sources} for r in got} == expected


def test_relevance(spark):
    titles = [("沙丘2 4K",), ("沙丘 2026",), ("",), ("别的",)]
    got = rows(spark, titles, "t string").select(ranking.title_relevance(F.lower("t"), query.analyse("沙丘 2")).alias("r")).collect()
    assert [r.r for r in got] == [1.0, 0.725, 0.3, 0.1]


def test_decisions(spark):
    answers = [("k", "1234", "baidu_code", 200, '{"errno":-9}'), ("k", "1234", "baidu_liveness", 200, '{"errno":0}'), ("d", "x", "baidu_code", 200, '{"errno":-62}'), ("d", "x", "baidu_liveness", 200, '{"errno":-3}')]
    told = liveness.decide(rows(spark, answers, "key string, pwd string, endpoint string, http_status int, body string"), F.current_timestamp())
    assert {r.key: r.status for r in liveness.decide_with_code(told).collect()} == {"k": "wrong_pwd", "d": "dead"}


def test_upsert(spark):
    old, new = rows(spark, [(1, "a"), (2, "b")], "k int, v string"), rows(spark, [(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_sources(spark, tmp_path):
    body = '{"merged_by_type":{"quark":[{"url":"https://pan.quark.cn/s/1","password":"","note":"n","source":"tg:c","datetime":"2024-01-02"}]}}'
    hit = captured.merged_payload(rows(spark, [(body,)], "body string")).first()
    assert (hit.source, hit.kind, hit.pwd, str(hit.shared_at)) == ("tg:c", "tg", None, "2024-01-02 00:00:00")
    api = captured.api_items(rows(spark, [('{"items":[{"id":"7","t":"x"},{"t":"y"}]}',)], "body string"), "$.items", "$.id", "$.t", template="https://a.org/{id}").collect()
    assert [(r.url, r.title) for r in api] == [("https://a.org/7", "x")]
    batch = captured.batch_json(spark, '{"results":[{"链接":"https://a","提取码":"1"},{"url":"https://b"}]}').collect()
    assert [(r.url, r.pwd) for r in batch] == [("https://a", "1"), ("https://b", None)]
    assert [captured.sniff(x) for x in ('[1]', "链接,提取码\na,b", "see https://x")] == ["json", "csv", "text"]
    page = '<div data-post="chan/5"><div class="message_text">沙丘 <a href="https://pan.quark.cn/s/q1">l</a> 提取码 ab12</div><time datetime="2024-01-01T00:00:00+00:00"></div>'
    message = captured.message_pages(rows(spark, [("Asked", page)], "channel string, html string")).first()
    assert (message.channel, message.msg_id, message.links[0].url) == ("Asked", 5, "https://pan.quark.cn/s/q1")
    (tmp_path / "c.txt").write_text("@alpha # x\nhttps://t.me/s/beta1\n# no\nalpha\n+invite\n")
    assert [r.channel for r in captured.channel_list(spark, f"file://{tmp_path}/c.txt").collect()] == ["alpha", "beta1"]
    raw = rows(spark, [(bytearray("密码".encode("gb18030")),), (bytearray("﻿ok".encode()),)], "b binary").select(captured.decode("b").alias("s")).collect()
    assert [r.s for r in raw] == ["密码", "ok"]


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table t (k integer, v text)")
        db.executemany("insert into t values (?, ?)", [(i, f"v{i}") for i in range(10)])
    spark.dataSource.register(captured.SqliteSource)
    df = spark.read.format("weftline_sqlite").options(path=str(tmp_path / "x.db"), table="t", partitions="3").load()
    assert sorted(map(tuple, df.collect())) == [(i, f"v{i}") for i in range(10)]


def test_export_round_trip(spark, tmp_path):
    out = sinks.export_rows(rows(spark, [("https://a/s/1", None, "=x", "alive", 1.0, ["a", "b", "c", "d"])], "url string, pwd string, title string, status string, score double, sources array<string>"))
    sinks.write_csv(out, f"file://{tmp_path}/o")
    back = captured.batch_csv(spark, f"file://{tmp_path}/o").first()
    assert (back.url, back.title, back.sources) == ("https://a/s/1", "=x", "a; b; c")


def test_search(spark):
    hits = [(0, "s", "tg", "https://pan.quark.cn/s/1", None, "沙丘 2 4K", None, None, None, False, "沙丘 2", 0), (1, "t", "tg", "https://pan.quark.cn/s/2", None, "别的 电影", None, None, None, False, "沙丘 2", 0), (2, "t", "tg", "https://nowhere.com/s/2", None, "沙丘 2", None, None, None, False, "沙丘 2", 1)]
    got = search.search(rows(spark, hits, search.HIT), "沙丘 2", now=F.current_timestamp()).collect()
    assert [r.url for r in got] == ["https://pan.quark.cn/s/1"] and got[0].relevance == 1.0


def test_titles_with_references_cut_off(spark):
    """A reference that no semicolon ends stays as it is."""
    pages = spark.createDataFrame([("<title>a &amp;&amp</title>",), ("<title>x &#39;&#x41; &hellip; &notit; &lt</title>",), ("<title> &nosuch; </title>",)], "html string")
    from weftline.functions import html

    assert [r.t for r in pages.select(html.title(F.col("html")).alias("t")).collect()] == ["a &&amp", "x 'A … &notit; &lt", "&nosuch;"]


def test_batches_of_pages_are_bounded(spark):
    """Python workers get a few megabytes of pages at once, however many rows these are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(64 << 20))
        session.ship(spark)
        assert int(spark.conf.get(name)) == session.BATCH_BYTES
    finally:
        spark.conf.set(name, before)


def test_verticals_of_mixed_texts(spark):
    """Keywords without ASCII are looked for between its runs: none is found across one, and those of both kinds as they are."""
    rows = spark.createDataFrame([("AE 模板 x",), ("电a影",), ("the 电影",), ("hi-res 音 乐",), ("论文 x",), (None,)], "t string")
    found = rows.select(text.verticals(F.col("t")).alias("v"))
    assert [r.v for r in found.collect()] == [["design"], [], ["movie"], ["music"], ["academic"], found.collect()[-1].v]
    assert "regexp_replace" in found._jdf.queryExecution().optimizedPlan().toString()
