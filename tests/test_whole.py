"""Whole texts, whole caches: what stands late in a text or in a table counts too."""

import datetime

from weftline.functions import links, text
from weftline.plans import queries_more, queries_web, search
from weftline.sources import captured


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_link_extract(spark, tmp_path):
    late = "word " * 100 + "https://pan.quark.cn/s/late 提取码：zz99 " + "word " * 100
    texts = [late, "", None, "magnet:?xt=urn:btih:" + "a" * 40 + " " + "x " * 3000]
    got = queries_more.link_extract(spark, documents(spark, tmp_path, texts)).collect()
    expected = set()
    for i, t in enumerate(texts):
        note = f"{t or ''} 链接 https://pan.quark.cn/s/k{i} 密码ab{i:02d} pan.baidu.com/s/1x{i} pwd 9x8y"
        expected |= {(i, r["pos"], r["url"], r["pan_type"], r["pwd"]) for r in links.find(note)}
    assert set(map(tuple, got)) == expected and (0, "https://pan.quark.cn/s/late", "zz99") in {(r.doc_id, r.url, r.pwd) for r in got}


def test_truncate_notes(spark, tmp_path):
    texts = [" " * 500 + "word " * 40, "a" + " \n" * 300 + "b", "short"]
    got = {r.doc_id: r.short for r in queries_web.truncate_notes(spark, documents(spark, tmp_path, texts)).collect()}
    flat = [" ".join(t.split()) for t in texts]
    assert got == {i: t[:79] + "…" if len(t) > 80 else t for i, t in enumerate(flat)}


def test_search_end_to_end(spark, tmp_path):
    """The last event of a key says its status, whatever its number."""
    at = datetime.datetime(2024, 1, 30, 20)
    spark.createDataFrame([(i, "the of", "s") for i in (1, 2, 4, 5)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(3, at, 1, "error"), (4, at, 1, "signup"), (2, at, 2, "error"), (6, at, 4, "signup"), (9, at, 4, "view")]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = queries_more.search_end_to_end(spark, str(tmp_path)).collect()
    assert sorted((r.key[-2:], r.status) for r in got) == [("k1", "alive"), ("k4", "need_pwd"), ("k5", "unchecked")]


def test_message_pages(spark):
    late = "字" * 5000 + " https://pan.quark.cn/s/late 提取码：ab12"
    page = f'<div data-post="c/1"><div class="message_text">{late}</div>' + '<div data-post="c/2"><a href="https://pan.quark.cn/s/bare?pwd=zz99">x</a>' + '<div data-post="c/3"><p></p>'
    got = captured.message_pages(spark.createDataFrame([("c", page)], "channel string, html string")).collect()
    assert [(r.msg_id, len(r.text), [(x.url, x.pwd) for x in r.links]) for r in got] == [(1, 4000, [("https://pan.quark.cn/s/late", "ab12")]), (2, 0, [("https://pan.quark.cn/s/bare", "zz99")])]
    hit = search.message_hits(captured.message_pages(spark.createDataFrame([("c", page)], "channel string, html string"))).collect()
    assert {(r.seq, r.url) for r in hit} == {(1, "https://pan.quark.cn/s/late"), (2, "https://pan.quark.cn/s/bare")}


def test_message_hits(spark):
    digest = "今日合集 会声会影教程 https://pan.quark.cn/s/a 提取码: ab12\nPDF Editor：https://pan.quark.cn/s/b UC https://pan.quark.cn/s/c " + "其他 " * 200 + "SolidWorks 视频教程 pan.baidu.com/s/1d"
    got = search.message_hits(spark.createDataFrame([("c", 7, "2024-01-02", digest)], "channel string, msg_id long, posted_at string, text string"), "SolidWorks").orderBy("rank").collect()
    assert [r.url[-3:] for r in got] == ["s/a", "s/b", "s/c", "/1d"]
    assert got[0].title == "今日合集 会声会影教程" and got[1].title == "提取码: ab12 PDF Editor"
    assert "SolidWorks" in got[2].title and got[2].title.startswith("…") and len(got[2].title) <= 302
    assert "SolidWorks 视频教程" in got[3].title and "PDF" not in got[3].title
    fillers = spark.createDataFrame([(x,) for x in ("夸克", "?pwd=8888", "UC", "备用 下载：", "Xcode 15", "Lucky", "三体")], "s string")
    assert [r.f for r in fillers.select(text.is_filler(fillers["s"]).alias("f")).collect()] == [True, True, True, True, False, False, False]
