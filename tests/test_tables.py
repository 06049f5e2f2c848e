"""Table functions, called laterally, against the functions of columns; a query's predicate in SQL."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import html, links, tables
from weftline.operators import ranking
from weftline.plans import search
from weftline.plans.query import analyse
from weftline.sources import captured

LINES = ["https://pan.quark.cn/s/a 提取码 ab12 and https://pan.baidu.com/s/1bcd?pwd=wxyz", "nothing", None, "", "https://pan.baidu.com/share/init?surl=T1&pwd=12ab", "magnet:?xt=urn:btih:" + "a" * 40]


def test_links_and_rejects(spark):
    tables.register(spark)
    rows = spark.createDataFrame(list(enumerate(LINES)), "line long, text string")
    got = spark.sql("SELECT line, l.* FROM {rows}, LATERAL pasted_links(text) l", rows=rows).select("line", "pos", "url", "pan_type", "pwd")
    hits, rejects = search.batch_text(rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, hits.select("line", "pos", "url", "pan_type", "pwd").collect()), key=str)
    none = spark.sql("SELECT line, text FROM {rows}, LATERAL pasted_rows(text) l WHERE l.url IS NULL", rows=rows)
    assert [tuple(r) for r in none.collect()] == [tuple(r) for r in rejects.collect()] == [(1, "nothing")]
    some = spark.sql("SELECT line, count(*) AS n FROM {rows}, LATERAL share_links(text) GROUP BY line", rows=rows).collect()
    assert {r.line: r.n for r in some} == {r.line: r.n for r in rows.select("line", F.size(links.share_links("text")).alias("n")).filter("n > 0").collect()}


def test_messages_and_forms(spark):
    tables.register(spark)
    page = '<div data-post="c/5"><div class="message_text">a https://pan.quark.cn/s/x</div><time datetime="2024-01-01T00:00:00"></time></div><div data-post="c/6"><div class="message_text">b</div></div><form action="/s"><input name="q"></form>'
    rows = spark.createDataFrame([("c", page, "https://x.org"), ("d", None, None)], "channel string, html string, base string")
    got = spark.sql("SELECT channel, m.* FROM {rows}, LATERAL page_messages(html, channel) m", rows=rows).collect()
    want = captured.message_pages(rows.select("channel", "html")).collect()
    assert [(r.channel, r.msg_id, r.posted_at, r.text, r.links) for r in got] == [(r.channel, r.msg_id, r.posted_at, r.text, len(r.links)) for r in want]
    forms = spark.sql("SELECT f.template FROM {rows}, LATERAL search_forms(html, base) f", rows=rows).collect()
    assert [r.template for r in forms] == html.find_search_forms(page, "https://x.org")


@pytest.mark.parametrize("query", ["三体 全集", "c++ 教程", "it's", "沙丘2", "serum"])
def test_match(spark, query):
    """As the predicate on columns has it."""
    titles = ["三 体 全集", "三体", "c++ 入门", "c#", "it's here", "its", "沙丘 2", "沙丘 2024", "serum2", "Serumology", "Serum", None]
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    tables.register_match(spark, "asked_for", query)
    asked = analyse(query)
    column = F.lit(True)
    for term in asked.required or asked.terms:
        column = column & F.lower("title").rlike(ranking.T.term_regex(term))
    assert [r.x for r in spark.sql("SELECT asked_for(title) AS x FROM {rows}", rows=rows).collect()] == [bool(r.x) for r in rows.select(column.alias("x")).collect()]
    with pytest.raises(ValueError):
        tables.register_match(spark, "a b", query)
