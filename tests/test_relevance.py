"""What titles say of a resource, and the budget of checks."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import evaluation, liveness, ranking, resolve
from weftline.plans import query


@pytest.mark.parametrize(
    ("title", "asked", "drop"),
    [
        (None, "沙丘", False), ("全集", "沙丘", False), ("Dune Part Two", "沙丘", False), ("沙丘 2 4K", "沙丘2", False), ("Omnisphere Factory Library", "大气合成器", False),
        ("沙丘 1080p", "4K 沙丘 HDR", False), ("黑夏 4K HDR", "4K 沙丘 HDR", True), ("Video Codec", "code", True), ("War Machine", "machine learning", True),
        ("百度网盘 下载", "三体", False), ("夸克 资源 合集", "三体", False), ("百度网盘下载2024", "三体", False), ("2024", "三体", False), ("黑夏下载", "三体", True), ("文件夹", "三体", False),
    ],
)
def test_irrelevant(spark, title, asked, drop):
    rows = spark.createDataFrame([([title] if title else [],)], "titles array<string>")
    assert rows.select(ranking.irrelevant(F.col("titles"), [asked, *query.aliases(asked)]).alias("x")).first().x is drop


def test_informative(spark):
    """As the analysis of a query has it: something is left that is neither common nor a number."""
    titles = ["三体", "下载三体全集", "百度网盘下载", "合集 4k", "电影", "下载电影", "破解版 office", "123", "第1季", "!!!", "", "免费下", "c++", "安装安装包安装", "蓝光蓝光"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", ranking.informative(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == {t: bool(query.analyse(t).subjects) for t in titles}


def test_exempt(spark):
    shown = [("q", 1, "u1", "k1", "百度网盘 下载", ["夸克 资源"], ["tg"], 0.1), ("q", 2, "u2", "k2", "黑夏", ["黑夏 下载"], ["tg"], 0.1)]
    rows = spark.createDataFrame(shown, "query string, pos int, url string, key string, title string, titles array<string>, kinds array<string>, relevance double")
    r = evaluation.lexical(rows, "三体", 10).first()
    assert (r.exempt_top, r.absent_top, r.evaluated_top) == (1, 1, 1)


def test_budget_of_nothing_is_no_limit(spark):
    rows = spark.createDataFrame([(f"k{k}", k / 25, 1.0, k) for k in range(25)], "key string, relevance double, score double, first_seq int")
    phases = {r.key: r.phase for r in liveness.budgeted(rows, 0).collect()}
    assert len(phases) == 25 and set(phases.values()) == {"early", "late"} and phases["k24"] == "early"
    assert sum(r.phase != "unchecked" for r in liveness.budgeted(rows, 10).collect()) == 10


def test_hot_key(spark):
    """Half of all hits are of one key, with a hundred thousand titles and a hundred sources: as the plain sums have it, in one pass."""
    n = 100_000
    hits = spark.range(2 * n).select(
        F.col("id").alias("seq"), F.concat(F.lit("s"), (F.col("id") % 100).cast("string")).alias("source"), F.lit("tg").alias("kind"),
        F.concat(F.lit("https://pan.quark.cn/s/k"), F.when(F.col("id") < n, 0).otherwise(F.col("id")).cast("string")).alias("url"), F.lit(None).cast("string").alias("pwd"),
        F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"), *(F.lit(None).cast(t).alias(c) for c, t in {"size": "string", "shared_at": "timestamp", "origin": "string"}.items()),
        F.lit(False).alias("relaxed"), F.lit("q").alias("query"), (F.col("id") % 1000).cast("int").alias("rank"),
    )
    found = resolve.resolve(hits).select("key", "rrf", F.size("titles").alias("n"), F.size("sources").alias("s"), "hit_count").filter("hit_count > 1").collect()
    assert [(r.n, r.s, r.hit_count) for r in found] == [(n, 100, n)]
    assert abs(found[0].rrf - sum(1 / (60 + k) for k in range(100))) < 1e-9


def test_titles_are_not_shuffled(spark):
    """Placed by an order, results are told as with their places given, and no exchange holds a title."""
    n = spark.range(60).select((F.col("id") % 3).alias("query"), "id", (F.col("id") % 7).alias("url"), (F.col("id") % 5).alias("key"), ((F.col("id") % 10) / 10).alias("relevance"), F.when(F.col("id") % 9 == 0, "").otherwise(F.concat(F.lit("the word "), F.when(F.col("id") % 2 == 0, "of").otherwise("x"))).alias("title"), F.array(F.when(F.col("id") % 4 == 2, "api").otherwise("tg")).alias("kinds"))
    n = n.withColumn("titles", F.array("title"))
    placed = n.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("id"))))
    ordered = evaluation.lexical(n, "the of", 3, [F.desc("id")])
    assert sorted(ordered.collect()) == sorted(evaluation.lexical(placed, "the of", 3).select(*ordered.columns).collect())
    shown = ordered._jdf.queryExecution().optimizedPlan().toString()
    below = shown[shown.index("Window") :].split("\n")[1]
    assert "Project [query" in below and " AS anchored#" in below and " AS untitled#" in below and "titles#" not in below.split(" AS anchored#")[1]
