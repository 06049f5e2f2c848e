"""Quality of rankings, and how much of what exists was found."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import query as Q
from . import ranking

#: Relevance under which a shown resource is a poor one; shares that a regression run must reach.
POOR, LEAST_OK, MOST_ABSENT = 0.4, 0.95, 0.01


def metrics(judged: DataFrame, k: int) -> DataFrame:
    """judged (query, doc_id, grade, pos from 1) -> precision, recall and NDCG at k per query that has something relevant."""
    ideal = judged.withColumn("best", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"))))
    gain = lambda pos: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(pos) + 1)
    top, good = F.col("pos") <= k, F.col("grade") > 0
    by = ideal.groupBy("query").agg(
        F.sum(F.when(top, gain("pos"))).alias("dcg"), F.sum(F.when(F.col("best") <= k, gain("best"))).alias("idcg"),
        F.count_if(top & good).alias("good"), F.count_if(top).alias("shown"), F.count_if(good).alias("relevant"),
    )
    ratio = lambda a, b: F.round(F.col(a) / F.col(b), 6)
    return by.filter("relevant > 0").select("query", ratio("good", "shown").alias("precision"), ratio("good", "relevant").alias("recall"), ratio("dcg", "idcg").alias("ndcg"))


def gate(rows: DataFrame, least: float) -> DataFrame:
    names = ("precision", "recall", "ndcg")
    means = rows.agg(*(F.avg(c).alias(c) for c in names))
    passed = (F.col("precision") >= least) & (F.col("recall") >= least) & (F.col("ndcg") >= least)
    return means.select(*(F.round(c, 6).alias(c) for c in names), passed.alias("passed"))


def chao2(found: DataFrame) -> DataFrame:
    """found (query, key, grp), distinct -> per query what was seen, by one and by two groups, and the estimate of all there is."""
    n = found.groupBy("query", "key").agg(F.count(F.lit(1)).alias("n"))
    by = n.groupBy("query").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("n") == 1).alias("q1"), F.count_if(F.col("n") == 2).alias("q2"))
    unseen = F.when(F.col("q2") > 0, F.pow(F.col("q1").cast("double"), F.lit(2.0)) / (2.0 * F.col("q2"))).otherwise(F.col("q1") * (F.col("q1") - 1) / 2.0)
    return by.withColumn("chao2", F.round(F.col("seen") + unseen, 6))


def chapman(found: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per query and pair of groups: what both found, and the estimate of all there is. One aggregation by key; no self-join."""
    has = found.groupBy("query", "key").agg(*(F.bool_or(F.col("grp") == g).alias(g) for g in groups))
    pairs = [(a, b) for i, a in enumerate(groups) for b in groups[i + 1 :]]
    sums = [F.count_if(F.col(g)).alias(f"n_{g}") for g in groups] + [F.count_if(F.col(a) & F.col(b)).alias(f"m_{a}_{b}") for a, b in pairs]
    by = has.groupBy("query").agg(*sums)

    def one(a: str, b: str):
        n, m, both = F.col(f"n_{a}"), F.col(f"n_{b}"), F.col(f"m_{a}_{b}")
        estimate = F.round((n + 1) * (m + 1) / (both + 1.0) - 1, 6)
        return F.when((n > 0) & (m > 0), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), both.alias("both"), estimate.alias("chapman")))

    return by.select("query", F.explode(F.array_compact(F.array(*(one(a, b) for a, b in pairs)))).alias("x")).select("query", "x.*")


def only_here(found: DataFrame) -> DataFrame:
    lone = found.groupBy("query", "key").agg(F.count(F.lit(1)).alias("n"), F.min("grp").alias("grp")).filter("n = 1")
    return lone.groupBy("grp").agg(F.count(F.lit(1)).alias("only_here"))


def equidistant(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows of each group, evenly spaced in its order."""
    w = Window.partitionBy(group)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / n))
    placed = rows.withColumn("pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("step", step)
    return placed.filter((F.col("pos") % F.col("step") == 0) & (F.floor(F.col("pos") / F.col("step")) < n)).drop("pos", "step")


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """vertical, keyword, subject of a file of tab-separated queries; comments and lines of another form are left out."""
    parts = F.split(F.trim(F.regexp_replace("value", "#.*$", "")), "\t")
    lines = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == 2)
    return lines.select(F.trim(F.get("p", F.lit(0))).alias("vertical"), F.trim(F.get("p", F.lit(1))).alias("keyword"))


def subject_of(keyword: str) -> str:
    return " ".join(Q.analyse(keyword).required)


def source_group(adapter: Column, kind: Column) -> Column:
    """The groups of independent sources that coverage is estimated from; null for those that give no shares."""
    return (
        F.when(adapter == "telegram", "tg_local")
        .when(adapter == "pansou", F.when(kind == "tg", "pansou_tg").otherwise("pansou_plugin"))
        .when(adapter.isin("websearch", "sitesearch", "bilibili"), "open_web")
    )


def lexical(shown: DataFrame, keyword: str, k: int, order: Sequence[Column | str] | None = None) -> DataFrame:
    """shown (query, pos from 1, url, key, title, titles, kinds, relevance), the results of queries that ask for ``keyword``
    -> per query how many lack its subject, are poor, have no title, or repeat.

    Links of interfaces, and resources whose titles say nothing, are exempt from what is said of subjects. order: what
    places results within a query, where shown has no pos. Titles are looked at where they are and never shuffled.
    """
    asked = [Q.analyse(q).required for q in (keyword, *Q.aliases(keyword))]
    every_title = F.array_distinct(F.concat(F.array("title"), F.coalesce("titles", F.array().cast("array<string>"))))
    names = F.transform(every_title, lambda t: T.evidence(F.lower(F.coalesce(t, F.lit("")))))

    def has(required: Sequence[str]) -> Callable[[Column], Column]:
        def every(t: Column) -> Column:
            out = F.lit(True)
            for term in required:
                out = out & ranking.term_present(t, term)
            return out

        return every

    def told(prepared: Column) -> Column:
        anchored = F.lit(False)
        for required in asked:
            anchored = anchored | F.exists(prepared, has(required))
        # Null for what is exempt.
        return F.when(~F.exists(prepared, lambda t: ~ranking.informative(t)), anchored)

    # Titles are prepared once, and those of interfaces not at all.
    api = F.coalesce(F.array_contains("kinds", "api"), F.lit(False))
    anchored = F.when(~api, F.get(F.transform(F.array(names), told), F.lit(0)))
    untitled = F.trim(F.coalesce("title", F.lit(""))) == ""
    some = shown.select(*(c for c in shown.columns if c not in ("title", "titles", "kinds")), anchored.alias("anchored"), untitled.alias("untitled"))
    if order is not None:
        some = some.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    exempt = F.col("anchored").isNull()
    rows = some.withColumn("exempt", exempt).withColumn("absent", ~exempt & ~F.col("anchored")).withColumn("poor", ~exempt & (F.col("relevance") < POOR))
    top = F.col("pos") <= k
    by = rows.groupBy("query").agg(
        F.count(F.lit(1)).alias("shown"), F.count_if("absent").alias("absent_all"), F.count_if("poor").alias("low_all"),
        F.count_if(top & F.col("absent")).alias("absent_top"), F.count_if(top & F.col("poor")).alias("low_top"), F.count_if(top & ~F.col("exempt")).alias("evaluated_top"), F.count_if(top & F.col("exempt")).alias("exempt_top"),
        F.count_if(top & ~F.col("exempt") & F.col("untitled")).alias("untitled_top"),
        F.countDistinct("url").alias("urls"), F.countDistinct("key").alias("keys"),
    )
    ratio = F.when(F.col("evaluated_top") > 0, F.round(F.col("absent_top") / F.col("evaluated_top"), 3)).otherwise(0.0)
    return by.select("*", ratio.alias("absent_ratio"), (F.col("shown") - F.col("urls")).alias("dupe_urls"), (F.col("shown") - F.col("keys")).alias("dupe_keys")).drop("urls", "keys")


def regression(results: DataFrame) -> DataFrame:
    """results (vertical, keyword, status: ok, empty or error, and lexical's columns) -> one row: totals, ratios and whether the run passes."""
    ok = F.col("status") == "ok"
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
    sums = ("shown", "absent_top", "low_top", "evaluated_top", "exempt_top", "dupe_urls", "untitled_top")
    by = results.agg(F.count(F.lit(1)).alias("queries"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(F.col("status") == "error").alias("errors"), *map(total, sums))
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    good, absent = share("ok", "queries"), share("absent_top", "evaluated_top")
    passed = (good >= LEAST_OK) & (absent <= MOST_ABSENT) & (F.col("errors") == 0)
    return by.select("*", F.round(good, 4).alias("ok_ratio"), F.round(absent, 4).alias("absent_ratio"), passed.alias("passed"))


def worst(results: DataFrame, n: int = 25) -> DataFrame:
    """The queries of which most lack their subject."""
    some = results.filter((F.col("status") == "ok") & (F.col("absent_top") > 0))
    return some.orderBy(F.desc("absent_top"), F.desc("absent_ratio"), "keyword").limit(n)


def by_vertical(results: DataFrame) -> DataFrame:
    return results.filter("status = 'ok'").groupBy("vertical").agg(F.count(F.lit(1)).alias("queries"), F.sum("shown").alias("shown"), F.sum("absent_top").alias("absent_top"))
