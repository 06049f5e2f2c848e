"""Mixing sources to target weights by hash-threshold histograms.

Each source takes every document ``floor(target / size)`` times and, for the remainder, the documents whose hash lies
under a threshold. The threshold is found without sorting: sizes are summed by source and hash bucket, a running sum
finds the boundary bucket, and only that bucket's documents are summed again by the next bits of the hash. A smaller
budget's documents are always among a larger one's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that a level of the histogram looks at, and all that it has.
STEP, DIGITS = 3, 15


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) -> with target.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times the total; no target
    exceeds ``most`` times its source's size, and the excess is shared again by weight. That is one water level: a source
    is full when its limit by weight lies under it. One row per source, so the global windows stay small.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(table, (F.row_number().over(order) - 1) % len(weights)))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("limit") / F.col("weight"))
    every, full = Window.partitionBy(), Window.orderBy("level", F.col("source").isNull(), F.col("source").cast("binary"))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("taken", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("water", (F.col("total") - F.col("taken")) / (F.col("weights") - F.col("used")))
        .withColumn("open", F.when(F.col("water") < F.col("level"), F.struct("level", "water")))
        .withColumn("water", F.min("open").over(every)["water"])
    )
    target = F.when(F.col("water").isNull() | (F.col("level") <= F.col("water")), F.col("limit")).otherwise(F.col("weight") * F.col("water"))
    return ranked.select("source", "source_size", target.alias("target"))


def _code() -> Column:
    return F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, DIGITS)


def _sizes(docs: DataFrame, folder: str) -> DataFrame:
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _code().alias("code")), "sizes", folder)


def thresholds(rows: DataFrame, weights: Sequence[float], share: float, most: float, folder: str) -> DataFrame:
    """rows (doc_id, source, size, code) -> one row per source: s, source_size, target, whole, prefix, with_edge."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialise(plan.withColumn("prefix", F.lit("")), "plan0", folder)

    # The threshold grows by STEP digits a level; ``rest`` is what the boundary bucket still has to give.
    open_, level = rows, 0
    while level < DIGITS:
        level += STEP
        side = plan.filter("rest > 0").select(F.col("source").alias("s"), "prefix")
        open_ = open_.join(side, open_["source"].eqNullSafe(F.col("s")) & open_["code"].startswith(F.col("prefix"))).drop("s", "prefix")
        bucket = F.substring("code", 1, level)
        summed = open_.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("source").orderBy("bucket")
        summed = summed.withColumn("upto", F.sum("words").over(w)).withColumn("before", F.col("upto") - F.col("words"))
        found = summed.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        edge = found.filter((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        edge = edge.groupBy("s").agg(F.min_by(F.struct("bucket", F.col("rest") - F.col("before"), "words", "n"), "bucket").alias("e"))
        edge = edge.select(F.col("s").alias("t"), F.col("e.bucket").alias("bucket"), F.col("e.col2").alias("left"), F.col("e.words").alias("words"), F.col("e.n").alias("n"))
        plan = plan.drop("words", "n").join(edge, plan["source"].eqNullSafe(F.col("t")), "left")
        plan = plan.select("source", "source_size", "target", "whole", F.when(F.col("t").isNotNull(), F.col("left")).otherwise(F.lit(0.0)).alias("rest"), F.coalesce("bucket", "prefix").alias("prefix"), F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("n", F.lit(0)).alias("n"))
        plan = materialise(plan, f"plan{level}", folder)
        if plan.filter("n > 1").isEmpty():
            break
        open_ = materialise(open_, f"open{level}", folder)
    # The boundary bucket is taken whole if that comes nearer to the target.
    return plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "prefix", (F.col("rest") * 2 > F.col("words")).alias("with_edge"))


def _copies(most: float) -> Column:
    head = F.expr("substring(code, 1, length(prefix))")
    extra = (head < F.col("prefix")) | ((F.col("prefix") != "") & (head == F.col("prefix")) & F.col("with_edge"))
    return F.least(F.col("whole") + F.when(extra, 1).otherwise(0), F.lit(int(most))).cast("int")


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, rows["source"].eqNullSafe(plan["s"])).drop("s")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per row of docs: doc_id, source, size (words), source_size, target, copies, taken.

    Null texts have size 0; null sources are one source, the last. The hash is of doc_id, so reruns agree, and rows that
    repeat a doc_id are taken alike: a source that is mostly one id gets within that id's words of its target. Documents
    are taken whole, so of ``most`` only whole copies count. An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    folder = scratch_dir(docs.sparkSession)
    rows = _sizes(docs, folder)
    out = _joined(rows, thresholds(rows, weights, share, most, folder))
    return out.select("doc_id", "source", "size", "source_size", "target", _copies(most).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of docs themselves, each as often as the mix takes it; texts are not shuffled."""
    folder = scratch_dir(docs.sparkSession)
    plan = thresholds(_sizes(docs, folder), weights, share, most, folder)
    own = F.struct(*docs.columns).alias("own")  # whatever they are called
    rows = docs.select(own, F.col("source").cast("string").alias("source"), _code().alias("code"))
    return _joined(rows, plan).select("own", F.explode(F.array_repeat(F.lit(0), _copies(most))).alias("k")).select("own.*")
