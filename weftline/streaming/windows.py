"""Event-time windows: the same plans over tables and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch


def tumbling(events: DataFrame, length: str) -> DataFrame:
    by = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str) -> DataFrame:
    by = events.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return by.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    by = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("began"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("n"))
    return by.drop("w")


def source(spark: SparkSession, path: str) -> DataFrame:
    """The files of a Parquet table as a stream."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path.rpartition("/")[0], pathGlobFilter=path.rpartition("/")[2]) if path.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def read(spark: SparkSession, path: str, late: str) -> DataFrame:
    """The same with a watermark."""
    return source(spark, path).withWatermark("ts", late)


def run_tumbling(spark: SparkSession, path: str, length: str, late: str = "1 day") -> DataFrame:
    """Everything that is there, through the streaming engine: state to the end, then the result, a table in the shared folder."""
    folder, last = scratch(spark, "stream"), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v{number}")  # the whole result so far
        last[:] = [number]

    stream = tumbling(read(spark, path, late), length)
    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/v{last[0]}") if last else tumbling(spark.read.parquet(path).limit(0), length)


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """At-least-once input, once each within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def upserts(events: DataFrame, target: str, keys: list[str], by: str, checkpoint: str):
    """Latest-wins merge of a stream into a Parquet table: a batch writes its own keys' latest rows and nothing else. A
    replayed batch overwrites its own folder. ``upserted`` reads the table, ``compact_upserts`` writes it as one batch."""
    from ..operators.liveness import latest

    def merge(batch: DataFrame, number: int) -> None:
        latest(batch, keys, by).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def upserted(spark: SparkSession, target: str, keys: list[str], by: str) -> DataFrame:
    from ..operators.liveness import latest

    return latest(spark.read.parquet(target).drop("batch"), keys, by)


def compact_upserts(spark: SparkSession, target: str, other: str, keys: list[str], by: str) -> None:
    """The table's present rows, in another folder, as what comes before any batch."""
    upserted(spark, target, keys, by).write.mode("overwrite").parquet(f"{other}/batch=-1")


def progress(hits: DataFrame, folder: str, ranked: Callable[[DataFrame], DataFrame]):
    """A stream of hits as frames: after each batch the ranking of all hits so far, as JSON lines in frames/<batch>. What a
    batch brought is kept in hits/batch=<batch>, so a replay changes nothing; the newest frame is the one to show."""

    def show(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{folder}/hits/batch={number}")
        ranked(spark.read.parquet(f"{folder}/hits").filter(F.col("batch") <= number).drop("batch")).write.mode("overwrite").json(f"{folder}/frames/{number}")

    return hits.writeStream.foreachBatch(show).option("checkpointLocation", f"{folder}/checkpoint")
