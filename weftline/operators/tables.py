"""Keyed tables: latest versions, watermarks, canonical keys, first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of every key by seq; one aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("row")).select(*keys, "row.*")


def ranked(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds rank, from 0, in each group."""
    return rows.withColumn("rank", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("long"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows, which replace those of the same key. Without a table format with merges, the result is a rewrite."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_marks(old: DataFrame, new: DataFrame) -> DataFrame:
    """channel, newest, oldest, n: the outer bounds and the sum, by one aggregation over both."""
    return old.unionByName(new).groupBy("channel").agg(F.max("newest").alias("newest"), F.min("oldest").alias("oldest"), F.sum("n").alias("n"))


def canonicalise(rows: DataFrame, key: str, known: DataFrame, canonical: str) -> DataFrame:
    """Keys spelt as in ``known`` (one row per key), case ignored; others stay."""
    other = known.select(F.col(canonical).alias("_as"), F.lower(canonical).alias("_low"))
    out = rows.join(other, F.lower(rows[key]) == F.col("_low"), "left")
    return out.withColumn(key, F.coalesce("_as", key)).drop("_as", "_low")


def compact(rows: DataFrame, keep: str, text: str = "text") -> DataFrame:
    """Blank the text of rows for which ``keep`` doesn't hold."""
    return rows.withColumn(text, F.when(F.col(keep), F.col(text)).otherwise(""))


def with_columns_of(rows: DataFrame, schema) -> DataFrame:
    """rows with the columns that schema has besides, as nulls."""
    return rows.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in rows.columns))
