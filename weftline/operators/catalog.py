"""Channels and sites: statistics, how deep to read, routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel_stats(messages: DataFrame) -> DataFrame:
    """messages (channel, msg_id, linked)."""
    return messages.groupBy("channel").agg(F.count(F.lit(1)).alias("messages"), F.count_if("linked").alias("with_links"), F.max("msg_id").alias("newest"))


def pages_to_read(messages: Column, with_links: Column, full: int, few: int = 200) -> Column:
    """All pages for channels that are new or rich in links, half, a fifth or one for poorer ones."""
    share = with_links / messages
    return F.when((messages < few) | (share >= 0.3), full).when(share >= 0.1, full // 2).when(share >= 0.02, full // 5).otherwise(1)


def route(sites: DataFrame, verticals: Sequence[str], most: int, disabled: DataFrame | None = None) -> DataFrame:
    """Sites that can be searched and fit a vertical, the best first: sites (name, domain, search, result_re, verticals, verified, yield)."""
    wanted = F.array(*map(F.lit, verticals)).cast("array<string>")
    fits, general = F.arrays_overlap("verticals", wanted), F.array_contains("verticals", "general")
    able = sites.filter(F.col("search").isNotNull() & F.col("result_re").isNotNull() & F.col("verified") & (fits | general))
    if disabled is not None:
        able = able.join(disabled.select("domain"), "domain", "left_anti")
    return able.orderBy(F.desc(fits.cast("int")), F.desc("yield"), "name").limit(most)


def top_pages(rows: DataFrame, group: str, most: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def merge_reports(reports: DataFrame) -> DataFrame:
    """reports (source, seq, hits, seconds, status, error) -> one per source: all hits, the longest time, the worst status and the first error. A source with hits is at worst degraded."""
    ranks = F.array(*map(F.lit, ("ok", "empty", "degraded", "timeout", "error")))
    some = F.nullif(F.col("error"), F.lit(""))
    by = reports.groupBy("source").agg(
        F.sum("hits").alias("hits"), F.round(F.max("seconds"), 2).alias("seconds"), F.max_by("status", F.array_position(ranks, F.col("status"))).alias("status"), F.min_by(some, F.when(some.isNotNull(), F.col("seq"))).alias("error")
    )
    return by.withColumn("status", F.when((F.col("hits") > 0) & F.col("status").isin("error", "timeout"), "degraded").otherwise(F.col("status")))
