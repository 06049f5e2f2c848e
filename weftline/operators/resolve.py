"""Grouping hits into resources: one aggregation by key, independent of the order in which hits arrive.

``seq`` says which hit came first; every "first" is a min_by over it and every ordered list sorts by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import RRF_K
from ..functions import urls


def with_keys(hits: DataFrame) -> DataFrame:
    """Hits with provider, token, code and key; hits of unknown hosts are dropped."""
    kind = hits.withColumn("pan_type", urls.provider(F.col("url"))).filter("pan_type <> 'other'")
    token = kind.withColumn("surl", F.when(F.col("pan_type") == "baidu", urls.share_token(F.col("url"))))
    code = token.withColumn("code", F.coalesce(F.nullif(F.col("pwd"), F.lit("")), urls.code_in_url(F.col("url"))))
    return code.withColumn("key", urls.resource_key(F.col("pan_type"), F.col("url"), F.col("surl")))


def rrf(rank: Column) -> Column:
    return F.when(rank >= 0, 1.0 / (F.lit(float(RRF_K)) + rank)).otherwise(0.0)


def fuse(hits: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: per key the sum of each source's best contribution."""
    best = hits.groupBy("key", "source").agg(F.max(rrf(F.col("rank"))).alias("best"))
    return best.groupBy("key").agg(F.sum("best").alias("rrf"))


#: What tells hits of a key apart; hits that agree in all of it are one row from the first exchange on.
CLASS = ("source", "kind", "origin", "query", "title", "relaxed")


def resolve(hits: DataFrame) -> DataFrame:
    """hits (seq, source, kind, url, pwd, title, size, shared_at, origin, relaxed, query, rank) -> one row per key.

    Two exchanges. In the first, hits of a key that agree in all that is listed become one row, counted where they are
    read, so a key of very many hits is spread over its classes. In the second, a key's classes, of which its lists are
    made anyway, come together: the arrays are as long as the key has different values.
    """
    keyed = with_keys(hits)
    size, shown = F.nullif(F.col("size"), F.lit("")), urls.canonical(F.col("pan_type"), F.col("url"), F.col("surl"))
    coded, sized = (F.when(c.isNotNull(), F.col("seq")) for c in (F.col("code"), size))
    classes = keyed.groupBy("key", *CLASS).agg(
        F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.max(rrf(F.col("rank"))).alias("best"), F.min("shared_at").alias("shared_at"),
        F.min_by(F.struct("pan_type", "surl", shown.alias("url")), "seq").alias("first"),
        F.min(coded).alias("code_seq"), F.min_by(F.struct(F.col("code"), shown.alias("url")), coded).alias("coded"),
        F.min(sized).alias("size_seq"), F.min_by(size, sized).alias("size"),
    )
    t, primary = F.nullif(F.col("title"), F.lit("")), ~F.coalesce(F.col("relaxed"), F.lit(False))
    value = lambda c, when=None: (F.nullif(F.col(c), F.lit("")) if when is None else F.when(when, F.nullif(F.col(c), F.lit("")))).alias(c)
    row = F.struct("seq", value("source"), value("kind"), value("title"), value("origin"), value("query", primary), "best", F.col("source").alias("of"))
    by = classes.groupBy("key").agg(
        F.min_by("first", "seq").alias("first"), F.min_by("coded", "code_seq").alias("coded"), F.max_by(t, F.when(t.isNotNull(), F.struct(F.length(t), -F.col("seq")))).alias("title"),
        F.min_by("size", "size_seq").alias("size"), F.min("shared_at").alias("shared_at"), F.bool_or(primary).alias("from_primary"),
        F.sum("n").alias("hit_count"), F.min("seq").alias("first_seq"), F.sort_array(F.collect_list(row)).alias("rows"),
    )
    listed = lambda name: F.array_distinct(F.array_compact(F.transform("rows", lambda r: r[name])))
    # The best of each source: the first of its run once rows are in order of source and best. Linear in the rows.
    ordered = F.sort_array(F.transform("rows", lambda r: F.struct(r["of"].alias("of"), (-r["best"]).alias("worse"))))
    run_ends = lambda all_: F.filter(all_, lambda x, i: (i == 0) | ~x["of"].eqNullSafe(F.get(all_, i - 1)["of"]))
    best = F.get(F.transform(F.array(ordered), run_ends), F.lit(0))
    fused = F.aggregate(best, F.lit(0.0), lambda a, x: a - x["worse"])
    return by.select(
        "key", F.col("first.pan_type").alias("pan_type"), F.coalesce("coded.url", "first.url").alias("url"), F.col("first.surl").alias("surl"), F.col("coded.code").alias("pwd"),
        "title", "size", "shared_at", "from_primary", "hit_count", "first_seq", fused.alias("rrf"),
        listed("source").alias("sources"), listed("kind").alias("kinds"), listed("title").alias("titles"), F.slice(listed("origin"), 1, 8).alias("origins"), listed("query").alias("queries"),
    )
