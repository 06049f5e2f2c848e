"""Collecting from captured answers: mirrors that hedge each other, channels read back to their marks, directories, sites."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import links, urls

#: Seconds that a mirror's failure counts for, and milliseconds after which the next mirror is asked too.
HEALTH_SECONDS, HEDGE_MS = 120, 800


def epoch(seconds: Column) -> Column:
    """A Unix time as a timestamp."""
    return F.timestamp_seconds(seconds)


def encode_links(found: Column) -> Column:
    """Links as JSON, as an index stores them."""
    return F.to_json(found)


def decode_links(text: Column) -> Column:
    """The links of a stored JSON; none where there is none."""
    return F.coalesce(F.from_json(text, links.SCHEMA.simpleString()), F.array().cast(links.SCHEMA))


def noise_word(n: int, seed: int = 0) -> str:
    """A word that no page holds but by chance; the same for the same seed."""
    return "".join(random.Random(seed).choices("abcdefghijklmnopqrstuvwxyz", k=n))


def anchor(terms: Sequence[str], dfs: Sequence[int], n: int) -> str | None:
    """The rarest of terms that occur at all, else the first."""
    rarity = [(math.log(1 + (n - df + 0.5) / (df + 0.5)), -k) for k, df in enumerate(dfs) if df > 0]
    return terms[-max(rarity)[1]] if rarity else (terms[0] if terms else None)


def snapshot(folder: str, query: str) -> str:
    """Where the hits of a query are kept between runs."""
    return f"{folder.rstrip('/')}/{hashlib.sha1(query.encode()).hexdigest()[:16]}"


def by_health(mirrors: DataFrame, failures: DataFrame, now: Column, seconds: int = HEALTH_SECONDS) -> DataFrame:
    """mirrors (name, place) with the order in which they are asked: those that failed a short time ago last, else as listed."""
    ill = failures.groupBy("name").agg(F.max("failed_at").alias("failed_at")).filter(F.unix_timestamp(now) - F.unix_timestamp("failed_at") < seconds)
    told = mirrors.join(F.broadcast(ill.select("name", F.lit(True).alias("ill"))), "name", "left").withColumn("ill", F.coalesce("ill", F.lit(False)))  # a few mirrors
    return told.withColumn("turn", F.row_number().over(Window.orderBy("ill", "place")) - 1)


def hedged(answers: DataFrame, wait_ms: int = HEDGE_MS) -> DataFrame:
    """answers (query, mirror, turn, latency_ms, ok) -> of each query the answer that came first: a mirror is asked when those before it had ``wait_ms`` each."""
    came = answers.filter("ok").withColumn("came_ms", F.col("turn") * wait_ms + F.col("latency_ms"))
    return came.groupBy("query").agg(F.min_by(F.struct("mirror", "came_ms"), F.struct("came_ms", "turn")).alias("x")).select("query", "x.*")


def crawl(messages: DataFrame, marks: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """messages (channel, page, msg_id, ...) of captured pages, the newest first, and marks (channel, newest): the messages that
    are new, of pages up to the first that reaches the mark and ``most`` at most; and what each channel's marks become."""
    pages = messages.groupBy("channel", "page").agg(F.min("msg_id").alias("low"), F.max("msg_id").alias("high"), F.count(F.lit(1)).alias("n"))
    told = pages.join(marks.select("channel", "newest"), "channel", "left").withColumn("reached", F.coalesce(F.col("low") <= F.col("newest"), F.lit(False)))
    before = Window.partitionBy("channel").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    read = told.withColumn("done", F.coalesce(F.max("reached").over(before), F.lit(False))).filter(~F.col("done") & (F.col("page") < most))
    fresh = messages.join(read.select("channel", "page", "newest"), ["channel", "page"]).filter(F.col("newest").isNull() | (F.col("msg_id") > F.col("newest"))).drop("newest")
    state = read.groupBy("channel").agg(F.max("high").alias("newest"), F.min("low").alias("oldest"), F.sum("n").alias("n"), F.max("reached").alias("caught_up"))
    return fresh, state


def harvest(pages: DataFrame, categories: DataFrame, pattern: str = r"https?://t\.me/(?:s/)?([A-Za-z][A-Za-z0-9_]{3,})") -> DataFrame:
    """pages (category, html) of a directory, categories (category, vertical) that are kept -> vertical, channel, once each."""
    kept = pages.join(F.broadcast(categories.select("category", "vertical")), "category")  # a list of categories
    names = kept.select("vertical", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("channel"))
    return names.groupBy(F.lower("channel").alias("low")).agg(F.min(F.struct("vertical", "channel")).alias("x")).select("x.*")


def load_sites(rows: DataFrame) -> DataFrame:
    """rows (domain, search, note, ...) of a catalogue with host and yield, which its note tells."""
    found = F.nullif(F.regexp_extract(F.coalesce("note", F.lit("")), r"yield=(\d+)", 1), F.lit("")).cast("int")
    address = F.when(F.col("search").rlike("^https?://"), urls.host(F.col("search"))).otherwise(F.lower("domain"))
    return rows.withColumn("host", address).withColumn("yield", F.coalesce(found, F.lit(0)))


def for_verticals(sources: DataFrame, verticals: Sequence[str], every: bool = False) -> DataFrame:
    """sources (name, verticals): those of the query's verticals and the general ones; all if there are none and ``every``."""
    if not verticals and every:
        return sources
    wanted = F.array(*map(F.lit, [*verticals, "general"]))
    return sources.filter(F.arrays_overlap("verticals", wanted))


def result_pages(answers: DataFrame) -> DataFrame:
    """answers (engine, seq, http_status, html) of search engines -> the links of their text and of their markup, once each;
    engines that refused are left out from their first refusal on."""
    w = Window.partitionBy("engine").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = answers.withColumn("cooled", F.max(F.col("http_status").isin(403, 429)).over(w)).filter(~F.col("cooled") & (F.col("http_status") == 200))
    found = F.regexp_extract_all("html", F.lit(r"https?://[^\s\"'<>()]+"), F.lit(0))
    return good.select("engine", "seq", F.posexplode(F.array_distinct(found)).alias("pos", "url"))


def site_videos(payloads: DataFrame) -> DataFrame:
    """payloads (template, page, body) of a video site's searches -> the videos, each as it was seen first; a template's pages
    end where one says that it failed."""
    code = F.coalesce(F.get_json_object("body", "$.code"), F.lit("none"))
    w = Window.partitionBy("template").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = payloads.withColumn("failed", F.max(code != "0").over(w)).filter(~F.col("failed"))
    item = "array<struct<bvid:string,title:string,description:string,tag:string>>"
    rows = good.select("template", "page", F.posexplode(F.from_json(F.get_json_object("body", "$.data.result"), item)).alias("pos", "v")).filter("v.bvid <> ''")
    first = rows.groupBy("v.bvid").agg(F.min_by(F.struct("template", "v.title", "v.description", "v.tag"), F.struct("template", "page", "pos")).alias("x"))
    return first.select(F.col("bvid").alias("video"), "x.*")


def cell_hits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (line, url, pwd, title) of a batch: the links of each cell, the code of its own column before any other; and the cells that have none, once each."""
    found = rows.select("line", "url", "pwd", "title", links.pasted_links(F.col("url")).alias("found"))
    hits = found.select("line", F.explode("found").alias("l"), F.nullif("pwd", F.lit("")).alias("own"), F.nullif("title", F.lit("")).alias("title"))
    rejects = found.filter(F.size("found") == 0).groupBy(F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.lit("(empty)")).alias("text")).agg(F.min("line").alias("line"))
    return hits.select("line", "l.url", F.coalesce("own", "l.pwd").alias("pwd"), "title"), rejects


def cache_key(version: int, kind: Column, key: Column) -> Column:
    return F.concat(F.lit(f"v{version}:"), kind, F.lit(":"), key)


def known_status(status: Column) -> Column:
    """A status as it is known, else ``unknown``."""
    return F.when(status.isin([s[0] for s in X.STATUSES]), status).otherwise("unknown")


#: Providers whose links can be asked for their state.
CHECKED = ("baidu", "quark", "aliyun", "115", "tianyi", "direct")


def can_check(kind: Column) -> Column:
    """Whether links of a provider can be asked for their state."""
    return kind.isin(*CHECKED)


def checkable(kind: str) -> bool:
    return kind in CHECKED


def alive_only(rows: DataFrame) -> DataFrame:
    """The rows whose status is in the bucket of what is alive."""
    return rows.filter(F.col("status").isin([s[0] for s in X.STATUSES if s[3] == "alive"]))


def keyword_table() -> dict[str, list[str]]:
    """Keywords of each vertical, folded, the longest first."""
    return {v: sorted({w.casefold() for w in words}, key=lambda w: (-len(w), w)) for v, words in X.VERTICALS.items()}


def reset(health: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Health records without those of these domains; without any, if none is named."""
    return health.limit(0) if domains is None else health.join(domains.select("domain"), "domain", "left_anti")
