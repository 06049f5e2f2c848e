"""Whole searches over captured hits, and batches of links to be checked."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import links
from ..functions import text as T
from ..operators import liveness, ranking, resolve
from ..operators.snapshots import Snapshots
from . import query as Q

#: Characters of a title at most.
TITLE = 300
HIT = "seq bigint, source string, kind string, url string, pwd string, title string, size string, shared_at timestamp, origin string, relaxed boolean, query string, rank int"


def jobs(asked: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every form of the query by every kind of source, but relaxed forms not by slow ones. Both are a few rows."""
    return asked.crossJoin(kinds).filter(~(F.col("relaxed") & F.col("primary_only")))


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """Hits of several sources in the order of the sources."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


class Watch:
    """Counts taken of rows on their way through a plan, by the job that runs it and no other: known once it has run."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def __call__(self, name: str, rows: DataFrame, **counts: Column) -> DataFrame:
        self.seen[name] = Observation()
        return rows.observe(self.seen[name], *(c.alias(n) for n, c in counts.items()))

    def counts(self) -> dict[str, int]:
        return {n: x or 0 for o in self.seen.values() for n, x in o.get.items()}


def _unwatched(name: str, rows: DataFrame, **counts: Column) -> DataFrame:
    return rows


def search(
    hits: DataFrame, text: str, cache: DataFrame | None = None, now: Column | None = None, types: Sequence[str] = (), strict: bool = False, drop_sources: Sequence[str] = (), limit: int | None = None, prune: bool = True, watch: Callable[..., DataFrame] = _unwatched
) -> DataFrame:
    """Group, rate, annotate, filter, tier and take: a row per resource, best first.

    One shuffle by key groups the hits; the cache is joined on that key; ``limit`` makes the sort a top-k.
    """
    now = F.current_timestamp() if now is None else now
    adult = F.lit(False)
    for marker in drop_sources:
        adult = adult | F.contains(F.lower("source"), F.lit(marker))
    hits = watch("hits", hits, raw_hits=F.count(F.lit(1)), adult_pruned=F.count_if(adult)).filter(~adult)
    queries = [q for q, relaxed in Q.plan(text) if not relaxed]
    rows = resolve.resolve(hits)
    kinds = [*dict.fromkeys([*X.PRIORITY, *(k for _, k in X.PROVIDERS), "other"])]
    rows = watch("resources", rows, dedup_count=F.count(F.lit(1)), **{f"type:{k}": F.count_if(F.col("pan_type") == k) for k in kinds})
    if types:
        rows = rows.filter(F.col("pan_type").isin(list(types)))
    rows = rows.withColumn("irrelevant", ranking.irrelevant(F.col("titles"), queries))
    rows = watch("relevance", rows, irrelevant_pruned=F.count_if("irrelevant")).filter(~F.col("irrelevant")).drop("irrelevant")
    rows = liveness.annotate(rows, cache, now) if cache is not None else rows.withColumn("status", F.lit("unchecked")).withColumn("pwd_verified", F.lit(False))
    rows = watch("statuses", rows, **{f"status:{s[0]}": F.count_if(F.col("status") == s[0]) for s in X.STATUSES})
    rows = rows.withColumn("best", ranking.relevance(F.col("titles"), queries)).withColumn("relevance", F.col("best.relevance"))
    rows = rows.withColumn("title", F.coalesce(F.nullif(F.col("best.title"), F.lit("")), F.col("title")))
    rows = ranking.score(rows, now)
    if prune:
        rows = liveness.prune(rows, strict)
    alive = F.col("status").isin([s[0] for s in X.STATUSES if s[4]])
    rows = watch("kept", rows, kept=F.count(F.lit(1)), alive=F.count_if(alive)).orderBy(*ranking.order())
    rows = rows.limit(limit) if limit else rows
    return rows.select("key", "pan_type", "url", "pwd", "title", "status", "relevance", "rrf", "score", "hit_count", "sources", "kinds", "first_seq")


#: What ``search`` gives.
FOUND = "key string, pan_type string, url string, pwd string, title string, status string, relevance double, rrf double, score double, hit_count long, sources array<string>, kinds array<string>, first_seq long"


def kept_search(store: Snapshots, hits: DataFrame, text: str, limit: int = 20, data: object = None, degraded: bool = False, **options) -> tuple[dict, bool]:
    """``outcome`` as a dictionary, out of a store of snapshots if it is there, and whether it was.

    data: what tells the hits and the cache apart from other ones, such as ``session.state`` of their folders. Tables among
    the options aren't part of what was asked, all others are.
    """
    flags = {k: v for k, v in options.items() if not isinstance(v, (DataFrame, Column))}

    def make() -> tuple[DataFrame, dict]:
        told = outcome(hits, text, limit, **options).as_dict()
        found = [(k, *r.values()) for k, r in enumerate(told.pop("results"))]  # ``limit`` rows, with their places
        return hits.sparkSession.createDataFrame(found, f"place int, {FOUND}").coalesce(1), told

    kept, was = store.ask(text, make, degraded, limit=limit, data=data, **flags)
    rows = kept.rows.orderBy("place").drop("place").collect()
    return kept.about | {"results": [r.asDict(recursive=True) for r in rows]}, was


@dataclass
class Outcome:
    """A search's best rows and what became of all others: counts, by provider and by status too, and seconds."""

    text: str
    rows: list[Row]
    counts: dict[str, int]
    seconds: dict[str, float]
    queries: list[str]

    @property
    def pruned(self) -> int:
        """Rows that were left out for their status."""
        return sum(self.by("status").values()) - self.counts["kept"]

    @property
    def slowest(self) -> str:
        """The phase that took longest; none if nothing was timed."""
        return max((k for k in self.seconds if k != "total"), key=self.seconds.get, default="")

    def by(self, what: str) -> dict[str, int]:
        """Counts by ``type`` or ``status`` of what there was."""
        return {k.partition(":")[2]: n for k, n in self.counts.items() if k.startswith(f"{what}:") and n}

    def as_dict(self) -> dict:
        plain = {k: n for k, n in self.counts.items() if ":" not in k}
        return {
            "keyword": self.text, "queries": self.queries, **plain, "pruned": self.pruned, "types": self.by("type"), "statuses": self.by("status"),
            "seconds": self.seconds, "slowest": self.slowest, "results": [r.asDict(recursive=True) for r in self.rows],
        }


def outcome(hits: DataFrame, text: str, limit: int = 20, **options) -> Outcome:
    """``search``, run: its first ``limit`` rows with the counts of all, from one job."""
    began, watch = time.monotonic(), Watch()
    found = search(hits, text, limit=limit, watch=watch, **options)
    planned = time.monotonic()
    rows = found.collect()
    ended = time.monotonic()
    seconds = {"plan": planned - began, "run": ended - planned, "total": ended - began}
    return Outcome(text, rows, watch.counts(), {k: round(v, 3) for k, v in seconds.items()}, [q for q, _ in Q.plan(text)])


def type_counts(resources: DataFrame) -> DataFrame:
    return resources.groupBy("pan_type").agg(F.count(F.lit(1)).alias("n"))


def message_hits(messages: DataFrame, query: str = "") -> DataFrame:
    """messages (channel, msg_id, posted_at, text, perhaps links) -> a hit per link.

    A link's title is the text between the link before it and itself; where that says nothing, an excerpt of the message
    around the query's terms. The links are those stored with a message, which may stand beyond its text, else its text's.
    """
    asked = Q.analyse(query)
    terms = F.array(*map(F.lit, asked.subjects or asked.terms)).cast("array<string>")
    excerpt = lambda c: F.nullif(T.excerpt(c, terms, TITLE), F.lit(""))
    stored = F.col("links") if "links" in messages.columns else links.share_links(F.col("text"))
    flat = messages.select("channel", "msg_id", "posted_at", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), stored.alias("links"))
    titled = flat.withColumn("titles", links.link_titles("text", F.transform("links", lambda x: x["url"])))
    found = titled.select("channel", "msg_id", "posted_at", "text", F.posexplode(F.arrays_zip("links", "titles")).alias("rank", "x"))
    found = found.select("*", F.col("x.links").alias("l"), F.when(~T.is_filler(F.col("x.titles")), F.col("x.titles")).alias("own"))
    found = found.withColumn("title", F.coalesce(excerpt(F.col("own")), excerpt(F.col("text"))))
    return found.select(F.col("msg_id").alias("seq"), F.concat(F.lit("tg:"), "channel").alias("source"), F.lit("tg").alias("kind"), "l.url", "l.pwd", "title", F.col("posted_at").cast("timestamp").alias("shared_at"), F.concat(F.lit("t.me/"), "channel").alias("origin"), "rank")


def batch_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Free text (line, text): the links, lone ones with their query kept, and the lines that have none."""
    found = lines.select("line", "text", links.pasted_links(F.col("text")).alias("found"))
    hits = found.select("line", F.explode("found").alias("l")).select("line", "l.*")
    return hits, found.filter((F.size("found") == 0) & (F.trim("text") != "")).select("line", "text")
