"""Many sources as one: which are asked, what each brought in time, and how captured pages become hits.

Sources are captured tables. Where the network would set a deadline, rows carry ``arrival_ms``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import html, links, urls
from ..functions import text as T
from ..operators import catalog
from . import query as Q

#: A preview frame is due after so many milliseconds, or so many new hits.
FRAME_MS, FRAME_HITS = 400, 25


def config(spark: SparkSession, path: str) -> dict:
    """A YAML file's object, read by way of the session's file system; an empty one where the library isn't there."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())  # one file
    return yaml.safe_load(text) or {}


def planned(sources: DataFrame, names: Sequence[str] = ()) -> DataFrame:
    """sources (name, enabled, ...): those that are enabled and asked for; all enabled ones if none is named."""
    some = sources.filter(F.coalesce(F.col("enabled"), F.lit(True)))
    return some.filter(F.col("name").isin(list(names))) if names else some


def types_of(text: str | None, known: Sequence[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Types as they are named in a list with commas; an unknown one is an error that says which there are."""
    out = [(aliases or {}).get(t, t) for t in (p.strip().lower() for p in (text or "").replace("，", ",").split(",")) if t]
    if odd := [t for t in out if t not in known]:
        raise ValueError(f"unknown type {', '.join(odd)}; known: {', '.join(known)}")
    return out


def in_time(hits: DataFrame, jobs: DataFrame, deadline_ms: int) -> tuple[DataFrame, DataFrame]:
    """hits (source, query, pos, arrival_ms, ...) and jobs (source, query, done_ms, error): the hits that came in time, each
    with its rank in its source and query, and a report of every source. What came before a source's deadline is kept."""
    some = hits.filter(F.col("arrival_ms") <= deadline_ms)
    order = Window.partitionBy("source", "query").orderBy("pos")
    ranked = some.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))
    brought = some.groupBy("source", "query").agg(F.count(F.lit(1)).alias("hits"))
    late = F.col("done_ms").isNull() | (F.col("done_ms") > deadline_ms)
    told = jobs.join(brought, ["source", "query"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    status = F.when(F.col("error").isNotNull(), "error").when(late, "timeout").when(F.col("hits") == 0, "empty").otherwise("ok")
    seconds = F.least(F.coalesce("done_ms", F.lit(deadline_ms)), F.lit(deadline_ms)) / 1000.0
    rows = told.select("source", F.xxhash64("query").alias("seq"), "hits", seconds.alias("seconds"), status.alias("status"), "error")
    return ranked, catalog.merge_reports(rows)


def frames(arrivals: DataFrame, wait_ms: int = FRAME_MS, new_hits: int = FRAME_HITS) -> DataFrame:
    """arrivals (search, at_ms, hits so far) -> those at which a preview is shown: the first, and each that is long enough
    after the last shown or brings enough beyond it. A fold over each search's arrivals, as every choice rests on the last."""
    start = F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("hits"), F.array().cast("array<struct<at_ms:long,hits:long>>").alias("shown"))

    def step(a: Column, x: Column) -> Column:
        due = a["at"].isNull() | (x["hits"] - a["hits"] >= new_hits) | (x["at_ms"] - a["at"] >= wait_ms)
        seen = F.struct(x["at_ms"].alias("at"), x["hits"].alias("hits"), F.concat(a["shown"], F.array(F.struct(x["at_ms"].alias("at_ms"), x["hits"].alias("hits")))).alias("shown"))
        return F.when(due, seen).otherwise(a)

    rows = F.array_sort(F.collect_list(F.struct(F.col("at_ms").cast("long").alias("at_ms"), F.col("hits").cast("long").alias("hits"))))
    by = arrivals.groupBy("search").agg(rows.alias("rows"))  # a search has as many arrivals as jobs
    return by.select("search", F.explode(F.aggregate("rows", start, step, lambda a: a["shown"])).alias("f")).select("search", "f.at_ms", "f.hits")


def relevant(text: Column, asked: str) -> Column:
    """Whether any term of a query stands in a text."""
    terms = Q.analyse(asked).terms
    return F.exists(F.array(*map(F.lit, terms)).cast("array<string>"), lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t))


def marked(sources: Column, kinds: Column, markers: Sequence[str]) -> Column:
    """Whether any source or kind of a resource holds a marker."""
    return F.exists(F.concat(sources, kinds), lambda x: F.exists(F.array(*map(F.lit, markers)).cast("array<string>"), lambda m: F.contains(F.lower(x), F.lower(m))))


def priority(text: Column, asked_as: Column, asked: str, hints: Sequence[str], templates: Sequence[str]) -> Column:
    """How likely a video leads to a resource: hints in its text, the template by which it was found, terms of the query."""
    count = lambda words, c, by: sum((F.contains(c, F.lit(w)).cast("double") * by for w in words), F.lit(0.0))
    from_template = F.exists(F.array(*map(F.lit, templates)).cast("array<string>"), lambda w: F.contains(F.coalesce(asked_as, F.lit("")), w))
    return count(hints, text, 1.0) + F.when(from_template, 2.0).otherwise(0.0) + count(Q.analyse(asked).terms, F.lower(text), 0.5)


def videos(items: DataFrame, asked: str, hints: Sequence[str], templates: Sequence[str], most: int) -> DataFrame:
    """items (video, title, description, tag, query): the most promising videos, each once, best first."""
    text = F.concat_ws(" ", T.plain(F.col("title")), T.plain(F.col("description")), T.plain(F.col("tag")))
    rated = items.withColumn("text", text).filter(relevant(F.col("text"), asked)).withColumn("priority", priority(F.col("text"), F.col("query"), asked, hints, templates))
    first = rated.groupBy("video").agg(F.max_by(F.struct("title", "text", "priority"), F.struct("priority", "title")).alias("v")).select("video", "v.*")
    return first.orderBy(F.desc("priority"), "video").limit(most)


def text_hits(texts: DataFrame, source: str, kind: str) -> DataFrame:
    """texts (seq, origin, title, text): the share links of each, with its title."""
    found = texts.select("seq", "origin", "title", F.posexplode(links.share_links(F.col("text"))).alias("rank", "l"))
    return found.select("seq", F.lit(source).alias("source"), F.lit(kind).alias("kind"), "l.url", "l.pwd", F.nullif("title", F.lit("")).alias("title"), "origin", "rank")


def candidates(results: DataFrame, noise: Sequence[str], most: int, per_host: int = 2) -> DataFrame:
    """results (seq, url) of search pages -> the pages worth reading: of real sites, not their front pages, two of a host, the first of all."""
    first = results.filter(F.col("url").rlike("^https?://")).groupBy("url").agg(F.min("seq").alias("seq")).withColumn("host", urls.host(F.col("url")))
    good = first.filter(~urls.is_noise(F.col("host"), list(noise)) & ~urls.path(F.col("url")).isin("", "/"))
    return catalog.top_pages(good, "host", per_host, F.col("seq")).orderBy("seq").limit(most).select("seq", "url")


def by_slug(pages: DataFrame, asked: str, most: int) -> DataFrame:
    """pages (seq, url): those first of which the URL has a term of the query, then in order."""
    return pages.orderBy(F.when(relevant(F.col("url"), asked), 0).otherwise(1), "seq").limit(most)


def page_hits(chosen: DataFrame, pages: DataFrame, asked: str, source: str, kind: str) -> DataFrame:
    """Hits of chosen pages (seq, url) as they were captured (url, html), if their titles have to do with the query."""
    read = chosen.join(pages.select("url", "html"), "url")
    titled = read.withColumn("title", html.title(F.col("html"))).filter(relevant(F.col("title"), asked))
    return text_hits(titled.select("seq", F.col("url").alias("origin"), "title", html.text(F.col("html")).alias("text")), source, kind)


def magnet_hits(pages: DataFrame, source: str = "bt") -> DataFrame:
    """pages (seq, url, html) of results: their magnet links, each once, named by themselves or by their row."""
    whole = pages.withColumn("html", html.with_whole_magnets(F.col("html")))
    rows = whole.select("seq", F.col("url").alias("origin"), F.posexplode(html.row_titles(F.col("html"))).alias("pos", "r")).select("seq", "origin", "pos", F.col("r.magnet").alias("url"), F.col("r.title").alias("row"))
    named = rows.filter("url <> ''").withColumn("title", F.coalesce(urls.magnet_name(F.col("url")), F.nullif("row", F.lit(""))))
    first = named.groupBy("url").agg(F.min_by(F.struct("seq", "origin", "pos", "title"), F.struct("seq", "pos")).alias("x")).select("url", "x.*")
    return first.select("seq", F.lit(source).alias("source"), F.lit("bt").alias("kind"), "url", "title", "origin", F.col("pos").alias("rank"))


def video_texts(found: DataFrame, details: DataFrame, comments: DataFrame) -> DataFrame:
    """All texts of videos: found (video, title, text), details (video, description) where these say more, comments (video, text)."""
    own = found.select("video", "title", "text", F.lit("field").alias("stage"))
    more = details.join(found.select("video", "title", F.col("text").alias("known")), "video").filter(~F.contains("known", F.col("description")))
    told = comments.join(found.select("video", "title"), "video")
    return own.unionByName(more.select("video", "title", F.col("description").alias("text"), F.lit("detail").alias("stage"))).unionByName(told.select("video", "title", "text", F.lit("comment").alias("stage")))


def with_early(resources: DataFrame, early: DataFrame) -> DataFrame:
    """Resources with what was checked ahead (key, pwd, status), where the key and the code agree."""
    told = early.groupBy("key", "pwd").agg(F.max_by("status", "checked_at").alias("early_status"))
    same = (F.col("r.key") == F.col("e.key")) & F.col("r.pwd").eqNullSafe(F.col("e.pwd"))
    return resources.alias("r").join(told.alias("e"), same, "left").select("r.*", "e.early_status")


def engine_jobs(engines: DataFrame, templates: DataFrame, asked: str) -> DataFrame:
    """engines (engine, url) by templates (template): every page of results to be asked for. Both are a few rows."""
    every = engines.crossJoin(templates)
    return every.select("engine", "template", urls.expand_template(F.col("url"), F.replace(F.col("template"), F.lit("{kw}"), F.lit(asked))).alias("url"))
