"""Scans that stop at a quota: searches of sites, whose detail pages are followed until enough of them are relevant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import html as H
from ..functions import links as L
from ..functions import urls as U
from ..plans.query import analyse
from .probing import detail_urls


def scan(rows: DataFrame, group: str, place: str, accepted: Column, quota: int, chunk: int = 1) -> DataFrame:
    """rows that an ordered scan of each group reads, with ``accepted``: chunk after chunk of ``chunk`` rows, until ``quota`` rows
    were accepted; those that aren't don't count. A chunk that was begun is read to its end.

    place: 0, 1, ... in each group. What is accepted is added up by chunk before a window sees it, so a window has a row
    for every chunk.
    """
    told = rows.withColumn("accepted", F.coalesce(accepted, F.lit(False))).withColumn("_chunk", F.floor(F.col(place) / chunk))
    counts = told.groupBy(group, "_chunk").agg(F.count_if("accepted").alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    read = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < quota).select(group, "_chunk")
    return told.join(read, [group, "_chunk"], "left_semi").drop("_chunk")


def followed(html: Column, pattern: Column, words: Column, most: int) -> Column:
    """The detail pages of a search page that are tried, at most ``most``: those with a word in their URL first, else in order."""
    dull = lambda u: F.exists(F.array(*map(F.lit, X.NOT_FOLLOWED)), lambda s: F.contains(F.lower(u), s))
    named = lambda u: F.exists(words, lambda w: F.contains(F.lower(u), w))
    found = F.filter(detail_urls(html, pattern), lambda u: ~dull(u))
    return F.get(F.transform(F.array(found), lambda x: F.slice(F.concat(F.filter(x, named), F.filter(x, lambda u: ~named(u))), 1, most)), F.lit(0))


def site_search(sites: DataFrame, searches: DataFrame, details: DataFrame, text: str, pages: int = 6, chunk: int = 6) -> tuple[DataFrame, DataFrame]:
    """sites (site, search, result_re, place: the order in which they were routed), searches (url, http_status, html: captured
    search pages), details (url, http_status, html) -> hits (site, place, page, rank, url, pwd, title) and a report by site.

    A site is asked by its search URL; links on the page itself are hits, and detail pages are followed, twice ``pages`` at
    most, in chunks, until ``pages`` are relevant: their title, or without one their text, has a word of the query. Every
    URL is a hit once, where it comes first. Sites whose search page is missing or failed give no hits.
    """
    words = F.array(*map(F.lit, analyse(text).terms)).cast("array<string>")
    asked = sites.withColumn("url", U.expand_template(F.col("search"), F.lit(text)))
    came = asked.join(searches.select("url", "http_status", F.coalesce("html", F.lit("")).alias("html")), "url", "left")
    good = came.filter("http_status = 200")
    own = good.select("site", "place", F.lit(-1).alias("page"), F.col("url").alias("origin"), F.lit(None).cast("string").alias("title"), L.share_links("html").alias("found"))
    tried = good.select("site", "place", F.posexplode(followed(F.col("html"), F.col("result_re"), words, 2 * pages)).alias("page", "origin"))
    # A page is read once, though several sites may lead to it; its text and links stay with it.
    once = details.filter("http_status = 200").groupBy("url").agg(F.max("html").alias("html"))
    read = tried.join(once.withColumnRenamed("url", "origin"), "origin", "left").withColumn("title", H.title(F.col("html"))).withColumn("text", H.text(F.col("html")))
    shown = F.lower(F.coalesce("title", "text"))
    kept = scan(read, "site", "page", F.exists(words, lambda w: F.contains(shown, w)), pages, chunk)
    more = kept.filter("accepted").select("site", "place", "page", "origin", "title", F.concat(L.share_links("text"), L.share_links("html")).alias("found"))
    rows = own.unionByName(more).select("site", "place", "page", "origin", "title", F.posexplode("found").alias("rank", "l"))
    first = rows.groupBy("l.url").agg(F.min_by(F.struct("site", "place", "page", "origin", "title", "rank", "l.pwd"), F.struct("place", "page", "rank")).alias("x"))
    hits = first.select("x.site", "x.place", "x.page", "x.origin", "x.title", "x.rank", "url", "x.pwd")
    followed_by = kept.groupBy("site").agg(F.count(F.lit(1)).alias("read"), F.count_if("accepted").alias("relevant"))
    error = F.when(F.col("http_status").isNull(), "no-answer").when(F.col("http_status") != 200, F.concat(F.lit("http:"), F.col("http_status").cast("string")))
    report = came.select("site", error.alias("error")).join(followed_by, "site", "left").join(hits.groupBy("site").agg(F.count(F.lit(1)).alias("hits")), "site", "left")
    return hits, report.na.fill(0, ["read", "relevant", "hits"])


def routed(sites: DataFrame, verticals: Sequence[str], most: int, disabled: DataFrame | None = None) -> DataFrame:
    """Sites as ``catalog.route`` takes them, with their place in that order."""
    from .catalog import route

    chosen = route(sites, verticals, most, disabled)
    fits = F.arrays_overlap("verticals", F.array(*map(F.lit, verticals)).cast("array<string>"))
    order = Window.orderBy(F.desc(fits.cast("int")), F.desc("yield"), "name")  # over ``most`` sites
    return chosen.select(F.col("name").alias("site"), "search", "result_re", (F.row_number().over(order) - 1).alias("place"))
