"""Probing of sites: which search URL of a site works, how its result links look, and whether they lead to resources.

Works on captured pages. A search page's links become shapes, which are regexes; these, as a column, are held against the
same page to pick detail pages, whose captured contents say what the site is good for. A search for a word is compared
with one for noise, so that pages which never change count for nothing. Pages never meet a shuffle: what goes on are
counts, regexes and a few URLs for each page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import html as H
from ..functions import urls as U

#: The path of a link without query or fragment, with or without its host.
LINKED = r'href="(?:https?://[^/"]+)?(/[^"#?]{3,})"'
#: Paths of contents: a number, an extension, a section, or words with hyphens, maybe under a section.
CONTENT = r"/[0-9]{3,}|(?i:\.html?$)|(?i:/(?:post|article|archives?|thread|read|book|game|movie|music|download)/)|(?i:^/(?:[a-z0-9_-]+/)?[a-z0-9]+(?:[-_][a-z0-9]+)+/?$)"
DOCUMENT = rf"(?i)\.(?:{'|'.join(X.DOCUMENTS)})(?:[?#\"'<>]|$)"
TAIL = f"[{X.LINK_TAIL}]+$"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _content(path: Column) -> Column:
    low = F.lower(path)
    return path.rlike(CONTENT) & ~F.exists(F.array(*map(F.lit, X.NO_RESULT_PATHS)), lambda s: F.contains(low, s))


def result_links(html: Column) -> Column:
    """How many distinct paths a page links to that look like contents."""
    return F.size(F.filter(F.array_distinct(F.regexp_extract_all(html, F.lit(LINKED), F.lit(1))), _content))


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([.^$*+?{}\[\]|()&~#\- ])", r"\\$1")


def result_patterns(html: Column, host: Column, most: int = 3) -> Column:
    """Regexes of the URLs that a page links to: the likeliest shapes of detail pages, then the commonest, then by text."""
    low = lambda p: F.lower(p)
    dull = lambda p: F.exists(F.array(*map(F.lit, X.NO_RESULT_PATHS)), lambda s: F.contains(low(p), s))
    shapes = F.filter(F.transform(F.filter(F.regexp_extract_all(html, F.lit(LINKED), F.lit(1)), lambda p: ~dull(p)), U.path_shape), lambda s: s.isNotNull())

    def ranked(found: Column) -> Column:
        told = F.transform(F.array_distinct(found), lambda s: F.struct((-U.detail_likeness(s)).alias("like"), (-F.size(F.filter(found, lambda x: x == s))).alias("n"), s.alias("shape")))
        return F.transform(F.slice(F.sort_array(told), 1, most), lambda x: F.concat(F.lit("https://"), _quoted(host), x["shape"]))

    return _let(shapes, ranked)


def detail_urls(html: Column, pattern: Column) -> Column:
    """Distinct URLs of a page that a pattern of ``result_patterns`` fits, those with a host first, then paths, given its host."""
    base = F.replace(F.regexp_extract(pattern, "^(https?://[^/]+)", 1), F.lit("\\"), F.lit(""))
    path = F.regexp_replace(pattern, "^https?://[^/]+", "")
    found = lambda p: F.filter(F.transform(F.regexp_extract_all(html, F.concat(F.lit("(?i)"), p), F.lit(0)), lambda x: F.regexp_replace(x, TAIL, "")), lambda x: x != "")
    near = F.when((path != "") & (path != pattern), F.transform(found(path), lambda x: F.concat(base, x))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(found(pattern), near))


def resources(html: Column) -> Column:
    """How many distinct resources a page offers: links to providers, magnets, documents. Null pages have none."""
    links = F.transform(F.regexp_extract_all(html, F.lit(f"https?://[^{X.LINK_STOP}]+"), F.lit(0)), lambda u: F.regexp_replace(u, TAIL, ""))
    shared = F.filter(links, lambda u: (U.provider(u) != "other") | u.rlike(DOCUMENT))
    files = F.filter(F.regexp_extract_all(html, F.lit('href="([^"]{4,300})"'), F.lit(1)), lambda u: u.rlike(DOCUMENT))
    return F.coalesce(F.size(F.array_distinct(F.concat(shared, F.regexp_extract_all(html, F.lit(f"(?i){X.MAGNET}"), F.lit(0)), files))), F.lit(0))


def requests(homes: DataFrame, patterns: Sequence[str] = tuple(X.SEARCH_PATTERNS), terms: dict[str, list[str]] | None = None) -> DataFrame:
    """homes (domain, html) -> what to capture: domain, place, template, term, url, noise_url.

    Templates of a home page's own search forms come before the patterns that sites commonly have; ``place`` is the order
    in which templates and terms are tried. Noise is letters that the domain decides on.
    """
    terms = terms or X.PROBE_TERMS
    base = F.when(F.col("domain").startswith("http"), F.rtrim(F.col("domain"), F.lit("/"))).otherwise(F.concat(F.lit("https://"), F.rtrim(F.col("domain"), F.lit("/"))))
    words = F.when(U.is_chinese_site(F.regexp_replace(base, "^https?://", "")), F.array(*map(F.lit, terms["zh"]))).otherwise(F.array(*map(F.lit, terms["en"])))
    rows = homes.select("domain", base.alias("base"), H.search_forms(F.coalesce("html", F.lit("")), base).alias("forms"), words.alias("words"))
    known = F.transform(F.array(*map(F.lit, patterns)), lambda p: F.concat("base", p))
    rows = rows.select("domain", "words", F.posexplode(F.concat("forms", known)).alias("t", "template")).select("domain", "t", "template", F.size("words").alias("n"), F.posexplode("words").alias("w", "term"))
    noise = F.translate(F.substring(F.md5(F.col("domain").cast("binary")), 1, 10), "0123456789", "ghijklmnop")
    return rows.select("domain", (F.col("t") * F.col("n") + F.col("w")).alias("place"), "template", "term", U.expand_template(F.col("template"), F.col("term")).alias("url"), U.expand_template(F.col("template"), noise).alias("noise_url"))


def probe(homes: DataFrame, searches: DataFrame, details: DataFrame, least: int = 3, gain: int = 3, patterns: int = 3, sample: int = 4, enough: int = 5, sure: tuple[int, int] = (20, 10)) -> DataFrame:
    """One row per home: domain, ok, template, real_hits, noise_hits, result_re, link_yield, error.

    homes (domain, http_status, error: of a home page that never came), searches (domain, place, template, http_status, html,
    noise_status, noise_html), details (url, http_status, html).

    A search works with ``least`` result links and ``gain`` more than for noise. Of its patterns, each tried on the first
    ``sample`` detail pages, the first with ``enough`` resources is taken, else the one with most, the earlier of equals.
    Of a domain's searches that yield any, the one with most result links is taken, the earliest of equals, out of those up
    to the first that is ``sure`` (so many links, so many more than for noise, more than all before). Errors: of the
    home page; ``no-share-links`` where searches work and lead to no resource, else ``no-pattern``. Detail pages that were
    captured several times count by their best. Null pages are empty ones.
    Where nothing was found, texts are empty and numbers 0.
    """
    host = F.rtrim(F.regexp_replace("domain", "^https?://", ""), F.lit("/"))
    page, noise = F.coalesce("html", F.lit("")), F.when(F.col("noise_status") == 200, result_links(F.coalesce("noise_html", F.lit("")))).otherwise(0)
    rows = searches.filter("http_status = 200").select("domain", "place", "template", result_links(page).alias("real"), F.coalesce(noise, F.lit(0)).alias("noise"), page.alias("html"), host.alias("host"))
    rows = rows.filter((F.col("real") >= least) & (F.col("real") - F.col("noise") >= gain))
    tried = F.transform(result_patterns(F.col("html"), F.col("host"), patterns), lambda p: F.struct(p.alias("pattern"), F.slice(detail_urls(F.col("html"), p), 1, sample).alias("urls")))
    rows = rows.select("domain", "place", "template", "real", "noise", F.posexplode(tried).alias("k", "tried"))
    asked = rows.select("domain", "place", "k", F.explode("tried.urls").alias("url"))
    found = details.filter("http_status = 200").select("url", resources(F.col("html")).alias("n")).filter("n > 0").groupBy("url").agg(F.max("n").alias("n"))
    yields = asked.join(found, "url").groupBy("domain", "place", "k").agg(F.sum("n").alias("n"))
    of = F.coalesce("n", F.lit(0).cast("long"))
    best = rows.join(yields, ["domain", "place", "k"], "left").groupBy("domain", "place").agg(
        F.first("template").alias("template"), F.first("real").alias("real"), F.first("noise").alias("noise"), F.max_by(F.struct(F.col("tried.pattern").alias("pattern"), of.alias("n")), F.struct(F.least(of, F.lit(enough)), -F.col("k"))).alias("best")
    )
    order = Window.partitionBy("domain").orderBy("place")
    before = F.max("real").over(order.rowsBetween(Window.unboundedPreceding, -1))
    good = best.filter("best.n > 0").withColumn("record", F.col("real") > F.coalesce(before, F.lit(-1)))
    stop = F.when(F.col("record") & (F.col("real") >= sure[0]) & (F.col("real") - F.col("noise") >= sure[1]), F.col("place"))
    good = good.withColumn("stop", F.min(stop).over(Window.partitionBy("domain"))).filter(F.col("stop").isNull() | (F.col("place") <= F.col("stop")))
    chosen = good.groupBy("domain").agg(F.max_by(F.struct("template", "real", "noise", F.col("best.pattern").alias("pattern"), F.col("best.n").alias("n")), F.struct("real", -F.col("place"))).alias("c"))
    # A domain with working searches, whether or not one was chosen.
    told = best.select("domain").distinct().join(chosen, "domain", "left")
    out = homes.select("domain", "http_status", F.nullif(F.col("error"), F.lit("")).alias("failed")).join(told.withColumn("works", F.lit(True)), "domain", "left")
    lost = F.coalesce("failed", F.when(F.col("http_status").isNull(), "no-answer").when(F.col("http_status") != 200, F.concat(F.lit("http:"), F.col("http_status").cast("string"))))
    kept = F.when(lost.isNull(), F.col("c"))
    error = F.coalesce(lost, F.when(F.col("c").isNull(), F.when(F.coalesce("works", F.lit(False)), "no-share-links").otherwise("no-pattern")))
    text = lambda c, n: F.coalesce(kept[c], F.lit("")).alias(n)
    number = lambda c, n: F.coalesce(kept[c], F.lit(0)).alias(n)
    return out.select(
        "domain", kept.isNotNull().alias("ok"), text("template", "template"), number("real", "real_hits"), number("noise", "noise_hits"), text("pattern", "result_re"), number("n", "link_yield"), F.coalesce(error, F.lit("")).alias("error")
    )
