"""API payloads read by configuration: where a source's items, links and titles are is told by columns, not by code.

A path is dotted: keys of objects, places of lists; a key that is asked of a list is asked of its items, of which the
first that has something counts. Paths are folded step by step over VARIANT, so one plan reads the payloads of all sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H

#: A configuration: format is json, xml or html; items, link, title are paths (json) or tags (xml); link_template has paths in
#: braces; link_re and base are for html.
CONFIG = "source string, format string, items string, link string, title string, link_template string, link_re string, base string"
#: Characters of a title at most, and configurations that are broadcast.
TITLE, BROADCAST_ROWS = 300, 10_000


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _variant(v: Column, path: Column, kind: str = "variant") -> Column:
    return F.call_function("try_variant_get", v, path, F.lit(kind))


def _field(v: Column, key: Column) -> Column:
    return _variant(v, F.concat(F.lit('$["'), key, F.lit('"]')))


def _list(v: Column) -> Column:
    """A list's items; null if it is none."""
    return _variant(v, F.lit("$"), "array<variant>")


def _text(v: Column) -> Column:
    """A scalar as text, what holds others as JSON; null for null."""
    return F.when(~F.is_variant_null(v), F.coalesce(_variant(v, F.lit("$"), "string"), F.to_json(v)))


def _first(v: Column) -> Column:
    """A list's first item that isn't null or empty; any other value itself."""
    return F.when(_list(v).isNull(), v).otherwise(F.get(F.filter(_list(v), lambda x: F.coalesce(_text(x) != "", F.lit(False))), F.lit(0)))


def _says(v: Column) -> Column:
    return F.coalesce(~_text(v).isin("", "false", "0", "0.0", "[]", "{}"), F.lit(False))


def _path(path: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(path, r"\."))


def _step(v: Column, key: Column, fan: bool) -> Column:
    """One step of a path; fan: whether a key is asked of a list's items too."""
    place = _variant(v, F.concat(F.lit("$["), key, F.lit("]")))
    into = F.get(F.filter(F.transform(_list(v), lambda x: _first(_field(x, key))), _says), F.lit(0)) if fan else F.lit(None).cast("variant")
    return F.when(_list(v).isNull(), _field(v, key)).when(key.rlike("^[0-9]+$"), place).otherwise(into)


def dig(v: Column, path: Column) -> Column:
    """The value at a path; of a list at its end, the first item that has something. Null without a path."""
    found = F.aggregate(_path(path), v, lambda at, key: _step(at, key, True))
    return F.when(F.coalesce(path, F.lit("")) != "", _first(found))


def dig_list(v: Column, path: Column) -> Column:
    """All items of the list at a path, "$" being the payload itself; a value that is no list is its only item."""
    found = F.when(F.trim(path).isin("$", "*"), v).otherwise(F.aggregate(_path(path), v, lambda at, key: _step(at, key, False)))
    one = F.when(F.coalesce(path, F.lit("")).isin("", "$", "*") | ~_says(found), F.array().cast("array<variant>")).otherwise(F.array(found))
    return F.coalesce(_let(found, _list), one)


def quoted(text: Column) -> Column:
    """Percent-encoded, slashes kept."""
    for sign, code in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        text = F.replace(F.url_encode(text) if sign == "+" else text, F.lit(sign), F.lit(code))
    return text


def filled(template: Column, v: Column) -> Column:
    """A template with the values at the paths in its braces; null if one of them has nothing."""
    asked = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([^{}]+)\}"), F.lit(1)))
    url = F.aggregate(asked, template, lambda url, path: F.replace(url, F.concat(F.lit("{"), path, F.lit("}")), quoted(F.nullif(_text(dig(v, path)), F.lit("")))))
    return F.when(~F.contains(url, F.lit("{")), url)


def _tag(tag: Column) -> Column:
    """A regex for a tag with what it holds."""
    return F.concat(F.lit(r"(?is)<\Q"), tag, F.lit(r"\E\b[^>]*>(.*?)</\Q"), tag, F.lit(r"\E>"))


def _tagged(block: str, tag: Column) -> Column:
    raw = F.regexp_replace(F.call_function("regexp_extract", F.col(block), _tag(F.nullif(tag, F.lit(""))), F.lit(1)), "<[^>]+>", "")
    return F.nullif(F.trim(H.unescaped(raw)), F.lit(""))


def _anchors(body: Column, pattern: Column) -> Column:
    """What a pattern finds, each once: its first group, if it has one, as the link, and all of it."""
    grouped = pattern.rlike(r"(?<!\\)\((?!\?)")
    whole = F.regexp_extract_all(body, F.concat(F.lit("(?i)"), pattern), F.lit(0))
    href = F.when(grouped, F.regexp_extract_all(body, F.concat(F.lit("(?i)"), pattern), F.lit(1))).otherwise(whole)
    both = F.zip_with(href, whole, lambda h, w: F.struct(F.when(h == "", w).otherwise(h).alias("href"), w.alias("whole")))
    return _let(both, lambda found: F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: y["href"]), x["href"]) == i + 1))


def read(payloads: DataFrame, config: DataFrame) -> DataFrame:
    """payloads (source, seq, body) by config (CONFIG, a row for each source) -> source, seq, rank, url, title.

    Links are http(s) ones; an item whose link, or a placeholder of its link's template, has nothing is left out. Payloads
    that can't be read, or of sources without a configuration, give nothing. Only items of a source's format are looked for.
    """
    small = F.broadcast(config) if config.count() <= BROADCAST_ROWS else config
    rows = payloads.select("source", "seq", "body").join(small, "source").withColumn("format", F.lower(F.coalesce("format", F.lit("json"))))
    kind = F.col("format")
    json = F.when(kind == "json", F.transform(_let(F.try_parse_json("body"), lambda v: dig_list(v, F.col("items"))), lambda v: F.struct(v.alias("v"), F.lit(None).cast("string").alias("block"), F.lit(None).cast("string").alias("href"))))
    nothing = F.lit(None).cast("variant")
    xml = F.when((kind == "xml") & (F.col("items") != ""), F.transform(F.regexp_extract_all("body", _tag(F.col("items")), F.lit(1)), lambda b: F.struct(nothing.alias("v"), b.alias("block"), F.lit(None).cast("string").alias("href"))))
    page = F.when((kind == "html") & (F.col("link_re") != ""), F.transform(_anchors(F.col("body"), F.col("link_re")), lambda a: F.struct(nothing.alias("v"), a["whole"].alias("block"), a["href"].alias("href"))))
    found = rows.select("source", "seq", "format", "link", "title", "link_template", "base", F.posexplode(F.coalesce(json, xml, page)).alias("rank", "i")).select("*", "i.v", "i.block", "i.href")
    template = F.coalesce("link_template", F.lit("")) != ""
    own = F.when(template, filled(F.col("link_template"), F.col("v"))).otherwise(_text(dig(F.col("v"), F.col("link"))))
    absolute = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.coalesce("base", F.lit("")), "href"))
    line = F.trim(F.regexp_replace(F.regexp_replace("block", "<[^>]+>", " "), r"\s+", " "))
    url = F.when(kind == "json", own).when(kind == "xml", _tagged("block", F.col("link"))).otherwise(absolute)
    title = F.when(kind == "json", F.trim(_text(dig(F.col("v"), F.col("title"))))).when(kind == "xml", _tagged("block", F.col("title"))).otherwise(H.unescaped(line))
    out = found.select("source", "seq", "rank", "format", url.alias("url"), F.nullif(F.substr(title, F.lit(1), F.lit(TITLE)), F.lit("")).alias("title"))
    return out.filter(F.col("url").rlike("^https?://") | (F.col("format") == "html")).drop("format")
