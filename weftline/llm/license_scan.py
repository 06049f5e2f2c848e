"""License scans by ordered signature rules. DataFrame functions only; texts are never shuffled.

A text is looked at only if a stem of some phrase or keyword occurs in it at all, as a plain search. The rules are
regexes over the text's words, lower-cased and set apart by single spaces. A rule runs only if its keyword occurs; its
detections are intervals of words. Detections are taken by priority, then length, and one that lies within a detection
taken before is suppressed: that is, one that lies within any other of an earlier place in this order, as what holds a
suppressed one holds the other too. So one pass over the intervals by start, with the farthest end so far of each
priority, tells which stay. Intervals are rows, in windows by text: their cost grows with their number, not its square.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, materialise, scratch_dir
from .signatures import STEMS, build_rules

#: What separates words; words are runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII characters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the text as it stands, before A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose every place counts, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
RULES = build_rules()


def _may_match(lowered: Column, base: Sequence[tuple[str, str]], rules: Sequence[tuple[int, str, str, str]], stems: Sequence[str]) -> Column:
    """Whether a stem that every rule's keyword holds occurs, or every word of some base phrase."""
    if odd := [keyword for _, _, keyword, _ in rules if not any(x in keyword for x in stems)]:
        raise ValueError(f"keywords without a stem: {odd}")
    used = [x for x in stems if any(x in keyword for _, _, keyword, _ in rules)]
    ways = [[x] for x in used] + [words for phrase, _ in base if not any(x in phrase for x in used) for words in [phrase.split()]]
    return F.coalesce(reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.contains(lowered, F.lit(w)) for w in words)) for words in ways)), F.lit(False))


def _count_words(padded: Column) -> Column:
    """Words of a text in which each has a space on either side."""
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(" ")))) / 2).cast("long")


def scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, rules: Sequence[tuple[int, str, str, str]] | None = None, stems: Sequence[str] = STEMS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections are structs (p, size, start, stop, label) of what stays, by priority, then length (size is its negative),
    start, stop and label; of equal ones, one. rules: (priority, label, keyword, regex), the keyword standing in every
    match and holding one of ``stems``.

    n_base counts the places of base phrases; first_word and last_word are their smallest and largest start. labels are
    the base labels and those of the detections that stay; ``unknown`` is named only where nothing else is. score is
    1 for a license text or grant, less for weaker signs, 0 for none. Null texts are empty; an empty table gives an
    empty result; repeated rows and ids are scanned each; other columns are ignored, whatever their names.
    """
    rules = RULES if rules is None else rules
    folder = scratch_dir(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lower("text").alias("lowered"))
    rows = rows.select("doc_id", "text", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), _may_match(F.col("lowered"), base, rules, stems).alias("open"))
    spaced = F.concat(F.lit(" "), F.regexp_replace(ascii_lower(F.col("text")), GAP, "  "), F.lit(" "))
    # Gaps at the ends leave lone spaces behind; one space on either side of each word, none elsewhere.
    spaced = F.regexp_replace(F.regexp_replace(spaced, r"^ +(?=[^ ]|$)", " "), r" +$", " ")
    rows = rows.select("doc_id", "n_words", F.when(F.col("open") & (F.col("n_words") > 0), spaced).otherwise("").alias("padded"))

    # Base phrases: what stands between their places, cut by the phrase.
    for k, (phrase, _) in enumerate(base):
        cut = F.lit(" " + phrase.replace(" ", "  ") + " ")
        rows = rows.withColumn(f"cut{k}", F.when(F.contains("padded", cut), F.split("padded", F.concat(F.lit(r"\Q"), cut, F.lit(r"\E")), -1)))

    def first(k: int) -> Column:
        return _count_words(F.element_at(f"cut{k}", 1))

    def last(k: int) -> Column:
        return F.col("n_words") - _count_words(F.element_at(f"cut{k}", -1)) - len(base[k][0].split())

    n_base = reduce(lambda a, b: a + b, (F.coalesce(F.size(F.col(f"cut{k}")) - 1, F.lit(0)) for k in range(len(base)))).cast("long")
    null = F.lit(None).cast("long")
    rows = rows.select(
        "doc_id", "padded", "n_words", n_base.alias("n_base"),
        F.least(null, null, *(first(k) for k in range(len(base)))).alias("first_word"), F.greatest(null, null, *(last(k) for k in range(len(base)))).alias("last_word"),
        F.array_compact(F.array(*(F.when(F.col(f"cut{k}").isNotNull(), F.lit(label)) for k, (_, label) in enumerate(base)))).alias("base_found"),
    )

    # Signature rules: the keyword gates each. Nothing of the text goes on, only its intervals.
    table = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(p).alias("p"), F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(f"(?<= )(?:{regex})(?= )").alias("regex")) for k, (p, label, keyword, regex) in enumerate(rules)))
    rows = rows.withColumn("words", F.when(F.col("padded") != "", F.replace("padded", F.lit("  "), F.lit(" "))))
    rows = rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_found", _hits(F.col("words"), table).alias("hits"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "scanned", folder)
    found = _kept(rows.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*"), sorted({r[0] for r in rules}))
    kept = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("p", "size", "start", "stop", "label"))).alias("detections"))
    rows = rows.drop("hits").join(kept, "row", "left")
    named = F.transform("detections", lambda d: d["label"])
    clear = F.filter(named, lambda x: x != "unknown")
    found = F.array_sort(F.array_distinct(F.concat("base_found", F.coalesce(F.when(F.size(clear) + F.size("base_found") > 0, clear).otherwise(named), F.array().cast("array<string>")))))
    best = F.array_min(F.transform("detections", lambda d: d["p"]))
    score = F.greatest(F.coalesce((F.lit(10.0) - best) / 9, F.lit(0.0)), F.when(F.col("n_base") > 0, 0.7).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base_found")), ",").alias("base_labels"), F.array_join(found, ",").alias("labels"), score.alias("score"), "detections",
    )


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _hits(words: Column, table: Column) -> Column:
    """array<struct<rule, p, label, k, gap, size>>: every match of every rule whose keyword occurs. A rule's k-th match has
    ``size`` words, and ``gap`` spaces before it from the match before (from the start of words)."""

    def of(rule: Column) -> Column:
        pieces, hits = F.split(words, rule["regex"], -1), F.regexp_extract_all(words, rule["regex"], F.lit(0))
        pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(_blanks(p).alias("gap"), (_blanks(h) + 1).alias("size")))
        return F.transform(pairs, lambda x, k: F.struct(rule["rule"].alias("rule"), rule["p"].alias("p"), rule["label"].alias("label"), k.alias("k"), x["gap"].alias("gap"), x["size"].alias("size")))

    live = F.filter(table, lambda r: F.contains(words, r["keyword"]))
    return F.flatten(F.transform(live, of))


def _kept(hits: DataFrame, priorities: Sequence[int]) -> DataFrame:
    """hits (row, rule, p, label, k, gap, size) -> row, p, size, start, stop, label of those that lie within none that goes before.

    A match starts after all spaces before it but its own: those of gaps, and those within earlier matches of its rule.
    """
    hits = hits.repartition("row")
    order = Window.partitionBy("row", "rule").orderBy("k")
    start = F.sum(F.col("gap") + F.col("size") - 1).over(order) - F.col("size")
    placed = hits.withColumn("start", start.cast("int")).select("row", "p", "label", (-F.col("size")).alias("size"), "start", (F.col("start") + F.col("size")).alias("stop"))
    before = Window.partitionBy("row").orderBy("start", F.desc("stop"), "p", "label").rowsBetween(Window.unboundedPreceding, -1)
    held = F.lit(False)
    for level in priorities:
        held = held | ((F.col("p") == level) & (F.coalesce(F.max(F.when(F.col("p") <= level, F.col("stop"))).over(before), F.lit(-1)) >= F.col("stop")))
    return placed.withColumn("held", held).filter("not held").select("row", "p", "size", "start", "stop", "label")
