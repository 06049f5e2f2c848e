"""Source divergence audit: how the words of sources differ, and which words set a source apart from its language.

Counts of terms by (lang, source) are made batch by batch and added up. A pair of sources is summed over all kept terms
without listing them: all terms count as absent from both first (the baseline), each source's terms correct that by a
histogram of their counts, and only terms that both have are met by a join. The first terms of each group are found by
radix select (``first_of``): histograms over the next bytes of a sort key, value first and then the term's UTF-8, narrow
each group's threshold down until what is left is few, so no group is ever sorted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, SMALL_ROWS, hot_join, materialise, numbered, scratch_dir, slices, text_bytes, tokenised

#: Bytes of terms: ASCII letters and all of other characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of text that are counted at once, the unit of probabilities, and what is added to each count.
SLICE, UNIT, ADDED = 4 << 20, 1_000_000_000, 2
#: Radix select: bytes of a value and of a step, and rows left of a group, by those asked for, that are sorted.
VALUE_BYTES, STEP, SORTED = 4, 2, 64


def _counted(size: int):
    def add(body: np.ndarray, heads: np.ndarray, of: np.ndarray) -> pa.Table:
        """By group (of: of each text) and term: n, and in how many texts."""
        starts, _, encoded = tokenised(body, heads, LETTER, LOWER)
        terms = encoded.dictionary
        width = max(1, len(terms))
        doc = np.searchsorted(heads, starts, side="right") - 1
        seen, n = np.unique(doc * width + encoded.indices.to_numpy(), return_counts=True)
        both, which = np.unique(of[seen // width] * width + seen % width, return_inverse=True)
        sums = np.zeros(len(both), np.int64)
        np.add.at(sums, which, n)
        return pa.table({"g": both // width, "term": terms.take(pa.array(both % width)), "n": sums, "df": np.bincount(which, minlength=len(both))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.table({"lang": batch.column("lang"), "source": batch.column("source")}).group_by(["lang", "source"], use_threads=False)
            known = groups.aggregate([])
            place = {pair: k for k, pair in enumerate(zip(known.column("lang").to_pylist(), known.column("source").to_pylist()))}
            of = np.array([place[p] for p in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())], np.int64)
            body, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets, size):
                lo, hi = offsets[i], offsets[j]
                if j - i > 1 or hi - lo <= size:
                    found = add(body[lo:hi], offsets[i:j] - lo, of[i:j])
                else:  # one text that is longer: cut between terms, then added up as one
                    cuts = np.concatenate(([lo], lo + np.flatnonzero(~LETTER[body[lo:hi]]), [hi]))
                    parts = [add(body[cuts[a] : cuts[b]], np.zeros(1, np.int64), of[i:j]) for a, b in slices(cuts, size)]
                    found = pa.concat_tables(parts).group_by(["g", "term"], use_threads=False).aggregate([("n", "sum")])
                    found = found.rename_columns(["g", "term", "n"]).append_column("df", pa.array(np.ones(len(found), np.int64)))
                at = found.column("g")
                out = pa.table({"lang": known.column("lang").take(at), "source": known.column("source").take(at), "term": found.column("term").cast(pa.string()), "n": found.column("n"), "df": found.column("df").cast(pa.int64())})
                yield from out.combine_chunks().to_batches()

    return run


def _p(count: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(UNIT * (count + ADDED) / (total + ADDED * terms)), exactly, in numbers of up to 38 digits."""
    whole = lambda c, d: (F.col(c) if isinstance(c, str) else c).cast(f"decimal({d}, 0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10, 0)") * whole((F.col(count) if isinstance(count, str) else count) + ADDED, 19), whole(F.col(total) + ADDED * F.col(terms), 19)) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def first_of(rows: DataFrame, within: list[str], value: str, item: str, k: int, folder: str) -> DataFrame:
    """The first k rows of each group by value descending and item (UTF-8) ascending, with their ranks from 1.

    rows: a stored table; values from 0 to 2^32 - 1. Equal rows are ranked in any order.
    """
    key = F.concat(F.unhex(F.lpad(F.hex(F.lit((1 << 8 * VALUE_BYTES) - 1) - F.col(value)), 2 * VALUE_BYTES, "0")), F.col(item).cast("binary"))
    rows = rows.withColumn("\x00key", key)
    state, level, open_ = None, 0, rows.select(*within, "\x00key")
    while True:
        level += 1
        bucket = F.substring("\x00key", 1, level * STEP)
        counts = open_.groupBy(*within, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        if state is not None:
            counts = counts.join(state.select(*within, "need"), within)
        else:
            counts = counts.withColumn("need", F.lit(k).cast("long"))
        counts = materialise(counts, f"counts{level}", folder)
        order = Window.partitionBy(*within).orderBy("bucket")
        edge = counts.withColumn("upto", F.sum("n").over(order)).filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        # Few left, or nothing more to tell them by: what is in the boundary bucket is sorted with the rest.
        done = (F.col("n") <= k * SORTED) | (F.length("bucket") < level * STEP)
        edge = materialise(edge.select(*within, F.col("bucket").alias("prefix"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"), "n", done.alias("done")), f"edge{level}", folder)
        yielded = edge.filter("done").select(*within, "prefix")
        ends = yielded if level == 1 else ends.unionByName(yielded)
        state = edge.filter("not done")
        if state.isEmpty():
            break
        inside = hot_join(open_, materialise(state, f"open edge{level}", folder), within, "n")
        open_ = materialise(inside.filter(F.substring("\x00key", 1, level * STEP) == F.col("prefix")).select(*within, "\x00key"), f"open{level}", folder)
    sizes = rows.groupBy(*within).agg(F.count(F.lit(1)).alias("\x00n"))
    # Groups of fewer than k rows have no boundary: all of them stay.
    sizes = materialise(sizes.join(materialise(ends, "ends", folder), within, "left"), "groups", folder)
    head = F.expr("substring(`\x00key`, 1, length(prefix))")
    left = hot_join(rows, sizes, within, "\x00n").filter(F.col("prefix").isNull() | (head <= F.col("prefix")))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy("\x00key"))
    return left.withColumn("rank", rank).filter(F.col("rank") <= k).drop("\x00key", "\x00n", "prefix")


class Audit:
    """The tables of an audit: cells (lang, source, term, n, total: the lang's count), groups (lang, source, v, n, n_lang).

    Null texts, langs and sources count as empty; rows that repeat count each. An empty table gives empty tables; other
    columns are ignored, whatever their names.
    """

    def __init__(self, docs: DataFrame, least: int = 10, size: int = SLICE):
        self.folder = scratch_dir(docs.sparkSession)
        rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
        counts = rows.mapInArrow(_counted(size), "lang string, source string, term string, n long, df long")
        counts = materialise(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts", self.folder)
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).filter(F.col("df") >= least).drop("df")
        kept = materialise(kept, "kept", self.folder)
        self.cells = materialise(counts.drop("df").join(kept, ["lang", "term"]), "cells", self.folder)
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
        sums = self.cells.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("size"))
        groups = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n", "size"])
        absent = F.when(F.col("v") > 0, _p(F.lit(0), "n", "v")).otherwise(1)
        self.groups = materialise(groups.withColumn("absent", absent), "groups", self.folder)
        self.few = self.groups.count() <= SMALL_ROWS

    def _of_lang(self, *columns: Column) -> DataFrame:
        other = self.groups.select("lang", *columns)
        return F.broadcast(other) if self.few else other

    def pairs(self) -> DataFrame:
        """lang, source, item (another source), value, rank: all of each group."""
        s, t = F.col("source"), F.col("item")
        own, theirs = F.col("absent"), F.col("other")
        there = self._of_lang(F.col("source").alias("item"), F.col("absent").alias("other"))
        # What a source's terms change where the other source lacks them, by how often they occur.
        shape = self.cells.groupBy("lang", "source", F.col("n").alias("count")).agg(F.count(F.lit(1)).alias("m"))
        shape = hot_join(shape, self.groups, ["lang", "source"], "size").withColumn("p", _p("count", "n", "v"))
        alone = shape.join(there, "lang").filter(s != t).groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (_f(F.col("p"), theirs) - _f(own, theirs))).alias("alone"))
        alone = materialise(alone, "alone", self.folder)
        # What terms of both change beyond that; each pair once.
        known = hot_join(self.cells.withColumnRenamed("n", "count"), self.groups, ["lang", "source"], "size").select("lang", "term", "source", _p("count", "n", "v").alias("p"), "absent")
        known = materialise(known, "known", self.folder)
        other = known.select("lang", "term", t_(), F.col("p").alias("q"), F.col("absent").alias("other"))
        p, q = F.col("p"), F.col("q")
        both = known.join(other, ["lang", "term"]).filter(s < t).groupBy("lang", "source", "item").agg(F.sum(_f(p, q) - _f(p, theirs) - _f(own, q) + _f(own, theirs)).alias("both"))
        both = materialise(both, "both", self.folder)
        both = both.unionByName(both.select("lang", t_("item", "source"), t_(), "both"))
        every = self.groups.select("lang", "source", "v", "absent").join(there, "lang").filter(s != t)
        back = alone.select("lang", t_("item", "source"), t_(), F.col("alone").alias("back"))
        keys = ["lang", "source", "item"]
        rows = every.join(alone, keys, "left").join(back, keys, "left").join(both, keys, "left").na.fill(0, ["alone", "back", "both"])
        value = F.when(F.col("v") > 0, F.col("v") * _f(own, theirs) + F.col("alone") + F.col("back") + F.col("both")).otherwise(0)
        rows = materialise(rows.select(*keys, value.cast("long").alias("value")), "pairs", self.folder)
        return numbered(rows, ["lang", "source"], [F.desc("value"), F.asc("item")], "rank", self.folder).withColumn("rank", (F.col("rank") + 1).cast("int"))

    def terms(self, k: int = 10) -> DataFrame:
        """lang, source, item (a term more likely in the group than in its lang), value, rank: the first k of each group."""
        rows = hot_join(self.cells.withColumnRenamed("n", "count"), self.groups, ["lang", "source"], "size")
        p, q = F.col("p"), F.col("q")
        rows = rows.select("lang", "source", F.col("term").alias("item"), _p("count", "n", "v").alias("p"), _p("total", "n_lang", "v").alias("q")).filter(p > q)
        rows = materialise(rows.select("lang", "source", "item", _f(p, q).alias("value")), "terms", self.folder)
        return first_of(rows, ["lang", "source"], "value", "item", k, f"{self.folder}/radix")


def t_(of: str = "source", to: str = "item") -> Column:
    return F.col(of).alias(to)


def audit(docs: DataFrame, least: int = 10, k: int = 10, size: int = SLICE) -> DataFrame:
    """docs (lang, source, text) -> lang, source, part (``pair`` or ``term``), item, value, rank. See Audit."""
    found = Audit(docs, least, size)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return found.pairs().withColumn("part", F.lit("pair")).select(*columns).unionByName(found.terms(k).withColumn("part", F.lit("term")).select(*columns))
