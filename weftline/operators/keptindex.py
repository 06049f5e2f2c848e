"""A kept inverted index: postings by term with positions, a forward index by document, segments and delete marks.

A segment's postings lie in files that each hold some documents whole, sorted by (term, doc_id), so a filter on terms, or
on a prefix, skips row groups and pages by their bounds, and a term's documents are spread over files; making them shuffles
nothing. Its forward rows (a document's terms, its text, time and whether it has links) lie on shelves by a hash of the id,
sorted by id, so what a few documents held is found by reading their pages alone.

An upsert adds a segment and marks the older rows of its documents as gone; it reads the forward rows of these documents
and nothing else of the index. Numbers of documents by term are kept as differences by segment. ``merge`` writes several
segments as one, ``tidy`` does so wherever there are ``FAN`` of a size. What is in force is said by the newest version of
the manifest, which is written last: a writer that dies leaves nothing that is read, a reader goes on with what it opened.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship, state
from .textindex import bm25_part

#: Marks, or ids of candidates, that a query broadcasts at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Query units at most, and candidates beyond which recency takes the place of relevance, if that is asked for.
MOST_UNITS, RANK_CANDIDATES = 6, 20_000
#: Letters that a Latin word needs to be searched as a prefix.
PREFIX_LETTERS = 4
#: Documents of a shelf, segments of a size that are merged, ids that are looked up by name, and candidates that are held
#: against their texts by rank before all of them are.
SHELF_ROWS, FAN, LOOKED_UP, CHECKED = 200_000, 4, 1_000, 4_000
#: Bytes of text of a shelf, so that a task can sort its rows.
SHELF_BYTES = 48 << 20
#: Postings of a block, blocks that a threshold is taken from, and blocks that are told apart by name in a filter.
BLOCK, FIRST_BLOCKS, NAMED_BLOCKS = 65_536, 8, 1_000
IN_THRESHOLD, BATCH = "spark.sql.parquet.pushdown.inFilterThreshold", "spark.sql.execution.arrow.maxBytesPerBatch"
SPLIT = "spark.sql.files.maxPartitionBytes"
#: Ids of one list of a filter, which becomes as deep a chain; tokens that make a file of postings, so that a task can sort them.
LISTED, FILE_TOKENS = 50, 4_000_000
#: What the parts of an index hold, folders included.
SCHEMAS = {
    "postings": "term string, doc_id long, tf int, dl int, at timestamp, linked boolean, positions array<int>, seg int",
    "forward": "doc_id long, dl int, at timestamp, linked boolean, text string, tokens array<string>, seg int, shelf int",
    "blocks": "term string, part int, lo long, hi long, n long, cf long, tf int, dl int, newest timestamp, seg int",
    "vocabulary": "term string, df long, cf long, seg int",
    "gone": "doc_id long, old int, seg int",
    "manifest": "seg int, rows long, shelves int, live long, tokens long, texts boolean, version int",
}


class Segment(NamedTuple):
    """rows and shelves of its forward index; what it adds to the documents in force and their tokens; whether it has texts."""

    rows: int
    shelves: int
    live: int
    tokens: int
    texts: bool


@dataclass(frozen=True)
class Unit:
    """What a query asks for: tokens one after another, any token that begins with the one given (``prefix``), or all of
    the tokens anywhere (``every``). proof: whether a text that has the unit has the term, so that nothing is left to check."""

    tokens: tuple[str, ...]
    prefix: bool = False
    every: bool = False
    proof: bool = field(default=False, compare=False)


def unit_of(term: str) -> Unit:
    """A folded term as a unit that no text with the term lacks, but for those that hold a lone character only at the end
    of a run: CJK as its pairs one after another; a lone character, and a Latin word of four letters or more, as a prefix,
    else the word itself. A lone character beside other tokens pairs with what follows it in the text, whatever that is, so
    only the other tokens are asked for."""
    found = T.mixed_token_list(term)
    whole = [t for t in found if len(t) > 1 or t.isascii()]
    if whole and len(whole) < len(found):
        return Unit(tuple(dict.fromkeys(whole)), every=True)
    lone = len(found) == 1 and (not whole or found[0].isascii() and found[0].isalpha() and len(found[0]) >= PREFIX_LETTERS)
    return Unit(tuple(found), lone, proof=exact_term(term))


def units_of(terms: Sequence[str]) -> list[Unit]:
    """The first units of a query; lone characters, whose prefixes are dear, only where there is nothing else."""
    units = [u for u in map(unit_of, terms[:MOST_UNITS]) if u.tokens]
    rich = [u for u in units if not (u.prefix and not u.tokens[0].isascii())]
    return rich or units


def exact_term(term: str) -> bool:
    """Whether the index itself says exactly if a text has a term: CJK of two characters or more, and nothing else."""
    return len(term) > 1 and all(T.is_cjk(c) for c in term)


class Index:
    """The index in a folder that driver and executors share. tokens: the array of tokens of a row of documents; text: its
    folded text, at: its time, linked: whether it has links; these are kept where they are given."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._open()

    # --- what is in force --------------------------------------------------------------------------

    def _read(self, name: str, seg: int | None = None) -> DataFrame:
        schema = SCHEMAS[name]
        if seg is None:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(schema.replace(", seg int", "")).parquet(f"{self.path}/{name}/seg={seg}")

    def _open(self) -> None:
        found = self._read("manifest").collect()  # a row for each segment of each version
        self.version = max(r["version"] for r in found)
        self.sizes = {r["seg"]: Segment(*(r[f] for f in Segment._fields)) for r in found if r["version"] == self.version}
        self.n, tokens = sum(s.live for s in self.sizes.values()), sum(s.tokens for s in self.sizes.values())
        self.avgdl = tokens / self.n if self.n else 0.0
        own = F.col("seg").isin(sorted(self.sizes))
        self.all_postings, self.vocabulary_rows, self.forward = (self._read(n).filter(own) for n in ("postings", "vocabulary", "forward"))
        self.forward = self.forward.filter("dl > 0")
        self.all_blocks = self._read("blocks").filter(own)
        self.marks = self._read("gone").filter(own & F.col("old").isin(sorted(self.sizes)))
        self.stale = self.marks.count() if len(self.sizes) > 1 else 0

    @property
    def segments(self) -> int:
        return len(self.sizes)

    def _commit(self, sizes: dict[int, Segment], version: int) -> Index:
        rows = self.spark.createDataFrame([(seg, *s) for seg, s in sizes.items()], SCHEMAS["manifest"].replace(", version int", ""))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        self._open()
        return self

    @property
    def has_texts(self) -> bool:
        return all(s.texts for s in self.sizes.values())

    # --- writing -----------------------------------------------------------------------------------

    @classmethod
    def build(cls, docs: DataFrame, tokens: Column, path: str, files: int | None = None, text: Column | None = None, at: Column | None = None, linked: Column | None = None, held: int | None = None) -> Index:
        """docs (doc_id, ...) -> an index of those that have tokens. Null ids are left out; of rows that repeat an id, one
        must have been chosen before. held: their bytes, where these are known."""
        self = object.__new__(cls)
        self.spark, self.path = docs.sparkSession, path
        files = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        size = self._write(docs, tokens, 0, files, text, at, linked, held)
        self._put("gone", self.spark.createDataFrame([], "doc_id long, old int"), 0)
        return self._commit({0: size}, 0)

    def _put(self, name: str, rows: DataFrame, seg: int, mode: str = "overwrite") -> None:
        rows.write.mode(mode).parquet(f"{self.path}/{name}/seg={seg}")

    def _shelve(self, rows: DataFrame, seg: int, shelves: int, made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """made: what is written of rows; it is made after they are dealt out, so what it adds isn't shuffled."""
        placed = made(rows.withColumn("shelf", _shelf(F.col("doc_id"), shelves)).repartitionById(shelves, F.col("shelf")).sortWithinPartitions("shelf", "doc_id"))
        placed.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 8 << 20).option("parquet.page.row.count.limit", 500).partitionBy("shelf").parquet(f"{self.path}/forward/seg={seg}")

    def _post(self, seg: int, tokens: int) -> None:
        """The postings of a segment and their blocks, from its forward rows, which have so many tokens: a task takes documents
        of about FILE_TOKENS, makes their places by term in their own rows, sorts them and writes its file, without a shuffle."""
        split = max(1, self._bytes(f"forward/seg={seg}") * FILE_TOKENS // max(tokens, 1))
        with _setting(self.spark, BATCH, str(4 << 20)), _setting(self.spark, SPLIT, str(min(split, 128 << 20))):
            ship(self.spark)
            posted = self._read("forward", seg).filter("dl > 0").select("doc_id", "dl", "at", "linked", "tokens").mapInArrow(_posted, "term string, doc_id long, tf int, dl int, at timestamp, linked boolean, positions array<int>")
            placed = posted.sortWithinPartitions("term", "doc_id")
            placed.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).option("maxRecordsPerFile", 0).parquet(f"{self.path}/postings/seg={seg}")
        # Of a term's postings in a file, BLOCK at a time: their documents, and what bounds their scores and times. Rows are short
        # here, and a bound on a batch's bytes, which Spark sees to row by row, would take longer than all else.
        with _setting(self.spark, BATCH, str(2**31 - 1)):
            blocks = self._read("postings", seg).select("term", _part().alias("part"), "doc_id", "tf", "dl", "at").mapInArrow(_blocks(BLOCK), SCHEMAS["blocks"].replace(", seg int", ""))
            self._put("blocks", blocks.sortWithinPartitions("term"), seg)

    def _bytes(self, name: str) -> int:
        return state(self.spark, f"{self.path}/{name}")[1]

    def _words(self, words: DataFrame, seg: int) -> None:
        """words: as a group by term gives them, so each of its tasks has its own terms."""
        self._put("vocabulary", words.sortWithinPartitions("term"), seg)

    def _size(self, seg: int, shelves: int, texts: bool) -> Segment:
        n, tokens = self._read("forward", seg).filter("dl > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return Segment(n, shelves, n, tokens, texts)

    def _write(self, docs: DataFrame, tokens: Column, seg: int, files: int, text: Column | None, at: Column | None, linked: Column | None, held: int | None = None) -> Segment:
        """The forward rows and, from them, the postings and the vocabulary of a segment: texts are tokenised once."""
        rows, held = docs.count(), bytes_of(docs) if held is None else held
        shelves, texts = max(files, math.ceil(rows / SHELF_ROWS), math.ceil(held / SHELF_BYTES)), text is not None
        text, at, linked = (F.lit(None).cast(kind) if c is None else c.cast(kind) for c, kind in ((text, "string"), (at, "timestamp"), (F.lit(True) if linked is None else linked, "boolean")))
        # Documents without tokens are written too, and readers leave them out (dl is 0): a filter here would have texts tokenised
        # twice, and rows made by a generator lose their order, so the writer would sort all of a shelf's tokens.
        made = lambda rows: rows.select("shelf", "doc_id", at.alias("at"), F.coalesce(linked, F.lit(False)).alias("linked"), text.alias("text"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens")).select("doc_id", F.size("tokens").alias("dl"), "at", "linked", "text", "tokens", "shelf")
        self._shelve(docs.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")), seg, shelves, made)
        size = self._size(seg, shelves, texts)
        self._post(seg, size.tokens)
        self._words(self._read("blocks", seg).groupBy("term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf")), seg)
        return size

    def looked_up(self, ids: DataFrame, *columns: str) -> DataFrame:
        """The live forward rows of ids (doc_id, distinct), with seg. Of few ids, by name: of their shelves, only pages that may have them are read."""
        few = [r["doc_id"] for r in ids.limit(LOOKED_UP + 1).collect()]
        if len(few) <= LOOKED_UP:
            return self._live(self._named(few).select("doc_id", "seg", *columns))
        small = ids.count() <= BROADCAST_ROWS
        return self._live(self.forward.select("doc_id", "seg", *columns)).join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def _named(self, ids: Sequence[int]) -> DataFrame:
        """Forward rows of a bounded list of ids."""
        shelf = lambda i, n: zlib.crc32(str(i).encode()) % n  # noqa: E731  as _shelf has it
        near = [(F.col("seg") == seg) & F.col("shelf").isin(sorted({shelf(i, s.shelves) for i in ids}) if s.shelves > 1 else [0]) for seg, s in self.sizes.items()]
        # Pushed down, a list is a chain as deep as it is long: several lists, in a tree, stay shallow.
        own = _any_of([f"doc_id in ({', '.join(map(str, ids[i : i + LISTED]))})" for i in range(0, len(ids), LISTED)] or ["false"])
        return self.forward.filter(reduce(lambda a, b: a | b, near) & F.expr(own))

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self.stale:
            return rows
        marks = self.marks.select("doc_id", F.col("old").alias("seg"))
        return rows.join(F.broadcast(marks) if self.stale <= BROADCAST_ROWS else marks, ["doc_id", "seg"], "left_anti")

    def upsert(self, docs: DataFrame, tokens: Column, removed: DataFrame | None = None, files: int = 1, text: Column | None = None, at: Column | None = None, linked: Column | None = None, tidy: bool = True) -> Index:
        """A new segment with docs, in place of older rows of the same ids and of those ``removed`` (doc_id)."""
        seg = self.version + 1  # versions are never used twice, so neither are segments
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        ids = (ids if removed is None else ids.unionByName(removed.select(F.col("doc_id").cast("long").alias("doc_id")))).filter("doc_id is not null").distinct()
        with _by_name(self.spark):
            self._put("changes", self.looked_up(ids, "dl", "tokens").withColumnRenamed("seg", "old"), seg)
        old = self.spark.read.schema("doc_id long, old int, dl int, tokens array<string>").parquet(f"{self.path}/changes/seg={seg}")
        size = self._write(docs, tokens, seg, files, text, at, linked)
        less = old.select("doc_id", F.explode("tokens").alias("term")).groupBy("term").agg((-F.countDistinct("doc_id")).alias("df"), (-F.count(F.lit(1))).alias("cf"))
        self._put("vocabulary", less, seg, "append")
        self._put("gone", old.select("doc_id", "old"), seg)
        live, lost = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self._commit(self.sizes | {seg: size._replace(live=size.live - live, tokens=size.tokens - lost)}, seg)
        return self.tidy(files) if tidy else self

    def merge(self, segs: Sequence[int], files: int = 1) -> Index:
        """Several segments as one, without what is gone; their files stay for readers that opened them."""
        seg, mine, some = self.version + 1, F.col("seg").isin(list(segs)), [self.sizes[s] for s in segs]
        shelves = _shelves(sum(s.rows for s in some), sum(s.tokens for s in some))
        self._shelve(self._live(self.forward.filter(mine)).drop("seg", "shelf"), seg, shelves)
        size = self._size(seg, shelves, all(s.texts for s in some))
        self._post(seg, size.tokens)
        words = self.vocabulary_rows.filter(mine).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        self._words(words.filter("df <> 0 or cf <> 0"), seg)
        # Marks on rows that were merged have done their work; those on others go on.
        self._put("gone", self.marks.filter(mine & ~F.col("old").isin(list(segs))).select("doc_id", "old"), seg)
        size = size._replace(live=sum(s.live for s in some), tokens=sum(s.tokens for s in some))
        return self._commit({s: x for s, x in self.sizes.items() if s not in segs} | {seg: size}, seg)

    def tidy(self, files: int = 1) -> Index:
        """Merge while there are FAN segments of a size, powers of FAN apart: a row is written again once for each size."""
        while True:
            by: dict[int, list[int]] = {}
            for seg, s in self.sizes.items():
                by.setdefault(int(math.log(max(s.rows, 1), FAN)), []).append(seg)
            some = next((sorted(g) for _, g in sorted(by.items()) if len(g) >= FAN), None)
            if some is None:
                return self
            self.merge(some, files)

    def compact(self, path: str, files: int | None = None) -> Index:
        """The same index as one segment, in another folder."""
        other = object.__new__(Index)
        other.spark, other.path = self.spark, path
        files = files or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        shelves = _shelves(self.n, sum(s.tokens for s in self.sizes.values()))
        other._shelve(self._live(self.forward).drop("seg", "shelf"), 0, shelves)
        size = other._size(0, shelves, self.has_texts)
        other._post(0, size.tokens)
        other._words(self.vocabulary(), 0)
        other._put("gone", self.spark.createDataFrame([], "doc_id long, old int"), 0)
        return other._commit({0: size}, 0)

    # --- reading -----------------------------------------------------------------------------------

    def vocabulary(self) -> DataFrame:
        """term, df, cf."""
        if self.segments == 1:
            return self.vocabulary_rows.select("term", "df", "cf")
        return self.vocabulary_rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).filter("df > 0")

    def postings(self, *terms: str) -> DataFrame:
        """term, doc_id, tf, dl, at, linked, positions of these terms; of all without any."""
        rows = self.all_postings.filter(F.col("term").isin(list(terms))) if terms else self.all_postings
        return self._live(rows).drop("seg")

    def matches(self, unit: Unit) -> DataFrame:
        """doc_id, tf, dl, at, linked of the documents that have a unit."""
        first, also = unit.tokens[0], [F.first(c).alias(c) for c in ("dl", "at", "linked")]
        if unit.prefix:
            return self._live(self.all_postings.filter(F.col("term").startswith(first))).groupBy("doc_id").agg(F.sum("tf").cast("int").alias("tf"), *also)
        if len(unit.tokens) == 1:
            return self.postings(first).select("doc_id", "tf", "dl", "at", "linked")
        names = list(dict.fromkeys(unit.tokens))
        if unit.every:
            return self.postings(*names).groupBy("doc_id").agg(F.min("tf").alias("tf"), *also, F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(names)).drop("n")
        # Where all tokens stand, each moved back by its place: the places that all share are the phrase's.
        at = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{k}") for k, t in enumerate(names)]
        by = self.postings(*names).groupBy("doc_id").agg(*also, *at).filter(" and ".join(f"p{k} is not null" for k in range(len(names))))
        back = lambda places, i: F.transform(places, lambda p: p - F.lit(i))
        moved = [back(f"p{names.index(t)}", i) for i, t in enumerate(unit.tokens)]
        return by.withColumn("tf", F.size(reduce(F.array_intersect, moved))).filter("tf > 0").select("doc_id", "tf", "dl", "at", "linked")

    def df(self, units: Sequence[Unit]) -> list[int]:
        """How many documents have each unit: of single tokens as it is kept, of others counted."""
        single = {u.tokens[0] for u in units if _single(u)}
        parts = [self.vocabulary_rows.filter(F.col("term").isin(sorted(single))).groupBy("term").agg(F.sum("df").alias("df"))] if single else []
        parts += [self.matches(u).agg(F.lit(f" {k}").alias("term"), F.count(F.lit(1)).alias("df")) for k, u in enumerate(units) if not _single(u)]
        found = {r["term"]: r["df"] for r in reduce(DataFrame.unionByName, parts).collect()} if parts else {}  # a row for each unit
        return [found.get(u.tokens[0] if _single(u) else f" {k}", 0) for k, u in enumerate(units)]

    def counted(self, units: Sequence[Unit]) -> DataFrame:
        """doc_id, dl, at, linked, t0, t1, ... (how often it has each unit, null: not) of the documents with any of these units."""
        simple = [k for k, u in enumerate(units) if _single(u)]
        parts = []
        if simple:
            place = F.coalesce(*(F.when(F.col("term") == units[k].tokens[0], F.lit(k)) for k in simple))
            parts.append(self.postings(*(units[k].tokens[0] for k in simple)).select("doc_id", place.alias("unit"), "tf", "dl", "at", "linked"))
        parts += [self.matches(u).select("doc_id", F.lit(k).alias("unit"), "tf", "dl", "at", "linked") for k, u in enumerate(units) if k not in simple]
        by_unit = [F.max(F.when(F.col("unit") == k, F.col("tf"))).alias(f"t{k}") for k in range(len(units))]
        return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(*(F.first(c).alias(c) for c in ("dl", "at", "linked")), *by_unit)

    def scored(self, units: Sequence[Unit], dfs: Sequence[int] | None = None, rows: DataFrame | None = None) -> DataFrame:
        """doc_id, score (BM25), has (which of the units, an array of booleans), at of the documents with any unit. rows: as
        ``counted`` gives them."""
        units = list(dict.fromkeys(units))
        dfs = self.df(units) if dfs is None else dfs
        # Added in the order of the units, so reruns agree to the last digit.
        parts = (F.coalesce(bm25_part(F.col(f"t{k}"), F.col("dl"), F.lit(float(self.n)), F.lit(float(x)), F.lit(float(self.avgdl))), F.lit(0.0)) for k, x in enumerate(dfs))
        has = F.array(*(F.col(f"t{k}").isNotNull() for k in range(len(units))))
        return (self.counted(units) if rows is None else rows).select("doc_id", reduce(lambda a, b: a + b, parts).alias("score"), has.alias("has"), "at")

    def _tiers(self, rows: DataFrame, units: Sequence[Unit], terms: Sequence[Unit], subjects: Sequence[Unit]) -> DataFrame:
        at = lambda some: [F.get("has", F.lit(units.index(u))) for u in some]
        every, alike = reduce(lambda a, b: a & b, at(terms)), reduce(lambda a, b: a & b, at(subjects))
        some = reduce(lambda a, b: a | b, at(subjects))
        return rows.withColumn("tier", F.when(every & alike, 1).when(alike, 2).when(some, 3)).filter("tier is not null")

    def tiered(self, terms: Sequence[Unit], subjects: Sequence[Unit]) -> DataFrame:
        """doc_id, tier, score: 1 for all terms, 2 for all subjects, 3 for any; what has no subject is left out.

        One pass over the postings of these terms, which is less than a job for each tier.
        """
        units = list(dict.fromkeys([*terms, *subjects]))
        return self._tiers(self.scored(units), units, terms, subjects).select("doc_id", "tier", "score")

    def top(self, terms: Sequence[str], limit: int, newest: bool = False) -> DataFrame:
        """doc_id, score, at of the best documents with any of the terms, by BM25, time and id; newest: by time and id alone.

        Blocks are read by what bounds them. The most promising give a threshold, the limit-th of their documents; of the
        others, only those are read that can hold as good a document, given the most that all other terms can add; terms that
        can't reach the threshold together don't make candidates. What is left out can't be among the results.
        """
        names, n, avgdl = list(dict.fromkeys(terms)), F.lit(float(self.n)), F.lit(float(self.avgdl))
        dfs = dict(zip(names, self.df([Unit((t,)) for t in names])))
        weight = F.element_at(F.create_map(*(F.lit(x) for t in names for x in (t, float(dfs[t])))), F.col("term"))
        part = lambda tf, dl: F.coalesce(F.unix_micros("newest" if tf == "block" else "at").cast("double"), F.lit(-1.0)) if newest else bm25_part(F.col("tf"), F.col("dl"), n, weight, avgdl)
        blocks = self.all_blocks.filter(F.col("term").isin(names)).withColumn("bound", part("block", None)).persist()
        rows = self._live(self.all_postings.filter(F.col("term").isin(names)).withColumn("part", _part()))

        def scored(chosen: list) -> list[dict]:
            some = rows if len(chosen) > NAMED_BLOCKS else rows.filter(_among([(b["seg"], b["part"], b["lo"], b["hi"]) for b in chosen]))
            by = some.groupBy("doc_id").agg(F.first("at").alias("at"), *(F.max(F.when(F.col("term") == t, part("row", None))).alias(f"s{k}") for k, t in enumerate(names)))
            added = F.greatest(*(F.col(f"s{k}") for k in range(len(names))), F.lit(-1.0)) if newest else reduce(lambda a, b: a + b, (F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(len(names))))
            order = [F.desc("place"), F.desc_nulls_last("time"), F.desc("doc_id")]
            found = by.select("doc_id", added.alias("score"), F.round(added, 9).alias("place"), F.unix_micros("at").alias("time")).orderBy(*order).limit(limit)
            return [r.asDict() for r in found.collect()]

        try:
            tops = {r["term"]: r["top"] for r in blocks.groupBy("term").agg(F.max("bound").alias("top")).collect()}
            self.blocks_read = [0, blocks.count()]
            most = F.lit(0.0) if newest else F.lit(float(sum(tops.values()))) - F.element_at(F.create_map(*(F.lit(x) for t, v in tops.items() for x in (t, float(v)))), F.col("term")) if tops else F.lit(0.0)
            able = blocks.withColumn("able", F.col("bound") + most)
            first = able.orderBy(F.desc("able"), "term", "seg", "lo").limit(FIRST_BLOCKS).collect()
            best = scored(first) if first else []
            least = best[-1]["score"] - (1.0 if newest else 2e-9) if len(best) == limit else float("-inf")
            # Terms that together stay under the threshold: a document with these alone is none.
            weak, total = [], 0.0
            for t in sorted(tops, key=tops.get) if not newest else ():
                total += tops[t]
                if total < least:
                    weak.append(t)
            more = able.filter((F.col("able") >= least) & ~F.col("term").isin(weak)) if weak else able.filter(F.col("able") >= least)
            chosen = more.select("seg", "part", "lo", "hi").limit(NAMED_BLOCKS + 1).collect()
            self.blocks_read[0] = len(chosen) if len(chosen) <= NAMED_BLOCKS else self.blocks_read[1]
            kept = scored(chosen) if chosen else []
        finally:
            blocks.unpersist()
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("at", pa.timestamp("us", "UTC"))])
        return self.spark.createDataFrame(pa.Table.from_pylist([{"doc_id": r["doc_id"], "score": r["score"], "at": r["time"]} for r in kept], schema))

    def search(self, terms: Sequence[str], subjects: Sequence[str], texts: DataFrame | None = None, limit: int = 20, rank: str = "bm25", linked: bool = False) -> DataFrame:
        """doc_id, tier, score, at of a query's best documents: by tier, BM25, time (newest first) and doc_id. linked: of those
        with links only, scored among all.

        Where a unit proves no match, documents are held against their texts, which are looked up by rank until there are
        ``limit`` that pass: few are read, and none is passed over, as all are looked at if these don't suffice. texts
        (doc_id, text: folded): for an index that keeps none. rank: by ``bm25``, by ``recency``, or by recency only where
        there are very many (``auto``).
        """
        asked = list(subjects or terms)[:MOST_UNITS]
        units, wanted = list(dict.fromkeys(units_of(terms))), units_of(asked)
        if not units or not wanted:
            return self.spark.createDataFrame([], "doc_id long, tier int, score double, at timestamp")
        every = list(dict.fromkeys([*units, *wanted]))
        rows = self.counted(every).persist()  # read several times
        if texts is None and not self.has_texts and not all(map(exact_term, asked)):
            raise ValueError("an index without texts needs them to check what it finds")
        try:
            dfs = list(rows.agg(*(F.count(f"t{k}") for k in range(len(every)))).first())
            found = self._tiers(self.scored(every, dfs, rows.filter("linked") if linked else rows), every, units, wanted)
            many = rank == "recency" or rank == "auto" and max(dfs) > RANK_CANDIDATES
            proved = [F.get("has", F.lit(every.index(unit_of(s)))) for s in asked if exact_term(s)]
            unproved = [s for s in asked if not exact_term(s)]
            # What candidates are ranked by: place is the score as it counts, 0 where time takes its place.
            place = F.lit(0.0) if many else F.round("score", 9)
            found = found.select("doc_id", "tier", "score", "at", place.alias("place"), F.unix_micros("at").alias("time"), reduce(lambda a, b: a | b, proved, F.lit(False)).alias("anyway"))
            kept = None
            if not unproved:
                kept = found.orderBy(*_order()).limit(limit).collect()
            elif texts is None:
                kept = self._checked(found, unproved, limit)
            if kept is None:
                held = self._live(self.forward.select("doc_id", "seg", "text")) if texts is None else texts
                kept = recheck(found, held, unproved).orderBy(*_order()).limit(limit).collect()
        finally:
            rows.unpersist()
        schema = pa.schema([("doc_id", pa.int64()), ("tier", pa.int32()), ("score", pa.float64()), ("at", pa.timestamp("us", "UTC"))])
        return self.spark.createDataFrame(pa.Table.from_pylist([{"doc_id": r["doc_id"], "tier": r["tier"], "score": r["score"], "at": r["time"]} for r in kept], schema))

    def _checked(self, found: DataFrame, unproved: Sequence[str], limit: int) -> list[dict] | None:
        """The first ``limit`` rows that hold, of candidates looked up by rank in growing numbers; null if CHECKED don't suffice."""
        n = max(200, 10 * limit)
        while n <= CHECKED:
            ranked = [r.asDict() for r in found.orderBy(*_order()).limit(n).collect()]  # n rows at most
            asked = [r["doc_id"] for r in ranked if r["tier"] < 3 or not r["anyway"]]
            with _by_name(self.spark):
                told = {r["doc_id"]: r for r in _flags(self._live(self._named(asked).select("doc_id", "seg", "text")), unproved).collect()} if asked else {}
            kept = []
            for r in ranked:
                has = told.get(r["doc_id"])
                tier = r["tier"] if r["tier"] == 3 and r["anyway"] or has and has["every"] and r["tier"] < 3 else 3 if has and (has["some"] or r["anyway"]) else None
                if tier:
                    kept.append(r | {"tier": tier})
            key = lambda r: (r["tier"], -r["place"], r["time"] is None, -(r["time"] or 0), -r["doc_id"])  # noqa: E731  as _order has it
            kept = sorted(kept, key=key)[:limit]
            # What wasn't looked at comes after all that was, as it was ranked.
            if len(ranked) < n or len(kept) == limit and key(kept[-1]) <= key(ranked[-1]):
                return kept
            n *= 4
        return None


def bytes_of(docs: DataFrame) -> int:
    """Bytes of all strings of some rows."""
    texts = [F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c, kind in docs.dtypes if kind == "string"]
    return docs.agg(F.sum(reduce(lambda a, b: a + b, texts, F.lit(0)))).first()[0] or 0


def _order() -> list[Column]:
    """The order of results."""
    return [F.col("tier"), F.desc("place"), F.desc_nulls_last("time"), F.desc("doc_id")]


def _flags(texts: DataFrame, unproved: Sequence[str]) -> DataFrame:
    """texts (doc_id, text) -> doc_id, every, some: whether all, or any, of the terms stand in the text."""
    plain = [F.contains("text", F.lit(s)) if s.isascii() else F.lit(True) for s in unproved]
    has = [p & F.col("text").rlike(T.term_regex(s)) for p, s in zip(plain, unproved)]
    return texts.select("doc_id", reduce(lambda a, b: a & b, has).alias("every"), reduce(lambda a, b: a | b, has).alias("some"))


def recheck(found: DataFrame, texts: DataFrame, unproved: Sequence[str]) -> DataFrame:
    """found (doc_id, tier, anyway: has a subject that needs no proof) as texts (doc_id, text) have the terms that no unit
    proves: of the first tiers if each stands in the text, of the last if any does, or a proved one."""
    sure = F.col("anyway") & (F.col("tier") == 3)
    told = F.when(F.col("every") & (F.col("tier") < 3), F.col("tier")).when(F.col("some") | F.col("anyway"), 3)
    joined = found.filter(~sure).join(_flags(texts, unproved), "doc_id").withColumn("tier", told).filter("tier is not null")
    return joined.select(*found.columns).unionByName(found.filter(sure))


def _single(u: Unit) -> bool:
    return not u.prefix and len(u.tokens) == 1


def _shelf(doc_id: Column, shelves: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(shelves)).cast("int")


def _shelves(rows: int, tokens: int) -> int:
    """How many shelves rows get whose tokens are shuffled and sorted with them, about as large as two files of postings."""
    return max(1, math.ceil(rows / SHELF_ROWS), math.ceil(tokens / (2 * FILE_TOKENS)))


def _part() -> Column:
    """The number of a row's file of postings."""
    return F.substring_index(F.substring(F.col("_metadata.file_name"), len("part-") + 1, 20), "-", 1).cast("int")


def _among(blocks: Sequence[tuple[int, int | None, int, int]]) -> Column:
    """Whether a document is one of some blocks' (seg, part, lo, hi), whose ranges are joined where they meet. Files without any
    aren't opened. part: null in an index whose files held ranges of terms, where a document's postings are in several."""
    joined: list[list] = []
    for seg, part, lo, hi in sorted(blocks, key=lambda b: (b[0], -1 if b[1] is None else b[1], b[2])):
        if joined and joined[-1][:2] == [seg, part] and lo <= joined[-1][3]:
            joined[-1][3] = max(joined[-1][3], hi)
        else:
            joined.append([seg, part, lo, hi])
    own = _any_of([f"seg = {seg} and doc_id between {lo} and {hi}" + (f" and part = {part}" if part is not None else "") for seg, part, lo, hi in joined])
    parts = {part for _, part, _, _ in joined}
    return F.expr(own if None in parts else f"part in ({', '.join(map(str, sorted(parts)))}) and ({own})")


def _any_of(tests: Sequence[str]) -> str:
    """A balanced tree of ORs."""
    half = len(tests) // 2
    return f"({_any_of(tests[:half])} or {_any_of(tests[half:])})" if half else tests[0]


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward rows -> a row for each of a document's terms, with its places in order; a batch's rows by term and document, so
    that a sort finds runs."""
    for batch in batches:
        tokens = batch.column("tokens")
        ends = np.concatenate(([0], np.cumsum(tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
        words = tokens.flatten().dictionary_encode()
        if not len(words):
            continue
        doc = np.repeat(np.arange(len(tokens)), np.diff(ends))
        place = np.empty(len(words.dictionary), np.int64)
        place[pc.sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))
        key = place[words.indices.to_numpy(zero_copy_only=False)] * len(tokens) + doc
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        rows = pa.array(doc[order[first]])
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array((order - ends[doc[order]]).astype(np.int32)))
        term = words.dictionary.take(words.indices.take(pa.array(order[first])))
        tf = pa.array(np.diff(np.append(first, len(key))).astype(np.int32))
        columns = {"term": term, "doc_id": batch.column("doc_id").take(rows), "tf": tf, **{c: batch.column(c).take(rows) for c in ("dl", "at", "linked")}, "positions": places}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings as files hold them -> a row for every ``size`` of a term's, or fewer, where a batch ends."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            term, at = batch.column("term"), batch.column("at")
            part, doc, tf, dl = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "doc_id", "tf", "dl"))
            word = term.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            fresh = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (part[1:] != part[:-1]))))
            within = np.arange(len(doc)) - np.repeat(fresh, np.diff(np.append(fresh, len(doc))))
            first = np.flatnonzero(within % size == 0)
            last, rows = np.append(first[1:], len(doc)) - 1, pa.array(first)
            never = np.iinfo(np.int64).min
            newest = np.maximum.reduceat(at.cast(pa.int64()).fill_null(never).to_numpy(zero_copy_only=False), first)
            columns = {"term": term.take(rows), "part": part[first], "lo": doc[first], "hi": doc[last], "n": last - first + 1, "cf": np.add.reduceat(tf.astype(np.int64), first)}
            columns |= {"tf": np.maximum.reduceat(tf, first), "dl": np.minimum.reduceat(dl, first), "newest": pa.array(newest, mask=newest == never).cast(at.type)}
            yield pa.RecordBatch.from_pydict(columns)

    return made


def _by_name(spark: SparkSession):
    """Filters on up to LOOKED_UP ids are pushed to the pages one by one, not as a range."""
    return _setting(spark, IN_THRESHOLD, str(CHECKED))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)
