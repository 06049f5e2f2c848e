"""Phrase collocation mining by hierarchical pair naming.

Texts become chunks: arrays of word ids with 0 between pieces. A level counts the pairs of neighbours, names those that
are frequent, and replaces each pair by its name and all others by 0; two neighbouring names of k words overlap in all
but one word and so are a phrase of k + 1. A phrase longer than a frequent one is counted only where both of its parts
are frequent, which loses nothing, as a phrase occurs no more often than its parts. The pair (left, right) of a name
points to its parents: the phrase without its last and without its first word. Along them go the counts of all its
beginnings and ends, which is what cuts need, and back along them the counts of longer phrases, which is what
subsumption needs.

A chunk is some megabytes of text. Names get to chunks by a broadcast where their number is under a bound that is
checked; beyond it, each chunk asks for its distinct pairs by a join and gets the answers in one array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SMALL_ROWS, discard, materialise, numbered, scratch_dir, slices, text_bytes, tokenised

#: Bytes that end a piece, and those that end a word only.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False
#: Bytes of text in a chunk (more only where no piece ends), names that are broadcast at most, and bytes of words among them.
CHUNK, BROADCAST_NAMES, BROADCAST_BYTES = 4 << 20, 2_000_000, 48 << 20
CHUNKS = "chunk string, ids binary, vocabulary array<struct<lang:string,word:string,n:bigint>>"
#: Chunks of a file, which a task may decode at once. On a local disk, Hadoop starts several processes for each file, which for
#: a moment count with all of an executor's memory, so files shouldn't be many.
FILE_CHUNKS = 8
RENAMED = pa.schema([("chunk", pa.string()), ("ids", pa.binary())])


def _words(body: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of words from 1 with 0 between pieces and texts, and the distinct words. heads: where texts begin."""
    starts, ends, encoded = tokenised(body, heads, WORD, LOWER)
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.large_string())
    stop = np.zeros(len(body) + 1, np.int64)
    np.cumsum(ENDS[body], out=stop[1:])
    breaks = np.searchsorted(heads, starts, side="right")
    fresh = np.concatenate(([False], (stop[starts[1:]] != stop[ends[:-1]]) | (breaks[1:] != breaks[:-1])))
    codes = np.zeros(len(starts) + int(fresh.sum()), np.int32)
    codes[np.arange(len(starts)) + np.cumsum(fresh)] = encoded.indices.to_numpy() + 1
    return codes, encoded.dictionary


def _chunked(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            langs = batch.column("lang")
            for lang in pc.unique(langs).to_pylist():
                body, offsets = text_bytes(batch.column("text").filter(pc.equal(langs, lang)))
                points = offsets
                long = np.flatnonzero(np.diff(offsets) > size)
                if len(long):  # texts longer than a chunk may be cut where a piece ends
                    points = np.unique(np.concatenate([offsets, *(offsets[i] + np.flatnonzero(ENDS[body[offsets[i] : offsets[i + 1]]]) for i in long)]))
                for i, j in slices(points, size):
                    codes, words = _words(body[points[i] : points[j]], points[i:j] - points[i])
                    if not len(words):
                        continue
                    n = np.bincount(codes, minlength=len(words) + 1)[1:]
                    rows = pa.StructArray.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(words)), words.cast(pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])
                    vocabulary = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), rows)
                    yield pa.RecordBatch.from_arrays([pa.array([f"{task}.{k}"]), pa.array([codes.tobytes()], pa.binary()), vocabulary], ["chunk", "ids", "vocabulary"])
                    k += 1

    return run


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of ids: where pairs of neighbours begin, the distinct pairs (left, right) in order, and which of them each is."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    known, codes = np.unique(ids, return_inverse=True)  # what is in a chunk is numbered, so two numbers fit one
    distinct, which = np.unique(codes[at].astype(np.int64) * len(known) + codes[at + 1], return_inverse=True)
    return at, known[distinct // len(known)], known[distinct % len(known)], which


def _asked(kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("ids")):
            _, left, right, which = _pairs(np.frombuffer(raw.as_buffer(), kind))
            n = np.bincount(which, minlength=len(left))
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(chunk), len(left)), pa.array(np.arange(len(left)), pa.int32()), pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(n, pa.int64())],
                ["chunk", "j", "l", "r", "n"],
            )


def _replaced(ids: np.ndarray, names: Callable, words: bool) -> np.ndarray:
    """The next level's ids: names (0: not frequent) in place of codes of words, or of pairs; one 0 for several."""
    if words:
        out = np.concatenate(([0], names(None, None)))[ids]
    else:
        at, left, right, which = _pairs(ids)
        out = np.zeros(max(0, len(ids) - 1), np.int64)
        out[at] = names(left, right)[which]
    return out[(out > 0) | np.concatenate(([False], out[:-1] > 0))]


def _renamed(kind: str, to: str, names: Callable, words: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """names(row) answers for a chunk. Chunks with no pair of names left go."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            out = _replaced(np.frombuffer(row.column("ids")[0].as_buffer(), kind), partial(names, row), words)
            if len(out) > 1:
                yield pa.RecordBatch.from_arrays([row.column("chunk"), pa.array([out.astype(to).tobytes()], pa.binary())], ["chunk", "ids"])


def _known_words(sent, row: pa.RecordBatch, _left, _right) -> np.ndarray:
    """Ids of a chunk's words by broadcast names: by language, its words in order and the number of those before."""
    vocabulary = row.column("vocabulary").flatten()
    langs, words = pc.struct_field(vocabulary, "lang"), pc.struct_field(vocabulary, "word")
    own, before = sent.value.get(langs[0].as_py(), (pa.array([], pa.string()), 0))
    at = pc.index_in(words.cast(pa.string()), own)
    return pc.fill_null(pc.add(at.cast(pa.int64()), before + 1), 0).to_numpy()


def _known_pairs(sent, row: pa.RecordBatch, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of pairs by broadcast names, which are numbered in their own order."""
    width, keys = sent.value
    asked = left.astype(np.int64) * width + right
    at = np.searchsorted(keys, asked)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == asked, at + 1, 0)


def _answered(kind: str, to: str, words: bool, found: pa.Table, chunk: pa.Table) -> pa.Table:
    """A chunk renamed by the answers that a join has brought (j: the place of what was asked for, id)."""

    def names(row: pa.RecordBatch, left: np.ndarray | None, _right) -> np.ndarray:
        out = np.zeros(len(row.column("vocabulary").flatten()) if left is None else len(left), np.int64)
        out[found["j"].to_numpy()] = found["id"].to_numpy()
        return out

    rows = chunk.to_batches() if found.num_rows else []  # without a name nothing is left of a chunk
    return pa.Table.from_batches(_renamed(kind, to, names, words, iter(rows)), RENAMED)


class Miner:
    """The levels of one corpus. most_names: how many names are broadcast at most."""

    def __init__(self, docs: DataFrame, least: int, chunk: int = CHUNK, most_names: int = BROADCAST_NAMES):
        self.spark, self.least, self.most_names, self.folder = docs.sparkSession, least, most_names, scratch_dir(docs.sparkSession)
        rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        self.chunks, self.kind = materialise(rows.mapInArrow(_chunked(chunk), CHUNKS), "chunks0", self.folder, "zstd", FILE_CHUNKS), "int32"
        asked = self.chunks.select("chunk", F.posexplode("vocabulary").alias("j", "w")).select("chunk", "j", "w.*")
        self.totals = materialise(asked.groupBy("lang").agg(F.sum("n").alias("n")), "totals", self.folder)
        self.level, self.width = 0, 0
        self.names = self._next(asked, ["lang", "word"])

    def _next(self, asked: DataFrame, keys: list[str]) -> DataFrame:
        """The next level's names (id from 1, keys, f), and its chunks."""
        self.level += 1
        counted = asked.groupBy(*keys).agg(F.sum("n").alias("f")).filter(F.col("f") >= self.least)
        counted = materialise(counted, f"counted{self.level}", self.folder)
        names = numbered(counted, [], keys, f"id{self.level}", self.folder).withColumnRenamed(f"id{self.level}", "id").withColumn("id", F.col("id") + 1)
        names = materialise(names, f"names{self.level}", self.folder)
        size = names.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(F.octet_length(F.col(k)) for k in keys)) if self.level == 1 else F.lit(0), F.lit(0))).first()
        self.n, to = size[0], "int32" if size[0] < 1 << 31 else "int64"
        if not self.n:
            return names
        words = self.level == 1
        if self.n <= self.most_names and size[1] <= BROADCAST_BYTES:
            known = names.select("id", *keys).toArrow().sort_by("id")
            if words:
                langs = known.column("lang").combine_chunks()
                sent = {x: (known.filter(pc.equal(langs, x)).column("word").combine_chunks(), pc.index(langs, x).as_py()) for x in pc.unique(langs).to_pylist()}
            else:
                sent = (self.width, known.column("l").to_numpy() * self.width + known.column("r").to_numpy())
            answer = partial(_known_words if words else _known_pairs, self.spark.sparkContext.broadcast(sent))
            chunks = self.chunks.mapInArrow(partial(_renamed, self.kind, to, answer, words), "chunk string, ids binary")
        else:  # a task has one chunk's answers at a time: lists of them, made by an aggregation, would be those of many
            found = asked.select(F.col("chunk").alias("of"), "j", *keys).join(names.drop("f"), keys).select("of", "j", "id")
            chunks = found.groupBy("of").cogroup(self.chunks.groupBy("chunk")).applyInArrow(partial(_answered, self.kind, to, words), "chunk string, ids binary")
        self.chunks = materialise(chunks, f"chunks{self.level}", self.folder, "zstd", FILE_CHUNKS)
        discard(self.spark, f"{self.folder}/chunks{self.level - 1}")  # nothing is made of these any more
        self.kind, self.width = to, self.n + 1
        return names

    def longer(self) -> DataFrame:
        """Names of one word more: id, l, r, f."""
        asked = self.chunks.mapInArrow(partial(_asked, self.kind), "chunk string, j int, l long, r long, n long")
        return self._next(asked, ["l", "r"])


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, **options: int) -> tuple[DataFrame, list[DataFrame]]:
    """Totals (lang, n), and by number of words the frequent phrases: id, l, r, lang, phrase, last (its last word), f, heads
    and tails (counts of its beginnings and ends, by their numbers of words)."""
    miner = Miner(docs, least, **options)
    own = F.array("f")
    out = [miner.names.select("id", F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("r"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", own.alias("heads"), own.alias("tails"))]
    while len(out) < longest and miner.n:
        names, known = miner.longer(), out[-1]
        left = known.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("head"), F.col("heads").alias("before"))
        right = known.select(F.col("id").alias("r"), "last", F.col("tails").alias("after"))
        rows = names.join(left, "l").join(right, "r")
        rows = rows.select("id", "l", "r", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", F.concat("before", own).alias("heads"), F.concat("after", own).alias("tails"))
        out.append(materialise(rows, f"phrases{len(out) + 1}", miner.folder))
    return miner.totals, out


#: The score of a cut after k words, in numbers of up to 38 digits, which div gives whole and exactly.
CUTS = """transform(sequence(1, size(heads) - 1), k -> named_struct(
'score', (cast(1000 as decimal(4, 0)) * cast(f as decimal(16, 0)) * cast(n as decimal(18, 0))) div (cast(heads[k - 1] as decimal(16, 0)) * cast(tails[size(heads) - k - 1] as decimal(16, 0))),
'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k - 1]))"""


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, **options: int) -> DataFrame:
    """docs (lang, text) -> lang, rank, phrase, a, l, r, n, score: each lang's first ``top`` by score, a and phrase.

    Null texts count as empty, null langs as ``und``; every row counts, rows that repeat too. A lang without a candidate,
    and an empty table, give no rows; other columns are ignored, whatever their names. Ties of cuts go to the smaller first
    part, ties of score and a to the smaller phrase in UTF-8. It is enough to look one word up for a longer phrase that
    subsumes: what lies between two phrases is no rarer than the longer one.
    """
    totals, levels = phrases(docs, least, longest, **options)
    kept = []
    for k, rows in enumerate(levels[1:] or [levels[0].limit(0)], 2):
        if k < len(levels):
            above = levels[k].select(F.col("l").alias("id"), "f").unionByName(levels[k].select(F.col("r").alias("id"), "f"))
            rows = rows.join(above.groupBy("id").agg(F.max("f").alias("above")), "id", "left")
            rows = rows.filter(F.col("above").isNull() | (F.col("above") * 100 < F.col("f") * percent)).drop("above")
        kept.append(rows.select("lang", "phrase", "f", "heads", "tails"))
    folder = scratch_dir(docs.sparkSession)
    rows = kept[0]
    for other in kept[1:]:
        rows = rows.unionByName(other)
    rows = rows.join(F.broadcast(totals) if totals.count() <= SMALL_ROWS else totals, "lang").withColumn("cut", F.array_min(F.expr(CUTS)))
    rows = materialise(rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score"), "candidates", folder)
    ranked = numbered(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank", folder).withColumn("rank", F.col("rank") + 1)
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
