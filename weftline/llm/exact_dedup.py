"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its UTF-8 bytes as the digits of a number, modulo two primes: H(xy) = H(x) * B^|y| + H(y).
So chunks are hashed on their own, in one vectorised pass, and combined by length-shifted arithmetic; the segments of a
huge text are even hashed by different tasks. Rows with equal fingerprints then undergo a chunkwise comparison with the
row that stays, as a join on chunk numbers, so a collision is found and its rows are grouped anew: the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import give_back, hot_join, materialise, scratch_dir, slices, text_bytes

#: Two primes under 2^31, and the base of the polynomial.
PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
#: Bytes of a chunk of the vectorised pass.
CHUNK = 4096
#: Members of a group that one salt takes.
SALT_ROWS = 128


def _power_table(prime: int, step: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for k in range(1, n):
        out[k] = int(out[k - 1]) * step % prime
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(prime: int, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """B^k for k up to a chunk, and B^(CHUNK * m) for m up to chunks."""
    if prime not in _TABLES or len(_TABLES[prime][1]) < chunks + 1:
        _TABLES[prime] = (_power_table(prime, BASE, CHUNK + 1), _power_table(prime, pow(BASE, CHUNK, prime), max(64, 2 * chunks)))
    return _TABLES[prime]


def fingerprints(body: np.ndarray, offsets: np.ndarray, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's H modulo prime, and B^length modulo prime, by which what stands before it is shifted."""
    lengths = np.diff(offsets)
    chunks = (lengths + CHUNK - 1) // CHUNK
    small, large = _powers(prime, int(chunks.max(initial=0)))
    shift = small[lengths % CHUNK] * large[lengths // CHUNK] % prime
    out = np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths)
    if len(full) == 0:
        return out, shift
    doc = np.repeat(full, chunks[full])
    number = np.arange(len(doc)) - np.repeat(np.cumsum(chunks[full]) - chunks[full], chunks[full])
    starts = offsets[doc] + number * CHUNK
    ends = np.minimum(starts + CHUNK, offsets[doc + 1])
    digit = np.repeat(ends, ends - starts) - 1 - np.arange(len(body))
    values = np.add.reduceat((body.astype(np.int64) + 1) * small[digit], starts) % prime
    after = offsets[doc + 1] - ends
    values = values * (small[after % CHUNK] * large[after // CHUNK] % prime) % prime
    first = np.flatnonzero(number == 0)
    out[full] = np.add.reduceat(values, first) % prime
    return out, shift


def combine(left: int, right: int, right_shift: int, prime: int) -> int:
    """H(xy) of H(x), H(y) and B^|y|."""
    return (left * right_shift + right) % prime


def _hashed(primes: tuple[int, int]):
    def run(batches):
        give_back()
        for batch in batches:
            body, offsets = text_bytes(batch.column("text"))
            parts = []
            for i, j in slices(offsets):
                o = offsets[i : j + 1]
                parts.append([x for p in primes for x in fingerprints(body[o[0] : o[-1]], o - o[0], p)])
            h1, s1, h2, s2 = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts) if parts else [()] * 4))
            keep = [k for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), *map(pa.array, (h1, s1, h2, s2))],
                names=[*(batch.schema.names[k] for k in keep), "h1", "s1", "h2", "s2"],
            )

    return run


def _segments(text: Column, size: int) -> Column:
    """The text cut after every ``size`` characters; an empty text is one empty segment."""
    last = F.greatest(F.ceil(F.length(text) / F.lit(size)).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * size + 1, F.lit(size)))


def fingerprint_table(docs: DataFrame, segment: int = 1 << 20, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """(doc_id, n_bytes, text_sha256, h1, h2) of every row. Texts of over ``segment`` bytes are hashed by segments in many tasks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "text")
    add = "h1 long, s1 long, h2 long, s2 long"
    short = rows.filter(F.col("n_bytes") <= segment).mapInArrow(_hashed(primes), f"doc_id long, n_bytes long, text_sha256 string, {add}")
    long = (
        rows.filter(F.col("n_bytes") > segment)
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "n_bytes", "text_sha256", "row", F.posexplode(_segments(F.col("text"), segment)).alias("k", "text"))
        .repartition("row", "k")
        .mapInArrow(_hashed(primes), f"doc_id long, n_bytes long, text_sha256 string, row long, k int, {add}")
    )

    def folded(h: str, s: str, prime: int) -> Column:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("k", h, s))), lambda x: F.struct(x[h].alias("h"), x[s].alias("s")))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: (a * x["s"] + x["h"]) % prime).alias(h)

    long = long.groupBy("row", "doc_id", "n_bytes", "text_sha256").agg(folded("h1", "s1", primes[0]), folded("h2", "s2", primes[1]))
    names = ["doc_id", "n_bytes", "text_sha256", "h1", "h2"]
    return short.select(*names).unionByName(long.select(*names))


def exact_dedup(docs: DataFrame, segment: int = 1 << 20, primes: tuple[int, int] = PRIMES, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, null counting as empty. The largest doc_id of a group stays (null ids are the
    smallest); of rows that repeat both text and doc_id one is kept. An empty table gives an empty result; other columns
    are ignored, whatever their names. broadcast_rows: the ids of up to so many candidate rows, 32 MB, are broadcast to
    find their texts; beyond it all texts are shuffled.
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession)
    prints = materialise(fingerprint_table(docs, segment, primes).withColumn("class", F.lit(0)), "prints", folder)
    key = ["n_bytes", "h1", "h2", "class"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    settled, todo, level = None, prints, 0
    while True:
        groups = todo.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max_by("text_sha256", F.struct("doc_id", "text_sha256")).alias("keep_sha"))
        rows = hot_join(todo, materialise(groups, f"groups{level}", folder), key, "group_size")
        wrong = _differing(rows.filter("group_size > 1"), texts, segment, key, broadcast_rows, folder, level)
        if wrong is None:
            done = rows
            break
        # A collision: rows that differ from the one that stays form groups of their own, among each other.
        marked = materialise(todo.join(wrong.withColumn("differs", F.lit(True)), [*key, "doc_id", "text_sha256"], "left"), f"marked{level}", folder)
        same = marked.filter("differs is null").drop("differs")
        todo, level = materialise(marked.filter("differs").drop("differs").withColumn("class", F.lit(level + 1)), f"todo{level}", folder), level + 1
        sized = same.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("text_sha256").alias("keep_sha"))
        part = hot_join(same, materialise(sized, f"sized{level}", folder), key, "group_size")
        settled = part if settled is None else settled.unionByName(part)
    out = done if settled is None else settled.unionByName(done)
    out = out.select("doc_id", "keep_id", "group_size", "text_sha256")
    top = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    one = Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(1))
    kept = out.filter(top).withColumn("kept", F.row_number().over(one) == 1)
    return kept.unionByName(out.filter(~top).withColumn("kept", F.lit(False))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _differing(members: DataFrame, texts: DataFrame, segment: int, key: list[str], broadcast_rows: int, folder: str, level: int) -> DataFrame | None:
    """The (key, doc_id, text_sha256) of members whose text differs from that of the row that stays, or None if there are none.

    Both texts are compared chunk by chunk, as rows of a join; a large group's members are dealt over salts, each of which
    has a copy of the chunks of the row that stays.
    """
    members = materialise(members, f"members{level}", folder)
    found = members.select("doc_id", "text_sha256", *key, "keep_id", "keep_sha", F.ceil(F.col("group_size") / SALT_ROWS).cast("int").alias("salts")).distinct()
    found = materialise(found, f"candidates{level}", folder)
    if found.isEmpty():
        return None
    if found.count() <= broadcast_rows:  # only candidates' texts are shuffled
        ids = F.broadcast(found.filter("doc_id is not null").select("doc_id").distinct())
        texts = texts.join(ids, "doc_id", "left_semi").unionByName(texts.filter("doc_id is null"))
    texts = texts.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), "text")
    own = texts.join(found.hint("merge"), texts["id"].eqNullSafe(found["doc_id"]) & (texts["sha"] == found["text_sha256"])).drop("id", "sha")
    chunks = own.select("*", F.posexplode(_segments(F.col("text"), segment)).alias("k", "chunk")).drop("text")
    theirs = (
        chunks.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("text_sha256") == F.col("keep_sha")))
        .select(*key, "k", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("chunk").alias("kept_chunk"))
        .dropDuplicates([*key, "k", "salt"])
    )
    mine = chunks.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.col("salts")).cast("int"))
    verdict = (
        mine.join(theirs, [*key, "k", "salt"], "left")
        .groupBy(*key, "doc_id", "text_sha256")
        .agg(F.bool_and(F.coalesce(F.col("chunk") == F.col("kept_chunk"), F.lit(False))).alias("same"))
    )
    wrong = materialise(verdict.filter("not same").drop("same"), f"wrong{level}", folder)
    return None if wrong.isEmpty() else wrong
