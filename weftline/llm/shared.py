"""Helpers that several operators share: scratch tables, batching, vectorised text kernels."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Odd 64-bit constants of the word and shingle hashes.
WORD_BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHINGLE_BASE = np.uint64(0xD1342543DE82EF95)

_POWERS: dict[str, np.ndarray] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see.

    It lies in ``spark.checkpoint.dir``; where that is unset (a single machine), in a local temporary folder.
    """
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "weftline-scratch")
        os.makedirs(base[len("file://") :], exist_ok=True)
    return f"{base.rstrip('/')}/weftline-{uuid.uuid4().hex}"


#: Bytes of a batch of rows that Python workers get at most (a row more, where one alone has more).
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it (on a cluster: the same path, or --py-files), and
    bound the batches that they get by bytes: rows are texts of any length."""
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not size.rstrip("b").isdigit() or int(size.rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, known)))


#: Whether what a query has shuffled goes when it is done; else it stays until the driver collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, tag: str, folder: str | None = None, compression: str | None = None, file_rows: int = 0) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage and survives lost executors. What was
    shuffled for it goes at once. file_rows: rows of a file at most, for rows of megabytes, of which a reader takes a file's
    first 4,096 at once."""
    spark = df.sparkSession
    path = f"{folder or scratch_dir(spark)}/{tag}"
    before = spark.conf.get(CLEANED)
    spark.conf.set(CLEANED, "true")
    try:
        options = ({"compression": compression} if compression else {}) | ({"maxRecordsPerFile": file_rows} if file_rows else {})
        df.write.mode("overwrite").options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing is made of any more, to bound what lies there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: What operators keep in a Python worker between tasks: tokenizers with their caches, for one.
KEPT_IN_WORKER: list[dict] = []


def give_back(but: dict | None = None) -> None:
    """Let a Python worker give back what earlier stages keep there, ``but`` what its own does, or left in its allocators: workers
    serve one stage after another, and what they hold counts with the executor's memory."""
    for kept in KEPT_IN_WORKER:
        if kept is not but:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


#: Groups that ``hot_join`` broadcasts at most because they are large, and rows of small tables that are broadcast whole.
HOT_GROUPS, SMALL_ROWS = 20_000, 100_000


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, most: int = HOT_GROUPS, small: int = SMALL_ROWS) -> DataFrame:
    """rows joined with their groups, one row per key, of which ``size`` counts the rows; groups should be a stored table.

    A few groups are broadcast. Of many, those of over 1 / most of all rows (and over 256), of which there can't be more
    than ``most`` whatever the size of the table, are broadcast to their rows; only the rest is shuffled by key, so no
    task gets a large group. Groups are rows of a few numbers, or a digest.
    """
    total, largest, n = groups.agg(F.sum(size), F.max(size), F.count(F.lit(1))).first()
    if n <= small:
        return rows.join(F.broadcast(groups), keys)
    large = max(256, -(-total // most))
    if largest <= large:
        return rows.join(groups, keys)
    known = F.broadcast(groups.filter(F.col(size) > large))
    others = rows.join(F.broadcast(groups.filter(F.col(size) > large).select(*keys)), keys, "left_anti")
    return rows.join(known, keys).unionByName(others.join(groups.filter(F.col(size) <= large), keys))


def numbered(rows: DataFrame, within: list[str], order: list[Column | str], name: str, folder: str) -> DataFrame:
    """rows, a stored table, with a gapless number from 0 within each group of ``within`` (no nulls there), by ``order``.

    Rows are sorted over tasks by ranges, written, and numbered by their places in the files, so no task needs a whole
    group: a window would. Equal rows are dealt over tasks as well; what they share in ``order`` is numbered in any order.
    Numbers of rows by file and group, of which there are no more than files and groups together, are added up.
    """
    spark = rows.sparkSession
    salt, part, at, first, n, before = (f"\x00{name} {x}" for x in ("salt", "part", "at", "first", "n", "before"))
    keys = [*within, *order]
    placed = rows.withColumn(salt, F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *keys, salt)
    placed = placed.sortWithinPartitions(*keys, salt).drop(salt).withColumn(part, F.spark_partition_id())
    path = f"{folder}/{name}"
    placed.write.mode("overwrite").option("maxRecordsPerFile", 0).parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path).select("*", F.col("_metadata.row_index").alias(at))
    runs = stored.groupBy(*within, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    runs = runs.withColumn(before, F.coalesce(F.sum(n).over(Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = materialise(runs.select(*within, part, (F.col(before) - F.col(first)).alias(before)), f"{name} runs", folder)
    small = runs.count() <= SMALL_ROWS
    return stored.join(F.broadcast(runs) if small else runs, [*within, part]).withColumn(name, F.col(at) + F.col(before)).drop(part, at, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(column: str | Column) -> Column:
    """crc32 of the id as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- vectorised kernels over Arrow string columns --------------------------------------------------


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its values. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8, int(ends[-1])) if data is not None and ends[-1] else np.zeros(0, np.uint8)
    return body[ends[0] :], ends - ends[0]


def slices(offsets: np.ndarray, most: int = 1 << 18):
    """Split documents into runs of at most ``most`` bytes (one document at least): yields (first, last + 1)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        inverse = pow(WORD_BASE, -1, 1 << 64)
        for name, base in (("up", WORD_BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


#: Bytes with A-Z lower-cased, and the white space of the word pattern [^\x20\x09-\x0D]+.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased; and each text's first word."""
    n = len(body)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[body]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | head[:-1]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | head[1:])) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[body].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def tokenised(body: np.ndarray, heads: np.ndarray, inside: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """Runs of bytes that are ``inside``, none across a head: where they start and end, and what they are, lower-cased.

    inside and lower are by byte; runs are cut at ASCII bytes, so each is a string. heads: where texts begin.
    """
    within = inside[body]
    head = np.zeros(len(body) + 1, bool)
    head[heads] = True
    before, after = np.concatenate(([False], within[:-1])), np.concatenate((within[1:], [False]))
    starts = np.flatnonzero(within & (~before | head[:-1]))
    ends = np.flatnonzero(within & (~after | head[1:])) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    data = lower[body[within]]
    runs = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return starts, ends, runs.dictionary_encode()


def shingle_sets(words: np.ndarray, n: int) -> np.ndarray:
    """Ascending distinct hashes of the n-word shingles of one text; with fewer words, of the whole sequence as one."""
    if len(words) == 0:
        return words
    width = min(n, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h = (h + words[k : len(words) - width + 1 + k]) * SHINGLE_BASE
        h ^= h >> np.uint64(29)
    return np.unique(mix64(h + np.uint64(width)))
