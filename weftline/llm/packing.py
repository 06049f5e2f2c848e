"""Best-fit packing, certified by bounds.

Documents are dealt over partitions; each packs its own by best-fit decreasing and compares its number of bins with
lower bounds from dual-feasible functions. A partition that meets its bound is done, but for its emptiest bin. What has
a gap gives up the bins that waste most; their documents are exchanged between partitions and packed anew, in fewer
partitions each round, until one partition has packed what is left or an exchange leaves as many documents open as it got.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, materialise, scratch_dir
from .tokens import OPEN, piece_tokenizer

#: Rows that one task packs, and pieces of text that the tokenizer's caches keep: packing may follow stages that hold memory.
TASK_ROWS, KEPT_PIECES = 100_000, 150_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The ids of every text and end_id, cut into pieces of capacity only where they are more: one row per piece.

    A null or empty text is the one piece (end_id). Every row counts, null and repeated doc_ids too; an empty table gives
    an empty result. Other columns are ignored, whatever their names. A text of any length stays within one task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(OPEN)
        tokenizer, end = piece_tokenizer(vocabulary, KEPT_PIECES), np.array([end_id], np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some, rows = batch.slice(i, 256), []
                for doc, got in zip(some.column("doc_id").to_pylist(), tokenizer.ids(some.column("text").to_pylist())):
                    ids = np.concatenate((got, end)).astype("<u4")
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        cut = ids[a : a + capacity]
                        rows.append((doc, k, a, len(cut), zlib.crc32(cut.tobytes())))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[s] items have size s. The best of a family of dual-feasible functions.

    The identity; f_e: sizes above capacity - e count as full and those under e as nothing; and u_k: s (k + 1) / capacity
    rounded down to k-ths, but whole multiples kept.
    """
    sizes = np.arange(len(counts))
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    many, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    for e in np.flatnonzero(counts[: capacity // 2 + 1]):
        big = int(many[-1] - many[capacity - e])
        mid = int(mass[capacity - e] - (mass[e - 1] if e else 0))
        best = max(best, big + -(-mid // capacity))
    for k in range(1, 33):
        scaled = sizes * (k + 1)
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)  # in units of capacity * k
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """lengths, descending -> bin and offset of each, and the number of bins. Each goes where least room is left over."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has room r
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, size in enumerate(lengths.tolist()):
        fits = open_ >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - r
        left = r - size
        if left:
            room[left].append(b)
            open_ |= 1 << left
    return bins, offsets, n


#: Bits of a sequence's number: its place in its task, the task, and above both the round; full pieces have a bit above all rounds.
PLACE_BITS, TASK_BITS, FULL = 28, 20, 1 << 62


def sequence_base(round_: int, task: int) -> int:
    if task >> TASK_BITS or round_ >= FULL >> (PLACE_BITS + TASK_BITS):
        raise ValueError(f"round {round_}, task {task}: more than sequences are numbered for")
    return (round_ << (PLACE_BITS + TASK_BITS)) + (task << PLACE_BITS)


def _pack_task(capacity: int, round_: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = list(batches)  # TASK_ROWS at most, but for chance
        if not frames:
            return
        rows = pd.concat(frames).sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        lengths = rows["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        gap = n - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n)
        if last:
            open_ = np.zeros(n, bool)
        elif gap == 0:
            open_ = np.arange(n) == int(fill.argmin())
        else:  # the bins that waste most, enough of them to hold the gap many times over
            open_ = np.zeros(n, bool)
            open_[np.argsort(fill, kind="stable")[: max(1, min(n, 16 * gap))]] = True
        yield rows.assign(sequence_id=sequence_base(round_, TaskContext.get().partitionId()) + bins, offset=offsets, gap=gap, open=open_[bins])

    return run


def pack(rows: DataFrame, capacity: int = 2048, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows with PIECES' columns -> the same with sequence_id, offset and gap. A piece of full length is a sequence of its own.

    gap: by how many sequences the partition that packed a piece is above its lower bound, 0 where it is proved to be as
    good as any packing of the same pieces. Rows are dealt out evenly, whatever repeats in them; ties of length go by
    doc_id and piece. Other columns of rows are ignored. An empty table gives an empty result.
    """
    folder = scratch_dir(rows.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = materialise(rows.select(*names), "pieces", folder)
    zero = F.lit(0).cast("long")
    out = rows.filter(F.col("length") == capacity).select(*names, (F.lit(FULL) + F.monotonically_increasing_id()).alias("sequence_id"), zero.alias("offset"), zero.alias("gap"))
    todo, round_, before = rows.filter(F.col("length") < capacity), 0, None
    while True:
        n = todo.count()
        tasks = -(-n // task_rows)
        if tasks == 0:
            return out
        last = tasks == 1 or n == before
        before = n
        dealt = todo.repartition(tasks) if tasks > 1 else todo.coalesce(1)
        packed = materialise(dealt.mapInPandas(_pack_task(capacity, round_, last), PIECES + ", sequence_id long, offset long, gap long, open boolean"), f"round{round_}", folder)
        out = out.unionByName(packed.filter("not open").select(*names, "sequence_id", "offset", "gap"))
        if last:
            return out
        todo, round_ = packed.filter("open").select(*names), round_ + 1


def global_bound(rows: DataFrame, capacity: int = 2048) -> int:
    """The lower bound on the sequences of all rows, from their histogram of lengths (capacity rows at most)."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return lower_bound(counts, capacity)
