"""Token ids in files of directly addressable codes.

An id is cut into chunks of 8 bits, the lowest first. Level k holds chunk k of every id that has one, and a bitmap that
says which go on; the rank of a set bit is the place in the next level. A rank directory (set bits before every 512th)
makes that a look-up, so any id, or any run of ids, is read without decoding what stands before it.

File: ``DAC1``, then little-endian: documents, ids and levels (3 uint64); doc ids (int64), starts of documents and
their end (uint64); for each level its number of chunks (uint64), the chunks, the bitmap and the directory (uint64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, scratch_dir, shuffle_partitions
from .tokens import piece_tokenizer

MAGIC = b"DAC1"
RANK_BITS = 512
#: Ids of a file; a task that has more writes several.
FILE_IDS = 8_000_000


class Level:
    def __init__(self, chunks: np.ndarray, more: np.ndarray):
        self.chunks, self.bitmap = chunks, np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more.astype(np.uint64), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint64)
        self.directory = np.concatenate((np.zeros(1, np.uint64), np.cumsum(ones, dtype=np.uint64)))


def encode(ids: np.ndarray) -> list[Level]:
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        levels.append(Level((rest & 255).astype(np.uint8), more))
        if not more.any():
            return levels
        rest = rest[more] >> np.uint32(8)


def to_bytes(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    levels = encode(ids)
    parts = [MAGIC, struct.pack("<3Q", len(doc_ids), len(ids), len(levels)), doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for x in levels:
        parts += [struct.pack("<Q", len(x.chunks)), x.chunks.tobytes(), x.bitmap.tobytes(), x.directory.astype("<u8").tobytes()]
    return b"".join(parts)


class TokenFile:
    """Random access to a file through ``read(offset, size)``: only the header and the document table are read at first."""

    def __init__(self, read):
        self._read = read
        head = read(0, 28)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, n_levels = struct.unpack("<3Q", head[4:])
        at = 28
        self.doc_ids = np.frombuffer(read(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        self.starts = np.frombuffer(read(at, 8 * (self.n_docs + 1)), "<u8").astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self._levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack("<Q", read(at, 8))
            bitmap = at + 8 + n
            directory = bitmap + (n + 7) // 8
            self._levels.append((n, at + 8, bitmap, directory))
            at = directory + 8 * ((n + RANK_BITS - 1) // RANK_BITS + 1)

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        raw = np.frombuffer(self._read(self._levels[level][2] + a // 8, (b + 7) // 8 - a // 8), np.uint8)
        return np.unpackbits(raw, bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)

    def _rank(self, level: int, i: int) -> int:
        block = i // RANK_BITS
        (ones,) = struct.unpack("<Q", self._read(self._levels[level][3] + 8 * block, 8))
        return ones + int(self._bits(level, block * RANK_BITS, i).sum())

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 of the file."""
        out, at, shift, where = np.zeros(b - a, np.uint32), a, 0, None
        size = b - a
        for level, (_, chunks, _, _) in enumerate(self._levels):
            if size == 0:
                break
            part = np.frombuffer(self._read(chunks + at, size), np.uint8).astype(np.uint32) << np.uint32(shift)
            more = self._bits(level, at, at + size)
            if where is None:
                out |= part
                where = np.flatnonzero(more)
            else:
                out[where] |= part
                where = where[more]
            at, size, shift = (self._rank(level, at) if len(where) else 0), len(where), shift + 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def open_file(path: str) -> TokenFile:
    fs, inner = pafs.FileSystem.from_uri(path)
    source = fs.open_input_file(inner)

    def read(offset: int, size: int) -> bytes:
        source.seek(offset)
        return source.read(size)

    return TokenFile(read)


def _write(path: str, body: bytes) -> None:
    """In one piece. The name holds the task's attempt, so a repeated task writes another file; a cut-off one's isn't in the table."""
    fs, inner = pafs.FileSystem.from_uri(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner) as out:
        out.write(body)


def write_token_files(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, append end_id, and write the ids in ascending doc_id order; returns the files' table.

    Columns: path, shard, part, n_docs, n_ids, start (ids in all files before). Documents are dealt by ranges of doc_id
    (rows that repeat an id by their text's hash), each range a shard that is written as it is read, in files of at
    most about file_ids ids; null ids come first, null texts are empty. Every row counts, however often it repeats. An empty
    table gives no files; other columns are ignored. A null id is kept as the smallest long, so that this number, as an id,
    is read back as null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, docs_, ids, count = TaskContext.get().partitionId(), 0, [], [], 0
        tokenizer, end = piece_tokenizer(vocabulary), np.array([end_id], np.uint32)

        def flush():
            nonlocal part, docs_, ids, count
            starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            path = f"{folder}/shard-{shard:06d}-{part:04d}-{TaskContext.get().taskAttemptId():x}.dac"
            null = np.iinfo(np.int64).min
            _write(path, to_bytes(np.array([null if d is None else d for d in docs_], np.int64), starts, np.concatenate(ids)))
            row = pa.RecordBatch.from_pydict({"path": [path], "shard": [shard], "part": [part], "n_docs": [len(docs_)], "n_ids": [int(starts[-1])]})
            part, docs_, ids, count = part + 1, [], [], 0
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for doc, got in zip(some.column("doc_id").to_pylist(), tokenizer.ids(some.column("text").to_pylist())):
                    docs_.append(doc)
                    ids.append(np.concatenate((got, end)))
                    count += len(got) + 1
                    if count >= file_ids:
                        yield flush()
        if docs_:
            yield flush()

    files = materialise(rows.mapInArrow(run, "path string, shard long, part long, n_docs long, n_ids long"), "files", folder)
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one row per file


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                f = open_file(path)
                null = np.iinfo(np.int64).min
                step = 2048
                for k in range(0, f.n_docs, step):
                    bounds = f.starts[k : min(k + step, f.n_docs) + 1]
                    ids = f.ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    crc = [zlib.crc32(ids[a - bounds[0] : b - bounds[0]].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                    doc = f.doc_ids[k : k + len(crc)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == null), pa.array(bounds[:-1] + base), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    dealt = files.repartition(shuffle_partitions(spark), "path")
    return dealt.select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digest(docs: DataFrame, vocabulary: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files in the shared scratch folder and read them back. An empty table gives an empty result."""
    return read_token_files(write_token_files(docs, vocabulary, scratch_dir(docs.sparkSession), end_id, file_ids))
