"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot i of the table is a mask of the languages whose filter has bit i set, so
the AND of an n-gram's slots returns all languages that contain it, in one look-up. Each language's popcount over a
text is corrected for its filter's false positives, and the largest decides. N-grams are of 4 UTF-8 bytes of the text,
lower-cased (ASCII and Latin-1), with all ASCII characters but letters as spaces.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import crc_of_id, give_back, slices, text_bytes

GRAM = 4
#: Look-ups per n-gram, and the part of a language's slots that are set at most: their product over the look-ups is the rate of false positives.
HASHES, FILL = (0x9E3779B1, 0x85EBCA6B), 0.125
#: Bound of the fit: labelled texts of a language.
TEXTS = 2_000
#: A language contains an n-gram that it has at least this part as often as the language that has it most.
SHARE = 0.25
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams as uint32, and where each text's begin and end in them. A space stands before each text and after it."""
    n = len(offsets) - 1
    folded = _FOLD[body]
    if (body == 0xC3).any():
        lead = np.concatenate(([False], body[:-1] == 0xC3))
        folded = np.where(lead & (body >= 0x80) & (body <= 0x9E) & (body != 0x97), body + 32, folded).astype(np.uint8)
    wide = np.full(len(body) + 2 * n, 32, np.uint8)
    at = np.arange(len(body)) + np.repeat(2 * np.arange(n) + 1, np.diff(offsets))
    wide[at] = folded
    wide = wide.astype(np.uint32)
    if len(wide) < GRAM:
        return np.zeros(0, np.uint32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    grams = wide[:-3] | (wide[1:-2] << 8) | (wide[2:-1] << 16) | (wide[3:] << 24)
    starts = offsets[:-1] + 2 * np.arange(n)
    ends = np.maximum(offsets[1:] + 2 * np.arange(1, n + 1) - GRAM + 1, starts)
    return grams, starts, ends


def _count(batches):
    """(lang, gram, n) of the batch's texts."""
    for batch in batches:
        body, offsets = text_bytes(batch.column("text"))
        langs = np.array(batch.column("lang").to_pylist(), object)
        found: dict[str, list[np.ndarray]] = {}
        for i, j in slices(offsets):
            o = offsets[i : j + 1]
            grams, starts, ends = _grams(body[o[0] : o[-1]], o - o[0])
            for k in range(j - i):
                found.setdefault(langs[i + k], []).append(grams[starts[k] : ends[k]])
        for lang, parts in found.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


class Model:
    """langs; bits: of the number of slots, a power of two, as many as the largest filter needs; table: (slots, bytes of masks
    of 8 languages); false: each language's false positive rate."""

    def __init__(self, langs: list[str], grams: list[np.ndarray]):
        self.langs, words = langs, max(1, -(-len(langs) // 8))
        self.bits = max(10, int(np.ceil(np.log2(max(1, *(len(HASHES) * len(g) / FILL for g in grams), 1)))))
        self.table = np.zeros((1 << self.bits, words), np.uint8)
        self.false = np.zeros(len(langs))
        for k, g in enumerate(grams):
            for slots in self.slots(g.astype(np.uint32)):
                self.table[slots, k // 8] |= np.uint8(1 << k % 8)
            self.false[k] = ((self.table[:, k // 8] >> k % 8) & 1).mean() ** len(HASHES)

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        return [(grams * np.uint32(h)) >> np.uint32(32 - self.bits) for h in HASHES]

    def shares(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language, the part of its n-grams that the language contains, corrected; and the number of n-grams."""
        grams, starts, ends = _grams(body, offsets)
        n = np.maximum(ends - starts, 0)
        hits = np.zeros((len(n), len(self.langs)))
        if len(grams):
            inside = np.zeros(len(grams) + 1, np.int8)
            slots = self.slots(grams)
            for w in range(self.table.shape[1]):
                mask = self.table[slots[0], w]
                for s in slots[1:]:
                    mask = mask & self.table[s, w]
                for k in range(8 * w, min(8 * w + 8, len(self.langs))):
                    inside[:-1] = (mask >> k % 8) & 1
                    edges = np.stack((starts, ends), 1).ravel().clip(0, len(grams))
                    hits[:, k] = np.where(n > 0, np.add.reduceat(inside, edges, dtype=np.int64)[::2], 0)
        part = hits / np.maximum(n, 1)[:, None]
        return np.clip((part - self.false) / (1 - self.false), 0, 1), n


def train(docs: DataFrame, texts: int = TEXTS) -> Model:
    """Fit on at most about ``texts`` labelled texts of each language, chosen by a hash of the id, of the text where the id is
    null; rows with null text or lang are left out.

    A filter has all n-grams of its language's texts that are likely enough there; the number of slots follows from theirs.
    """
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return Model([], [])
    # A part of each language's rows, by hash; whole texts.
    limit = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, int(min(1.0, texts / n) * 1_000_000))])
    code = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    sample = rows.filter(F.pmod(code, F.lit(1_000_000)) < limit[F.col("lang")]).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("best"))
    own = rates.join(best, "gram").filter((F.col("rate") >= SHARE * F.col("best")) & (F.col("n") >= 2))
    top = own.select("lang", "gram").toArrow()  # the sample's grams, bounded by its texts
    langs, of, grams = sorted(totals), np.array(top.column("lang").to_pylist(), object), top.column("gram").to_numpy()
    return Model(langs, [np.sort(grams[of == x]) for x in langs])


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep``, lang_pred and score (under ``names``) for every row, rows that repeat an id each. Null texts and texts without a letter are ``und`` with score 0; so is every text if no language was learned.

    Ties go to the first language by name. Whole texts of any length; an empty table gives an empty result. The score is the likelier language's part of the corrected popcounts, between 0 and 1, times how much of the text it contains.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a byte a slot for each 8 languages

    def run(batches):
        give_back()
        m = shared.value
        for batch in batches:
            body, offsets = text_bytes(batch.column("text"))
            n = batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            for i, j in slices(offsets):
                o = offsets[i : j + 1]
                part = body[o[0] : o[-1]]
                if not m.langs:
                    continue
                share, _ = m.shares(part, o - o[0])
                top = share.argmax(1)
                most = share[np.arange(j - i), top]
                best[i:j], score[i:j] = top, most / np.maximum(share.sum(1), 1e-9) * np.minimum(1, most + 0.5)
            texts = batch.column("text")
            for k in range(n):
                if best[k] >= 0:
                    raw = body[offsets[k] : offsets[k + 1]]
                    if not _has_letter(raw, texts, k):
                        best[k], score[k] = -1, 0
            langs = [UNDETERMINED, *m.langs]
            out = [*(batch.column(c) for c in keep), pa.array([langs[b + 1] for b in best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, *names])

    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    kinds = [docs.schema[c] for c in keep]
    return rows.mapInArrow(run, StructType([*kinds, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def _has_letter(raw: np.ndarray, texts, k: int) -> bool:
    head = raw[:64]
    if ((head | 32) - np.uint8(97) < 26).any() or ((raw | 32) - np.uint8(97) < 26).any():
        return True
    return bool((raw >= 128).any()) and any(c.isalpha() for c in texts[k].as_py())


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, texts: int = TEXTS) -> DataFrame:
    """Learn from the rows that are not held out, predict all: doc_id, held_out, lang_pred, score. Null ids are not held out
    and take part; other columns are ignored, whatever their names."""
    model = train(docs.filter(~held_out()), texts)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
