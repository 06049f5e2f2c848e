"""Quality classification with naive Bayes support vectors.

A text's features are the indicators of its hashed byte n-grams, each scaled by the class log-count ratio of that
n-gram; a linear hinge-loss model over them is fitted by dual coordinate descent, and the score is a logistic function
of its margin. Case and punctuation count: they are what junk differs by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, text_bytes

#: Buckets of the hash (a power of two), and lengths of the n-grams.
BUCKET_BITS, LENGTHS = 16, (2, 4)
#: Bound of the fit: labelled texts.
TEXTS = 4_000


def features(raw: np.ndarray) -> np.ndarray:
    """The hash bucket of every n-gram of one text, with repeats."""
    wide = raw.astype(np.uint32)
    out = []
    for n in LENGTHS:
        if len(wide) >= n:
            g = wide[: len(wide) - n + 1].copy()
            for k in range(1, n):
                g |= wide[k : len(wide) - n + 1 + k] << np.uint32(8 * k)
            out.append(((g * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class Model:
    """weights: per bucket, hinge weight times log-count ratio; bias; texts with n distinct features are scaled by 1 / sqrt(n)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, raw: np.ndarray, seen: np.ndarray) -> float:
        found = features(raw)
        seen[found] = 1
        n = int(seen.sum())
        margin = float(seen @ self.weights) / max(1.0, np.sqrt(n)) + self.bias
        seen[found] = 0
        return float(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 20, cost: float = 1.0, smooth: float = 1.0) -> Model:
    """rows: each text's distinct buckets; labels 0 or 1. Classes weigh alike, however many texts they have."""
    size = 1 << BUCKET_BITS
    if len(rows) == 0 or labels.min() == labels.max():
        bias = 0.0 if len(rows) == 0 else (1.0 if labels[0] else -1.0)
        return Model(np.zeros(size), bias)
    counts = np.full((2, size), smooth)
    for r, y in zip(rows, labels):
        counts[y, r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    y = np.where(labels == 1, 1.0, -1.0)
    limit = np.where(labels == 1, cost * len(y) / (2 * (labels == 1).sum()), cost * len(y) / (2 * (labels == 0).sum()))
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    norm = np.array([float((ratio[r] ** 2).sum()) for r in rows]) * scale**2 + 1.0  # 1: the constant feature
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    order, rng = np.arange(len(y)), np.random.default_rng(7)
    for _ in range(rounds):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            r = rows[i]
            x = ratio[r] * scale[i]
            slope = y[i] * (float(w[r] @ x) + bias) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return Model(w * ratio, bias)


def train(docs: DataFrame, labels: DataFrame, texts: int = TEXTS) -> Model:
    """Fit on at most about ``texts`` labelled texts of each class, chosen by a hash of the id. Labels other than 0
    and 1, and null ids, are left out; of several labels of an id the larger counts, and of several texts the one of the
    largest feature set. Without labels, or with those of one class only, the score is the same for every text."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not totals:
        return fit([], np.zeros(0, np.int64))
    limit = F.create_map(*[F.lit(x) for y, n in totals.items() for x in (y, int(min(1.0, texts / n) * 1_000_000))])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit[F.col("y")]).select(F.col("doc_id").cast("long").alias("doc_id"), "y")
    chosen = F.broadcast(chosen)  # two classes of about ``texts`` rows

    def run(batches):
        for batch in batches:
            body, offsets = text_bytes(batch.column("text"))
            found = [np.unique(features(body[a:b])).astype("<u2").tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], names=["doc_id", "y", "f"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").mapInArrow(run, "doc_id long, y int, f binary")
    # One text of an id, however many rows repeat it: the driver gets at most a set of 2^16 buckets for each chosen label.
    sample = sample.groupBy("doc_id", "y").agg(F.max("f").alias("f"))
    rows = sorted(((r["doc_id"], r["y"], bytes(r["f"])) for r in sample.toLocalIterator()), key=lambda r: r)
    return fit([np.frombuffer(f, "<u2").astype(np.int64) for _, _, f in rows], np.array([y for _, y, _ in rows], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every row; null texts count as empty, and empty ones get the score of the bias alone.

    Whole texts of any length. A score of exactly 0.5 predicts 1. Rows that repeat an id are scored each; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 doubles

    def run(batches):
        m, seen = shared.value, np.zeros(1 << BUCKET_BITS)
        for batch in batches:
            body, offsets = text_bytes(batch.column("text"))
            out = np.array([m.score(body[a:b], seen) for a, b in zip(offsets[:-1], offsets[1:])], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(3)) == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, texts: int = TEXTS) -> DataFrame:
    """Learn from the labels that are not held out, score all: doc_id, held_out, score, predicted. Null ids are not held out."""
    model = train(docs, labels.filter(~held_out()), texts)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
