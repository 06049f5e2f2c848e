"""Nearest neighbours by largest inner product, with vantage-point trees.

A vector x gets a coordinate more, sqrt(M^2 - |x|^2) with M the largest norm, and a query a zero: then |q - x|^2 is
|q|^2 + M^2 - 2 q.x, so the nearest by distance are those of the largest inner product, and the triangle inequality
holds. Vectors are dealt over shards of bounded size; a task builds its shard's tree once and streams blocks of queries
through it. A subtree is passed over if ``relax`` times the query's distance from the ball or shell that holds it exceeds the k-th
distance so far; a factor of one is the exact search, more prunes more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, scratch_dir, ship

#: Vectors of a shard and queries of a block; vectors of a leaf.
SHARD, BLOCK, LEAF = 65_536, 2_048, 256
#: Rounding of the distances, relative to the largest norms: what lies this near the bound is not passed over.
SLACK = 1e-6


class Tree:
    """x: distinct vectors, one coordinate added; ids: for each, the ids that have it, smallest first."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x, self.rng = x, np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(x)))

    def _build(self, own: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(own) <= LEAF:
            self.nodes[at] = (None, own)
            return at
        tries = self.rng.choice(own, min(8, len(own)), replace=False)
        some = self.x[self.rng.choice(own, min(128, len(own)), replace=False)]
        spread = [np.linalg.norm(some - self.x[t], axis=1).std() for t in tries]
        centre = self.x[tries[int(np.argmax(spread))]]
        d = np.linalg.norm(self.x[own] - centre, axis=1)
        order = np.argsort(d, kind="stable")
        half = len(own) // 2
        near, far = order[:half], order[half:]
        bounds = (d[near[-1]], d[far[0]], d[far[-1]])
        a, b = self._build(own[near]), self._build(own[far])
        self.nodes[at] = (centre, bounds, a, b)
        return at

    def search(self, q: np.ndarray, k: int, relax: float, least_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k distinct vectors of the largest inner product: the products, and their numbers (-1: none). Ties go to the smaller least_id.

        Distances only tell which subtrees to pass over: where one norm is very large, all others' distances are equal but for rounding.
        """
        best = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), -1)
        raw, asked = self.x[:, :-1], q[:, :-1]
        norms, qnorms = (raw**2).sum(1), (asked**2).sum(1)
        reach = qnorms + (self.x**2).sum(1).max()
        # What a product may be off by, and so two orders of adding up.
        off, qoff = np.sqrt(norms), np.sqrt(qnorms) * (4 * raw.shape[1] * np.finfo(float).eps)
        top = off.max()
        stack: list[tuple] = [(self.root, np.arange(len(q)), np.zeros(len(q)))]
        while stack:
            node, some, least = stack.pop()
            bound = np.sqrt(np.maximum(reach[some] - 2 * best[some, -1], 0) + SLACK**2 * reach[some]) + SLACK * np.sqrt(reach[some])
            keep = ~(relax * least > bound)
            some, least = some[keep], least[keep]
            if len(some) == 0:
                continue
            entry = self.nodes[node]
            if entry[0] is None:
                own = entry[1]
                d = asked[some] @ raw[own].T
                # Only queries that the leaf may bring something, rounding allowed for.
                hope = np.flatnonzero(d.max(1) + (off[own].max() + top) * qoff[some] >= best[some, -1])
                if len(hope) < len(some):
                    some, d = some[hope], d[hope]
                if len(some) == 0:
                    continue
                both, ids = np.concatenate((best[some], d), 1), np.concatenate((who[some], np.broadcast_to(own, d.shape)), 1)
                pick = np.argpartition(-both, k - 1, axis=1)[:, :k]
                rows = np.arange(len(some))[:, None]
                values, found = both[rows, pick], ids[rows, pick]
                high = both + np.where(ids < 0, 0, off[ids]) * qoff[some, None]
                low = (values - np.where(found < 0, 0, off[found]) * qoff[some, None]).min(1)
                near = (ids >= 0) & (high >= low[:, None])
                for r in np.flatnonzero(near.sum(1) > k):  # ties at the end, but for rounding
                    some_ids = ids[r, near[r]]
                    exact = np.cumsum(raw[some_ids] * asked[some[r]], axis=1)[:, -1]
                    full = np.lexsort((least_id[some_ids], -exact))[:k]
                    values[r], found[r] = exact[full], some_ids[full]
                order = np.argsort(-values, axis=1, kind="stable")
                best[some], who[some] = values[rows, order], found[rows, order]
                continue
            centre, (inner, gap, outer), a, b = entry
            d = np.sqrt(np.maximum(qnorms[some] + (centre**2).sum() - 2 * (q[some] @ centre), 0))
            to_a, to_b = np.maximum(d - inner, 0), np.maximum(np.maximum(gap - d, d - outer), 0)
            a_first = d <= (inner + gap) / 2
            low_a, low_b = np.maximum(least, to_a), np.maximum(least, to_b)
            stack += [(b, some[a_first], low_b[a_first]), (a, some[~a_first], low_a[~a_first]), (b, some[~a_first], low_b[~a_first]), (a, some[a_first], low_a[a_first])]
        return best, who


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _packs(rows: DataFrame, number: str, n: int) -> DataFrame:
    """Rows dealt evenly into n packs, each one row: number, ids, vectors (float64, end to end), dim."""

    def run(key, table):
        order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
        lists = table["vector"].combine_chunks()
        dim = len(lists[0])
        x = lists.flatten().to_numpy().reshape(-1, dim)[order]
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([table["vec_id"].to_numpy()[order].astype("<i8").tobytes()]), pa.array([x.astype("<f8").tobytes()]), pa.array([dim], pa.int32())],
            names=[number, "ids", "vectors", "dim"],
        )

    # By the row, not the id or the vector: neither can be hot.
    numbered = rows.withColumn(number, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    return numbered.groupBy(number).applyInArrow(run, f"{number} int, ids binary, vectors binary, dim int")


def _searched(row: dict, k: int, relax: float, held: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query_id, vec_id, score of a block of queries against the tree that is held."""
    ids, distinct, order, firsts, tree = held
    qids, q = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
    _, who = tree.search(np.column_stack((q, np.zeros(len(q)))), min(k + 1, len(distinct)), relax, ids[order[firsts[:-1]]])
    out_q, out_v, out_s = [], [], []
    for i in range(len(q)):
        found = who[i][who[i] >= 0]
        # Each vector's smallest ids: k of them besides the query's own suffice.
        own = np.concatenate([order[firsts[f] : min(firsts[f + 1], firsts[f] + k + 1)] for f in found]) if len(found) else np.zeros(0, np.int64)
        sims = np.cumsum(distinct[found] * q[i], axis=1)[:, -1]  # added from the first component to the last
        sims = np.repeat(sims, [min(firsts[f + 1] - firsts[f], k + 1) for f in found])
        keep = ids[own] != qids[i]
        own, sims = ids[own[keep]], sims[keep]
        first = np.lexsort((own, -sims))[:k]
        out_q.append(np.full(len(first), qids[i]))
        out_v.append(own[first])
        out_s.append(sims[first])
    return np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)


def _search(k: int, relax: float, top: float):
    """Rows (shard, part, block, ids, vectors, dim) in this order: a shard's vectors, block -1, and then blocks of queries."""

    def run(batches):
        held: tuple = ()
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                if row["block"] >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in _searched(row, k, relax, held)], names=["query_id", "vec_id", "score"])
                    continue
                ids, x = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                distinct, inverse = np.unique(x, axis=0, return_inverse=True)
                inverse = inverse.ravel()
                order = np.lexsort((ids, inverse))
                firsts = np.searchsorted(inverse[order], np.arange(len(distinct) + 1))
                extra = np.sqrt(np.maximum(top**2 - (distinct**2).sum(1), 0))
                held = (ids, distinct, order, firsts, Tree(np.column_stack((distinct, extra))))

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, relax: float = 1.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) for which ``queries`` holds, the k rows of
    other ids with the largest inner product in double precision, ties to the smaller vec_id; all, if there are fewer.

    Vectors null, zero, or with a null or non-finite component take no part, nor do pairs of different lengths, nor null
    ids. Queries that repeat an id give one result; rows that repeat an id and a vector are candidates each. An empty table
    gives an empty result; other columns are ignored, whatever their names. relax 1 is exact; more passes over subtrees
    that may hold some of the k.
    """
    spark, folder = vectors.sparkSession, scratch_dir(vectors.sparkSession)
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.filter(usable(F.col("vector")) & F.col("vec_id").isNotNull()).withColumn("dim", F.size("vector"))
    dims = [(r["dim"], r["n"], r["asks"], r["top"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).collect()]
    parts = []
    for dim, n, asks, top in dims:  # one, but for odd data
        if not asks:
            continue
        own, shards, blocks = rows.filter(F.col("dim") == dim), -(-n // shard), -(-asks // block)
        packed = materialise(_packs(own.select("vec_id", "vector"), "shard", shards), f"shards{dim}", folder)
        asked = materialise(_packs(own.filter("asks").dropDuplicates(["vec_id"]).select("vec_id", "vector"), "block", blocks), f"blocks{dim}", folder)
        # Every block of the stated queries meets every shard: as rows that follow it. Where there are fewer shards than
        # tasks, a shard's blocks are dealt over several.
        tasks = spark.sparkContext.defaultParallelism
        shares = min(blocks, -(-tasks // shards))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        data = ["ids", "vectors", "dim"]
        trees = packed.select("shard", every(shares).alias("part"), F.lit(-1).alias("block"), *data)
        asking = asked.select(every(shards).alias("shard"), F.pmod(F.col("block"), F.lit(shares)).alias("part"), "block", *data)
        runs = trees.unionByName(asking).repartition(min(shards * shares, 16 * tasks), "shard", "part").sortWithinPartitions("shard", "part", "block")
        parts.append(runs.mapInArrow(_search(k, relax, math.sqrt(top)), "query_id long, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.dropDuplicates(["query_id", "vec_id"]) if len(parts) > 1 else found
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
