"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards. From the root down, every child of a node draws a number from the hash of (key,
child) and its weight, the largest of ``ln(u) / weight`` wins, and a node weighs what its shards weigh together. So a
share of rows goes to each shard by its weight, and a change of weights moves rows only into, out of or within the
subtrees whose weights changed. A region that is added takes rows from all others and moves none between them: a tree
grows by a shard that is a region of its own (``grown``), so a further shard takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, numbered, scratch_dir

#: Hex digits of a draw, 52 bits, and what a row takes besides its text.
DIGITS, ROW_BYTES = 13, 16


@dataclass(frozen=True)
class Node:
    """A region, a rack, or a shard; a shard has a number and its own weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own

    @property
    def depth(self) -> int:
        depths = {c.depth for c in self.children}
        if len(depths) > 1:
            raise ValueError("all shards of a tree must lie at the same level")
        return 1 + depths.pop() if depths else 0

    @property
    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards] if self.children else [self.shard]


def balanced(shards: int, regions: int = 5, racks: int = 2, weights: Sequence[float] | None = None) -> Node:
    """So many shards dealt evenly over racks of regions, by number."""
    weights = weights or [1.0] * shards
    spots = min(shards, regions * racks)
    by: dict[int, dict[int, list[Node]]] = {}
    for s in range(shards):
        spot = s * spots // shards
        by.setdefault(spot // racks, {}).setdefault(spot, []).append(Node(f"s{s}", shard=s, own=float(weights[s])))
    return Node("root", tuple(Node(f"r{r}", tuple(Node(f"k{k}", tuple(own)) for k, own in found.items())) for r, found in by.items()))


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, a region of its own."""
    s = max(tree.shards) + 1
    return Node(tree.name, (*tree.children, Node(f"r+{s}", (Node(f"k+{s}", (Node(f"s{s}", shard=s, own=weight),)),))))


def levels(tree: Node) -> list[list[list[tuple[str, float, int]]]]:
    """By level and node, the children that have a weight: name, weight, and place in the next level (at last: the shard)."""
    out, nodes = [], [tree]
    for _ in range(tree.depth):
        below: list[Node] = []
        rows = []
        for node in nodes:
            rows.append([(c.name, c.weight, c.shard if not c.children else len(below) + k) for k, c in enumerate(c for c in node.children if c.weight > 0)])
            below += [c for c in node.children if c.weight > 0]
        if not all(rows):
            raise ValueError("a tree needs a shard with a weight")
        out.append(rows)
        nodes = below
    return out


def place(key: Column, tree: Node) -> Column:
    """The shard of a key. Ties go to the smaller place."""

    def draw(name: Column, weight: Column) -> Column:
        code = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), name).cast("binary")), 1, DIGITS), 16, 10).cast("double")
        return F.ln((code + 0.5) / F.lit(float(16**DIGITS))) / weight

    node = F.lit(0)
    for rows in levels(tree):
        table = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(k).alias("at")) for n, w, k in row]) for row in rows])
        drawn = F.transform(F.get(table, node), lambda c: F.struct(draw(c["name"], c["weight"]).alias("u"), (-c["at"]).alias("at")))
        node = -F.array_max(drawn)["at"]
    return node


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key of a row: its doc_id; rows without one go by what they hold."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(" ", F.lit("null"), "text_crc32", "size")))


def assign(docs: DataFrame, tree: Node, more: Node | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the doc_id and the tree decide on the shard, so rows that repeat an id share one, and equal texts
    go each by its own id. Null texts count as empty; rows with null ids are placed by size and crc32 of their texts.
    Slots number a shard's rows from 0 by doc_id (null first), crc32 and size; rows that repeat all three are alike. Texts are
    read once and never shuffled; the numbers come from ranges of rows, so a hot shard or id is spread over tasks. An empty
    table gives an empty result; other columns are ignored, whatever their names. more: the tree of grown_shard, by
    default with one more shard.
    """
    folder = scratch_dir(docs.sparkSession)
    rows = measured(docs).select("doc_id", "size", "text_crc32", place(F.col("key"), tree).alias("shard"), place(F.col("key"), more or grown(tree)).alias("grown_shard"))
    rows = numbered(materialise(rows, "placed", folder), ["shard"], ["doc_id", "text_crc32", "size"], "slot", folder)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: Node, path: str, files: int = 1, key: Column | None = None) -> None:
    """Write the rows of docs, all columns, as Parquet under path/shard=N, each shard as so many files at least (more where
    Spark splits them). key: a text column to go by instead of doc_id, such as a digest of the text, which keeps equal texts together."""
    rows = docs.withColumn("shard", place(key if key is not None else F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), tree))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    rows.repartition(max(1, files * len(tree.shards)), "shard", salt).write.mode("overwrite").partitionBy("shard").parquet(path)


def moved(docs: DataFrame, before: Node, after: Node) -> DataFrame:
    """What a change of the tree moves: from_shard, to_shard, rows, bytes. A row per pair of shards at most."""
    rows = measured(docs).select("size", place(F.col("key"), before).alias("from_shard"), place(F.col("key"), after).alias("to_shard"))
    return rows.filter("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def placement_sql(tree: Node, source: str, out: str) -> str:
    """DuckDB's WITH clauses that place the rows of source (doc_id, key) as table ``out`` (doc_id, shard)."""
    parts, at = [], f"SELECT doc_id, key, 0 AS node FROM {source}"
    for k, rows in enumerate(levels(tree)):
        values = ", ".join(f"({parent}, '{n}', {float(w)}::DOUBLE, {to})" for parent, row in enumerate(rows) for n, w, to in row)
        draw = f"ln((CAST('0x' || substr(md5(key || '|' || name), 1, {DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {16**DIGITS}::DOUBLE) / weight"
        parts.append(f"{out}{k} AS (SELECT doc_id, key, arg_max(child, {draw}) AS node FROM ({at}) x JOIN (VALUES {values}) c(parent, name, weight, child) ON c.parent = x.node GROUP BY 1, 2)")
        at = f"SELECT doc_id, key, node FROM {out}{k}"
    return ",\n".join(parts) + f",\n{out} AS (SELECT doc_id, node AS shard FROM {out}{len(parts) - 1})"
