"""The corpus pipeline: language ID, exact dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what a stage returns is written as Parquet and reread as
the next one's docs. All but the last return the columns of documents.

An empty table passes through every stage. Null texts count as empty; null ids and rows that repeat an id are documents
of their own, told apart by their texts; of rows that repeat both, filters keep one. Extra columns stay as they are,
whatever their names. Ties are broken as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, language_id, mixing, ngram_join, packing
from weftline.llm.shared import materialise, scratch_dir, ship, table
from weftline.llm.tokens import vocabulary

#: Ids of rows to be dropped up to which they are broadcast, 32 MB; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Names that no column of the documents has.
TOLD, SCORE = "\x00predicted language", "\x00its score"
#: Word shingles and percent of similarity of near duplicates; weights, share and limit of the mix; ids of a sequence.
SHINGLE, PERCENT, WEIGHTS, SHARE, MOST, CAPACITY = 5, 80, (3, 1, 2), 1.5, 2.0, 2048


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, text_sha256) is in gone.

    Ids alone are broadcast, to tell the rows that may go; only the texts of these are shuffled. Null ids are looked up too.
    """
    gone = materialise(gone, "gone", scratch_dir(docs.sparkSession))
    ids = gone.filter("gone_id is not null").select("gone_id").distinct()
    ids = F.broadcast(ids) if gone.count() <= BROADCAST_ROWS else ids
    own = docs["doc_id"] == ids["gone_id"]
    safe = docs.filter("doc_id is not null").join(ids, own, "left_anti")
    asked = docs.join(ids, own, "left_semi").unionByName(docs.filter("doc_id is null"))
    sha = F.sha2(F.coalesce(asked["text"], F.lit("")), 256)
    return safe.unionByName(asked.join(gone.hint("merge"), asked["doc_id"].eqNullSafe(gone["gone_id"]) & (sha == gone["gone_sha"]), "left_anti"))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """Of rows that repeat (doc_id, text) the one whose other columns are the smallest as JSON, so that reruns agree."""
    others = F.to_json(F.struct(F.lit(0), *(c for c in docs.columns if c not in ("doc_id", "text"))))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.groupBy(F.col("doc_id").alias(TOLD), sha.alias(SCORE)).agg(F.min_by(F.struct(*docs.columns), others).alias("row")).select("row.*")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letter in any language, null and empty texts among it: no language can be told. Of the rest,
    rows without a lang get the language that is told."""
    ship(spark)
    model = language_id.train(docs.filter(~language_id.held_out()))
    told = language_id.predict(docs, model, docs.columns, (TOLD, SCORE)).filter(F.col(TOLD) != language_id.UNDETERMINED)
    return told.select(*(F.coalesce("lang", TOLD).alias("lang") if c == "lang" else F.col(c) for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, null ids being the smallest; of rows that repeat both, one."""
    verdict = materialise(exact_dedup.exact_dedup(docs.select("doc_id", "text")), "verdict", scratch_dir(spark))
    lost = verdict.filter("not kept")
    other = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    left = _without(docs, lost.filter(other).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct())
    if lost.filter(~other).isEmpty():
        return left
    return _one_of_each(left)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: of the smallest doc_id, null after all others, then of the smallest SHA-256.

    Ids may repeat, so a row goes by a hash of (doc_id, SHA-256), under a seed for which no two of them share one.
    """
    folder, seed = scratch_dir(spark), 0
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    while True:
        name = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha)
        keys = docs.groupBy(name.alias("row"), "doc_id", sha.alias("sha")).agg(F.count(F.lit(1)).alias("times"))
        keys = materialise(keys, f"rows{seed}", folder)
        if keys.groupBy("row").count().filter("count > 1").isEmpty():
            break
        seed += 1
    found = ngram_join.jaccard_components(docs.select(name.alias("doc_id"), "text"), SHINGLE, PERCENT)
    found = materialise(found.select(F.col("doc_id").alias("row"), "component_id").distinct(), "near", folder)
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "sha")
    stays = found.join(keys, "row").groupBy("component_id").agg(F.min_by("row", first).alias("row"))
    lost = found.join(stays.select("row"), "row", "left_anti").join(keys, "row")
    left = _without(docs, lost.select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha")))
    if keys.filter("times > 1").isEmpty():
        return left
    return _one_of_each(left)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Ties of the order within a source go by doc_id."""
    return mixing.mixed_rows(docs, WEIGHTS, SHARE, MOST)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap. A document that the mix repeats is packed each time."""
    ship(spark)
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"), CAPACITY, 0), CAPACITY)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the language filters, nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name, folder)
    return docs
