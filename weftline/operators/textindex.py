"""What a text index rests on: postings, vocabulary, rarity, the parts of BM25; and the search without an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(docs: DataFrame, tokens: Column) -> DataFrame:
    """(doc_id, term, pos, dl): one row per token; dl is the document's number of tokens."""
    return docs.select("doc_id", tokens.alias("tokens")).select("doc_id", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term"))


def vocabulary(post: DataFrame) -> DataFrame:
    tf = post.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def corpus(docs: DataFrame, tokens: Column) -> DataFrame:
    """One row: n documents with tokens, avgdl."""
    n = F.size(tokens)
    return docs.select(n.alias("dl")).filter("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    """Of rarity: ln(1 + (n - df + .5) / (df + .5))."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_part(tf: Column, dl: Column, n: Column, df: Column, avgdl: Column) -> Column:
    """What one term adds to a document's score."""
    weight = F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def substring_hits(text: Column, terms: Sequence[str]) -> Column:
    """The fallback without an index: how many terms occur anywhere, case ignored."""
    return sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0))
