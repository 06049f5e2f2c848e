"""The pipeline on the smallest tables: each stage's columns, and what it may keep."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[0] == sizes[1] >= sizes[2] >= sizes[3]
    assert docs.groupBy("doc_id").count().filter("count > 2").isEmpty()
    packed = corpus_pipeline.pack_sequences(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("n", range(1, 11))
def test_registered(n):
    assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1 and "pipeline" in entry.queries()


def test_workers_keep_nothing_of_other_stages():
    """A tokenizer's caches go when a worker serves another stage, and stay where it is asked for again."""
    from weftline.llm import ngram_join, shared, tokens

    path = tokens.vocabulary("word_bpe_49k.json")
    one = tokens.piece_tokenizer(path, 10)
    shared.give_back(tokens.OPEN)
    assert tokens.piece_tokenizer(path, 10) is one
    assert list(ngram_join._prints(5, 80)(iter([]))) == [] and not tokens.OPEN
