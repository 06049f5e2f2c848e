"""Streams of small files against the same over whole tables."""

import datetime
import os
import random

from pyspark.sql import functions as F

from weftline.operators import liveness
from weftline.plans import search
from weftline.streaming import health, windows

BEGAN = datetime.datetime(2024, 1, 1)


def files(spark, rows, schema, folder, n):
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    return spark.readStream.schema(spark.read.parquet(f"file://{folder}").schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def test_upserts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(20), i, f"v{i}") for i in range(200)]
    stream = files(spark, rows, "k long, seq long, v string", tmp_path / "in", 4)
    target = f"file://{tmp_path}/out"
    windows.upserts(stream, target, ["k"], "seq", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    expected = {k: max((s, v) for key, s, v in rows if key == k) for k in {r[0] for r in rows}}
    assert {r.k: (r.seq, r.v) for r in windows.upserted(spark, target, ["k"], "seq").collect()} == expected
    assert len([f for f in os.listdir(tmp_path / "out") if f.startswith("batch=")]) == 4
    windows.compact_upserts(spark, target, f"file://{tmp_path}/less", ["k"], "seq")
    assert {r.k: (r.seq, r.v) for r in windows.upserted(spark, f"file://{tmp_path}/less", ["k"], "seq").collect()} == expected


def test_health(spark, tmp_path):
    rng = random.Random(2)
    runs = [(f"d{rng.randrange(3)}", BEGAN + datetime.timedelta(hours=i), i, rng.choice([0, 0, 0, 2]), rng.choice(["E", None])) for i in range(90)]
    for k in range(3):  # in order of time
        spark.createDataFrame(runs[30 * k : 30 * k + 30], "domain string, run_at timestamp, event_id long, hits long, error string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    stream = spark.readStream.schema("domain string, run_at timestamp, event_id long, hits long, error string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{tmp_path}/in")
    seen = {}
    q = health.consecutive_failures(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.update({r.domain: r.fails for r in b.collect()})).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    last = liveness.failures(spark.createDataFrame(runs, "domain string, run_at timestamp, event_id long, hits long, error string")).groupBy("domain").agg(F.max_by("fails", "event_id").alias("fails"))
    assert seen == {r.domain: r.fails for r in last.collect()}


def test_progress(spark, tmp_path):
    hits = [(i, "s", "tg", f"https://pan.quark.cn/s/{i % 7}", None, "沙丘 2", None, None, None, False, "沙丘 2", i) for i in range(40)]
    stream = files(spark, hits, search.HIT, tmp_path / "in", 3)
    ranked = lambda rows: search.search(rows, "沙丘 2", now=F.lit(BEGAN)).select("key", "hit_count", "score")
    windows.progress(stream, f"file://{tmp_path}/out", ranked).trigger(availableNow=True).start().awaitTermination()
    assert sorted(os.listdir(tmp_path / "out" / "frames")) == ["0", "1", "2"]
    got = {(r.key, r.hit_count, r.score) for r in spark.read.json(f"file://{tmp_path}/out/frames/2").collect()}
    assert got == {(r.key, r.hit_count, r.score) for r in ranked(spark.createDataFrame(hits, search.HIT)).collect()}
