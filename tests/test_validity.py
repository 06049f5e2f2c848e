"""States that hold for a time: streams with timers against a plain walk and against the batch twin."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from weftline.streaming import validity

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
TTL = {"alive": 60, "dead": 600, "forever": 0}
SCHEMA = "key string, status string, at timestamp, seq long"


def at(second):
    return START + dt.timedelta(seconds=second)


def walk(rows, until):
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key and r[2] <= until), key=lambda r: (r[2], r[3]))
        for r, after in zip(own, [*own[1:], None]):
            over = r[2] + dt.timedelta(seconds=TTL[r[1]]) if TTL[r[1]] else None
            if after and (over is None or over >= after[2]):
                out.append((key, r[1], r[2], after[2], "checked"))
            elif over and over <= until:
                out.append((key, r[1], r[2], over, "expired"))
    return sorted(out)


def read(df):
    utc = lambda t: t.replace(tzinfo=dt.timezone.utc) if t.tzinfo is None else t.astimezone(dt.timezone.utc)
    return sorted((r.key, r.status, utc(r.since), utc(r.until), r.ended_by) for r in df.select("key", "status", "since", "until", "ended_by").collect())


def test_batch_twin(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice(list(TTL)), at(rng.randrange(3000)), k) for k in range(200)]
    got = validity.stretches(spark.createDataFrame(rows, SCHEMA), F.lit(at(2500)), TTL)
    assert read(got) == walk(rows, at(2500))


def test_stream(spark, tmp_path):
    """Two runs from one checkpoint; rows out of order within the delay are taken in order, rows after it are lost."""
    rng = random.Random(4)
    folder, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    first = [(rng.choice("ab"), rng.choice(list(TTL)), at(rng.randrange(0, 400)), k) for k in range(25)] + [("c", "alive", at(400), 90)]
    second = [(rng.choice("ab"), rng.choice(list(TTL)), at(rng.randrange(310, 2000)), 100 + k) for k in range(25)] + [("a", "alive", at(2000), 190)]
    lost = [("a", "dead", at(20), 200), ("b", "dead", at(299), 201)]
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(folder)
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(folder)
    validity.run(spark, stream(), out, checkpoint, "100 seconds", TTL)
    assert read(spark.read.parquet(out)) == walk(first, at(300))
    spark.createDataFrame(second + lost, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    validity.run(spark, stream(), out, checkpoint, "100 seconds", TTL)
    assert read(spark.read.parquet(out)) == walk(first + second, at(1900)) == read(validity.stretches(spark.createDataFrame(first + second, SCHEMA), F.lit(at(1900)), TTL))


def test_health_of_mirrors(spark):
    """A failure counts for two minutes, an answer ends it."""
    rows = spark.createDataFrame([("m", "failed", at(0), 1), ("m", "ok", at(30), 2), ("m", "failed", at(50), 3), ("n", "failed", at(0), 4)], SCHEMA)
    got = read(validity.stretches(rows, F.lit(at(1000)), {"failed": 120}))
    assert [r for r in got if r[1] == "failed"] == [("m", "failed", at(0), at(30), "checked"), ("m", "failed", at(50), at(170), "expired"), ("n", "failed", at(0), at(120), "expired")]


class Kept:
    """A state of a key, and how often it was asked."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, set()

    def appendList(self, rows):
        self.calls += 1
        self.rows += rows

    def appendValue(self, row):
        self.appendList([row])

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows) if isinstance(self.rows, list) else self.rows

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []

    def update(self, row):
        self.rows = row

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_one_timer_for_all_that_waits():
    """A key's rows cost a call for all of them, not one for each; what the watermark hasn't passed waits for its own."""
    held = validity.Held(TTL)
    held.handle, held.held, held.waiting = handle, _, waiting = Kept(), Kept(), Kept()
    rows = pd.DataFrame({"status": ["alive"] * 100, "at": [1000 * k for k in range(100, 0, -1)], "seq": range(100)})
    assert list(held.handleInputRows(("a",), iter([rows]), None)) == []
    assert (waiting.calls, handle.calls, handle.timers) == (1, 1, {1000})
    handle.now = 50_000
    told = pd.concat(held.handleExpiredTimer(("a",), handle, None))
    assert len(told) == 49 and 51_000 in handle.timers and len(waiting.rows) == 50
    handle.now = 1_000_000
    assert len(pd.concat(held.handleExpiredTimer(("a",), handle, None))) == 51 and not waiting.rows
