"""States that hold for a time: as a stream with timers of event time, and the same over a table.

A state of a key holds from when it was seen until the next one of the key, or until its time to live is over. Each such
stretch is told once, when it is over. A cache of checked links and the health of mirrors (a failure counts for two
minutes) are stretches of this kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import fixed as X

OUT = "key string, status string, since timestamp, until timestamp, ended_by string"
ROW = "status string, at long, seq long"
#: What keeps the state of such streams, with timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Seconds that the states of checked links hold.
CACHE = {s[0]: (X.DEAD_TTL_HOURS if s[5] else X.TTL_HOURS) * 3600 for s in X.STATUSES}


class Held(StatefulProcessor):
    """One key's state and the rows that wait for the watermark. Times are milliseconds.

    A row waits until the watermark has passed it, so rows that come in another order are taken in order of (at, seq); rows
    later than the watermark never come this far. A state without a time to live holds until the next one. A key has one timer
    for its first waiting row and not one for each, as the first to expire takes all rows that the watermark has passed.
    """

    def __init__(self, ttl: dict[str, int]):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", ROW)
        self.waiting = handle.getListState("waiting", ROW)

    def _over(self, row: tuple) -> int | None:
        seconds = self.ttl.get(row[0], 0)
        return row[1] + seconds * 1000 if seconds > 0 else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(s, int(a), int(q)) for frame in rows for s, a, q in zip(frame["status"], frame["at"], frame["seq"])]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[1] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # all that it has passed, whichever timer comes first
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[1], r[2]))
        held = tuple(self.held.get()) if self.held.exists() else None
        out = []

        def end(until: int, by: str) -> None:
            out.append((key[0], held[0], pd.Timestamp(held[1], unit="ms"), pd.Timestamp(until, unit="ms"), by))

        ready = [r for r in rows if r[1] <= now]
        for r in ready:
            if held and (over := self._over(held)) is not None and over < r[1]:
                end(over, "expired")
            elif held:
                end(r[1], "checked")
            held = r
        if held and (over := self._over(held)) is not None and over <= now:
            end(over, "expired")
            held = None
        if ready:
            self.waiting.clear()
            if left := [r for r in rows if r[1] > now]:
                self.waiting.put(left)
                self.handle.registerTimer(min(r[1] for r in left))
        if held:
            self.held.update(held)
            if ready and (over := self._over(held)) is not None:
                self.handle.registerTimer(over)
        elif self.held.exists():
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "status", "since", "until", "ended_by"])

    def close(self) -> None:
        pass


def stretches_stream(rows: DataFrame, late: str, ttl: dict[str, int] = CACHE) -> DataFrame:
    """A stream (key, status, at: timestamp, seq) -> its stretches that are over (OUT), by timers of event time."""
    rows.sparkSession.conf.set(*STORE)
    flat = rows.withWatermark("at", late).select("key", "status", F.col("at").alias("seen"), F.unix_millis("at").alias("at"), "seq")
    return flat.groupBy("key").transformWithStateInPandas(Held(ttl), OUT, "Append", "EventTime")


def _seconds(status: Column, ttl: dict[str, int]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in ttl.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, status), F.lit(0))


def stretches(rows: DataFrame, until: Column, ttl: dict[str, int] = CACHE) -> DataFrame:
    """The same of a table: the stretches that were over at ``until``, of the rows up to then."""
    order = Window.partitionBy("key").orderBy("at", "seq")
    known = rows.filter(F.col("at") <= until).withColumn("next", F.lead("at").over(order)).withColumn("ttl", _seconds(F.col("status"), ttl))
    over = F.when(F.col("ttl") > 0, F.timestamp_millis(F.unix_millis("at") + F.col("ttl") * 1000))
    by = F.when(F.col("next").isNotNull() & (over.isNull() | (over >= F.col("next"))), "checked").when(over <= until, "expired")
    ended = known.withColumn("over", over).withColumn("ended_by", by).filter("ended_by is not null")
    return ended.select("key", "status", F.col("at").alias("since"), F.when(F.col("ended_by") == "checked", F.col("next")).otherwise(F.col("over")).alias("until"), "ended_by")


def run(spark: SparkSession, rows: DataFrame, out: str, checkpoint: str, late: str, ttl: dict[str, int] = CACHE) -> None:
    """Take all that there is of a stream of states; stretches go to a Parquet table, once each, over restarts too."""
    found = stretches_stream(rows, late, ttl)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
