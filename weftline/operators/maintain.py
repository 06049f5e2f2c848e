"""Upkeep: what is due for another check, counters of a run, the lock and state of runs, channels to be added, logs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from . import liveness

#: Seconds after which a lock that was left behind may be taken over, and hours between runs at least.
LOCK_STALE, MIN_HOURS = 3 * 3600, 6.0
#: How many times the limit is read, as some rows have no URL.
AHEAD = 3


def recheck_queue(cache: DataFrame, now: Column, older_hours: float, dead_hours: float, limit: int) -> DataFrame:
    """The rows to be checked again, oldest first, with a URL made from their keys; rows whose key gives none are passed over."""
    due = liveness.stale(cache, now, older_hours, dead_hours, limit * AHEAD)
    key = F.regexp_replace("cache_key", r"^v\d+:", "")
    named = due.withColumn("key", key).withColumn("url", F.when(F.col("key").rlike("^[^:]+:.+"), urls.rebuild(F.col("key"))))
    return named.filter("url is not null").orderBy("checked_at", "cache_key").limit(limit)


def pending(cache: DataFrame, now: Column, hours: float) -> DataFrame:
    """One row: the cached rows, and those that are older than so many hours."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("checked_at")) / 3600
    return cache.agg(F.count(F.lit(1)).alias("cached"), F.count_if(age >= hours).alias("expired"))


def counters(checked: DataFrame) -> DataFrame:
    """checked (status) -> one row of a run's counters; a link that asks for a code counts as alive."""
    is_in = lambda *names: F.count_if(F.col("status").isin(*names))
    return checked.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(~F.col("status").isin("unchecked", "unsupported")).alias("checked"),
        is_in("alive", "need_pwd", "wrong_pwd").alias("alive"), is_in("dead", "not_found").alias("dead"), is_in("unsupported").alias("unsupported"), is_in("unknown").alias("errors"),
    )


def slowest(stages: Column) -> Column:
    """The name of the largest of a map of seconds by stage, but for ``total``; null of an empty map."""
    some = F.filter(F.map_entries(stages), lambda e: e["key"] != "total")
    return F.array_max(F.transform(some, lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))))["key"]


def verify_channels(pages: DataFrame, least: int, most_pages: int = 3) -> DataFrame:
    """pages (channel, page, links, text) -> the channels whose first pages have enough links, with these and their text."""
    read = pages.filter(F.col("page") < most_pages)
    by = read.groupBy("channel").agg(F.sum("links").alias("links"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("texts"))  # most_pages of each
    return by.filter(F.col("links") >= least).select("channel", "links", F.array_join(F.transform("texts", lambda t: t["text"]), " ").alias("text"))


def new_channels(found: DataFrame, known: DataFrame) -> DataFrame:
    """found (vertical, channel) that aren't known (channel), case ignored, by vertical in order."""
    low = lambda rows: rows.withColumn("low", F.lower("channel"))
    fresh = low(found).join(low(known).select("low").distinct(), "low", "left_anti").groupBy("low").agg(F.min(F.struct("vertical", "channel")).alias("x"))
    return fresh.groupBy("x.vertical").agg(F.sort_array(F.collect_list("x.channel")).alias("channels"))


class Files:
    """Small control files in a folder that any Hadoop file system holds: state, reports and the lock of runs."""

    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.jvm, self.gateway, self.clock = spark.sparkContext._jvm, spark.sparkContext._gateway, clock
        self.folder = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.folder)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def read(self, name: str) -> dict:
        """A file's object; an empty one where it is missing or broken."""
        if not self.fs.exists(self._at(name)):
            return {}
        stream = self.fs.open(self._at(name))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return {}

    def write(self, name: str, value: dict, replace: bool = True) -> bool:
        """Whether it was written: not, where it exists already and isn't to be replaced."""
        try:
            stream = self.fs.create(self._at(name), replace)
        except Exception as e:
            if not replace and self.fs.exists(self._at(name)):
                return False
            raise e
        try:
            stream.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
        finally:
            stream.close()
        return True

    def swap(self, name: str, value: dict) -> None:
        """Replace a file in one step: readers see the old one or the new one, and the old one stays if this run ends before."""
        aside = f"{name}.{uuid.uuid4().hex}"
        self.write(aside, value)
        whole = lambda x: self.fs.makeQualified(self._at(x))
        overwrite = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(whole(aside), whole(name), overwrite)

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def acquire(self, name: str = "lock.json") -> bool:
        """Takes the lock, unless another run holds it; one that was left behind long ago is taken over."""
        mine = {"started_at": self.clock()}
        if self.write(name, mine, replace=False):
            return True
        if self.clock() - float(self.read(name).get("started_at") or 0) < LOCK_STALE:
            return False
        return self.write(name, mine)

    def release(self, name: str = "lock.json") -> None:
        self.fs.delete(self._at(name), False)


def run(files: Files, work: Callable[[], dict], force: bool = False, min_hours: float = MIN_HOURS) -> dict:
    """A run of upkeep: skipped if the last was a short time ago or another is at work; else its report, kept with the state."""
    last = files.read("state.json").get("last_run")
    age = None if last is None else (files.clock() - float(last)) / 3600
    if not force and age is not None and age < min_hours:
        return {"skipped": "interval", "age_hours": round(age, 1)}
    if not force and not files.acquire():
        return {"skipped": "locked"}
    try:
        report = work()
        state = files.read("state.json")
        files.write("state.json", {**state, "last_run": files.clock(), "last_report": report, "runs": int(state.get("runs") or 0) + 1})
    finally:
        files.release()
    return report
