"""Results that are kept for a while: tables by a hash of what was asked, and a manifest that says which are in force.

A table is written first, under a name of its own, and the manifest replaced after it in one step. A writer that dies
leaves the manifest as it was, and of two at a time the later manifest counts, which may forget the other's table but
never shows half of one. What is no longer in force is removed after the manifest has let go of it.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .maintain import Files

MANIFEST = "manifest.json"


class Kept(NamedTuple):
    rows: DataFrame
    about: dict[str, Any]


class Snapshots:
    """Tables in a folder that any Hadoop file system holds; seconds that one is in force, and how many are at most."""

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 300, most: int = 64, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.seconds, self.most, self.clock = spark, folder.rstrip("/"), seconds, most, clock
        self.files = Files(spark, folder)

    @staticmethod
    def name(query: str, **flags: Any) -> str:
        """The same for the same query and flags, in whichever order these are given."""
        return hashlib.sha256(json.dumps([query, flags], sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:32]

    def _entries(self) -> dict[str, dict]:
        return self.files.read(MANIFEST).get("entries", {})

    def get(self, name: str) -> Kept | None:
        """What is kept under a name, unless its time is over."""
        entry = self._entries().get(name)
        if entry is None or self.clock() - entry["at"] >= self.seconds:
            return None
        return Kept(self.spark.read.parquet(f"{self.folder}/{entry['table']}"), entry["about"])

    def put(self, name: str, rows: DataFrame, about: dict[str, Any] | None = None) -> Kept:
        """Keep rows; the oldest beyond ``most``, and those whose time is over, are given up."""
        table, now = f"table-{uuid.uuid4().hex}", self.clock()
        rows.write.parquet(f"{self.folder}/{table}")
        before = self._entries()
        entries = {k: e for k, e in before.items() if k != name and now - e["at"] < self.seconds}
        entries[name] = {"at": now, "table": table, "about": about or {}}
        kept = dict(sorted(entries.items(), key=lambda x: x[1]["at"])[-self.most :])
        self.files.swap(MANIFEST, {"entries": kept})
        for lost in {e["table"] for e in before.values()} - {e["table"] for e in kept.values()}:
            self.files.remove(lost)
        return Kept(self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{table}"), about or {})

    def ask(self, query: str, make: Callable[[], tuple[DataFrame, dict[str, Any]]], degraded: bool = False, **flags: Any) -> tuple[Kept, bool]:
        """What is kept for a query and its flags, else what ``make`` gives, which is kept; and whether it was.

        A result of nothing, where sources failed (``degraded``), isn't kept: the next search asks again.
        """
        name = self.name(query, **flags)
        found = self.get(name)
        if found is not None:
            return found, True
        rows, about = make()
        if degraded and rows.isEmpty():
            return Kept(rows, about), False
        return self.put(name, rows, about), False
