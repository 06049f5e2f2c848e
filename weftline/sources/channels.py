"""Pages of channels as a stream: offsets are each channel's newest message, read back page by page to the last of them.

Pages come from a ``Pager``, of which a store of captured pages is one; a source of another kind is a class more:
``spark.dataSource.register(channel_source(MyPager, "my_channels"))``.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .captured import MESSAGE, parse_messages

#: How often a page is asked for before its failure is the batch's.
TRIES = 2
#: A message's number on a page.
POST = r'data-post="[^"/]+/(\d+)"'


class Pager(ABC):
    """Where pages come from. It is made anew, of the source's options, wherever it is needed."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    @abstractmethod
    def newest(self) -> dict[str, int]:
        """The newest message of every channel that has any."""

    @abstractmethod
    def page(self, channel: str, before: int) -> str | None:
        """The newest page of which all messages are older than ``before``, cut there if need be; null or one that doesn't go
        back any further if there is none."""

    def cuts(self, channel: str, after: int, upto: int) -> list[int]:
        """Messages, ascending, between which and what follows a stretch may be cut for several tasks; none if that isn't known."""
        return []


class StoredPages(Pager):
    """Pages that ``store_pages`` has written (option path): folders of channels, whose row groups are runs of pages in order
    of messages. Footers tell which row group has a page; those read last are held, so a page is read about once."""

    #: Row groups that are held: captures of several times overlap.
    HELD = 4

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.groups: dict[str, list[tuple]] = {}
        self.held: dict[tuple, tuple] = {}

    def _dataset(self):
        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        system, path = fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] else (fs.LocalFileSystem(), self.options["path"])
        return ds.dataset(path, filesystem=system, format="parquet", partitioning=ds.partitioning(flavor="hive"), exclude_invalid_files=False)

    def _bounds(self, channel: str | None = None) -> dict[str, list[tuple]]:
        """By channel: (highest message, lowest, file, row group), the highest first, from the files' footers: no page is read."""
        import pyarrow.dataset as ds

        out: dict[str, list[tuple]] = {}
        for fragment in self._dataset().get_fragments():
            own = str(ds.get_partition_keys(fragment.partition_expression)["channel"])
            if channel in (None, own):
                names = fragment.metadata.schema.names
                for k in range(fragment.metadata.num_row_groups):
                    group = fragment.metadata.row_group(k)
                    low, high = (group.column(names.index(c)).statistics for c in ("low", "high"))
                    out.setdefault(own, []).append((high.max, low.min, fragment.path, k))
        return {c: sorted(g, reverse=True) for c, g in out.items()}

    def newest(self) -> dict[str, int]:
        return {c: g[0][0] for c, g in self._bounds().items()}

    def cuts(self, channel: str, after: int, upto: int) -> list[int]:
        if channel not in self.groups:
            self.groups = self._bounds()  # on the driver: all channels are asked for
        return sorted({high for high, *_ in self.groups.get(channel, ()) if after < high < upto})

    def _group(self, file: str, k: int) -> tuple:
        """The lows, highs and pages of a row group."""
        import pyarrow.parquet as pq

        if (file, k) not in self.held:
            while len(self.held) >= self.HELD:
                self.held.pop(next(iter(self.held)))
            rows = pq.ParquetFile(file, filesystem=self._dataset().filesystem).read_row_group(k, columns=["low", "high", "html"])
            self.held[file, k] = (rows["low"].to_numpy(), rows["high"].to_numpy(), rows["html"])
        self.held[file, k] = self.held.pop((file, k))  # the one used last is the last to go
        return self.held[file, k]

    def page(self, channel: str, before: int) -> str | None:
        import numpy as np

        if channel not in self.groups:
            self.groups[channel] = self._bounds(channel).get(channel, [])
        # Of pages that reach below, the one that reaches highest; captures overlap where they were made at several times.
        best = None
        for most, least, file, k in self.groups[channel]:
            if best and most < best[0]:
                break
            if least < before:
                lows, highs, pages = self._group(file, k)
                able = np.flatnonzero(lows < before)
                at = able[np.lexsort((lows[able], highs[able]))[-1]]
                if best is None or (highs[at], lows[at]) > best[:2]:
                    best = highs[at], lows[at], pages[int(at)]
        return best and best[2].as_py()


#: Bytes of pages in a row group, which is what a task reads at least.
RUN_BYTES = 8 << 20


def store_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    """pages (channel, html) -> a store that StoredPages reads. Pages without messages are left out. A channel's pages are dealt
    over tasks by ranges of messages."""
    ids = F.transform(F.regexp_extract_all("html", F.lit(POST), F.lit(1)), lambda x: x.cast("long"))
    rows = pages.select("channel", "html", F.array_min(ids).alias("low"), F.array_max(ids).alias("high")).filter("low is not null")
    placed = rows.repartitionByRange("channel", "high").sortWithinPartitions("channel", "high")
    placed.write.mode(mode).option("parquet.block.size", RUN_BYTES).partitionBy("channel").parquet(path)


@dataclass
class Stretch(InputPartition):
    """Messages of a channel after ``after``, up to ``upto``."""

    channel: str
    after: int
    upto: int


def read_back(pager: Pager, stretch: Stretch) -> Iterator[tuple]:
    """The messages of a stretch, once each, the newest first: page after page back to the one that reaches ``after``.

    A page that doesn't go on is the last; a page that can't be had fails the task, and so the batch, which is read again.
    """
    before = stretch.upto + 1
    while before > stretch.after + 1:
        for k in range(TRIES):
            try:
                html = pager.page(stretch.channel, before)
                break
            except OSError:
                if k == TRIES - 1:
                    raise
        rows = sorted((m for m in parse_messages(html, stretch.channel) if m["msg_id"] < before), key=lambda m: -m["msg_id"])
        seen = [int(x) for x in _posts(html) if int(x) < before]
        if not seen:
            return
        last = None
        for m in rows:
            if m["msg_id"] > stretch.after and m["msg_id"] != last:
                yield tuple(m[c] for c in MESSAGE.names[:-1]) + ([tuple(x[c] for c in ("pos", "url", "pan_type", "pwd")) for x in m["links"]],)
            last = m["msg_id"]
        before = min(seen)


def _posts(html: str | None) -> list[str]:
    import re

    return re.findall(POST, html or "")


class ChannelStream(DataSourceStreamReader):
    """Offsets are {channel: newest message}; a batch is what lies between two of them, so a replay reads the same."""

    def __init__(self, pager: type[Pager], options: dict[str, str]):
        self.pager, self.options_ = pager, options

    def initialOffset(self) -> dict:
        """Nothing read, or the marks of option ``marks`` (JSON: channel -> newest message known)."""
        return json.loads(self.options_.get("marks", "{}"))

    def latestOffset(self) -> dict:
        return self.pager(self.options_).newest()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Channels cut where their pager allows it; a page across a cut is read on both sides, for the messages of each."""
        pager, out = self.pager(self.options_), []
        for c, n in sorted(end.items()):
            low = int(start.get(c, 0))
            if n > low:
                points = [low, *pager.cuts(c, low, int(n)), int(n)]
                out += [Stretch(c, a, b) for a, b in zip(points, points[1:])]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return read_back(self.pager(self.options_), partition)

    def commit(self, end: dict) -> None:
        pass  # the checkpoint keeps the offsets


class ChannelTable(DataSourceReader):
    """All messages that there are, a task for each stretch of a channel."""

    def __init__(self, pager: type[Pager], options: dict[str, str]):
        self.stream = ChannelStream(pager, options)

    def partitions(self) -> list[InputPartition]:
        return self.stream.partitions(self.stream.initialOffset(), self.stream.latestOffset())

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return self.stream.read(partition)


def channel_source(pager: type[Pager], title: str) -> type[DataSource]:
    """A data source, for batches and streams, of the messages on a pager's pages."""

    class Channels(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> StructType:
            return MESSAGE

        def reader(self, schema: StructType) -> DataSourceReader:
            return ChannelTable(pager, dict(self.options))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return ChannelStream(pager, dict(self.options))

    return Channels


def marks(messages: DataFrame) -> DataFrame:
    """channel, newest, oldest, n of the messages that were read."""
    return messages.groupBy("channel").agg(F.max("msg_id").alias("newest"), F.min("msg_id").alias("oldest"), F.count(F.lit(1)).alias("n"))
