"""Pages of channels as a stream: each message once, through restarts, replays and pages that overlap."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftline.sources import channels
from weftline.sources.channels import Pager, Stretch, channel_source, read_back


def page(channel, ids):
    posts = "".join(f'<div data-post="{channel}/{i}"><div class="tgme_widget_message_text">m{i} https://pan.quark.cn/s/k{i}</div><time datetime="2024-01-01T00:00:00+00:00"></time></div>' for i in ids)
    return f"<html>{posts}</html>"


def stored(spark, path, pages):
    channels.store_pages(spark.createDataFrame([(c, page(c, ids)) for c, ids in pages], "channel string, html string"), path)


def run(spark, tmp_path, sink):
    source = channel_source(channels.StoredPages, "weftline_stored_channels")
    spark.dataSource.register(source)
    stream = spark.readStream.format("weftline_stored_channels").option("path", f"file://{tmp_path}/pages").load()
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_restarts(spark, tmp_path):
    """Three runs from one checkpoint: what is there, nothing, and what came since, of which one page overlaps."""
    got = []
    keep = lambda batch, n: got.append([(r.channel, r.msg_id, r.links[0].url) for r in batch.collect()])
    stored(spark, f"file://{tmp_path}/pages", [("a", range(1, 6)), ("a", range(6, 9)), ("b", [3, 7]), ("none", [])])
    run(spark, tmp_path, keep)
    first = [x for b in got for x in b]
    assert sorted(first) == [(c, i, f"https://pan.quark.cn/s/k{i}") for c, ids in (("a", range(1, 9)), ("b", [3, 7])) for i in ids]
    run(spark, tmp_path, keep)
    assert [x for b in got for x in b] == first
    stored(spark, f"file://{tmp_path}/pages", [("a", range(7, 12)), ("c", [1])])
    run(spark, tmp_path, keep)
    assert sorted(x[:2] for b in got for x in b) == sorted([(c, i) for c, i, _ in first] + [("a", 9), ("a", 10), ("a", 11), ("c", 1)])


def test_failed_batch_is_read_again(spark, tmp_path):
    stored(spark, f"file://{tmp_path}/pages", [("a", range(1, 6))])
    seen = []

    def dies(batch, n):
        seen.append(sorted(r.msg_id for r in batch.collect()))
        if len(seen) == 1:
            raise RuntimeError("the sink died")

    with pytest.raises(Exception):
        run(spark, tmp_path, dies)
    stored(spark, f"file://{tmp_path}/pages", [("a", range(6, 8))])
    run(spark, tmp_path, dies)
    run(spark, tmp_path, dies)
    assert seen[0] == seen[1] == [1, 2, 3, 4, 5] and sorted(x for b in seen[1:] for x in b) == [1, 2, 3, 4, 5, 6, 7]


def test_batch_twin(spark, tmp_path):
    stored(spark, f"file://{tmp_path}/pages", [("a", range(1, 40)), ("a", range(40, 45)), ("b", [5])])
    spark.dataSource.register(channel_source(channels.StoredPages, "weftline_stored_channels"))
    rows = spark.read.format("weftline_stored_channels").option("path", f"file://{tmp_path}/pages").option("marks", '{"a": 30}').load()
    assert sorted((r.channel, r.msg_id) for r in rows.collect()) == [("a", i) for i in range(31, 45)] + [("b", 5)]
    assert {(r.channel, r.newest, r.oldest, r.n) for r in channels.marks(rows).collect()} == {("a", 44, 31, 14), ("b", 5, 5, 1)}


class Flaky(Pager):
    """A pager of one's own: pages of ten; every other request fails; what is out of range falls back to the newest page."""

    asked = 0

    def newest(self):
        return {"x": 95}

    def page(self, channel, before):
        Flaky.asked += 1
        if Flaky.asked % 2:
            raise OSError("connection reset")
        top = min(before - 1, 95) if before > 20 else 95
        return page(channel, range(top, max(top - 10, 19), -1))


def test_retries_and_the_end():
    """A request is made twice; a page that goes no further back is the channel's end."""
    assert [m[1] for m in read_back(Flaky({}), Stretch("x", 0, 95))] == list(range(95, 19, -1))
    assert [m[1] for m in read_back(Flaky({}), Stretch("x", 90, 95))] == [95, 94, 93, 92, 91]

    class Dead(Flaky):
        def page(self, channel, before):
            raise OSError("gone")

    with pytest.raises(OSError):
        list(read_back(Dead({}), Stretch("x", 0, 95)))


def test_another_source(spark):
    """A source of another kind is a class more."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
    spark.dataSource.register(channel_source(Flaky, "weftline_flaky"))
    rows = spark.read.format("weftline_flaky").option("marks", '{"x": 93}').load()
    assert sorted(r.msg_id for r in rows.select("msg_id", F.size("links").alias("n")).collect()) == [94, 95]


def test_stretches_and_row_groups(spark, tmp_path, monkeypatch):
    """A long channel is read by several tasks, each message once, as one task reads it; a page's row group is read about once."""
    monkeypatch.setattr(channels, "RUN_BYTES", 1 << 10)
    path, told = f"file://{tmp_path}/pages", []
    for start in (1, 11):  # two captures, which overlap
        stored(spark, path, [("a", range(k, k + 20)) for k in range(start, 8000, 40)])
    stream = channels.ChannelStream(channels.StoredPages, {"path": path})
    parts = stream.partitions({}, stream.latestOffset())
    assert len(parts) > 2
    whole = list(read_back(channels.StoredPages({"path": path}), Stretch("a", 0, parts[-1].upto)))
    assert sorted(m for p in parts for m in stream.read(p)) == sorted(whole) and len({m[1] for m in whole}) == len(whole)
    pager = channels.StoredPages({"path": path})
    bounds = pager._bounds
    monkeypatch.setattr(pager, "_bounds", lambda *a: told.append(a) or bounds(*a))
    list(read_back(pager, Stretch("a", 0, parts[-1].upto)))
    assert len(told) == 1  # footers once, not for every page
