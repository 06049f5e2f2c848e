"""Merged reports of sources, nested comments, direct links."""

import datetime
import json

from pyspark.sql import functions as F

from weftline.operators import catalog, liveness
from weftline.sources import captured


def test_merge_reports(spark):
    reports = [("a", 0, 3, 1.234, "ok", None), ("a", 1, 0, 9.0, "timeout", "late"), ("a", 2, 0, 2.0, "error", "later"), ("b", 0, 0, 1.0, "empty", None), ("b", 1, 0, 1.0, "error", "down"), ("c", 0, 1, 0.5, "ok", "")]
    got = catalog.merge_reports(spark.createDataFrame(reports, "source string, seq long, hits long, seconds double, status string, error string")).orderBy("source").collect()
    assert [tuple(r) for r in got] == [("a", 3, 9.0, "degraded", "late"), ("b", 0, 1.0, "error", "down"), ("c", 1, 0.5, "ok", None)]


def test_comments(spark):
    c = lambda t, *replies: {"content": {"message": t}, "member": {"uname": t.upper()}, "replies": list(replies) or None}
    deep = c("z")
    for _ in range(50):
        deep = c("y", deep)
    body = json.dumps({"data": {"replies": [c("a", c("b", c("c"))), None, deep], "top": c("t")}})
    got = spark.createDataFrame([(body,), ("no",), (None,)], "body string").select(captured.comment_texts("body").alias("c")).collect()
    assert [x.text for x in got[0].c] == ["t", "a", "b", "c", *["y"] * 50, "z"] and got[0].c[3].author == "C" and not got[1].c and not got[2].c


def test_direct(spark):
    rows = spark.createDataFrame([("k", None, "direct", 0, ""), ("o", None, "other", 0, "")], "key string, pwd string, endpoint string, http_status int, body string")
    assert {r.key: r.status for r in liveness.decide(rows, F.lit(datetime.datetime(2024, 1, 1))).collect()} == {"k": "alive", "o": "unsupported"}
