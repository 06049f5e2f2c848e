"""Answers decided by rows of a table."""

from pyspark.sql import functions as F

from weftline.operators import liveness

ROWS = [
    (1, "aliyun", 404, '{"code":"NotFound.ShareLink"}', "not_found"), (2, "aliyun", 404, "", "not_found"), (3, "aliyun", 500, "{}", "unknown"), (4, "aliyun", None, None, "alive"), (5, "aliyun", 200, '{"expiration":"2020-01-01T00:00:00Z"}', "dead"),
    (6, "aliyun", 200, '{"expiration":"2090-01-01"}', "alive"), (7, "aliyun", 200, '{"code":"x.Cancelled"}', "dead"), (8, "115", 200, '{"state":false,"errno":990002}', "not_found"), (9, "115", 200, '{"state":false}', "not_found"), (10, "115", 200, "<html>", "unknown"),
    (11, "tianyi", 400, "<code>ShareInfoInvalid</code>", "dead"), (12, "tianyi", 400, "", "not_found"), (13, "quark", 404, '{"code":0}', "not_found"), (14, "quark", 200, '{"code":5,"status":200}', "alive"), (15, "direct", None, None, "alive"), (16, "else", 200, "{}", "unsupported"), (17, None, 200, "{}", "unsupported"),
]


def frame(spark):
    return spark.createDataFrame([r[:4] for r in ROWS], "key int, endpoint string, http_status int, body string")


def test_default_rules(spark):
    got = liveness.decide(frame(spark), F.lit("2024-01-01").cast("timestamp"))
    assert got.columns == ["key", "endpoint", "http_status", "body", "status"] and {r.key: r.status for r in got.collect()} == {r[0]: r[4] for r in ROWS}


def test_rules_in_order(spark):
    """The first that holds; an answer that none fits is unknown; what is not there equals nothing."""
    rules = [("a", 1, "$.x", "is", "1", "alive"), ("a", 0, "body", "has", "stop", "dead"), ("a", 2, "$.x", "not", "1", "wrong_pwd"), ("a", 3, "when", "past", None, "not_found")]
    rows = spark.createDataFrame([(1, "a", 200, '{"x":1}'), (2, "a", 200, '{"x":1,"y":"stop"}'), (3, "a", 200, '{"x":2}'), (4, "a", 200, "{}"), (5, "a", 200, "<when>2020-01-01</when>")], "key int, endpoint string, http_status int, body string")
    got = liveness.decide(rows, F.lit("2024-01-01").cast("timestamp"), rules=spark.createDataFrame(rules, liveness.RULES)).collect()
    assert {r.key: r.status for r in got} == {1: "alive", 2: "dead", 3: "wrong_pwd", 4: "unknown", 5: "not_found"}
