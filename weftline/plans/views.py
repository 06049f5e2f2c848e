"""Projections of the driver's tables to the engine's row shapes, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

HITS = """SELECT doc_id AS seq, source,
 CASE doc_id % 4 WHEN 0 THEN 'tg' WHEN 1 THEN 'forum' WHEN 2 THEN 'api' ELSE 'websearch' END AS kind,
 concat('https://pan.quark.cn/s/k', CAST(doc_id % 400 AS VARCHAR(20))) AS url,
 CASE WHEN doc_id % 3 = 0 THEN lpad(CAST(doc_id % 10000 AS VARCHAR(20)), 4, '0') END AS pwd,
 substr(text, 1, 60) AS title, CASE WHEN doc_id % 7 = 0 THEN concat(CAST(doc_id % 50 AS VARCHAR(20)), ' MB') END AS size,
 CAST(NULL AS TIMESTAMP) AS shared_at, concat('o', CAST(doc_id % 13 AS VARCHAR(20))) AS origin,
 (doc_id % 5 = 0) AS relaxed, CASE WHEN doc_id % 5 = 0 THEN 'rest' ELSE concat('q', CAST(doc_id % 3 AS VARCHAR(20))) END AS query,
 doc_id % 97 AS rank
 FROM documents"""

#: Hits of several providers.
MIXED_HITS = """SELECT doc_id AS seq, source, CASE doc_id % 4 WHEN 0 THEN 'tg' WHEN 1 THEN 'forum' WHEN 2 THEN 'api' ELSE 'websearch' END AS kind,
 CASE doc_id % 6 WHEN 0 THEN concat('https://pan.baidu.com/s/1T', CAST(doc_id % 90 AS VARCHAR(20)), '?pwd=', lpad(CAST(doc_id % 10000 AS VARCHAR(20)), 4, '0'))
 WHEN 1 THEN concat('https://pan.quark.cn/s/k', CAST(doc_id % 80 AS VARCHAR(20)), '#', lpad(CAST(doc_id % 10000 AS VARCHAR(20)), 4, '0'))
 WHEN 2 THEN concat('magnet:?xt=urn:btih:', upper(md5(CAST(doc_id % 70 AS VARCHAR(20)))), '&dn=name')
 WHEN 3 THEN concat('https://www.alipan.com/s/a', CAST(doc_id % 60 AS VARCHAR(20)), '?x=1') WHEN 4 THEN concat('https://example.com/s/', CAST(doc_id AS VARCHAR(20)))
 ELSE concat('https://www.123pan.com/s/z', CAST(doc_id % 50 AS VARCHAR(20))) END AS url,
 CASE WHEN doc_id % 7 = 0 THEN 'own1' END AS pwd, substr(text, 1, 60) AS title, CASE WHEN doc_id % 7 = 0 THEN concat(CAST(doc_id % 50 AS VARCHAR(20)), ' MB') END AS size,
 CAST(NULL AS TIMESTAMP) AS shared_at, concat('o', CAST(doc_id % 13 AS VARCHAR(20))) AS origin, (doc_id % 5 = 0) AS relaxed, CASE WHEN doc_id % 5 = 0 THEN 'rest' ELSE concat('q', CAST(doc_id % 3 AS VARCHAR(20))) END AS query,
 doc_id % 97 AS rank FROM documents"""

#: Cached states by user, one key each: tables of states grow with the events.
STATES = """SELECT CAST(user_id AS VARCHAR(20)) AS cache_key, CAST(NULL AS VARCHAR(10)) AS pwd,
 CASE event_type WHEN 'signup' THEN 'alive' WHEN 'view' THEN 'need_pwd' WHEN 'click' THEN 'wrong_pwd' WHEN 'error' THEN 'dead' ELSE 'unknown' END AS status,
 ts AS checked_at, event_id FROM events"""

#: The same for the keys of hits.
CACHE = """SELECT concat('quark:pan.quark.cn/s/k', CAST(user_id % 400 AS VARCHAR(20))) AS cache_key, CAST(NULL AS VARCHAR(10)) AS pwd,
 CASE event_type WHEN 'signup' THEN 'alive' WHEN 'view' THEN 'need_pwd' WHEN 'click' THEN 'wrong_pwd' WHEN 'error' THEN 'dead' ELSE 'unknown' END AS status,
 ts AS checked_at, event_id, (event_id % 2 = 0) AS pwd_verified, CAST(NULL AS VARCHAR(10)) AS title_hint FROM events"""

RUNS = """SELECT CAST(user_id % 20 AS VARCHAR(20)) AS domain, ts AS run_at, event_id,
 CASE WHEN event_type IN ('signup', 'view') THEN 1 ELSE 0 END AS hits, CASE WHEN event_type = 'error' THEN 'E' END AS error FROM events"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A view's rows; the tables are handed over by name, so sessions and folders don't mix."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables})


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, HITS, "documents")


def mixed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, MIXED_HITS, "documents")


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CACHE, "events")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, STATES, "events")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RUNS, "events")
