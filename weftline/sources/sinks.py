"""Writers of results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def export_rows(resources: DataFrame) -> DataFrame:
    """Resources as flat rows of text that a spreadsheet can take, and that ``batch_csv`` reads again."""
    safe = lambda c: text.csv_safe(F.coalesce(F.col(c), F.lit("")))
    return resources.select(F.col("url").alias("链接"), F.coalesce("pwd", F.lit("")).alias("提取码"), safe("title").alias("标题"), "status", "score", F.array_join(F.slice("sources", 1, 3), "; ").alias("sources"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a mark of its encoding, by which spreadsheets know it: the first column's name begins with it."""
    marked = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    marked.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def frames(resources: DataFrame) -> DataFrame:
    """A row of JSON per resource, as a progress frame has them."""
    return resources.select(F.to_json(F.struct(*resources.columns)).alias("frame"))


def remark(status: Column, note: Column) -> Column:
    """What is said of a checked link."""
    return F.concat_ws(" · ", F.nullif(status, F.lit("")), F.nullif(note, F.lit("")))


def batch_rows(checked: DataFrame) -> DataFrame:
    """Checked links (url, pwd, title, status, note, checked_at) in the columns that ``batch_csv`` and ``batch_json`` read again."""
    safe = lambda c: text.csv_safe(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return checked.select(safe("url").alias("链接"), safe("pwd").alias("提取码"), safe("title").alias("标题"), F.col("status").alias("状态"), remark(F.col("status"), F.col("note")).alias("备注"))


def batch_document(checked: DataFrame) -> DataFrame:
    """One JSON object a line, of checked links, with the fields that a batch is read from."""
    return checked.select(F.to_json(F.struct("url", "pwd", "title", "status", "note"), {"ignoreNullFields": "false"}).alias("value"))


def append_log(spark: SparkSession, path: str, keyword: str, shown: int, at: str) -> None:
    """One more line of the log of searches."""
    spark.createDataFrame([(keyword, shown, at)], "kw string, shown bigint, at string").select("kw", "shown", F.to_timestamp("at").alias("ts")).coalesce(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The searches of last, each once: how often it was asked and when."""
    by = spark.read.parquet(path).groupBy("kw").agg(F.count(F.lit(1)).alias("times"), F.max("ts").alias("last_at"))
    return by.orderBy(F.desc("last_at"), "kw").limit(n)


def catalogue_lines(sites: DataFrame) -> DataFrame:
    """sites (name, domain, verticals, ...) as lines of JSON, which YAML is too, empty fields left out, by first vertical and domain."""
    some = []
    for name, kind in sites.dtypes:
        c = F.col(name)
        some.append((F.when(F.size(c) > 0, c) if kind.startswith("array") else F.nullif(c, F.lit("")) if kind == "string" else c).alias(name))
    rows = sites.select(F.coalesce(F.get("verticals", F.lit(0)), F.lit("")).alias("_first"), F.col("domain").alias("_domain"), F.to_json(F.struct(*some)).alias("line"))
    return rows.orderBy("_first", "_domain").select("line")


def write_text(spark: SparkSession, path: str, value: dict | list) -> None:
    """A small object as one file of JSON."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)
