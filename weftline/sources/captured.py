"""Readers of captured answers: aggregator payloads, API payloads, message pages, channel lists, batches of links.

Nothing here asks the network: pages and payloads are rows that someone captured.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions import links
from ..functions.text import csv_plain

MESSAGE = StructType([StructField("channel", StringType()), StructField("msg_id", LongType()), StructField("posted_at", StringType()), StructField("text", StringType()), StructField("links", links.SCHEMA)])
#: Characters of a message's text that are kept.
TEXT_LIMIT = 4000


def merged_payload(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Aggregator payloads {"merged_by_type": {type: [{url, password, note, source, datetime}]}} -> hits in order."""
    item = "struct<url:string,password:string,note:string,source:string,datetime:string>"
    parsed = F.from_json(F.get_json_object(column, "$.merged_by_type"), f"map<string,array<{item}>>")
    by_type = payloads.select(F.explode(parsed).alias("pan_type", "items"))
    rows = by_type.select("pan_type", F.posexplode("items").alias("rank", "i"))
    kind = F.when(F.col("i.source").startswith("tg:"), "tg").otherwise("aggregator")
    return rows.filter(F.col("i.url").isNotNull()).select(F.col("i.source").alias("source"), kind.alias("kind"), "i.url", F.nullif(F.col("i.password"), F.lit("")).alias("pwd"), F.col("i.note").alias("title"), parse_time(F.col("i.datetime")).alias("shared_at"), "rank")


def parse_time(text: Column) -> Column:
    """ISO, ``yyyy-MM-dd HH:mm:ss``, ``yyyy-MM-dd`` or ``yyyy/MM/dd``; null if it is none of them."""
    return F.coalesce(F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd")))


def api_items(payloads: DataFrame, items: str, link: str, title: str, column: str = "body", template: str | None = None) -> DataFrame:
    """JSON payloads by configured paths: the array at ``items``, and ``link`` and ``title`` in each; a template replaces {id} by the link's value. Only http(s) links stay."""
    array = F.expr(f"try_variant_get(try_parse_json({column}), '{items}', 'array<variant>')")
    rows = payloads.select(F.posexplode(array).alias("rank", "v"))
    value = F.expr(f"try_variant_get(v, '{link}', 'string')")
    url = F.replace(F.lit(template), F.lit("{id}"), value) if template else value
    out = rows.select("rank", F.when(value.isNotNull(), url).alias("url"), F.expr(f"try_variant_get(v, '{title}', 'string')").alias("title"))
    return out.filter(F.col("url").rlike("^https?://"))


def xml_items(payloads: DataFrame, item: str, link: str, title: str, column: str = "body") -> DataFrame:
    """XML payloads by tag names."""
    one = lambda tag: F.regexp_extract("item", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1)
    rows = payloads.select(F.posexplode(F.regexp_extract_all(column, F.lit(rf"(?s)<{item}[ >].*?</{item}>"), F.lit(0))).alias("rank", "item"))
    return rows.select("rank", F.trim(one(link)).alias("url"), F.trim(one(title)).alias("title")).filter(F.col("url").rlike("^https?://"))


_BLOCK = re.compile(r'data-post="([^"/]+)/(\d+)"(.*?)(?=data-post="|\Z)', re.S)


def parse_messages(page: str | None, channel: str) -> list[dict]:
    """The messages of a channel's page; the channel that was asked for gives its name to them.

    Links come from the whole text, and from the whole block where the text has none; what has neither is left out.
    """
    out = []
    for m in _BLOCK.finditer(page or ""):
        body = re.search(r'<div class="[^"]*message_text[^"]*"[^>]*>(.*?)</div>', m[3], re.S)
        raw = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<br\s*/?>", "\n", body[1])) if body else ""
        hrefs = " ".join(re.findall(r'href="(https?://[^"]+)"', body[1])) if body else ""
        text = entities.unescape(raw).strip()
        found = links.find(text + " " + entities.unescape(hrefs)) or links.find_any(m[3])
        if not text and not found:
            continue
        when = re.search(r'datetime="([^"]+)"', m[3])
        out.append({"channel": channel, "msg_id": int(m[2]), "posted_at": when[1] if when else None, "text": text[:TEXT_LIMIT], "links": found})
    return out


def message_pages(pages: DataFrame) -> DataFrame:
    """pages (channel, html) -> messages, in Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [m for c, h in zip(f["channel"], f["html"]) for m in parse_messages(h, c)]
            yield pd.DataFrame(rows, columns=MESSAGE.names)

    return pages.select("channel", "html").mapInPandas(run, MESSAGE)


def parse_comments(body: str | None) -> list[dict]:
    """The texts of a comments payload with their authors: pinned, top and plain ones, each followed by the replies to it, however deep."""
    try:
        data = json.loads(body or "")
    except ValueError:
        return []
    data = data.get("data") if isinstance(data, dict) else None
    many = lambda v: [v] if isinstance(v, dict) else v if isinstance(v, list) else []
    tops = [c for k in ("top", "top_replies", "replies") for c in many(data.get(k))] if isinstance(data, dict) else []
    out, stack = [], tops[::-1]
    while stack:
        c = stack.pop()
        if not isinstance(c, dict):
            continue
        content, member = c.get("content"), c.get("member")
        text = content.get("message") if isinstance(content, dict) else None
        if text:
            out.append({"text": str(text), "author": str(member.get("uname") or "") if isinstance(member, dict) else ""})
        stack += many(c.get("replies"))[::-1]
    return out


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("author", StringType())])))
def comment_texts(bodies: pd.Series) -> pd.Series:
    return bodies.map(parse_comments)


def channel_list(spark: SparkSession, path: str) -> DataFrame:
    """Names, one a line: comments and blank lines dropped, ``@`` and link forms stripped, invitations left out, once each."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    name = F.regexp_replace(F.trim(F.regexp_replace("value", "#.*$", "")), r"^(?:https?://)?(?:t\.me/(?:s/)?)?@?", "")
    rows = lines.select("seq", name.alias("channel")).filter(F.col("channel").rlike(r"^[A-Za-z][A-Za-z0-9_]{3,}$"))
    return rows.groupBy("channel").agg(F.min("seq").alias("seq")).orderBy("seq").select("channel")


def batch_json(spark: SparkSession, text: str) -> DataFrame:
    """A batch as JSON: a list, or an object with ``results``, of links or of rows with one of the known column names."""
    body = spark.createDataFrame([(text,)], "body string")
    doc = F.try_parse_json("body")
    array = F.coalesce(F.try_variant_get(doc, "$.results", "array<variant>"), F.try_variant_get(doc, "$", "array<variant>"))
    rows = body.select(F.posexplode(array).alias("line", "v"))
    get = lambda *names: F.coalesce(*(F.try_variant_get("v", f"$['{n}']", "string") for n in names))
    return rows.select("line", F.coalesce(get("url", "链接"), F.try_variant_get("v", "$", "string")).alias("url"), get("pwd", "提取码").alias("pwd"), get("title", "标题").alias("title")).filter("url is not null")


def batch_csv(spark: SparkSession, path: str) -> DataFrame:
    """A batch as CSV with the columns 链接, 提取码 and perhaps 标题, or url, pwd and title; guards against formulas are undone."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    named = rows.select(*(F.col(f"`{c}`").alias({"链接": "url", "提取码": "pwd", "标题": "title"}.get(c.lstrip("﻿"), c.lstrip("﻿"))) for c in rows.columns))
    missing = {"url", "pwd"} - set(named.columns)
    if missing:
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    texts = [csv_plain(F.col(c)).alias(c) if c in ("url", "pwd", "title") else F.col(c) for c in named.columns]
    return named.select(*texts).filter(F.trim("url") != "")


def sniff(text: str) -> str:
    """json, csv or text, by content."""
    head = text.lstrip("﻿ \t\r\n")
    first = head.partition("\n")[0]
    if head[:1] in "[{" and head[:1]:
        return "json"
    return "csv" if {"链接", "提取码"} <= set(first.strip().split(",")) or {"url", "pwd"} <= set(first.strip().split(",")) else "text"


@F.pandas_udf(StringType())
def decode(raw: pd.Series) -> pd.Series:
    """Bytes in UTF-8, with or without a mark, else in GB 18030; what isn't in that either is replaced."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("utf-8-sig")
        except UnicodeDecodeError:
            return bytes(b).decode("gb18030", "replace")

    return raw.map(one)


class SqliteSource(DataSource):
    """A table of an SQLite file (options path, table, and partitions, by rowid): spark.read.format("weftline_sqlite")."""

    @classmethod
    def name(cls) -> str:
        return "weftline_sqlite"

    def schema(self) -> str:
        import sqlite3

        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            info = db.execute(f"PRAGMA table_info({self.options['table']})").fetchall()
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in info)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema.names)


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.options_, self.names = options, names

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(int(self.options_.get("partitions", "1")))]

    def read(self, partition: InputPartition):
        import sqlite3

        n = int(self.options_.get("partitions", "1"))
        columns = ", ".join(f'"{c}"' for c in self.names)
        with sqlite3.connect(f"file:{self.options_['path']}?mode=ro", uri=True) as db:
            yield from db.execute(f"SELECT {columns} FROM {self.options_['table']} WHERE rowid % ? = ?", (n, partition.value))
