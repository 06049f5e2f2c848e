"""Payloads of JSON, XML and HTML sources by rows of a configuration."""

import pytest
from pyspark.sql import functions as F

from weftline.sources import configured

ITEM = '{"id": 7, "attributes": {"title": {"en": "T"}}, "names": ["", null, "N", "M"], "many": [{"x": ""}, {"x": ["", "deep"]}, {"x": "later"}], "zero": 0, "none": null, "flag": false, "a b": "s p", "list": [[1, 2], 3], "o": {"k": 1}}'


@pytest.mark.parametrize(
    ("path", "found"),
    [
        ("attributes.title.en", "T"), ("names", "N"), ("names.2", "N"), ("names.9", None), ("many.x", "deep"), ("many.2.x", "later"), ("zero", "0"), ("none", None), ("flag", "false"), ("a b", "s p"), ("missing.x", None),
        ("id.x", None), ("", None), (None, None), ("o", '{"k":1}'), ("many.y", None),
    ],
)
def test_dig(spark, path, found):
    rows = spark.createDataFrame([(ITEM, path)], "j string, p string")
    assert rows.select(configured._text(configured.dig(F.parse_json("j"), F.col("p"))).alias("x")).first().x == found


@pytest.mark.parametrize(("body", "path", "n"), [('{"message": {"items": [1, 2, 3]}}', "message.items", 3), ("[1, 2]", "$", 2), ('{"a": 1}', "$", 0), ('{"a": {"b": 1}}', "a", 1), ('{"a": {}}', "a", 0), ('[{"r": [1, 2]}]', "0.r", 2), ('[{"r": 1}]', "r", 0), ('{"a": 1}', "", 0), ('{"a": []}', "a", 0), ("{", "a", 0)])
def test_dig_list(spark, body, path, n):
    rows = spark.createDataFrame([(body, path)], "j string, p string")
    assert (rows.select(F.size(configured.dig_list(F.try_parse_json("j"), F.col("p"))).alias("x")).first().x or 0) in (n, -1 if n == 0 else n)


CONFIG = [
    ("crossref", "json", "message.items", "URL", "title", None, None, None), ("dex", None, "data", None, "attributes.title.en", "https://dex.org/title/{id}/{attributes.slug}", None, None),
    ("arxiv", "xml", "entry", "id", "title", None, None, None), ("gutenberg", "html", None, None, None, None, r'<a href="(/ebooks/\d+)">[^<]*</a>', "https://g.org"), ("plain", "HTML", None, None, None, None, r"https://p\.org/\w+", None),
]
PAYLOADS = [
    ("crossref", 1, '{"message": {"items": [{"URL": "https://doi.org/1", "title": ["", "One"]}, {"URL": "ftp://x", "title": "no"}, {"title": "no link"}, {"URL": "http://doi.org/2"}]}}'),
    ("dex", 2, '{"data": [{"id": "a b/c", "attributes": {"title": {"en": " x "}, "slug": 5}}, {"id": "z", "attributes": {}}, {"id": "", "attributes": {"slug": 1}}]}'),
    ("arxiv", 3, "<feed><entry><id>https://arxiv.org/1</id><title type='t'>A &amp; <b>B</b></title></entry><Entry><id>no</id></Entry><entry><ID>http://arxiv.org/2</ID></entry></feed>"),
    ("gutenberg", 4, '<a href="/ebooks/1">Alice &amp; <a href="/ebooks/2">Two\n  lines</a><a href="/ebooks/2">again</a>'), ("plain", 5, "see https://p.org/x and https://p.org/x, HTTPS://P.ORG/y"),
    ("crossref", 6, "not json"), ("unknown", 7, "{}"), ("arxiv", 8, None),
]


def test_read(spark):
    config = spark.createDataFrame(CONFIG, configured.CONFIG)
    got = configured.read(spark.createDataFrame(PAYLOADS, "source string, seq long, body string"), config).collect()
    assert sorted(((r.seq, r["rank"], r.url, r.title) for r in got), key=str) == sorted(
        [
            (1, 0, "https://doi.org/1", "One"), (1, 3, "http://doi.org/2", None), (2, 0, "https://dex.org/title/a%20b/c/5", "x"), (3, 0, "https://arxiv.org/1", "A & B"), (3, 2, "http://arxiv.org/2", None),
            (4, 0, "https://g.org/ebooks/2", "Two lines"), (5, 0, "https://p.org/x", "https://p.org/x"), (5, 1, "HTTPS://P.ORG/y", "HTTPS://P.ORG/y"),
        ], key=str,
    )
    assert configured.read(spark.createDataFrame([], "source string, seq long, body string"), config).count() == 0
