"""Pages: URLs, titles, links, shapes, sites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import html, text, urls
from ..session import ship, table
from . import views
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
HREFS = "list_distinct(regexp_extract_all(html, 'href=[\"'']((?:/)[^\"''#? ]*)', 1))"
SKIP = " OR ".join(f"contains(lower(p), '{s}')" for s in X.SKIP_PATHS)


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@R.add(f"SELECT page_id, {HOST} AS host, {PATH} AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM pages")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.fragment(u).alias("fragment"))


@R.add(f"SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS normal, 'other:' || {HOST} || rtrim({PATH}, '/') AS key FROM pages")
def url_normalise(spark, sf_dir):
    u, kind, none = F.col("url"), F.lit("other"), F.lit(None).cast("string")
    return pages(spark, sf_dir).select("page_id", urls.canonical(kind, u, none).alias("normal"), urls.resource_key(kind, u, none).alias("key"))


@R.add(f"SELECT page_id, list_last(string_split(rtrim({PATH}, '/'), '/')) AS id, regexp_extract(url, '[?&]page=([^&#]+)', 1) AS page FROM pages")
def path_ids(spark, sf_dir):
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", urls.path_id(u).alias("id"), F.coalesce(urls.query_value(u, "page"), F.lit("")).alias("page"))


@R.add(f"""WITH p AS (SELECT page_id, {HOST} AS host, {PATH} AS path FROM pages) SELECT page_id, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM p WHERE path NOT IN ('', '/') AND NOT (host = 'spam-farm.example.org' OR host LIKE '%.spam-farm.example.org')) WHERE rn <= 2""")
def host_cap2(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    noise = (F.col("host") == "spam-farm.example.org") | F.col("host").endswith(".spam-farm.example.org")
    own = Window.partitionBy("host").orderBy("page_id")
    return rows.filter(~F.col("path").isin("", "/") & ~noise).withColumn("rn", F.row_number().over(own)).filter("rn <= 2").select("page_id", "host")


TITLE = "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', '', 'g')"
for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):  # those that the pages have
    TITLE = f"replace({TITLE}, '{entity}', '{sign}')"


@R.add(f"SELECT page_id, nullif(trim({TITLE}), '') AS title FROM pages")
def page_title(spark, sf_dir):
    ship(spark)
    return pages(spark, sf_dir).select("page_id", html.title(F.col("html")).alias("title"))


@R.add(f"SELECT page_id, len({HREFS}) AS n, array_to_string(list_sort({HREFS}), ' ') AS links FROM pages")
def local_links(spark, sf_dir):
    links = html.local_links(F.col("html"))
    return pages(spark, sf_dir).select("page_id", F.size(links).cast("long").alias("n"), F.array_join(F.array_sort(links), " ").alias("links"))


@R.add(f"""SELECT page_id, len(list_filter({HREFS}, lambda p: (regexp_matches(p, '/[0-9]{{3,}}') OR regexp_matches(lower(p), '[.]html?$') OR regexp_matches(lower(p), '/(post|article|archives?|thread|read|book|game|movie|music|download)/')) AND NOT ({SKIP}))) AS n FROM pages""")
def detail_links(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.size(html.detail_links(F.col("html"), X.SKIP_PATHS)).cast("long").alias("n"))


@R.add("""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>|</p>|</div>|</li>|</h[1-6]>', chr(10), 'g'), '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g')) AS digest FROM pages""")
def html_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.md5(html.text_unescaped(F.col("html")).cast("binary")).alias("digest"))


@R.add()
def html_text_unescaped(spark, sf_dir):
    ship(spark)
    return pages(spark, sf_dir).select("page_id", html.text(F.col("html")).alias("text"))


LOW = "lower(p)"
BODY = f"regexp_replace({LOW}, '[.](html?|php|aspx?|jsp)$', '')"
SHAPE = f"""replace(replace(regexp_replace(regexp_replace(regexp_replace({BODY}, '[a-z][a-z0-9_-]*', chr(2), 'g'), '[0-9]+', chr(1), 'g'), '([.^$*+?{{}}\\[\\]|()&~#\\- ])', '\\\\\\1', 'g'), chr(1), '\\d+'), chr(2), '[a-z0-9_-]+') || replace(regexp_extract({LOW}, '[.](?:html?|php|aspx?|jsp)$', 0), '.', '\\.')"""
SHAPES = f"""links AS (SELECT DISTINCT {HOST} AS site, p FROM (SELECT url, unnest({HREFS}) AS p FROM pages)),
shapes AS (SELECT site, {SHAPE} AS shape, count(*) AS n FROM links WHERE regexp_matches(lower(p), '[a-z0-9]') GROUP BY 1, 2),
liked AS (SELECT *, CASE WHEN contains(shape, '.html') OR contains(shape, '.htm') OR contains(shape, '.php') THEN 3 ELSE 0 END + CASE WHEN contains(shape, '_') THEN 2 ELSE 0 END + CASE WHEN contains(shape, '\\d') THEN 1 ELSE 0 END
 + CASE WHEN length(shape) - length(replace(shape, '/', '')) >= 4 THEN 1 ELSE 0 END AS likeness FROM shapes)"""


@R.add(f"WITH {SHAPES} SELECT site, shape, n, likeness FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY likeness DESC, n DESC, shape) AS rn FROM liked) WHERE rn <= 3")
def path_shapes_topk(spark, sf_dir):
    links = pages(spark, sf_dir).select(urls.host(F.col("url")).alias("site"), F.explode(html.local_links(F.col("html"))).alias("p")).distinct()
    shapes = links.select("site", urls.path_shape(F.col("p")).alias("shape")).filter("shape is not null").groupBy("site", "shape").agg(F.count(F.lit(1)).alias("n"))
    liked = shapes.withColumn("likeness", urls.detail_likeness(F.col("shape")))
    best = Window.partitionBy("site").orderBy(F.desc("likeness"), F.desc("n"), "shape")
    return liked.withColumn("rn", F.row_number().over(best)).filter("rn <= 3").drop("rn")


@R.add(f"""WITH s AS (SELECT {HOST} AS site, page_id, len({HREFS}) AS links FROM pages) SELECT site, CAST(sum(links) AS BIGINT) AS yield FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS rn FROM s) WHERE rn <= 4 GROUP BY 1""")
def link_yield(spark, sf_dir):
    rows = pages(spark, sf_dir).select(urls.host(F.col("url")).alias("site"), "page_id", F.size(html.local_links(F.col("html"))).alias("links"))
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("site").orderBy("page_id"))).filter("rn <= 4")
    return first.groupBy("site").agg(F.sum("links").alias("yield"))


@R.add(f"SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || p AS link FROM (SELECT page_id, url, unnest({HREFS}) AS p FROM pages) WHERE regexp_matches(p, '^/[a-z]{{4,}}$')")
def detail_urls(spark, sf_dir):
    rows = pages(spark, sf_dir).select("page_id", "url", F.explode(html.local_links(F.col("html"))).alias("p")).filter(F.col("p").rlike("^/[a-z]{4,}$"))
    return rows.select("page_id", html.absolute(F.col("url"), F.col("p")).alias("link"))


@R.add("""SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/]*(com|net)[/?#]') THEN 'general' ELSE 'other' END AS route, replace('https://search.example/?q={q}', '{q}', 'page%20' || CAST(page_id AS VARCHAR)) AS template FROM pages""")
def search_templates(spark, sf_dir):
    route = F.when(urls.host(F.col("url")).rlike("(com|net)$"), "general").otherwise("other")
    term = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    return pages(spark, sf_dir).select("page_id", route.alias("route"), urls.expand_template(F.lit("https://search.example/?q={q}"), term).alias("template"))


@R.add("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 THEN 'https://api.example/' || json_extract_string(props, '$.k') END AS link FROM events""")
def json_paths(spark, sf_dir):
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    rows = table(spark, sf_dir, "events").select("event_id", k.alias("k"))
    return rows.withColumn("link", F.when(F.col("k") % 2 == 0, F.concat(F.lit("https://api.example/"), F.col("k").cast("string"))))


LINE = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@R.add(f"""SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 79) || '…' ELSE t END AS short FROM (SELECT doc_id, {LINE} AS t FROM documents)""")
def truncate_notes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.shorten(F.coalesce("text", F.lit("")), 80).alias("short"))


@R.add(f"""WITH p AS (SELECT doc_id, {LINE} AS t FROM documents), q AS (SELECT doc_id, t, CASE WHEN contains(lower(t), 'the') THEN position('the' IN lower(t)) WHEN contains(lower(t), 'of') THEN position('of' IN lower(t)) ELSE 1 END AS hit FROM p),
r AS (SELECT doc_id, t, greatest(1, least(hit - 30, length(t) - 60 + 1)) AS st FROM q) SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE CASE WHEN st > 1 THEN '…' ELSE '' END || substr(t, st, 60) || CASE WHEN st + 59 < length(t) THEN '…' ELSE '' END END AS excerpt FROM r""")
def excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), F.array(F.lit("the"), F.lit("of")), 60).alias("excerpt"))


@R.add("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '''=x' || CAST(doc_id AS VARCHAR) ELSE 'x' || CAST(doc_id AS VARCHAR) END AS safe, CASE WHEN doc_id % 5 = 0 THEN '=x' ELSE 'x' END || CAST(doc_id AS VARCHAR) AS back FROM documents""")
def csv_guard(spark, sf_dir):
    cell = F.concat(F.when(F.col("doc_id") % 5 == 0, "=x").otherwise("x"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", text.csv_safe(cell).alias("safe"), text.csv_plain(text.csv_safe(cell)).alias("back"))


#: Result pages: a page's own address, others of its host, and what isn't worth reading.
RESULTS = """SELECT page_id, own, concat('<a href="', url, '">https://www.google.com/x https://box.com/a https://x.com/b https://cdn.', own, '/a.CSS https://', own, '/1 https://', own, '/2 https://', own, '/3 https://mp.weixin.qq.com/s/1 https://pan.baidu.com/s/1 https://', own, '。') AS html
 FROM (SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS own FROM pages) x"""


@R.add("""WITH p AS (SELECT page_id, regexp_extract(url, '^[^?,;!]*', 0) AS u, regexp_extract(url, '://([^/?#]+)', 1) AS own, regexp_extract(regexp_extract(url, '^[^?,;!]*', 0), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT page_id, CASE WHEN replace(path, '/', '') <> '' AND regexp_matches(u, '^https?://') THEN [u] ELSE [] END AS first, own FROM p)
SELECT page_id, array_to_string(list_concat(list_concat(first, ['https://box.com/a', 'https://' || own || '/1']), CASE WHEN len(first) = 0 THEN ['https://' || own || '/2', 'https://mp.weixin.qq.com/s/1'] ELSE ['https://mp.weixin.qq.com/s/1'] END), ' ') AS links FROM c""")
def pages_worth_reading(spark, sf_dir):
    """Pages of a results page that are worth reading, two of a host."""
    return views.view(spark, sf_dir, RESULTS, "pages").select("page_id", F.array_join(html.candidate_pages(F.col("html")), " ").alias("links"))
