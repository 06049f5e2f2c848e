"""Upkeep, federation, evaluation of whole runs, and extraction by configuration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import collect, evaluation, liveness, maintain, tables
from ..session import ship, table
from . import federation, views
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
NOW = views.NOW
LAST = f"""cache AS ({views.CACHE}), last AS (SELECT cache_key, arg_max(status, event_id) AS status, arg_max(checked_at, event_id) AS checked_at FROM cache GROUP BY 1)"""
AGE = f"date_diff('second', checked_at, {NOW}) / 3600.0"


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def last(spark, sf_dir):
    return liveness.latest(views.cache(spark, sf_dir), ["cache_key"], "event_id")


@R.add(f"""WITH {LAST}, due AS (SELECT * FROM last WHERE {AGE} >= CASE WHEN status = 'dead' THEN 240 ELSE 24 END ORDER BY checked_at, cache_key LIMIT 30)
SELECT cache_key, 'https://' || substr(cache_key, 7) AS url, status FROM due ORDER BY checked_at, cache_key LIMIT 10""")
def recheck_queue(spark, sf_dir):
    return maintain.recheck_queue(last(spark, sf_dir), now(), 24, 240, 10).select("cache_key", "url", "status")


@R.add(f"WITH {LAST} SELECT count(*) AS cached, count(*) FILTER ({AGE} >= 6) AS expired FROM last")
def pending_checks(spark, sf_dir):
    return maintain.pending(last(spark, sf_dir), now(), 6)


@R.add(f"""WITH {LAST} SELECT count(*) AS candidates, count(*) AS checked, count(*) FILTER (status IN ('alive', 'need_pwd', 'wrong_pwd')) AS alive, count(*) FILTER (status IN ('dead', 'not_found')) AS dead, 0::BIGINT AS unsupported, count(*) FILTER (status = 'unknown') AS errors FROM last""")
def upkeep_counters(spark, sf_dir):
    return maintain.counters(last(spark, sf_dir))


@R.add("""WITH s AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'total' ELSE event_type END AS stage, round(sum(value), 4) AS seconds FROM events GROUP BY 1, 2)
SELECT user_id, arg_max(stage, (seconds, stage)) FILTER (stage <> 'total') AS slowest FROM s GROUP BY 1""")
def slowest_stage(spark, sf_dir):
    stage = F.when(F.col("event_type") == "view", "total").otherwise(F.col("event_type"))
    spent = table(spark, sf_dir, "events").groupBy("user_id", stage.alias("stage")).agg(F.round(F.sum("value"), 4).alias("seconds"))
    by = spent.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "seconds"))).alias("stages"))  # one entry a stage
    return by.select("user_id", maintain.slowest("stages").alias("slowest"))


@R.add("""WITH found AS (SELECT event_type AS vertical, 'C' || CAST(user_id AS VARCHAR) AS channel FROM events), known AS (SELECT DISTINCT 'c' || CAST(user_id AS VARCHAR) AS low FROM events WHERE value > 95),
f AS (SELECT lower(channel) AS low, min(vertical) AS vertical, min(channel) AS channel FROM found WHERE lower(channel) NOT IN (SELECT low FROM known) GROUP BY 1) SELECT vertical, array_to_string(list(channel ORDER BY channel), ',') AS channels FROM f GROUP BY 1""")
def new_channels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    found = e.select(F.col("event_type").alias("vertical"), F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("channel"))
    known = e.filter("value > 95").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("channel"))
    return maintain.new_channels(found, known).select("vertical", F.array_join("channels", ",").alias("channels"))


@R.add("SELECT event_type AS vertical, count(DISTINCT user_id) AS channels FROM events GROUP BY 1")
def channels_by_vertical(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("vertical")).agg(F.countDistinct("user_id").alias("channels"))


@R.add("""WITH p AS (SELECT user_id, event_id % 5 AS page, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS links FROM events) SELECT user_id AS channel, CAST(sum(links) AS BIGINT) AS links FROM p WHERE page < 3 GROUP BY 1 HAVING sum(links) >= 10""")
def verified_channels(spark, sf_dir):
    pages = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("channel"), (F.col("event_id") % 5).alias("page")).agg(F.sum((F.col("event_type") == "purchase").cast("int")).alias("links"), F.min("event_type").alias("text"))
    return maintain.verify_channels(pages, 10).select("channel", "links")


# --- forms, configured extraction, magnets

HOST = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
FORMS = {
    0: '<form action="/find"><input type="hidden" name="h"><input name="query"></form>',
    1: '<form method="post" action="/find"><input name="q"></form>',
    2: "<FORM><input type=text name='s'/><input name='t'></FORM>",
    3: '<form method="GET" action="more/list.php?k=1"><p><input type="search" name="wd"></p></form><form action="/x"><input type="submit" name="go"></form>',
}


@R.add(f"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN {HOST} || '/find?query={{q}}' WHEN 2 THEN {HOST} || '/?s={{q}}' WHEN 3 THEN {HOST} || '/more/list.php?k=1&wd={{q}}' ELSE '' END AS templates FROM pages""")
def search_forms(spark, sf_dir):
    """Templates of the search forms at the end of whole pages."""
    ship(spark)
    form = F.element_at(F.array(*(F.lit(FORMS[k]) for k in range(4))), (F.col("page_id") % 4 + 1).cast("int"))
    found = html.search_forms(F.concat("html", form), F.regexp_extract("url", "^(https?://[^/?#]+)", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, " ").alias("templates"))


ITEM = r'<a href="(/[^"]*)">([^<]*)</a>'


@R.add(f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '{ITEM}', 1) AS h, regexp_extract_all(html, '{ITEM}', 2) AS t FROM pages), u AS (SELECT page_id, unnest(h) AS h, unnest(t) AS t, unnest(range(len(h))) AS i FROM a)
SELECT page_id, 'https://site.example' || h AS link, trim(regexp_replace(arg_min(t, i), '\\s+', ' ', 'g')) AS title FROM u GROUP BY page_id, h""")
def configured_items(spark, sf_dir):
    """Links and titles of pages by a configured pattern."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(html.items(F.col("html"), ITEM, "https://site.example")).alias("i"))
    return rows.select("page_id", "i.link", "i.title")


@R.add("""WITH m AS (SELECT page_id, 'magnet:?xt=urn:btih:' || md5(CAST(page_id % 200 AS VARCHAR)) || CASE WHEN page_id % 2 = 0 THEN '&dn=%5Bg%5D%20n' ELSE '&tr=t' END AS url, CASE WHEN page_id % 2 = 0 THEN '[g] n' ELSE 'Row ' || CAST(page_id % 200 AS VARCHAR) END AS title FROM pages)
SELECT url, min(page_id) AS seq, arg_min(title, page_id) AS title FROM m GROUP BY 1""")
def magnet_rows(spark, sf_dir):
    """Magnet links in tables of results: escaped ampersands and brackets, names of their own or of their row."""
    magnet = F.concat(F.lit("magnet:?xt=urn:btih:"), F.md5((F.col("page_id") % 200).cast("string").cast("binary")), F.when(F.col("page_id") % 2 == 0, "&amp;dn=[g]%20n").otherwise("&amp;tr=t"))
    row = F.concat(F.lit("<table></tr><tr><td><a href='/x'>x</a><a href='/y'>Row "), (F.col("page_id") % 200).cast("string"), F.lit("</a><a href=\""), magnet, F.lit("\">m</a></td></tr></table>"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url", F.concat("html", row).alias("html"))
    return federation.magnet_hits(pages).select("url", "seq", "title")


@R.add(f"""WITH p AS (SELECT url, min(page_id) AS seq FROM pages GROUP BY 1), h AS (SELECT *, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY seq) AS rn FROM h WHERE path NOT IN ('', '/') AND NOT contains(host, 'spam') AND NOT (host = 'free-bets.example.com' OR host LIKE '%.free-bets.example.com')) SELECT seq, url FROM k WHERE rn <= 2 ORDER BY seq LIMIT 40""")
def candidate_pages(spark, sf_dir):
    results = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url")
    return federation.candidates(results, ["spam", "free-bets.example.com"], 40)


# --- sources in time

JOBS = "h AS (SELECT source, lang AS query, doc_id AS pos, n_chars % 5000 AS arrival_ms FROM documents), j AS (SELECT source, query, max(arrival_ms) AS done_ms FROM h GROUP BY 1, 2)"


def _jobs(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("query"), F.col("doc_id").alias("pos"), (F.col("n_chars") % 5000).alias("arrival_ms"))
    jobs = hits.groupBy("source", "query").agg(F.max("arrival_ms").alias("done_ms")).withColumn("error", F.lit(None).cast("string"))
    return federation.in_time(hits, jobs, 2500)


@R.add(f"WITH {JOBS} SELECT source, query, pos, CAST(row_number() OVER (PARTITION BY source, query ORDER BY pos) - 1 AS INT) AS rank FROM h WHERE arrival_ms <= 2500")
def hits_in_time(spark, sf_dir):
    return _jobs(spark, sf_dir)[0].select("source", "query", "pos", "rank")


@R.add(f"""WITH {JOBS}, n AS (SELECT source, query, count(*) AS hits FROM h WHERE arrival_ms <= 2500 GROUP BY 1, 2), t AS (SELECT j.source, coalesce(hits, 0) AS hits, least(done_ms, 2500) / 1000.0 AS seconds, CASE WHEN done_ms > 2500 THEN 4 WHEN coalesce(hits, 0) = 0 THEN 2 ELSE 1 END AS w FROM j LEFT JOIN n ON n.source = j.source AND n.query IS NOT DISTINCT FROM j.query)
SELECT source, CAST(sum(hits) AS BIGINT) AS hits, round(max(seconds), 2) AS seconds, CASE WHEN max(w) = 4 THEN CASE WHEN sum(hits) > 0 THEN 'degraded' ELSE 'timeout' END WHEN max(w) = 2 THEN 'empty' ELSE 'ok' END AS status FROM t GROUP BY 1""")
def reports_in_time(spark, sf_dir):
    return _jobs(spark, sf_dir)[1].select("source", "hits", "seconds", "status")


@R.add()
def preview_frames(spark, sf_dir):
    """When a preview is shown, of the arrivals of each user's search."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("search"), (F.unix_millis("ts") % 100_000).alias("at_ms"))
    by = e.groupBy("search", "at_ms").agg(F.count(F.lit(1)).alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("search").orderBy("at_ms"))
    return federation.frames(by.select("search", "at_ms", so_far.alias("hits")))


@R.add("""WITH t AS (SELECT doc_id, lang, lower(text) AS l, text FROM documents), r AS (SELECT doc_id, CAST(CASE WHEN contains(text, 'ing') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lang, 'e') THEN 2 ELSE 0 END
 + CASE WHEN contains(l, 'the') THEN 0.5 ELSE 0 END + CASE WHEN contains(l, 'of') THEN 0.5 ELSE 0 END AS DOUBLE) AS priority FROM t WHERE contains(l, 'the') OR contains(l, 'of')) SELECT doc_id AS video, priority FROM r ORDER BY priority DESC, doc_id LIMIT 25""")
def video_candidates(spark, sf_dir):
    empty = F.lit("")
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video"), empty.alias("title"), F.regexp_replace("text", "<[^>]+>", "").alias("description"), empty.alias("tag"), F.col("lang").alias("query"))
    return federation.videos(items, "the of", ["ing", "tion"], ["e"], 25).select("video", "priority")


@R.add(f"WITH h AS ({views.HITS}) SELECT CASE kind WHEN 'tg' THEN 'pansou_tg' ELSE 'pansou_plugin' END AS grp, count(*) AS n FROM h GROUP BY 1")
def source_groups(spark, sf_dir):
    return views.hits(spark, sf_dir).groupBy(evaluation.source_group(F.lit("pansou"), F.col("kind")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@R.add(f"WITH h AS ({views.HITS}) SELECT seq FROM h WHERE contains(source, 'src1') OR contains(kind, 'forum')")
def marked_sources(spark, sf_dir):
    return views.hits(spark, sf_dir).filter(federation.marked(F.array("source"), F.array("kind"), ["SRC1", "forum"])).select("seq")


# --- lexical evaluation and the regression report

THE, OF = (f"regexp_matches(t, '(^|[^a-z0-9]){w}($|[^a-z+#])')" for w in ("the", "of"))
LEX = f"""s AS (SELECT doc_id % 200 AS query, row_number() OVER (PARTITION BY doc_id % 200 ORDER BY n_chars DESC, doc_id) AS pos, n_chars % 7 AS url, doc_id % 11 AS key, trim(regexp_replace(lower(coalesce(text, '')), '(https?://|magnet:\\?|[?&](pwd|password|code|public)=)\\S+', ' ', 'g')) AS t, doc_id % 4 = 2 AS api, (doc_id % 10) / 10.0 AS relevance FROM documents),
f AS (SELECT *, api OR length(regexp_replace(t, '[\\s\\d[:punct:]]+', '', 'g')) = 0 AS exempt FROM s), g AS (SELECT *, NOT exempt AND NOT ({THE} AND {OF}) AS absent, NOT exempt AND relevance < 0.4 AS poor FROM f),
lex AS (SELECT query, count(*) AS shown, count(*) FILTER (absent) AS absent_all, count(*) FILTER (poor) AS low_all, count(*) FILTER (pos <= 3 AND absent) AS absent_top, count(*) FILTER (pos <= 3 AND poor) AS low_top, count(*) FILTER (pos <= 3 AND NOT exempt) AS evaluated_top,
 count(*) FILTER (pos <= 3 AND exempt) AS exempt_top, 0::BIGINT AS untitled_top, count(*) - count(DISTINCT url) AS dupe_urls, count(*) - count(DISTINCT key) AS dupe_keys FROM g GROUP BY 1),
l AS (SELECT *, CASE WHEN evaluated_top > 0 THEN round(absent_top / evaluated_top, 3) ELSE 0.0::DOUBLE END AS absent_ratio FROM lex)"""


def _lexical(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("query", F.col("doc_id") % 200)
    kinds = F.array(F.when(F.col("doc_id") % 4 == 2, "api").otherwise("tg"))
    shown = d.select("query", "n_chars", "doc_id", (F.col("n_chars") % 7).alias("url"), (F.col("doc_id") % 11).alias("key"), F.col("text").alias("title"), F.array("text").alias("titles"), kinds.alias("kinds"), ((F.col("doc_id") % 10) / 10).alias("relevance"))
    return evaluation.lexical(shown, "the of", 3, [F.desc("n_chars"), "doc_id"])


@R.add(f"WITH {LEX} SELECT * FROM l")
def lexical_evaluation(spark, sf_dir):
    return _lexical(spark, sf_dir)


RUN = "x AS (SELECT *, 'v' || CAST(query % 3 AS VARCHAR) AS vertical, 'k' || CAST(query AS VARCHAR) AS keyword, CASE WHEN query % 50 = 7 THEN 'empty' WHEN query % 50 = 9 THEN 'error' ELSE 'ok' END AS status FROM l)"


def _run(spark, sf_dir):
    q = F.col("query")
    status = F.when(q % 50 == 7, "empty").when(q % 50 == 9, "error").otherwise("ok")
    return _lexical(spark, sf_dir).select("*", F.concat(F.lit("v"), (q % 3).cast("string")).alias("vertical"), F.concat(F.lit("k"), q.cast("string")).alias("keyword"), status.alias("status"))


SUMS = ", ".join(f"CAST(coalesce(sum({c}) FILTER (status = 'ok'), 0) AS BIGINT) AS {c}" for c in ("shown", "absent_top", "low_top", "evaluated_top", "exempt_top", "dupe_urls", "untitled_top"))


@R.add(f"""WITH {LEX}, {RUN}, t AS (SELECT count(*) AS queries, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'error') AS errors, {SUMS} FROM x)
SELECT *, round(ok / greatest(1, queries), 4) AS ok_ratio, round(absent_top / greatest(1, evaluated_top), 4) AS absent_ratio, ok / greatest(1, queries) >= 0.95 AND absent_top / greatest(1, evaluated_top) <= 0.01 AND errors = 0 AS passed FROM t""")
def regression_report(spark, sf_dir):
    return evaluation.regression(_run(spark, sf_dir))


@R.add(f"WITH {LEX}, {RUN} SELECT keyword, vertical, absent_top, absent_ratio FROM x WHERE status = 'ok' AND absent_top > 0 ORDER BY absent_top DESC, absent_ratio DESC, keyword LIMIT 25")
def worst_queries(spark, sf_dir):
    return evaluation.worst(_run(spark, sf_dir)).select("keyword", "vertical", "absent_top", "absent_ratio")


@R.add(f"WITH {LEX}, {RUN} SELECT vertical, count(*) AS queries, CAST(sum(shown) AS BIGINT) AS shown, CAST(sum(absent_top) AS BIGINT) AS absent_top FROM x WHERE status = 'ok' GROUP BY 1")
def run_by_vertical(spark, sf_dir):
    return evaluation.by_vertical(_run(spark, sf_dir))


@R.add("""SELECT page_id, regexp_matches(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '\\.(cn|cc|me|top|xyz)$') AS chinese FROM pages""")
def chinese_sites(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.is_chinese_site(urls.host(F.col("url"))).alias("chinese"))


@R.add(f"WITH {LAST}, h AS ({views.HITS}), r AS (SELECT 'quark:pan.quark.cn/s/k' || CAST(seq % 400 AS VARCHAR) AS key, seq FROM h) SELECT r.seq, l.status AS early_status FROM r LEFT JOIN last l ON l.cache_key = r.key")
def checked_ahead(spark, sf_dir):
    """Hits with what was checked ahead for their key, without a code."""
    early = last(spark, sf_dir).select(F.col("cache_key").alias("key"), F.lit(None).cast("string").alias("pwd"), "status", "checked_at")
    rows = views.hits(spark, sf_dir).select("seq", F.concat(F.lit("quark:"), F.regexp_replace("url", "^https://", "")).alias("key"), F.lit(None).cast("string").alias("pwd"))
    return federation.with_early(rows, early).select("seq", "early_status")


# --- channels read back to their marks, mirrors, directories

CRAWL = """m AS (SELECT user_id AS channel, event_id AS msg_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1) // 20 AS page FROM events), k AS (SELECT user_id AS channel, max(event_id) AS newest FROM events WHERE event_type = 'error' AND value > 40 GROUP BY 1),
p AS (SELECT channel, page, min(msg_id) AS low, max(msg_id) AS high, count(*) AS n FROM m GROUP BY 1, 2), t AS (SELECT p.*, newest, coalesce(low <= newest, false) AS reached FROM p LEFT JOIN k USING (channel)),
r AS (SELECT *, coalesce(bool_or(reached) OVER (PARTITION BY channel ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM t), x AS (SELECT * FROM r WHERE NOT done AND page < 3)"""


def _crawl(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    page = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))) - 1) / 20)
    messages = e.select(F.col("user_id").alias("channel"), F.col("event_id").alias("msg_id"), page.alias("page"))
    marks = e.filter("event_type = 'error' AND value > 40").groupBy(F.col("user_id").alias("channel")).agg(F.max("event_id").alias("newest"))
    return collect.crawl(messages, marks, 3), marks


@R.add(f"WITH {CRAWL} SELECT m.channel, m.msg_id FROM m JOIN x USING (channel, page) WHERE newest IS NULL OR msg_id > newest")
def crawl_new(spark, sf_dir):
    """The new messages of channels, page by page back to the mark of the last time."""
    return _crawl(spark, sf_dir)[0][0].select("channel", "msg_id")


@R.add(f"WITH {CRAWL}, s AS (SELECT channel, max(high) AS newest, min(low) AS oldest, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY 1), b AS (SELECT channel, newest, newest AS oldest, 0 AS n FROM k UNION ALL SELECT * FROM s) SELECT channel, max(newest) AS newest, min(oldest) AS oldest, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY 1")
def crawl_marks(spark, sf_dir):
    (_, state), marks = _crawl(spark, sf_dir)
    old = marks.select("channel", "newest", F.col("newest").alias("oldest"), F.lit(0).cast("long").alias("n"))
    return tables.merge_marks(old, state.select("channel", "newest", "oldest", "n"))


ANSWERS = """SELECT user_id AS query, concat('m', CAST(event_id % 3 AS VARCHAR(20))) AS mirror, CAST(event_id % 3 AS INT) AS turn, CAST(floor(value * 20) AS INT) AS latency_ms, event_type <> 'error' AS ok FROM events"""


@R.add(f"WITH a AS ({ANSWERS}), c AS (SELECT *, turn * 800 + latency_ms AS came_ms FROM a WHERE ok) SELECT query, min(came_ms) AS came_ms FROM c GROUP BY 1")
def hedged_answers(spark, sf_dir):
    """The first of several mirrors' answers, each asked when those before it had their time."""
    return collect.hedged(views.view(spark, sf_dir, ANSWERS, "events")).select("query", "came_ms")


@R.add("""WITH f AS (SELECT CASE lang WHEN 'en' THEN 'movie' WHEN 'fr' THEN 'ebook' END AS vertical, 'Chan_' || CAST(doc_id % 50 AS VARCHAR) AS channel FROM documents WHERE lang IN ('en', 'fr')) SELECT min(vertical) AS vertical, channel FROM f GROUP BY channel""")
def harvested_channels(spark, sf_dir):
    """Channels named at the end of whole pages of a directory, by category."""
    categories = spark.createDataFrame([("en", "movie"), ("fr", "ebook")], "category string, vertical string")
    named = F.concat(F.coalesce("text", F.lit("")), F.lit(" <a href='https://t.me/s/Chan_"), (F.col("doc_id") % 50).cast("string"), F.lit("'>x</a>"))
    return collect.harvest(table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), named.alias("html")), categories)
