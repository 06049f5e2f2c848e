"""Joins, set operations, windows, upserts, streams, links in texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import links, text
from ..operators import catalog, liveness, tables
from ..session import scratch, ship, table
from ..streaming import validity, windows
from . import queries_core, search, views
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


@R.add("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@R.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@R.add("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def correlated_count(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(by, "c_custkey", "left").na.fill(0, ["n"])


@R.add("SELECT n_name, s.n AS suppliers, c.n AS customers FROM nation LEFT JOIN (SELECT s_nationkey k, count(*) n FROM supplier GROUP BY 1) s ON s.k = n_nationkey LEFT JOIN (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) c ON c.k = n_nationkey")
def full_outer_coverage(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counts = lambda t, c, name: table(spark, sf_dir, t).groupBy(F.col(c).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(name))
    both = counts("supplier", "s_nationkey", "suppliers").join(counts("customer", "c_nationkey", "customers"), "n_nationkey", "full_outer")
    return n.join(both, "n_nationkey", "left").select("n_name", "suppliers", "customers")


@R.add("SELECT q.q AS query, k.kind, q.relaxed FROM (VALUES ('a b', false), ('a', true), ('b', true)) q(q, relaxed), (VALUES ('tg', false), ('websearch', true), ('forum', false)) k(kind, primary_only) WHERE NOT (q.relaxed AND k.primary_only)")
def cross_plan(spark, sf_dir):
    asked = spark.createDataFrame([("a b", False), ("a", True), ("b", True)], "query string, relaxed boolean")
    kinds = spark.createDataFrame([("tg", False), ("websearch", True), ("forum", False)], "kind string, primary_only boolean")
    return search.jobs(asked, kinds).select("query", "kind", "relaxed")


@R.add("SELECT lang, source FROM documents INTERSECT SELECT lang, source FROM documents WHERE n_chars > 2000")
def set_intersect(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", "n_chars")
    return d.drop("n_chars").intersect(d.filter("n_chars > 2000").drop("n_chars"))


@R.add("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@R.add("SELECT source, lang, min(doc_id) AS first_id FROM documents GROUP BY 1, 2")
def union_distinct_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").alias("seq"))
    return tables.first_of(d.filter("seq % 2 = 0").unionByName(d.filter("seq % 2 = 1")), ["source", "lang"], "seq").select("source", "lang", F.col("seq").alias("first_id"))


@R.add("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM documents")
def source_ranks(spark, sf_dir):
    return tables.ranked(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@R.add("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def top_per_group(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return d.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))).filter("rn <= 3").drop("rn")


OLD = "old AS (SELECT user_id AS channel, max(event_id) AS newest, min(event_id) AS oldest, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), new AS (SELECT user_id AS channel, max(event_id) AS newest, min(event_id) AS oldest, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1)"


@R.add(f"WITH {OLD} SELECT coalesce(old.channel, new.channel) AS channel, greatest(old.newest, new.newest) AS newest, least(old.oldest, new.oldest) AS oldest, coalesce(old.n, 0) + coalesce(new.n, 0) AS n FROM old FULL JOIN new ON old.channel = new.channel")
def watermark_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    marks = lambda rows: rows.groupBy(F.col("user_id").alias("channel")).agg(F.max("event_id").alias("newest"), F.min("event_id").alias("oldest"), F.count(F.lit(1)).alias("n"))
    return tables.merge_marks(marks(e.filter("event_id % 2 = 0")), marks(e.filter("event_id % 2 = 1")))


@R.add("SELECT user_id AS channel, count(*) AS messages, count(*) FILTER (event_type = 'purchase') AS with_links, max(event_id) AS newest FROM events GROUP BY 1")
def channel_stats(spark, sf_dir):
    return catalog.channel_stats(table(spark, sf_dir, "events").select(F.col("user_id").alias("channel"), F.col("event_id").alias("msg_id"), (F.col("event_type") == "purchase").alias("linked")))


@R.add("SELECT channel, CASE WHEN n < 60 OR y >= 0.3 THEN 60 WHEN y >= 0.1 THEN 30 WHEN y >= 0.02 THEN 12 ELSE 1 END AS pages FROM (SELECT user_id AS channel, count(*) AS n, count(*) FILTER (event_type = 'purchase') / count(*) AS y FROM events GROUP BY 1)")
def deepen_pages(spark, sf_dir):
    stats = channel_stats(spark, sf_dir)
    return stats.select("channel", catalog.pages_to_read(F.col("messages"), F.col("with_links"), full=60, few=60).alias("pages"))


@R.add("SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' THEN '' ELSE text END) AS digest FROM conversations")
def compact_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("linked", F.col("role") != "assistant")
    return tables.compact(c, "linked").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("digest"))


@R.add("SELECT upper(substr(source, 1, 1)) || substr(source, 2) AS canonical, count(*) AS n FROM documents GROUP BY 1")
def canonical_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    known = d.select(F.initcap("source").alias("canonical")).distinct()
    return tables.canonicalise(d, "source", known, "canonical").groupBy(F.col("source").alias("canonical")).agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT event_type, count(*) AS attempts, max(ts) AS last_at FROM events GROUP BY 1 ORDER BY last_at DESC LIMIT 20")
def search_log(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("attempts"), F.max("ts").cast("timestamp_ntz").alias("last_at")).orderBy(F.desc("last_at")).limit(20)


@R.add("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return windows.tumbling(e, "1 day").select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


SESS = "s AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL '6 hours' THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s)"


@R.add(f"WITH {SESS} SELECT user_id, min(ts) AS began, max(ts) AS last_at, count(*) AS n FROM g GROUP BY user_id, g")
def session_windows(spark, sf_dir):
    out = windows.sessions(table(spark, sf_dir, "events"), "6 hours")
    return out.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n")


@R.add("SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    out = windows.run_tumbling(spark, f"{sf_dir}/events.parquet", "1 day")
    return out.select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add("""SELECT doc_id, CAST(length(coalesce(text, '')) + CASE k WHEN 1 THEN 4 ELSE 36 + length(n) END AS INT) AS pos, CASE k WHEN 1 THEN 'https://pan.quark.cn/s/k' || n ELSE 'https://pan.baidu.com/s/1x' || n END AS url,
 CASE k WHEN 1 THEN 'quark' ELSE 'baidu' END AS pan_type, CASE k WHEN 1 THEN 'ab' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') ELSE '9x8y' END AS pwd FROM (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS n FROM documents), (VALUES (1), (2)) v(k)""")
def link_extract(spark, sf_dir):
    """Links and codes planted at the end of whole texts, which have none of their own."""
    ship(spark)
    n = F.col("doc_id").cast("string")
    note = F.concat(F.coalesce("text", F.lit("")), F.lit(" 链接 https://pan.quark.cn/s/k"), n, F.lit(" 密码ab"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit(" pan.baidu.com/s/1x"), n, F.lit(" pwd 9x8y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(links.share_links(note)).alias("l")).select("doc_id", "l.*")


@R.add("SELECT doc_id, 'https://pan.quark.cn/s/k' || CAST(doc_id AS VARCHAR) AS url, 'c' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') AS code FROM documents")
def plain_link_codes(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    note = F.concat(F.lit("见 https://pan.quark.cn/s/k"), n, F.lit("，提取码: c"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(links.plain_links(note), F.lit(0)).alias("url"), text.code_in_text(note).alias("code"))


@R.add()
def mixed_script_tokens(spark, sf_dir):
    rows = spark.createDataFrame([(1, "沙丘 4k hdr 全集"), (2, "沙丘 预言 电视剧"), (3, "单"), (4, "dune part 2")], "id int, text string")
    return rows.select("id", text.mixed_tokens(F.col("text")).alias("tokens"))


BOTH = "regexp_matches(t, '(^|[^a-z0-9])the($|[^a-z+#])') AND regexp_matches(t, '(^|[^a-z0-9])of($|[^a-z+#])')"


#: A search for "the of" in SQL: sc has the resources that titles don't make irrelevant, with status and score.
SEARCHED = f"""{queries_core.RESOLVED}, titled AS (SELECT key, title, min(seq) AS s, trim(lower(title)) AS t FROM keyed WHERE title <> '' GROUP BY key, title),
told AS (SELECT key, bool_or({BOTH}) AS answers, bool_or(length(regexp_replace(t, '[\\s\\d[:punct:]]+', '', 'g')) > 0) AS known FROM titled GROUP BY 1),
rated AS (SELECT *, CAST(regexp_matches(t, '(^|[^a-z0-9])the($|[^a-z+#])') AS INT) + CAST(regexp_matches(t, '(^|[^a-z0-9])of($|[^a-z+#])') AS INT) AS m FROM titled),
rel AS (SELECT *, CAST({queries_core.REL} AS DOUBLE) AS r FROM rated), top AS (SELECT key, max(r) AS relevance, first(title ORDER BY r DESC, length(title) DESC, s) AS best FROM rel GROUP BY 1),
kw AS (SELECT key, max(CASE kind WHEN 'api' THEN 0.95 WHEN 'tg' THEN 0.9 WHEN 'forum' THEN 0.8 ELSE 0.6 END)::DOUBLE AS kw, count(DISTINCT source) AS ns FROM keyed GROUP BY 1),
cache AS ({views.CACHE}), last AS (SELECT cache_key, arg_max(status, (checked_at, event_id)) AS status, arg_max(checked_at, (checked_at, event_id)) AS checked_at, arg_max(pwd_verified, (checked_at, event_id)) AS verified FROM cache GROUP BY 1),
live AS (SELECT cache_key AS key, status, verified FROM last WHERE date_diff('second', checked_at, {views.NOW}) <= CASE WHEN status IN ('dead', 'not_found') THEN 720 ELSE 6 END * 3600),
st AS (SELECT res.key, res.pwd, coalesce(best, res.title) AS title, from_primary, hit_count, first_seq, rrf, coalesce(relevance, 0.3) AS relevance, kw, ns, coalesce(status, 'unchecked') AS status, coalesce(verified, false) AS verified
 FROM res JOIN fused USING (key) JOIN kw USING (key) LEFT JOIN top USING (key) LEFT JOIN told USING (key) LEFT JOIN live ON live.key = res.key AND res.pwd IS NULL WHERE coalesce(answers, false) OR NOT coalesce(known, false)),
us AS (SELECT *, status = 'alive' OR (status = 'need_pwd' AND pwd IS NOT NULL AND verified) AS usable FROM st),
sc AS (SELECT *, round(relevance * relevance * kw * (1 + least(0.35, (ns - 1) * 0.12)) * (1 + least(0.30, rrf)) * CASE WHEN pwd IS NOT NULL AND usable THEN 1.1 ELSE 1 END
 * CASE WHEN NOT from_primary AND relevance < 0.85 THEN 0.5 ELSE 1 END * CASE status WHEN 'alive' THEN 1.0 WHEN 'need_pwd' THEN 0.8 WHEN 'wrong_pwd' THEN 0.5 WHEN 'unchecked' THEN 0.6 WHEN 'unknown' THEN 0.3 WHEN 'dead' THEN 0.02 ELSE 0.5 END, 6) AS score FROM us)"""


@R.add(f"""WITH {SEARCHED}
SELECT key, title, status, relevance, score, hit_count, first_seq FROM sc WHERE status NOT IN ('dead', 'not_found') ORDER BY CASE WHEN relevance >= 0.85 THEN 0 WHEN relevance >= 0.45 THEN 1 ELSE 2 END,
 CASE WHEN status = 'alive' THEN 0 WHEN status IN ('need_pwd', 'wrong_pwd') THEN 1 ELSE 2 END, score DESC, CAST(NOT usable AS INT), first_seq LIMIT 50""")
def search_end_to_end(spark, sf_dir):
    """A whole search over the hits and cache of the driver's tables."""
    found = search.search(views.hits(spark, sf_dir), "the of", cache=views.cache(spark, sf_dir), now=now(), limit=50)
    return found.select("key", "title", "status", "relevance", "score", "hit_count", "first_seq")


COUNTED = {"alive": "alive", "need_pwd": "need_pwd", "wrong_pwd": "wrong_pwd", "dead": "dead", "unknown": "unknown", "unchecked": "unchecked"}


@R.add(f"""WITH {SEARCHED}, n AS (SELECT count(*) AS raw  FROM ({views.HITS})), r AS (SELECT count(*) AS n FROM res)
SELECT n.raw AS raw_hits, r.n AS dedup_count, r.n - (SELECT count(*) FROM sc) AS irrelevant_pruned, count(*) FILTER (status IN ('dead', 'not_found')) AS pruned, count(*) FILTER (status NOT IN ('dead', 'not_found')) AS kept,
 {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in COUNTED)} FROM sc, n, r GROUP BY n.raw, r.n""")
def search_outcome(spark, sf_dir):
    """What became of all hits of a search, counted by the job that finds its best rows."""
    o = search.outcome(views.hits(spark, sf_dir), "the of", cache=views.cache(spark, sf_dir), now=now(), limit=20)
    row = {**{k: o.counts[k] for k in ("raw_hits", "dedup_count", "irrelevant_pruned", "kept")}, "pruned": o.pruned, **{k: o.by("status").get(v, 0) for k, v in COUNTED.items()}}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))


@R.add(f"""WITH h AS ({views.MIXED_HITS}), k AS (SELECT DISTINCT CASE seq % 6 WHEN 0 THEN 'baidu' WHEN 1 THEN 'quark' WHEN 2 THEN 'magnet' WHEN 3 THEN 'aliyun' ELSE '123' END AS kind,
 CASE seq % 6 WHEN 0 THEN seq % 90 WHEN 1 THEN seq % 80 WHEN 2 THEN seq % 70 WHEN 3 THEN seq % 60 ELSE seq % 50 END AS id FROM h WHERE NOT contains(source, 'src1') AND seq % 6 <> 4) SELECT kind, count(*) AS n, (SELECT count(*) FROM h WHERE contains(source, 'src1')) AS adult_pruned FROM k GROUP BY 1""")
def outcome_types(spark, sf_dir):
    """Resources of a search by provider (links to none are no resources), and hits of sources that were left out, from the same job."""
    o = search.outcome(views.mixed_hits(spark, sf_dir).filter("source is not null"), "the of", drop_sources=["src1"], limit=5)
    return spark.createDataFrame([(k, n, o.counts["adult_pruned"]) for k, n in o.by("type").items()], "kind string, n long, adult_pruned long")


#: Captured answers of six endpoints, made from events.
ANSWERS = """SELECT concat('k', CAST(event_id AS VARCHAR(20))) AS key, CASE WHEN event_id % 2 = 0 THEN 'abcd' END AS pwd,
 CASE event_id % 7 WHEN 0 THEN 'baidu_liveness' WHEN 1 THEN 'baidu_code' WHEN 2 THEN 'quark' WHEN 3 THEN 'aliyun' WHEN 4 THEN '115' WHEN 5 THEN 'tianyi' ELSE 'other' END AS endpoint,
 CASE WHEN event_type = 'error' THEN 404 WHEN event_type = 'click' THEN 400 ELSE 200 END AS http_status,
 CASE event_id % 7 WHEN 0 THEN concat('{"errno":', CASE event_type WHEN 'view' THEN '0' WHEN 'click' THEN '-9' WHEN 'error' THEN '140' WHEN 'signup' THEN '-3' ELSE '7' END, '}')
 WHEN 1 THEN concat('{"errno":', CASE event_type WHEN 'view' THEN '0' WHEN 'click' THEN '-12' WHEN 'error' THEN '105' WHEN 'signup' THEN '-62' ELSE '7' END, '}')
 WHEN 2 THEN CASE event_type WHEN 'view' THEN '{"code":0,"status":200}' WHEN 'signup' THEN '{"code":41006}' WHEN 'purchase' THEN '{"status":200}' ELSE '{}' END
 WHEN 3 THEN CASE event_type WHEN 'view' THEN '{"share_name":"a"}' WHEN 'signup' THEN '{"code":"ShareLink.Cancelled"}' WHEN 'purchase' THEN '{"code":"Odd.NotFound"}' WHEN 'click' THEN '{"x":1}' ELSE '{}' END
 WHEN 4 THEN CASE event_type WHEN 'view' THEN '{"state":true,"errno":0}' WHEN 'signup' THEN '{"state":false,"errno":4100012}' WHEN 'purchase' THEN '{"state":false,"errno":9}' WHEN 'click' THEN '{"state":false,"errno":4100008}' ELSE 'not json' END
 WHEN 5 THEN CASE event_type WHEN 'view' THEN '<shareVO><a/></shareVO>' WHEN 'signup' THEN '<error><code>ShareInfoInvalid</code></error>' WHEN 'purchase' THEN '<error><code>Other</code></error>' ELSE '' END ELSE '{}' END AS body FROM events"""


@R.add("""SELECT 'k' || CAST(event_id AS VARCHAR) AS key, CASE event_id % 7
 WHEN 0 THEN CASE event_type WHEN 'view' THEN 'alive' WHEN 'click' THEN 'need_pwd' WHEN 'error' THEN 'not_found' WHEN 'signup' THEN 'dead' ELSE 'unknown' END
 WHEN 1 THEN CASE event_type WHEN 'view' THEN 'alive' WHEN 'click' THEN 'wrong_pwd' WHEN 'error' THEN 'not_found' WHEN 'signup' THEN 'unknown' ELSE 'unknown' END
 WHEN 2 THEN CASE event_type WHEN 'view' THEN 'alive' WHEN 'signup' THEN 'not_found' WHEN 'purchase' THEN 'alive' WHEN 'error' THEN 'not_found' ELSE 'unknown' END
 WHEN 3 THEN CASE event_type WHEN 'view' THEN 'alive' WHEN 'signup' THEN 'dead' WHEN 'purchase' THEN 'not_found' WHEN 'click' THEN 'unknown' ELSE 'not_found' END
 WHEN 4 THEN CASE event_type WHEN 'view' THEN 'alive' WHEN 'signup' THEN 'need_pwd' WHEN 'purchase' THEN 'not_found' WHEN 'click' THEN 'wrong_pwd' ELSE 'unknown' END
 WHEN 5 THEN CASE event_type WHEN 'view' THEN 'alive' WHEN 'signup' THEN 'dead' WHEN 'click' THEN 'not_found' ELSE 'unknown' END ELSE 'unsupported' END AS status FROM events""")
def response_decisions(spark, sf_dir):
    """Answers of every endpoint, decided by tables."""
    return liveness.decide(views.view(spark, sf_dir, ANSWERS, "events"), now()).select("key", "status")


#: Answers with dates of expiry, and of a provider that is told of by rows alone.
EXPIRING = """SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN 'aliyun' ELSE 'newpan' END AS endpoint, CASE WHEN event_id % 11 = 0 THEN 500 ELSE 200 END AS http_status,
 CASE WHEN event_id % 2 = 0 THEN concat('{"expiration":"', CASE event_id % 3 WHEN 0 THEN concat('2024-', lpad(CAST(1 + event_id % 12 AS VARCHAR(20)), 2, '0'), '-10T00:00:00Z') WHEN 1 THEN '' ELSE 'soon' END, '"}')
 ELSE concat('{"data":{"state":"', CASE event_id % 5 WHEN 1 THEN 'ok' WHEN 2 THEN 'code needed' WHEN 3 THEN 'gone' ELSE 'odd' END, '","until":"2024-', lpad(CAST(1 + event_id % 12 AS VARCHAR(20)), 2, '0'), '-10"}}') END AS body FROM events"""
NEWPAN = [("$.data.state", "is", "gone", "not_found"), ("$.data.state", "has", "needed", "need_pwd"), ("$.data.until", "past", None, "dead"), ("$.data.state", "is", "ok", "alive")]


@R.add("""SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 11 = 0 THEN 'unknown' WHEN event_id % 3 = 0 AND event_id % 12 = 0 THEN 'dead' ELSE 'alive' END
 ELSE CASE event_id % 5 WHEN 3 THEN 'not_found' WHEN 2 THEN 'need_pwd' ELSE CASE WHEN event_id % 12 = 0 THEN 'dead' WHEN event_id % 5 = 1 THEN 'alive' ELSE 'unknown' END END END AS status FROM events""")
def expiring_shares(spark, sf_dir):
    """Dates of expiry, and a provider that is added as rows of the table of rules."""
    rules = [*liveness.default_rules(), *(("newpan", k, *r) for k, r in enumerate(NEWPAN))]
    return liveness.decide(views.view(spark, sf_dir, EXPIRING, "events"), now(), rules=spark.createDataFrame(rules, liveness.RULES)).select("key", "status")


@R.add("""SELECT doc_id AS line, CASE doc_id % 3 WHEN 0 THEN 'https://pan.quark.cn/s/b' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'https://pan.baidu.com/share/init?surl=T' || CAST(doc_id AS VARCHAR) || '&pwd=12ab' END AS url,
 CASE doc_id % 3 WHEN 0 THEN '12xy' WHEN 1 THEN '12ab' END AS pwd FROM documents WHERE doc_id % 3 <> 2 OR trim(text) <> ''""")
def batch_lines(spark, sf_dir):
    """A batch of lines: links with codes, lone links that keep their query, and lines that have none."""
    ship(spark)
    n = F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://pan.quark.cn/s/b"), n, F.lit(" 提取码 12xy"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("https://pan.baidu.com/share/init?surl=T"), n, F.lit("&pwd=12ab")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), F.coalesce(line, F.col("text")).alias("text"))
    hits, rejects = search.batch_text(rows)
    none = F.lit(None).cast("string")
    return hits.select("line", "url", "pwd").unionByName(rejects.select("line", none.alias("url"), none.alias("pwd")))


#: Events as states of users, and how long each holds; after the last come the stretches that the watermark has passed.
HOLDS = {"view": 3_600, "click": 86_400, "error": 600, "purchase": 0}
LATE_HOURS = 24
STATE = "SELECT CAST(user_id AS VARCHAR(20)) AS key, event_type AS status, date_trunc('MILLISECOND', ts) AS seen, event_id AS seq FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL"
TTL = f"CASE status {' '.join(f"WHEN '{k}' THEN {v}" for k, v in HOLDS.items())} ELSE 0 END"
STRETCHES = f"""WITH s AS ({STATE}), w AS (SELECT max(seen) - INTERVAL {LATE_HOURS} HOUR AS mark FROM s),
n AS (SELECT s.*, lead(seen) OVER (PARTITION BY key ORDER BY seen, seq) AS later, CASE WHEN {TTL} > 0 THEN seen + to_seconds({TTL}) END AS ends, mark FROM s, w WHERE seen <= mark)
SELECT key, status, seen AS since, CASE WHEN later IS NOT NULL AND (ends IS NULL OR ends >= later) THEN later ELSE ends END AS until, CASE WHEN later IS NOT NULL AND (ends IS NULL OR ends >= later) THEN 'checked' ELSE 'expired' END AS ended_by
FROM n WHERE (later IS NOT NULL AND (ends IS NULL OR ends >= later)) OR ends <= mark"""


@R.add(STRETCHES)
def validity_stream(spark, sf_dir):
    """How long states held, by a stream with timers of event time."""
    ship(spark)
    folder = scratch(spark, "validity")
    events = windows.source(spark, f"{sf_dir}/events.parquet").filter("user_id is not null and ts is not null")
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("status"), F.date_trunc("MILLISECOND", "ts").alias("at"), F.col("event_id").alias("seq"))
    validity.run(spark, rows, f"{folder}/out", f"{folder}/checkpoint", f"{LATE_HOURS} hours", HOLDS)
    return spark.read.schema(validity.OUT).parquet(f"{folder}/out")


@R.add(STRETCHES)
def validity_stretches(spark, sf_dir):
    """The batch twin."""
    rows = views.view(spark, sf_dir, STATE, "events").withColumnRenamed("seen", "at")
    mark = rows.agg(F.max("at").alias("mark")).select((F.col("mark") - F.expr(f"INTERVAL {LATE_HOURS} HOUR")).alias("mark"))
    rows = rows.crossJoin(F.broadcast(mark))  # one row
    return validity.stretches(rows, F.col("mark"), HOLDS)
