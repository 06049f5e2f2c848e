"""Hits, resources, scores, liveness."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import urls
from ..operators import catalog, liveness, ranking, resolve
from ..session import table
from . import views
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")
WORDS = "the of"

KEYED = f"""hits AS ({views.HITS}), keyed AS (SELECT *, concat('quark:', substr(url, 9)) AS key, nullif(pwd, '') AS code FROM hits)"""


def ordered(column: str, where: str = "true", cap: int | None = None) -> str:
    """Distinct values by their first seq, in DuckDB: one subquery, joined by key."""
    cut = f"[1:{cap}]" if cap else ""
    return f"(SELECT key, array_to_string((list(x ORDER BY s)){cut}, '|') AS {column}s FROM (SELECT key, {column} AS x, min(seq) AS s FROM keyed WHERE {column} IS NOT NULL AND {column} <> '' AND {where} GROUP BY 1, 2) GROUP BY key)"


AFTER_KEYS = """best AS (SELECT key, source, max(1.0 / (60 + rank)) AS b FROM keyed GROUP BY 1, 2), fused AS (SELECT key, sum(b) AS rrf FROM best GROUP BY 1),
res AS (SELECT key, coalesce(arg_min(url, seq) FILTER (code IS NOT NULL), arg_min(url, seq)) AS url, arg_min(code, seq) FILTER (code IS NOT NULL) AS pwd,
 arg_max(title, length(title) * 1000000000 - seq) FILTER (title <> '') AS title, arg_min(size, seq) FILTER (size <> '') AS size, bool_or(NOT relaxed) AS from_primary,
 count(*) AS hit_count, min(seq) AS first_seq FROM keyed GROUP BY key)"""
RESOLVED = f"{KEYED}, {AFTER_KEYS}"
LISTED = f"""SELECT res.*, sources, kinds, origins, querys AS queries, round(rrf, 9) AS rrf FROM res JOIN fused USING (key)
 LEFT JOIN {ordered("source")} USING (key) LEFT JOIN {ordered("kind")} USING (key) LEFT JOIN {ordered("origin", cap=8)} USING (key)
 LEFT JOIN {ordered("query", "NOT relaxed")} USING (key)"""


def listed(hits):
    out = resolve.resolve(hits)
    lists = (F.nullif(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("sources", "kinds", "origins", "queries"))
    return out.select("key", "url", "pwd", "title", "size", "from_primary", "hit_count", "first_seq", *lists, F.round("rrf", 9).alias("rrf"))


@R.add(f"WITH {RESOLVED} {LISTED}")
def resolve_hits(spark, sf_dir):
    return listed(views.hits(spark, sf_dir))


@R.add(f"""WITH hits AS ({views.MIXED_HITS}), keyed AS (SELECT * REPLACE (CASE doc % 6 WHEN 0 THEN 'https://pan.baidu.com/s/1T' || CAST(doc % 90 AS VARCHAR) WHEN 2 THEN regexp_replace(url, '&dn=.*$', '') ELSE regexp_extract(url, '^([^?#]*)', 1) END AS url),
 CASE doc % 6 WHEN 0 THEN 'baidu:1T' || CAST(doc % 90 AS VARCHAR) WHEN 1 THEN 'quark:pan.quark.cn/s/k' || CAST(doc % 80 AS VARCHAR) WHEN 2 THEN 'magnet:' || lower(regexp_extract(url, 'btih:([A-Za-z0-9]+)', 1))
 WHEN 3 THEN 'aliyun:www.alipan.com/s/a' || CAST(doc % 60 AS VARCHAR) ELSE '123:www.123pan.com/s/z' || CAST(doc % 50 AS VARCHAR) END AS key,
 coalesce(nullif(pwd, ''), CASE doc % 6 WHEN 0 THEN regexp_extract(url, 'pwd=(....)', 1) WHEN 1 THEN regexp_extract(url, '#(....)$', 1) END) AS code FROM (SELECT *, seq AS doc FROM hits) WHERE doc % 6 <> 4), {AFTER_KEYS} {LISTED}""")
def resolve_providers(spark, sf_dir):
    """Hits of five providers, codes in queries and fragments, magnets with names, and hosts that nobody knows."""
    return listed(views.mixed_hits(spark, sf_dir))


@R.add(f"WITH {KEYED}, best AS (SELECT key, source, max(1.0 / (60 + rank)) AS b FROM keyed GROUP BY 1, 2) SELECT key, round(sum(b), 9) AS rrf FROM best GROUP BY 1")
def rrf_fusion(spark, sf_dir):
    return resolve.fuse(resolve.with_keys(views.hits(spark, sf_dir))).select("key", F.round("rrf", 9).alias("rrf"))


REL = """CASE WHEN t = '' THEN 0.3 WHEN m = 2 THEN CASE WHEN t LIKE 'the%' THEN 1.0 ELSE 0.95 END WHEN m = 1 THEN 0.275 ELSE 0.1 END"""
#: Only ASCII letters and digits bound a Latin term on the left; on the right letters, + and #.
TERM = r"(^|[^a-z0-9]){0}($|[^a-z+#])"
SCORED = f"""{RESOLVED}, titled AS (SELECT DISTINCT key, title, trim(lower(title)) AS t FROM keyed),
rated AS (SELECT key, title, t, CAST(regexp_matches(t, '{TERM.format("the")}') AS INT) + CAST(regexp_matches(t, '{TERM.format("of")}') AS INT) AS m FROM titled),
rel AS (SELECT key, CAST(max({REL}) AS DOUBLE) AS relevance FROM rated GROUP BY 1),
kw AS (SELECT key, max(CASE kind WHEN 'api' THEN 0.95 WHEN 'tg' THEN 0.9 WHEN 'forum' THEN 0.8 ELSE 0.6 END)::DOUBLE AS kw, count(DISTINCT source) AS ns FROM keyed GROUP BY 1),
cache AS ({views.CACHE}), last AS (SELECT cache_key, arg_max(status, event_id) AS status, arg_max(pwd_verified, event_id) AS verified, arg_max(checked_at, event_id) AS checked_at FROM cache GROUP BY 1),
live AS (SELECT cache_key AS key, status, verified FROM last WHERE date_diff('second', checked_at, {views.NOW}) <= CASE WHEN status IN ('dead', 'not_found') THEN 720 ELSE 360 END * 3600),
st AS (SELECT res.key, pwd, from_primary, hit_count, first_seq, rrf, relevance, kw, ns, coalesce(status, 'unchecked') AS status, coalesce(verified, false) AS verified
 FROM res JOIN fused USING (key) JOIN rel USING (key) JOIN kw USING (key) LEFT JOIN live USING (key)),
us AS (SELECT *, status = 'alive' OR (status = 'need_pwd' AND pwd IS NOT NULL AND verified) AS usable FROM st),
scored AS (SELECT *, round(relevance * relevance * kw * (1 + least(0.35, (ns - 1) * 0.12)) * (1 + least(0.30, rrf)) * CASE WHEN pwd IS NOT NULL AND usable THEN 1.1 ELSE 1 END
 * CASE WHEN NOT from_primary AND relevance < 0.85 THEN 0.5 ELSE 1 END * CASE status WHEN 'alive' THEN 1.0 WHEN 'need_pwd' THEN 0.8 WHEN 'wrong_pwd' THEN 0.5 WHEN 'unchecked' THEN 0.6 WHEN 'unknown' THEN 0.3 WHEN 'dead' THEN 0.02 ELSE 0.5 END, 6) AS score FROM us)"""


def scored(spark, sf_dir):
    """Resources with relevance, cached status and score. The cache is read without codes here, so it joins on the key alone."""
    found = resolve.resolve(views.hits(spark, sf_dir))
    best = ranking.relevance(F.col("titles"), [WORDS])
    rated = found.withColumn("best", best).withColumn("relevance", F.col("best.relevance"))
    last = liveness.latest(views.cache(spark, sf_dir), ["cache_key"], "event_id")
    live = last.filter(liveness.valid(F.col("status"), F.col("checked_at"), now(), ttl_hours=360)).select(F.col("cache_key").alias("key"), "status", "pwd_verified")
    known = rated.join(live, "key", "left").withColumn("status", F.coalesce("status", F.lit("unchecked"))).withColumn("pwd_verified", F.coalesce("pwd_verified", F.lit(False)))
    return ranking.score(known, now())


@R.add(f"WITH {SCORED} SELECT key, relevance, status, usable, score FROM scored")
def score_resources(spark, sf_dir):
    return scored(spark, sf_dir).select("key", "relevance", "status", "usable", "score")


@R.add(f"""WITH {SCORED} SELECT key, status, relevance, score, hit_count FROM scored ORDER BY CAST(status IN ('dead', 'not_found') AS INT), CASE WHEN relevance >= 0.85 THEN 0 WHEN relevance >= 0.45 THEN 1 ELSE 2 END,
 CASE WHEN status = 'alive' THEN 0 WHEN status IN ('need_pwd', 'wrong_pwd') THEN 1 ELSE 2 END, score DESC, CAST(NOT usable AS INT), first_seq LIMIT 20""")
def resolve_rank(spark, sf_dir):
    """The flagship: group, fuse, score, join the cache, tier, and take the top."""
    return scored(spark, sf_dir).orderBy(*ranking.order()).limit(20).select("key", "status", "relevance", "score", "hit_count")


@R.add(f"WITH {SCORED} SELECT key, status FROM scored WHERE status NOT IN ('dead', 'not_found')")
def prune_default(spark, sf_dir):
    return liveness.prune(scored(spark, sf_dir)).select("key", "status")


@R.add(f"WITH {SCORED} SELECT key, status FROM scored WHERE status IN ('alive', 'need_pwd')")
def prune_strict(spark, sf_dir):
    return liveness.prune(scored(spark, sf_dir), strict=True).select("key", "status")


@R.add(f"""WITH {SCORED}, early AS (SELECT key FROM scored WHERE relevance >= 0.85 ORDER BY relevance DESC, score DESC, first_seq LIMIT 37),
late AS (SELECT key FROM scored WHERE key NOT IN (SELECT key FROM early) ORDER BY relevance DESC, score DESC, first_seq LIMIT (50 - (SELECT count(*) FROM early)))
SELECT key, CASE WHEN key IN (SELECT key FROM early) THEN 'early' WHEN key IN (SELECT key FROM late) THEN 'late' ELSE 'unchecked' END AS phase FROM scored""")
def budget_phases(spark, sf_dir):
    return liveness.budgeted(scored(spark, sf_dir), 50, 0.75).select("key", "phase")


@R.add(f"WITH {SCORED} SELECT key, CASE WHEN relevance >= 0.85 THEN 'early' ELSE 'late' END AS phase FROM scored")
def budget_unlimited(spark, sf_dir):
    """A budget of 0 is none: everything is checked."""
    return liveness.budgeted(scored(spark, sf_dir), 0).select("key", "phase")


#: Titles, whether they name something, and whether that is what is asked for.
NAMED = [
    ("百度网盘 下载", False, False), ("夸克 资源 合集 2024", False, False), ("三体 全集", True, True), ("黑夏 下载", True, False),
    ("下载三体", True, True), ("download", False, False), ("Dune Part Two", True, False), ("4K 1080p 破解版", False, False),
]


@R.add(f"""WITH t(k, title, named, asked) AS (VALUES {', '.join(f"({k}, '{t}', {n}, {a})" for k, (t, n, a) in enumerate(NAMED))}),
h AS (SELECT doc_id // 2 AS key, t.* FROM documents JOIN t ON (doc_id + doc_id // 7) % 8 = k)
SELECT key, bool_or(named) AND NOT bool_or(asked) AND bool_or(named AND NOT regexp_matches(title, '^[ -~]*$')) AS irrelevant FROM h GROUP BY 1""")
def generic_titles(spark, sf_dir):
    """Titles of common words only say nothing of what a resource is: they don't make it irrelevant, nor do foreign ones."""
    title = F.get(F.array(*(F.lit(t) for t, _, _ in NAMED)), ((F.col("doc_id") + F.floor(F.col("doc_id") / 7)) % 8).cast("int"))
    rows = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 2).alias("key")).agg(F.collect_set(title).alias("titles"))  # of eight at most
    return rows.select("key", ranking.irrelevant(F.col("titles"), ["三体 下载"]).alias("irrelevant"))


LAST = f"cache AS ({views.STATES}), last AS (SELECT cache_key, arg_max(status, event_id) AS status, arg_max(checked_at, event_id) AS checked_at, max(event_id) AS event_id FROM cache GROUP BY 1)"


@R.add(f"WITH {LAST} SELECT cache_key, status, event_id FROM last")
def latest_wins_upsert(spark, sf_dir):
    return liveness.latest(views.states(spark, sf_dir), ["cache_key"], "event_id").select("cache_key", "status", "event_id")


@R.add(f"""WITH {LAST} SELECT cache_key, status, date_diff('second', checked_at, {views.NOW}) <= CASE WHEN status = 'dead' THEN 720 ELSE 6 END * 3600 AS holds FROM last""")
def ttl_cache(spark, sf_dir):
    last = liveness.latest(views.states(spark, sf_dir), ["cache_key"], "event_id")
    return last.select("cache_key", "status", liveness.valid(F.col("status"), F.col("checked_at"), now()).alias("holds"))


@R.add(f"""WITH {LAST} SELECT cache_key, status, round(date_diff('second', checked_at, {views.NOW}) / 3600.0, 1) AS age_hours FROM last
 WHERE date_diff('second', checked_at, {views.NOW}) / 3600.0 >= CASE WHEN status = 'dead' THEN 240 ELSE 24 END ORDER BY checked_at, cache_key LIMIT 25""")
def stale_queue(spark, sf_dir):
    last = liveness.latest(views.states(spark, sf_dir), ["cache_key"], "event_id")
    return liveness.stale(last, now(), 24, 240, 25).select("cache_key", "status", "age_hours")


@R.add(f"""WITH {LAST}, k AS (SELECT status, CAST(regexp_extract(cache_key, '[0-9]+$') AS INT) % 4 AS service FROM last)
 SELECT coalesce(CAST(service AS VARCHAR), 'all') AS service, count(*) AS checked, count(*) FILTER (status IN ('alive', 'need_pwd', 'wrong_pwd')) AS alive, count(*) FILTER (status IN ('dead', 'not_found')) AS dead,
 count(*) FILTER (status = 'unknown') AS other FROM k GROUP BY ROLLUP (service)""")
def verify_summary(spark, sf_dir):
    last = liveness.latest(views.states(spark, sf_dir), ["cache_key"], "event_id")
    rows = last.withColumn("service", (F.regexp_extract("cache_key", "[0-9]+$", 0).cast("int") % 4).cast("string"))
    known = rows.join(F.broadcast(liveness.status_table(spark).select("status", "is_alive", "is_dead")), "status")
    counts = (F.count(F.lit(1)).alias("checked"), F.count_if("is_alive").alias("alive"), F.count_if("is_dead").alias("dead"), F.count_if(~F.col("is_alive") & ~F.col("is_dead")).alias("other"))
    return known.rollup("service").agg(*counts).withColumn("service", F.coalesce("service", F.lit("all")))


@R.add(f"""WITH {LAST} SELECT CASE WHEN status IN ('alive', 'need_pwd') THEN 'alive' WHEN status IN ('dead', 'not_found') THEN 'dead' ELSE status END AS bucket, count(*) AS n FROM last GROUP BY 1""")
def batch_buckets(spark, sf_dir):
    last = liveness.latest(views.states(spark, sf_dir), ["cache_key"], "event_id")
    return last.join(F.broadcast(liveness.status_table(spark)), "status").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


FAILS = f"""runs AS ({views.RUNS}), isl AS (SELECT *, sum(CASE WHEN hits > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY run_at, event_id ROWS UNBOUNDED PRECEDING) AS g FROM runs),
f AS (SELECT domain, event_id, run_at, sum(CASE WHEN error IS NOT NULL AND hits = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY domain, g ORDER BY run_at, event_id ROWS UNBOUNDED PRECEDING) AS fails FROM isl)"""


@R.add(f"WITH {FAILS} SELECT domain, event_id, CAST(fails AS BIGINT) AS fails FROM f")
def health_consecutive_fails(spark, sf_dir):
    return liveness.failures(views.runs(spark, sf_dir)).select("domain", "event_id", "fails")


@R.add(f"WITH {FAILS}, l AS (SELECT domain, arg_max(fails, (run_at, event_id)) AS fails FROM f GROUP BY 1) SELECT domain, CAST(fails AS BIGINT) AS fails FROM l WHERE fails >= 2")
def disabled_sites(spark, sf_dir):
    return liveness.disabled(views.runs(spark, sf_dir), 2)


@R.add(f"""WITH r AS ({views.RUNS}) SELECT domain, count(*) AS attempts, sum(hits) AS hits, count(*) FILTER (hits > 0) AS ok_runs, max(run_at) AS last_run FROM r GROUP BY 1 ORDER BY hits DESC, attempts DESC, domain LIMIT 50""")
def health_report(spark, sf_dir):
    by = views.runs(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("attempts"), F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("ok_runs"), F.max("run_at").cast("timestamp_ntz").alias("last_run"))
    return by.orderBy(F.desc("hits"), F.desc("attempts"), "domain").limit(50)


@R.add("""SELECT o_orderkey, round(greatest(0.35, pow(0.5, floor(date_diff('second', o_orderdate, TIMESTAMP '1998-08-02 00:00:00') / 86400.0) / 730.0)), 6) AS freshness FROM orders WHERE o_orderdate <= TIMESTAMP '1998-08-02 00:00:00'""")
def freshness_decay(spark, sf_dir):
    at = F.lit("1998-08-02 00:00:00").cast("timestamp")
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") <= at)
    return orders.select("o_orderkey", F.round(ranking.freshness(F.col("o_orderdate"), at), 6).alias("freshness"))


@R.add("""SELECT p.kind, p.n, CAST(w.weight AS DOUBLE) AS weight FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'tg' WHEN 1 THEN 'forum' WHEN 2 THEN 'api' ELSE 'websearch' END AS kind, count(*) AS n FROM documents GROUP BY 1) p
 JOIN (VALUES ('tg', 0.9), ('forum', 0.8), ('api', 0.95), ('websearch', 0.6)) w(kind, weight) ON p.kind = w.kind""")
def kind_weights(spark, sf_dir):
    by = views.hits(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("weight", ranking.lookup(F.col("kind"), X.KIND_WEIGHTS, X.KIND_DEFAULT))


REPORTS = """SELECT concat(CAST(user_id AS VARCHAR(20)), '-', CAST(day(ts) AS VARCHAR(20))) AS source, event_id AS seq, CASE event_type WHEN 'view' THEN 3 WHEN 'purchase' THEN 1 ELSE 0 END AS hits, value AS seconds,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'timeout' WHEN 'signup' THEN 'empty' ELSE 'ok' END AS status, CASE WHEN event_type IN ('error', 'click') THEN concat('E', CAST(event_id AS VARCHAR(20))) END AS error FROM events"""


@R.add(f"""WITH r AS ({REPORTS}), m AS (SELECT source, sum(hits) AS hits, round(max(seconds), 2) AS seconds, max(CASE status WHEN 'ok' THEN 1 WHEN 'empty' THEN 2 WHEN 'timeout' THEN 4 ELSE 5 END) AS w, arg_min(error, seq) FILTER (error IS NOT NULL) AS error FROM r GROUP BY 1)
SELECT source, CAST(hits AS BIGINT) AS hits, seconds, CASE WHEN hits > 0 AND w >= 4 THEN 'degraded' WHEN w = 1 THEN 'ok' WHEN w = 2 THEN 'empty' WHEN w = 4 THEN 'timeout' ELSE 'error' END AS status, error FROM m""")
def source_report(spark, sf_dir):
    """Reports of a source's jobs as one: what failed shows, and what failed but brought hits is degraded."""
    return catalog.merge_reports(views.view(spark, sf_dir, REPORTS, "events"))


@R.add("""SELECT 'u' || CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 6 = 0 THEN 'baidu' WHEN doc_id % 6 = 1 THEN 'quark' WHEN doc_id % 6 = 2 THEN 'magnet' WHEN doc_id % 6 = 3 THEN 'direct' WHEN doc_id % 6 = 4 THEN '123' ELSE 'other' END AS pan_type,
 CASE WHEN doc_id % 6 = 0 THEN 'baidu:1T' || CAST(doc_id AS VARCHAR) WHEN doc_id % 6 = 1 THEN 'quark:pan.quark.cn/s/a' || CAST(doc_id AS VARCHAR) WHEN doc_id % 6 = 2 THEN 'magnet:' || md5(CAST(doc_id AS VARCHAR))
 WHEN doc_id % 6 = 3 THEN 'direct:libgen.rs/book/' || CAST(doc_id AS VARCHAR) WHEN doc_id % 6 = 4 THEN '123:www.123pan.com/s/z' || CAST(doc_id AS VARCHAR) ELSE 'other:example.com/s/' || CAST(doc_id AS VARCHAR) END AS key,
 CASE WHEN doc_id % 6 IN (0, 1) THEN lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') END AS code FROM documents""")
def provider_keys(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    code = F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0")
    forms = [
        F.concat(F.lit("https://pan.baidu.com/s/1T"), n, F.lit("?pwd="), code), F.concat(F.lit("https://PAN.quark.cn/s/a"), n, F.lit("/#"), code),
        F.concat(F.lit("magnet:?xt=urn:btih:"), F.upper(F.md5(n.cast("binary"))), F.lit("&dn=x&tr=udp://t")), F.concat(F.lit("http://libgen.rs/book/"), n),
        F.concat(F.lit("https://www.123pan.com/s/z"), n, F.lit("?x=1")), F.concat(F.lit("https://example.com/s/"), n),
    ]
    url = F.element_at(F.array(*forms), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("u"), n).alias("id"), url.alias("url")).withColumn("pan_type", urls.provider(F.col("url")))
    token = F.when(F.col("pan_type") == "baidu", urls.share_token(F.col("url")))
    return rows.select("id", "pan_type", urls.resource_key(F.col("pan_type"), F.col("url"), token).alias("key"), urls.code_in_url(F.col("url")).alias("code"))
