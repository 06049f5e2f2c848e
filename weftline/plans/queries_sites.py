"""Sites: probing of search URLs and of what their results lead to, planned requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import html, tables
from ..operators import probing, quota
from ..session import scratch, ship, table
from ..sources import channels, configured
from . import views
from .queries_web import SHAPE
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Pages as captured search pages of their hosts: links moved under sections, some pages with many more, some that are
#: the same for noise, some that failed.
SEARCHES = f"""SELECT domain, place, concat('/t', CAST(place % 7 AS VARCHAR(20))) AS template, CASE WHEN place % 11 = 10 THEN 500 ELSE 200 END AS http_status,
 concat(replace(html, '<li><a href="/', concat('<li><a href="', section)), CASE WHEN place % 6 = 0 THEN '{''.join(f'<a href="/item/{k}.html">' for k in range(1001, 1025))}' ELSE '' END) AS html,
 200 AS noise_status, CASE WHEN place % 5 = 1 THEN replace(html, '<li><a href="/', '<li><a href="/post/') ELSE '' END AS noise_html
 FROM (SELECT page_id AS place, html, regexp_extract(url, '://([^/?#]+)', 1) AS domain, CASE page_id % 4 WHEN 0 THEN '/post/' WHEN 1 THEN '/tag/' WHEN 2 THEN concat('/read/', CAST(1000 + page_id AS VARCHAR(20)), '_')
 ELSE concat('https://', regexp_extract(url, '://([^/?#]+)', 1), '/book/') END AS section FROM pages) x"""
HOMES = """SELECT domain, CASE WHEN n % 9 = 4 THEN 403 WHEN n % 9 <> 5 THEN 200 END AS http_status, CASE WHEN n % 9 = 5 THEN 'ConnectTimeout' END AS error
 FROM (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS domain, min(page_id) AS n FROM pages GROUP BY 1) x"""
#: A page that a link leads to: what it offers depends on the pages that link to it.
OFFER = """concat('<p>', w, '</p>', CASE WHEN place % 3 <> 0 THEN concat('<a href="https://pan.quark.cn/s/k', CAST(place AS VARCHAR(20)), '">') ELSE '' END,
 CASE WHEN place % 4 = 0 THEN '<a href="/files/a.pdf"><a href="/files/b.epub?x=1">' ELSE '' END, CASE WHEN place % 2 = 0 THEN ' https://pan.baidu.com/s/1a https://example.com/x ' ELSE '' END, CASE WHEN place % 3 = 2 THEN 'magnet:?xt=urn:btih:0123456789abcdef0123456789abcdef01234567' ELSE '' END)"""


def details(spark, sf_dir):
    rows = views.view(spark, sf_dir, SEARCHES, "pages").select("domain", "place", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(probing.LINKED), F.lit(1)))).alias("w"))
    return rows.select(F.concat(F.lit("https://"), "domain", "w").alias("url"), F.when(F.col("place") % 13 == 12, 404).otherwise(200).alias("http_status"), F.expr(OFFER).alias("html"))


LINKED = f"regexp_extract_all(html, '{probing.LINKED}', 1)"
DULL = " OR ".join(f"contains(lower(p), '{s}')" for s in X.NO_RESULT_PATHS)
CONTENT = probing.CONTENT.replace("'", "''")
HITS = f"len(list_filter(list_distinct(regexp_extract_all(@, '{probing.LINKED}', 1)), lambda p: regexp_matches(p, '{CONTENT}') AND NOT ({DULL})))"
CUT = "regexp_replace(x, '[。，、；;!！?？''\"]+$', '')"
KNOWN = "|".join(h.replace(".", "[.]") + ("" if h.endswith(".") else "$") for h, _ in X.PROVIDERS)
DOC = probing.DOCUMENT.replace("'", "''")
LINK = f"https?://[^{X.LINK_STOP}]+".replace("'", "''")
HOST_OF = "lower(regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
OFFERS = f"""len(list_distinct(list_concat(list_concat(list_filter(list_transform(regexp_extract_all(html, '{LINK}', 0), lambda x: {CUT}), lambda x: regexp_matches({HOST_OF}, '(?:^|[.])(?:{KNOWN})') OR regexp_matches(x, '{DOC}')),
 regexp_extract_all(html, '(?i)magnet:[?]xt=urn:btih:[a-z0-9]{{32,40}}', 0)), list_filter(regexp_extract_all(html, 'href="([^"]{{4,300}})"', 1), lambda x: regexp_matches(x, '{DOC}')))))"""
ESCAPE = r"'([.^$*+?{}\[\]|()&~#\- ])', '\\\1', 'g'"


@R.add(f"""WITH s AS ({SEARCHES}), h AS ({HOMES}),
p AS (SELECT * FROM (SELECT *, {HITS.replace('@', 'html')} AS real, {HITS.replace('@', 'noise_html')} AS noise FROM s WHERE http_status = 200) WHERE real >= 3 AND real - noise >= 3),
l AS (SELECT domain, place, unnest({LINKED}) AS p FROM p), sh AS (SELECT domain, place, {SHAPE} AS shape, count(*) AS n FROM l WHERE NOT ({DULL}) AND regexp_matches(lower(p), '[a-z0-9]') AND NOT contains(p, '%') GROUP BY 1, 2, 3),
lk AS (SELECT *, CASE WHEN contains(shape, '.htm') OR contains(shape, '.php') THEN 3 ELSE 0 END + CASE WHEN contains(shape, '_') THEN 2 ELSE 0 END + CASE WHEN contains(shape, '\\d') THEN 1 ELSE 0 END + CASE WHEN length(shape) - length(replace(shape, '/', '')) >= 4 THEN 1 ELSE 0 END AS likeness FROM sh),
rk AS (SELECT domain, place, shape, 'https://' || regexp_replace(domain, {ESCAPE}) || shape AS pattern, row_number() OVER (PARTITION BY domain, place ORDER BY likeness DESC, n DESC, shape) AS k FROM lk QUALIFY k <= 3),
c AS (SELECT p.domain, p.place, template, real, noise, k, pattern, list_filter(list_transform(list_concat(regexp_extract_all(html, '(?i)' || pattern, 0), list_transform(regexp_extract_all(html, '(?i)' || shape, 0), lambda x: ' ' || x)), lambda x: {CUT}), lambda x: trim(x) <> '') AS found FROM p JOIN rk ON rk.domain = p.domain AND rk.place = p.place),
u AS (SELECT domain, place, k, replace(x, ' ', 'https://' || domain) AS url, min(pos) AS pos FROM (SELECT domain, place, k, unnest(found) AS x, generate_subscripts(found, 1) AS pos FROM c) GROUP BY 1, 2, 3, 4),
a AS (SELECT domain, place, k, url FROM u QUALIFY row_number() OVER (PARTITION BY domain, place, k ORDER BY pos) <= 4),
d AS (SELECT url, max({OFFERS}) AS n FROM (SELECT 'https://' || domain || w AS url, place, {OFFER} AS html FROM (SELECT domain, place, unnest(list_distinct({LINKED})) AS w FROM s)) WHERE place % 13 <> 12 GROUP BY 1),
y AS (SELECT c.domain, c.place, c.template, c.real, c.noise, c.k, c.pattern, coalesce(z.n, 0) AS n FROM c LEFT JOIN (SELECT a.domain, a.place, a.k, sum(d.n) AS n FROM a JOIN d USING (url) GROUP BY 1, 2, 3) z ON z.domain = c.domain AND z.place = c.place AND z.k = c.k),
b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY domain, place ORDER BY least(n, 5) DESC, k) = 1),
g AS (SELECT *, real > coalesce(max(real) OVER (PARTITION BY domain ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS record FROM b WHERE n > 0),
e AS (SELECT *, min(place) FILTER (record AND real >= 20 AND real - noise >= 10) OVER (PARTITION BY domain) AS stop FROM g),
f AS (SELECT * FROM e WHERE stop IS NULL OR place <= stop QUALIFY row_number() OVER (PARTITION BY domain ORDER BY real DESC, place) = 1),
t AS (SELECT h.domain, CASE WHEN h.error IS NOT NULL THEN h.error WHEN http_status <> 200 THEN 'http:' || CAST(http_status AS VARCHAR) WHEN f.domain IS NOT NULL THEN NULL WHEN h.domain IN (SELECT domain FROM b) THEN 'no-share-links' ELSE 'no-pattern' END AS failed, f.template, f.real, f.noise, f.pattern, f.n FROM h LEFT JOIN f ON f.domain = h.domain)
SELECT domain, failed IS NULL AS ok, CASE WHEN failed IS NULL THEN template ELSE '' END AS template, CAST(CASE WHEN failed IS NULL THEN real ELSE 0 END AS INT) AS real_hits, CAST(CASE WHEN failed IS NULL THEN noise ELSE 0 END AS INT) AS noise_hits,
 CASE WHEN failed IS NULL THEN pattern ELSE '' END AS result_re, CAST(CASE WHEN failed IS NULL THEN n ELSE 0 END AS BIGINT) AS link_yield, coalesce(failed, '') AS error FROM t""")
def site_probe(spark, sf_dir):
    """Per host: the search template that works, the regex of its results, what they yield, or why it doesn't."""
    homes, searches = views.view(spark, sf_dir, HOMES, "pages"), views.view(spark, sf_dir, SEARCHES, "pages")
    return probing.probe(homes, searches, details(spark, sf_dir))


NOISE = "translate(substr(md5(domain), 1, 10), '0123456789', 'ghijklmnop')"
FORM = """'<form action="/find/"><input type="hidden" name="a"><input name="text"></form>'"""
TERMS = "['微信', '电影', '教程']", "['download', 'windows', 'audio']"


@R.add(f"""WITH h AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN 'a.cn' ELSE 'a.' END || regexp_extract(url, '://([^/?#]+)', 1) AS domain, page_id % 4 = 0 AS form FROM pages),
g AS (SELECT domain, bool_or(form) AS form, CASE WHEN regexp_matches(domain, '[.](cn|cc|me|top|xyz)$') THEN {TERMS[0]} ELSE {TERMS[1]} END AS terms FROM h GROUP BY domain),
p AS (SELECT domain, terms, CASE WHEN form THEN ['https://' || domain || '/find/?text={{q}}'] ELSE [] END || list_transform([{', '.join(f"'{p}'" for p in X.SEARCH_PATTERNS)}], lambda x: 'https://' || domain || x) AS t FROM g),
q AS (SELECT domain, terms, unnest(t) AS template, generate_subscripts(t, 1) - 1 AS k FROM p), r AS (SELECT domain, template, k * 3 + generate_subscripts(terms, 1) - 1 AS place, unnest(terms) AS term FROM q)
SELECT domain, CAST(place AS INT) AS place, template, term, replace(template, '{{q}}', url_encode(term)) AS url, replace(template, '{{q}}', {NOISE}) AS noise_url FROM r""")
def probe_requests(spark, sf_dir):
    """What to capture to probe the hosts of pages: a form's template first, then the common ones, each with three words."""
    ship(spark)
    host = F.concat(F.when(F.col("page_id") % 3 == 0, "a.cn").otherwise("a."), F.regexp_extract("url", "://([^/?#]+)", 1))
    homes = table(spark, sf_dir, "pages").groupBy(host.alias("domain")).agg(F.max(F.when(F.col("page_id") % 4 == 0, F.expr(FORM))).alias("html"))
    return probing.requests(homes)


#: Hosts as sites of a catalogue, searched under the page that has the smallest number of theirs.
CATALOGUE = """SELECT domain AS name, concat('https://', domain, '/?s={q}') AS search, concat('https://', domain, '/(?:post|read|book)/[a-z0-9_-]+') AS result_re, CASE WHEN n % 4 = 1 THEN 'music' WHEN n % 4 = 3 THEN 'general' ELSE 'ebook' END AS vertical,
 n % 10 <> 7 AS verified, n % 6 AS yield, n FROM (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS domain, min(page_id) AS n FROM pages GROUP BY 1) x"""
WORDS = ["th", "er"]
QUOTA, CHUNK, SITES = 2, 2, 25


@R.add(f"""WITH s AS ({SEARCHES}), c AS ({CATALOGUE}), r AS (SELECT *, row_number() OVER (ORDER BY vertical = 'ebook' DESC, yield DESC, name) - 1 AS site_place FROM c WHERE verified AND vertical IN ('ebook', 'general') QUALIFY site_place < {SITES}),
p AS (SELECT r.name AS site, r.site_place, s.place, regexp_extract_all(html, '(?i)' || result_re, 0) AS a, regexp_extract_all(html, '(?i)/(?:post|read|book)/[a-z0-9_-]+', 0) AS b FROM r JOIN s ON s.domain = r.name AND s.place = r.n WHERE http_status = 200),
u AS (SELECT site, site_place, unnest(list_concat(a, list_transform(b, lambda x: 'https://' || site || x))) AS url, generate_subscripts(list_concat(a, b), 1) AS pos FROM p),
d AS (SELECT site, site_place, url, min(pos) AS pos FROM u WHERE NOT ({' OR '.join(f"contains(lower(url), '{x}')" for x in X.NOT_FOLLOWED)}) GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY {' OR '.join(f"contains(lower(url), '{w}')" for w in WORDS)} DESC, pos) - 1 AS page FROM d QUALIFY page < {2 * QUOTA}),
pg AS (SELECT url, arg_max(place, html) AS place, arg_max(w, html) AS w FROM (SELECT 'https://' || domain || w AS url, place, w, {OFFER} AS html FROM (SELECT domain, place, unnest(list_distinct(regexp_extract_all(html, '{probing.LINKED}', 1))) AS w FROM s)) WHERE place % 13 <> 12 GROUP BY 1),
k AS (SELECT t.*, pg.place AS offer, coalesce({' OR '.join(f"contains(lower(pg.w), '{w}')" for w in WORDS)}, false) AS ok FROM t LEFT JOIN pg ON pg.url = t.url),
q AS (SELECT *, coalesce(sum(CAST(ok AS INT)) OVER (PARTITION BY site ORDER BY page // {CHUNK} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {QUOTA} AS seen FROM k),
h AS (SELECT site, site_place, page, unnest(list_filter([CASE WHEN offer % 2 = 0 THEN 'https://pan.baidu.com/s/1a' END, CASE WHEN offer % 3 = 2 THEN 'magnet:?xt=urn:btih:0123456789abcdef0123456789abcdef01234567' END, CASE WHEN offer % 3 <> 0 THEN 'https://pan.quark.cn/s/k' || CAST(offer AS VARCHAR) END], lambda x: x IS NOT NULL)) AS url FROM q WHERE seen AND ok)
SELECT url, arg_min(site, (site_place, page)) AS site, arg_min(page, (site_place, page)) AS page FROM h GROUP BY 1""")
def site_hits(spark, sf_dir):
    """Routed sites, their search pages, detail pages up to a quota of relevant ones, and the links of these."""
    ship(spark)
    sites = views.view(spark, sf_dir, CATALOGUE, "pages").withColumn("verticals", F.array("vertical")).withColumn("domain", F.col("name"))
    chosen = quota.routed(sites, ["ebook"], SITES)
    searches = views.view(spark, sf_dir, SEARCHES, "pages").join(sites.select(F.col("name").alias("domain"), F.col("n").alias("place")), ["domain", "place"])
    asked = searches.select(F.concat(F.lit("https://"), "domain", F.lit(f"/?s={'%20'.join(WORDS)}")).alias("url"), "http_status", F.regexp_replace("html", "https?://pan[^\"]*", "").alias("html"))
    hits, _ = quota.site_search(chosen, asked, details(spark, sf_dir), " ".join(WORDS), QUOTA, CHUNK)
    return hits.select("url", "site", "page")


#: Documents as messages on captured pages of a few channels, some pages captured a second time with the page before.
POSTS = """SELECT concat('c', CAST(doc_id % 5 AS VARCHAR(20))) AS channel, doc_id + 1 AS msg_id, CAST(floor(doc_id / 100) AS BIGINT) AS page,
 concat('<div data-post="c', CAST(doc_id % 5 AS VARCHAR(20)), '/', CAST(doc_id + 1 AS VARCHAR(20)), '"><div class="message_text">', replace(replace(text, '&', '&amp;'), '<', '&lt;'), ' https://pan.quark.cn/s/k', CAST(doc_id AS VARCHAR(20)), '</div>',
 '<time datetime="2024-01-01T00:00:00+00:00"></time></div>') AS block FROM documents"""


@R.add("""SELECT 'c' || CAST(doc_id % 5 AS VARCHAR) AS channel, doc_id + 1 AS msg_id, 'https://pan.quark.cn/s/k' || CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 500 < 300 THEN 'first' ELSE 'second' END AS run FROM documents
 WHERE doc_id % 500 < 300 OR doc_id > coalesce((SELECT max(doc_id) FROM documents o WHERE o.doc_id % 500 < 300 AND o.doc_id % 5 = documents.doc_id % 5), -1)""")
def channel_stream(spark, sf_dir):
    """Channel pages as a stream in two runs from one checkpoint: the second brings what came since the first, and nothing again.

    Pages older than a channel's mark are not gone back to; ``crawled`` reads them all.
    """
    ship(spark)
    folder = scratch(spark, "channels")
    posts = views.view(spark, sf_dir, POSTS, "documents")
    pages = posts.groupBy("channel", "page").agg(F.array_join(F.sort_array(F.collect_list("block")), "").alias("html"))  # twenty messages a page
    spark.dataSource.register(channels.channel_source(channels.StoredPages, "weftline_channels"))
    first = F.col("page") % 5 < 3
    for run, some in (("first", first), ("second", ~first)):
        channels.store_pages(pages.filter(some), f"{folder}/pages")
        stream = spark.readStream.format("weftline_channels").option("path", f"{folder}/pages").load().withColumn("run", F.lit(run))
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select("channel", "msg_id", F.get("links", F.size("links") - 1)["url"].alias("url"), "run")


@R.add("SELECT 'c' || CAST(doc_id % 5 AS VARCHAR) AS channel, max(doc_id) + 1 AS newest, min(doc_id) + 1 AS oldest, count(*) AS n FROM documents GROUP BY 1")
def crawled(spark, sf_dir):
    """The batch twin: all messages of the same pages, and each channel's marks."""
    ship(spark)
    folder = scratch(spark, "channels")
    posts = views.view(spark, sf_dir, POSTS, "documents")
    channels.store_pages(posts.groupBy("channel", "page").agg(F.array_join(F.sort_array(F.collect_list("block")), "").alias("html")), f"{folder}/pages")
    spark.dataSource.register(channels.channel_source(channels.StoredPages, "weftline_channels"))
    return channels.marks(spark.read.format("weftline_channels").option("path", f"{folder}/pages").load())


#: Events as answers of four interfaces, each with two items.
BODIES = """SELECT CASE event_id % 4 WHEN 0 THEN 'paths' WHEN 1 THEN 'template' WHEN 2 THEN 'feed' ELSE 'page' END AS source, event_id AS seq,
 CASE event_id % 4 WHEN 0 THEN concat('{"data":{"items":[{"links":[{"u":""},{"u":"https://a.org/', id, '"}],"names":["","', event_type, '"]},{"links":[{"u":"ftp://', id, '"}]}]}}')
 WHEN 1 THEN concat('[{"id":"', id, ' x","user":{"n":', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR(20)) END, '},"t":{"en":"', event_type, '"}},{"id":"only"}]')
 WHEN 2 THEN concat('<feed><entry><id>https://c.org/', id, '</id><title>', event_type, ' &amp; more</title></entry><entry><title>none</title></entry></feed>')
 ELSE concat('<p><a href="/e/', id, '"> ', event_type, ' </a><a href="/e/', id, '">again</a><a href="https://d.org/e/0">all</a>') END AS body FROM (SELECT event_id, user_id, event_type, CAST(event_id AS VARCHAR(20)) AS id FROM events) x"""
INTERFACES = [
    ("paths", "json", "data.items", "links.u", "names", None, None, None), ("template", "json", "$", None, "t.en", "https://b.org/{id}/{user.n}", None, None),
    ("feed", "xml", "entry", "id", "title", None, None, None), ("page", "html", None, None, None, None, r'<a href="([^"]+)">[^<]*</a>', "https://d.org"),
]


@R.add("""SELECT event_id AS seq, 'https://a.org/' || CAST(event_id AS VARCHAR) AS url, event_type AS title FROM events WHERE event_id % 4 = 0
UNION ALL SELECT event_id, 'https://b.org/' || CAST(event_id AS VARCHAR) || '%20x/' || CAST(user_id AS VARCHAR), event_type FROM events WHERE event_id % 4 = 1 AND event_id % 3 <> 0 AND user_id IS NOT NULL
UNION ALL SELECT event_id, 'https://c.org/' || CAST(event_id AS VARCHAR), event_type || ' & more' FROM events WHERE event_id % 4 = 2
UNION ALL SELECT event_id, unnest(['https://d.org/e/' || CAST(event_id AS VARCHAR), 'https://d.org/e/0']), unnest([event_type, 'all']) FROM events WHERE event_id % 4 = 3""")
def api_by_configuration(spark, sf_dir):
    """JSON by paths and by a template, XML and HTML, read by rows of a configuration in one plan."""
    ship(spark)
    config = spark.createDataFrame(INTERFACES, configured.CONFIG)
    return configured.read(views.view(spark, sf_dir, BODIES, "events"), config).select("seq", "url", "title")


#: Notes with a link and a code, a lone link, or none.
NOTES = """SELECT doc_id AS line, CASE doc_id % 3 WHEN 0 THEN concat('https://pan.quark.cn/s/b', CAST(doc_id AS VARCHAR(20)), ' 提取码 12xy')
 WHEN 1 THEN concat('https://pan.baidu.com/share/init?surl=T', CAST(doc_id AS VARCHAR(20)), '&pwd=12ab') ELSE text END AS note FROM documents"""


@R.add("""SELECT doc_id AS line, CASE doc_id % 3 WHEN 0 THEN 'https://pan.quark.cn/s/b' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'https://pan.baidu.com/share/init?surl=T' || CAST(doc_id AS VARCHAR) || '&pwd=12ab' ELSE '' END AS url,
 CASE doc_id % 3 WHEN 0 THEN '12xy' WHEN 1 THEN '12ab' ELSE '' END AS pwd, doc_id % 3 = 2 AS reject FROM documents WHERE doc_id % 3 <> 2 OR trim(text) <> ''""")
def lateral_links(spark, sf_dir):
    """Links of notes, and notes without any, by a table function in SQL."""
    ship(spark)
    tables.register(spark)
    notes = views.view(spark, sf_dir, NOTES, "documents")
    return spark.sql("SELECT line, coalesce(l.url, '') AS url, coalesce(l.pwd, '') AS pwd, l.url IS NULL AS reject FROM {notes}, LATERAL pasted_rows(note) l", notes=notes)


@R.add("""SELECT page_id, regexp_matches(lower(html), '(^|[^a-z0-9])article($|[^a-z+#])') AND regexp_matches(lower(html), '(^|[^a-z0-9])thorea($|[^a-z+#])') AS asked FROM pages""")
def match_in_sql(spark, sf_dir):
    """A query's predicate, called in SQL."""
    tables.register_match(spark, "asked_for", "thorea article")
    return spark.sql("SELECT page_id, asked_for(html) AS asked FROM {pages}", pages=table(spark, sf_dir, "pages"))
