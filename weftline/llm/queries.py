"""The queries of this subpackage, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, language_id, license_scan, mixing, nearest, ngram_join, packing, phrases, quality, sharding, token_files, url_filter
from .shared import ship, table
from .tokens import vocabulary


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ship(spark)
    return packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json"), 2048, 0), 2048)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, percent=90)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("detections")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), (3, 1, 2), 1.5, 2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20, relax=1.0)


#: 40 shards, and one more.
TREE = sharding.balanced(40)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), TREE, sharding.grown(TREE))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=100, longest=5, percent=100, top=2000)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"), least=10, k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_ngram_jaccard, op3_url_filters, op4_license_scans, op5_language_id, op6_quality_classifier, op7_exact_dedup, op8_token_files, op9_mixing, op10_nearest_neighbours, op11_sharding, op12_phrase_mining, op13_source_divergence)
}
WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWERED)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM w),
n AS (SELECT doc_id, len(x) AS n FROM s), e AS (SELECT doc_id, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, min(b) AS component_id FROM n JOIN r ON r.a = doc_id GROUP BY 1, 2""",
    "op10_nearest_neighbours": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s) SELECT query_id, CAST(rn AS INT) AS rank, vec_id, score FROM k WHERE rn <= 20""",
    "op7_exact_dedup": """WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM documents JOIN g ON coalesce(text, '') = t""",
    "op9_mixing": f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size, substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS code FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY 1),
v AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS level FROM s),
c AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS water FROM v WINDOW o AS (ORDER BY level, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN m IS NULL OR level <= m THEN cap ELSE weight * m END AS target FROM (SELECT *, arg_min(water, level) FILTER (water < level) OVER () AS m FROM c)),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
u AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY code) AS upto FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN upto < rest OR (upto - size < rest AND (rest - (upto - size)) * 2 > size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM u""",
    # CRC-32 by a table of its 256 steps, byte by byte.
    "op11_sharding": f"""WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
r AS (SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) AS text_crc32, CAST(doc_id AS VARCHAR) AS key FROM b, tab),
{sharding.placement_sql(TREE, "r", "p")},
{sharding.placement_sql(sharding.grown(TREE), "r", "g")}
SELECT r.doc_id, r.size, r.text_crc32, 'key' AS law, CAST(p.shard AS INT) AS shard, row_number() OVER (PARTITION BY p.shard ORDER BY r.doc_id) - 1 AS slot, CAST(g.shard AS INT) AS grown_shard FROM r JOIN p USING (doc_id) JOIN g USING (doc_id)""",
    "op12_phrase_mining": f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOWERED} AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT f.lang, f.k, f.phrase, f.a, j, x.a AS l, y.a AS r, CAST(1000::HUGEINT * f.a * t.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score, t.n
 FROM f JOIN range(1, 5) q(j) ON j < f.k JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(f.ws[1:j], ' ') JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(f.ws[j + 1:], ' ') JOIN t ON t.lang = f.lang WHERE f.k >= 2),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS best FROM c),
o AS (SELECT * FROM b WHERE best = 1 AND NOT EXISTS (SELECT 1 FROM f z WHERE z.lang = b.lang AND z.k > b.k AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * z.a >= 100 * b.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= 2000""",
    "op13_source_divergence": f"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT row, lang, source, unnest(w) AS term FROM d), c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS df FROM e GROUP BY 1, 2, 3),
k AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY 1, 2 HAVING sum(df) >= 10), v AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM k GROUP BY 1),
g AS (SELECT lang, source FROM d GROUP BY 1, 2),
x AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS n_all FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT x.*, CAST(1 + 1000000000 * (n + 2)::HUGEINT // (n_all + 2 * v) AS HUGEINT) AS p, CAST(1 + 1000000000 * (total + 2)::HUGEINT // (n_lang + 2 * v) AS HUGEINT) AS q FROM x JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10""",
}
