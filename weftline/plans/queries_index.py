"""The text index: tokens, vocabulary, BM25, phrases, prefixes, tiers, fallback; evaluation of rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import text
from ..operators import evaluation, keptindex, textindex
from ..operators.keptindex import Unit
from ..session import scratch, ship, state, table
from . import views
from .registry import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
TERMS = ["the", "of", "and"]
TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
POST = f"toks AS (SELECT doc_id, unnest({TOK}) AS term FROM documents)"
TF = f"{POST}, tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2), dl AS (SELECT doc_id, len({TOK}) AS dl FROM documents WHERE len({TOK}) > 0)"
BM25 = f"""{TF}, st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf WHERE term IN ('the', 'of', 'and') GROUP BY 1),
bm AS (SELECT tf.doc_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY 1)"""


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def tokens():
    return text.words(F.col("text"))


_KEPT: dict[tuple, keptindex.Index] = {}


def kept(spark, sf_dir, kind="words"):
    """The kept index of a folder's documents, built on first use and used from then on, as long as the table stays as it is."""
    key = (spark.sparkContext.applicationId, sf_dir, kind, state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _KEPT:
        ship(spark)
        rows = docs(spark, sf_dir)
        if kind == "words":
            _KEPT[key] = keptindex.Index.build(rows, tokens(), scratch(spark, "index-words"))
        else:
            held = 2 * keptindex.bytes_of(rows)  # of a Latin letter, three bytes; these are about two fifths of a text
            rows = rows.select("doc_id", mixed(F.col("text")).alias("text")).select("doc_id", text.folded(F.col("text")).alias("text"))  # each made once
            at = F.timestamp_seconds(F.col("doc_id") % 7 * 86_400)
            _KEPT[key] = keptindex.Index.build(rows, text.mixed_tokens(F.col("text")), scratch(spark, "index-mixed"), text=F.col("text"), at=at, linked=F.col("doc_id") % 3 != 0, held=held)
    return _KEPT[key]


#: Letters that become CJK characters, so that texts are of mixed script.
LATIN, CJK = "aeiou", "三体小说电"


def mixed(c):
    return F.translate(F.lower(c), LATIN, CJK)


@R.add(f"WITH {POST} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM toks GROUP BY 1")
def doc_freq(spark, sf_dir):
    return kept(spark, sf_dir).vocabulary()


@R.add(f"WITH {POST}, n AS (SELECT count(*) AS n FROM documents) SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(DISTINCT doc_id) AS df FROM toks GROUP BY 1), n")
def idf(spark, sf_dir):
    d = docs(spark, sf_dir)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    return kept(spark, sf_dir).vocabulary().crossJoin(F.broadcast(n)).select("term", F.round(textindex.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@R.add(f"SELECT doc_id, md5(array_to_string({TOK}, ' ')) AS tokens, len({TOK}) AS dl FROM documents")
def index_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(tokens(), " ").cast("binary")).alias("tokens"), F.size(tokens()).cast("long").alias("dl"))


@R.add(f"WITH {TF} SELECT doc_id, term, tf FROM tf WHERE term IN ('the', 'of', 'and')")
def postings_of_terms(spark, sf_dir):
    return kept(spark, sf_dir).postings(*TERMS).select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


@R.add(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, doc_id LIMIT 50")
def bm25_topk(spark, sf_dir):
    scores = kept(spark, sf_dir).scored([Unit((t,)) for t in TERMS]).select("doc_id", F.round("score", 6).alias("score"))
    return scores.orderBy(F.desc("score"), "doc_id").limit(50)


@R.add(f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id DESC LIMIT 50")
def bounded_topk(spark, sf_dir):
    """The best documents by blocks of postings, of which only those are read that can hold one."""
    return kept(spark, sf_dir).top(TERMS, 50).select("doc_id", F.round("score", 6).alias("score"))


@R.add(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({TOK}, ' ') || ' ', ' of the ')")
def phrase_match(spark, sf_dir):
    return kept(spark, sf_dir).matches(Unit(("of", "the"))).select("doc_id")


@R.add(f"SELECT doc_id FROM documents WHERE len(list_filter({TOK}, lambda t: starts_with(t, 'tion'))) > 0")
def prefix_match(spark, sf_dir):
    return kept(spark, sf_dir).matches(Unit(("tion",), prefix=True)).select("doc_id")


def tiers(spark, sf_dir):
    return kept(spark, sf_dir).tiered([Unit((t,)) for t in TERMS], [Unit(("the",)), Unit(("of",))])


@R.add(f"SELECT doc_id, CASE WHEN a AND b AND c THEN 1 WHEN a AND b THEN 2 WHEN a OR b THEN 3 END AS tier FROM (SELECT doc_id, list_contains({TOK}, 'the') AS a, list_contains({TOK}, 'of') AS b, list_contains({TOK}, 'and') AS c FROM documents) WHERE a OR b")
def recall_tiers(spark, sf_dir):
    return tiers(spark, sf_dir).select("doc_id", "tier")


@R.add(f"""WITH {BM25}, t AS (SELECT doc_id, CASE WHEN a AND b AND c THEN 1 WHEN a AND b THEN 2 WHEN a OR b THEN 3 END AS tier FROM (SELECT doc_id, list_contains({TOK}, 'the') AS a, list_contains({TOK}, 'of') AS b, list_contains({TOK}, 'and') AS c FROM documents) WHERE a OR b)
SELECT doc_id, tier FROM t JOIN bm USING (doc_id) ORDER BY tier, round(score, 9) DESC, doc_id LIMIT 40""")
def tiered_recall(spark, sf_dir):
    return tiers(spark, sf_dir).orderBy("tier", F.desc(F.round("score", 9)), "doc_id").limit(40).select("doc_id", "tier")


@R.add("SELECT doc_id, CAST(contains(lower(text), 'thou') AS INT) + CAST(contains(lower(text), 'edha') AS INT) AS hits FROM documents WHERE contains(lower(text), 'thou') OR contains(lower(text), 'edha')")
def like_fallback(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", textindex.substring_hits(F.col("text"), ["thou", "edha"]).alias("hits"))
    return rows.filter("hits > 0")


@R.add(f"WITH {TF} SELECT doc_id FROM tf WHERE term IN ('the', 'of', 'and') GROUP BY 1 HAVING count(*) >= 2")
def boolean_two_of_three(spark, sf_dir):
    found = kept(spark, sf_dir).scored([Unit((t,)) for t in TERMS])
    return found.filter(F.size(F.filter("has", lambda x: x)) >= 2).select("doc_id")


# Texts of mixed script: letters become CJK characters, which are indexed as overlapping pairs.
CJK_CLASS = "㐀-鿿"
FOLDED = f"replace(lower(translate(lower(text), '{LATIN}', '{CJK}')), 'ß', 'ss')"
JOINED = FOLDED
for _ in range(2):  # separators between CJK characters go; twice, as what is joined may be a single character
    JOINED = f"regexp_replace({JOINED}, '([{CJK_CLASS}])[^a-z0-9{CJK_CLASS}]+([{CJK_CLASS}])', '\\1\\2', 'g')"
MIXED = f"""runs AS (SELECT doc_id, regexp_extract_all({JOINED}, '[a-z0-9]+|[{CJK_CLASS}]+') AS r FROM documents),
mt AS (SELECT doc_id, flatten(list_transform(r, lambda x: CASE WHEN regexp_matches(x, '^[a-z0-9]') THEN [x] ELSE list_transform(range(1, greatest(length(x) - 1, 1) + 1), lambda i: substr(x, i, 2)) END)) AS t FROM runs)"""


@R.add(f"WITH {MIXED}, f AS (SELECT doc_id, unnest(t) AS term FROM mt) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM f GROUP BY 1")
def mixed_vocabulary(spark, sf_dir):
    """Terms of the index of mixed-script texts."""
    return kept(spark, sf_dir, "mixed").vocabulary()


@R.add(f"WITH {MIXED} SELECT doc_id FROM mt WHERE list_contains(t, '小说') OR list_contains(t, '三体') ORDER BY doc_id % 7 DESC, doc_id DESC LIMIT 40")
def newest_first(spark, sf_dir):
    """The newest documents with any of two terms, by the newest times of blocks."""
    ship(spark)
    return kept(spark, sf_dir, "mixed").top(["小说", "三体"], 40, newest=True).select("doc_id")


#: A term of three CJK characters, as its two pairs one after another.
TRIPLE = "三体三"
PHRASE_TF = "len(list_filter(range(1, len(t)), lambda i: t[i] = '三体' AND t[i + 1] = '体三'))"


@R.add(f"WITH {MIXED} SELECT doc_id, CAST({PHRASE_TF} AS INT) AS tf FROM mt WHERE {PHRASE_TF} > 0")
def cjk_phrase(spark, sf_dir):
    """A CJK term's places, by positions of its pairs."""
    return kept(spark, sf_dir, "mixed").matches(keptindex.unit_of(TRIPLE)).select("doc_id", "tf")


@R.add(f"WITH {MIXED} SELECT doc_id, CAST(len(list_filter(t, lambda x: starts_with(x, '电'))) AS INT) AS tf FROM mt WHERE len(list_filter(t, lambda x: starts_with(x, '电'))) > 0")
def cjk_prefix(spark, sf_dir):
    """A lone CJK character, by the range of pairs that begin with it."""
    return kept(spark, sf_dir, "mixed").matches(keptindex.unit_of("电")).select("doc_id", "tf")


@R.add(f"""WITH {MIXED}, x AS (SELECT doc_id, len(t) AS dl, {PHRASE_TF} AS a, len(list_filter(t, lambda x: x = '小说')) AS b, len(list_filter(t, lambda x: starts_with(x, 'thth'))) AS c FROM mt WHERE len(t) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db, count(*) FILTER (c > 0) AS dc FROM x),
s AS (SELECT doc_id, {' + '.join(f"CASE WHEN {u} > 0 THEN greatest(ln((n - d{u} + 0.5) / (d{u} + 0.5)), 1e-6) * {u} * 2.2 / ({u} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for u in "abc")} AS score,
 CASE WHEN a > 0 AND b > 0 AND c > 0 THEN 1 WHEN a > 0 AND b > 0 THEN 2 WHEN a > 0 OR b > 0 THEN 3 END AS tier FROM x, st)
SELECT doc_id, tier, round(score, 6) AS score FROM s WHERE tier IS NOT NULL ORDER BY tier, round(score, 9) DESC, doc_id DESC LIMIT 30""")
def mixed_search(spark, sf_dir):
    """A search of units of all three kinds by tiers: a phrase of pairs, a pair, a prefix. Subjects are the first two."""
    found = kept(spark, sf_dir, "mixed").tiered([keptindex.unit_of(t) for t in (TRIPLE, "小说", "thth")], [keptindex.unit_of(t) for t in (TRIPLE, "小说")])
    return found.orderBy("tier", F.desc(F.round("score", 9)), F.desc("doc_id")).limit(30).select("doc_id", "tier", F.round("score", 6).alias("score"))


@R.add(f"""WITH {MIXED}, x AS (SELECT mt.doc_id, list_has_any(list_transform(t, lambda y: y[1:4]), ['thth']) AS c, {PHRASE_TF} > 0 AS a FROM mt)
SELECT x.doc_id FROM x JOIN documents d ON d.doc_id = x.doc_id WHERE a AND NOT c""")
def cjk_without_latin(spark, sf_dir):
    """Boolean: one unit and not another."""
    found = kept(spark, sf_dir, "mixed").scored([keptindex.unit_of(TRIPLE), keptindex.unit_of("thth")])
    return found.filter(F.get("has", F.lit(0)) & ~F.get("has", F.lit(1))).select("doc_id")


#: A term with a character that pairs with whatever comes before it in a text: only its other token is asked of the index.
LONE = "说thth"
GAP = "[" + X.SEPARATORS.replace("'", "''") + "]*"
HELD = f"""{MIXED}, p AS (SELECT doc_id, regexp_matches({FOLDED}, '{GAP.join(LONE)}') AS lone FROM documents),
x AS (SELECT mt.doc_id, lone, len(t) AS dl, {PHRASE_TF} AS a, len(list_filter(t, lambda x: x = 'thth')) AS b, len(list_filter(t, lambda x: x = '小说')) AS c, mt.doc_id % 7 AS day FROM mt JOIN p ON p.doc_id = mt.doc_id WHERE len(t) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f"count(*) FILTER ({u} > 0) AS d{u}" for u in "abc")} FROM x)"""
PART = {u: f"CASE WHEN {u} > 0 THEN greatest(ln((n - d{u} + 0.5) / (d{u} + 0.5)), 1e-6) * {u} * 2.2 / ({u} + 1.2 * (0.25 + 0.75 * dl / avgdl)) ELSE 0 END" for u in "abc"}
WHOLE = f"""{HELD}, s AS (SELECT doc_id, day, {' + '.join(PART.values())} AS score, CASE WHEN a > 0 AND b > 0 AND c > 0 AND lone THEN 1 WHEN a > 0 AND b > 0 AND lone THEN 2 WHEN a > 0 OR (b > 0 AND lone) THEN 3 END AS tier FROM x, st)"""


def found_by(index, **options):
    return index.search([TRIPLE, LONE, "小说"], [TRIPLE, LONE], **options).select("doc_id", "tier", F.round("score", 6).alias("score"))


@R.add(f"WITH {WHOLE} SELECT doc_id, tier, round(score, 6) AS score FROM s WHERE tier IS NOT NULL ORDER BY tier, round(score, 9) DESC, day DESC, doc_id DESC LIMIT 20")
def indexed_search(spark, sf_dir):
    """A whole search by the kept index: a phrase that needs no proof, a term that is held against candidates' texts, and one
    more; by tier, BM25, time and id."""
    ship(spark)
    return found_by(kept(spark, sf_dir, "mixed"))


@R.add(f"WITH {WHOLE} SELECT doc_id, tier, round(score, 6) AS score FROM s WHERE tier IS NOT NULL AND doc_id % 3 <> 0 ORDER BY tier, round(score, 9) DESC, day DESC, doc_id DESC LIMIT 200")
def linked_search(spark, sf_dir):
    """The same over documents with links only."""
    ship(spark)
    return found_by(kept(spark, sf_dir, "mixed"), limit=200, linked=True)


@R.add(f"WITH {HELD} SELECT doc_id, CAST(b AS INT) AS tf, lone AS has_term FROM x WHERE b > 0")
def isolated_candidates(spark, sf_dir):
    """Candidates of a term with a lone character, and which of them have it."""
    ship(spark)
    index = kept(spark, sf_dir, "mixed")
    texts = index.forward.select("doc_id", F.col("text").rlike(text.term_regex(LONE)).alias("has_term"))
    return index.matches(keptindex.unit_of(LONE)).join(texts, "doc_id").select("doc_id", "tf", "has_term")


@R.add(f"WITH {HELD}, s AS (SELECT doc_id, day, {PART['b']} AS score FROM x, st WHERE b > 0 AND lone) SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, day DESC, doc_id DESC LIMIT 100")
def isolated_search(spark, sf_dir):
    """A search for nothing but a term that no unit proves: texts decide, as many as it takes."""
    ship(spark)
    return kept(spark, sf_dir, "mixed").search([LONE], [LONE], limit=100).select("doc_id", F.round("score", 6).alias("score"))


VERT = "SELECT doc_id, " + ", ".join(f"round({' + '.join(f'''CASE WHEN contains(lower(text), '{w}') THEN {1 + len(w) / 10} ELSE 0 END''' for w in sorted(set(X.VERTICALS[v])))}, 4) AS s{k}" for k, v in enumerate(("game", "academic", "design"))) + " FROM documents"


@R.add(f"WITH v AS ({VERT}) SELECT doc_id, CASE WHEN s0 >= s1 AND s0 >= s2 THEN 'game' WHEN s1 >= s2 THEN 'academic' ELSE 'design' END AS vertical, CAST(greatest(s0, s1, s2) AS DOUBLE) AS score FROM v WHERE s0 + s1 + s2 > 0")
def classify_vertical(spark, sf_dir):
    low = F.lower("text")
    scores = [F.round(sum((F.when(F.contains(low, F.lit(w)), 1 + len(w) / 10).otherwise(0.0) for w in sorted(set(X.VERTICALS[v]))), F.lit(0.0)), 4).alias(v) for v in ("game", "academic", "design")]
    rows = docs(spark, sf_dir).select("doc_id", *scores).filter("game + academic + design > 0")
    best = F.when((F.col("game") >= F.col("academic")) & (F.col("game") >= F.col("design")), "game").when(F.col("academic") >= F.col("design"), "academic").otherwise("design")
    return rows.select("doc_id", best.alias("vertical"), F.greatest("game", "academic", "design").alias("score"))


EVERY = ", ".join(f"struct_pack(worse := -round({' + '.join(f"CASE WHEN contains(t, '{w}') THEN {1 + len(w) / 10} ELSE 0 END" for w in sorted(set(words)))}, 4), name := '{v}')" for v, words in X.VERTICALS.items())


@R.add(f"WITH d AS (SELECT doc_id, lower(text) || CASE doc_id % 6 WHEN 0 THEN ' 电影 4k' WHEN 1 THEN ' vst 教程' WHEN 2 THEN ' 漫画 小说' ELSE '' END AS t FROM documents) SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([{EVERY}], lambda s: s.worse < 0))[1:3], lambda s: s.name), ' ') AS verticals FROM d")
def verticals_top3(spark, sf_dir):
    """The verticals of a text, out of all."""
    more = F.when(F.col("doc_id") % 6 == 0, " 电影 4k").when(F.col("doc_id") % 6 == 1, " vst 教程").when(F.col("doc_id") % 6 == 2, " 漫画 小说").otherwise("")
    return docs(spark, sf_dir).select("doc_id", F.array_join(text.verticals(F.concat("text", more)), " ").alias("verticals"))


JUDGED = "judged AS (SELECT d.source AS query, d.doc_id, CAST(quality + CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS INT) AS grade, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS pos FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL)"


def judged(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("query"), "n_chars").join(table(spark, sf_dir, "labels").filter("quality is not null"), "doc_id")
    place = Window.partitionBy("query").orderBy(F.desc("n_chars"), "doc_id")
    return rows.select("query", "doc_id", (F.col("quality") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).cast("int").alias("grade"), F.row_number().over(place).alias("pos"))


METRICS = f"""WITH {JUDGED}, ideal AS (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC) AS pos FROM judged),
g AS (SELECT query, sum((pow(2, grade) - 1) / log2(pos + 1)) FILTER (pos <= 10) AS dcg, count(*) FILTER (pos <= 10 AND grade > 0) AS good, count(*) FILTER (pos <= 10) AS shown, count(*) FILTER (grade > 0) AS relevant FROM judged GROUP BY 1),
i AS (SELECT query, sum((pow(2, grade) - 1) / log2(pos + 1)) AS idcg FROM ideal WHERE pos <= 10 GROUP BY 1)"""


@R.add(f"{METRICS} SELECT query, round(good / shown, 6) AS precision, round(good / relevant, 6) AS recall, round(dcg / idcg, 6) AS ndcg FROM g JOIN i USING (query) WHERE relevant > 0")
def ndcg_at_10(spark, sf_dir):
    return evaluation.metrics(judged(spark, sf_dir), 10)


@R.add(f"{METRICS}, m AS (SELECT good / shown AS p, good / relevant AS r, dcg / idcg AS n FROM g JOIN i USING (query) WHERE relevant > 0) SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(n), 6) AS ndcg, avg(p) >= 0.95 AND avg(r) >= 0.95 AND avg(n) >= 0.95 AS passed FROM m")
def quality_gate(spark, sf_dir):
    return evaluation.gate(evaluation.metrics(judged(spark, sf_dir), 10), 0.95)


FOUND = f"found AS (SELECT DISTINCT 'q' || CAST(seq % 10 AS VARCHAR) AS query, url AS key, kind AS grp FROM ({views.HITS})), n AS (SELECT query, key, count(*) AS n FROM found GROUP BY 1, 2)"


def found(spark, sf_dir):
    return views.hits(spark, sf_dir).select(F.concat(F.lit("q"), (F.col("seq") % 10).cast("string")).alias("query"), F.col("url").alias("key"), F.col("kind").alias("grp")).distinct()


@R.add(f"WITH {FOUND} SELECT query, count(*) AS seen, count(*) FILTER (n = 1) AS q1, count(*) FILTER (n = 2) AS q2, round(count(*) + CASE WHEN count(*) FILTER (n = 2) > 0 THEN pow(count(*) FILTER (n = 1), 2) / (2.0 * count(*) FILTER (n = 2)) ELSE count(*) FILTER (n = 1) * (count(*) FILTER (n = 1) - 1) / 2.0 END, 6) AS chao2 FROM n GROUP BY 1")
def chao2(spark, sf_dir):
    return evaluation.chao2(found(spark, sf_dir))


@R.add(f"""WITH {FOUND}, s AS (SELECT query, grp, count(*) AS n FROM found GROUP BY 1, 2), b AS (SELECT a.query, a.grp AS a, b.grp AS b, count(*) AS m FROM found a JOIN found b ON a.query = b.query AND a.key = b.key AND a.grp < b.grp GROUP BY 1, 2, 3)
SELECT x.query, x.grp AS a, y.grp AS b, coalesce(m, 0) AS both, round((x.n + 1) * (y.n + 1) / (coalesce(m, 0) + 1.0) - 1, 6) AS chapman FROM s x JOIN s y ON x.query = y.query AND x.grp < y.grp LEFT JOIN b ON b.query = x.query AND b.a = x.grp AND b.b = y.grp""")
def chapman_pairs(spark, sf_dir):
    return evaluation.chapman(found(spark, sf_dir), ["api", "forum", "tg", "websearch"])


@R.add(f"WITH {FOUND} SELECT coalesce(grp, 'ALL') AS grp, count(*) AS links, count(DISTINCT key) AS keys FROM found GROUP BY ROLLUP (grp)")
def coverage_rollup(spark, sf_dir):
    return found(spark, sf_dir).rollup("grp").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("key").alias("keys")).withColumn("grp", F.coalesce("grp", F.lit("ALL")))


@R.add(f"WITH {FOUND}, one AS (SELECT query, key FROM n WHERE n = 1) SELECT grp, count(*) AS only_here FROM found JOIN one USING (query, key) GROUP BY 1")
def only_by_source(spark, sf_dir):
    return evaluation.only_here(found(spark, sf_dir))


@R.add(f"""WITH r AS (SELECT source AS vertical, CAST(doc_id AS VARCHAR) AS keyword, doc_id FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY vertical ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY vertical) AS n FROM r)
SELECT vertical, keyword FROM k WHERE pos % greatest(1, n // 5) = 0 AND pos // greatest(1, n // 5) < 5""")
def query_sampling(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("vertical"), F.col("doc_id").cast("string").alias("keyword"), F.col("doc_id").alias("seq"))
    return evaluation.equidistant(rows, "vertical", "seq", 5).select("vertical", "keyword")


@R.add("SELECT event_type, median(value) AS mid, count(*) AS n FROM events GROUP BY 1")
def stage_medians(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("mid"), F.count(F.lit(1)).alias("n"))
