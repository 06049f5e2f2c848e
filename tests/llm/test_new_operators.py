"""Sharding, phrase mining and the divergence audit against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.llm import divergence, language_id, packing, phrases, sharding
from weftline.llm.shared import materialise, numbered, scratch_dir

# --- sharding


def placed(spark, tree, n=4000):
    rows = spark.range(n).select(F.col("id").cast("string").alias("key"))
    return {r.key: r.s for r in rows.select("key", sharding.place(F.col("key"), tree).alias("s")).collect()}


def test_grown_tree(spark):
    """One more shard, and then another, take rows only into themselves, about as many as their weights say."""
    tree = sharding.balanced(40)
    seen = placed(spark, tree)
    counts = Counter(seen.values())
    assert set(counts) == set(range(40)) and max(counts.values()) < 100 + 60
    for more in (sharding.grown(tree), sharding.grown(sharding.grown(tree, 3.0), 1.0)):
        after = placed(spark, more)
        moved = [k for k in seen if after[k] != seen[k]]
        new = max(more.shards)
        assert moved and all(after[k] >= 40 for k in moved) and new in set(after.values())
    assert abs(sum(s == 40 for s in placed(spark, sharding.grown(tree, 4.0)).values()) - 4000 * 4 / 44) < 80


def test_changed_weight(spark):
    """Rows that move are in the changed region before or after, and no shard without a weight has any."""
    weights = [1.0] * 24
    before = placed(spark, sharding.balanced(24, 3, 2, weights))
    weights[9] = 0.0
    weights[10] = 3.0
    after = placed(spark, sharding.balanced(24, 3, 2, weights))
    region = lambda s: s // 8
    moved = [k for k in before if before[k] != after[k]]
    assert moved and all(1 in (region(before[k]), region(after[k])) for k in moved) and 9 not in after.values()
    with pytest.raises(ValueError):
        sharding.levels(sharding.balanced(2, weights=[0.0, 0.0]))


def test_slots(spark):
    """Null ids, null and equal texts, rows that repeat, clashing names: each shard's slots are 0 to n - 1."""
    rng = random.Random(1)
    rows = [(rng.choice([None, k, k % 50]), rng.choice([None, "", "é" * (k % 5), "same text"]), "?", 9, "law?") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, slot int, law string")
    got = sharding.assign(docs, sharding.balanced(7, 2, 2)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by, where = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.law == "key" and r.grown_shard in (r.shard, 7)
        if r.doc_id is not None:
            assert where.setdefault(r.doc_id, r.shard) == r.shard
    for own in by.values():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size) for r in own]
        assert order == sorted(order)
    assert len({r.shard for r in got if r.doc_id is None}) > 1
    assert sharding.assign(docs.limit(0), sharding.balanced(3)).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text"))
    tree = sharding.balanced(5, 2, 1)
    sharding.write_shards(docs, tree, f"file://{tmp_path}/a", 2)
    back = spark.read.parquet(f"file://{tmp_path}/a")
    assert back.count() == 300 and {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.s) for r in docs.select("doc_id", sharding.place(F.col("doc_id").cast("string"), tree).alias("s")).collect()}
    sharding.write_shards(docs, tree, f"file://{tmp_path}/b", 1, F.md5("text"))
    assert all(r.n == 1 for r in spark.read.parquet(f"file://{tmp_path}/b").groupBy("text").agg(F.countDistinct("shard").alias("n")).collect())
    moves = sharding.moved(docs, tree, sharding.grown(tree)).collect()
    assert moves and all(r.to_shard == 5 and r.bytes == r.rows * 18 for r in moves)


def test_numbered(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([0, 0, 0, k]), "x") for k in range(800)]
    folder = scratch_dir(spark)
    stored = materialise(spark.createDataFrame(rows, "g string, v int, n string"), "rows", folder)
    got = numbered(stored, ["g"], [F.desc("v")], "place", folder).collect()
    for g in "ab":
        own = sorted((r.place, r.v) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted((v for x, v, _ in rows if x == g), reverse=True)


# --- phrases


def mined(rows, least, longest, percent, top):
    words, counts = Counter(), {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often, n = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, words[lang]
        found = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items())
            score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "mit", "é", "ß", "a-b", "x y", "of", "q", "zz"]
    texts = [None, "", " . ", "the. of", "one\ttwo\rthree"]
    for _ in range(n):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ", ", "\t", ".", "\n", "! "]) for _ in range(rng.randrange(1, 60))))
    texts += ["the mit of q zz the mit of q zz"] * 15 + texts[5:8]
    return [(rng.choice([None, "en", "en", "en", "de", "und"]), t) for t in texts]


@pytest.mark.parametrize(("least", "percent", "options"), [(6, 100, {}), (9, 70, {"most_names": 0}), (6, 100, {"chunk": 64, "most_names": 10})])
def test_phrases(spark, least, percent, options):
    """Names by broadcast, by joins and by both; chunks that end within a text."""
    rows = corpus(3)
    docs = spark.createDataFrame([(lang, t, "?", 1) for lang, t in rows], "lang string, text string, phrase string, n int").repartition(3)
    got = phrases.collocations(docs, least, 5, percent, 40, **options)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert got.columns == columns and sorted(tuple(r) for r in got.collect()) == mined(rows, least, 5, percent, 40)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert phrases.collocations(docs).count() == 0 and phrases.collocations(docs.limit(0)).count() == 0


def test_large_scores(spark):
    """Products of more than 64 bits."""
    rows = spark.createDataFrame([(10**12, 10**15, [10**12, 10**12], [10**12 + 1, 10**12])], "f long, n long, heads array<long>, tails array<long>")
    assert rows.select(F.array_min(F.expr(phrases.CUTS)).alias("c")).first().c.score == 1000 * 10**12 * 10**15 // (10**12 * (10**12 + 1))


# --- divergence


def audited(rows, least, k):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for lang, source, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, total, by = Counter(), Counter(), {}
        for x, source, words in docs:
            if x == lang:
                df.update(set(words))
                total.update(words)
                by.setdefault(source, Counter()).update(words)
        kept = [t for t in df if df[t] >= least]
        v = len(kept)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * v) for t in kept}
        q, of = p(total), {s: p(c) for s, c in by.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = sorted((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode()) for o in by if o != s)
            terms = sorted((-f(of[s][t], q[t]), t.encode()) for t in kept if by[s][t] and of[s][t] > q[t])[:k]
            out += [(lang, s, part, i.decode(), -x, n) for part, found in (("pair", pairs), ("term", terms)) for n, (x, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "size"), [(10, divergence.SLICE), (2, 40)])
def test_divergence(spark, least, size):
    """Groups without terms, a lang without kept terms, nulls, ties, texts longer than a slice."""
    rng = random.Random(4)
    words = ["the", "The", "mit", "é", "É", "ß", "a1b", "x y", "of", "q", "zz", "tie", "eit"]
    rows = [(rng.choice([None, "en", "en", "de"]), rng.choice([None, "a", "b", "c", "é", ""]), " ".join(rng.choice(words) + rng.choice(["", ".", "7"]) for _ in range(rng.randrange(40)))) for _ in range(150)]
    rows += [("en", "empty", None), ("fr", "only", "un"), ("fr", "other", ""), ("nothing", "x", "12"), *rows[:5], ("en", "a", "tie eit " * 300)]
    docs = spark.createDataFrame([(*r, "?", 1) for r in rows], "lang string, source string, text string, item string, n int").repartition(3)
    got = divergence.audit(docs, least, 4, size)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audited(rows, least, 4)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_first_of(spark, monkeypatch):
    """Radix select down to the last byte of items: ties of values, items that begin like others, groups of few rows."""
    monkeypatch.setattr(divergence, "SORTED", 1)
    rng = random.Random(5)
    rows = {(rng.choice(["big", "big", "big", "small"]), rng.choice([7, 7, 7, 70_000, 3_000_000_000, 0]), "".join(rng.choice("aé中") for _ in range(rng.randrange(1, 6)))) for _ in range(900)} | {("one", 5, "x")}
    folder = scratch_dir(spark)
    stored = materialise(spark.createDataFrame(sorted(rows), "g string, v long, item string").repartition(4), "rows", folder)
    for k in (1, 3, 40):
        got = sorted((r.g, r["rank"], r.v, r.item) for r in divergence.first_of(stored, ["g"], "v", "item", k, f"{folder}/{k}").collect())
        want = [(g, n, v, i) for g in ("big", "one", "small") for n, (v, i) in enumerate(sorted(((v, i) for x, v, i in rows if x == g), key=lambda r: (-r[0], r[1].encode()))[:k], 1)]
        assert got == want


# --- numbers and filters


def test_sequence_numbers():
    """Rounds, tasks and full pieces never share a number."""
    last = packing.sequence_base(0, (1 << packing.TASK_BITS) - 1) + (1 << packing.PLACE_BITS) - 1
    assert last < packing.sequence_base(1, 0) and packing.sequence_base(10_000, 1_000_000) + (1 << packing.PLACE_BITS) < packing.FULL
    for round_, task in ((1 << 14, 0), (0, 1 << 20)):
        with pytest.raises(ValueError):
            packing.sequence_base(round_, task)


def test_filters_keep_all(spark):
    """Every n-gram that is likely enough, however many; slots grow with them."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)) for _ in range(3)]
    rows = [(k, t, "x") for k, t in enumerate([*texts, *texts])] + [(None, "some other words", "y")] * 2
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["x", "y"] and model.bits >= 20 and 0.05 < model.false[0] ** 0.5 <= language_id.FILL and model.false[1] < 1e-6


def test_answers_of_a_chunk_at_a_time(spark, monkeypatch):
    """Names that come by a join are not gathered in lists by an aggregation, which would hold those of many chunks; and files
    of chunks are small."""
    from weftline.llm import phrases, shared

    plans, files = [], []

    def watched(df, tag, *rest):
        plans.append((tag, df._jdf.queryExecution().optimizedPlan().toString()))
        files.append((tag, rest))
        return shared.materialise(df, tag, *rest)

    monkeypatch.setattr(phrases, "materialise", watched)
    docs = spark.createDataFrame([("en", "a b c d. " * 30)] * 40, "lang string, text string")
    got = {tuple(r) for r in phrases.collocations(docs, least=5, chunk=600, most_names=0).collect()}
    assert got == {tuple(r) for r in phrases.collocations(docs, least=5).collect()} and got
    assert not any("collect_list" in plan for tag, plan in plans if tag.startswith("chunks"))
    assert all(rest[-1] == phrases.FILE_CHUNKS for tag, rest in files if tag.startswith("chunks"))


def test_scratch_of_a_join_goes(spark, tmp_path):
    """Of the join's tables only those stay that its result is made of, and nothing that was shuffled."""
    from weftline.llm import ngram_join

    folder = str(tmp_path / "scratch")
    words = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, words + f" x{k % 7}") for k in range(60)] + [(k, f"q{k} r{k} s{k} t{k}") for k in range(100, 140)], "doc_id long, text string")
    before = ngram_join.scratch_dir
    try:
        ngram_join.scratch_dir = lambda _: folder
        got = {(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    finally:
        ngram_join.scratch_dir = before
    assert got == {(k, 0) for k in range(60)} | {(k, k) for k in range(100, 140)}
    left = {p.name for p in (tmp_path / "scratch").iterdir()}
    assert not left & {"prints", "shared", "grams0", "grams1", "grams2", "sets", "met", "full"}


def test_chunk_files(spark, monkeypatch):
    """Eight chunks share a file: a local disk pays for each file with processes."""
    seen = {}

    def watched(df, tag, folder=None, compression=None, file_rows=0):
        out = materialise(df.coalesce(1) if tag.startswith("chunks") else df, tag, folder, compression, file_rows)
        if tag.startswith("chunks"):
            seen[tag] = (out.count(), len(out.inputFiles()))
        return out

    monkeypatch.setattr(phrases, "materialise", watched)
    docs = spark.createDataFrame([("en", "a b c d e " * 100) for _ in range(40)], "lang string, text string")
    phrases.collocations(docs, least=5, chunk=600).count()
    assert seen["chunks0"][0] > 16 and all(files == -(-chunks // 8) for chunks, files in seen.values())
