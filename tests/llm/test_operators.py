"""Each operator on small tables with odd rows, against plain versions of what it computes."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import exact_dedup, language_id, license_scan, mixing, nearest, ngram_join, packing, quality, token_files, tokens, url_filter
from weftline.llm.components import components
from weftline.llm.shared import ship

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


def docs_of(spark, texts, langs=None, sources=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, v=300):
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    near = [" ".join(t if rng.random() > 0.02 else "zz" for t in b.split()) for b in base[:30] for _ in range(3)]
    return [None, "", "   \n", "one", "One", "two words", *base, *near, *base[:20], *[base[0]] * 30, words(rng, 60_000)]


def test_exact_dedup(spark, texts):
    docs = docs_of(spark, texts)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    expected = {(i, max(g), len(g), i == max(g), hashlib.sha256((texts[i] or "").encode()).hexdigest()) for g in groups.values() for i in g}
    for options in ({}, {"segment": 1000}, {"primes": (7, 11), "broadcast_rows": 0}):  # small primes collide
        got = exact_dedup.exact_dedup(docs, **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert len(got) == len(texts) and set(map(tuple, got)) == expected, options


def test_exact_dedup_repeated_and_empty(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, "b"), (2, "c")], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup.exact_dedup(rows).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, False), (None, 1, 3, False), (2, 2, 1, True), (2, 2, 1, True)], key=str)
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0


def test_fingerprints_compose():
    a, b, p = b"hello " * 3000, b"world" * 999, exact_dedup.PRIMES[0]
    whole = np.frombuffer(a + b, np.uint8)
    h, _ = exact_dedup.fingerprints(whole, np.array([0, len(whole)]), p)
    parts, shifts = exact_dedup.fingerprints(whole, np.array([0, len(a), len(a) + len(b)]), p)
    assert exact_dedup.combine(int(parts[0]), int(parts[1]), int(shifts[1]), p) == int(h[0])


def jaccard_classes(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "percent", "grams"), [(3, 90, 1_000_000), (5, 80, 300)])
def test_ngram_join(spark, texts, n, percent, grams):
    got = ngram_join.jaccard_components(docs_of(spark, texts), n, percent, task_grams=grams, broadcast_rows=0 if grams < 1000 else 1000)
    assert set(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == jaccard_classes(texts, n, percent)


def test_ngram_join_empty(spark):
    assert ngram_join.jaccard_components(docs_of(spark, [None]).limit(0)).count() == 0
    assert ngram_join.jaccard_components(docs_of(spark, [None, ""])).count() == 2


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if any(a != b and x in (a, b) for a, b in pairs)}


PIECES = [" ", "  ", "\n", "\n\n", "\t", "a", "Bc", "é", "́", "ß", "İ", "'s", "1", "%", "***", "<|endoftext|>", "<|startoftext|>", "<|end", "\x1c", " ", "\xa0", "日本", "😀", " the", "Über,", "été."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens(name):
    """Equal to the library's own ids from the file as loaded, spellings of special tokens included."""
    rng = random.Random(2)
    t = tokens.PieceTokenizer(tokens.vocabulary(name), keep=50)
    assert t.known
    some = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(1500)]
    expected = [e.ids for e in Tokenizer.from_file(tokens.vocabulary(name)).encode_batch(some, add_special_tokens=False)]
    assert [list(x) for x in t.ids(some)] == expected


def test_tokens_of_another_file(tmp_path):
    """A file of another kind goes to the library."""
    spec = json.load(open(tokens.vocabulary("byte_bpe_50k.json")))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    t, some = tokens.PieceTokenizer(str(path)), ["a b", "", " x", "<|endoftext|> y"]
    assert not t.known and [list(x) for x in t.ids(some)] == [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(some, add_special_tokens=False)]


def test_token_files(spark, texts, tmp_path):
    ids = np.array([0, 1, 255, 256, 65535, 65536, 1 << 24, 7] * 300, np.uint32)
    raw = token_files.to_bytes(np.array([5, 6]), np.array([0, 1000, len(ids)]), ids)
    f = token_files.TokenFile(lambda at, n: raw[at : at + n])
    assert all((f.ids(a, b) == ids[a:b]).all() for a, b in [(0, 0), (0, 1), (5, 6), (511, 514), (700, 2400), (0, len(ids))]) and len(f.document(1)) == 1400
    ship(spark)
    path = tokens.vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    at, expected = 0, []
    for i, text in enumerate(texts):
        x = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    got = token_files.token_file_digest(docs_of(spark, texts).repartition(3), path, 0, file_ids=5000)
    assert sorted(map(tuple, got.collect())) == expected


def test_pieces(spark, texts):
    """Pieces against plain encoding by the library: every row, repeated and null ids too."""
    ship(spark)
    path = tokens.vocabulary("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    some = [*texts, "a <|endoftext|> b", "x<|startoftext|>", "<|endoftext|>", None]
    ids_of = [*range(len(some) - 2), 0, None]
    rows = spark.createDataFrame(list(zip(ids_of, some, ["?"] * len(some), ["?"] * len(some))), "doc_id long, text string, length string, piece string")
    expected = []
    for i, t in zip(ids_of, some):
        x = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected += [(i, k, a, len(x[a : a + 256]), zlib.crc32(x[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(x), 256))]
    got = packing.pieces(rows, path, 256, 0)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    packed = packing.pack(got.withColumn("offset", F.lit("?")).withColumn("gap", F.lit("?")), 256, task_rows=50)
    assert sorted((tuple(r)[:5] for r in packed.collect()), key=str) == sorted(expected, key=str)
    certified = packing.pack(spark.createDataFrame([(i, 0, 0, 128, 0) for i in range(40)], packing.PIECES), 256).collect()
    assert len({r.sequence_id for r in certified}) == 20 and {r.gap for r in certified} == {0}


def test_packing(spark, texts):
    ship(spark)
    rows = packing.pieces(docs_of(spark, texts), tokens.vocabulary("word_bpe_49k.json"), 256, 0)
    got = packing.pack(rows, 256, task_rows=100).collect()
    assert len(got) == rows.count()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        end = 0
        for offset, length in sorted(b):
            assert offset == end
            end += length
        assert end <= 256
    bound = packing.global_bound(rows, 256)
    assert bound <= len(bins) <= bound * 1.02 + 1
    assert packing.pack(rows.limit(0), 256).count() == 0


def test_bounds():
    counts = np.zeros(11, np.int64)
    counts[6] = 5  # five sixes never share a bin of ten
    assert packing.lower_bound(counts, 10) == 5
    bins, offsets, n = packing.best_fit_decreasing(np.array([7, 6, 4, 3]), 10)
    assert n == 2 and sorted(zip(bins, offsets)) == [(0, 0), (0, 7), (1, 0), (1, 6)]


def water(sizes, weights, total, most):
    """Shares by weight, cut at their limits, the excess shared again."""
    target, full = {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        target = {s: most * sizes[s] if s in full else left * weights[s] / sum(weights[o] for o in open_) for s in sizes}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rng = random.Random(4)
    sources = [rng.choice(["a", "b", "c", None, "big", "big", "big"]) for _ in range(400)]
    texts = [None if i % 50 == 0 else words(rng, rng.randrange(0, 30)) for i in range(400)]
    got = mixing.mix(docs_of(spark, texts, sources=sources)).collect()
    size = defaultdict(int)
    for s, t in zip(sources, texts):
        size[s] += len((t or "").split())
    names = sorted([s for s in size if s is not None]) + ([None] if None in size else [])
    expected = water({s: size[s] for s in names}, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(size.values()), 2)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - expected[r.source]) < 1e-6 and r.source_size == size[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == 400 and all(abs(taken[s] - expected[s]) <= 30 for s in names)
    assert mixing.mix(docs_of(spark, ["a"]).limit(0)).count() == 0
    again = mixing.mixed_rows(docs_of(spark, texts, sources=sources)).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in again} == {r.doc_id: r.copies for r in got if r.copies}


def test_url_filter(spark):
    urls = ["https://A.example.NET/en/1?x", "http://b.net/x", "https://www.example.com/de/1#t", "https://x.org/fr/", "https://spam-farm.example.org/en/7", "https://blog.example.org/en/7", "nothing", None, "ftp://h?q", "https://notnet/x"]
    got = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got[:6]] == [
        ("a.example.net", "/en/1", "example.net/en/", "allow"), ("b.net", "/x", "net/", "block"), ("www.example.com", "/de/1", "example.com/de/", "block"),
        ("x.org", "/fr/", "org/fr/", "allow"), ("spam-farm.example.org", "/en/7", None, "block"), ("blog.example.org", "/en/7", None, "allow"),
    ]
    assert [(r.host, r.path, r.rule) for r in got[6:]] == [("", "", None), ("", "", None), ("h", "", None), ("notnet", "/x", None)]
    assert all(0 <= r.score <= 1 and r.verdict in ("allow", "block") for r in got)


def test_license_scan(spark):
    cases = ["MIT License. mit, license\nApache--License", None, "", "...", "the general public license", "Released under the MIT License; SPDX-License-Identifier: Apache-2.0", "submit license", "all rights reserved", "É license mit license É"]
    got = license_scan.scan(docs_of(spark, cases)).orderBy("doc_id").collect()
    for r, text in zip(got, cases):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None)), text
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert set(got[5].labels.split(",")) == {"mit", "apache"} and got[7].labels == "proprietary"
    assert len(license_scan.RULES) > 200


def test_language_id(spark):
    rng = random.Random(6)
    stems = {"aa": ["shan", "the", "ing"], "bb": ["que", "cion", "los"], "cc": ["über", "schw", "ßen"]}
    langs = [rng.choice(list(stems)) for _ in range(400)]
    texts = [" ".join("".join(rng.choice(stems[g]) for _ in range(2)) for _ in range(30)) for g in langs] + [None, "", "123 !!", "ÉÀ"]
    got = language_id.identify(docs_of(spark, texts, langs=[*langs, "aa", "aa", "aa", "aa"])).orderBy("doc_id").collect()
    assert all(r.lang_pred == g for r, g in zip(got, langs)) and [r.lang_pred for r in got[400:403]] == ["und"] * 3
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.lang_pred for r in language_id.identify(docs_of(spark, texts).limit(0)).collect()} == set()


def test_quality(spark):
    rng = random.Random(7)
    marks = [rng.randrange(2) for _ in range(300)]
    texts = [words(rng, 40, 50) + ("" if y else " BUY!! NOW!! ***") for y in marks] + [None, ""]
    labels = spark.createDataFrame([*enumerate(marks), (300, None)], "doc_id long, quality int")
    got = quality.classify(docs_of(spark, texts), labels).orderBy("doc_id").collect()
    assert sum(r.predicted == y for r, y in zip(got, marks)) >= 295 and len(got) == 302
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert quality.classify(docs_of(spark, texts), labels.limit(0)).count() == 302


def test_nearest(spark):
    rng = np.random.default_rng(8)
    x = [list(map(float, v)) for v in rng.integers(-2, 3, (400, 6))] + [[1.0] * 6] * 60
    rows = [(i, v) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (920, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, np.array(v)) for i, v in enumerate(x) if any(v)]
    expected = set()
    for i, q in good:
        if i % 20 == 0:
            best = sorted((-float(q @ v), j) for j, v in good if j != i)[:20]
            expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    for options in ({}, {"shard": 100, "block": 7}):
        got = nearest.nearest(df, F.col("vec_id") % 20 == 0, 20, 1.0, **options).select("query_id", "rank", "vec_id", "score").collect()
        assert set(map(tuple, got)) == expected
    loose = nearest.nearest(df, F.col("vec_id") % 20 == 0, 20, 1.2).collect()
    assert len(loose) == len(expected)
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.nearest(df.limit(3), F.col("vec_id") % 20 == 0).count() <= 2
