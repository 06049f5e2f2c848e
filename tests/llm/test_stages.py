"""Each stage of the pipeline against a plain version, on a table with nulls, repeated rows and ids, ties and columns of clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from weftline.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, kept string, row string, gone_id string, class string, h1 string"
ODD = ("x",) * 7
A = "the city library keeps the history of the river and of the people who live by the river in the old town "
B = "la bibliothèque de la ville garde l'histoire de la rivière et des gens qui vivent près de la rivière "


def fixture():
    rng = random.Random(9)
    rows = []
    for i in range(80):
        base = (A if i % 2 else B).split()
        text = " ".join(rng.choice(base) for _ in range(40))
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}"))
    rows += [(5, rows[4][1], "fr", "s0"), (5, rows[4][1], "fr", "s0"), (None, rows[7][1], None, None), (None, "the river and the town of the people", None, "s1")]
    rows += [(90, None, "en", "s1"), (91, "", "en", None), (92, "123 !!", "en", "s2"), (93, "12 ü", "fr", "s2")]
    rows += [(94 + k, rows[10][1] + f" again{k}", "fr", "s0") for k in range(6)] + [(10, "another text of the library with an id that repeats", "en", "s2")]
    rows += [(200, " ".join(rng.choice(A.split()) + str(rng.randrange(50)) for _ in range(20_000)), "en", "s1")]
    return [(*r, len(r[1] or ""), *ODD) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA)


def plain(rows):
    return Counter((r[0], r[1]) for r in rows)


def has_letter(t):
    return any(c.isalpha() for c in t or "")


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def after_copies(rows):
    keep = {}
    for i, t in {(r[0], r[1] or "") for r in rows}:
        old = keep.get(t, "none")
        keep[t] = i if old in ("none", None) or i is not None and i > old else old
    return Counter((i, t) for t, i in keep.items())


def test_language_stage(spark, docs):
    out = P.identify_language(spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and plain(got) == plain([r for r in fixture() if has_letter(r[1])])
    given = {(r[0], r[1]): r[2] for r in fixture()}
    assert all(r.lang == given[r.doc_id, r.text] or given[r.doc_id, r.text] is None and r.lang in ("en", "fr") for r in got) and all(tuple(r)[5:] == ODD for r in got)


def test_copies_stage(spark, docs):
    out = P.drop_copies(spark, docs, "")
    got = out.collect()
    assert out.columns == docs.columns and Counter((r.doc_id, r.text or "") for r in got) == after_copies(fixture()) and all(tuple(r)[5:] == ODD for r in got)


def test_near_stage(spark, docs):
    rows = [r for r in fixture() if r[1]]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (re.findall(r"[^\x20\x09-\x0D]+", r[1].lower()) for r in rows)]
    group = list(range(len(rows)))

    def find(x):
        return x if group[x] == x else find(group[x])

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    best = defaultdict(list)
    for k, r in enumerate(rows):
        best[find(k)].append(((r[0] is None, r[0] or 0, sha(r[1])), (r[0], r[1])))
    expected = Counter(min(g)[1] for g in best.values()) + Counter({(r[0], r[1]): 1 for r in fixture() if not r[1]})
    out = P.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns and plain(out.collect()) == expected


def test_mixing_stage(spark, docs):
    out = P.mix_sources(spark, docs, "")
    got, times = plain(out.collect()), plain(fixture())
    assert out.columns == docs.columns and all(n <= 2 * times[k] for k, n in got.items())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(r[1]) for r in fixture())
    big = max(words(r[1]) for r in fixture())
    assert abs(sum(words(t) * n for (_, t), n in got.items()) - 1.5 * total) <= 4 * big
    assert plain(P.mix_sources(spark, docs, "").collect()) == got  # again the same


def test_packing_stage(spark, docs):
    plain_ids = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = Counter()
    for r in fixture():
        n = len(plain_ids.encode(r[1] or "", add_special_tokens=False).ids) + 1
        expected.update((r[0], k, a, min(2048, n - a)) for k, a in enumerate(range(0, n, 2048)))
    got = P.pack_sequences(spark, docs, "").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == expected
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 2048 and sorted(b)[0][0] == 0 for b in bins.values())


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_empty_tables(spark, docs, name):
    stage = dict(P.STAGES)[name]
    assert stage(spark, docs.limit(0), "").count() == 0
    nulls = spark.createDataFrame([(None,) * 12] * 3, SCHEMA)
    n = stage(spark, nulls, "").count()
    assert n == {"language_id": 0, "exact_dedup": 1, "ngram_jaccard_join": 1, "mixing": n, "best_fit_packing": 3}[name]
