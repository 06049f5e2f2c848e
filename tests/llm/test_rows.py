"""Near copies among repeated and null ids."""

import hashlib
import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(60)) for _ in range(6)]
    near = [b + " end" for b in base]
    # A repeated id with one near copy; near copies of one id; null ids; a lone null; no words.
    rows = [(1, base[0]), (2, near[0]), (2, base[1]), (3, base[2]), (3, near[2]), (None, base[3]), (None, near[3]), (None, base[4]), (7, near[4]), (None, base[5]), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    group = list(range(len(rows)))
    sets = [shingles(t) for _, t in rows]
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0, hashlib.sha256((rows[k][1] or "").encode()).hexdigest())
    expected = [rows[min((k for k in range(len(rows)) if group[k] == g), key=order)] for g in set(group)]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len(got) == 8
