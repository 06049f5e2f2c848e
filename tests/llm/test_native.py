"""URL rules and license scans against plain versions of what they compute; held-out figures of the models."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import language_id, license_scan, quality, signatures, url_filter
from weftline.llm.shared import ship


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path, rules):
    fits = [(len(r), -k, r, v) for k, (r, v) in enumerate(rules) for own, _, under in [r.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + under)]
    return max(fits)[2:] if fits else (None, None)


def test_url_rules(spark):
    rng = random.Random(11)
    hosts = ["net", "A.net", "example.net", "m.Example.NET", "example.com", "xexample.com", "org", "b.org", "É.org", "", "a:80", "net.org"]
    paths = ["", "/", "/en/", "/en", "/en/1", "/de/x", "/fr/", "/fr", "//en/", "/EN/", "/" + "y" * 3000]
    urls = [None, "", "no", "://", "a://b://c.net/", "http:/x.net/"]
    urls += [rng.choice(["http://", "x://", "HTTPS://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?a://b", "#/en/", "?x#y"]) for _ in range(500)]
    rows = spark.createDataFrame([(i, u, "?", "?", "?") for i, u in enumerate([*urls, *urls[:20]])], "page_id long, url string, host string, rule string, score string")
    for rules in (url_filter.RULES, (("net/", "block"), ("net/en", "allow"), ("org/e", "block"), ("net/e/", "allow"), ("org/d", "allow"))):
        for r in url_filter.url_filter(rows, rules).collect():
            host, path = parts_of([*urls, *urls[:20]][r.page_id])
            rule, verdict = rule_of(host, path, rules)
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))
    assert url_filter.url_filter(rows.limit(0)).count() == 0


def test_url_model_held_out(spark):
    good, bad = url_filter.labelled_urls()
    out = lambda k: k % 5 == 3
    w = url_filter.train(spark, [u for k, u in enumerate(good) if not out(k)], [u for k, u in enumerate(bad) if not out(k)])
    asked = [(u, y) for y, us in ((0, good), (1, bad)) for k, u in enumerate(us) if out(k)]
    got = {r.page_id: r.score for r in url_filter.url_filter(spark.createDataFrame([(k, u) for k, (u, _) in enumerate(asked)], "page_id long, url string"), (), w).collect()}
    right = [(got[k] > 0.5) == bool(y) for k, (_, y) in enumerate(asked)]
    assert np.mean(right) >= 0.93 and len(right) > 200


RULES = [(2, "b", "licen", "a licen[sc]e"), (1, "a", "licen", "the licence"), (2, "c", "licen", "(?:a|the) licen[sc]e(?: x)?"), (3, "d", "permit", "permit"), (3, "e", "permit", "permit y permit"), (9, "unknown", "licen", "licen[sc]e")]


def scanned(text):
    """Detections that stay, by taking them one after another."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line, found = f" {' '.join(words)} ", []
    for p, label, keyword, regex in RULES:
        for m in re.finditer(f"(?<= )(?:{regex})(?= )", line) if keyword in line else ():
            start = line[: m.start()].count(" ") - 1
            found.append((p, -(m[0].count(" ") + 1), start, start + m[0].count(" ") + 1, label))
    taken = []
    for d in sorted(found):
        if not any(t[2] <= d[2] and t[3] >= d[3] for t in taken):
            taken.append(d)
    return taken


def test_containment(spark):
    rng = random.Random(12)
    vocabulary = ["a", "the", "licence", "license", "x", "y", "permit", "É"]
    texts = [None, "", "licence", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40))) for _ in range(300))]
    texts += texts[3:8]
    rows = spark.createDataFrame([(i % 300, t, "?", "?") for i, t in enumerate(texts)], "doc_id long, text string, row string, hits string")
    got = license_scan.scan(rows.withColumn("at", F.lit(1)), rules=RULES, stems=("licen", "permit")).collect()
    assert sorted((r.doc_id, [tuple(d) for d in r.detections or []]) for r in got) == sorted((i % 300, scanned(t)) for i, t in enumerate(texts))
    assert license_scan.scan(rows.limit(0)).count() == 0


def test_signatures():
    rules = signatures.build_rules()
    assert len(rules) >= 280 and len({r[3] for r in rules}) >= 250
    for p, label, keyword, regex in rules:
        assert 1 <= p <= 9 and label and any(s in keyword for s in signatures.STEMS) and keyword in re.sub(r"\(\?[=!][^)]*\)", "", regex), regex
        re.compile(regex)


def test_long_scan(spark):
    """A text of a million words, a quarter of them detections."""
    text = "under the mit license foo " * 200_000
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (r,) = license_scan.scan(rows).drop("detections").collect()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (1_000_000, 200_000, 2, 999_997, "mit") and time.time() - began < 120


def test_language_popcounts(spark):
    """Corrected popcounts against sets of n-grams looked up one by one."""
    rng = random.Random(13)
    words = [["the", "ing", "sh"], ["que", "los", "ñan"]]
    grams = [np.unique(language_id._grams(*raw(" ".join(rng.choice(w) + rng.choice(w) for _ in range(200))))[0]) for w in words]
    model = language_id.Model(["aa", "bb"], [g.astype(np.int64) for g in grams])
    texts = ["thesh inging", "quelos", "", "thelos ñan", "x" * 2000]
    for t in texts:
        got = model.shares(*raw(t))[0][0]
        wide = np.frombuffer((" " + re.sub("[^a-zñ]", " ", t) + " ").encode(), np.uint8).astype(int)
        own = [int(wide[i]) | int(wide[i + 1]) << 8 | int(wide[i + 2]) << 16 | int(wide[i + 3]) << 24 for i in range(len(wide) - 3)]
        bits = [set(map(int, s)) for k in range(2) for s in model.slots(grams[k].astype(np.uint32))]
        for k in range(2):
            both = bits[2 * k] | bits[2 * k + 1]
            inside = sum(all(int(s[0]) in both for s in model.slots(np.array([g], np.uint32))) for g in own)
            share = (inside / max(1, len(own)) - model.false[k]) / (1 - model.false[k])
            assert abs(got[k] - min(1, max(0, share))) < 1e-12


def raw(text):
    b = np.frombuffer(text.encode(), np.uint8)
    return b, np.array([0, len(b)])


def test_quality_fit(spark):
    """Dual coordinate descent against plain subgradient steps on the same objective; repeated ids and empty tables."""
    rng = np.random.default_rng(14)
    rows, y = [], []
    for k in range(60):
        y.append(k % 2)
        rows.append(np.unique(rng.integers(0, 40, 12) + (20 if k % 2 else 0)))
    y = np.array(y)
    model = quality.fit(rows, y, rounds=400)
    ratio = np.zeros(1 << quality.BUCKET_BITS)
    counts = np.full((2, len(ratio)), 1.0)
    for r, c in zip(rows, y):
        counts[c, r] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((60, 61))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / np.sqrt(len(r))
    x[:, 60] = 1
    sign = np.where(y == 1, 1.0, -1.0)

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()

    w = np.zeros(61)
    best = np.inf
    for step in range(1, 20_001):
        slope = w - ((sign * (x @ w) < 1) * sign) @ x
        w = w - slope / step
        best = min(best, loss(w))
    own = np.append(np.divide(model.weights[:60], ratio[:60], out=np.zeros(60), where=ratio[:60] != 0), model.bias)
    assert loss(own) <= best * 1.01 + 1e-6
    ship(spark)
    docs = spark.createDataFrame([(k // 3, f"text number {k % 5} " * (1 + 40 * (k % 2)), "?", "?") for k in range(30)] + [(None, None, "?", "?"), (99, "", "?", "?")], "doc_id long, text string, score string, y string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 32 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == 32
