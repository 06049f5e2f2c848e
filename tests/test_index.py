"""The kept index against plain searches, through upserts, removals and compaction."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import keptindex
from weftline.operators.keptindex import Index, Unit, unit_of

WORDS = "沙 丘 沙丘 预言 三体 serum serum2 sera 4k hdr dune 2 the 书 好书 书包".split()


def texts(rng, n, start=0):
    return {i: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 25))) for i in range(start, start + n)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows.items()], "doc_id long, text string, term string")


def tokens():
    return T.mixed_tokens(F.col("text"))


def places(found, unit):
    if unit.prefix:
        return sum(t.startswith(unit.tokens[0]) for t in found)
    return sum(tuple(found[k : k + len(unit.tokens)]) == unit.tokens for k in range(len(found)))


def check(index, rows):
    held = {i: T.mixed_token_list(t) for i, t in rows.items()}
    assert {(r.term, r.df, r.cf) for r in index.vocabulary().collect()} == {(t, sum(t in d for d in held.values()), n) for t, n in Counter(t for d in held.values() for t in d).items()}
    assert index.n == sum(bool(d) for d in held.values()) and abs(index.avgdl * index.n - sum(map(len, held.values()))) < 1e-6
    units = [unit_of(w) for w in ("沙丘", "书", "serum", "三体书", "2", "沙丘预言")] + [Unit(("沙丘", "丘沙", "沙丘"))]
    for u in units:
        assert {(r.doc_id, r.tf) for r in index.matches(u).collect()} == {(i, places(d, u)) for i, d in held.items() if places(d, u)}, u
    assert index.df(units) == [sum(places(d, u) > 0 for d in held.values()) for u in units]
    got = {r.doc_id: (r.score, list(r.has)) for r in index.scored(units[:4]).collect()}
    assert set(got) == {i for i, d in held.items() if any(places(d, u) for u in units[:4])} and all(h == [places(held[i], u) > 0 for u in units[:4]] for i, (_, h) in got.items())


def test_units():
    assert unit_of("沙丘预言") == Unit(("沙丘", "丘预", "预言")) and unit_of("书") == Unit(("书",), True) and unit_of("serum") == Unit(("serum",), True) and unit_of("4k") == Unit(("4k",))
    assert keptindex.units_of(["书", "沙丘"]) == [unit_of("沙丘")] and keptindex.units_of(["书"]) == [unit_of("书")] and len(keptindex.units_of([f"w{k}" for k in range(9)])) == 6
    assert keptindex.exact_term("沙丘") and not keptindex.exact_term("书") and not keptindex.exact_term("沙丘2")


def test_tokens_agree(spark):
    rng = random.Random(5)
    some = ["".join(rng.choice("沙丘a1 ,，-x9") for _ in range(rng.randrange(20))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in some], "text string").select("text", tokens().alias("t")).collect()
    assert all(list(r.t) == T.mixed_token_list(r.text) for r in got)


def test_index(spark, tmp_path):
    rng = random.Random(6)
    rows = texts(rng, 120)
    docs = frame(spark, rows).unionByName(spark.createDataFrame([(None, "沙丘", "x"), (500, None, "x")], "doc_id long, text string, term string"))
    index = Index.build(docs, tokens(), f"file://{tmp_path}/a", 3)
    check(index, rows)
    fresh = {**texts(rng, 30, 100), 3: "沙丘 沙丘 沙丘", 4: ""}
    index.upsert(frame(spark, fresh), tokens(), spark.createDataFrame([(7,), (8,), (9999,)], "doc_id long"))
    rows = {i: t for i, t in {**rows, **fresh}.items() if i not in (7, 8)}
    check(index, rows)
    again = {3: "三体", 7: "书包 沙丘", 129: "the"}
    index.upsert(frame(spark, again), tokens())
    rows |= again
    check(index, rows)
    check(index.compact(f"file://{tmp_path}/b", 2), rows)


def test_empty_index(spark, tmp_path):
    index = Index.build(frame(spark, {1: ""}), tokens(), f"file://{tmp_path}/c", 2)
    assert index.n == 0 and index.scored([Unit(("a",))]).count() == 0 and index.vocabulary().count() == 0


@pytest.mark.parametrize(("asked", "subjects", "expected"), [(["沙丘", "4k"], ["沙丘"], [2, 3, 1]), (["serum"], ["serum"], [6]), (["书"], ["书"], [8])])
def test_search(spark, tmp_path, asked, subjects, expected):
    """All terms before all subjects; what only begins like a term is thrown out by its text; a lone character begins a word's pairs."""
    rows = {1: "沙丘 预言 电视剧", 2: "沙丘 4k hdr", 3: "沙 丘 预言 姐妹会", 4: "黑夏 4k hdr", 5: "serumx", 6: "a serum2", 8: "书包"}
    index = Index.build(frame(spark, rows), tokens(), f"file://{tmp_path}/d", 2)
    got = index.search(asked, subjects, frame(spark, rows), 10, rank="recency").collect()
    assert [r.doc_id for r in got] == expected
    plan = index.postings("沙丘")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "沙丘" in plan


def test_units_are_candidates():
    """A lone character beside other tokens isn't asked for; what no unit proves is told."""
    assert unit_of("哆啦a梦") == Unit(("哆啦", "a"), every=True) and unit_of("全dlc") == Unit(("dlc",), every=True) and unit_of("a书b书") == Unit(("a", "b"), every=True)
    assert [unit_of(t).proof for t in ("沙丘", "哆啦a梦", "书", "serum", "4k", "沙丘2")] == [True, False, False, False, False, False]
    assert unit_of("c#") == Unit(("c",)) and unit_of("100%") == Unit(("100",))


def whole(spark, tmp_path, rows, **options):
    """An index that keeps texts: id -> (text, day, whether it has links)."""
    docs = spark.createDataFrame([(i, t, d, has) for i, (t, d, has) in rows.items()], "doc_id long, text string, day int, has boolean")
    return Index.build(docs, tokens(), f"file://{tmp_path}/whole", 2, text=F.col("text"), at=F.timestamp_seconds(F.col("day") * 86_400), linked=F.col("has"))


def ids(found):
    return [r.doc_id for r in found.collect()]


def test_isolated_characters(spark, tmp_path):
    """A character that pairs with what follows: the term is found, and texts that only have its other tokens are not."""
    texts = {1: "哆啦a梦全集", 2: "完全dlc", 3: "哆啦 a 类", 4: "dlc 合集", 5: "哆啦a·梦", 6: "全 dlc", 7: "电子书 合集", 8: "书法 字帖", 9: "好书"}
    index = whole(spark, tmp_path, {i: (t, i, True) for i, t in texts.items()})
    assert {r.doc_id for r in index.matches(unit_of("哆啦a梦")).collect()} == {1, 3, 5}
    assert set(ids(index.search(["哆啦a梦"], ["哆啦a梦"]))) == {1, 5} and set(ids(index.search(["全dlc"], ["全dlc"]))) == {2, 6}
    assert set(ids(index.search(["书"], ["书"]))) == {7, 8}  # at the end of a run a lone character isn't found
    assert set(ids(index.search(["哆啦a梦", "合集"], ["哆啦a梦", "合集"]))) == {1, 5, 4, 7}


def test_time_and_links(spark, tmp_path):
    """Within a tier the newer of equals first; links only if asked; candidates that fail are passed over, however many."""
    rows = {1: ("沙丘", 3, True), 2: ("沙丘", 9, True), 4: ("沙丘 预言", 5, True), 5: ("沙丘", 9, False), 6: ("沙丘", None, True)}
    rows |= {100 + k: ("serumx", 1, True) for k in range(300)} | {500: ("serum 2", 1, True), 501: ("my serum", 1, True)}
    index = whole(spark, tmp_path, rows)
    assert ids(index.search(["沙丘"], ["沙丘"], linked=True)) == [2, 1, 6, 4] and ids(index.search(["沙丘"], ["沙丘"])) == [5, 2, 1, 6, 4]
    assert set(ids(index.search(["serum"], ["serum"], limit=2))) == {500, 501}
    assert ids(index.search(["沙丘"], ["沙丘"], limit=2)) == [5, 2] and index.search(["x"], ["x"]).count() == 0 and index.search(["!"], []).count() == 0


@pytest.mark.parametrize("checked", [1, 60, 100_000])
def test_checked_by_rank(spark, tmp_path, monkeypatch, checked):
    """The same rows, whether all candidates meet their texts, windows of them, or the first window suffices."""
    rng = random.Random(9)
    words = ["沙丘", "三体", "全dlc", "完全dlc", "dlc", "全集", "4k"]
    rows = {k: (" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), rng.randrange(5), True) for k in range(400)}
    index = whole(spark, tmp_path, rows)
    monkeypatch.setattr(keptindex, "CHECKED", 10**6)
    every = [tuple(r) for r in index.search(["沙丘", "全dlc", "4k"], ["沙丘", "全dlc"], limit=1000).collect()]
    has = lambda i, t: t in rows[i][0].replace(" ", "")
    assert {(i, t) for i, t, *_ in every} == {(i, 3 if not (has(i, "沙丘") and has(i, "全dlc")) else 1 if "4k" in rows[i][0].split() else 2) for i in rows if has(i, "沙丘") or has(i, "全dlc")}
    monkeypatch.setattr(keptindex, "CHECKED", checked)
    for limit in (5, 40, 150):
        assert [tuple(r) for r in index.search(["沙丘", "全dlc", "4k"], ["沙丘", "全dlc"], limit=limit).collect()] == every[:limit]


def scanned(df):
    """Rows that a plan's scans have read."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_small_upserts(spark, tmp_path, monkeypatch):
    """What an upsert looks up of the index is a few pages; segments of a size are merged; an old reader goes on; a writer that
    died leaves nothing."""
    monkeypatch.setattr(keptindex, "SHELF_ROWS", 4_000)
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), (F.col("id") % 10).cast("string")).alias("text"))
    index = Index.build(docs, tokens(), f"file://{tmp_path}/e", 2)
    with keptindex._by_name(spark):
        few = index._named([5, 17, 39_999]).select("doc_id")
        assert sorted(ids(few)) == [5, 17, 39_999] and scanned(few) <= 3 * 600
    old = Index(spark, index.path)
    for k in range(9):
        index.upsert(frame(spark, {k: "new", 1_000_000 + k: "new w"}), tokens())
    assert index.segments <= 1 + 2 * keptindex.FAN and index.n == 40_009 and index.df([Unit(("new",)), Unit(("w",))]) == [18, 40_000 - 9 + 9]
    assert old.df([Unit(("new",)), Unit(("w",))]) == [0, 40_000] and Index(spark, index.path).n == 40_009
    seg = index.version + 1
    index._write(frame(spark, {7: "dead writer"}), tokens(), seg, 1, None, None, None)
    again = Index(spark, index.path)
    assert again.n == 40_009 and again.df([Unit(("dead",))]) == [0]
    again.upsert(frame(spark, {8: "after"}), tokens(), spark.createDataFrame([(0,)], "doc_id long"))
    assert again.n == 40_008 and again.df([Unit(("dead",)), Unit(("after",)), Unit(("new",))]) == [0, 1, 16]


def test_texts_are_asked_for(spark, tmp_path):
    index = Index.build(frame(spark, {1: "serum"}), tokens(), f"file://{tmp_path}/f", 1)
    with pytest.raises(ValueError):
        index.search(["serum"], ["serum"])


@pytest.mark.parametrize("size", [7, 65_536])
def test_top_by_bounds(spark, tmp_path, monkeypatch, size):
    """The best by bounds are the best of all, through upserts; and few blocks are read where few can hold them."""
    monkeypatch.setattr(keptindex, "BLOCK", size)
    monkeypatch.setattr(keptindex, "FIRST_BLOCKS", 2)
    rng = random.Random(size)
    rows = {k: (" ".join(rng.choice(["common", "common", "rare", "x", "y", "z"]) for _ in range(rng.randrange(1, 12))), rng.randrange(300), True) for k in range(300)}
    index = whole(spark, tmp_path, rows)
    index.upsert(frame(spark, {k: "common common rare" for k in (5, 50)}), tokens(), spark.createDataFrame([(7,)], "doc_id long"))
    for terms in (["common"], ["rare", "common", "x"]):
        every = index.scored([Unit((t,)) for t in terms]).select("doc_id", F.round("score", 9).alias("s"), "at").collect()
        for limit in (3, 1000):
            want = sorted(every, key=lambda r: (-r.s, r.at is None, -(r.at.timestamp() if r.at else 0), -r.doc_id))[:limit]
            assert ids(index.top(terms, limit)) == [r.doc_id for r in want]
            want = sorted(every, key=lambda r: (r.at is None, -(r.at.timestamp() if r.at else 0), -r.doc_id))[:limit]
            assert ids(index.top(terms, limit, newest=True)) == [r.doc_id for r in want]
    assert ids(index.top(["nothing"], 3)) == []


def test_blocks_that_are_not_read(spark, tmp_path, monkeypatch):
    """Where time or impact follows the ids, most blocks can't hold one of the best."""
    monkeypatch.setattr(keptindex, "BLOCK", 10)
    monkeypatch.setattr(keptindex, "FIRST_BLOCKS", 2)
    rows = {k: ("rare rare rare" if k < 15 else "rare a b c d e f g h i", k, True) for k in range(200)}
    index = whole(spark, tmp_path, rows)
    assert ids(index.top(["rare"], 3, newest=True)) == [199, 198, 197] and index.blocks_read[0] <= 3 < index.blocks_read[1]
    assert ids(index.top(["rare"], 3)) == [14, 13, 12] and index.blocks_read[0] <= 3 < index.blocks_read[1]


def test_many_ids_by_name(spark, tmp_path, monkeypatch):
    """Thousands of candidates are looked up by name: the filter that is pushed down must not be as deep as their number."""
    rows = {k: f"三体 x{k}" for k in range(4000)}
    index = Index.build(frame(spark, rows), tokens(), f"file://{tmp_path}/many", files=2, text=F.col("text"))
    monkeypatch.setattr(keptindex, "LOOKED_UP", 5000)
    with keptindex._by_name(spark):
        found = index.looked_up(spark.range(0, 4000, 1).withColumnRenamed("id", "doc_id"), "text").collect()
    assert {r.doc_id: r.text for r in found} == rows


def test_build_without_groups(spark, tmp_path):
    """A document's places are made in its row: the plan of the postings shuffles nothing, and no sort gives way to a spill."""
    rows = {k: "三体 the x the " + "y " * k for k in range(40)}
    index = Index.build(frame(spark, rows), tokens(), f"file://{tmp_path}/rows", files=2)
    made = index.forward.select("doc_id", "dl", "at", "linked", "tokens").mapInArrow(keptindex._posted, "term string, doc_id long, tf int, dl int, at timestamp, linked boolean, positions array<int>")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.term, r.doc_id): list(r.positions) for r in made.collect()} == {(t, k): [i for i, x in enumerate(f) if x == t] for k, f in ((k, T.mixed_token_list(t)) for k, t in rows.items()) for t in f}


def shuffled(spark, work):
    """Rows that stages write to shuffles while work runs."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    work()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for stage, n in stages().items() if stage not in before)


def test_postings_are_not_shuffled(spark, tmp_path):
    """Of a build, documents and terms are shuffled, not postings; each document's lie in one file, whose blocks say which."""
    rng = random.Random(11)
    rows = {k: " ".join(rng.sample([f"w{i}" for i in range(150)], 100)) for k in range(600)}
    docs, built = frame(spark, rows), []
    assert shuffled(spark, lambda: built.append(Index.build(docs, tokens(), f"file://{tmp_path}/local", 3))) < 600 * 100 / 4
    index = built[0]
    files = index.all_postings.select("doc_id", F.col("_metadata.file_name").alias("file"))
    assert files.select("file").distinct().count() == 3 and files.distinct().count() == 600
    parts = {p: g for p, g in ((r.part, r.ids) for r in index.all_postings.withColumn("part", keptindex._part()).groupBy("part").agg(F.collect_set("doc_id").alias("ids")).collect())}
    for b in index.all_blocks.filter("term < 'w2'").collect():
        own = [i for i in sorted(parts[b.part]) if b.term in rows[i].split()]
        assert (b.lo, b.hi, b.n, b.cf, b.tf, b.dl) == (own[0], own[-1], len(own), len(own), 1, 100)
    some = index.all_postings.filter("term = 'w7'").withColumn("part", keptindex._part()).filter(keptindex._among([(0, 1, 0, 300), (0, 1, 200, 400)]))
    assert sorted(ids(some.select("doc_id"))) == [i for i in sorted(parts[1]) if i <= 400 and "w7" in rows[i].split()]


def test_blocks_of_older_indexes(spark):
    """Without the number of a file, as older indexes have it, ranges alone choose; ranges that meet are one."""
    rows = spark.createDataFrame([(0, k % 2, k) for k in range(20)] + [(1, 0, 3)], "seg int, part int, doc_id long")
    pick = lambda *blocks: sorted((r.seg, r.doc_id) for r in rows.filter(keptindex._among(blocks)).collect())
    assert pick((0, None, 2, 5), (0, None, 4, 7)) == [(0, k) for k in range(2, 8)]
    assert pick((0, 1, 2, 5), (0, 0, 8, 9), (1, 0, 0, 9)) == [(0, 3), (0, 5), (0, 8), (1, 3)]


def test_shelves_by_bytes(spark, tmp_path, monkeypatch):
    """A shelf is bounded by its bytes, and what is written of it is sorted once, before texts become tokens."""
    rows = texts(random.Random(11), 200) | {900: "", 901: "?!"}
    monkeypatch.setattr(keptindex, "SHELF_BYTES", 2_000)
    ordered = []
    shelve = Index._shelve

    def spied(self, docs, seg, shelves, made=lambda rows: rows):
        plan = made(docs.withColumn("shelf", F.lit(0)).sortWithinPartitions("shelf", "doc_id"))
        plan.write.mode("overwrite").partitionBy("shelf").parquet(str(tmp_path / "spied"))
        ordered.append("Generate" in plan._jdf.queryExecution().optimizedPlan().toString())
        shelve(self, docs, seg, shelves, made)

    monkeypatch.setattr(Index, "_shelve", spied)
    index = Index.build(frame(spark, rows), tokens(), str(tmp_path / "index"), files=1)
    assert ordered == [False] and index.sizes[0].shelves == -(-sum(len(t.encode()) + 1 for t in rows.values()) // 2_000) > 1
    check(index, rows)
    assert {r.doc_id for r in index.forward.select("doc_id").collect()} == {i for i, t in rows.items() if T.mixed_token_list(t)}
    monkeypatch.setattr(keptindex, "FILE_TOKENS", 200)
    whole = index.compact(str(tmp_path / "compact"))
    assert whole.sizes[0].shelves > 1
    check(whole, rows)
