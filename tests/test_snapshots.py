"""Kept results: read again, told apart by flags, given up in time, and never seen half-written."""

import json

import pytest
from test_quota import HITS, hits

from weftline import cli
from weftline.operators.snapshots import MANIFEST, Snapshots
from weftline.plans import search


def store(spark, tmp_path, **options):
    return Snapshots(spark, f"file://{tmp_path}/kept", **options)


def test_second_search_reads_the_first(spark, tmp_path):
    kept, calls = store(spark, tmp_path), []

    def make():
        calls.append(1)
        return spark.range(3), {"n": len(calls)}

    assert [kept.ask("q", make, strict=s, types=t) for s, t in ((False, []), (False, []), (True, []), (False, ["a"]))][1][1] is True
    assert len(calls) == 3 and kept.ask("q", make, types=[], strict=False)[0].about == {"n": 1}
    assert kept.name("q", a=1, b=2) == kept.name("q", b=2, a=1) != kept.name("q", a=2, b=1)


def test_time_and_number(spark, tmp_path):
    now = [0.0]
    kept = store(spark, tmp_path, seconds=300, most=2, clock=lambda: now[0])
    for k in range(3):
        now[0] = k
        kept.put(f"n{k}", spark.range(k + 1))
    assert [kept.get(f"n{k}") and kept.get(f"n{k}").rows.count() for k in range(3)] == [None, 2, 3]
    now[0] = 301.0
    assert kept.get("n1") is None and kept.get("n2").rows.count() == 3
    kept.put("n9", spark.range(1))
    assert len(list((tmp_path / "kept").glob("table-*"))) == 2  # what is over is removed
    nothing = lambda: (spark.range(0), {})
    assert kept.ask("x", nothing, degraded=True)[1] is False and kept.ask("x", nothing)[1] is False and kept.ask("x", nothing)[1] is True


def test_writer_that_dies(spark, tmp_path, monkeypatch):
    """The table is there, the manifest isn't replaced: the old one stays in force."""
    kept = store(spark, tmp_path)
    kept.put("q", spark.range(2))

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(kept.files, "swap", dies)
    with pytest.raises(RuntimeError):
        kept.put("q", spark.range(5))
    assert store(spark, tmp_path).get("q").rows.count() == 2
    (tmp_path / "kept" / f"{MANIFEST}.half").write_text('{"entries": {"q"')
    assert store(spark, tmp_path).get("q").rows.count() == 2


def test_kept_search(spark, tmp_path):
    kept = store(spark, tmp_path)
    first, was = search.kept_search(kept, hits(spark), "三体", 3, types=["quark", "baidu"])
    again, now = search.kept_search(kept, hits(spark), "三体", 3, types=["quark", "baidu"])
    assert (was, now) == (False, True) and again == first and len(first["results"]) == 3 and first["raw_hits"] == len(HITS)
    assert search.kept_search(kept, hits(spark), "三体", 3, types=["quark"])[1] is False
    assert search.kept_search(kept, hits(spark), "三体", 3, data="other", types=["quark"])[1] is False


def test_command(spark, tmp_path, capsys):
    where = f"file://{tmp_path}/hits"
    hits(spark).write.parquet(where)
    told = []
    for _ in range(2):
        assert cli.main(["search", "三体", "--hits", where, "--json", "--keep", f"file://{tmp_path}/kept"]) == 0
        told.append(json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    hits(spark).limit(2).write.mode("overwrite").parquet(where)
    assert cli.main(["search", "三体", "--hits", where, "--json", "--keep", f"file://{tmp_path}/kept"]) == 0
    told.append(json.loads(capsys.readouterr().out.strip().splitlines()[-1]))
    assert [t["from_cache"] for t in told] == [False, True, False] and told[0]["results"] == told[1]["results"] and told[2]["raw_hits"] == 2
