"""The command line over small tables."""

import datetime

from weftline import cli


def test_index(spark, tmp_path, capsys):
    docs, path = f"file://{tmp_path}/docs", f"file://{tmp_path}/index"
    spark.createDataFrame([(1, "沙丘 预言"), (2, "沙丘 4K"), (3, "other")], "doc_id long, text string").write.parquet(docs)
    assert cli.main(["index", "build", path, "--documents", docs]) == 0 and "3 documents" in capsys.readouterr().out
    assert cli.main(["index", "search", path, "--documents", docs, "--text", "沙丘 4k"]) == 0
    shown = capsys.readouterr().out
    assert shown.index("|2 ") < shown.index("|1 ") and "|3 " not in shown
    assert cli.main(["index", "compact", path, "--to", f"{path}2"]) == 0 and cli.main(["index", "stats", f"{path}2"]) == 0
    assert "1 segments" in capsys.readouterr().out


def test_maintain(spark, tmp_path, capsys):
    cache = f"file://{tmp_path}/cache"
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("v2:quark:pan.quark.cn/s/a", None, "alive", at), ("odd", None, "unknown", at)], "cache_key string, pwd string, status string, checked_at timestamp").write.parquet(cache)
    assert cli.main(["maintain", cache, "--state", f"file://{tmp_path}/state"]) == 0
    shown = capsys.readouterr().out
    assert "https://pan.quark.cn/s/a" in shown and "'candidates': 2" in shown
    assert cli.main(["maintain", cache, "--state", f"file://{tmp_path}/state"]) == 0 and "interval" in capsys.readouterr().out
    assert cli.main(["stats", cache]) == 0


def test_verify(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("https://pan.quark.cn/s/a 提取码 ab12\nnothing\n")
    assert cli.main(["verify", f"file://{tmp_path}/a.txt"]) == 1 and "ab12" in capsys.readouterr().out


def test_verify_a_link(spark, tmp_path, capsys):
    """Exit codes: 0 told, 1 no link of a known provider, 2 a provider that can't be asked."""
    cache = f"file://{tmp_path}/cache"
    spark.createDataFrame([("quark:pan.quark.cn/s/qdead", "not_found", datetime.datetime(2024, 1, 1))], "cache_key string, status string, checked_at timestamp").write.parquet(cache)
    assert cli.main(["verify", "https://pan.quark.cn/s/qdead", "--cache", cache]) == 0 and "not_found  quark" in capsys.readouterr().out
    assert cli.main(["verify", "https://pan.quark.cn/s/qalive"]) == 0 and "unchecked" in capsys.readouterr().out
    assert cli.main(["verify", "https://pan.xunlei.com/s/VNxunlei123"]) == 2 and cli.main(["verify", "https://example.com/x"]) == 1


def test_probe_and_health(spark, tmp_path, capsys):
    page = "".join(f'<a href="/page-{k}/">' for k in ("aaa", "bbb", "ccc", "ddd"))
    for name, rows, kind in (
        ("homes", [("x.example", 200, None)], "domain string, http_status int, error string"),
        ("searches", [("x.example", 0, "/?s={q}", 200, page, 200, "")], "domain string, place int, template string, http_status int, html string, noise_status int, noise_html string"),
        ("details", [("https://x.example/page-aaa/", 200, '<a href="https://pan.quark.cn/s/a">')], "url string, http_status int, html string"),
        ("runs", [("x.example", datetime.datetime(2024, 1, k), k, 0, "E") for k in (1, 2)], "domain string, run_at timestamp, event_id long, hits long, error string"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(f"file://{tmp_path}/{name}")
    assert cli.main(["sites", "probe", f"file://{tmp_path}"]) == 0 and "/?s={q}" in capsys.readouterr().out
    assert cli.main(["sites", "health", f"file://{tmp_path}/runs"]) == 0 and "|x.example|2" in capsys.readouterr().out
