"""Command line: python -m weftline.cli search|verify|query|index|sites|channels|stats|maintain ... over captured tables."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="rank the hits of a table for a query")
    s.add_argument("text")
    s.add_argument("--hits", required=True)
    s.add_argument("--cache")
    s.add_argument("--type", action="append", default=[])
    s.add_argument("--strict", action="store_true")
    s.add_argument("-n", type=int, default=20)
    s.add_argument("--csv")
    s.add_argument("--keep", help="a folder in which results are kept for --seconds")
    s.add_argument("--seconds", type=float, default=300)
    s.add_argument("--json", action="store_true", help="the results with what became of all others")
    v = sub.add_parser("verify", help="links and codes of a text file, and the lines without any")
    v.add_argument("file", help="or a link: exit code 1 for none of a known provider, 2 for one that can't be checked")
    v.add_argument("--cache", help="known states, for a link")
    q = sub.add_parser("query", help="run a registered query")
    q.add_argument("name")
    q.add_argument("folder")
    i = sub.add_parser("index", help="the kept text index")
    i.add_argument("action", choices=["build", "search", "stats", "compact"])
    i.add_argument("path")
    i.add_argument("--documents", help="a table with doc_id and text")
    i.add_argument("--text", default="")
    i.add_argument("--to", help="the folder of the compacted index")
    i.add_argument("-n", type=int, default=20)
    t = sub.add_parser("sites", help="sites of a table: listed, routed, their search forms, health, or a probe of captured pages (folders homes, searches, details)")
    t.add_argument("action", choices=["list", "route", "forms", "health", "probe"])
    t.add_argument("table")
    t.add_argument("--text", default="")
    c = sub.add_parser("channels", help="statistics of messages by channel, or new channels by vertical")
    c.add_argument("action", choices=["stats", "new"])
    c.add_argument("table")
    c.add_argument("--known")
    a = sub.add_parser("stats", help="what a cache of states holds")
    a.add_argument("cache")
    m = sub.add_parser("maintain", help="the queue of links to be checked again, unless a run was a short time ago")
    m.add_argument("cache")
    m.add_argument("--state", required=True, help="a folder for the state and the lock")
    m.add_argument("--force", action="store_true")
    m.add_argument("-n", type=int, default=150)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)

    from . import catalogue
    from .functions import html, links
    from .functions import text as T
    from .operators import catalog, collect, keptindex, liveness, maintain, probing, snapshots
    from .plans import query, search
    from .session import session, ship, state
    from .sources import sinks

    spark = session()
    ship(spark)
    read = spark.read.parquet
    if a.command == "search":
        asked = {"cache": read(a.cache) if a.cache else None, "types": a.type, "strict": a.strict}
        if a.json:
            if a.keep:
                data = [(p, state(spark, p)) for p in (a.hits, a.cache) if p]
                told, was = search.kept_search(snapshots.Snapshots(spark, a.keep, a.seconds), read(a.hits), a.text, a.n, data, **asked)
                told["from_cache"] = was
            else:
                told = search.outcome(read(a.hits), a.text, a.n, **asked).as_dict()
            print(json.dumps(told, ensure_ascii=False, default=str))
            return 0
        found = search.search(read(a.hits), a.text, limit=a.n, **asked)
        if a.csv:
            sinks.write_csv(sinks.export_rows(found), a.csv)
        found.show(a.n, False)
    elif a.command == "verify" and a.file.startswith(("http://", "https://", "magnet:")):
        kind, found = links.provider_of(a.file), links.find_or_single(a.file)
        if not found:
            print("no link of a known provider")
            return 1
        if not collect.checkable(kind):
            print(f"{kind}: can't be checked")
            return 2
        known = read(a.cache).filter(F.col("cache_key").endswith(found[0]["url"].split("://", 1)[-1].split("?")[0])) if a.cache else None
        row = None if known is None else liveness.latest(known, ["cache_key"], "checked_at").first()
        print(f"{row['status'] if row else 'unchecked'}  {kind}  {found[0]['url']}")
    elif a.command == "verify":
        lines = spark.read.text(a.file).select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
        hits, rejects = search.batch_text(lines)
        hits.show(1000, False)
        rejects.show(1000, False)
        return 0 if rejects.isEmpty() else 1
    elif a.command == "query":
        catalogue.QUERIES[a.name](spark, a.folder).show(100, False)
    elif a.command == "index":
        folded = lambda: read(a.documents).select("doc_id", T.folded(F.col("text")).alias("text"))
        if a.action == "build":
            index = keptindex.Index.build(folded(), T.mixed_tokens(F.col("text")), a.path, text=F.col("text"))
        else:
            index = keptindex.Index(spark, a.path)
        if a.action == "search":
            asked = query.analyse(a.text)
            index.search(asked.terms, asked.required, limit=a.n).show(a.n, False)
        elif a.action == "compact":
            index.compact(a.to)
        else:
            print(f"{index.n} documents, {index.avgdl:.1f} tokens each, {index.segments} segments, {index.vocabulary().count()} terms")
    elif a.command == "sites":
        rows = read(a.table) if a.action != "probe" else probing.probe(*(read(f"{a.table}/{t}") for t in ("homes", "searches", "details")))
        if a.action == "health":
            rows = liveness.failures(rows).groupBy("domain").agg(F.max_by("fails", F.struct("run_at", "event_id")).alias("fails"), F.max("run_at").alias("last_run"))
        if a.action == "route":
            rows = catalog.route(rows, query.verticals(a.text), 12)
        elif a.action == "forms":
            rows = rows.select("url", html.search_forms("html", F.regexp_extract("url", "^(https?://[^/?#]+)", 1)).alias("templates"))
        rows.show(100, False)
    elif a.command == "channels":
        rows = read(a.table)
        (catalog.channel_stats(rows) if a.action == "stats" else maintain.new_channels(rows, read(a.known))).show(1000, False)
    elif a.command == "stats":
        cache = liveness.latest(read(a.cache), ["cache_key", "pwd"], "checked_at")
        cache.groupBy("status").agg(F.count(F.lit(1)).alias("n")).show()
        maintain.pending(cache, F.current_timestamp(), 6).show()
    else:

        def work() -> dict:
            cache = liveness.latest(read(a.cache), ["cache_key", "pwd"], "checked_at")
            due = maintain.recheck_queue(cache, F.current_timestamp(), 6, 720, a.n)
            due.show(a.n, False)
            return maintain.counters(cache).first().asDict()

        print(maintain.run(maintain.Files(spark, a.state), work, a.force))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
