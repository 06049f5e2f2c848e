"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON: median seconds by query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Queries that stand for what is done most: retrieval, grouping with scores, liveness, pages, evaluation, streams.
HEADLINE = [
    "bm25_topk", "tiered_recall", "phrase_match", "prefix_match", "like_fallback", "resolve_hits", "rrf_fusion", "score_resources", "resolve_rank",
    "latest_wins_upsert", "stale_queue", "verify_summary", "health_consecutive_fails", "path_shapes_topk", "local_links", "html_text", "ndcg_at_10", "chao2",
    "tumbling_windows", "session_windows", "semi_join", "correlated_count", "mixed_search", "indexed_search", "search_end_to_end", "source_report",
    "bounded_topk", "search_outcome", "site_probe", "response_decisions", "lateral_links", "validity_stretches",
]


def main() -> None:
    from weftline import catalogue
    from weftline.operators.keptindex import Index
    from weftline.plans import queries_index
    from weftline.session import scratch, session, ship

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    seconds: dict[str, float] = {}
    # Queries of the text index use one that is kept, so what it takes to build it is told apart.
    for k in range(2):
        began = time.time()
        Index.build(queries_index.docs(spark, sf), queries_index.tokens(), scratch(spark, "bench"))
        seconds["index_build"] = round(time.time() - began, 3)
    for name in HEADLINE:
        runs = []
        for k in range(3):  # the first warms up
            began = time.time()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total median seconds of headline queries, warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
