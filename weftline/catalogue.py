"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and the DuckDB SQL of those that it can express."""

from __future__ import annotations

from .plans import queries_core, queries_index, queries_more, queries_ops, queries_sites, queries_web

MODULES = (queries_core, queries_web, queries_index, queries_more, queries_ops, queries_sites)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
FLAGSHIP = "resolve_rank"
