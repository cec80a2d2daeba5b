"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from tessera.llm import compression, decontaminate, jaccard_join, line_dedup, mixing, repeats, sharding, token_counts, toxicity, url_filter

MODULES = (sharding, compression, mixing, repeats, toxicity, token_counts, line_dedup, url_filter, decontaminate, jaccard_join)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
