"""All queries of the engine's own operators, with the SQL that DuckDB checks them by."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "dedup_text_hash"
MODULES = ("dedup", "relational", "tables", "docs", "analysis", "structure", "reading")
QUERIES, SQL = {}, {}
for _m in MODULES:
    _q = import_module(f"tessera.plans.{_m}")
    QUERIES |= _q.QUERIES
    SQL |= _q.SQL
