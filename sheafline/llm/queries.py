"""All queries of the subpackage, and the SQL of those that have one."""

from __future__ import annotations

import importlib

MODULES = ("corpus_encoding", "eval_leakage", "repeated_lines", "related_splits", "split_overlap", "similar_vectors", "truncated_texts", "scan_repair")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
