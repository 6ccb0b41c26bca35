"""Registered queries of the core and the SQL of those that have one."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("sheafline.operators.nested_records", "sheafline.plans.stream_queries", "sheafline.plans.document_queries")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(_name)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
