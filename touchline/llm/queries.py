"""Queries of the llm operators, and the SQL each is checked against where SQL can say it."""

from __future__ import annotations

import importlib
import importlib.util

_PARTS = ["records", "names_queries", "linkage_queries", "text_queries", "sentence_queries"]

QUERIES: dict = {}
SQL: dict = {}
for _p in _PARTS:
    if importlib.util.find_spec(f"touchline.llm.{_p}"):
        _m = importlib.import_module(f"touchline.llm.{_p}")
        QUERIES |= _m.QUERIES
        SQL |= _m.SQL
