"""Queries of the operators for training data, with their SQL."""

from __future__ import annotations

import importlib

QUERIES, SQL = {}, {}
for _name in ("row_plans", "text_plans"):
    try:
        _m = importlib.import_module(f"sieveline.llm.{_name}")
    except ModuleNotFoundError as e:
        if e.name != f"sieveline.llm.{_name}":
            raise
        continue
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
