"""Checked queries: importing this package registers every query module."""

from __future__ import annotations

import importlib

from .registry import REGISTRY

_MODULES = ["q_market", "q_company", "q_grid", "q_perf", "q_portfolio", "q_sources"]
for _m in _MODULES:
    importlib.import_module(f"{__name__}.{_m}")


def queries():
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql is not None}
