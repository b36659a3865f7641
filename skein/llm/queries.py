"""Queries of the operators on text and code corpora, with SQL where SQL can express them."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = ("source_queries", "counting_queries", "packing_queries", "leak_queries", "subject_queries")


def _modules():
    for name in MODULES:
        full = f"skein.llm.{name}"
        if importlib.util.find_spec(full):
            yield importlib.import_module(full)


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.queries().items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.oracle_sql().items()}
