"""All queries outside the llm subpackage, with their SQL where SQL can express them."""

import importlib
import importlib.util

MODULES = ("processing", "hierarchy", "graph", "scalars", "lookups", "joins", "analysis", "extraction", "streams", "more", "receivers", "indexing")


def _modules():
    for name in MODULES:
        full = f"skein.queries.{name}"
        if importlib.util.find_spec(full):
            yield importlib.import_module(full)


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.queries().items()}


def all_oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.oracle_sql().items()}
