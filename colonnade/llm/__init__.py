"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module

MODULES = ("contamination", "topk", "simhash", "toxicity", "linechunks", "suffixes", "urltree", "tokenrollup", "quality", "mixing")


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in getattr(import_module(f"{__name__}.{m}"), "SQL", {}).items()}
