"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that hold QUERIES and ORACLES.
MODULES = ("quality", "minhash", "packing", "substring", "pii", "warc", "vafile", "language", "toxicity", "sampling")


def _all(attr: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), attr).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
