"""Every query over the driver tables with its SQL twin."""

from __future__ import annotations

from lexitide.plans import activity, language, storage

MODULES = (activity, language, storage)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
