"""All queries of the core library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from skydrift.plans import data_problems, spectral, streams, tracks, truth

MODULES = [data_problems, spectral, tracks, truth, streams]
FLAGSHIP = "drift_hits"


def queries() -> dict[str, Callable]:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
