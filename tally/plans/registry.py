"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL or None)."""
from __future__ import annotations

from typing import Callable

from tally.plans.oracle_prelude import q

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None, prelude: bool = True) -> Callable:
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = q(sql) if prelude else sql
        return fn

    return deco
