"""Query registry.

Each entry maps a SURVEY §2 id to ``fn(spark, sf_dir) -> DataFrame`` and, where the result is
SQL-expressible, to oracle SQL for DuckDB (base tables pre-registered as views; the derived
views are inlined as CTEs by ``with_views``).  Parameters are fixed per query and never tuned
to make a comparison pass.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

_MODULES = ("q_search", "q_normalize", "q_pii", "q_vectors", "q_multiline", "q_clusters",
            "q_triage", "q_misc", "q_streaming")


def register(qid: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if qid in REGISTRY:
            raise KeyError(f"duplicate query id {qid}")
        REGISTRY[qid] = (fn, with_views(oracle, *views) if oracle else None)
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(f"{__package__}.{m}")
        except ModuleNotFoundError as e:  # modules are added as the build progresses
            if e.name != f"{__package__}.{m}":
                raise


def queries() -> dict[str, QueryFn]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}
