"""Registered queries: one Spark plan per SURVEY §2 row id, with its DuckDB oracle SQL."""

from .registry import REGISTRY, oracle_sql, queries  # noqa: F401
