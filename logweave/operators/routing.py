"""Routing and batch bookkeeping: R1 priority filter, R3 sub-batching, R5 outcome counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import PRIORITY_LEVELS
from .numbering import number_rows


def priority(df: DataFrame, levels: list[str] | None = None, enabled: bool = True,
             level_col: str = "level") -> DataFrame:
    """Rows whose upper-cased level is in the priority list (none when disabled)."""
    if not enabled:
        return df.limit(0)
    levels = [x.upper() for x in (levels or PRIORITY_LEVELS)]
    return df.filter(F.upper(F.col(level_col)).isin(levels))


def sub_batches(df: DataFrame, size: int = 50, order_cols=("ts", "log_id"),
                partition_col: str | None = None) -> DataFrame:
    """Number rows into batches of ``size`` (``batch_no`` = floor((row_number-1)/size)).

    With ``partition_col`` the numbering restarts per key.  Neither form sends all rows, or all
    rows of a key, to one task.
    """
    numbered = number_rows(df, order_cols, [partition_col] if partition_col else ())
    return numbered.withColumn("batch_no", F.floor((F.col("row_no") - 1) / size).cast("bigint")).drop("row_no")


def outcome_counters() -> list[Column]:
    """R5 as aggregates, for ``agg`` or ``observe``, over ``embedding``, ``is_anomaly`` and ``error`` (all nullable)."""
    return [F.count(F.lit(1)).alias("processed"),
            F.count_if(F.col("embedding").isNotNull()).alias("embeddings_generated"),
            F.count_if(F.coalesce(F.col("is_anomaly"), F.lit(False))).alias("anomalies_detected"),
            F.count_if(F.col("error").isNotNull()).alias("errors")]


def batch_outcome(df: DataFrame) -> DataFrame:
    """Processed / embedded / anomalous / failed counters of one batch result table."""
    return df.agg(*outcome_counters())
