"""Input partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it arrives in fewer splits than there are.

    A small table of one file and one row group is one split; expensive per-row work on it would
    run on one core.  Tables with splits enough pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal(df: DataFrame, share: int = 4) -> DataFrame:
    """``df`` dealt evenly over ``share`` tasks a core, and over ``share`` a split where those are more.

    Splits of a file may hold no row group or several; where a narrow row costs much more to work on
    than to move, dealing keeps the longest task at its share of the rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(share * max(cores, df.rdd.getNumPartitions()))
