"""Row numbers and exact order statistics without a one-task window.

Rows are range partitioned, sorted within partitions and numbered there; a partition's offset is
the number of rows before it, of which there is one row a partition.  The dealt table is
checkpointed (shared folder), because a second evaluation could draw other range bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def number_rows(df: DataFrame, order_cols, key_cols=(), out: str = "row_no") -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in order of ``order_cols``, anew for each ``key_cols``.

    ``order_cols`` must tell rows apart for a defined result.  A key may hold any share of the rows.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    order = [*key_cols, *order_cols]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
             .withColumn("__part", F.spark_partition_id())
             .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint())
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    ranked = dealt.join(F.broadcast(offsets), "__part") \
        .withColumn(out, (F.col("__offset") + F.col("__at") + 1).cast("bigint")).drop("__part", "__at", "__offset")
    if not key_cols:
        return ranked
    first = ranked.groupBy(*key_cols).agg(F.min(out).alias("__first"))
    keys = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in key_cols]
    joined = ranked.alias("k").join(first.alias("f"), keys)
    return joined.select("k.*", "f.__first").withColumn(out, (F.col(out) - F.col("__first") + 1).cast("bigint")).drop("__first")


def percentiles(df: DataFrame, value: str, shares: list[float]) -> Column:
    """Exact percentiles (linear interpolation) as a scalar column of an array.

    The values are ranked in parallel and only those at the wanted ranks are read.
    """
    values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    ranked = number_rows(values, ["v"])
    n = ranked.count()
    wanted = [share * (n - 1) for share in shares]
    ranks = sorted({r + 1 for p in wanted for r in (math.floor(p), math.ceil(p))}) if n else []
    at = {r["row_no"]: r["v"] for r in ranked.where(F.col("row_no").isin(ranks)).collect()} if n else {}  # two a share
    found = [None if not n else at[math.floor(p) + 1] + (p - math.floor(p)) * (at[math.ceil(p) + 1] - at[math.floor(p) + 1])
             for p in wanted]
    return F.array(*[F.lit(x).cast("double") for x in found])
