"""Vector table operators: K1, K3-K6, SRC6.

Scale notes: the vector table is scanned once per query; equality filters on the payload
(level, service) are pushed into the Parquet scan; top-k uses TakeOrderedAndProject (each
task keeps k rows).  Exact k-NN for many queries at once (K2) lives in ``knn.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vector as VX


def valid_vectors(vec: DataFrame, col: str = "embedding") -> DataFrame:
    """K6: drop points without a vector."""
    return vec.filter(F.col(col).isNotNull() & (F.size(col) > 0))


def knn(vec: DataFrame, query, k: int = 10, level: str | None = None,
        service: str | None = None, min_score: float | None = None,
        id_col: str = "log_id") -> DataFrame:
    """K1: cosine top-k with equality filters and a minimum score (B21: applied as a filter).

    ``query`` is a list of floats or an array Column.  Rows are ordered by score desc with an
    id tie-break and numbered from 1 (``rank``).
    """
    q = VX.literal_vector(query) if not isinstance(query, Column) else query.cast("array<double>")
    df = valid_vectors(vec)
    if level:
        df = df.filter(F.col("level") == level)
    if service:
        df = df.filter(F.col("service") == service)
    df = df.withColumn("_q", q).withColumn("score", VX.cosine("embedding", "_q")).drop("_q")
    if min_score is not None:
        df = df.filter(F.col("score") >= F.lit(float(min_score)))
    top = df.orderBy(F.col("score").desc(), F.col(id_col)).limit(int(k))
    return top


def get_vector(vec: DataFrame, log_id) -> DataFrame:
    """K3."""
    return vec.filter(F.col("log_id") == F.lit(log_id))


def scan_vectors(vec: DataFrame, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """SRC6: full scan with an optional payload filter and an optional limit (ordered by id)."""
    df = vec if where is None else vec.filter(where)
    if limit is not None:
        df = df.orderBy("log_id").limit(int(limit))
    return df


def upsert_vectors(vec: DataFrame, new: DataFrame) -> DataFrame:
    """K4 upsert: points of ``new`` replace points with the same id (anti join + union)."""
    return vec.join(new.select("log_id"), "log_id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete_vectors(vec: DataFrame, ids: DataFrame) -> DataFrame:
    """K4 delete."""
    return vec.join(ids.select("log_id"), "log_id", "left_anti")


def vector_stats(vec: DataFrame, dim: int | None = None) -> DataFrame:
    """K5: count, vectors, min/max dimension, and points whose dimension differs from ``dim``."""
    size = F.size("embedding")
    aggs = [F.count(F.lit(1)).alias("points"),
            F.count_if(F.col("embedding").isNotNull()).alias("with_vector"),
            F.min(F.when(F.col("embedding").isNotNull(), size)).cast("bigint").alias("min_dim"),
            F.max(F.when(F.col("embedding").isNotNull(), size)).cast("bigint").alias("max_dim")]
    if dim is not None:
        aggs.append(F.count_if(F.col("embedding").isNotNull() & (size != dim)).alias("dim_mismatch"))
    return vec.agg(*aggs)
