"""Mergeable population statistics for scoring vectors as they arrive (R2's scoring track, Z7).

A population is kept as one small row a version instead of being scanned for every batch:

* ``n``, ``mean`` and ``scatter``: number of vectors, their mean vector and the sum of squared
  distances to it; two populations merge by the parallel formulas, so mean and scatter are always
  those of all vectors;
* ``center``, ``distance_mean`` and ``distance_m2``: mean and sum of squared deviations of the
  vectors' distances to a fixed centre, merged in the same way.

The Z-score needs the distances' spread about the population's mean.  Distances to a mean that moves
do not merge, so ``center`` is the mean at the last refresh: ``refresh`` moves it to the current
mean and reads all vectors once.  ``due`` says when: after the population has grown by a given
share.  With a share of 0 every batch is scored exactly as Z7 scores it against all vectors so
far; with a share g a vector is read about 1 + 1/g times in all, however many batches there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as VX
from .anomaly import centroid, gated_zscore
from .vectors import valid_vectors

SCHEMA = ("n bigint, mean array<double>, scatter double, center array<double>, distance_mean double, "
          "distance_m2 double, refreshed_n bigint")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, None, 0.0, None, 0.0, 0.0, 0)], SCHEMA)


def _scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _spread_about(value: Column, n: Column) -> Column:
    return F.coalesce(F.var_pop(value) * n, F.lit(0.0))


def moments(vec: DataFrame, center: DataFrame | None = None) -> DataFrame:
    """The population of the vectors alone, one row; distances are to ``center(center)`` or their own mean.

    Two passes over ``vec``: the mean, then distances; a task emits one row a dimension, then one row.
    """
    mean = centroid(vec)
    held = mean.select("centroid").scalar()
    about = held if center is None else F.coalesce(center.select("center").scalar(), held)
    rows = valid_vectors(vec).select("embedding").withColumn("_mean", held).withColumn("_center", about)
    rows = rows.select(VX.euclidean("embedding", "_mean").alias("r"), VX.euclidean("embedding", "_center").alias("d"),
                       "_mean", "_center")
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), F.first("_mean").alias("mean"),
                    F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("scatter"),
                    F.first("_center").alias("center"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("distance_mean"),
                    _spread_about(F.col("d"), n).alias("distance_m2")).withColumn("refreshed_n", F.col("n"))


def merge(held: DataFrame, new: DataFrame) -> DataFrame:
    """One population of two (one-row) populations with the same centre; an empty one changes nothing."""
    a, b = (df.select(F.struct(*df.columns).alias(name)) for df, name in ((held, "a"), (new, "b")))
    both = a.withColumn("b", b.select("b").scalar())
    na, nb = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    n = na + nb
    apart = F.aggregate(F.zip_with("a.mean", "b.mean", lambda x, y: (y - x) * (y - x)), F.lit(0.0), lambda s, x: s + x)
    gap = F.col("b.distance_mean") - F.col("a.distance_mean")
    merged = F.struct(
        (F.col("a.n") + F.col("b.n")).alias("n"),
        _plus(_scaled(F.col("a.mean"), na / n), _scaled(F.col("b.mean"), nb / n)).alias("mean"),
        (F.col("a.scatter") + F.col("b.scatter") + apart * na * nb / n).alias("scatter"),
        F.col("a.center").alias("center"),
        (F.col("a.distance_mean") + gap * nb / n).alias("distance_mean"),
        (F.col("a.distance_m2") + F.col("b.distance_m2") + gap * gap * na * nb / n).alias("distance_m2"),
        F.col("a.refreshed_n").alias("refreshed_n"))
    picked = F.when(F.col("a.n") == 0, F.col("b")).when(F.col("b.n") == 0, F.col("a")).otherwise(merged)
    return both.select(picked.alias("p")).select("p.*")


def due(population: dict, growth: float) -> bool:
    """Whether the centre should move: nothing was ever read, or enough has come since."""
    return population["n"] > 0 and (population["refreshed_n"] == 0
                                    or population["n"] > population["refreshed_n"] * (1 + growth))


def refresh(vec: DataFrame) -> DataFrame:
    """The population of all vectors about their own mean; reads them once for it and once for distances."""
    return moments(vec)


def score(vec: DataFrame, population: DataFrame, threshold: float = 3.0, weights: dict | None = None) -> DataFrame:
    """Z-scores of ``vec(log_id, level, embedding)`` against a population, without reading the population's vectors.

    A population of fewer than two vectors, or without spread, gives no score: NULL ``anomaly_score``
    and ``is_anomaly`` (as Z7).
    """
    st = population.select(F.struct(F.col("distance_mean").alias("m"), F.sqrt(F.try_divide("distance_m2", "n")).alias("s"),
                                    F.col("n"), F.col("center")).alias("st")).select("st").scalar()
    rows = valid_vectors(vec).withColumn("_st", st).withColumn("distance", VX.euclidean("embedding", "_st.center"))
    return gated_zscore(rows, threshold, weights)
