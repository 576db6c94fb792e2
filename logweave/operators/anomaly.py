"""Statistical anomaly detection over embeddings: Z1-Z4, Z6-Z8.

Plan shape: one pass computes the centroid (posexplode + partial/final aggregate: a task emits
one row per dimension), the centroid and the population statistics enter later stages as
scalar subqueries (a single row of size d — never a join, never a collect), and scoring is a
narrow projection over the vector scan.  The level comes from a join with the log table.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as VX
from ..functions.levels import level_gate, level_weight
from .numbering import percentiles
from .vectors import valid_vectors


def centroid_rows(vec: DataFrame) -> DataFrame:
    """Z1 as rows: (dim, mean) — dims are 0-based."""
    return valid_vectors(vec).select(F.posexplode(VX.as_double("embedding")).alias("dim", "x")) \
        .groupBy("dim").agg(F.avg("x").alias("mean"))


def centroid(vec: DataFrame) -> DataFrame:
    """One row ``centroid ARRAY<DOUBLE>`` (d values; bounded by the dimension)."""
    rows = centroid_rows(vec)
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))),
                                lambda s: s["mean"]).alias("centroid"))


def centroid_distance(vec: DataFrame) -> DataFrame:
    """Euclidean distance of every vector to the centroid."""
    c = centroid(vec).select("centroid").scalar()
    # The centroid enters as a scalar subquery column (one row of d values); the lambda of the
    # distance reads that column (subqueries may not appear inside higher-order functions).
    return valid_vectors(vec).withColumn("_centroid", c) \
        .withColumn("distance", VX.euclidean("embedding", "_centroid")).drop("_centroid")


def _with_level(df: DataFrame, logs: DataFrame | None) -> DataFrame:
    if logs is None:
        return df if "level" in df.columns else df.withColumn("level", F.lit(None).cast("string"))
    base = df.drop("level") if "level" in df.columns else df
    return base.join(logs.select("log_id", "level"), "log_id", "left")


def _distance_table(vec: DataFrame, logs: DataFrame | None) -> DataFrame:
    """(log_id, level, distance ...) without the vectors, persisted: the population statistics
    and the scoring both read this small table instead of re-scanning the vectors (two passes
    over the vectors in total: centroid, distances)."""
    d = _with_level(centroid_distance(vec).drop("embedding"), logs)
    return d.persist(StorageLevel.MEMORY_AND_DISK)


def gated_zscore(rows: DataFrame, threshold: float, weights: dict | None = None) -> DataFrame:
    """``anomaly_score`` (= |z|), ``is_anomaly`` and method of rows with ``distance``, ``level`` and the
    population's ``_st(m, s, n)``; NULL with fewer than 2 vectors or zero spread."""
    m, s, n = F.col("_st.m"), F.col("_st.s"), F.col("_st.n")
    z = F.when((n >= 2) & (s > 0), F.abs((F.col("distance") - m) / s))
    return rows.withColumn("anomaly_score", z) \
        .withColumn("is_anomaly", level_gate(z > F.lit(threshold), z, threshold, level_weight("level", weights))) \
        .withColumn("detection_method", F.lit("Z-score")).drop("_st")


def detect_zscore(vec: DataFrame, logs: DataFrame | None = None, threshold: float = 3.0,
                  weights: dict | None = None) -> DataFrame:
    """Z3: |d - mean| / std_pop(d) > threshold, then the level gate.

    Returns every vector with ``anomaly_score`` (= |z|), ``distance`` and ``is_anomaly``;
    with fewer than 2 vectors or zero spread no row is returned (as the reference).
    """
    if not 1.0 <= threshold <= 5.0:
        raise ValueError("threshold must be in 1..5")
    d = _distance_table(vec, logs)
    st = d.agg(F.struct(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s"),
                        F.count(F.lit(1)).alias("n")).alias("st")).select("st").scalar()
    d = d.withColumn("_st", st).filter((F.col("_st.n") >= 2) & (F.col("_st.s") > 0))
    return gated_zscore(d, threshold, weights)


def detect_iqr(vec: DataFrame, logs: DataFrame | None = None, multiplier: float = 1.5,
               weights: dict | None = None, approximate: bool = False) -> DataFrame:
    """Outside [q1 - m*iqr, q3 + m*iqr]; score = distance past the nearer bound / iqr; gate
    score > 1/weight for weights below 0.8.  Exact linear-interpolated percentiles (= numpy);
    ``approximate=True`` switches to ``percentile_approx`` for very large populations."""
    if not 0.5 <= multiplier <= 3.0:
        raise ValueError("multiplier must be in 0.5..3")
    d = _distance_table(vec, logs)
    if approximate:
        q = F.percentile_approx("distance", [0.25, 0.75], 100000)
    else:
        q = F.first(percentiles(d, "distance", [0.25, 0.75]))  # literals
    st = d.agg(F.struct(q.alias("q"), F.count(F.lit(1)).alias("n")).alias("st")).select("st").scalar()
    d = d.withColumn("_st", st)
    n = F.col("_st.n")
    q1, q3 = F.col("_st.q")[0], F.col("_st.q")[1]
    iqr = q3 - q1
    lo, hi = q1 - F.lit(multiplier) * iqr, q3 + F.lit(multiplier) * iqr
    d = d.filter((n >= 4) & (iqr != 0))
    dist = F.col("distance")
    score = F.when(dist < lo, (lo - dist) / iqr).when(dist > hi, (dist - hi) / iqr).otherwise(F.lit(0.0))
    stat = (dist < lo) | (dist > hi)
    w = level_weight("level", weights)
    return d.withColumn("anomaly_score", score) \
        .withColumn("is_anomaly", level_gate(stat, score, 1.0, w)) \
        .withColumn("detection_method", F.lit("IQR")).drop("_st")


def anomalies_only(scored: DataFrame) -> DataFrame:
    return scored.filter("is_anomaly")


def score_logs(ids: DataFrame, vec: DataFrame, logs: DataFrame | None = None,
               method: str = "zscore") -> DataFrame:
    """Score the given log ids against the whole population (t=3, m=1.5 fixed).

    Population statistics are computed once for all ids; ids without a vector (or when the
    population has no spread) get NULL scores.
    """
    method = method.lower()
    if method in ("zscore", "z-score"):
        scored = detect_zscore(vec, logs, 3.0)
    elif method == "iqr":
        scored = detect_iqr(vec, logs, 1.5)
    elif method in ("isolation_forest", "iforest"):
        from .iforest import detect_iforest
        scored = detect_iforest(vec, logs, 0.1)
    else:
        raise ValueError(f"unknown method {method!r}")
    return ids.select("log_id").join(
        scored.select("log_id", "anomaly_score", "is_anomaly", "detection_method"), "log_id", "left")


def tier2_candidates(scored: DataFrame, threshold: float = 0.7, enabled: bool = True) -> DataFrame:
    """Tier-1 anomalies with score >= threshold go to model validation (when enabled)."""
    if not enabled:
        return scored.limit(0)
    return scored.filter(F.col("is_anomaly") & (F.col("anomaly_score") >= F.lit(threshold)))
