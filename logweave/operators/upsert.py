"""Keyed result maintenance without a table format.

Each upsert is a full outer join on the key plus per-column ``coalesce``/``when`` rules — a
set-based rewrite instead of one lookup per row.  ``commit_version`` writes the new table as
a fresh version directory and then adds a line to a commit log, so readers never see a
half-written table (one writer at a time).  With a v2 table format on the classpath the same
rules map to ``DataFrame.mergeInto``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANOM_COLUMNS = ["log_id", "anomaly_score", "is_anomaly", "detection_method", "cluster_id",
                "llm_reasoning"]


def upsert_scores(anom: DataFrame, scored: DataFrame) -> DataFrame:
    """Detector results (score, flag, method) by log id; keeps cluster_id and reasoning."""
    o = anom.select(*[F.col(c).alias(f"o_{c}") for c in ANOM_COLUMNS])
    n = scored.select(F.col("log_id").alias("n_log_id"), F.col("anomaly_score").alias("n_score"),
                      F.col("is_anomaly").alias("n_flag"), F.col("detection_method").alias("n_method"))
    j = o.join(n, F.col("o_log_id") == F.col("n_log_id"), "full_outer")
    has_new = F.col("n_log_id").isNotNull()
    return j.select(
        F.coalesce("n_log_id", "o_log_id").alias("log_id"),
        F.when(has_new, F.col("n_score")).otherwise(F.col("o_anomaly_score")).alias("anomaly_score"),
        F.when(has_new, F.col("n_flag")).otherwise(F.col("o_is_anomaly")).alias("is_anomaly"),
        F.when(has_new, F.col("n_method")).otherwise(F.col("o_detection_method")).alias("detection_method"),
        F.col("o_cluster_id").alias("cluster_id"),
        F.col("o_llm_reasoning").alias("llm_reasoning"))


def upsert_assignments(anom: DataFrame, assign: DataFrame, method: str = "HDBSCAN") -> DataFrame:
    """U2 (B15): an existing row gets only cluster_id and detection_method; a new row also gets
    score 0 and is_anomaly = (cluster_id = -1)."""
    o = anom.select(*[F.col(c).alias(f"o_{c}") for c in ANOM_COLUMNS])
    n = assign.select(F.col("log_id").alias("n_log_id"), F.col("cluster_id").alias("n_cluster"))
    j = o.join(n, F.col("o_log_id") == F.col("n_log_id"), "full_outer")
    has_new = F.col("n_log_id").isNotNull()
    existed = F.col("o_log_id").isNotNull()
    return j.select(
        F.coalesce("n_log_id", "o_log_id").alias("log_id"),
        F.when(existed, F.col("o_anomaly_score")).otherwise(F.lit(0.0)).alias("anomaly_score"),
        F.when(existed, F.col("o_is_anomaly")).otherwise(F.col("n_cluster") == -1).alias("is_anomaly"),
        F.when(has_new, F.lit(method)).otherwise(F.col("o_detection_method")).alias("detection_method"),
        F.when(has_new, F.col("n_cluster")).otherwise(F.col("o_cluster_id")).alias("cluster_id"),
        F.col("o_llm_reasoning").alias("llm_reasoning"))


def update_reasoning(anom: DataFrame, reasoning: DataFrame) -> DataFrame:
    """Set llm_reasoning on existing rows only (ids not in ``anom`` are ignored)."""
    r = reasoning.select(F.col("log_id").alias("r_id"), F.col("llm_reasoning").alias("r_text"))
    j = anom.join(r, anom["log_id"] == r["r_id"], "left")
    return j.select(*[F.coalesce("r_text", "llm_reasoning").alias(c) if c == "llm_reasoning" else F.col(c)
                      for c in anom.columns])


def upsert_metadata(clu: DataFrame, new: DataFrame, updated_at=None, replace: bool = False) -> DataFrame:
    """U4: cluster metadata by cluster_id with updated_at; vanished clusters are kept
    unless ``replace``."""
    ts = F.lit(updated_at).cast("timestamp_ntz") if updated_at is not None else \
        F.current_timestamp().cast("timestamp_ntz")
    cols = ["cluster_id", "cluster_size", "centroid", "representative_logs"]
    n = new.select(*cols).withColumn("updated_at", ts)
    if replace:
        return n
    old = clu.select(*cols, "updated_at").join(n.select("cluster_id"), "cluster_id", "left_anti")
    return old.unionByName(n)


# ---- versioned tables -------------------------------------------------------------------

def _pointer(path: str) -> str:
    return f"{path.rstrip('/')}/_commits"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq bigint, version string").json(_pointer(path))


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """Read the latest committed version of a versioned table."""
    version = _commits(spark, path).orderBy(F.desc("seq")).first()["version"]
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def commit_version(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as a new version directory, then add a line to the commit log.

    Nothing that a reader may be looking at is removed: it finds the version before or the one
    after.  There may be one writer at a time; old versions stay until they are cleared away.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path.rstrip('/')}/{version}")
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_pointer(path))
    there = log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(log)
    last = _commits(spark, path).agg(F.max("seq").alias("seq")).first()["seq"] if there else None
    spark.createDataFrame([((last or 0) + 1, version)], "seq bigint, version string").coalesce(1) \
        .write.mode("append").json(_pointer(path))
    return version
