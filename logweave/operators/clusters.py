"""Cluster queries over an assignment table (log_id, cluster_id; -1 = noise): C2-C10, A3.

Per-cluster aggregates are partial/final hash aggregates, so a cluster holding a third of all
rows costs one partial row per task.  "First n members" is a salted two-phase top-n: ranks are
taken inside (cluster, salt) groups, at most n * salts survivors per cluster are merged — no
task ever sorts a whole hot cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as VX

NOISE = -1


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], n: int,
                    salt_col: str | None = None, salts: int = 64) -> DataFrame:
    """Exact top-n rows per group, skew-safe: rank inside (group, salt), keep <= n per salt,
    then rank the survivors per group."""
    salt = F.xxhash64(F.col(salt_col) if salt_col else F.monotonically_increasing_id()) % salts
    s = df.withColumn("_salt", F.pmod(salt, F.lit(salts)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    s = s.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= n)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return s.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= n).drop("_salt", "_r")


def sample_key(id_col: str = "log_id", seed: int = 42) -> Column:
    """Portable hash order key (also computable in plain SQL): Knuth multiplicative hash."""
    return F.pmod(F.col(id_col) * F.lit(2654435761) + F.lit(seed), F.lit(4294967296))


def sample_vectors(vec: DataFrame, n: int | None = None, seed: int = 42,
                   float32: bool = True) -> DataFrame:
    """Seeded hash sample of ``n`` vectors (B17: no unseeded sampling, no hard cap on the
    distributed path); optional float32 cast of the embedding."""
    df = vec
    if n is not None:
        df = df.withColumn("_k", sample_key("log_id", seed)).orderBy("_k", "log_id").limit(int(n)).drop("_k")
    if float32:
        df = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    return df


def clustering_summary(assign: DataFrame) -> DataFrame:
    """n_clusters (excluding noise), n_outliers, total, outlier percentage."""
    return assign.agg(
        F.count_distinct(F.when(F.col("cluster_id") != NOISE, F.col("cluster_id"))).alias("n_clusters"),
        F.count_if(F.col("cluster_id") == NOISE).alias("n_outliers"),
        F.count(F.lit(1)).alias("total")) \
        .withColumn("outlier_pct", F.round(F.when(F.col("total") > 0,
                                                  F.col("n_outliers") * 100.0 / F.col("total")), 6))


def cluster_metadata(assign: DataFrame, vec: DataFrame, representatives: int = 10) -> DataFrame:
    """C4: per real cluster: size, centroid (mean per dimension), first member ids (by id)."""
    a = assign.filter(F.col("cluster_id") != NOISE)
    size = a.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    dims = a.join(vec.select("log_id", "embedding"), "log_id") \
        .select("cluster_id", F.posexplode(VX.as_double("embedding")).alias("dim", "x")) \
        .groupBy("cluster_id", "dim").agg(F.avg("x").alias("m"))
    cent = dims.groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))
    reps = top_n_per_group(a, ["cluster_id"], [F.col("log_id")], representatives, salt_col="log_id") \
        .groupBy("cluster_id").agg(F.array_sort(F.collect_list("log_id")).alias("representative_logs"))
    return size.join(cent, "cluster_id", "left").join(reps, "cluster_id", "left")


def list_clusters(clu: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Clusters by size desc (id tie-break), paged."""
    return clu.orderBy(F.col("cluster_size").desc(), F.col("cluster_id")).offset(offset).limit(limit)


def cluster_members(anom: DataFrame, logs: DataFrame, cluster_id: int, limit: int = 100) -> DataFrame:
    """C6 members: up to ``limit`` logs of one cluster, by id."""
    ids = anom.filter(F.col("cluster_id") == cluster_id).select("log_id", "anomaly_score", "is_anomaly")
    return logs.join(ids, "log_id").orderBy("log_id").limit(limit)


def cluster_detail(clu: DataFrame, anom: DataFrame, logs: DataFrame, cluster_id: int,
                   limit: int = 100) -> DataFrame:
    """Metadata of one cluster with its first ``limit`` member logs (one row per member)."""
    meta = clu.filter(F.col("cluster_id") == cluster_id).select("cluster_id", "cluster_size")
    mem = cluster_members(anom, logs, cluster_id, limit).withColumn("cluster_id", F.lit(cluster_id))
    return meta.join(mem, "cluster_id", "inner")


def cluster_of_log(anom: DataFrame, clu: DataFrame, log_id) -> DataFrame:
    """The log's cluster: none if unassigned, a fixed outlier row for -1, else metadata."""
    a = anom.filter(F.col("log_id") == F.lit(log_id)).select("log_id", "cluster_id")
    j = a.join(clu.select("cluster_id", "cluster_size"), "cluster_id", "left")
    return j.select("log_id", "cluster_id",
                    F.when(F.col("cluster_id") == NOISE, F.lit(True)).otherwise(F.lit(False)).alias("is_outlier"),
                    F.when(F.col("cluster_id") == NOISE, F.lit(None).cast("bigint"))
                    .otherwise(F.col("cluster_size")).alias("cluster_size")) \
        .filter(F.col("cluster_id").isNotNull())


def outliers(anom: DataFrame, logs: DataFrame) -> DataFrame:
    """Noise points joined to their logs, with validation and tier; ``total`` counts the
    noise rows before the join (a scalar subquery)."""
    o = anom.filter(F.col("cluster_id") == NOISE)
    total = o.select(F.count(F.lit(1))).scalar()
    j = o.join(logs.select("log_id", "ts", "level", "service", "message", "created_at"), "log_id", "inner")
    reasoning = F.col("llm_reasoning")
    return j.select("log_id", "ts", "level", "service", "message", "anomaly_score", "llm_reasoning",
                    reasoning.isNotNull().alias("llm_validated"), "detection_method",
                    F.when(F.coalesce(reasoning, F.lit("")) != "", F.lit("tier2")).otherwise(F.lit("tier1"))
                    .alias("hybrid_tier"), "created_at").withColumn("total", total)


def filter_outliers(df: DataFrame, mode: str = "all", outliers_only: bool = False) -> DataFrame:
    """Dashboard filter over points (is_outlier, llm_validated)."""
    out = df
    if outliers_only:
        out = out.filter("is_outlier")
    if mode == "validated":
        out = out.filter(~F.col("is_outlier") | F.col("llm_validated"))
    elif mode == "unvalidated":
        out = out.filter(~F.col("is_outlier") | ~F.col("llm_validated"))
    elif mode != "all":
        raise ValueError("mode must be all, validated or unvalidated")
    return out


def reference_cluster(assign: DataFrame, samples: int = 10) -> DataFrame:
    """The largest real cluster (id tie-break) and its first ``samples`` members by id."""
    big = assign.filter(F.col("cluster_id") != NOISE).groupBy("cluster_id") \
        .agg(F.count(F.lit(1)).alias("cluster_size")) \
        .orderBy(F.col("cluster_size").desc(), "cluster_id").limit(1)
    mem = assign.join(F.broadcast(big.select("cluster_id")), "cluster_id", "left_semi") \
        .orderBy("log_id").limit(samples)
    return big.join(mem, "cluster_id")


def outlier_metrics(anom: DataFrame, clu: DataFrame) -> DataFrame:
    """A3: clusters, outliers, model-validated outliers, tier-1 and tier-2 counts."""
    n_clusters = clu.filter(F.col("cluster_id") != NOISE).select(F.count(F.lit(1))).scalar()
    o = anom.filter(F.col("cluster_id") == NOISE)
    r = F.col("llm_reasoning")
    return o.agg(F.count(F.lit(1)).alias("total_outliers"),
                 F.count_if(r.isNotNull()).alias("llm_validated_outliers"),
                 F.count_if(F.coalesce(r, F.lit("")) == "").alias("tier1_anomalies"),
                 F.count_if(F.coalesce(r, F.lit("")) != "").alias("tier2_anomalies")) \
        .withColumn("total_clusters", n_clusters)
