"""Registered queries: cluster queries over the assignment table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import upsert as U
from ..sources.tables import Tables
from .registry import register

_META = """meta AS (
  SELECT a.cluster_id, COUNT(*) AS cluster_size FROM assignments a WHERE a.cluster_id <> -1 GROUP BY a.cluster_id)"""
_CENT = """cent AS (SELECT cluster_id, list(round(m, 6) ORDER BY i) AS centroid FROM (
  SELECT a.cluster_id, i, avg(x) AS m FROM (
    SELECT log_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM vectors) v
  JOIN assignments a ON a.log_id = v.log_id WHERE a.cluster_id <> -1 GROUP BY a.cluster_id, i) GROUP BY cluster_id),
reps AS (SELECT cluster_id, list(log_id ORDER BY log_id) AS representative_logs FROM (
  SELECT cluster_id, log_id, row_number() OVER (PARTITION BY cluster_id ORDER BY log_id) AS r
  FROM assignments WHERE cluster_id <> -1) WHERE r <= 10 GROUP BY cluster_id)"""


def _meta(t):
    m = C.cluster_metadata(t.assignments, t.vectors)
    return m.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


@register("C1")
def q_c1(spark, sf_dir):
    """HDBSCAN over the whole vector table (rows-only; MST/core-distance invariants in tests)."""
    from ..operators.hdbscan import hdbscan
    return hdbscan(Tables(spark, sf_dir).vectors, min_cluster_size=5, min_samples=3)


@register("C1_summary")
def q_c1_summary(spark, sf_dir):
    """C3 over the HDBSCAN assignment (rows-only)."""
    from ..operators.hdbscan import hdbscan
    return C.clustering_summary(hdbscan(Tables(spark, sf_dir).vectors, 5, 3))


@register("C2", """SELECT log_id FROM vectors ORDER BY (log_id * 2654435761 + 42) % 4294967296, log_id LIMIT 100""",
          views=("vectors",))
def q_c2(spark, sf_dir):
    return C.sample_vectors(Tables(spark, sf_dir).vectors, 100, seed=42).select("log_id")


@register("C3", """SELECT COUNT(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS n_clusters,
  COUNT(*) FILTER (WHERE cluster_id = -1) AS n_outliers, COUNT(*) AS total,
  round(CASE WHEN COUNT(*) > 0 THEN COUNT(*) FILTER (WHERE cluster_id = -1) * 100.0 / COUNT(*) END, 6) AS outlier_pct
FROM assignments""", views=("assignments",))
def q_c3(spark, sf_dir):
    return C.clustering_summary(Tables(spark, sf_dir).assignments)


@register("C4", f"""WITH {_META}, {_CENT}
SELECT meta.cluster_id, meta.cluster_size, cent.centroid, reps.representative_logs
FROM meta LEFT JOIN cent ON cent.cluster_id = meta.cluster_id LEFT JOIN reps ON reps.cluster_id = meta.cluster_id""",
          views=("assignments", "vectors"))
def q_c4(spark, sf_dir):
    return _meta(Tables(spark, sf_dir))


@register("C5", f"""WITH {_META} SELECT cluster_id, cluster_size FROM meta
ORDER BY cluster_size DESC, cluster_id LIMIT 5 OFFSET 1""", views=("assignments",))
def q_c5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.list_clusters(_meta(t), limit=5, offset=1).select("cluster_id", "cluster_size")


@register("C6", f"""WITH {_META},
mem AS (SELECT l.log_id, l.level, l.message, a.anomaly_score FROM logs l JOIN anomalies a ON a.log_id = l.log_id
        WHERE a.cluster_id = 3 ORDER BY l.log_id LIMIT 100)
SELECT meta.cluster_id, meta.cluster_size, mem.log_id, mem.level, mem.message, mem.anomaly_score
FROM meta JOIN mem ON meta.cluster_id = 3""", views=("assignments", "anomalies", "logs"))
def q_c6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = C.cluster_detail(_meta(t), t.anomalies, t.logs, 3, 100)
    return d.select("cluster_id", "cluster_size", "log_id", "level", "message", "anomaly_score")


@register("C7", f"""WITH {_META}
SELECT a.log_id, a.cluster_id, a.cluster_id = -1 AS is_outlier,
  CASE WHEN a.cluster_id = -1 THEN NULL ELSE meta.cluster_size END AS cluster_size
FROM anomalies a LEFT JOIN meta ON meta.cluster_id = a.cluster_id WHERE a.log_id IN (5, 9, 19) AND a.cluster_id IS NOT NULL""",
          views=("assignments", "anomalies"))
def q_c7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = _meta(t)
    parts = [C.cluster_of_log(t.anomalies, m, i) for i in (5, 9, 19)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("C8", """SELECT a.log_id, l.level, round(a.anomaly_score, 6) AS anomaly_score, a.llm_reasoning IS NOT NULL AS llm_validated,
  CASE WHEN COALESCE(a.llm_reasoning, '') <> '' THEN 'tier2' ELSE 'tier1' END AS hybrid_tier,
  (SELECT COUNT(*) FROM anomalies WHERE cluster_id = -1) AS total
FROM anomalies a JOIN logs l ON l.log_id = a.log_id WHERE a.cluster_id = -1""", views=("anomalies", "logs"))
def q_c8(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = C.outliers(t.anomalies, t.logs)
    return o.select("log_id", "level", F.round("anomaly_score", 6).alias("anomaly_score"), "llm_validated",
                    "hybrid_tier", "total")


@register("C9", """SELECT log_id, cluster_id FROM (
  SELECT log_id, cluster_id, cluster_id = -1 AS is_outlier, llm_reasoning IS NOT NULL AS llm_validated FROM anomalies)
WHERE NOT is_outlier OR llm_validated""", views=("anomalies",))
def q_c9(spark, sf_dir):
    a = Tables(spark, sf_dir).anomalies
    pts = a.select("log_id", "cluster_id", (F.col("cluster_id") == -1).alias("is_outlier"),
                   F.col("llm_reasoning").isNotNull().alias("llm_validated"))
    return C.filter_outliers(pts, "validated").select("log_id", "cluster_id")


@register("C10", """WITH big AS (SELECT cluster_id, COUNT(*) AS cluster_size FROM assignments WHERE cluster_id <> -1
  GROUP BY cluster_id ORDER BY cluster_size DESC, cluster_id LIMIT 1)
SELECT big.cluster_id, big.cluster_size, m.log_id FROM big JOIN (
  SELECT log_id, cluster_id FROM assignments WHERE cluster_id = (SELECT cluster_id FROM big) ORDER BY log_id LIMIT 10) m
  ON m.cluster_id = big.cluster_id""", views=("assignments",))
def q_c10(spark, sf_dir):
    return C.reference_cluster(Tables(spark, sf_dir).assignments).select("cluster_id", "cluster_size", "log_id")


@register("A3", f"""WITH {_META}
SELECT COUNT(*) AS total_outliers, COUNT(llm_reasoning) AS llm_validated_outliers,
  COUNT(*) FILTER (WHERE COALESCE(llm_reasoning, '') = '') AS tier1_anomalies,
  COUNT(*) FILTER (WHERE COALESCE(llm_reasoning, '') <> '') AS tier2_anomalies,
  (SELECT COUNT(*) FROM meta) AS total_clusters
FROM anomalies WHERE cluster_id = -1""", views=("assignments", "anomalies"))
def q_a3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return C.outlier_metrics(t.anomalies, _meta(t))


@register("U2", """WITH n AS (SELECT log_id, -1 AS cluster_id FROM logs WHERE level = 'FATAL')
SELECT COALESCE(n.log_id, a.log_id) AS log_id,
  CASE WHEN a.log_id IS NOT NULL THEN round(a.anomaly_score, 6) ELSE 0.0 END AS anomaly_score,
  CASE WHEN a.log_id IS NOT NULL THEN a.is_anomaly ELSE n.cluster_id = -1 END AS is_anomaly,
  CASE WHEN n.log_id IS NOT NULL THEN 'HDBSCAN' ELSE a.detection_method END AS detection_method,
  CASE WHEN n.log_id IS NOT NULL THEN n.cluster_id ELSE a.cluster_id END AS cluster_id, a.llm_reasoning
FROM anomalies a FULL OUTER JOIN n ON n.log_id = a.log_id""", views=("anomalies", "logs"))
def q_u2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    new = t.logs.filter(F.col("level") == "FATAL").select("log_id", F.lit(-1).alias("cluster_id"))
    out = U.upsert_assignments(t.anomalies, new)
    return out.withColumn("anomaly_score", F.round("anomaly_score", 6))


@register("U3", """WITH r AS (SELECT log_id, 'checked: ' || service AS txt FROM logs WHERE level = 'ERROR')
SELECT a.log_id, COALESCE(r.txt, a.llm_reasoning) AS llm_reasoning, a.cluster_id
FROM anomalies a LEFT JOIN r ON r.log_id = a.log_id""", views=("anomalies", "logs"))
def q_u3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = t.logs.filter(F.col("level") == "ERROR").select(
        "log_id", F.concat(F.lit("checked: "), F.col("service")).alias("llm_reasoning"))
    return U.update_reasoning(t.anomalies, r).select("log_id", "llm_reasoning", "cluster_id")


@register("U4", f"""WITH {_META},
old AS (SELECT cluster_id, cluster_size, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM meta),
nw AS (SELECT a.cluster_id, COUNT(*) AS cluster_size FROM assignments a JOIN logs l ON l.log_id = a.log_id
       WHERE a.cluster_id <> -1 AND l.level = 'ERROR' GROUP BY a.cluster_id)
SELECT cluster_id, cluster_size, updated_at FROM old WHERE cluster_id NOT IN (SELECT cluster_id FROM nw)
UNION ALL SELECT cluster_id, cluster_size, TIMESTAMP '2024-02-01 00:00:00' FROM nw""",
          views=("assignments", "logs"))
def q_u4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    old = _meta(t).withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    err = t.assignments.join(t.logs.filter(F.col("level") == "ERROR").select("log_id"), "log_id", "left_semi")
    new = C.cluster_metadata(err, t.vectors)
    out = U.upsert_metadata(old, new, updated_at="2024-02-01 00:00:00")
    return out.select("cluster_id", "cluster_size", "updated_at")
