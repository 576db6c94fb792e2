"""Registered queries: triage preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knn as KN
from ..operators import triage as T
from ..sources.tables import Tables
from .registry import register

_K2 = """qv AS (SELECT log_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM vectors WHERE level = 'ERROR'),
p AS (SELECT qv.query_id, v.log_id AS neighbor_id, list_cosine_similarity(qv.q, CAST(v.embedding AS DOUBLE[])) AS s
      FROM qv, vectors v WHERE v.log_id <> qv.query_id AND v.embedding IS NOT NULL),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) AS rnk FROM p) WHERE rnk <= 5)"""


def _neighbours(t):
    qs = t.vectors.filter(F.col("level") == "ERROR").select(F.col("log_id").alias("query_id"), "embedding")
    return KN.knn_join(qs, t.vectors, k=5, exclude_self=True)


@register("T1", f"""WITH {_K2}
SELECT k2.query_id, string_agg(CAST(k2.rnk AS VARCHAR) || '. [' || COALESCE(l.level, 'N/A') || '] ' || COALESCE(l.message, ''), chr(10) ORDER BY k2.rnk) AS context_text
FROM k2 LEFT JOIN logs l ON l.log_id = k2.neighbor_id GROUP BY k2.query_id""", views=("vectors", "logs"))
def q_t1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return T.context_text(_neighbours(t), t.logs)


_CLU = """meta AS (SELECT cluster_id, COUNT(*) AS cluster_size FROM assignments WHERE cluster_id <> -1 GROUP BY cluster_id),
mem AS (SELECT a.cluster_id, l.log_id, l.level, l.message,
          row_number() OVER (PARTITION BY a.cluster_id ORDER BY l.log_id) AS i
        FROM assignments a JOIN logs l ON l.log_id = a.log_id WHERE a.cluster_id <> -1),
cc AS (SELECT meta.cluster_id, '- Cluster ID: ' || CAST(meta.cluster_id AS VARCHAR) || chr(10) || '- Cluster Size: ' ||
         CAST(meta.cluster_size AS VARCHAR) || chr(10) || '- Sample logs from cluster:' ||
         COALESCE(chr(10) || string_agg('  ' || CAST(mem.i AS VARCHAR) || '. [' || COALESCE(mem.level, 'N/A') || '] ' ||
           substring(COALESCE(mem.message, ''), 1, 100) || '...', chr(10) ORDER BY mem.i), '') AS cluster_context
       FROM meta LEFT JOIN mem ON mem.cluster_id = meta.cluster_id AND mem.i <= 3 GROUP BY meta.cluster_id, meta.cluster_size)"""


def _cluster_ctx(t):
    a = t.assignments.filter(F.col("cluster_id") != -1)
    clu = a.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    members = a.join(t.logs.select("log_id", "level", "message"), "log_id")
    return T.cluster_context_text(clu, members)


@register("T2", f"WITH {_CLU} SELECT cluster_id, cluster_context FROM cc", views=("assignments", "logs"))
def q_t2(spark, sf_dir):
    return _cluster_ctx(Tables(spark, sf_dir))


@register("T3", f"""WITH {_K2}, {_CLU},
ctx AS (SELECT k2.query_id, string_agg(CAST(k2.rnk AS VARCHAR) || '. [' || COALESCE(l.level, 'N/A') || '] ' || COALESCE(l.message, ''), chr(10) ORDER BY k2.rnk) AS context_text
        FROM k2 LEFT JOIN logs l ON l.log_id = k2.neighbor_id GROUP BY k2.query_id),
c AS (SELECT v.log_id, l.level, l.service, l.message, ctx.context_text, cc.cluster_context
      FROM vectors v JOIN logs l ON l.log_id = v.log_id LEFT JOIN ctx ON ctx.query_id = v.log_id
      LEFT JOIN assignments a ON a.log_id = v.log_id LEFT JOIN cc ON cc.cluster_id = a.cluster_id WHERE v.level = 'ERROR')
SELECT log_id, 'root_cause' AS prompt_kind,
  'Explain why this log entry is anomalous; list root causes and remediation steps in JSON.' || chr(10) || 'Level: ' || COALESCE(level, 'N/A') ||
  chr(10) || 'Service: ' || COALESCE(service, 'N/A') || chr(10) || 'Message: ' || COALESCE(message, '') ||
  CASE WHEN COALESCE(context_text, '') <> '' THEN chr(10) || chr(10) || 'Similar logs:' || chr(10) || context_text ELSE '' END ||
  CASE WHEN COALESCE(cluster_context, '') <> '' THEN chr(10) || chr(10) || 'Cluster:' || chr(10) || cluster_context ELSE '' END AS prompt
FROM c""", views=("vectors", "logs", "assignments"))
def q_t3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    cand = t.vectors.filter(F.col("level") == "ERROR").select("log_id") \
        .join(t.logs.select("log_id", "level", "service", "message"), "log_id")
    ctx = T.context_text(_neighbours(t), t.logs).withColumnRenamed("query_id", "log_id")
    cc = _cluster_ctx(t)
    df = cand.join(ctx, "log_id", "left").join(t.assignments, "log_id", "left").join(cc, "cluster_id", "left")
    return T.build_prompts(df, "root_cause")


_VERD = """SELECT log_id,
  CASE WHEN COALESCE(json_valid(response), false) AND json_type(CASE WHEN json_valid(response) THEN response END) = 'OBJECT'
       THEN COALESCE(CAST(json_extract_string(response, '$.is_anomaly') AS BOOLEAN), false) END AS is_anomaly,
  CASE WHEN COALESCE(json_valid(response), false) AND json_type(CASE WHEN json_valid(response) THEN response END) = 'OBJECT'
       THEN COALESCE(TRY_CAST(json_extract_string(response, '$.confidence') AS DOUBLE), 0.5) END AS confidence,
  CASE WHEN COALESCE(json_valid(response), false) AND json_type(CASE WHEN json_valid(response) THEN response END) = 'OBJECT'
       THEN COALESCE(json_extract_string(response, '$.reasoning'), 'No reasoning provided') END AS reasoning
FROM verdicts"""


@register("T4", _VERD, views=("verdicts",))
def q_t4(spark, sf_dir):
    v = Tables(spark, sf_dir).verdicts
    return T.parse_verdicts(v).select("log_id", "is_anomaly", "confidence", "reasoning")


@register("T6", f"""WITH v AS ({_VERD}) SELECT log_id, COALESCE(is_anomaly AND confidence >= 0.6, false) AS confirmed FROM v""",
          views=("verdicts",))
def q_t6(spark, sf_dir):
    v = T.parse_verdicts(Tables(spark, sf_dir).verdicts)
    return T.confirmed(v).select("log_id", "confirmed")


_OBJ = "(COALESCE(json_valid(response), false) AND json_type(CASE WHEN json_valid(response) THEN response END) = 'OBJECT')"
_RC = f"""SELECT log_id, {_OBJ} AS ok,
  CASE WHEN {_OBJ} THEN COALESCE(json_extract_string(response, '$.explanation'), 'No explanation provided')
       ELSE 'fallback for ' || CAST(log_id AS VARCHAR) END AS explanation,
  CASE WHEN {_OBJ} THEN COALESCE(json_extract_string(response, '$.severity'), 'MEDIUM') ELSE 'MEDIUM' END AS severity,
  CASE WHEN {_OBJ} THEN COALESCE(json_extract_string(response, '$.severity_reason'), 'No reason provided')
       ELSE 'Analysis completed but structured parsing failed' END AS severity_reason,
  CASE WHEN {_OBJ} THEN COALESCE(json_array_length(response, '$.root_causes'), 0) ELSE 0 END AS n_causes,
  CASE WHEN {_OBJ} THEN COALESCE(json_array_length(response, '$.remediation_steps'), 0) ELSE 0 END AS n_steps,
  response FROM root_causes"""


def _rc(t):
    r = t.root_causes
    return T.parse_root_cause(r, fallback=F.concat(F.lit("fallback for "), F.col("log_id").cast("string")))


@register("T5", f"""WITH r AS ({_RC}) SELECT log_id, explanation, severity, severity_reason,
  CAST(n_causes AS INTEGER) AS n_causes, CAST(n_steps AS INTEGER) AS n_steps FROM r""", views=("root_causes",))
def q_t5(spark, sf_dir):
    p = _rc(Tables(spark, sf_dir))
    return p.select("log_id", "explanation", "severity", "severity_reason",
                    F.size("root_causes").alias("n_causes"), F.size("remediation_steps").alias("n_steps"))


_T7 = f"""WITH r AS ({_RC}),
c AS (SELECT log_id, string_agg('- ' || COALESCE(json_extract_string(x, '$.hypothesis'), 'Unknown') || ': ' ||
        COALESCE(json_extract_string(x, '$.description'), ''), chr(10) ORDER BY i) AS causes
      FROM (SELECT log_id, unnest(json_extract(response, '$.root_causes[*]')) AS x,
                   generate_subscripts(json_extract(response, '$.root_causes[*]'), 1) AS i FROM r WHERE ok AND n_causes > 0) GROUP BY log_id),
s AS (SELECT log_id, string_agg('- [' || COALESCE(json_extract_string(x, '$.priority'), 'MEDIUM') || '] ' ||
        COALESCE(json_extract_string(x, '$.step'), 'Unknown') || ': ' || COALESCE(json_extract_string(x, '$.description'), ''),
        chr(10) ORDER BY i) AS steps
      FROM (SELECT log_id, unnest(json_extract(response, '$.remediation_steps[*]')) AS x,
                   generate_subscripts(json_extract(response, '$.remediation_steps[*]'), 1) AS i FROM r WHERE ok AND n_steps > 0) GROUP BY log_id)
SELECT r.log_id, r.explanation ||
  CASE WHEN c.causes IS NOT NULL THEN chr(10) || chr(10) || chr(10) || 'Root Causes:' || chr(10) || c.causes ELSE '' END ||
  CASE WHEN s.steps IS NOT NULL THEN chr(10) || chr(10) || chr(10) || 'Remediation Steps:' || chr(10) || s.steps ELSE '' END ||
  chr(10) || chr(10) || chr(10) || 'Severity: ' || r.severity || ' - ' || r.severity_reason AS rendered
FROM r LEFT JOIN c ON c.log_id = r.log_id LEFT JOIN s ON s.log_id = r.log_id"""


@register("T7", _T7, views=("root_causes",))
def q_t7(spark, sf_dir):
    return T.render_reasoning(_rc(Tables(spark, sf_dir))).select("log_id", "rendered")


@register("T8", """SELECT log_id, round(anomaly_score, 6) AS anomaly_score FROM anomalies WHERE cluster_id = -1
ORDER BY anomaly_score DESC, log_id LIMIT 5""", views=("anomalies",))
def q_t8(spark, sf_dir):
    a = Tables(spark, sf_dir).anomalies.filter(F.col("cluster_id") == -1)
    return T.cap(a, 5).select("log_id", F.round("anomaly_score", 6).alias("anomaly_score"))


_T7_NOFB = _T7.replace("ELSE 'fallback for ' || CAST(log_id AS VARCHAR) END AS explanation", "END AS explanation")


@register("T9", f"""WITH v AS ({_VERD}), r AS ({_T7_NOFB.replace('WITH r AS', 'WITH r0 AS', 1)})
SELECT v.log_id, COALESCE(r.rendered, v.reasoning) AS llm_reasoning,
  CASE WHEN r.rendered IS NOT NULL THEN 'root_cause' WHEN v.reasoning IS NOT NULL THEN 'verdict' END AS reasoning_source
FROM v LEFT JOIN r ON r.log_id = v.log_id""".replace("WITH r0 AS", "WITH r AS"), views=("verdicts", "root_causes"))
def q_t9(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rc = T.render_reasoning(T.parse_root_cause(t.root_causes)).select("log_id", "rendered")
    v = T.parse_verdicts(t.verdicts).select("log_id", "reasoning")
    j = v.join(rc, "log_id", "left").withColumn("plain_explanation", F.lit(None).cast("string"))
    return T.choose_reasoning(j).select("log_id", "llm_reasoning", "reasoning_source")


@register("T10", """WITH meta AS (SELECT DISTINCT cluster_id FROM assignments WHERE cluster_id <> -1)
SELECT l.log_id, a.cluster_id,
  CASE WHEN a.cluster_id IS NOT NULL AND a.cluster_id <> -1 AND m.cluster_id IS NOT NULL THEN 'cluster' ELSE 'similar' END AS context_kind
FROM logs l LEFT JOIN anomalies a ON a.log_id = l.log_id LEFT JOIN meta m ON m.cluster_id = a.cluster_id
WHERE l.level IN ('ERROR', 'FATAL')""", views=("logs", "anomalies", "assignments"))
def q_t10(spark, sf_dir):
    t = Tables(spark, sf_dir)
    clu = t.assignments.filter(F.col("cluster_id") != -1).select("cluster_id").distinct()
    ids = t.logs.filter(F.col("level").isin("ERROR", "FATAL"))
    return T.route_context(ids, t.anomalies, clu)

