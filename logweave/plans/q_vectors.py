"""Registered queries: vectors (K*, SRC6), detectors (Z*), upserts (U1), embedding prep (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import level_weight
from ..operators import anomaly as A
from ..operators import embed as EM
from ..operators import knn as KN
from ..operators import routing as R
from ..operators import upsert as U
from ..operators import vectors as VE
from ..sources.tables import Tables
from .registry import register

QUERY_ID = 7

_CEN = """cen AS (SELECT list(m ORDER BY i) AS c FROM (
  SELECT i, avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
                              FROM vectors WHERE embedding IS NOT NULL AND len(embedding) > 0) GROUP BY i)),
d AS (SELECT v.log_id, v.level, list_distance(CAST(v.embedding AS DOUBLE[]), cen.c) AS distance
      FROM vectors v, cen WHERE v.embedding IS NOT NULL AND len(v.embedding) > 0)"""
_W = ("(CASE upper(COALESCE(level, 'INFO')) WHEN 'ERROR' THEN 1.0 WHEN 'WARN' THEN 0.8 WHEN 'WARNING' THEN 0.8 "
      "WHEN 'INFO' THEN 0.3 WHEN 'DEBUG' THEN 0.2 WHEN 'TRACE' THEN 0.1 ELSE 0.5 END)")


def _gate(stat: str, score: str, base: str) -> str:
    return f"(({stat}) AND ({_W} >= 0.8 OR ({score}) > ({base}) / {_W}))"


def _zsql(t: float) -> str:
    z = "abs(d.distance - st.m) / st.s"
    return f"""WITH {_CEN},
st AS (SELECT avg(distance) AS m, stddev_pop(distance) AS s, count(*) AS n FROM d)
SELECT d.log_id, d.level, round(d.distance, 6) AS distance, round({z}, 6) AS anomaly_score,
  {_gate(f'{z} > {t}', z, str(t))} AS is_anomaly
FROM d, st WHERE st.n >= 2 AND st.s > 0"""


def _zscore(spark, sf_dir, t):
    v = Tables(spark, sf_dir).vectors
    s = A.detect_zscore(v, None, t)
    return s.select("log_id", "level", F.round("distance", 6).alias("distance"),
                    F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@register("Z3", _zsql(2.0), views=("vectors",))
def q_z3(spark, sf_dir):
    return _zscore(spark, sf_dir, 2.0)


@register("Z3_t3", _zsql(3.0), views=("vectors",))
def q_z3_t3(spark, sf_dir):
    return _zscore(spark, sf_dir, 3.0)


@register("Z1", """WITH cen AS (SELECT i - 1 AS dim, avg(x) AS m FROM (
  SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM vectors
  WHERE embedding IS NOT NULL AND len(embedding) > 0) GROUP BY i)
SELECT dim, round(m, 6) AS mean FROM cen""", views=("vectors",))
def q_z1(spark, sf_dir):
    r = A.centroid_rows(Tables(spark, sf_dir).vectors)
    return r.select(F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"))


@register("Z2", f"WITH {_CEN} SELECT log_id, round(distance, 6) AS distance FROM d", views=("vectors",))
def q_z2(spark, sf_dir):
    d = A.centroid_distance(Tables(spark, sf_dir).vectors)
    return d.select("log_id", F.round("distance", 6).alias("distance"))


_IQR = f"""WITH {_CEN},
q AS (SELECT quantile_cont(distance, 0.25) AS q1, quantile_cont(distance, 0.75) AS q3, count(*) AS n FROM d),
b AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, n FROM q),
s AS (SELECT d.*, CASE WHEN distance < lo THEN (lo - distance) / iqr WHEN distance > hi THEN (distance - hi) / iqr
        ELSE 0.0 END AS score, (distance < lo OR distance > hi) AS stat FROM d, b WHERE n >= 4 AND iqr <> 0)
SELECT log_id, level, round(distance, 6) AS distance, round(score, 6) AS anomaly_score,
  {_gate('stat', 'score', '1.0')} AS is_anomaly FROM s"""


@register("Z4", _IQR, views=("vectors",))
def q_z4(spark, sf_dir):
    s = A.detect_iqr(Tables(spark, sf_dir).vectors, None, 1.5)
    return s.select("log_id", "level", F.round("distance", 6).alias("distance"),
                    F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@register("Z6", f"""SELECT log_id, level, CAST({_W} AS DOUBLE) AS weight FROM logs""", views=("logs",))
def q_z6(spark, sf_dir):
    lg = Tables(spark, sf_dir).logs
    return lg.select("log_id", "level", level_weight("level").alias("weight"))


@register("Z7", f"""WITH {_CEN},
st AS (SELECT avg(distance) AS m, stddev_pop(distance) AS s, count(*) AS n FROM d),
z AS (SELECT d.log_id, abs(d.distance - st.m) / st.s AS sc, d.level FROM d, st WHERE st.n >= 2 AND st.s > 0)
SELECT l.log_id, round(z.sc, 6) AS anomaly_score, {_gate('z.sc > 3.0', 'z.sc', '3.0').replace('level', 'z.level')} AS is_anomaly
FROM logs l LEFT JOIN z ON z.log_id = l.log_id WHERE l.level = 'FATAL'""", views=("logs", "vectors"))
def q_z7(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ids = t.logs.filter(F.col("level") == "FATAL")
    r = A.score_logs(ids, t.vectors, None, "zscore")
    return r.select("log_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@register("Z7_iqr", f"""WITH {_CEN},
q AS (SELECT quantile_cont(distance, 0.25) AS q1, quantile_cont(distance, 0.75) AS q3, count(*) AS n FROM d),
b AS (SELECT q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, n FROM q),
s AS (SELECT d.log_id, CASE WHEN distance < lo THEN (lo - distance) / iqr WHEN distance > hi THEN (distance - hi) / iqr
        ELSE 0.0 END AS sc FROM d, b WHERE n >= 4 AND iqr <> 0)
SELECT l.log_id, round(s.sc, 6) AS anomaly_score FROM logs l LEFT JOIN s ON s.log_id = l.log_id
WHERE l.level = 'WARN'""", views=("logs", "vectors"))
def q_z7_iqr(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = A.score_logs(t.logs.filter(F.col("level") == "WARN"), t.vectors, None, "iqr")
    return r.select("log_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@register("Z8", f"""WITH z AS ({_zsql(2.0)}) SELECT log_id, anomaly_score FROM z
WHERE is_anomaly AND anomaly_score >= 0.7""", views=("vectors",))
def q_z8(spark, sf_dir):
    s = A.detect_zscore(Tables(spark, sf_dir).vectors, None, 2.0)
    return A.tier2_candidates(s, 0.7).select("log_id", F.round("anomaly_score", 6).alias("anomaly_score"))


@register("U1", f"""WITH z AS ({_zsql(2.0)})
SELECT COALESCE(z.log_id, a.log_id) AS log_id,
  CASE WHEN z.log_id IS NOT NULL THEN z.anomaly_score ELSE round(a.anomaly_score, 6) END AS anomaly_score,
  CASE WHEN z.log_id IS NOT NULL THEN z.is_anomaly ELSE a.is_anomaly END AS is_anomaly,
  CASE WHEN z.log_id IS NOT NULL THEN 'Z-score' ELSE a.detection_method END AS detection_method,
  a.cluster_id, a.llm_reasoning
FROM anomalies a FULL OUTER JOIN z ON z.log_id = a.log_id""", views=("vectors", "anomalies"))
def q_u1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = A.detect_zscore(t.vectors, None, 2.0)
    out = U.upsert_scores(t.anomalies, s)
    return out.withColumn("anomaly_score", F.round("anomaly_score", 6))


@register("Z5")
def q_z5(spark, sf_dir):
    """Isolation Forest over the whole vector table (rows-only; invariants in tests)."""
    from ..operators.iforest import detect_iforest
    s = detect_iforest(Tables(spark, sf_dir).vectors, None, contamination=0.1, n_trees=100, seed=42)
    return s.select("log_id", "level", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@register("Z7_iforest")
def q_z7_iforest(spark, sf_dir):
    """Forest scores for the FATAL logs against the whole population (rows-only)."""
    t = Tables(spark, sf_dir)
    r = A.score_logs(t.logs.filter(F.col("level") == "FATAL"), t.vectors, None, "iforest")
    return r.select("log_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@register("K1", f"""SELECT log_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {QUERY_ID})), 6) AS score
FROM vectors WHERE level = 'ERROR' AND embedding IS NOT NULL
ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {QUERY_ID})) DESC, log_id
LIMIT 20""", views=("vectors",))
def q_k1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    qv = t.embeddings.filter(F.col("vec_id") == QUERY_ID).select("embedding").scalar()
    return VE.knn(t.vectors, qv, k=20, level="ERROR").select("log_id", F.round("score", 6).alias("score"))


@register("K2", """WITH qv AS (SELECT log_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM vectors WHERE level = 'ERROR'),
p AS (SELECT qv.query_id, v.log_id AS neighbor_id, list_cosine_similarity(qv.q, CAST(v.embedding AS DOUBLE[])) AS s
      FROM qv, vectors v WHERE v.log_id <> qv.query_id AND v.embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) AS rnk FROM p)
SELECT query_id, neighbor_id, rnk AS rank, round(s, 6) AS score FROM r WHERE rnk <= 5""", views=("vectors",))
def q_k2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    qs = t.vectors.filter(F.col("level") == "ERROR").select(F.col("log_id").alias("query_id"), "embedding")
    r = KN.knn_join(qs, t.vectors, k=5, exclude_self=True)
    return r.select("query_id", "neighbor_id", "rank", F.round("score", 6).alias("score"))


@register("K3", "SELECT log_id, level, service, ts, embedding FROM vectors WHERE log_id = 42", views=("vectors",))
def q_k3(spark, sf_dir):
    return VE.get_vector(Tables(spark, sf_dir).vectors, 42).select("log_id", "level", "service", "ts", "embedding")


@register("K4", """WITH n AS (SELECT log_id, list_transform(embedding, lambda x: -x) AS embedding, level FROM vectors WHERE level = 'ERROR')
SELECT log_id, level, round(CAST(embedding[1] AS DOUBLE), 6) AS e0 FROM (
  SELECT v.log_id, v.embedding, v.level FROM vectors v WHERE v.log_id NOT IN (SELECT log_id FROM n)
  UNION ALL SELECT * FROM n)""", views=("vectors",))
def q_k4(spark, sf_dir):
    v = Tables(spark, sf_dir).vectors.select("log_id", "embedding", "level")
    new = v.filter(F.col("level") == "ERROR").withColumn("embedding", F.transform("embedding", lambda x: -x))
    out = VE.upsert_vectors(v, new)
    return out.select("log_id", "level", F.round(F.col("embedding")[0].cast("double"), 6).alias("e0"))


@register("K4_delete", """SELECT log_id FROM vectors WHERE log_id NOT IN (SELECT log_id FROM logs WHERE level = 'DEBUG')""",
          views=("vectors", "logs"))
def q_k4_delete(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return VE.delete_vectors(t.vectors, t.logs.filter(F.col("level") == "DEBUG")).select("log_id")


@register("K5", """SELECT COUNT(*) AS points, COUNT(embedding) AS with_vector,
  MIN(len(embedding)) AS min_dim, MAX(len(embedding)) AS max_dim,
  COUNT(*) FILTER (WHERE embedding IS NOT NULL AND len(embedding) <> 64) AS dim_mismatch FROM vectors""",
          views=("vectors",))
def q_k5(spark, sf_dir):
    return VE.vector_stats(Tables(spark, sf_dir).vectors, 64)


@register("K6", "SELECT log_id FROM vectors WHERE embedding IS NOT NULL AND len(embedding) > 0", views=("vectors",))
def q_k6(spark, sf_dir):
    return VE.valid_vectors(Tables(spark, sf_dir).vectors).select("log_id")


@register("SRC6", "SELECT log_id, level, service FROM vectors WHERE service = 'svc-3'", views=("vectors",))
def q_src6(spark, sf_dir):
    return VE.scan_vectors(Tables(spark, sf_dir).vectors, where=F.col("service") == "svc-3") \
        .select("log_id", "level", "service")


@register("Q5", f"""WITH hits AS (
  SELECT log_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {QUERY_ID})) AS s
  FROM vectors WHERE embedding IS NOT NULL AND service = 'svc-1'),
top AS (SELECT log_id, s, row_number() OVER (ORDER BY s DESC, log_id) AS rnk FROM hits QUALIFY rnk <= 30)
SELECT top.log_id, top.rnk AS rank, round(top.s, 6) AS score, l.level, l.message,
  COALESCE(a.is_anomaly, false) AS is_anomaly
FROM top JOIN logs l ON l.log_id = top.log_id LEFT JOIN anomalies a ON a.log_id = top.log_id
WHERE top.rnk > 10 AND COALESCE(a.is_anomaly, false) = false""", views=("vectors", "logs", "anomalies"))
def q_q5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    qv = t.embeddings.filter(F.col("vec_id") == QUERY_ID).select("embedding").scalar()
    r = KN.semantic_search(t.logs, t.vectors, t.anomalies, qv, limit=20, offset=10,
                           service="svc-1", is_anomaly=False)
    return r.select("log_id", "rank", F.round("score", 6).alias("score"), "level", "message", "is_anomaly")


# ---- embedding preparation -----------------------------------------------------------------

@register("E1", "SELECT log_id, sha256(message) AS text_hash FROM logs", views=("logs",))
def q_e1(spark, sf_dir):
    return Tables(spark, sf_dir).logs.select("log_id", EM.text_hash("message").alias("text_hash"))


_PRIO = "level IN ('ERROR', 'WARN', 'WARNING', 'CRITICAL', 'FATAL')"


@register("E2", f"""WITH p AS (SELECT message AS text, sha256(message) AS text_hash FROM logs WHERE {_PRIO}),
cache AS (SELECT DISTINCT sha256(message) AS text_hash FROM logs WHERE level = 'ERROR' AND ts < TIMESTAMP '2024-01-15 00:00:00')
SELECT text_hash, min(text) AS text FROM p WHERE text_hash NOT IN (SELECT text_hash FROM cache) GROUP BY text_hash""",
          views=("logs",))
def q_e2(spark, sf_dir):
    lg = Tables(spark, sf_dir).logs
    texts = R.priority(lg).select(F.col("message").alias("text"))
    cache = lg.filter((F.col("level") == "ERROR") & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))) \
        .select(EM.text_hash("message").alias("text_hash")).distinct()
    _, misses = EM.split_cached(texts, cache)
    return misses


@register("E2_hits", f"""WITH p AS (SELECT log_id, message AS text, sha256(message) AS text_hash FROM logs WHERE {_PRIO}),
cache AS (SELECT sha256(message) AS text_hash, CAST(floor(length(message) / 4) AS BIGINT) AS tokens
          FROM logs WHERE level = 'ERROR' AND ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1, 2)
SELECT p.log_id, p.text_hash, cache.tokens FROM p JOIN cache ON cache.text_hash = p.text_hash""", views=("logs",))
def q_e2_hits(spark, sf_dir):
    """Cache hits reuse the cached entry (joined by content hash)."""
    lg = Tables(spark, sf_dir).logs
    texts = R.priority(lg).select("log_id", F.col("message").alias("text"))
    cache = EM.estimate_cost(lg.filter((F.col("level") == "ERROR") & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
                             .select(F.col("message").alias("text")), "text") \
        .select(EM.text_hash("text").alias("text_hash"), "tokens").distinct()
    hits, _ = EM.split_cached(texts, cache)
    return hits.select("log_id", "text_hash", "tokens")


@register("Q7_semantic", f"""SELECT v.log_id, l.level, substring(l.message, 1, 200) AS message,
  round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {QUERY_ID})), 6) AS score
FROM vectors v JOIN logs l ON l.log_id = v.log_id WHERE v.embedding IS NOT NULL
ORDER BY list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {QUERY_ID})) DESC, v.log_id
LIMIT 100""", views=("vectors", "logs"))
def q_q7_semantic(spark, sf_dir):
    """Analyst semantic search: no filters, at most 100 hits, message cut at 200."""
    t = Tables(spark, sf_dir)
    qv = t.embeddings.filter(F.col("vec_id") == QUERY_ID).select("embedding").scalar()
    hits = VE.knn(t.vectors, qv, k=100).select("log_id", "score")
    rows = t.logs.select("log_id", "level", F.substring("message", 1, 200).alias("message")) \
        .join(F.broadcast(hits), "log_id", "inner")
    return rows.select("log_id", "level", "message", F.round("score", 6).alias("score"))


@register("E3", f"""SELECT service, CAST(SUM(floor(length(message) / 4)) AS BIGINT) AS tokens,
  round(SUM(floor(length(message) / 4) / 1e6 * 0.02), 9) AS cost_usd FROM logs WHERE {_PRIO} GROUP BY service""",
          views=("logs",))
def q_e3(spark, sf_dir):
    c = EM.estimate_cost(R.priority(Tables(spark, sf_dir).logs), "message")
    return c.groupBy("service").agg(F.sum("tokens").cast("bigint").alias("tokens"),
                                    F.round(F.sum("cost_usd"), 9).alias("cost_usd"))


_BATCHES = f"""b0 AS (SELECT CAST(ts AS DATE) AS day, log_id, floor(length(message) / 4) / 1e6 * 0.02 AS c,
  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY log_id) AS rn FROM logs WHERE {_PRIO}),
b1 AS (SELECT day, CAST(floor((rn - 1) / 50) AS BIGINT) AS batch_no, SUM(c) AS est_cost_usd FROM b0 GROUP BY 1, 2)"""


def _batches(spark, sf_dir):
    lg = R.priority(Tables(spark, sf_dir).logs)
    c = EM.estimate_cost(lg, "message").withColumn("day", F.to_date("ts"))
    c = EM.chunk(c, 50, order_cols=("log_id",), partition_cols=("day",))
    return c.groupBy("day", F.col("request_no").alias("batch_no")).agg(F.sum("cost_usd").alias("est_cost_usd"))


@register("E4", f"""WITH RECURSIVE {_BATCHES},
b AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY batch_no) AS k FROM b1),
r AS (SELECT day, k, batch_no, est_cost_usd <= 0.00002 AS admitted, 0.0::DOUBLE AS spent_before,
        CASE WHEN est_cost_usd <= 0.00002 THEN est_cost_usd ELSE 0.0 END AS spent_after FROM b WHERE k = 1
      UNION ALL
      SELECT b.day, b.k, b.batch_no, r.spent_after + b.est_cost_usd <= 0.00002, r.spent_after,
        CASE WHEN r.spent_after + b.est_cost_usd <= 0.00002 THEN r.spent_after + b.est_cost_usd ELSE r.spent_after END
      FROM r JOIN b ON b.day = r.day AND b.k = r.k + 1)
SELECT day, batch_no, admitted, round(spent_after, 9) AS spent_after, spent_after >= 0.00002 * 0.8 AS warning FROM r""",
          views=("logs",))
def q_e4(spark, sf_dir):
    a = EM.admit(_batches(spark, sf_dir), 0.00002)
    return a.select("day", "batch_no", "admitted", F.round("spent_after", 9).alias("spent_after"), "warning")


@register("E5", f"""SELECT log_id, service, CAST(floor((row_number() OVER (PARTITION BY service ORDER BY log_id) - 1) / 50) AS BIGINT) AS request_no
FROM logs WHERE {_PRIO}""", views=("logs",))
def q_e5(spark, sf_dir):
    lg = R.priority(Tables(spark, sf_dir).logs)
    return EM.chunk(lg, 50, order_cols=("log_id",), partition_cols=("service",)).select("log_id", "service", "request_no")


@register("E6")
def q_e6(spark, sf_dir):
    """Offline hashing embedder over the distinct priority messages (rows-only)."""
    lg = R.priority(Tables(spark, sf_dir).logs)
    texts = lg.select(EM.text_hash("message").alias("text_hash"), F.col("message").alias("text")) \
        .dropDuplicates(["text_hash"])
    return EM.embed(texts, as_of="2024-01-20T00:00:00").drop("text")


@register("E7", f"""WITH spend AS (SELECT CAST(ts AS DATE) AS day, floor(length(message) / 4) / 1e6 * 0.02 AS cost_usd FROM logs WHERE {_PRIO}),
s AS (SELECT day, SUM(cost_usd) AS spent FROM spend GROUP BY day)
SELECT day, round(spent, 9) AS spent_usd, round(greatest(0.0, 0.00005 - spent), 9) AS remaining_usd,
  round(spent / 0.00005 * 100, 6) AS utilisation_pct FROM s""", views=("logs",))
def q_e7(spark, sf_dir):
    lg = EM.estimate_cost(R.priority(Tables(spark, sf_dir).logs), "message").withColumn("day", F.to_date("ts"))
    return EM.budget_stats(lg, 0.00005)


@register("E7_cache", """SELECT COUNT(*) AS entries, CAST(SUM(floor(length(message) / 4)) AS BIGINT) AS tokens,
  round(SUM(floor(length(message) / 4) / 1e6 * 0.02), 9) AS cost_usd
FROM (SELECT DISTINCT message FROM logs WHERE level = 'ERROR')""", views=("logs",))
def q_e7_cache(spark, sf_dir):
    lg = Tables(spark, sf_dir).logs.filter(F.col("level") == "ERROR").select("message").distinct()
    return EM.cache_stats(EM.estimate_cost(lg, "message"))


@register("R1", f"SELECT log_id, level FROM logs WHERE upper(level) IN ('ERROR', 'WARN', 'WARNING', 'CRITICAL', 'FATAL')",
          views=("logs",))
def q_r1(spark, sf_dir):
    return R.priority(Tables(spark, sf_dir).logs).select("log_id", "level")


@register("R3", f"""SELECT log_id, CAST(ts AS DATE) AS day,
  CAST(floor((row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, log_id) - 1) / 50) AS BIGINT) AS batch_no
FROM logs WHERE {_PRIO}""", views=("logs",))
def q_r3(spark, sf_dir):
    """Size-bounded sub-batches (50 rows) of the priority track, numbered per day."""
    lg = R.priority(Tables(spark, sf_dir).logs).withColumn("day", F.to_date("ts"))
    return R.sub_batches(lg, 50, order_cols=("ts", "log_id"), partition_col="day").select("log_id", "day", "batch_no")


@register("R5", f"""WITH z AS ({_zsql(2.0)})
SELECT COUNT(*) AS processed, COUNT(z.log_id) AS embeddings_generated,
  COUNT(*) FILTER (WHERE COALESCE(z.is_anomaly, false)) AS anomalies_detected, CAST(0 AS BIGINT) AS errors
FROM logs l LEFT JOIN z ON z.log_id = l.log_id WHERE l.{_PRIO}""", views=("logs", "vectors"))
def q_r5(spark, sf_dir):
    t = Tables(spark, sf_dir)
    z = A.detect_zscore(t.vectors, None, 2.0).select("log_id", "is_anomaly")
    emb = t.vectors.select("log_id", "embedding")
    b = R.priority(t.logs).select("log_id").join(z, "log_id", "left") \
        .join(emb.select("log_id", F.lit(1).alias("embedding")), "log_id", "left") \
        .withColumn("error", F.lit(None).cast("string"))
    return R.batch_outcome(b)

