"""Registered queries: search (Q*), volume (V*), summaries (A1, A2), backlog."""

from __future__ import annotations

from ..operators import search as S
from ..operators import timeseries as TS
from ..sources.tables import Tables
from .registry import register

# Fixed query parameters (a "now" inside the test data's time range).
AS_OF = "2024-01-15T12:00:00"
RANGE = ("2024-01-01T00:00:00", "2024-01-31T00:00:00")   # whole test-data range


@register("V1", """
SELECT CAST(date_trunc('hour', created_at) + to_minutes(CAST(floor(minute(created_at) / 15) * 15 AS BIGINT)) AS TIMESTAMP) AS bucket_start,
  COUNT(*) AS count,
  COUNT(*) FILTER (WHERE level = 'ERROR') AS error_count,
  COUNT(*) FILTER (WHERE level = 'WARN') AS warn_count,
  COUNT(*) FILTER (WHERE level = 'INFO') AS info_count,
  COUNT(*) FILTER (WHERE level = 'DEBUG') AS debug_count
FROM logs
WHERE created_at >= TIMESTAMP '2024-01-14 12:00:00' AND created_at <= TIMESTAMP '2024-01-15 12:00:00'
GROUP BY 1""", views=("logs",))
def q_v1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return TS.volume_buckets(t.logs, hours=24, bucket_minutes=15, as_of=AS_OF)


_V2_SQL = """
WITH grid AS (
  SELECT CAST(g AS TIMESTAMP) AS bucket_start
  FROM generate_series(TIMESTAMP '2024-01-14 13:00:00', TIMESTAMP '2024-01-15 12:50:30', INTERVAL 20 MINUTE) t(g)
), c AS (
  SELECT date_trunc('hour', created_at) + to_minutes(CAST(floor(minute(created_at) / 20) * 20 AS BIGINT)) AS b,
    COUNT(*) AS n, COUNT(*) FILTER (WHERE level = 'ERROR') AS e, COUNT(*) FILTER (WHERE level = 'WARN') AS w,
    COUNT(*) FILTER (WHERE level = 'INFO') AS i, COUNT(*) FILTER (WHERE level = 'DEBUG') AS d
  FROM logs
  WHERE created_at >= TIMESTAMP '2024-01-14 12:50:30' AND created_at <= TIMESTAMP '2024-01-15 12:50:30'
    AND service ILIKE '%svc-%'
  GROUP BY 1
)
SELECT grid.bucket_start, CAST(COALESCE(n, 0) AS BIGINT) AS count, CAST(COALESCE(e, 0) AS BIGINT) AS error_count,
  CAST(COALESCE(w, 0) AS BIGINT) AS warn_count, CAST(COALESCE(i, 0) AS BIGINT) AS info_count,
  CAST(COALESCE(d, 0) AS BIGINT) AS debug_count
FROM grid LEFT JOIN c ON c.b = grid.bucket_start"""


@register("V2", _V2_SQL, views=("logs",))
def q_v2(spark, sf_dir):
    # as_of with seconds: the first partial bucket (12:40) is dropped, grid starts 13:00.
    t = Tables(spark, sf_dir)
    return TS.log_volume(t.logs, hours=24, bucket_minutes=20, as_of="2024-01-15T12:50:30",
                         service="svc-")


@register("V3", """
SELECT CAST(COUNT(*) AS BIGINT) AS total_logs FROM logs
WHERE ts >= TIMESTAMP '2024-01-14 13:00:00' AND ts <= TIMESTAMP '2024-01-15 12:50:30'
  AND level = 'ERROR'""", views=("logs",))
def q_v3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    vol = TS.log_volume(t.logs, hours=24, bucket_minutes=20, as_of="2024-01-15T12:50:30",
                        level="error", use_ingestion_time=False)
    return TS.volume_total(vol)


@register("Q1", """
SELECT log_id, ts, level, service, message, raw_log, created_at FROM logs
WHERE level = 'ERROR' AND service ILIKE '%SVC-3%' AND ts >= TIMESTAMP '2024-01-03 00:00:00'
  AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND message ILIKE '%PAYMENT%'""", views=("logs",))
def q_q1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.search(t.logs, query="PAYMENT", level="error", service="SVC-3",
                    start_time="2024-01-03T00:00:00Z", end_time="2024-01-20T00:00:00")


@register("Q2", """
SELECT l.log_id, l.level, l.service FROM logs l
WHERE l.log_id IN (SELECT log_id FROM anomalies WHERE is_anomaly = false) AND l.message ILIKE '%user=%'""",
          views=("logs", "anomalies"))
def q_q2(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.search(t.logs, query="user=", is_anomaly=False, anom=t.anomalies) \
        .select("log_id", "level", "service")


_Q3_SQL = """
WITH f AS (SELECT * FROM logs WHERE level = 'WARN'),
page AS (SELECT * FROM f ORDER BY created_at DESC, log_id DESC LIMIT 50 OFFSET 20)
SELECT page.log_id, page.created_at, page.level, page.message,
  (SELECT COUNT(*) FROM f) AS total, (20 + 50) < (SELECT COUNT(*) FROM f) AS has_more
FROM page"""


@register("Q3", _Q3_SQL, views=("logs",))
def q_q3(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.paginate(S.search(t.logs, level="WARN"), limit=50, offset=20) \
        .select("log_id", "created_at", "level", "message", "total", "has_more")


@register("Q4", """
WITH page AS (SELECT * FROM logs WHERE message ILIKE '%handled%' ORDER BY created_at DESC, log_id DESC LIMIT 200)
SELECT page.log_id, page.level, COALESCE(a.is_anomaly, false) AS is_anomaly, a.anomaly_score
FROM page LEFT JOIN anomalies a ON a.log_id = page.log_id""", views=("logs", "anomalies"))
def q_q4(spark, sf_dir):
    t = Tables(spark, sf_dir)
    page = S.paginate(S.search(t.logs, query="handled"), limit=200, offset=0)
    return S.with_anomaly(page, t.anomalies).select("log_id", "level", "is_anomaly", "anomaly_score")


@register("Q6", "SELECT * FROM logs WHERE log_id = 4242", views=("logs",))
def q_q6(spark, sf_dir):
    return S.get_log(Tables(spark, sf_dir).logs, 4242)


@register("Q7", """
SELECT log_id, ts, level, service, substring(message, 1, 200) AS message FROM logs
WHERE message ILIKE '%timeout%' AND level = 'ERROR'
ORDER BY ts DESC, log_id DESC LIMIT 100""", views=("logs",))
def q_q7(spark, sf_dir):
    return S.search_compact(Tables(spark, sf_dir).logs, query="timeout", level="ERROR", limit=100)


@register("Q8", """
SELECT * FROM logs WHERE log_id <> 17 ORDER BY ts DESC, log_id DESC LIMIT 5""", views=("logs",))
def q_q8(spark, sf_dir):
    return S.recent_context(Tables(spark, sf_dir).logs, 17, 5)


@register("Q9", """
WITH j AS (SELECT l.service, l.level, a.cluster_id, COALESCE(a.is_anomaly, false) AS is_anomaly
           FROM logs l LEFT JOIN anomalies a ON a.log_id = l.log_id)
SELECT 'service' AS facet, service AS value, COUNT(*) AS n FROM j GROUP BY service
UNION ALL SELECT 'level', level, COUNT(*) FROM j GROUP BY level
UNION ALL SELECT 'cluster', CAST(cluster_id AS VARCHAR), COUNT(*) FROM j GROUP BY cluster_id
UNION ALL SELECT 'anomaly', CAST(is_anomaly AS VARCHAR), COUNT(*) FROM j GROUP BY is_anomaly""",
          views=("logs", "anomalies"))
def q_q9(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.facets(t.logs, t.anomalies)


_A1_SQL = """
WITH r AS (SELECT * FROM logs WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'
           AND service ILIKE '%svc%'),
lv AS (SELECT level AS key, COUNT(*) AS n FROM r GROUP BY level),
sv AS (SELECT service AS key, COUNT(*) AS n,
         row_number() OVER (ORDER BY COUNT(*) DESC, service) AS rk FROM r GROUP BY service)
SELECT 'total' AS dimension, '' AS key, COUNT(*) AS n FROM r
UNION ALL SELECT 'level', key, n FROM lv
UNION ALL SELECT 'service', key, n FROM sv WHERE rk <= 10
UNION ALL SELECT 'error_count', '', COALESCE(SUM(n) FILTER (WHERE key = 'ERROR'), 0)::BIGINT FROM lv
UNION ALL SELECT 'warning_count', '', COALESCE(SUM(n) FILTER (WHERE key = 'WARN'), 0)::BIGINT FROM lv"""


@register("A1", _A1_SQL, views=("logs",))
def q_a1(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return TS.summarize_range(t.logs, *RANGE, service="svc", max_logs=None)


@register("A1_newest", """
WITH r AS (SELECT * FROM logs WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'
           ORDER BY ts DESC, log_id DESC LIMIT 100),
lv AS (SELECT level AS key, COUNT(*) AS n FROM r GROUP BY level),
sv AS (SELECT service AS key, COUNT(*) AS n,
         row_number() OVER (ORDER BY COUNT(*) DESC, service) AS rk FROM r GROUP BY service)
SELECT 'total' AS dimension, '' AS key, COUNT(*) AS n FROM r
UNION ALL SELECT 'level', key, n FROM lv
UNION ALL SELECT 'service', key, n FROM sv WHERE rk <= 10
UNION ALL SELECT 'error_count', '', COALESCE(SUM(n) FILTER (WHERE key = 'ERROR'), 0)::BIGINT FROM lv
UNION ALL SELECT 'warning_count', '', COALESCE(SUM(n) FILTER (WHERE key = 'WARN'), 0)::BIGINT FROM lv""",
          views=("logs",))
def q_a1_newest(spark, sf_dir):
    # The default summarises the newest 100 rows of the range (the feature's own limit).
    t = Tables(spark, sf_dir)
    return TS.summarize_range(t.logs, *RANGE, max_logs=100)


@register("A1_samples", """
SELECT log_id, ts, level, service, substring(message, 1, 150) AS message FROM logs
WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-31 00:00:00'
ORDER BY ts DESC, log_id DESC LIMIT 5""", views=("logs",))
def q_a1_samples(spark, sf_dir):
    return TS.range_samples(Tables(spark, sf_dir).logs, *RANGE, max_logs=None)


@register("A2", """
WITH m AS (SELECT list_slice(string_split_regex(regexp_replace(substring(lower(message), 1, 100), '^\\s+|\\s+$', '', 'g'), '\\s+'), 1, 10) AS toks
           FROM logs WHERE level = 'ERROR'),
w AS (SELECT unnest(toks) AS word FROM m)
SELECT word, COUNT(*) AS n FROM w WHERE length(word) > 4 GROUP BY word ORDER BY n DESC, word LIMIT 5""",
          views=("logs",))
def q_a2(spark, sf_dir):
    return TS.error_terms(Tables(spark, sf_dir).logs, chars=100, words=10)


@register("A2_whole", """
WITH w AS (SELECT unnest(string_split_regex(regexp_replace(lower(message), '^\\s+|\\s+$', '', 'g'), '\\s+')) AS word
           FROM logs WHERE level = 'ERROR')
SELECT word, COUNT(*) AS n FROM w WHERE length(word) > 4 GROUP BY word ORDER BY n DESC, word LIMIT 5""",
          views=("logs",))
def q_a2_whole(spark, sf_dir):
    return TS.error_terms(Tables(spark, sf_dir).logs)


@register("R4", """
SELECT COUNT(*) AS queue_size,
  CAST(epoch(TIMESTAMP '2024-01-15 12:00:00') - epoch(MIN(ts)) AS BIGINT) AS oldest_age_s
FROM logs WHERE level IN ('ERROR', 'WARN', 'WARNING', 'CRITICAL', 'FATAL')""", views=("logs",))
def q_r4(spark, sf_dir):
    from ..operators.routing import priority
    return TS.backlog_stats(priority(Tables(spark, sf_dir).logs), AS_OF)
