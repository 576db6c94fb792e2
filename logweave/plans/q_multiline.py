"""Registered queries: multi-line assembly (M1, M2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import multiline as ML
from ..operators import raw_lines as RL
from ..sources.tables import Tables
from . import duck as D
from .registry import register

_NEW = D.q(D.alt(ML.NEW_ENTRY_PATTERNS))
_CONT = D.q(D.alt(ML.CONTINUATION_PATTERNS))
_ERR = D.q("(?m)" + D.alt(ML.ERROR_INDICATORS))
_OPEN = D.q(ML.OPENER_START)
_L = """l AS (SELECT src AS k, arrival_ms AS t, seq AS q, regexp_replace(line, '\\n+$', '') AS line FROM stream_lines
        WHERE line IS NOT NULL AND regexp_replace(line, '\\n+$', '') <> '')"""


@register("M1", f"""WITH {_L}
SELECT q AS seq, regexp_matches(line, {_NEW}) AS is_new_entry, regexp_matches(line, {_CONT}) AS is_continuation,
  contains(line, {D.q(ML.TRACEBACK_TEXT)}) AS is_traceback, regexp_matches(line, {_ERR}) AS has_error,
  (regexp_matches(line, {_ERR}) OR contains(line, {D.q(ML.TRACEBACK_TEXT)}) OR regexp_matches(line, {_OPEN})) AS is_opener
FROM l""", views=("stream_lines",))
def q_m1(spark, sf_dir):
    t = Tables(spark, sf_dir).stream_lines
    df = t.select("seq", ML.strip_line(t["line"]).alias("line")).filter("line <> ''")
    return ML.classify_lines(df).drop("line")


_M2 = f"""WITH {_L},
c AS (SELECT *, regexp_matches(line, {_NEW}) AS is_new, regexp_matches(line, {_CONT}) AS is_cont,
        contains(line, {D.q(ML.TRACEBACK_TEXT)}) AS tb, regexp_matches(line, {_ERR}) AS err, regexp_matches(line, {_OPEN}) AS op0,
        row_number() OVER (PARTITION BY k ORDER BY t, q) AS rn, lag(t) OVER (PARTITION BY k ORDER BY t, q) AS pt FROM l),
h AS (SELECT *, (err OR tb OR op0) AS opener, (tb OR (is_new AND NOT is_cont) OR pt IS NULL OR t - pt > 2000) AS hard FROM c),
s AS (SELECT *, SUM(CASE WHEN hard THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY rn ROWS UNBOUNDED PRECEDING) AS seg FROM h),
f AS (SELECT *, MIN(CASE WHEN opener THEN rn END) OVER (PARTITION BY k, seg) AS fo FROM s),
g AS (SELECT k, array_to_string(list(line ORDER BY rn), chr(10)) AS message, arg_min(q, rn) AS first_seq,
        arg_min(t, rn) AS start_ms, arg_max(t, rn) AS end_ms, count(*) AS line_count
      FROM f WHERE fo IS NOT NULL AND rn >= fo GROUP BY k, seg)
SELECT k AS src, first_seq, start_ms, end_ms, message, line_count, true AS aggregated,
  regexp_matches(message, {_ERR}) AS detected_error, CASE WHEN regexp_matches(message, {_ERR}) THEN 'ERROR' END AS level FROM g
UNION ALL
SELECT k, q, t, t, line, 1, false, false, NULL FROM f WHERE fo IS NULL OR rn < fo"""


@register("M2", _M2, views=("stream_lines",))
def q_m2(spark, sf_dir):
    """Whole-table batch assembly (groups in this fixture stay under the 100-line cap; the cap
    path is tested against the sequential simulation in tests/)."""
    return ML.assemble_multiline(Tables(spark, sf_dir).stream_lines)


@register("M2_small_buckets", _M2, views=("stream_lines",))
def q_m2_small_buckets(spark, sf_dir):
    """Same result with 10-second row buckets: exercises every cross-bucket carry."""
    return ML.assemble_multiline(Tables(spark, sf_dir).stream_lines, bucket_ms=10_000)


_RECORDS = f"""SELECT concat(src, ':abcdefabcdef') AS src, first_seq,
  line_count, aggregated, message, CASE WHEN detected_error THEN 'ERROR' ELSE 'INFO' END AS level, first_seq * 10 AS n FROM ({_M2})"""


@register("M2_records", _RECORDS, views=("stream_lines",))
def q_m2_records(spark, sf_dir):
    """Raw records to assembled records: key, line and carried fields; each told from the record's JSON."""
    lines = Tables(spark, sf_dir).stream_lines
    raw = lines.select("seq", "arrival_ms", F.to_json(F.struct(
        F.col("line").alias("log"), F.col("src").alias("container_name"), F.lit("abcdefabcdef0123").alias("container_id"),
        F.lit("INFO").alias("level"), F.struct((F.col("seq") * 10).alias("n")).alias("kubernetes"))).alias("value"))
    out = RL.assemble_records(raw)
    return out.select("src", "first_seq", "line_count", "aggregated", F.get_json_object("value", "$.log").alias("message"),
                      F.get_json_object("value", "$.level").alias("level"),
                      F.get_json_object("value", "$.kubernetes.n").cast("bigint").alias("n"))
