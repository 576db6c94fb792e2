"""Registered queries: normalisation (N1-N12) and log-line parsers (SRC3-SRC5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators.normalize import normalize_records, split_rejected
from ..operators.partitioning import deal
from ..sources.tables import Tables
from . import duck as D
from .registry import register

AS_OF = "2024-01-20 00:00:00"
V = "value"
OBJ = D.is_object(V)


def _is_object():
    v = N.parse_record(V)
    return v.isNotNull() & F.schema_of_variant(F.coalesce(v, F.parse_json(F.lit("0")))).startswith("OBJECT")


def _told(df, *names):
    """``rec_id`` and the columns, NULL for records that are no JSON object."""
    return df.select("rec_id", *[F.when(F.col("_object"), F.col(n)).alias(n) for n in names])


def _records(spark, sf_dir):
    return Tables(spark, sf_dir).raw_records.withColumn("_object", _is_object())


_RECS = f"recs AS (SELECT * FROM raw_records WHERE {OBJ})"


@register("N1", f"""WITH {_RECS}, {D.message_ctes('recs')}
SELECT r.rec_id, m.message FROM raw_records r LEFT JOIN msg m ON m.rec_id = r.rec_id""", views=("raw_records",))
def q_n1(spark, sf_dir):
    return _told(N.with_message(_records(spark, sf_dir), "value", "message"), "message")


@register("N2", f"SELECT rec_id, CASE WHEN {OBJ} THEN {D.service_name(V)} END AS service_name FROM raw_records",
          views=("raw_records",))
def q_n2(spark, sf_dir):
    return _told(_records(spark, sf_dir).withColumn("service_name", N.extract_service_name("value")), "service_name")


@register("N3", f"SELECT rec_id, CASE WHEN {OBJ} THEN {D.pick_ts(V)} END AS ts_text FROM raw_records",
          views=("raw_records",))
def q_n3(spark, sf_dir):
    return _told(_records(spark, sf_dir).withColumn("ts_text", N.pick_timestamp("value")), "ts_text")


@register("N4", f"""SELECT rec_id, CASE WHEN {OBJ} AND {D.ts_is_string(V)} THEN {D.parse_ts(D.pick_ts(V))} END AS parsed_ts
FROM raw_records""", views=("raw_records",))
def q_n4(spark, sf_dir):
    return _told(N.with_timestamp_field(_records(spark, sf_dir), "value", "parsed_ts"), "parsed_ts")


_N5_TS = f"CASE WHEN {D.ts_is_string(V)} THEN {D.parse_ts(D.pick_ts(V))} END"


@register("N5", f"""WITH {_RECS}, {D.message_ctes('recs')},
t AS (SELECT rec_id, {D.resolve_ts(_N5_TS, 'message', AS_OF)} AS resolved_ts FROM msg)
SELECT r.rec_id, t.resolved_ts FROM raw_records r LEFT JOIN t ON t.rec_id = r.rec_id""", views=("raw_records",))
def q_n5(spark, sf_dir):
    # The normaliser's probe-once path (unused columns such as the redacted message are pruned).
    out = normalize_records(_records(spark, sf_dir), as_of=AS_OF, id_cols=["rec_id"])
    return _told(out.withColumnRenamed("timestamp", "resolved_ts"), "resolved_ts")


@register("N6", f"SELECT line_id, {D.resolve_level('message', 'NULL', 'level')} AS resolved_level FROM raw_lines",
          views=("raw_lines",))
def q_n6(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.raw_lines.select("line_id", N.resolve_level("message", None, F.col("level")).alias("resolved_level"))


@register("N7", f"SELECT line_id, {D.stack_trace('message')} AS is_stack_trace FROM raw_lines",
          views=("raw_lines",))
def q_n7(spark, sf_dir):
    return Tables(spark, sf_dir).raw_lines.select("line_id", N.is_stack_trace("message").alias("is_stack_trace"))


@register("N8", f"SELECT line_id, {D.http_level('message')} AS http_level FROM raw_lines",
          views=("raw_lines",))
def q_n8(spark, sf_dir):
    return Tables(spark, sf_dir).raw_lines.select("line_id", N.level_from_http("message").alias("http_level"))


@register("N9", f"SELECT line_id, {D.resolve_service('message', 'NULL', 'log_type', 'service')} AS resolved_service FROM raw_lines",
          views=("raw_lines",))
def q_n9(spark, sf_dir):
    return Tables(spark, sf_dir).raw_lines.select(
        "line_id", N.resolve_service("message", None, F.col("log_type"), F.col("service")).alias("resolved_service"))


_N10_SQL = f"""
WITH r AS (SELECT line_id, {D.resolve_level('message', 'NULL', 'level')} AS lv,
                  {D.resolve_service('message', 'NULL', 'log_type', 'service')} AS sv, log_type FROM raw_lines)
SELECT line_id, 'extracted_level' AS key, lv AS value FROM r
UNION ALL SELECT line_id, 'extracted_service', sv FROM r
UNION ALL SELECT line_id, 'log_type', COALESCE(log_type, 'unknown') FROM r
UNION ALL SELECT line_id, 'source', 'raw_lines' FROM r"""


@register("N10", _N10_SQL, views=("raw_lines",))
def q_n10(spark, sf_dir):
    t = Tables(spark, sf_dir).raw_lines
    lv = N.resolve_level("message", None, F.col("level"))
    sv = N.resolve_service("message", None, F.col("log_type"), F.col("service"))
    base = F.create_map(F.lit("source"), F.lit("raw_lines"), F.lit("log_type"), F.lit("overwritten"))
    m = N.merge_metadata(base, lv, sv, F.col("log_type"))
    return t.select("line_id", F.explode(m).alias("key", "value"))


_META_T = "json_type(value, '$.metadata')"
_META_LEVEL = f"CASE WHEN {_META_T} = 'OBJECT' THEN json_extract_string(value, '$.metadata.level') END"
_META_SVC = f"CASE WHEN {_META_T} = 'OBJECT' THEN json_extract_string(value, '$.metadata.service') END"
_SVC_KEY = D.jfirst_key(V, ["container_name", "service", "tag"])
_SVC = f"COALESCE(NULLIF({D.service_name(V)}, ''), json_extract_string(value, '$.service'))"
_STR_OR_NULL = "(json_type(value, '$.{k}') IS NULL OR json_type(value, '$.{k}') IN ('NULL', 'VARCHAR'))"
_N11_SQL = f"""
WITH r AS (
  SELECT rec_id, value,
    CASE WHEN NOT COALESCE(json_valid(value), false) THEN 'invalid_json'
         WHEN NOT {OBJ} THEN 'not_object'
         WHEN NOT {_STR_OR_NULL.format(k='level')} THEN 'level_type'
         WHEN {_SVC_KEY} = 'container_name' AND json_type(value, '$.container_name') <> 'VARCHAR' THEN 'service_type'
         WHEN {_SVC_KEY} = 'service' AND json_type(value, '$.service') <> 'VARCHAR' THEN 'service_type'
         WHEN {_SVC_KEY} = 'tag' AND json_type(value, '$.tag') <> 'VARCHAR' THEN 'service_type'
         WHEN {_SVC_KEY} IS NULL AND NOT {_STR_OR_NULL.format(k='service')} THEN 'service_type'
         WHEN {_META_T} IS NOT NULL AND {_META_T} <> 'OBJECT' THEN 'metadata_type'
         WHEN NOT {_STR_OR_NULL.format(k='log_type')} THEN 'log_type_type' END AS reject_reason
  FROM raw_records),
ok AS (SELECT * FROM r WHERE reject_reason IS NULL),
{D.message_ctes('ok')},
{D.pii_ctes('msg', 'message')}
SELECT rec_id, reject_reason,
  {D.resolve_ts(_N5_TS, 'message', AS_OF)} AS timestamp,
  {D.resolve_level('message', _META_LEVEL, "json_extract_string(value, '$.level')")} AS level,
  {D.resolve_service('message', _META_SVC, "json_extract_string(value, '$.log_type')", _SVC)} AS service,
  redacted AS message,
  (n_ip + n_uuid + n_host + n_email + n_card) > 0 AS pii_redacted
FROM pii
UNION ALL
SELECT rec_id, reject_reason, NULL, NULL, NULL, NULL, NULL FROM r WHERE reject_reason IS NOT NULL"""


@register("N11", _N11_SQL, views=("raw_records",))
def q_n11(spark, sf_dir):
    t = Tables(spark, sf_dir)
    out = normalize_records(deal(t.raw_records), as_of=AS_OF, id_cols=["rec_id"])
    ok = F.col("reject_reason").isNull()
    return out.select("rec_id", "reject_reason",
                      *[F.when(ok, F.col(c)).alias(c) for c in
                        ["timestamp", "level", "service", "message", "pii_redacted"]])


@register("N11_rejects", None)
def q_n11_rejects(spark, sf_dir):
    """Quarantine output of N11 (rows-only: the reasons are checked in N11 itself)."""
    t = Tables(spark, sf_dir)
    _, rejected = split_rejected(normalize_records(deal(t.raw_records), as_of=AS_OF, id_cols=["rec_id"]))
    return rejected.select("rec_id", "reject_reason", "raw_log")


@register("N12", "SELECT log_id, substring(message, 1, 20) AS short_message FROM logs", views=("logs",))
def q_n12(spark, sf_dir):
    return Tables(spark, sf_dir).logs.select("log_id", N.truncate("message", 20).alias("short_message"))
