"""Registered queries: log-line sources (SRC3-SRC5), operational counters (A4), result
validation (W1, W2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import quality as W
from ..sources import logfiles as LF
from ..sources.tables import Tables
from . import duck as D
from .registry import register


def _re2(p: str) -> str:
    """Java regex of the collector formats -> RE2 (named groups, needless escapes)."""
    for a, b in (("(?<", "(?P<"), ("\\<", "<"), ("\\>", ">"), ("\\/", "/"), ("\\:", ":"), ('\\"', '"')):
        p = p.replace(a, b)
    return p


def _src3_sql(fmt: str) -> str:
    pat, _ = LF.LINE_FORMATS[fmt]
    rp = D.q(_re2(pat))
    names = LF.group_names(pat)
    lst = "[" + ", ".join(D.q(n) for n in names) + "]"
    cols = ", ".join(f"CASE WHEN matched THEN g.{n} END AS {n}" for n in names)
    body = (f"SELECT line_id, matched, {cols} FROM (SELECT line_id, regexp_matches(line, {rp}) AS matched, "
            f"regexp_extract(line, {rp}, {lst}) AS g FROM log_lines WHERE fmt = {D.q(fmt)})")
    if fmt == "syslog":
        return (f"SELECT *, CAST(try_strptime('1900 ' || regexp_replace(time, ' +', ' ', 'g'), '%Y %b %d %H:%M:%S') AS TIMESTAMP) "
                f"AS time_parsed FROM ({body})")
    if fmt == "nginx":
        return f"SELECT *, CAST(try_strptime(time, '%d/%b/%Y:%H:%M:%S %z') AS TIMESTAMP) AS time_parsed FROM ({body})"
    return body


def _src3(fmt):
    def q(spark, sf_dir):
        lines = Tables(spark, sf_dir).log_lines.filter(F.col("fmt") == fmt)
        return LF.parse_lines(lines, fmt).drop("fmt", "line")
    q.__name__ = f"q_src3_{fmt}"
    return q


for _fmt in LF.LINE_FORMATS:
    register(f"SRC3_{_fmt}", _src3_sql(_fmt), views=("log_lines",))(_src3(_fmt))


_OBJ = D.is_object("value")


def _when_object(text: str) -> str:
    return f"CASE WHEN {_OBJ} THEN {text} END"


def _object_records(spark, sf_dir):
    v = N.parse_record("value")
    is_object = v.isNotNull() & F.schema_of_variant(F.coalesce(v, F.parse_json(F.lit("0")))).startswith("OBJECT")
    return Tables(spark, sf_dir).raw_records.withColumn("_object", is_object)


@register("SRC4", f"""SELECT rec_id, CAST({_when_object("len(json_keys(value))")} AS INTEGER) AS n_fields,
  {_when_object("json_extract_string(value, '$.message')")} AS message,
  {_when_object("CAST(try_strptime(json_extract_string(value, '$.timestamp'), '%Y-%m-%dT%H:%M:%S.%g') AS TIMESTAMP)")} AS time_parsed
FROM raw_records""", views=("raw_records",))
def q_src4(spark, sf_dir):
    """Lines that are no JSON object have no fields, message or time."""
    lines = _object_records(spark, sf_dir).withColumn("line", F.when(F.col("_object"), F.col("value")))
    p = LF.parse_json_lines(lines, "json", time_key="timestamp")
    return p.select("rec_id", F.when(F.col("_object"), F.size("fields")).alias("n_fields"),
                    F.col("fields")["message"].alias("message"), "time_parsed")


@register("SRC5", f"""WITH r AS (SELECT rec_id, {_when_object("json_extract_string(value, '$.tag')")} AS tag,
  {_when_object("json_extract_string(value, '$.service')")} AS service,
  {_when_object("json_extract_string(value, '$.environment')")} AS environment FROM raw_records)
SELECT rec_id, tag, COALESCE(service, CASE WHEN regexp_matches(tag, '^host\\.') THEN 'host'
    WHEN regexp_matches(tag, '^logs\\.') THEN 'fluentbit' END) AS service,
  COALESCE(environment, CASE WHEN regexp_matches(tag, '^docker\\.') THEN 'docker' WHEN regexp_matches(tag, '^host\\.') THEN 'host'
    WHEN regexp_matches(tag, '^logs\\.') THEN 'docker' END) AS environment
FROM r""", views=("raw_records",))
def q_src5(spark, sf_dir):
    r = _object_records(spark, sf_dir)
    fields = [F.when(F.col("_object"), N.vget(N.parse_record("value"), k)).alias(k) for k in ("tag", "service", "environment")]
    return LF.enrich_by_tag(r.select("rec_id", *fields))


@register("A4", "SELECT service, level, COUNT(*) AS n FROM logs GROUP BY service, level", views=("logs",))
def q_a4(spark, sf_dir):
    """Logs processed by (service, level)."""
    return Tables(spark, sf_dir).logs.groupBy("service", "level").agg(F.count(F.lit(1)).alias("n"))


@register("A4_methods", """SELECT detection_method, COUNT(*) FILTER (WHERE is_anomaly) AS anomalies, COUNT(*) AS scored
FROM anomalies GROUP BY detection_method""", views=("anomalies",))
def q_a4_methods(spark, sf_dir):
    a = Tables(spark, sf_dir).anomalies
    return a.groupBy("detection_method").agg(F.count_if("is_anomaly").alias("anomalies"),
                                             F.count(F.lit(1)).alias("scored"))


@register("A4_vectors", """SELECT COUNT(*) AS vectors, COUNT(DISTINCT level) AS levels FROM vectors""", views=("vectors",))
def q_a4_vectors(spark, sf_dir):
    v = Tables(spark, sf_dir).vectors
    return v.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("level").alias("levels"))


@register("A4_usage", """WITH t AS (SELECT message, COUNT(*) AS n, CAST(floor(length(message) / 4) AS BIGINT) AS tokens FROM logs GROUP BY message)
SELECT 'hashing-64' AS embedding_model, CAST(SUM(n) AS BIGINT) AS texts, CAST(SUM(n) - COUNT(*) AS BIGINT) AS cache_hits,
  CAST(SUM(tokens) AS BIGINT) AS tokens, round(SUM(tokens / 1e6 * 0.02), 9) AS cost_usd FROM t""", views=("logs",))
def q_a4_usage(spark, sf_dir):
    """Every log message embedded once: repeats are cache hits."""
    from ..operators import embed as EM
    texts = Tables(spark, sf_dir).logs.groupBy(F.col("message").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    used = EM.estimate_cost(texts).select(
        F.lit("hashing-64").alias("embedding_model"), F.col("tokens").alias("embedding_tokens"),
        F.col("cost_usd").alias("embedding_cost_usd"),
        F.explode(F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("n")), lambda i: i > 1)).alias("embedding_cached"))
    return EM.usage_by_model(used)


_W_T = """(CASE WHEN json_type(e, '$.{k}') = 'VARCHAR' AND json_extract_string(e, '$.{k}') <> '' THEN json_extract_string(e, '$.{k}') ELSE {d} END)"""


@register("W1", f"""WITH p AS (SELECT page_id, CASE WHEN json_type(body, '$.results') = 'ARRAY' THEN json_extract(body, '$.results[*]')
                           WHEN json_type(body, '$.logs') = 'ARRAY' THEN json_extract(body, '$.logs[*]') END AS arr
                    FROM api_pages WHERE json_type(body) = 'OBJECT'),
x AS (SELECT page_id, unnest(arr) AS e, generate_subscripts(arr, 1) - 1 AS idx FROM p WHERE arr IS NOT NULL)
SELECT page_id, CAST(idx AS INTEGER) AS idx, {_W_T.format(k='id', d="'unknown-' || CAST(idx AS VARCHAR)")} AS id,
  {_W_T.format(k='timestamp', d="'2024-01-20T00:00:00'")} AS timestamp, {_W_T.format(k='level', d="'INFO'")} AS level,
  {_W_T.format(k='service', d="'unknown'")} AS service, {_W_T.format(k='message', d="''")} AS message,
  CASE WHEN json_type(e, '$.is_anomaly') = 'BOOLEAN' THEN CAST(json_extract_string(e, '$.is_anomaly') AS BOOLEAN) END AS is_anomaly,
  CASE WHEN json_type(e, '$.cluster_id') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(e, '$.cluster_id') AS DOUBLE) END AS cluster_id,
  CASE WHEN json_type(e, '$.anomaly_score') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string(e, '$.anomaly_score') AS DOUBLE) END AS anomaly_score,
  CASE WHEN json_type(e, '$.metadata') IN ('OBJECT', 'ARRAY') THEN CAST(json_extract(e, '$.metadata') AS VARCHAR) END AS metadata,
  {_W_T.format(k='redacted_message', d='NULL')} AS redacted_message, {_W_T.format(k='llm_reasoning', d='NULL')} AS llm_reasoning,
  {_W_T.format(k='detection_method', d='NULL')} AS detection_method, {_W_T.format(k='created_at', d='NULL')} AS created_at,
  CASE WHEN json_type(e, '$.llm_validated') = 'BOOLEAN' THEN CAST(json_extract_string(e, '$.llm_validated') AS BOOLEAN) END AS llm_validated,
  CASE WHEN json_type(e, '$.pii_redacted') = 'BOOLEAN' THEN CAST(json_extract_string(e, '$.pii_redacted') AS BOOLEAN) END AS pii_redacted,
  CASE WHEN json_extract_string(e, '$.hybrid_tier') IN ('tier1', 'tier2') THEN json_extract_string(e, '$.hybrid_tier') END AS hybrid_tier,
  CASE WHEN json_type(e, '$.pii_entities_detected') IN ('OBJECT', 'ARRAY') THEN CAST(json_extract(e, '$.pii_entities_detected') AS VARCHAR) END AS pii_entities_detected
FROM x WHERE json_type(e) = 'OBJECT'""", views=("api_pages",))
def q_w1(spark, sf_dir):
    return W.repair_rows(Tables(spark, sf_dir).api_pages, as_of="2024-01-20T00:00:00")


@register("W2", """WITH p AS (SELECT page_id, body, json_type(body) AS top FROM api_pages),
i AS (
  SELECT page_id, 'Missing required field: ' || f AS issue FROM p, (SELECT unnest(['results', 'total', 'limit', 'offset']) AS f)
    WHERE top IN ('OBJECT', 'ARRAY') AND json_type(body, '$.' || f) IS NULL
  UNION ALL SELECT page_id, 'Found "logs" field instead of expected "results" field' FROM p
    WHERE top IN ('OBJECT', 'ARRAY') AND json_type(body, '$.results') IS NULL AND json_type(body, '$.logs') IS NOT NULL
  UNION ALL SELECT page_id, 'Field "results" should be array, got ' || CASE json_type(body, '$.results') WHEN 'VARCHAR' THEN 'string'
      WHEN 'BIGINT' THEN 'number' WHEN 'UBIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'object' END
    FROM p WHERE top IN ('OBJECT', 'ARRAY') AND json_type(body, '$.results') IS NOT NULL AND json_type(body, '$.results') <> 'ARRAY')
SELECT issue, COUNT(*) AS n FROM i GROUP BY issue""", views=("api_pages",))
def q_w2(spark, sf_dir):
    return W.issue_counts(W.validate_structure(Tables(spark, sf_dir).api_pages))
