"""Base tables and the derived log-shaped views.

The test tables hold no log lines, so log-shaped tables are derived with SQL that runs
unchanged in Spark and in DuckDB (FIXTURES.md, part A).  The same text is used to register
Spark temp views and to build the DuckDB oracle CTEs, so both engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

# Derived views: name -> (dependencies, SELECT text).  Order matters for registration.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "logs": (("events",), """
SELECT event_id AS log_id, ts,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG'
       WHEN 'click' THEN 'INFO' ELSE CASE WHEN event_id % 5 = 0 THEN 'FATAL' ELSE 'INFO' END END AS level,
  CONCAT('svc-', CAST(user_id % 8 AS STRING)) AS service,
  CONCAT(CASE event_type WHEN 'error' THEN 'Timeout while calling upstream payment handler'
       WHEN 'signup' THEN 'Slow account creation' ELSE CONCAT('handled ', event_type) END,
       ' user=', CAST(user_id AS STRING), ' k=', regexp_extract(props, '([0-9]+)', 1)) AS message,
  props AS raw_log,
  ts + INTERVAL '1' SECOND * (event_id % 97) AS created_at
FROM events"""),
    "vectors": (("embeddings", "logs"), """
SELECT e.vec_id AS log_id, e.embedding, l.level, l.service, l.ts
FROM embeddings e LEFT JOIN logs l ON l.log_id = e.vec_id"""),
    "assignments": (("embeddings",), """
SELECT vec_id AS log_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_id FROM embeddings"""),
    "anomalies": (("assignments",), """
SELECT a.log_id, CAST(a.log_id % 100 AS DOUBLE) / 100 AS anomaly_score, (a.log_id % 100 >= 70) AS is_anomaly,
  'HDBSCAN' AS detection_method, a.cluster_id,
  CASE WHEN a.log_id % 3 = 0 THEN 'looks unusual' END AS llm_reasoning
FROM assignments a"""),
    "raw_lines": (("events",), """
SELECT event_id AS line_id, CASE event_id % 16
  WHEN 0 THEN 'ERROR:db:connection lost' WHEN 1 THEN 'warning: disk nearly full' WHEN 2 THEN '[INFO] started service=api'
  WHEN 3 THEN 'DEBUG - cache miss app: web,' WHEN 4 THEN '2024-01-15 10:30:45 ERROR boom'
  WHEN 5 THEN '2024-01-15T10:30:45 WARN slow' WHEN 6 THEN 'GET /x HTTP/1.1" 503 12' WHEN 7 THEN 'GET /y HTTP/1.1" 404 9'
  WHEN 8 THEN 'GET /z HTTP/1.1" 200 77' WHEN 9 THEN 'Traceback (most recent call last):'
  WHEN 10 THEN 'ValueError: bad input' WHEN 11 THEN 'nginx upstream ready' WHEN 12 THEN 'postgres checkpoint done'
  WHEN 13 THEN 'kafka rebalance' WHEN 14 THEN 'no error here, just text' ELSE '[CRITICAL] out of memory component=core' END AS message,
  CASE WHEN event_id % 11 = 0 THEN 'warning' WHEN event_id % 13 = 0 THEN 'trace' END AS level,
  CASE WHEN event_id % 7 = 0 THEN 'billing' END AS service,
  CASE WHEN event_id % 3 = 0 THEN 'json' END AS log_type
FROM events"""),
    "stream_lines": (("events",), """
SELECT event_id AS seq, CONCAT('svc-', CAST(user_id % 8 AS STRING)) AS src,
  event_id * 100 + CAST(floor(event_id / 40) AS BIGINT) * 1500 AS arrival_ms,
  CASE event_id % 9 WHEN 0 THEN 'Traceback (most recent call last):' WHEN 1 THEN '  File "a.py", line 3'
  WHEN 2 THEN '    raise ValueError(x)' WHEN 3 THEN 'ValueError: bad' WHEN 4 THEN 'INFO:app:ok'
  WHEN 5 THEN 'plain text' WHEN 6 THEN 'ERROR:app:failed' WHEN 7 THEN '' ELSE '2024-01-15 10:30:45 tick' END AS line
FROM events"""),
    "pii_lines": (("events",), """
SELECT event_id AS line_id, CONCAT('client 10.', CAST(user_id % 256 AS STRING), '.0.', CAST(event_id % 256 AS STRING),
  CASE WHEN event_id % 2 = 0 THEN ':8080' ELSE '' END,
  CASE WHEN event_id % 3 = 0 THEN ' id 123e4567-e89b-12d3-a456-426614174000' ELSE '' END,
  CASE WHEN event_id % 4 = 0 THEN ' host x1.Qdrant.io:6333' ELSE '' END,
  CASE WHEN event_id % 5 = 0 THEN CONCAT(' mail u', CAST(user_id AS STRING), '@example.com') ELSE '' END,
  CASE WHEN event_id % 7 = 0 THEN ' kernel: [ 12.5] oom pid=3' ELSE '' END,
  CASE WHEN event_id % 6 = 0 THEN ' card 4532015112830366' ELSE '' END) AS text
FROM events"""),
}


# Raw JSON log records for the normaliser (N1-N11, SRC4): one template per rule and trap of
# SURVEY §2.2 (nested messages, key order, year-less and offset timestamps, epochs, wrong-typed
# fields, metadata, container names and docker tags).  ``{u}`` is the event's user id.
RAW_RECORD_TEMPLATES = [
    '{"message": "Timeout user={u}", "level": "error", "timestamp": "2024-01-15T10:30:45.123", "service": "billing"}',
    '{"log": "INFO:app:started {u}\\n", "container_name": "/ai-log-backend", "container_id": "abcdef1234567890", "time": "2024-01-15 10:31:00"}',
    '{"msg": "", "text": "fallback text {u}", "@timestamp": "2024-01-15T10:30:45Z"}',
    '{"message": "{\\"message\\": \\"nested hello service=inner{u}\\", \\"level\\": \\"warn\\"}", "tag": "docker.web"}',
    '{"message": "{\\"log\\": \\"inner log line {u}\\"}", "tag": "host.x"}',
    '{"message": "{\\"other\\": {u}}", "level": "WARNING"}',
    '{"message": "Jan 15 10:30:45 host sshd[{u}]: accepted", "timestamp": "Jan 15 10:30:45", "log_type": "syslog"}',
    '{"message": "2024-01-15 09:00:00 WARN disk {u}", "metadata": {"level": "debug", "service": "meta-svc", "n": {u}}}',
    '{"message": "GET /a HTTP/1.1\\" 502 {u}", "timestamp": 1705312245.5, "level": ""}',
    '{"text": "ERROR: Database connection failed {u}", "level": 5}',
    '{"message": "plain message app=shop{u}", "metadata": "notadict"}',
    '{"message": "User u{u}@example.com from 10.0.0.{u}:443 at 2024-01-16T08:00:00", "service": "api", "log_type": "json", "date": "2024-01-15T10:30:45+02:00"}',
    '{"message": "Traceback (most recent call last):\\n  File \\"x.py\\", line {u}", "container_name": "worker", "metadata": {"level": "TRACE"}}',
    '{"log": "kafka consumer lag {u}", "log_type": null, "metadata": null}',
    '{"message": "[CRITICAL] out of memory component=core{u}", "level": "critical", "time": "2024-01-15T10:30:45"}',
    '[1, 2, {u}]',
]


def _sql_literal(text: str, dialect: str) -> str:
    if dialect == "spark":
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "'" + text.replace("'", "''") + "'"


def raw_records_sql(dialect: str) -> str:
    whens = []
    for i, t in enumerate(RAW_RECORD_TEMPLATES):
        parts = t.split("{u}")
        pieces = []
        for j, part in enumerate(parts):
            if part:
                pieces.append(_sql_literal(part, dialect))
            if j < len(parts) - 1:
                pieces.append("CAST(user_id AS STRING)")
        whens.append(f"WHEN {i} THEN CONCAT({', '.join(pieces)})")
    n = len(RAW_RECORD_TEMPLATES)
    return (f"SELECT event_id AS rec_id, CASE event_id % {n} " + " ".join(whens[:-1])
            + f" ELSE CONCAT({', '.join(_pieces_else(dialect))}) END AS value FROM events")


def _pieces_else(dialect: str) -> list[str]:
    parts = RAW_RECORD_TEMPLATES[-1].split("{u}")
    out = []
    for j, part in enumerate(parts):
        if part:
            out.append(_sql_literal(part, dialect))
        if j < len(parts) - 1:
            out.append("CAST(user_id AS STRING)")
    return out


VIEWS["raw_records"] = (("events",), raw_records_sql)

# Collector-format log lines (SRC3): syslog, nginx access and python logging lines built
# from the logs view.
VIEWS["log_lines"] = (("logs",), """
SELECT log_id AS line_id, 'syslog' AS fmt, CONCAT('<', CAST(log_id % 192 AS STRING), '>Jan ', lpad(CAST(day(ts) AS STRING), 2, ' '), ' ',
  lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), ':', lpad(CAST(CAST(floor(second(ts)) AS INT) AS STRING), 2, '0'),
  ' host', CAST(log_id % 5 AS STRING), ' ', service, '[', CAST(log_id AS STRING), ']: ', message) AS line FROM logs
UNION ALL
SELECT log_id, 'nginx', CONCAT('10.0.', CAST(log_id % 7 AS STRING), '.', CAST(log_id % 250 AS STRING), ' - - [', lpad(CAST(day(ts) AS STRING), 2, '0'),
  '/Jan/2024:', lpad(CAST(hour(ts) AS STRING), 2, '0'), ':', lpad(CAST(minute(ts) AS STRING), 2, '0'), ':',
  lpad(CAST(CAST(floor(second(ts)) AS INT) AS STRING), 2, '0'), ' +0000] "GET /api/', service, ' HTTP/1.1" ',
  CASE level WHEN 'ERROR' THEN '500' WHEN 'WARN' THEN '404' ELSE '200' END, ' ', CAST(length(message) AS STRING),
  CASE WHEN level = 'DEBUG' THEN '' ELSE ' "-" "curl/8.0"' END) FROM logs
UNION ALL
SELECT log_id, 'python', CONCAT(CASE level WHEN 'WARN' THEN 'WARNING' WHEN 'FATAL' THEN 'CRITICAL' ELSE level END, ':', service, ':', message)
FROM logs""")

# Model outputs for the triage parsers (T4, T5, T9): valid, partial and invalid JSON answers.
VIEWS["verdicts"] = (("vectors",), """
SELECT log_id, CASE WHEN log_id % 4 = 0 THEN 'not json'
  WHEN log_id % 4 = 1 THEN CONCAT('{"is_anomaly": true, "confidence": 0.', CAST(log_id % 10 AS STRING), ', "reasoning": "burst on ', service, '"}')
  WHEN log_id % 4 = 2 THEN '{"is_anomaly": false}'
  ELSE CONCAT('{"confidence": "0.9", "reasoning": "level ', level, '"}') END AS response
FROM vectors""")
VIEWS["root_causes"] = (("vectors",), """
SELECT log_id, CASE WHEN log_id % 3 = 0 THEN '{bad'
  WHEN log_id % 3 = 1 THEN CONCAT('{"explanation": "spike in ', service, '", "root_causes": [{"hypothesis": "pool exhausted", "confidence": 0.8, "description": "too many connections"}, {"hypothesis": "slow db"}], "remediation_steps": [{"step": "raise pool", "priority": "HIGH", "description": "double it"}, {"step": "add index"}], "severity": "HIGH", "severity_reason": "payments affected"}')
  ELSE '{"explanation": "minor", "severity_reason": "none"}' END AS response
FROM vectors""")


# Search-response pages (W1, W2): JSON bodies of <= 100 rows each, with wrong-typed fields,
# non-object elements, a "logs" page instead of "results" and a non-array page.
_API_ROW = """CONCAT('{"id": ', CASE WHEN log_id % 11 = 0 THEN 'null' ELSE CONCAT('"', CAST(log_id AS STRING), '"') END,
  ', "level": ', CASE WHEN log_id % 7 = 0 THEN '123' ELSE CONCAT('"', level, '"') END,
  ', "service": "', service, '", "message": "', message, '", "timestamp": ',
  CASE WHEN log_id % 5 = 0 THEN 'null' ELSE '"2024-01-15T00:00:00"' END,
  ', "is_anomaly": ', CASE WHEN log_id % 3 = 0 THEN 'true' ELSE '"no"' END,
  ', "cluster_id": ', CASE WHEN log_id % 2 = 0 THEN CAST(log_id % 9 AS STRING) ELSE '"x"' END,
  CASE WHEN log_id % 4 = 1 THEN ', "anomaly_score": 0.25, "detection_method": "iqr", "hybrid_tier": "tier2", "llm_validated": true, "metadata": {"a":"b"}'
       WHEN log_id % 4 = 2 THEN ', "anomaly_score": "high", "detection_method": "", "hybrid_tier": "tier9", "llm_validated": "yes", "metadata": "none"'
       WHEN log_id % 4 = 3 THEN ', "redacted_message": "[EMAIL]", "llm_reasoning": "rare", "created_at": "2024-01-16T00:00:00", "pii_redacted": false, "pii_entities_detected": {"EMAIL_ADDRESS":2}'
       ELSE '' END, '}')"""


def api_pages_sql(dialect: str) -> str:
    elem = f"CASE WHEN log_id % 13 = 0 THEN '42' ELSE {_API_ROW} END"
    if dialect == "spark":
        agg = "array_join(transform(array_sort(collect_list(struct(log_id, e))), x -> x.e), ', ')"
    else:
        agg = "string_agg(e, ', ' ORDER BY log_id)"
    return f"""
SELECT page_id, CASE
  WHEN page_id % 10 = 3 THEN CONCAT('{{"logs": [', body, '], "total": ', CAST(n AS STRING), ', "limit": 100, "offset": 0}}')
  WHEN page_id % 10 = 7 THEN '{{"results": "oops", "total": "many", "limit": 100}}'
  WHEN page_id % 10 = 9 THEN '[1, 2]'
  ELSE CONCAT('{{"results": [', body, '], "total": ', CAST(n AS STRING), ', "limit": 100, "offset": 0}}') END AS body
FROM (SELECT CAST(floor(log_id / 100) AS BIGINT) AS page_id, {agg} AS body, COUNT(*) AS n
      FROM (SELECT log_id, {elem} AS e FROM logs) GROUP BY CAST(floor(log_id / 100) AS BIGINT))"""


VIEWS["api_pages"] = (("logs",), api_pages_sql)


def view_sql(name: str, dialect: str) -> str:
    sql = VIEWS[name][1]
    return sql(dialect) if callable(sql) else sql


#: The session setting that names the folder whose tables are registered.
REGISTERED = "spark.logweave.tables"


def register_tables(spark: SparkSession, sf_dir: str, force: bool = False) -> None:
    """Register the base parquet tables and the derived views as session temp views
    (once per session and scale directory)."""
    if not force and spark.conf.get(REGISTERED, "") == sf_dir and spark.catalog.tableExists("logs"):
        return
    spark.conf.set(REGISTERED, sf_dir)
    # The log tables carry naive UTC datetimes; bucketing casts go through the session zone.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    for name in BASE_TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name in VIEWS:
        spark.sql(view_sql(name, "spark")).createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One base table or derived view, freshly resolved against ``sf_dir``."""
    register_tables(spark, sf_dir)
    return spark.table(name)


class Tables:
    """Attribute access to the tables of one scale factor: ``t = Tables(spark, d); t.logs``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        register_tables(spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES or name in VIEWS:
            register_tables(self.spark, self.sf_dir)  # another folder may have been registered since
            return self.spark.table(name)
        raise AttributeError(name)


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs (and their dependencies) a DuckDB oracle needs."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in VIEWS and n not in order:
            for d in VIEWS[n][0]:
                visit(d)
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({view_sql(n, 'duckdb')}\n)" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
