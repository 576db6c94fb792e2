"""Registered queries: streams run to their end (``availableNow``) over derived log tables, and sinks read back
(M3 with M4, R2, SRC1, SRC2, SNK1, SNK2, V4).

Input files, checkpoints and results are below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import PRIORITY_LEVELS
from ..session import ensure_checkpoint_dir
from ..sources import sinks
from ..sources.logfiles import read_log_files, read_raw_stream
from ..sources.tables import Tables
from ..streaming.multiline_stream import assemble_multiline_stream, drain
from ..streaming.pipeline import run_pipeline, volume_stream
from . import duck as D
from .q_multiline import _M2
from .q_normalize import _N11_SQL, AS_OF
from .registry import register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/logweave-{name}-{uuid.uuid4().hex}"


def _done(query) -> None:
    """Wait for an ``availableNow`` query; its failure is raised here."""
    query.awaitTermination()


@register("M3", _M2, views=("stream_lines",))
def q_m3(spark, sf_dir):
    """Stateful assembly over two runs on one checkpoint (M3) and the drain of what stays open (M4): equal to M2."""
    d = _folder(spark, "m3")
    lines = Tables(spark, sf_dir).stream_lines.select("seq", "src", "arrival_ms", "line")
    half = lines.agg(F.percentile_approx("arrival_ms", 0.5)).first()[0] or 0
    for n, part in enumerate((lines.where(F.col("arrival_ms") <= half), lines.where(F.col("arrival_ms") > half))):
        part.write.parquet(f"{d}/in/{n}")
        source = spark.readStream.schema(lines.schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
        _done(assemble_multiline_stream(source).writeStream.format("parquet").option("path", f"{d}/out")
              .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
    return spark.read.parquet(f"{d}/out").unionByName(drain(spark, f"{d}/ck"))


def _copied(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream delivers until its input ends."""
    _done(stream.writeStream.format("parquet").option("path", f"{folder}/out")
          .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@register("SRC1", "SELECT value, 'file' AS topic FROM raw_records", views=("raw_records",))
def q_src1(spark, sf_dir):
    """The raw stream's file form, from its first record to its last."""
    d = _folder(spark, "src1")
    Tables(spark, sf_dir).raw_records.select("value").write.text(f"{d}/in")
    return _copied(read_raw_stream(spark, {"format": "text", "path": f"{d}/in"}), d).select("value", "topic")


@register("SRC2", """SELECT line, folder, CAST(NULL AS VARCHAR) AS tag FROM (
  SELECT line, CASE WHEN fmt = 'syslog' THEN 'a' ELSE 'b' END AS folder FROM log_lines)""", views=("log_lines",))
def q_src2(spark, sf_dir):
    """Two folders of log files tailed as one stream (files of these names have no tag)."""
    d = _folder(spark, "src2")
    lines = Tables(spark, sf_dir).log_lines
    syslog = F.col("fmt") == "syslog"
    lines.where(syslog).select("line").write.text(f"{d}/a")
    lines.where(~syslog).select("line").write.text(f"{d}/b")
    read = _copied(read_log_files(spark, [f"{d}/a", f"{d}/b"], stream=True), d)
    return read.select("line", F.regexp_extract("path", "/([ab])/[^/]*$", 1).alias("folder"), "tag")


_PRIORITY = ", ".join(D.q(x) for x in PRIORITY_LEVELS)


@register("R2", f"""WITH n AS ({_N11_SQL}),
c AS (SELECT level, COUNT(*) AS stored, COUNT(*) FILTER (WHERE upper(level) IN ({_PRIORITY})) AS prio
      FROM n WHERE reject_reason IS NULL GROUP BY level)
SELECT level, stored, stored AS published, prio AS embedded, prio AS scored, CAST(0 AS BIGINT) AS errors FROM c""",
          views=("raw_records",))
def q_r2(spark, sf_dir):
    """Both tracks of the pipeline over all raw records: rows by level in each of its tables."""
    d = _folder(spark, "r2")
    Tables(spark, sf_dir).raw_records.select("value").write.text(f"{d}/in")
    raw = read_raw_stream(spark, {"format": "text", "path": f"{d}/in"})
    _done(run_pipeline(raw, f"{d}/out", f"{d}/ck", trigger={"availableNow": True}, as_of=AS_OF))

    def by_level(df: DataFrame, **counts) -> DataFrame:
        return df.groupBy("level").agg(*[c.cast("bigint").alias(n) for n, c in counts.items()])

    stored = by_level(spark.read.parquet(f"{d}/out/log_entries"), stored=F.count(F.lit(1)))
    sent = spark.read.schema("key string, value string, epoch_id int").json(f"{d}/out/processed")
    sent = by_level(sent.select(F.get_json_object("value", "$.level").alias("level")), published=F.count(F.lit(1)))
    results = by_level(spark.read.parquet(f"{d}/out/results"), embedded=F.count("distance"),
                       scored=F.count("anomaly_score"), errors=F.count("error"))
    joined = stored.join(sent, "level", "full").join(results, "level", "full")
    return joined.na.fill(0, ["stored", "published", "embedded", "scored", "errors"])


@register("SNK1", """SELECT CAST(log_id AS VARCHAR) AS key, level, service, message, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts
FROM logs""", views=("logs",))
def q_snk1(spark, sf_dir):
    """Published rows read back, the second of two equal epochs."""
    path = _folder(spark, "snk1")
    logs = Tables(spark, sf_dir).logs.select("log_id", "level", "service", "message", "ts")
    for _ in range(2):
        sinks.write_processed(logs, path, 1)
    sent = spark.read.schema("key string, value string, epoch_id int").json(path)
    return sent.select("key", *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("level", "service", "message", "ts")])


@register("SNK2", """SELECT log_id, level, service, message, TIMESTAMP '2024-01-20 00:00:00' AS created_at,
  DATE '2024-01-20' AS ingest_date, CAST(log_id % 3 AS INTEGER) AS epoch_id FROM logs""", views=("logs",))
def q_snk2(spark, sf_dir):
    """The log table after three epochs, one of which ran twice."""
    path = _folder(spark, "snk2")
    logs = Tables(spark, sf_dir).logs.select("log_id", "level", "service", "message")
    for epoch in (0, 1, 2, 1):
        sinks.append_logs(logs.where(F.col("log_id") % 3 == epoch), path, epoch, created_at=AS_OF)
    return spark.read.parquet(path)


@register("V4", """SELECT date_trunc('hour', ts) + INTERVAL 1 MINUTE * (15 * (minute(ts) // 15)) AS bucket_start, level, COUNT(*) AS n
FROM logs WHERE ts IS NOT NULL GROUP BY 1, 2""", views=("logs",))
def q_v4(spark, sf_dir):
    """Live volume by level, its last complete table."""
    d = _folder(spark, "v4")
    Tables(spark, sf_dir).logs.select("log_id", "ts", "level").write.parquet(f"{d}/in")
    live = spark.readStream.schema("log_id bigint, ts timestamp_ntz, level string").parquet(f"{d}/in")
    _done(volume_stream(live, 15).writeStream.outputMode("complete")
          .foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{d}/out"))
          .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
    return spark.read.parquet(f"{d}/out")
