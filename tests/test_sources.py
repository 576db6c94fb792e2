import tempfile

from pyspark.sql import functions as F

from logweave.sources import logfiles as LF
from logweave.sources import sinks
from logweave.sources.tables import Tables

from .conftest import SF_SMALL


def test_read_log_files_tags_and_parses(spark):
    d = tempfile.mkdtemp(prefix="lw-src2-", dir="/tmp")
    t = Tables(spark, SF_SMALL)
    t.log_lines.filter("fmt = 'syslog'").select("line").coalesce(1).write.text(f"{d}/var/log/syslog_dir")
    df = LF.read_log_files(spark, [f"{d}/var/log/syslog_dir"])
    assert df.count() == t.logs.count()
    parsed = LF.parse_lines(df, "syslog")
    assert parsed.filter("matched").count() == t.logs.count()
    assert parsed.filter(F.col("time_parsed").isNull()).count() == 0


def test_raw_stream_file_source(spark):
    d = tempfile.mkdtemp(prefix="lw-src1-", dir="/tmp")
    t = Tables(spark, SF_SMALL)
    t.raw_records.select("value").coalesce(1).write.text(f"{d}/in")
    s = LF.read_raw_stream(spark, {"format": "text", "path": f"{d}/in"})
    q = s.writeStream.format("memory").queryName("raw_src_t").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.table("raw_src_t")
    assert got.count() == t.raw_records.count()
    assert set(got.columns) >= {"value", "topic", "partition", "offset", "ingest_ts"}


def test_stream_reads_every_path(spark):
    d = tempfile.mkdtemp(prefix="lw-src2s-", dir="/tmp")
    for n in (1, 2):
        spark.createDataFrame([(f"line {n}{k}",) for k in range(n + 2)], "value string").coalesce(1).write.text(f"{d}/in{n}")
    q = LF.read_log_files(spark, [f"{d}/in1", f"{d}/in2"], stream=True).writeStream.format("memory") \
        .queryName("two_paths_t").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert {r.line for r in spark.table("two_paths_t").collect()} == {"line 10", "line 11", "line 12", "line 20", "line 21", "line 22", "line 23"}


def test_repeated_epoch_replaces_its_rows_on_another_date(spark):
    d = tempfile.mkdtemp(prefix="lw-snk2-", dir="/tmp")
    df = spark.createDataFrame([("a",), ("b",)], "log_id string")
    sinks.append_logs(df, f"{d}/t", 1, created_at="2024-01-01 23:59:59")
    sinks.append_logs(df, f"{d}/t", 2, created_at="2024-01-01 23:59:59")
    sinks.append_logs(df, f"{d}/t", 1, created_at="2024-01-02 00:00:01")
    got = spark.read.parquet(f"{d}/t").groupBy("epoch_id", "ingest_date").count().collect()
    assert sorted((r.epoch_id, str(r.ingest_date), r["count"]) for r in got) == [(1, "2024-01-02", 2), (2, "2024-01-01", 2)]


def test_enrich_keeps_existing(spark):
    df = spark.createDataFrame([("docker.web", None, None), ("host.syslog", "x", None), ("logs.nginx", None, "prod")],
                               "tag string, service string, environment string")
    r = {x.tag: x for x in LF.enrich_by_tag(df).collect()}
    assert r["docker.web"].environment == "docker" and r["docker.web"].service is None
    assert r["host.syslog"].service == "x" and r["host.syslog"].environment == "host"
    assert r["logs.nginx"].service == "fluentbit" and r["logs.nginx"].environment == "prod"
