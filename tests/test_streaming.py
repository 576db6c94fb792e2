import os
import tempfile
import time

from pyspark.sql import functions as F

from logweave.operators import anomaly as A
from logweave.operators import multiline as ML
from logweave.operators import timeseries as TS
from logweave.operators.routing import batch_outcome
from logweave.sources.logfiles import read_raw_stream
from logweave.sources.tables import Tables
from logweave.streaming.multiline_stream import assemble_multiline_stream, drain
from logweave.streaming.pipeline import outcome_totals, process_batch, run_pipeline, volume_stream

from .conftest import SF_SMALL

AS_OF = "2024-01-20 00:00:00"
SCHEMA = "seq bigint, src string, arrival_ms bigint, line string"


def _key(r):
    return (r["src"], r["first_seq"], r["message"], r["line_count"], r["aggregated"], r["detected_error"])


def test_stream_assembly_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="lw-m3-", dir="/tmp")
    t = Tables(spark, SF_SMALL)
    lines = t.stream_lines.select("seq", "src", "arrival_ms", "line")
    lines.filter("seq < 500").coalesce(1).write.parquet(f"{d}/in/a")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(f"{d}/in")
    out = assemble_multiline_stream(src)

    def run():
        q = out.writeStream.format("parquet").option("path", f"{d}/out") \
            .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start()
        q.awaitTermination(300)

    run()
    lines.filter("seq >= 500").coalesce(1).write.parquet(f"{d}/in/b")
    run()   # a restart on the same checkpoint goes on with the open buffers
    got = spark.read.parquet(f"{d}/out").collect() + drain(spark, f"{d}/ck").collect()
    want = ML.assemble_multiline(lines).collect()
    assert sorted(map(_key, got)) == sorted(map(_key, want))


def test_late_lines_are_not_lost(spark):
    d = tempfile.mkdtemp(prefix="lw-m3-late-", dir="/tmp")
    os.mkdir(f"{d}/in")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true") \
        .parquet(f"{d}/in")
    out = assemble_multiline_stream(src)
    for n, row in enumerate([(1, "a", 10_000_000, "INFO:x:first"), (2, "a", 1_000, "INFO:x:hours late")]):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(f"{d}/in/{n}")
        q = out.writeStream.format("parquet").option("path", f"{d}/out") \
            .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start()
        q.awaitTermination(300)
    assert {r.message for r in spark.read.parquet(f"{d}/out").collect()} == {"INFO:x:first", "INFO:x:hours late"}


def test_idle_buffer_is_flushed_without_new_input(spark):
    d = tempfile.mkdtemp(prefix="lw-m3-idle-", dir="/tmp")
    spark.createDataFrame([(1, "a", 1_000, "ERROR:x:alone")], SCHEMA).coalesce(1).write.parquet(f"{d}/in/a")
    src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{d}/in")
    q = assemble_multiline_stream(src, gap_ms=200, idle_flush=True).writeStream.format("parquet") \
        .option("path", f"{d}/out").option("checkpointLocation", f"{d}/ck").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if q.recentProgress and os.path.isdir(f"{d}/out") and spark.read.schema(
                    "message string").parquet(f"{d}/out").count():
                break
    finally:
        q.stop()
    assert [r.message for r in spark.read.parquet(f"{d}/out").collect()] == ["ERROR:x:alone"]


def test_two_track_pipeline_restart_no_duplicates(spark):
    d = tempfile.mkdtemp(prefix="lw-r2-", dir="/tmp")
    t = Tables(spark, SF_SMALL)
    t.raw_records.select("value").coalesce(2).write.text(f"{d}/in")
    n_in = spark.read.text(f"{d}/in").count()
    raw = read_raw_stream(spark, {"format": "text", "path": f"{d}/in"})
    for _ in range(2):   # second run restarts from the checkpoint and must add nothing
        q = run_pipeline(raw, f"{d}/out", f"{d}/ck", trigger={"availableNow": True}, as_of="2024-01-20 00:00:00")
        q.awaitTermination(300)
        ok = spark.read.parquet(f"{d}/out/log_entries").count()
        bad = spark.read.parquet(f"{d}/out/quarantine").count()
        assert ok + bad == n_in
        # every line of a file has an id of its own
        assert spark.read.parquet(f"{d}/out/log_entries").select("log_id").distinct().count() == ok
    vec = spark.read.parquet(f"{d}/out/log_vectors")
    prio = spark.read.parquet(f"{d}/out/log_entries").filter(
        F.upper("level").isin("ERROR", "WARN", "WARNING", "CRITICAL", "FATAL")).count()
    assert vec.count() == prio
    assert os.path.isdir(f"{d}/out/processed")


OUT = ["log_id", "anomaly_score", "is_anomaly", "error"]


def _results(spark, out):
    return sorted((tuple(r) for r in spark.read.parquet(f"{out}/results").select(*OUT).collect()), key=str)


def test_priority_rows_are_scored_as_by_the_whole_scan(spark):
    d = tempfile.mkdtemp(prefix="lw-r2-score-", dir="/tmp")
    records = Tables(spark, SF_SMALL).raw_records.select("value").distinct()
    parts = records.randomSplit([1.0, 1.0], seed=3)
    for epoch, part in enumerate(parts):
        outcome = process_batch(part, epoch, f"{d}/out", as_of=AS_OF, refresh_growth=0.0)
    vec = spark.read.parquet(f"{d}/out/log_vectors")
    second = vec.where("epoch_id = 1").select("log_id")
    want = {r.log_id: (r.anomaly_score, r.is_anomaly) for r in A.score_logs(second, vec.drop("epoch_id"), None, "zscore").collect()}
    got = spark.read.parquet(f"{d}/out/results").where("epoch_id = 1").collect()
    assert len(got) == len(want) == outcome["processed"] > 20
    for r in got:
        assert abs(r.anomaly_score - want[r.log_id][0]) < 1e-9 and r.is_anomaly == want[r.log_id][1]
    # an epoch that is run again changes nothing, and its counters are those of its table
    before = _results(spark, f"{d}/out")
    states = spark.read.parquet(f"{d}/out/population").orderBy("epoch_id").collect()
    assert process_batch(parts[1], 1, f"{d}/out", as_of=AS_OF, refresh_growth=0.0) == outcome
    assert _results(spark, f"{d}/out") == before
    assert spark.read.parquet(f"{d}/out/population").orderBy("epoch_id").collect() == states
    told = spark.read.parquet(f"{d}/out/results").join(vec.select("log_id", "embedding"), "log_id", "left")
    assert batch_outcome(told).first() == outcome_totals(spark, f"{d}/out").first()


def test_budget_admits_whole_requests_and_counts_the_rest_as_errors(spark):
    d = tempfile.mkdtemp(prefix="lw-r2-budget-", dir="/tmp")
    texts = [f'{{"message": "ERROR: disk {i} {"x" * 392}", "level": "error"}}' for i in range(120)]
    batch = spark.createDataFrame([(t,) for t in texts], "value string")
    # a request of 50 such texts costs some 50 * 101 tokens
    outcome = process_batch(batch, 0, f"{d}/out", as_of=AS_OF, daily_budget_usd=2.1 * 50 * 101 / 1e6 * 0.02)
    assert outcome["processed"] == 120 and outcome["embeddings_generated"] == 100 and outcome["errors"] == 20
    again = process_batch(batch, 1, f"{d}/out", as_of=AS_OF, daily_budget_usd=2.1 * 50 * 101 / 1e6 * 0.02)
    assert again["embeddings_generated"] == 100 and again["errors"] == 20  # hits are free, the rest is still too dear


def test_batches_without_priority_rows(spark):
    d = tempfile.mkdtemp(prefix="lw-r2-none-", dir="/tmp")
    quiet = spark.createDataFrame([('{"message": "all well", "level": "info"}',)], "value string")
    none = {"processed": 0, "embeddings_generated": 0, "anomalies_detected": 0, "errors": 0}
    for epoch in (0, 1):
        assert process_batch(quiet, epoch, f"{d}/out", as_of=AS_OF) == {"epoch_id": epoch, **none}


def test_volume_stream_matches_batch(spark):
    t = Tables(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="lw-v4-", dir="/tmp")
    t.logs.select("log_id", "ts", "level").write.parquet(f"{d}/in")
    s = spark.readStream.schema("log_id bigint, ts timestamp_ntz, level string").parquet(f"{d}/in")
    q = volume_stream(s, 15).writeStream.outputMode("complete").format("memory").queryName("vol_t") \
        .trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r.bucket_start, r.level): r.n for r in spark.table("vol_t").collect()}
    want = t.logs.groupBy(TS.bucket_of(F.col("ts"), 15).alias("b"), "level").count().collect()
    assert got == {(r.b, r.level): r["count"] for r in want}
