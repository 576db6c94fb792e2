"""Two-track ingest pipeline (R2) with size-or-time micro-batches (R3), and live volume (V4).

One streaming query; ``foreachBatch`` per micro-batch:
  normalise (N11) -> persist -> every accepted row appended to the log table (SNK2) and
  published (SNK1); rejected rows to quarantine; priority rows (R1) -> cache split (E2) -> requests
  of distinct texts admitted by the day's budget (E5, E4) -> embed (E6) -> vector table append (K4)
  and cache append -> population merged and the new vectors scored (Z7) -> outcome counters (R5).

Tables below ``out_dir``, all partitioned by ``epoch_id``: ``log_entries``, ``processed``,
``quarantine``, ``embedding_cache``, ``embedding_spend``, ``log_vectors``, ``population``,
``results`` (one row a priority row) and ``outcomes`` (one row an epoch).  A micro-batch reads state
of earlier epochs only and overwrites its own partitions, so running it again changes nothing.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import embed as EM
from ..operators import population as PO
from ..operators.admission import admit
from ..operators.normalize import normalize_records, split_rejected
from ..operators.routing import outcome_counters, priority
from ..sources import sinks
from ..sources.logfiles import line_places

REQUEST_TEXTS = 50  # fixed value: texts of one embedding request of the pipeline
REFRESH_GROWTH = 0.1
THRESHOLD = 3.0


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder is there; any other fault of the store is raised."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _write(df: DataFrame, path: str, epoch_id: int) -> None:
    df.withColumn("epoch_id", F.lit(epoch_id)).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("epoch_id").parquet(path)


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table below ``out_dir``; without rows where nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, epoch_id int")
    return spark.read.schema(f"{schema}, epoch_id int").parquet(path)


VECTORS = "log_id string, level string, embedding array<float>"


def _admitted(misses: DataFrame, out_dir: str, epoch_id: int, budget: float | None, as_of) -> DataFrame:
    """The misses whose request the day's budget admits; notes what they cost."""
    day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    sized = EM.estimate_cost(EM.chunk(misses, REQUEST_TEXTS, order_cols=("text_hash",)), "text").withColumn("day", day)
    requests = sized.groupBy("day", F.col("request_no").alias("batch_no")).agg(F.sum("cost_usd").alias("est_cost_usd"))
    path = f"{out_dir}/embedding_spend"
    if budget is None:
        told = requests.withColumn("admitted", F.lit(True))
    else:
        spent = table(misses.sparkSession, path, "day date, spent_usd double").where(F.col("epoch_id") < epoch_id)
        told = admit(requests, budget, spent.groupBy("day").agg(F.sum("spent_usd").alias("spent_usd")))
    told = told.persist(StorageLevel.MEMORY_AND_DISK)  # one row a request
    try:
        paid = told.where("admitted").groupBy("day").agg(F.sum("est_cost_usd").alias("spent_usd"))
        _write(paid, path, epoch_id)
        chosen = told.where("admitted").select(F.col("batch_no").alias("request_no"))
        return sized.join(chosen, "request_no", "left_semi").select("text_hash", "text").checkpoint()
    finally:
        told.unpersist()


def _population(vec: DataFrame, out_dir: str, epoch_id: int, growth: float) -> DataFrame:
    """The population after this epoch: one row, written as the epoch's version."""
    spark, path = vec.sparkSession, f"{out_dir}/population"
    latest = table(spark, path, PO.SCHEMA).where(F.col("epoch_id") < epoch_id).orderBy(F.desc("epoch_id")).drop("epoch_id").first()
    held = spark.createDataFrame([tuple(latest)], PO.SCHEMA) if latest else PO.empty(spark)
    row = PO.merge(held, PO.moments(vec, held)).first()
    if PO.due(row.asDict(), growth) or (row["n"] and not held.first()["n"]):
        every = table(spark, f"{out_dir}/log_vectors", VECTORS).where(F.col("epoch_id") <= epoch_id)
        row = PO.refresh(every).first()
    out = spark.createDataFrame([tuple(row)], PO.SCHEMA)
    _write(out, path, epoch_id)
    return out


def process_batch(batch: DataFrame, epoch_id: int, out_dir: str, as_of=None,
                  embed_fn=None, levels=None, daily_budget_usd: float | None = None,
                  threshold: float = THRESHOLD, refresh_growth: float = REFRESH_GROWTH) -> dict:
    """One micro-batch through both tracks; returns its outcome counters.

    ``refresh_growth`` 0 scores each batch against all vectors so far exactly as Z7 does; a share g
    keeps the population's centre until it has grown by g (``population``).
    """
    spark = batch.sparkSession
    place = ["topic", "partition", "offset"]
    placed = set(place) <= set(batch.columns)
    norm = normalize_records(line_places(batch) if placed else batch, "value", as_of=as_of,
                             id_cols=place if placed else None)
    norm = norm.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ok, rejected = split_rejected(norm)
        ok = ok.select("log_id", "timestamp", "level", "service", "message", "raw_log", "metadata",
                       "pii_redacted", "pii_entities")
        sinks.append_logs(ok, f"{out_dir}/log_entries", epoch_id, created_at=as_of)
        sinks.write_processed(ok, f"{out_dir}/processed", epoch_id)
        _write(rejected, f"{out_dir}/quarantine", epoch_id)

        prio = priority(ok, levels).select("log_id", "level", F.col("message").alias("text")) \
            .withColumn("text_hash", EM.text_hash("text"))
        cache_path = f"{out_dir}/embedding_cache"
        cached = table(spark, cache_path, "text_hash string").where(F.col("epoch_id") < epoch_id)
        _, misses = EM.split_cached(prio, cached)
        _write(EM.embed(_admitted(misses, out_dir, epoch_id, daily_budget_usd, as_of), embed_fn, as_of=as_of),
               cache_path, epoch_id)
        known = table(spark, cache_path, "text_hash string, embedding array<float>") \
            .where(F.col("epoch_id") <= epoch_id).select("text_hash", "embedding")
        _write(prio.join(known, "text_hash").select("log_id", "level", "embedding"), f"{out_dir}/log_vectors", epoch_id)
        vec = table(spark, f"{out_dir}/log_vectors", VECTORS).where(F.col("epoch_id") == epoch_id)

        population = _population(vec, out_dir, epoch_id, refresh_growth)
        scored = PO.score(vec, population, threshold).select(
            "log_id", "embedding", "distance", "anomaly_score", "is_anomaly", "detection_method")
        result = prio.select("log_id", "level", "text_hash").join(scored, "log_id", "left") \
            .withColumn("error", F.when(F.col("embedding").isNull(), F.lit("budget_exceeded")))
        seen = Observation(f"outcome-{epoch_id}")
        _write(result.observe(seen, *outcome_counters()).drop("embedding"), f"{out_dir}/results", epoch_id)
        outcome = seen.get
        _write(spark.createDataFrame([outcome], "processed bigint, embeddings_generated bigint, anomalies_detected bigint, errors bigint"),
               f"{out_dir}/outcomes", epoch_id)
    finally:
        norm.unpersist()
    return {"epoch_id": epoch_id, **outcome}


def run_pipeline(raw_stream: DataFrame, out_dir: str, checkpoint: str, trigger: dict | None = None,
                 as_of=None, embed_fn=None, levels=None, **scoring):
    """Start the two-track query.  ``trigger`` defaults to ``processingTime='5 seconds'`` (the
    reference's time bound); the size bound is the source's ``maxOffsetsPerTrigger``.  ``scoring`` goes to
    ``process_batch``."""
    trig = trigger or {"processingTime": "5 seconds"}
    return raw_stream.writeStream.foreachBatch(
        lambda df, eid: process_batch(df, eid, out_dir, as_of, embed_fn, levels, **scoring) and None) \
        .option("checkpointLocation", checkpoint).trigger(**trig).start()


def outcome_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """R5 over a whole run: the counters of its epochs added up."""
    return spark.read.parquet(f"{out_dir}/outcomes").agg(
        *[F.sum(c).alias(c) for c in ("processed", "embeddings_generated", "anomalies_detected", "errors")])


def volume_stream(stream: DataFrame, bucket_minutes: int = 5, time_col: str = "ts",
                  watermark: str = "10 minutes") -> DataFrame:
    """V4: live volume by level per n-minute window (epoch-aligned, equal to V1's hour-relative
    buckets when n divides 60).  The watermark bounds state; it is our addition (the reference
    polls)."""
    if 60 % bucket_minutes:
        raise ValueError("bucket_minutes must divide 60")
    s = stream.withColumn("_et", F.col(time_col).cast("timestamp")).withWatermark("_et", watermark)
    return s.groupBy(F.window("_et", f"{bucket_minutes} minutes").alias("w"), "level") \
        .agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").cast("timestamp_ntz").alias("bucket_start"), "level", "n")
