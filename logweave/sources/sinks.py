"""Sinks: processed-log publication (SNK1) and the append-only log table (SNK2).

Batch writes are idempotent per micro-batch: every write replaces exactly the partitions of
its own ``epoch_id`` (dynamic partition overwrite), so a retried batch never duplicates rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def processed_json(df: DataFrame) -> DataFrame:
    """SNK1 payload: one JSON object per row, datetimes as ISO text (key = log_id)."""
    cols = [F.date_format(c, ISO).alias(c) if t.startswith("timestamp") else F.col(c)
            for c, t in df.dtypes]
    return df.select(F.col("log_id").cast("string").alias("key"), F.to_json(F.struct(*cols)).alias("value"))


def write_processed(df: DataFrame, path: str | None = None, epoch_id: int | None = None,
                    kafka_options: dict | None = None) -> None:
    """SNK1 for one (micro-)batch: Kafka topic ``logs-processed`` when options are given (the
    connector is not on this image's classpath), else JSON-lines files under ``path``."""
    out = processed_json(df)
    if kafka_options:
        w = out.write.format("kafka").option("topic", kafka_options.get("topic", "logs-processed"))
        for k, v in kafka_options.items():
            if k != "topic":
                w = w.option(k, v)
        w.save()
        return
    out = out.withColumn("epoch_id", F.lit(epoch_id if epoch_id is not None else 0))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("epoch_id").json(path)


def append_logs(df: DataFrame, table_path: str, epoch_id: int, created_at=None) -> None:
    """SNK2: append processed logs stamped with ``created_at`` and its ``ingest_date``.

    The table is partitioned by ``epoch_id`` alone: a micro-batch that is run again replaces its
    own partition, also if the date has changed in between.  Readers skip files of other dates by
    the statistics of ``ingest_date``, which is constant within a partition.
    """
    ts = F.current_timestamp().cast("timestamp_ntz") if created_at is None else \
        F.lit(created_at).cast("timestamp_ntz")
    out = df.withColumn("created_at", ts).withColumn("ingest_date", F.to_date("created_at")) \
        .withColumn("epoch_id", F.lit(int(epoch_id)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("epoch_id").parquet(table_path)
