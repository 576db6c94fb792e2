"""M3: streaming multi-line assembly with keyed state.

``groupBy(key).transformWithStateInPandas``: per key, a bounded buffer (< max_lines lines)
lives in a RocksDB-backed ValueState.  Rows of one micro-batch are applied in (arrival time,
seq) order, because messages of one container may sit on several input partitions.  Gaps are
measured on the arrival-time column, so replays give the same records.

Nothing is dropped for being late: there is no watermark.  A line that arrives after its
buffer's later lines were seen joins the buffer of its micro-batch in arrival order, as it
would in a collector that reads its input once.

Idle flush: with ``idle_flush`` a processing-time timer, ``gap_ms`` after a key's last
micro-batch, emits its buffer also if no further line ever comes (the engine then runs a
micro-batch per trigger).  Without it (runs that end, such as ``availableNow``), open buffers
wait in the state; ``drain`` reads them from the checkpoint after the query has stopped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import multiline as ML

OUT_SCHEMA = ("k string, first_seq bigint, start_ms bigint, end_ms bigint, message string, "
              "line_count bigint, aggregated boolean, detected_error boolean, level string")
COLUMNS = ["k", "first_seq", "start_ms", "end_ms", "message", "line_count", "aggregated", "detected_error", "level"]
STATE_SCHEMA = "lines string, last_ms bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor_class():
    from pyspark.sql.streaming import StatefulProcessor

    class LineAssembler(StatefulProcessor):
        def __init__(self, gap_ms: int, max_lines: int, idle_flush: bool):
            self.gap_ms, self.max_lines, self.idle_flush = gap_ms, max_lines, idle_flush

        def init(self, handle) -> None:
            self.handle = handle
            self.buf = handle.getValueState("buf", STATE_SCHEMA)

        def _open(self) -> list:
            return json.loads(self.buf.get()[0]) if self.buf.exists() else []

        def _frame(self, key, records) -> Iterator[pd.DataFrame]:
            if records:
                yield pd.DataFrame(records).assign(k=key)[COLUMNS]

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows), ignore_index=True).sort_values(["t", "q"])
            batch["line"] = batch["line"].str.rstrip("\n")
            batch = batch[batch["line"].notna() & (batch["line"] != "")]
            lines = self._open() + [[int(t), int(q), line] for t, q, line in zip(batch["t"], batch["q"], batch["line"])]
            records, held = ML.assemble_lines(*map(list, zip(*lines)), self.gap_ms, self.max_lines, closed=False) \
                if lines else ([], 0)
            if self.idle_flush:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
            if held < len(lines):
                self.buf.update((json.dumps(lines[held:]), lines[-1][0]))
                if self.idle_flush:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.gap_ms)
            else:
                self.buf.clear()
            yield from self._frame(key[0], records)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            lines = self._open()
            self.buf.clear()
            yield from self._frame(key[0], _closed(lines, self.gap_ms, self.max_lines))

        def close(self) -> None:
            pass

    return LineAssembler


def _closed(lines: list, gap_ms: int, max_lines: int) -> list[dict]:
    return ML.assemble_lines(*map(list, zip(*lines)), gap_ms, max_lines)[0] if lines else []


def assemble_multiline_stream(df: DataFrame, key_col: str = "src", time_col: str = "arrival_ms",
                              seq_col: str = "seq", line_col: str = "line",
                              gap_ms: int = ML.FLUSH_TIMEOUT_MS, max_lines: int = ML.MAX_LINES,
                              idle_flush: bool = False) -> DataFrame:
    """Streaming M3 over a stream with (key, arrival time in ms, seq, line)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = df.select(F.col(key_col).alias("k"), F.col(time_col).cast("bigint").alias("t"),
                     F.col(seq_col).cast("bigint").alias("q"), F.col(line_col).alias("line"))
    processor = _processor_class()(gap_ms, max_lines, idle_flush)
    return rows.groupBy("k").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=OUT_SCHEMA, outputMode="Append",
        timeMode="ProcessingTime" if idle_flush else "None").withColumnRenamed("k", key_col)


def drain(spark: SparkSession, checkpoint: str, key_col: str = "src", gap_ms: int = ML.FLUSH_TIMEOUT_MS,
          max_lines: int = ML.MAX_LINES) -> DataFrame:
    """M4 for a stopped query: the records of the buffers still open in its state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "buf").load()
    held = state.select(F.col("key.k").alias("k"), F.col("value.lines").alias("lines"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, lines in zip(frame["k"], frame["lines"], strict=True):
                yield pd.DataFrame(_closed(json.loads(lines), gap_ms, max_lines)).assign(k=key)[COLUMNS]

    return held.mapInPandas(run, OUT_SCHEMA).withColumnRenamed("k", key_col)
