"""Multi-line event assembly, batch form (M1, M2, M4).

Rules per source key, in arrival order (lines empty after stripping trailing newlines are
dropped first):
  1. an idle gap > 2 s flushes the open buffer;
  2. a traceback line flushes and opens an error buffer;
  3. with an open buffer, a continuation line or any line that is not a new entry is appended;
     at 100 lines the buffer flushes and closes;
  4. otherwise flush; open a buffer only for an "opener" line, else emit the line unchanged.

Batch form.  A *hard start* (traceback, new entry, gap > 2 s, first line of the key) ends the
previous buffer.  Between hard starts every line from the first opener on is one group, lines
before it pass through.  Only groups longer than ``max_lines`` depend on the cap: there the
buffer restarts at the first opener at or after (start + max_lines), a chain computed over the
openers' positions alone.

Distribution.  No window is partitioned by the key alone (a key may hold a third of all rows):
per-row windows run per (key, time bucket); what crosses bucket borders (last arrival time,
latest hard start, row counts) comes from one-row-per-bucket aggregates with small windows.
The group assembly is a grouped aggregate of at most ``max_lines`` lines per group.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import U, alternation

# Fixed values (must equal the reference): line classes of the assembler.
NEW_ENTRY_PATTERNS = [
    r"^(DEBUG|INFO|WARNING|ERROR|CRITICAL):",
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}",
    r"^\[\d{4}-\d{2}-\d{2}",
    r"^\[(DEBUG|INFO|WARNING|ERROR|CRITICAL)\]",
]
CONTINUATION_PATTERNS = [
    r"^\s{2,}",
    r"^File \"",
    r"^[A-Za-z_][A-Za-z0-9_.]*Error:",
    r"^[A-Za-z_][A-Za-z0-9_.]*Exception:",
    r"^The above exception was the direct cause",
    r"^During handling of the above exception",
    r"^Traceback \(most recent call last\):",
    r"^\s*[\^~]+\s*$",
    r"^\s*\|",
]
ERROR_INDICATORS = [
    r"Traceback \(most recent call last\):",
    r"^(ERROR|CRITICAL|FATAL):",
    r"^\[(ERROR|CRITICAL|FATAL)\]",
    r"^[A-Za-z_][A-Za-z0-9_.]*Error:",
    r"^[A-Za-z_][A-Za-z0-9_.]*Exception:",
    r"raise \w+Error\(",
    r"raise \w+Exception\(",
]
OPENER_START = r"^(ERROR|WARN|WARNING|CRITICAL|FATAL):"
TRACEBACK_TEXT = "Traceback (most recent call last):"
FLUSH_TIMEOUT_MS = 2000
MAX_LINES = 100

NEW_RE = U + alternation(NEW_ENTRY_PATTERNS)
CONT_RE = U + alternation(CONTINUATION_PATTERNS)
ERR_RE = U + "(?m)" + alternation(ERROR_INDICATORS)
OPENER_RE = OPENER_START


def strip_line(c) -> F.Column:
    """rstrip('\\n')."""
    return F.regexp_replace(c, "\n+$", "")


def classify_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """M1: is_new_entry, is_continuation, is_traceback, has_error, is_opener."""
    s = F.col(line_col)
    err = s.rlike(ERR_RE)
    tb = s.contains(TRACEBACK_TEXT)
    return df.withColumn("is_new_entry", s.rlike(NEW_RE)) \
        .withColumn("is_continuation", s.rlike(CONT_RE)) \
        .withColumn("is_traceback", tb) \
        .withColumn("has_error", err) \
        .withColumn("is_opener", err | tb | s.rlike(OPENER_RE))


def _cap_chain(max_lines: int):
    """Sequential cap rule over the opener positions of one group (positions only)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pos = np.sort(pdf["pos"].to_numpy(dtype=np.int64))
        starts = []
        i = 0
        while i < len(pos):
            s = pos[i]
            starts.append(s)
            i = int(np.searchsorted(pos, s + max_lines, side="left"))
        return pd.DataFrame({"gkey": pdf["gkey"].iloc[0] if len(pdf) else "",
                             "chunk_start": np.asarray(starts, dtype=np.int64)})
    return run


def assemble_multiline(df: DataFrame, key_col: str = "src", time_col: str = "arrival_ms",
                       seq_col: str = "seq", line_col: str = "line", gap_ms: int = FLUSH_TIMEOUT_MS,
                       max_lines: int = MAX_LINES, bucket_ms: int = 3_600_000) -> DataFrame:
    """M2 (+ M4: every buffer is flushed at the end of input).

    Output, one row per emitted record: key, first_seq, start_ms, end_ms, message (lines joined
    by newline), line_count, aggregated, detected_error, level ('ERROR' for error buffers,
    NULL otherwise).
    """
    k, t, q = key_col, time_col, seq_col
    rows = df.select(F.col(k).alias("k"), F.col(t).cast("bigint").alias("t"),
                     F.col(q).cast("bigint").alias("q"), strip_line(F.col(line_col)).alias("line")) \
        .filter(F.col("line").isNotNull() & (F.col("line") != ""))
    rows = classify_lines(rows, "line").withColumn("b", F.floor(F.col("t") / bucket_ms).cast("bigint"))
    # Each stage below reads the per-row frame several times (bucket aggregates joined back);
    # persisting it at the stage boundaries keeps every branch from re-deriving it.
    held = []

    def keep(df):
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(df)
        return df
    rows = keep(rows)
    order = F.struct("t", "q")

    # --- gap to the previous line of the key -------------------------------------------------
    wb = Window.partitionBy("k", "b").orderBy("t", "q")
    rows = rows.withColumn("prev_t", F.lag("t").over(wb))
    buckets = rows.groupBy("k", "b").agg(
        F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n_rows"))
    wk = Window.partitionBy("k").orderBy("b")
    buckets = buckets.withColumn("carry_t", F.lag("last_t").over(wk))
    rows = rows.join(buckets.select("k", "b", "carry_t"), ["k", "b"], "left") \
        .withColumn("prev_t", F.coalesce("prev_t", "carry_t")).drop("carry_t")
    hard = (F.col("is_traceback") | (F.col("is_new_entry") & ~F.col("is_continuation"))
            | F.col("prev_t").isNull() | ((F.col("t") - F.col("prev_t")) > gap_ms))
    rows = keep(rows.withColumn("hard", hard))

    # --- segment = latest hard start at or before the row -----------------------------------
    hard_o = F.when(F.col("hard"), order)
    rows = rows.withColumn("seg_in", F.max(hard_o).over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    hb = rows.groupBy("k", "b").agg(F.max(hard_o).alias("bucket_hard"))
    hb = hb.withColumn("carry_seg", F.max("bucket_hard").over(wk.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(hb.select("k", "b", "carry_seg"), ["k", "b"], "left") \
        .withColumn("seg", F.coalesce("seg_in", "carry_seg")).drop("seg_in", "carry_seg")

    # --- first opener of the segment; rows from it on form the group ------------------------
    firsts = rows.groupBy("k", "seg").agg(F.min(F.when(F.col("is_opener"), order)).alias("first_open"))
    rows = rows.join(firsts, ["k", "seg"], "left")
    rows = keep(rows.withColumn("grouped", F.col("first_open").isNotNull() & (order >= F.col("first_open"))))

    grp = rows.filter("grouped")
    sizes = grp.groupBy("k", "seg").agg(F.count(F.lit(1)).alias("g_n"))
    grp = grp.join(sizes, ["k", "seg"], "left")
    small = grp.filter(F.col("g_n") <= max_lines).withColumn("chunk", F.lit(0).cast("bigint"))
    big = grp.filter(F.col("g_n") > max_lines)

    # --- capped groups: exact positions from per-bucket counts, then the opener chain -------
    gb = big.groupBy("k", "seg", "b").agg(F.count(F.lit(1)).alias("nb"))
    wsb = Window.partitionBy("k", "seg").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    gb = gb.withColumn("off", F.coalesce(F.sum("nb").over(wsb), F.lit(0)).cast("bigint"))
    wsbr = Window.partitionBy("k", "seg", "b").orderBy("t", "q")
    big = big.join(gb.select("k", "seg", "b", "off"), ["k", "seg", "b"], "left") \
        .withColumn("pos", F.col("off") + F.row_number().over(wsbr) - 1) \
        .withColumn("gkey", F.to_json(F.struct("k", "seg")))
    chain = big.filter("is_opener").select("gkey", "pos").groupBy("gkey") \
        .applyInPandas(_cap_chain(max_lines), "gkey string, chunk_start bigint")
    # Chunk starts are >= max_lines apart: a row can only belong to a start in its own
    # position bin or the one before — a bounded equi-join.
    chain = chain.withColumn("bin", F.floor(F.col("chunk_start") / max_lines).cast("bigint"))
    big = big.withColumn("bin", F.explode(F.array(F.floor(F.col("pos") / max_lines).cast("bigint"),
                                                  F.floor(F.col("pos") / max_lines).cast("bigint") - 1)))
    big = big.join(chain, ["gkey", "bin"], "left") \
        .withColumn("hit", F.col("chunk_start").isNotNull() & (F.col("pos") >= F.col("chunk_start"))
                    & (F.col("pos") < F.col("chunk_start") + max_lines))
    per_row = big.groupBy("k", "seg", "t", "q", "line").agg(
        F.max(F.when(F.col("hit"), F.col("chunk_start"))).alias("chunk"))
    big_grouped = per_row.filter(F.col("chunk").isNotNull())
    big_raw = per_row.filter(F.col("chunk").isNull()).select("k", "t", "q", "line")

    # --- assemble groups (<= max_lines lines each) ------------------------------------------
    cols = ["k", "seg", "chunk", "t", "q", "line"]
    allg = small.select(*cols).unionByName(big_grouped.select(*cols))
    agg = allg.groupBy("k", "seg", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("t", "q", "line"))).alias("ls"))
    msg = F.array_join(F.transform("ls", lambda x: x["line"]), "\n")
    assembled = agg.select(
        F.col("k"), F.col("ls")[0]["q"].alias("first_seq"), F.col("ls")[0]["t"].alias("start_ms"),
        F.element_at("ls", -1)["t"].alias("end_ms"), msg.alias("message"),
        F.size("ls").cast("bigint").alias("line_count"), F.lit(True).alias("aggregated"))
    assembled = assembled.withColumn("detected_error", F.col("message").rlike(ERR_RE)) \
        .withColumn("level", F.when(F.col("detected_error"), F.lit("ERROR")))

    raw = rows.filter(~F.col("grouped")).select("k", "t", "q", "line").unionByName(big_raw)
    raw = raw.select(F.col("k"), F.col("q").alias("first_seq"), F.col("t").alias("start_ms"),
                     F.col("t").alias("end_ms"), F.col("line").alias("message"),
                     F.lit(1).cast("bigint").alias("line_count"), F.lit(False).alias("aggregated"),
                     F.lit(False).alias("detected_error"), F.lit(None).cast("string").alias("level"))
    return assembled.unionByName(raw).withColumnRenamed("k", key_col)


def assemble_lines(times: list[int], seqs: list[int], lines: list[str], gap_ms: int = FLUSH_TIMEOUT_MS,
                   max_lines: int = MAX_LINES, closed: bool = True) -> tuple[list[dict], int]:
    """Records of one key's lines in arrival order, cut by position; for one micro-batch.

    All lines are classified first.  Hard starts (as in the batch form) bound the segments; in
    each, chunks of at most ``max_lines`` begin at the first opener not yet covered and what no
    chunk covers passes through.  Unless the input is ``closed``, a chunk that reaches the end
    and still has room is held back: the second result is where it starts (the number of lines
    if none does).
    """
    size = len(lines)
    if not size:
        return [], 0
    def seen(pattern: str, flags: int = 0) -> np.ndarray:
        search = re.compile(pattern, flags).search
        return np.array([search(line) is not None for line in lines])

    trace = np.array([TRACEBACK_TEXT in line for line in lines])
    fresh = seen(alternation(NEW_ENTRY_PATTERNS)) & ~seen(alternation(CONTINUATION_PATTERNS))
    gaps = np.diff(np.asarray(times, dtype=np.int64), prepend=times[0])
    hard = trace | fresh | (gaps > gap_ms)
    hard[0] = True
    openers = np.flatnonzero(trace | seen(alternation(ERROR_INDICATORS), re.M) | seen(OPENER_START))

    spans, held = [], size
    bounds = [*np.flatnonzero(hard).tolist(), size]
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        at = begin
        while at < end:
            nth = np.searchsorted(openers, at)
            chunk = min(int(openers[nth]), end) if nth < len(openers) else end
            spans += [(n, n + 1, False) for n in range(at, chunk)]
            at = min(chunk + max_lines, end)
            if chunk < end:
                if at == size and at - chunk < max_lines and not closed:
                    held = chunk
                else:
                    spans.append((chunk, at, True))
    return [_record(times, seqs, lines, *span) for span in spans], held


def _record(times, seqs, lines, begin: int, end: int, joined: bool) -> dict:
    message = "\n".join(lines[begin:end])
    failed = joined and re.search(alternation(ERROR_INDICATORS), message, re.M) is not None
    return {"first_seq": seqs[begin], "start_ms": times[begin], "end_ms": times[end - 1], "message": message,
            "line_count": end - begin, "aggregated": joined, "detected_error": failed,
            "level": "ERROR" if failed else None}
