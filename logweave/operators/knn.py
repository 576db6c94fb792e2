"""Exact batch k-NN (K2) and semantic search (Q5).

K2 is a blocked matrix product: vectors are hashed into ``vb`` blocks and queries into ``qb``
blocks; every (vector block, query block) cell is one cogroup task that computes cosine
scores with numpy and keeps only the top-k per query.  A per-query merge over at most
``k * vb`` candidates gives the exact answer.  Nothing is collected to the driver, no task
holds more than one block of each side, and no all-pairs rows are emitted.  Block counts are
chosen from the row counts and the dimension so that a cell's score matrix stays near
``block_bytes``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import search as S
from .vectors import knn, valid_vectors

#: Rows of a block below which a finer split costs more than it gains.
SMALL_BLOCK = 512
OUT_SCHEMA = "query_id bigint, neighbor_id bigint, score double"


def _topk_cell(k: int, exclude_self: bool):
    def run(vecs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if len(vecs) == 0 or len(qs) == 0:
            return pd.DataFrame({"query_id": pd.Series([], dtype="int64"),
                                 "neighbor_id": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        V = np.stack(vecs["embedding"].to_numpy()).astype(np.float64)
        Q = np.stack(qs["q"].to_numpy()).astype(np.float64)
        vn = np.linalg.norm(V, axis=1)
        qn = np.linalg.norm(Q, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            Sm = (Q @ V.T) / np.outer(qn, vn)
        vid = vecs["log_id"].to_numpy(dtype=np.int64)
        qid = qs["query_id"].to_numpy(dtype=np.int64)
        if exclude_self:
            Sm[qid[:, None] == vid[None, :]] = -np.inf
        Sm = np.nan_to_num(Sm, nan=-np.inf)
        kk = min(k, Sm.shape[1])
        # The kk-th best score of each row bounds its candidates; ties at it go to the smaller id.
        bound = -np.partition(-Sm, kk - 1, axis=1)[:, kk - 1]
        rows, cols = [], []
        for row in range(len(qid)):
            near = np.flatnonzero(Sm[row] >= bound[row])
            near = near[np.lexsort((vid[near], -Sm[row, near]))[:kk]]
            rows.append(np.full(len(near), row))
            cols.append(near)
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        sc = Sm[rows, cols]
        keep = np.isfinite(sc)
        return pd.DataFrame({"query_id": qid[rows][keep], "neighbor_id": vid[cols][keep],
                             "score": sc[keep]})
    return run


def knn_join(queries: DataFrame, vec: DataFrame, k: int = 5, exclude_self: bool = False,
             vb: int | None = None, qb: int | None = None,
             block_bytes: int = 64 * 1024 * 1024, dim: int | None = None) -> DataFrame:
    """K2: exact cosine top-k neighbours for every query row.

    ``queries``: (query_id, embedding); ``vec``: (log_id, embedding, ...).  Output:
    (query_id, neighbor_id, rank, score), rank 1..k by score desc then neighbour id.
    """
    v = valid_vectors(vec).select("log_id", F.col("embedding").cast("array<float>").alias("embedding"))
    q = queries.select("query_id", F.col("embedding").cast("array<float>").alias("q"))
    if vb is None or qb is None:
        # A cell holds its score matrix (doubles, with working copies) and both blocks; small
        # inputs still spread over the cores.
        head = v.select(F.size("embedding").alias("d")).first() if dim is None else None
        d = dim or (head["d"] if head else 1)
        side = max(1, min(math.isqrt(block_bytes // 16), block_bytes // (16 * d)))
        cores = vec.sparkSession.sparkContext.defaultParallelism
        n = v.count()
        vb = vb or max(1, math.ceil(n / side), min(cores, math.ceil(n / SMALL_BLOCK)))
        qb = qb or max(1, math.ceil(q.count() / side))
    vv = v.withColumn("vblk", F.pmod(F.xxhash64("log_id"), F.lit(vb))) \
        .withColumn("qblk", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).withColumn("qblk", F.col("qblk").cast("bigint"))
    qq = q.withColumn("qblk", F.pmod(F.xxhash64("query_id"), F.lit(qb))) \
        .withColumn("vblk", F.explode(F.sequence(F.lit(0), F.lit(vb - 1)))).withColumn("vblk", F.col("vblk").cast("bigint"))
    cand = vv.groupBy("vblk", "qblk").cogroup(qq.groupBy("vblk", "qblk")) \
        .applyInPandas(_topk_cell(k, exclude_self), OUT_SCHEMA)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("neighbor_id"))
    return cand.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)


def semantic_search(logs: DataFrame, vec: DataFrame, anom: DataFrame, query,
                    limit: int = 100, offset: int = 0, level: str | None = None,
                    service: str | None = None, min_score: float | None = None,
                    is_anomaly: bool | None = None, start_time=None, end_time=None) -> DataFrame:
    """Q5: top (limit+offset) hits with payload filters, skip ``offset``, fetch the log rows,
    attach anomaly flags, then post-filter anomaly/time (B20) keeping rank order.

    The hit list is bounded by limit+offset, so it is broadcast into the log and anomaly
    joins; ``total`` counts the rows left after the post-filter.
    """
    S._check_page(limit, offset)
    hits = knn(vec, query, k=limit + offset, level=level, service=service, min_score=min_score)
    hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "log_id")).cast("bigint"))
    hits = hits.filter(F.col("rank") > offset).select("log_id", "rank", "score")
    rows = logs.join(F.broadcast(hits), "log_id", "inner")
    rows = S.with_anomaly(rows, anom)
    if is_anomaly is not None:
        rows = rows.filter(F.col("is_anomaly") == F.lit(bool(is_anomaly)))
    if start_time:
        rows = rows.filter(F.col("ts") >= S.ts_lit(S.parse_ts(start_time)))
    if end_time:
        rows = rows.filter(F.col("ts") <= S.ts_lit(S.parse_ts(end_time)))
    return rows.orderBy("rank")

