"""Isolation Forest (Z5), after Liu, Ting and Zhou, "Isolation Forest", ICDM 2008.

Distributed plan
1. Subsample: tree t takes the psi = min(256, n) rows with the smallest seeded hash of
   (seed, t, id).  Rows are pre-filtered by a hash threshold with a safety margin and the
   exact psi smallest are kept per tree (a tree never sees more than a few psi rows); if a
   tree falls short the exact two-phase top-n over all rows is used instead.
2. Build: ``groupBy(tree).applyInPandas`` grows each isolation tree (random feature among the
   non-constant ones, uniform split, height limit ceil(log2 psi)) from a generator seeded by
   (seed, tree), so results survive retries and repartitioning.
3. Score: the forest (trees * (2 psi - 1) nodes, bounded: ~2 MB for 100 trees) is broadcast
   and ``mapInPandas`` computes path lengths for Arrow batches with numpy, one level of all
   trees at a time.  s(x) = 2^(-E[h(x)] / c(psi)); score_samples = -s.
4. Statistics: offset = percentile(score_samples, contamination) (strict "<" flags), median of
   s for the level gate — exact percentiles by rank, two values each to the driver.
Scores cannot equal scikit-learn's (different random stream); tests check invariants.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_gate, level_weight
from .clusters import top_n_per_group
from .numbering import percentiles
from .vectors import valid_vectors

EULER = 0.5772156649


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _hash_u(seed: int, tree_col, id_col):
    """Uniform [0,1) from a 64-bit hash of (seed, tree, id)."""
    h = F.xxhash64(F.lit(seed), tree_col, id_col)
    return (F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53))


def subsample(vec: DataFrame, n_trees: int, psi: int, n: int, seed: int) -> DataFrame:
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))
    base = valid_vectors(vec).select("log_id", "embedding").withColumn("tree", trees) \
        .withColumn("u", _hash_u(seed, F.col("tree"), F.col("log_id")))
    p = min(1.0, 4.0 * psi / max(n, 1) + 1e-9)
    if p < 1.0:
        cand = base.filter(F.col("u") < p)
        picked = top_n_per_group(cand, ["tree"], [F.col("u"), F.col("log_id")], psi, salt_col="log_id")
        short = picked.groupBy("tree").count().filter(F.col("count") < psi).limit(1).count()
        if short == 0:
            return picked
    return top_n_per_group(base, ["tree"], [F.col("u"), F.col("log_id")], psi, salt_col="log_id")


def _builder(seed: int, psi: int):
    height = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        X = np.stack(pdf.sort_values("log_id")["embedding"].to_numpy()).astype(np.float64)
        rng = np.random.default_rng([seed, tree])
        feat, thr, left, right, size = [], [], [], [], []

        def grow(idx, depth):
            node = len(feat)
            feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
            if depth >= height or len(idx) <= 1:
                return node
            sub = X[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            cand = np.flatnonzero(hi > lo)
            if len(cand) == 0:
                return node
            q = int(cand[rng.integers(len(cand))])
            p = float(rng.uniform(lo[q], hi[q]))
            mask = sub[:, q] < p
            feat[node], thr[node] = q, p
            lnode = grow(idx[mask], depth + 1)
            rnode = grow(idx[~mask], depth + 1)
            left[node], right[node] = lnode, rnode
            return node

        grow(np.arange(len(X)), 0)
        return pd.DataFrame({"tree": [tree], "feat": [np.asarray(feat, dtype=np.int32)],
                             "thr": [np.asarray(thr)], "left": [np.asarray(left, dtype=np.int32)],
                             "right": [np.asarray(right, dtype=np.int32)],
                             "size": [np.asarray(size, dtype=np.int64)]})
    return build


def build_forest(vec: DataFrame, n_trees: int = 100, seed: int = 42,
                 max_samples: int = 256) -> tuple[DataFrame, int]:
    """Trees as rows (tree, feat, thr, left, right, size); returns (forest, psi)."""
    n = valid_vectors(vec).count()
    psi = max(1, min(max_samples, n))
    sub = subsample(vec, n_trees, psi, n, seed)
    forest = sub.groupBy("tree").applyInPandas(
        _builder(seed, psi),
        "tree int, feat array<int>, thr array<double>, left array<int>, right array<int>, size array<bigint>")
    return forest, psi


def _scorer(bc, psi: int):
    cpsi = float(c_factor([psi])[0]) or 1.0

    def run(it):
        trees = bc.value
        for pdf in it:
            if len(pdf) == 0:
                yield pd.DataFrame({"log_id": pd.Series([], dtype="int64"),
                                    "score_samples": pd.Series([], dtype="float64")})
                continue
            X = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            total = np.zeros(len(X))
            rows = np.arange(len(X))
            for (feat, thr, left, right, size) in trees:
                node = np.zeros(len(X), dtype=np.int64)
                depth = np.zeros(len(X))
                active = feat[node] >= 0
                while active.any():
                    f = feat[node[active]]
                    go_left = X[rows[active], f] < thr[node[active]]
                    node[active] = np.where(go_left, left[node[active]], right[node[active]])
                    depth[active] += 1
                    active = feat[node] >= 0
                total += depth + c_factor(size[node])
            s = np.power(2.0, -(total / len(trees)) / cpsi)
            yield pd.DataFrame({"log_id": pdf["log_id"].to_numpy(dtype=np.int64), "score_samples": -s})
    return run


def score_forest(vec: DataFrame, forest: DataFrame, psi: int) -> DataFrame:
    """score_samples (= -s, lower is more anomalous) for every vector."""
    spark = vec.sparkSession
    rows = forest.orderBy("tree").collect()   # bounded: n_trees * (2 psi - 1) nodes
    trees = [(np.asarray(r.feat, dtype=np.int64), np.asarray(r.thr), np.asarray(r.left, dtype=np.int64),
              np.asarray(r.right, dtype=np.int64), np.asarray(r.size, dtype=np.float64)) for r in rows]
    bc = spark.sparkContext.broadcast(trees)
    v = valid_vectors(vec).select("log_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return v.mapInPandas(_scorer(bc, psi), "log_id bigint, score_samples double")


def detect_iforest(vec: DataFrame, logs: DataFrame | None = None, contamination: float = 0.1,
                   n_trees: int = 100, seed: int = 42, weights: dict | None = None,
                   max_samples: int = 256) -> DataFrame:
    """Every vector with anomaly_score (= s, positive scale), is_anomaly and method."""
    if not 0.0 < contamination <= 0.5:
        raise ValueError("contamination must be in (0, 0.5]")   # B14: validated up front
    forest, psi = build_forest(vec, n_trees, seed, max_samples)
    from pyspark import StorageLevel
    sc = score_forest(vec, forest, psi).persist(StorageLevel.MEMORY_AND_DISK)   # (id, score): small
    levels = percentiles(sc, "score_samples", [contamination, 0.5])
    offset, med = levels[0], -levels[1]
    lv = valid_vectors(vec).select("log_id", *(["level"] if "level" in vec.columns else []))
    if logs is not None:
        lv = lv.select("log_id").join(logs.select("log_id", "level"), "log_id", "left")
    elif "level" not in lv.columns:
        lv = lv.withColumn("level", F.lit(None).cast("string"))
    df = sc.join(lv, "log_id", "left")
    s = -F.col("score_samples")
    w = level_weight("level", weights)
    return df.withColumn("anomaly_score", s) \
        .withColumn("is_anomaly", level_gate(F.col("score_samples") < offset, s, med, w)) \
        .withColumn("detection_method", F.lit("IsolationForest"))
