"""Nearest neighbours by inner product through a hash-prefix forest (op 7).

Each tree hashes a vector to a long string of bits, one random hyperplane a bit, and keeps the
strings in a sorted array.  All vectors with a given prefix lie side by side there, so a query
descends by binary search to its longest matching prefix in every tree.  All trees then ascend
together, one bit at a time, until the ranges at the common depth hold enough candidates; all
members of those ranges are scored exactly, in double precision.

Vectors are first given one more component that makes all of them equally long (and queries
a zero there), so that the angle the hyperplanes see orders candidates by inner product.  The
longest norm is an aggregate over all vectors.

Scale: vectors are dealt by hash into shards of at most about ``SHARD`` distinct vectors, each
with a forest of its own; the stated queries meet every shard in blocks, and each pair of a
shard and a block is one bounded task that returns its best 20 a query.  Equal vectors are
indexed once with the smallest ids that any query could need, found by a salted two-step top-n,
so a vector that many rows share is no hot group; equal query vectors are searched once.

Vectors null, zero or holding null or non-finite components, or of another length than most,
take no part.  A query with fewer than k candidates gets all of them; repeated ids with the
same vector count once; rows without an id are no candidates; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

NEIGHBOURS = 20
QUERY_EVERY = 20
TREES = 128
BITS = 32
#: Candidates at which the ascent stops, in each shard.
CANDIDATES = 3500
SHARD = 8192
QUERY_BLOCK = 4096
SEED = 20240607
SALTS = 32


def sound(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that may take part."""
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    return typed.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)
                       & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
                       & F.exists("embedding", lambda x: x != 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(embedding, ids): each different vector once, with its ``keep`` smallest ids."""
    # Equal vectors may differ in the sign of a zero; adding zero makes them one.
    same = rows.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding")).distinct()
    keyed = same.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    for keys in (["embedding", "salt"], ["embedding"]):
        order = Window.partitionBy(*keys).orderBy("vec_id")
        keyed = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    return keyed.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most ``keep``


def hash_strings(vectors: np.ndarray, trees: int, bits: int, seed: int) -> list[np.ndarray]:
    """For each tree the vectors' bit strings as unsigned numbers, first bit highest."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        planes = rng.standard_normal((vectors.shape[1], bits))
        signs = (vectors @ planes) > 0
        out.append(signs.astype(np.uint64) @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)))
    return out


class Forest:
    """Sorted hash strings of one shard's vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int, bits: int, seed: int):
        norms = np.einsum("ij,ij->i", vectors, vectors)
        extra = np.sqrt(np.maximum(longest * longest - norms, 0))
        self.vectors, self.trees, self.bits, self.seed = vectors, trees, bits, seed
        strings = hash_strings(np.column_stack([vectors, extra]), trees, bits, seed)
        self.order = [np.argsort(s, kind="stable") for s in strings]
        self.sorted = [s[o] for s, o in zip(strings, self.order, strict=True)]

    def ranges(self, strings: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(low, high), a row a tree: where each query's prefix of ``depth`` bits lies."""
        low, high = [], []
        rest = np.uint64(self.bits - depth)
        for mine, theirs in zip(self.sorted, strings, strict=True):
            first = (theirs >> rest) << rest
            low.append(np.searchsorted(mine, first, "left"))
            high.append(np.searchsorted(mine, first | np.uint64((1 << int(rest)) - 1), "right"))
        return np.array(low), np.array(high)

    def candidates(self, queries: np.ndarray, enough: int):
        """Yields (query, candidate numbers): all trees at the deepest depth that holds enough."""
        strings = hash_strings(np.column_stack([queries, np.zeros(len(queries))]), self.trees, self.bits, self.seed)
        waiting = np.arange(len(queries))
        for depth in range(self.bits, -1, -1):
            low, high = self.ranges([s[waiting] for s in strings], depth)
            found = (high - low).sum(axis=0)
            ready = np.flatnonzero((found >= enough) | (depth == 0))
            for i in ready:
                parts = [o[a:b] for o, a, b in zip(self.order, low[:, i], high[:, i], strict=True)]
                yield int(waiting[i]), np.unique(np.concatenate(parts))
            waiting = np.delete(waiting, ready)
            if not len(waiting):
                return


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), dtype=np.float64).reshape(len(column), -1)


FOUND = "query long, vec_id long, score double"


def _search_cell(longest: float, keep: int, enough: int, trees: int, bits: int, seed: int):
    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype(
            {"query": "int64", "vec_id": "int64", "score": "float64"})
        if shard.empty or queries.empty:
            return empty
        shard = shard.iloc[np.argsort([ids[0] for ids in shard["ids"]], kind="stable")]
        vectors, wanted = _matrix(shard["embedding"]), _matrix(queries["embedding"])
        ids, names = shard["ids"].to_list(), queries["query"].to_numpy()
        forest, out = Forest(vectors, longest, trees, bits, seed), []
        for q, near in forest.candidates(wanted, enough):
            top = near[np.argsort(-(vectors[near] @ wanted[q]), kind="stable")[:4 * keep]]
            best = sorted((-exact(wanted[q], vectors[n]), int(i)) for n in top for i in ids[n])
            out += [(names[q], i, -s) for s, i in best[:keep]]
        return pd.DataFrame(out, columns=["query", "vec_id", "score"]) if out else empty

    return run


def exact(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product, correctly rounded, so equal pairs score alike wherever they meet."""
    return math.fsum((a * b).tolist())


def search(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, enough: int = CANDIDATES,
           trees: int = TREES, bits: int = BITS, shard: int = SHARD, block: int = QUERY_BLOCK,
           seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``queries``.

    Both tables have vec_id and embedding; a query's own id is no candidate.
    """
    rows = materialise(sound(vectors), "vectors")
    lengths = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").first()
    usual = F.size("embedding") == (lengths["length"] if lengths else 0)
    rows, asked = rows.where(usual), sound(queries).where(usual)
    index = materialise(distinct_vectors(rows, k + 1), "distinct")
    size, longest = index.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x * x)))).first()
    shards = max(1, math.ceil(size / shard))

    texts = asked.select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0)).alias("embedding"))
    apart = materialise(texts.groupBy("embedding").agg(F.min("vec_id").alias("query")), "apart")
    blocks = max(1, math.ceil(apart.count() / block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = (index.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))
             .withColumn("block", every(blocks)))
    posed = (apart.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int"))
             .withColumn("shard", every(shards)))
    # One more than k, as a query may find its own id.
    found = dealt.groupBy("shard", "block").cogroup(posed.groupBy("shard", "block")).applyInPandas(
        _search_cell(float(longest or 0.0), k + 1, enough, trees, bits, seed), FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")  # at most (k + 1) a shard
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(
        F.struct("place", "vec_id", "score"))).alias("near"))

    # Every query row takes the list of its vector, without its own id.
    named = texts.join(apart, "embedding").select(F.col("vec_id").alias("query_id"), "query").distinct()
    own = F.slice(F.filter("near", lambda n: n["vec_id"] != F.col("query_id")), 1, k)
    return (named.join(lists, "query").select("query_id", F.posexplode(own).alias("rank", "hit"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"),
                    F.col("hit.score").alias("score")))


def neighbours(vectors: DataFrame, every: int = QUERY_EVERY, **how) -> DataFrame:
    """``search`` with the stated query set: rows whose vec_id is divisible by ``every``."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), **how)
