"""HDBSCAN (C1): Campello, Moulavi, Sander (PAKDD 2013); McInnes, Healy (ICDMW 2017).

Distributed plan
1. Neighbours: equal vectors are one site with a count; all pairs of sites are looked at once by
   cells (unordered pairs of blocks, a matrix product with its rounding allowed for, then exact
   distances of what is left), which gives the ``NEIGHBOURS`` nearest other sites of every site.
   core(p) = distance to the ``min_samples``-th nearest point counting p itself (the usual library
   convention) is read from them.
2. Minimum spanning tree of the mutual-reachability graph (mrd = max(core_a, core_b, d(a, b)),
   ties by (weight, min id, max id)), exactly, by Boruvka rounds over the neighbours' edges.  What a
   point's list does not hold is no lighter than the list's end; a component chooses its lightest
   edge only if no point of it could have a lighter one outside its list.  When few components can
   choose, the others but the largest are searched again: the ``NEIGHBOURS`` lightest edges of each
   of their points that leave its component, over all points.  Components are merged by pointer
   jumping (joins only), each round's edges cut with ``checkpoint()`` in the shared checkpoint dir.
   Points of one block (a small table) are spanned at once, without rounds.  No candidate cap.
3. Condensed tree and excess-of-mass selection from the n-1 MST edges (24 bytes each) in one
   grouped ``applyInPandas`` — the single-linkage hierarchy is inherently sequential.  This is
   the one step that sees all edges of a clustering run in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import valid_vectors

NOISE = -1
#: Rows and columns of a matrix of distances held at a time; points of a block at most and at least.
TILE, BLOCK_MOST, BLOCK_LEAST = 2048, 32768, 2048
#: Nearest other sites, or lightest edges, that are kept of a point.
NEIGHBOURS = 8
#: Rows and columns of a rough matrix, which stays in a core's cache.
ROWS, COLUMNS = 256, 1024


def _block(vb: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(vb))


def _cells(v: DataFrame, vb: int) -> DataFrame:
    """Every unordered pair of blocks as one cell; a point comes once in each of its ``vb`` cells."""
    blocks = F.sequence(F.lit(0).cast("bigint"), F.lit(vb - 1).cast("bigint"))
    return v.withColumn("blk", _block(vb)).withColumn("other", F.explode(blocks)) \
        .withColumn("lb", F.least("blk", "other")).withColumn("rb", F.greatest("blk", "other")).drop("other") \
        .repartition(vb * (vb + 1) // 2, "lb", "rb")


def _sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two blocks of a cell; twice the same for a block with itself."""
    lb, rb = pdf["lb"].iloc[0], pdf["rb"].iloc[0]
    left = pdf[pdf["blk"] == lb]
    return left, left if lb == rb else pdf[pdf["blk"] == rb]


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.empty((0, 1))


def _dist(A: np.ndarray, B: np.ndarray, cached: int = 1 << 15) -> np.ndarray:
    """Distances from the differences themselves: equal points are 0 apart and a pair's distance
    is the same from both sides, to the last bit.  ``cached`` differences are held at a time."""
    out = np.empty((len(A), len(B)))
    step = max(1, cached // max(1, A.shape[1]))
    for at in range(0, len(B), step):
        part = B[at:at + step]
        gap = np.empty_like(part)
        for i, a in enumerate(A):
            np.subtract(a, part, out=gap)
            np.multiply(gap, gap, out=gap)
            np.add.reduce(gap, axis=1, out=out[i, at:at + step])
    return np.sqrt(out, out=out)


def _nearest(A: np.ndarray, B: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest distances from each row of A to rows of B (fewer if B has fewer).

    A matrix product tells which rows can be among them, its rounding allowed for; only their
    distances are then taken from differences, the same bits as ``_dist`` gives.
    """
    k = min(k, len(B))
    out = np.full((len(A), k), np.nan)
    norm_a, norm_b = (A * A).sum(axis=1), (B * B).sum(axis=1)
    slack = 1e-12 * (A.shape[1] + 8) * (norm_a + norm_b.max())
    step = max(1, TILE * TILE // max(1, len(B)))
    for at in range(0, len(A), step):
        a, room = A[at:at + step], slack[at:at + step, None]
        rough = norm_a[at:at + step, None] + norm_b[None, :] - 2 * (a @ B.T)
        bound = np.partition(rough, k - 1, axis=1)[:, k - 1:k] + 2 * room
        if not np.isfinite(bound).all():
            out[at:at + step] = np.sort(np.partition(_dist(a, B), k - 1, axis=1)[:, :k], axis=1)
            continue
        rows, cols = np.nonzero(rough <= bound)
        d = np.empty(len(rows))
        many = max(1, (1 << 20) // max(1, A.shape[1]))
        for p in range(0, len(rows), many):
            gap = a[rows[p:p + many]] - B[cols[p:p + many]]
            d[p:p + many] = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((d, rows))
        first = np.searchsorted(rows, np.arange(len(a)))   # ``rows`` is sorted, and so is rows[order]
        out[at:at + step] = d[order][first[:, None] + np.arange(k)]
    return out


def _gaps(A: np.ndarray, B: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of pairs, the same bits as ``_dist`` gives."""
    d = np.empty(len(rows))
    many = max(1, (1 << 18) // max(1, A.shape[1]))
    for p in range(0, len(rows), many):
        gap = A[rows[p:p + many]]
        gap -= B[cols[p:p + many]]
        np.multiply(gap, gap, out=gap)
        np.add.reduce(gap, axis=1, out=d[p:p + many])
    return np.sqrt(d, out=d)


def _first(row: np.ndarray, d: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first ``k`` of each row by (d, tie), rows in order; which of them are a k-th."""
    order = np.lexsort((tie, d, row))
    r = row[order]
    at = np.arange(len(r))
    start = np.maximum.accumulate(np.where(np.r_[True, r[1:] != r[:-1]], at, 0)) if len(r) else at
    rank = at - start
    keep = rank < k
    return order[keep], rank[keep] == k - 1


def _true(hit: np.ndarray) -> np.ndarray:
    """Flat positions of the few that are true, eight looked at in one."""
    flat = hit.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64) != 0)
    at = (eights[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


class _Rough:
    """Squared distances by a matrix product, with what its rounding can amount to.

    Single precision where that is small beside ``typical`` (a squared distance that matters).
    """

    def __init__(self, A: np.ndarray, B: np.ndarray, typical: float):
        na, nb = (A * A).sum(axis=1), (B * B).sum(axis=1)
        self.safe = bool(np.isfinite(na).all() and np.isfinite(nb).all())
        most_a, most_b = na.max(initial=0), nb.max(initial=0)
        terms = 2 * A.shape[1] + 16
        kind = np.float64
        if self.safe and most_a + most_b < 1e37 and np.finfo(np.float32).eps * terms * (most_a + most_b) < 1e-2 * typical:
            kind = np.float32
        eps = terms * np.finfo(kind).eps
        self.slack_a, self.slack_b, self.kind = 2 * eps * (na + most_b), 2 * eps * (nb + most_a), kind
        self.left = np.column_stack([-2 * A, na, np.ones(len(A))]).astype(kind)
        self.right = np.ascontiguousarray(np.column_stack([B, np.ones(len(B)), nb]).astype(kind).T)

        self.room = np.empty(ROWS * COLUMNS, dtype=kind)

    def tile(self, r: slice, c: slice) -> np.ndarray:
        """In the same place as the tile before."""
        n, m = r.stop - r.start, c.stop - c.start
        return np.matmul(self.left[r], self.right[:, c], out=self.room[:n * m].reshape(n, m))

    def limit(self, d: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Above every rough value of a pair at most ``d`` apart."""
        with np.errstate(over="ignore"):
            return np.nextafter((d * d * (1 + 1e-12) + slack).astype(self.kind), self.kind(np.inf))


def _typical(d: np.ndarray) -> float:
    d = d[np.isfinite(d)]
    return float(np.median(d)) ** 2 if len(d) else 0.0


def _close(A: np.ndarray, B: np.ndarray, ta: np.ndarray, tb: np.ndarray, k: int):
    """The ``k`` nearest pairs (row, column, d) of each row of A in B, and (column, row, d) of each of B in A.

    ``A is B``: each row's nearest others, and nothing of the second.  No row's k-th nearest is
    farther than its ``ta``, no column's than its ``tb``.
    """
    same = A is B
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    rough = _Rough(A, B, _typical(ta))
    ta, tb = ta.copy(), tb.copy()
    lim_b = None if same else rough.limit(tb, rough.slack_b)
    marks = np.empty((2, ROWS * COLUMNS), dtype=bool)
    out, held, waiting, count = [none], none, [], 0
    for r0 in range(0, len(A), ROWS):
        r = slice(r0, min(r0 + ROWS, len(A)))
        lim_a = rough.limit(ta[r], rough.slack_a[r])
        mine, new, many = none, [], 0
        for c0 in range(0, len(B), COLUMNS):
            c = slice(c0, min(c0 + COLUMNS, len(B)))
            if rough.safe:
                M = rough.tile(r, c)
                hit = np.less_equal(M, lim_a[:, None], out=marks[0, :M.size].reshape(M.shape))
                if not same:
                    hit |= np.less_equal(M, lim_b[None, c], out=marks[1, :M.size].reshape(M.shape))
                at = _true(hit)
            else:
                at = np.arange((r.stop - r0) * (c.stop - c0))
            i, j = np.divmod(at, c.stop - c0)
            i, j = i + r0, j + c0
            d = _gaps(A, B, i, j)
            near = (d <= ta[i]) & np.isfinite(d)
            if same:
                near &= i != j
            new.append((i[near], j[near], d[near]))
            many += int(near.sum())
            if many > k * ROWS // 2 or c.stop == len(B):
                row, col, dist = (np.concatenate(x) for x in zip(mine, *new))
                keep, last = _first(row, dist, col, k)
                mine = row, col, dist = row[keep], col[keep], dist[keep]
                ta[row[last]] = np.minimum(ta[row[last]], dist[last])
                lim_a = rough.limit(ta[r], rough.slack_a[r])
                new, many = [], 0
            if not same:
                near = (d <= tb[j]) & np.isfinite(d)
                waiting.append((j[near], i[near], d[near]))
                count += int(near.sum())
                if count > max(1 << 17, len(held[0])):
                    row, col, dist = (np.concatenate(x) for x in zip(held, *waiting))
                    keep, last = _first(row, dist, col, k)
                    held = row, col, dist = row[keep], col[keep], dist[keep]
                    tb[row[last]] = np.minimum(tb[row[last]], dist[last])
                    lim_b = rough.limit(tb, rough.slack_b)
                    waiting, count = [], 0
        out.append(mine)
    row, col, dist = (np.concatenate(x) for x in zip(held, *waiting)) if waiting else held
    keep, _ = _first(row, dist, col, k)
    return tuple(np.concatenate(x) for x in zip(*out)), (row[keep], col[keep], dist[keep])


def _bound(A: np.ndarray, B: np.ndarray, k: int) -> np.ndarray:
    """Above the distance of the k-th nearest in B, from a sixteenth of B's rows."""
    part = B[:max(4 * k, len(B) // 16)]
    if len(part) < k:
        return np.full(len(A), np.inf)
    d = _nearest(A, part, k)[:, k - 1]
    return np.where(np.isfinite(d), d, np.inf)


_NEAR = "id bigint, other bigint, m bigint, d double"


def _found(pairs) -> pd.DataFrame:
    """Rows of ``_NEAR`` from ((ids, rows), (ids of others, their counts, columns), d) each."""
    own, other, m, d = ([np.empty(0, dtype=t)] for t in (np.int64, np.int64, np.int64, np.float64))
    for (a, i), (b, count, j), x in pairs:
        own.append(a[i]), other.append(b[j]), m.append(count[j]), d.append(x)
    return pd.DataFrame({"id": np.concatenate(own), "other": np.concatenate(other), "m": np.concatenate(m), "d": np.concatenate(d)})


def _near_block(k: int):
    """Each site's ``k`` nearest others in its own block."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        A, ids, m = _matrix(pdf), pdf["id"].to_numpy(dtype=np.int64), pdf["m"].to_numpy(dtype=np.int64)
        bound = _bound(A, A, k + 1)                 # a row is its own nearest
        (i, j, d), _ = _close(A, A, bound, bound, k)
        return _found([((ids, i), (ids, m, j), d)])
    return run


def _near_cell(k: int):
    """Sites of two blocks that are nearer to each other than ``far``, ``k`` of each at most."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        if not len(left) or not len(right):
            return _found([])
        ida, ma, ta = (left[c].to_numpy(dtype=t) for c, t in (("id", np.int64), ("m", np.int64), ("far", np.float64)))
        idb, mb, tb = (right[c].to_numpy(dtype=t) for c, t in (("id", np.int64), ("m", np.int64), ("far", np.float64)))
        (i, j, d), (q, p, e) = _close(_matrix(left), _matrix(right), ta, tb, k)
        return _found([((ida, i), (idb, mb, j), d), ((idb, q), (ida, ma, p), e)])
    return run


def _neighbours(v: DataFrame, k: int, vb: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites (id, v, m: rows there), members (id, site, times) and (id, other, m, d, r): each site's
    ``k`` nearest other sites.  Vectors with a null, NaN or infinite component are at no distance."""
    some = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sites = some.groupBy("v").agg(F.count(F.lit(1)).alias("m")) \
        .withColumn("id", F.monotonically_increasing_id()).checkpoint()
    members = some.filter(F.col("id").isNotNull()).join(sites.select("v", F.col("id").alias("site")), "v") \
        .groupBy("id", "site").agg(F.count(F.lit(1)).alias("times")).checkpoint()
    w = Window.partitionBy("id").orderBy("d", "other")
    # A site's k-th nearest in its own block tells how far to look in the others.
    near = sites.withColumn("blk", _block(vb)).repartition(vb, "blk").groupBy("blk").applyInPandas(_near_block(k), _NEAR)
    if vb > 1:
        near = near.checkpoint()
        far = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")) \
            .select("id", F.when(F.col("n") == k, F.col("d")).alias("far"))
        bound = sites.join(far, "id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
        near = near.unionByName(_cells(bound, vb).filter("lb <> rb").groupBy("lb", "rb").applyInPandas(_near_cell(k), _NEAR))
    near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).checkpoint()
    return sites, members, near


def _core(sites: DataFrame, members: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    there = sites.select(F.col("id").alias("site"), F.lit(0.0).alias("d"), "m") \
        .unionByName(near.filter(F.col("r") < min_samples).select(F.col("id").alias("site"), "d", "m"))
    w = Window.partitionBy("id").orderBy("d")
    return members.join(there, "site").withColumn("so_far", F.sum(F.col("m") * F.col("times")).over(w)) \
        .filter(F.col("so_far") >= min_samples).groupBy("id").agg(F.min("d").alias("core"))


def core_distances(v: DataFrame, min_samples: int, vb: int) -> DataFrame:
    """(id, core): distance to the min_samples-th nearest point, the point itself included."""
    return _core(*_neighbours(v, max(1, min_samples - 1), vb), min_samples)


def _span(M: np.ndarray, ida: np.ndarray, idb: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest (w, lo, hi) of a tile by Prim, edges ordered by (w, lo, hi).

    ``M`` weighs the pairs of the rows ``ida`` and the columns ``idb``; without ``idb``, those of
    the rows among themselves.
    """
    ids = ida if idb is None else np.concatenate([ida, idb])
    n, na = len(ids), len(ida)
    across = None if idb is None else np.ascontiguousarray(M.T)
    best, source, free = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    w, lo, hi = [], [], []
    at = 0
    for _ in range(n):
        free[at] = False
        best[at] = np.inf
        if idb is None:
            far, row = slice(0, n), M[at]
        elif at < na:
            far, row = slice(na, n), M[at]
        else:
            far, row = slice(0, na), across[at - na]
        near = row < best[far]
        same = (row == best[far]) & np.isfinite(row)
        if same.any():                     # with one end given, the smaller other id is the smaller edge
            near |= same & (ids[at] < ids[source[far]])
        near &= free[far]
        best[far][near] = row[near]
        source[far][near] = at
        least = best.min()
        if not np.isfinite(least):         # nothing in reach: a new tree
            at = int(free.argmax())
            continue
        ends = np.flatnonzero(best == least)
        if len(ends) > 1:
            one, two = ids[ends], ids[source[ends]]
            ends = ends[np.lexsort((np.maximum(one, two), np.minimum(one, two)))]
        at = int(ends[0])
        one, two = ids[at], ids[source[at]]
        w.append(least)
        lo.append(min(one, two))
        hi.append(max(one, two))
    return np.asarray(w, dtype=np.float64), np.asarray(lo, dtype=np.int64), np.asarray(hi, dtype=np.int64)


def _forest(w: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Positions of the edges in the minimum spanning forest by (w, lo, hi) (Kruskal)."""
    ids, ends = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    one, two = ends[:len(lo)].tolist(), ends[len(lo):].tolist()
    up = list(range(len(ids)))
    kept = []
    for e in np.lexsort((hi, lo, w)).tolist():
        a, b = one[e], two[e]
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            kept.append(e)
    return np.asarray(kept, dtype=np.int64)


def _edge_cell():
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf)
        A, core_a, ida = _matrix(left), left["core"].to_numpy(), left["id"].to_numpy(dtype=np.int64)
        B, core_b, idb = _matrix(right), right["core"].to_numpy(), right["id"].to_numpy(dtype=np.int64)
        found = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]
        for i in range(0, len(A), TILE):
            for j in range(i if left is right else 0, len(B), TILE):
                r, c = slice(i, i + TILE), slice(j, j + TILE)
                M = np.maximum(_dist(A[r], B[c]), np.maximum(core_a[r][:, None], core_b[c][None, :]))
                M[~np.isfinite(M)] = np.inf
                found.append(_span(M, ida[r], None if left is right and i == j else idb[c]))
        w, lo, hi = (np.concatenate(x) for x in zip(*found))
        apart = lo != hi                   # an id may come twice
        w, lo, hi = w[apart], lo[apart], hi[apart]
        keep = _forest(w, lo, hi)
        return pd.DataFrame({"lo": lo[keep], "hi": hi[keep], "w": w[keep]})
    return run


def _resolve_parents(pairs: DataFrame) -> DataFrame:
    """(comp, target) chosen edges -> (comp, root) by breaking 2-cycles and pointer jumping."""
    p = pairs.alias("a").join(pairs.alias("b"), F.col("a.target") == F.col("b.comp"), "left") \
        .select(F.col("a.comp").alias("comp"),
                F.when((F.col("b.target") == F.col("a.comp")) & (F.col("a.comp") < F.col("a.target")),
                       F.col("a.comp")).otherwise(F.col("a.target")).alias("parent"))
    # Pointer jumping: O(log depth) joins; intermediate states are persisted (not
    # checkpointed) because the lineage stays a few joins deep.
    p = p.persist()
    held = [p]
    while True:
        j = p.alias("x").join(p.alias("y"), F.col("x.parent") == F.col("y.comp"), "left") \
            .select(F.col("x.comp").alias("comp"), F.coalesce(F.col("y.parent"), F.col("x.parent")).alias("parent"),
                    (F.coalesce(F.col("y.parent"), F.col("x.parent")) != F.col("x.parent")).alias("moved")).persist()
        held.append(j)
        if j.filter("moved").limit(1).count() == 0:
            out = j.select("comp", F.col("parent").alias("root")).checkpoint()
            for h in held:
                h.unpersist()
            return out
        p = j.select("comp", "parent")


def _lightest(A: pd.DataFrame, B: pd.DataFrame, k: int):
    """(row of A, row of B, w): each row's ``k`` lightest edges by (w, id) into other components."""
    X, Y = _matrix(A), _matrix(B)
    core_a, core_b = A["core"].to_numpy(), B["core"].to_numpy()
    comp_a, comp_b, idb = A["comp"].to_numpy(), B["comp"].to_numpy(), B["id"].to_numpy(dtype=np.int64)
    rough = _Rough(X, Y, float(np.median(np.concatenate([core_a, core_b]))) ** 2)
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    flat = (core_b * core_b * (1 - 1e-6)).astype(rough.kind)     # below a core distance, squared
    out = [none]
    for r0 in range(0, len(X), ROWS):
        r = slice(r0, min(r0 + ROWS, len(X)))
        top = np.full(r.stop - r0, np.inf)
        mine = none
        for c0 in range(0, len(Y), COLUMNS):
            c = slice(c0, min(c0 + COLUMNS, len(Y)))
            apart = comp_a[r, None] != comp_b[None, c]
            if rough.safe:
                M = rough.tile(r, c)
                np.maximum(M, flat[None, c], out=M)
                M[~apart] = np.inf
                limit = rough.limit(top, rough.slack_a[r])
                new = ~np.isfinite(limit)
                if new.any() and M.shape[1] > k:                 # the first tile says how far to look
                    rise = core_b[c].max(initial=0) ** 2 * 4e-6
                    kth = np.partition(M[new], k - 1, axis=1)[:, k - 1].astype(np.float64)
                    bound = np.sqrt(np.maximum(kth + rough.slack_a[r][new] + rise, 0))
                    limit[new] = rough.limit(np.maximum(bound, core_a[r][new]), rough.slack_a[r][new])
                apart &= M <= limit[:, None]
            at = _true(apart)
            if not len(at):
                continue
            i, j = np.divmod(at, c.stop - c0)
            i, j = i + r0, j + c0
            w = np.maximum(_gaps(X, Y, i, j), np.maximum(core_a[i], core_b[j]))
            some = (w <= top[i - r0]) & np.isfinite(w)
            if some.any():
                row, col, weight = (np.concatenate(x) for x in zip(mine, (i[some], j[some], w[some])))
                keep, last = _first(row, weight, idb[col], k)
                mine = row, col, weight = row[keep], col[keep], weight[keep]
                top[row[last] - r0] = weight[last]
        out.append(mine)
    return tuple(np.concatenate(x) for x in zip(*out))


def _search_cell(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        A, B = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        i, j, w = _lightest(A, B, k) if len(A) and len(B) else (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0),)
        return pd.DataFrame({"rid": A["rid"].to_numpy(dtype=np.int64)[i], "id": A["id"].to_numpy(dtype=np.int64)[i],
                             "other": B["id"].to_numpy(dtype=np.int64)[j], "w": w})
    return run


def _search(asking: DataFrame, all_: DataFrame, side: int, k: int) -> DataFrame:
    """(rid, id, other, w, r): the ``k`` lightest edges of each asking row into other components."""
    cores = asking.sparkSession.sparkContext.defaultParallelism
    n, m = asking.count(), all_.count()
    qb = max(1, math.ceil(n / side))
    db = max(math.ceil(m / side), min(math.ceil(m / 1024), math.ceil(4 * cores / qb)), 1)

    def dealt(df, own, mine, across, others):
        return df.withColumn(own, F.pmod(F.xxhash64("rid"), F.lit(mine)).cast("int")) \
            .withColumn(across, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    rows = dealt(asking.withColumn("asks", F.lit(True)), "qb", qb, "db", db) \
        .unionByName(dealt(all_.withColumn("asks", F.lit(False)), "db", db, "qb", qb))
    by = Window.partitionBy("rid").orderBy("w", "other")
    return rows.repartition(qb * db, "qb", "db").groupBy("qb", "db") \
        .applyInPandas(_search_cell(k), "rid bigint, id bigint, other bigint, w double") \
        .withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k).checkpoint()


def _ends(found: DataFrame, k: int) -> DataFrame:
    """(rid, b): the end of each full list; what the list does not hold comes after it."""
    return found.filter(F.col("r") == k) \
        .select("rid", F.struct("w", F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi")).alias("b"))


def _edges(found: DataFrame) -> DataFrame:
    return found.filter("id <> other").select(F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"), "w")


def mst_edges(v: DataFrame, core: DataFrame, vb: int, max_rounds: int | None = None,
              near: tuple[DataFrame, DataFrame, DataFrame] | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """Exact MST of the mutual-reachability graph: (lo, hi, w), n-1 rows.

    ``near``: what ``_neighbours`` found with at least ``k`` of each site, if it is at hand.
    """
    if vb == 1:                            # one block holds all pairs, and its forest is the tree
        return _cells(v.join(core, "id"), 1).groupBy("lb", "rb").applyInPandas(_edge_cell(), "lo bigint, hi bigint, w double")
    sites, members, near = near or _neighbours(v, k, vb)
    near = near.filter(F.col("r") <= k)
    # Points of one vector and core distance: the smallest id stands for them.  The others are
    # leaves: all their edges but the one with the smallest id at their core distance are the
    # largest of some cycle.
    points = members.join(core.filter(F.col("core") < float("inf")), "id").select("id", "site", "core")
    reps = points.groupBy("site", "core").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")) \
        .withColumn("rid", F.monotonically_increasing_id()).checkpoint()
    one, two = reps.alias("a"), reps.select(F.col("site").alias("to"), F.col("id").alias("other"), F.col("core").alias("far"))
    found = one.join(near.select(F.col("id").alias("site"), F.col("other").alias("to"), "d", "r"), "site").join(two, "to") \
        .select("rid", "id", "other", F.greatest("core", "far", "d").alias("w"))
    by = Window.partitionBy("site").orderBy("core", "id").rowsBetween(Window.unboundedPreceding, -1)
    beside = reps.withColumn("other", F.min("id").over(by)).filter(F.col("other").isNotNull()) \
        .select("rid", "id", "other", F.col("core").alias("w"))
    bounds = reps.join(near.filter(F.col("r") == k).select(F.col("id").alias("site"), F.col("d").alias("last")), "site", "left") \
        .select("rid", "id", "core", "m", F.when(F.col("last").isNotNull(), F.struct(
            F.greatest("core", "last").alias("w"), F.lit(-(1 << 63)).alias("lo"), F.lit(-(1 << 63)).alias("hi"))).alias("b")).checkpoint()
    all_ = reps.join(sites.select(F.col("id").alias("site"), "v"), "site").select("rid", "id", "v", "core")
    side = max(1, math.ceil(sites.count() / vb))

    unsure = bounds.filter((F.col("m") > 1) & (F.col("b.w") <= F.col("core"))).select("rid")
    if unsure.limit(1).count():            # as many sites at one distance as a list holds
        by_id = all_.withColumn("comp", F.col("id"))
        more = _search(by_id.join(unsure, "rid", "left_semi"), by_id, side, k)
        found = found.unionByName(more.select("rid", "id", "other", "w"))
        bounds = bounds.join(unsure, "rid", "left_anti").unionByName(
            bounds.drop("b").join(unsure, "rid", "left_semi").join(_ends(more, k), "rid", "left"))
    found = found.unionByName(beside)
    led = found.join(reps.filter("m > 1").select("rid", "core"), "rid").filter("w = core").groupBy("rid").agg(F.min("other").alias("lead"))
    leaves = reps.filter("m > 1").select("rid", "site", "core", F.col("id").alias("first")).join(led, "rid", "left") \
        .join(points, ["site", "core"]).filter("id <> first") \
        .select("id", F.least("first", "lead").alias("other"), F.col("core").alias("w"))
    left = _edges(found.select("id", "other", "w").unionByName(leaves)).distinct() \
        .withColumn("c_lo", F.col("lo")).withColumn("c_hi", F.col("hi")).checkpoint()
    at = bounds.select("rid", "id", "m", "b", F.col("id").alias("comp"))
    comps = at.groupBy("comp").agg(F.min("b").alias("b"), F.sum("m").alias("size")).checkpoint()
    edges = None
    n = comps.count()
    rounds, searched = max_rounds or 16 * max(n, 2).bit_length() + 16, False
    for _ in range(rounds):
        ends = left.select(F.explode(F.array(F.struct(F.col("c_lo").alias("comp"), F.col("c_hi").alias("target")),
                                             F.struct(F.col("c_hi").alias("comp"), F.col("c_lo").alias("target")))).alias("x"),
                           "w", "lo", "hi")
        known = ends.groupBy("x.comp").agg(F.min(F.struct("w", "lo", "hi", "x.target")).alias("e")).checkpoint()
        best = known.join(comps.select("comp", "b"), "comp", "left") \
            .filter(F.col("b").isNull() | (F.struct("e.w", "e.lo", "e.hi") <= F.col("b"))) \
            .select("comp", "e.*").checkpoint()
        chosen = best.count()
        if not searched and 8 * chosen < comps.count():
            largest = comps.orderBy(F.col("size").desc(), "comp").first()["comp"]
            # Rows whose list ends before their component's lightest known edge, no others.
            at = at.checkpoint()
            asking = at.filter(F.col("b").isNotNull() & (F.col("comp") != largest)) \
                .join(known.select("comp", F.struct("e.w", "e.lo", "e.hi").alias("e")), "comp", "left") \
                .filter(F.col("e").isNull() | (F.col("b") < F.col("e"))).select("rid").checkpoint()
            if asking.limit(1).count():
                now = all_.join(at.select("rid", "comp"), "rid").checkpoint()
                more = _search(now.join(asking, "rid", "left_semi"), now, side, k)
                where = at.select("id", "comp").distinct()
                left = left.unionByName(_edges(more).distinct()
                                        .join(where.select(F.col("id").alias("lo"), F.col("comp").alias("c_lo")), "lo")
                                        .join(where.select(F.col("id").alias("hi"), F.col("comp").alias("c_hi")), "hi")) \
                    .checkpoint()
                at = at.join(asking, "rid", "left_anti").unionByName(
                    at.drop("b").join(asking, "rid", "left_semi").join(_ends(more, k), "rid", "left")).checkpoint()
                comps = at.groupBy("comp").agg(F.min("b").alias("b"), F.sum("m").alias("size")).checkpoint()
                searched = True
                continue
        searched = False
        if not chosen:
            break
        new_edges = best.select("lo", "hi", "w").distinct()
        edges = new_edges if edges is None else edges.unionByName(new_edges)
        roots = _resolve_parents(best.select("comp", "target"))

        def moved(df, c):
            return df.join(roots.select(F.col("comp").alias(c), "root"), c, "left") \
                .withColumn(c, F.coalesce("root", c)).drop("root")
        # The lightest edge between two components is all that can be chosen of theirs.
        left = moved(moved(left, "c_lo"), "c_hi").where("c_lo <> c_hi") \
            .groupBy(F.least("c_lo", "c_hi").alias("c_lo"), F.greatest("c_lo", "c_hi").alias("c_hi")) \
            .agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("e.*", "c_lo", "c_hi").checkpoint()
        comps = moved(comps, "comp").groupBy("comp").agg(F.min("b").alias("b"), F.sum("size").alias("size")).checkpoint()
        at = moved(at, "comp")
    else:
        if left.limit(1).count():
            raise RuntimeError(f"the points are still in several components after {rounds} rounds")
    return edges if edges is not None else v.sparkSession.createDataFrame([], "lo bigint, hi bigint, w double")


def condense_and_select(edges: pd.DataFrame, n_ids: np.ndarray, min_cluster_size: int = 5,
                        max_cluster_size: int = 0, allow_single_cluster: bool = False) -> pd.DataFrame:
    """Single-linkage tree -> condensed tree -> excess-of-mass selection -> labels."""
    ids = np.sort(np.asarray(n_ids, dtype=np.int64))
    n = len(ids)
    if n == 0:
        return pd.DataFrame({"id": pd.Series([], dtype="int64"), "cluster_id": pd.Series([], dtype="int64")})
    pos = {int(x): i for i, x in enumerate(ids)}
    e = edges.sort_values(["w", "lo", "hi"])[["w", "lo", "hi"]].to_numpy()
    parent = np.arange(2 * n - 1)
    uf = list(range(2 * n - 1))
    size = np.ones(2 * n - 1, dtype=np.int64)
    left = np.full(2 * n - 1, -1)
    right = np.full(2 * n - 1, -1)
    dist = np.zeros(2 * n - 1)

    def find(x):
        while uf[x] != x:
            uf[x] = uf[uf[x]]
            x = uf[x]
        return x

    nxt = n
    for w, lo, hi in e:
        a, b = find(pos[int(lo)]), find(pos[int(hi)])
        if a == b:
            continue
        uf[a] = uf[b] = nxt
        left[nxt], right[nxt], dist[nxt] = a, b, w
        size[nxt] = size[a] + size[b]
        parent[a] = parent[b] = nxt
        nxt += 1
    root = nxt - 1 if nxt > n else 0

    # condensed tree
    lam = lambda d: np.inf if d <= 0 else 1.0 / d
    c_parent, c_child, c_lambda, c_size = [], [], [], []
    next_label = [n]
    relabel = {root: n}

    def leaves(node):
        out, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack.extend([left[x], right[x]])
        return out

    stack = [root] if root >= n else []
    while stack:
        node = stack.pop()
        lab = relabel[node]
        l_, r_ = left[node], right[node]
        lv = lam(dist[node])
        ls, rs = size[l_], size[r_]
        if ls >= min_cluster_size and rs >= min_cluster_size:
            for ch in (l_, r_):
                next_label[0] += 1
                relabel[ch] = next_label[0]
                c_parent.append(lab), c_child.append(next_label[0]), c_lambda.append(lv), c_size.append(size[ch])
                if ch >= n:
                    stack.append(ch)
                else:
                    pass
        else:
            for ch, cs in ((l_, ls), (r_, rs)):
                if cs < min_cluster_size:
                    for p in leaves(ch):
                        c_parent.append(lab), c_child.append(p), c_lambda.append(lv), c_size.append(1)
                else:
                    relabel[ch] = lab
                    if ch >= n:
                        stack.append(ch)
    # a leaf cluster created by a true split that is a single point cannot happen (size >= m >= 2)
    cp, cc, cl, cs = (np.asarray(x) for x in (c_parent, c_child, c_lambda, c_size))
    if len(cp) == 0:
        return pd.DataFrame({"id": ids, "cluster_id": np.full(n, NOISE, dtype=np.int64)})
    clusters = np.unique(cc[cc >= n].tolist() + [n]).tolist()
    cp, cc, cl, cs = (x.tolist() for x in (cp, cc, cl, cs))
    birth = {n: 0.0}
    for p_, c_, l_, s_ in zip(cp, cc, cl, cs):
        if c_ >= n:
            birth[c_] = l_
    stability = {c: 0.0 for c in clusters}
    for p_, c_, l_, s_ in zip(cp, cc, cl, cs):
        stability[p_] += (l_ - birth.get(p_, 0.0)) * s_ if math.isfinite(l_) else 0.0
    children = {c: [] for c in clusters}
    csize = {n: n}
    for p_, c_, l_, s_ in zip(cp, cc, cl, cs):
        if c_ >= n:
            children[p_].append(c_)
            csize[c_] = s_
    selected = {}
    for c in sorted(clusters, reverse=True):       # children have larger labels than parents
        kids = children[c]
        sub = sum(stability[k] for k in kids)
        too_big = max_cluster_size and csize.get(c, 0) > max_cluster_size
        if c == n and not allow_single_cluster:
            selected[c] = False
            continue
        if kids and (sub > stability[c] or too_big):
            selected[c] = False
            stability[c] = sub
        else:
            selected[c] = True
    cparent = {c_: p_ for p_, c_ in zip(cp, cc) if c_ >= n}
    # From the root down: a cluster below a selected one is part of that, at any depth.
    chosen, label_at = 0, {}
    for c in clusters:
        label_at[c] = label_at[cparent[c]] if c in cparent else NOISE
        if selected[c] and label_at[c] == NOISE:
            label_at[c] = chosen
            chosen += 1
    point_cluster = {c_: p_ for p_, c_ in zip(cp, cc) if c_ < n}
    labels = np.full(n, NOISE, dtype=np.int64)
    for i, c in point_cluster.items():
        labels[i] = label_at[c]
    return pd.DataFrame({"id": ids, "cluster_id": labels})


def hdbscan(vec: DataFrame, min_cluster_size: int = 5, min_samples: int = 3,
            max_cluster_size: int = 0, id_col: str = "log_id", vb: int | None = None,
            block_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """(log_id, cluster_id) with noise = -1."""
    ensure = vec.sparkSession.sparkContext.getCheckpointDir()
    if not ensure:
        from ..session import ensure_checkpoint_dir
        ensure_checkpoint_dir(vec.sparkSession)
    # Materialised once (shared checkpoint dir): several steps read the vectors.
    kind = vec.schema["embedding"].dataType.simpleString()
    v = valid_vectors(vec).select(F.col(id_col).alias("id"), F.col("embedding").cast(
        kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v")).checkpoint()
    if vb is None:
        d = len(v.select("v").first()[0]) if v.limit(1).count() else 1
        # A block of doubles is what has to fit; fewer points still give every core some cells.
        side = max(1, min(block_bytes // (8 * d), BLOCK_MOST))
        n, cores = v.count(), vec.sparkSession.sparkContext.defaultParallelism
        vb = max(1, math.ceil(n / side), min(math.ceil(n / BLOCK_LEAST), math.isqrt(32 * cores)))
    near = _neighbours(v, max(NEIGHBOURS, min_samples - 1), vb)
    core = _core(*near, min_samples).checkpoint()
    edges = mst_edges(v, core, vb, near=near)
    ids = v.select("id")
    # one group: the n - 1 edges plus the id list (bounded by the run's input size)
    allg = edges.select(F.lit(0).alias("g"), "lo", "hi", "w", F.lit(None).cast("bigint").alias("pid")) \
        .unionByName(ids.select(F.lit(0).alias("g"), F.lit(None).cast("bigint").alias("lo"),
                                F.lit(None).cast("bigint").alias("hi"), F.lit(None).cast("double").alias("w"),
                                F.col("id").alias("pid")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf["pid"].isna()][["lo", "hi", "w"]].astype({"lo": "int64", "hi": "int64"})
        p = pdf["pid"].dropna().astype("int64").to_numpy()
        return condense_and_select(e, p, min_cluster_size, max_cluster_size)
    out = allg.groupBy("g").applyInPandas(run, "id bigint, cluster_id bigint")
    return out.withColumnRenamed("id", id_col)
