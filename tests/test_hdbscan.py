import numpy as np
from pyspark.sql import functions as F

from logweave.operators import hdbscan as H


def _prim_weight(X, core):
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    M = np.maximum(D, np.maximum(core[:, None], core[None, :]))
    seen = np.zeros(n, bool)
    seen[0] = True
    best = M[0].copy()
    total = 0.0
    for _ in range(n - 1):
        best[seen] = np.inf
        j = int(np.argmin(best))
        total += best[j]
        seen[j] = True
        best = np.minimum(best, M[j])
    return total


def test_hdbscan_blobs(spark):
    rng = np.random.default_rng(1)
    X = np.vstack([rng.normal(0, 0.3, (30, 4)), rng.normal(5, 0.3, (40, 4)), np.array([[20, 20, 20, 20.0],
                                                                                       [-20, 0, 0, 0], [0, 30, 0, 0]])])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(X)], "log_id long, embedding array<double>")
    v = df.select(F.col("log_id").alias("id"), F.col("embedding").alias("v"))
    core = {r.id: r.core for r in H.core_distances(v, 3, 3).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    want_core = np.sort(D, axis=1)[:, 2]
    assert np.allclose([core[i] for i in range(len(X))], want_core)
    edges = H.mst_edges(v, H.core_distances(v, 3, 3), 3).toPandas()
    assert len(edges) == len(X) - 1
    assert abs(edges["w"].sum() - _prim_weight(X, want_core)) < 1e-9
    labels = {r.log_id: r.cluster_id for r in H.hdbscan(df, 5, 3, vb=3).collect()}
    a, b = {labels[i] for i in range(30)}, {labels[i] for i in range(30, 70)}
    assert len(a) == 1 and len(b) == 1 and a != b and -1 not in a | b
    assert labels[70] == labels[71] == labels[72] == -1


def test_tiny_inputs_and_duplicates(spark):
    schema = "log_id long, embedding array<double>"
    for n in (0, 1, 2):
        df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], schema)
        assert sorted((r.log_id, r.cluster_id) for r in H.hdbscan(df).collect()) == [(i, -1) for i in range(n)]
    a = np.random.default_rng(0).standard_normal((40, 6)) * 1e3
    assert (H._dist(a, a).diagonal() == 0).all() and (H._dist(a, a[::-1]) == H._dist(a[::-1], a).T).all()


def test_cells_hold_every_pair_once_and_their_forests_the_tree(spark):
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(0, 1, (60, 3)) * 2) / 2           # many equal distances
    X[40:50] = X[0]
    ids = rng.permutation(1000)[:60].astype(np.int64)
    v = spark.createDataFrame([(int(i), [float(x) for x in r]) for i, r in zip(ids, X)], "id long, v array<double>")
    cells = [(r.id, r.blk, r.lb, r.rb) for r in H._cells(v, 4).select("id", "blk", "lb", "rb").collect()]
    assert len(cells) == 60 * 4 and all(lb <= rb and blk in (lb, rb) for _, blk, lb, rb in cells)

    D = H._dist(X, X)
    core = np.sort(D, axis=1)[:, 2]
    near = np.concatenate([H._nearest(X, X[:25], 3), H._nearest(X, X[25:], 3)], axis=1)
    assert (np.sort(near, axis=1)[:, 2] == core).all()
    M = np.maximum(D, np.maximum(core[:, None], core[None, :]))
    i, j = np.triu_indices(60, 1)
    w, lo, hi = M[i, j], np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    want = {(w[e], lo[e], hi[e]) for e in H._forest(w, lo, hi)}
    assert len(want) == 59 and set(zip(*H._span(M, ids, None))) == want
    parts = [H._span(M[:25, :25], ids[:25], None), H._span(M[25:, 25:], ids[25:], None),
             H._span(M[:25, 25:], ids[:25], ids[25:])]
    w, lo, hi = (np.concatenate(x) for x in zip(*parts))
    assert {(w[e], lo[e], hi[e]) for e in H._forest(w, lo, hi)} == want
    got = H.mst_edges(v, H.core_distances(v, 3, 4), 4).collect()
    assert {(r.w, r.lo, r.hi) for r in got} == want and len(got) == 59


def test_close_looks_at_few_pairs_exactly_and_finds_the_nearest(monkeypatch):
    rng = np.random.default_rng(7)
    X = rng.normal(0, 1, (3000, 16))
    X[100:140] = np.round(X[100:140])                         # equal distances
    X[200:230] = X[200:230] * 1e-4 + 3                        # close together, far from zero
    A, B = X[:1300], X[1300:]
    seen, gaps = [], H._gaps
    monkeypatch.setattr(H, "_gaps", lambda a, b, i, j: seen.append(len(i)) or gaps(a, b, i, j))
    D = H._dist(A, B)
    (i, j, d), (q, p, e) = H._close(A, B, H._bound(A, B, 4), H._bound(B, A, 4), 4)
    assert (d == D[i, j]).all() and (e == D[p, q]).all()
    assert (d.reshape(-1, 4) == np.sort(D, axis=1)[:, :4]).all() and (i.reshape(-1, 4) == np.arange(1300)[:, None]).all()
    assert (e.reshape(-1, 4) == np.sort(D.T, axis=1)[:, :4]).all() and (q.reshape(-1, 4) == np.arange(1700)[:, None]).all()
    assert sum(seen) < D.size / 10
    far = np.full(1300, np.inf)                               # without a bound, and beyond what squares can hold
    (i, j, d), _ = H._close(A, A, far, far, 4)
    assert (d.reshape(-1, 4) == np.sort(H._dist(A, A), axis=1)[:, 1:5]).all() and (i != j).all()
    big = A[:40] * 1e160
    with np.errstate(over="ignore", invalid="ignore"):
        assert not len(H._close(big, big, far[:40], far[:40], 4)[0][0])


def test_tree_from_neighbours_is_the_tree_of_all_pairs(spark):
    rng = np.random.default_rng(11)
    X = np.vstack([rng.normal(0, .02, (40, 3)) + c for c in rng.normal(0, 3, (4, 3))])   # clusters wider than a list
    X = np.vstack([X, np.round(rng.normal(0, 1, (50, 3))), np.full((9, 3), 2.0), np.full((2, 3), -4.0)])
    ids = [int(x) for x in rng.permutation(1000)[:len(X)]]
    rows = [(i, [float(x) for x in r]) for i, r in zip(ids, X)]
    rows += [(ids[3], [9.0, 9.0, 9.0]), (ids[170], [2.0, 2.0, 2.0]), (ids[5], rows[5][1])]        # ids that repeat
    rows += [(None, rows[0][1]), (None, [9.0, 9.0, 9.1]), (2000, [float("nan"), 0.0, 1.0]), (2001, [None, 1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, v array<double>")

    good = [(i, r) for i, r in rows if i not in (2000, 2001)]
    P = np.array([r for _, r in good])
    D = H._dist(P, P)
    near = {}
    for (i, _), d in zip(good, D):
        near.setdefault(i, []).extend(d)
    core = {i: sorted(d)[2] for i, d in near.items() if i is not None}
    got = H.core_distances(v, 3, 3)
    assert {r.id: r.core for r in got.collect()} == core
    at = [n for n, (i, _) in enumerate(good) if i is not None]
    own = np.array([good[n][0] for n in at])
    c = np.array([core[i] for i in own])
    M = np.maximum(D[np.ix_(at, at)], np.maximum(c[:, None], c[None, :]))
    a, b = np.nonzero(own[:, None] < own[None, :])
    w, lo, hi = M[a, b], own[a], own[b]
    want = {(w[e], lo[e], hi[e]) for e in H._forest(w, lo, hi)}
    assert len(want) == len(core) - 1
    assert {(r.w, r.lo, r.hi) for r in H.mst_edges(v, got, 3, k=2).collect()} == want


def test_selection_in_a_deep_chain_of_clusters():
    n = 5000                                                  # groups of five that join one after the other
    at = np.arange(n - 1)
    w = np.where(at % 5 == 4, 1.0 + at // 5, 0.5 + at % 5 * 0.01)
    edges = H.pd.DataFrame({"lo": at, "hi": at + 1, "w": w})
    labels = H.condense_and_select(edges, np.arange(n), 5)["cluster_id"].to_numpy()
    assert (labels.reshape(-1, 5) == labels[::5, None]).all()
    assert sorted(set(labels.tolist())) == list(range(n // 5))
