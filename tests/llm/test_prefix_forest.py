import math

import numpy as np
import pytest

from logweave.llm import prefix_forest as forest

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def brute(rows, k=20, every=20):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
            if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            scored = {(i, math.fsum((a * b).tolist())) for i, b in good if i != q}
            out[q] = sorted(scored, key=lambda x: (-x[1], x[0]))[:k]
    return out


def vectors(n, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.standard_normal(16) * rng.uniform(0.5, 2)).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(copies)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", "s") for i, v in rows], SCHEMA).repartition(3)


def listed(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(found)] for q, found in out.items()}


ODD = [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] + [1.0] * 15), (5080, [float("inf")] * 16),
       (5100, [None] + [1.0] * 15), (5120, [1.0] * 3), (None, [1.0] * 16)]


def test_all_candidates_give_the_exact_answer(spark):
    rows = vectors(300, 1, copies=90) + ODD
    rows += [rows[3], rows[40], rows[40]]
    got = listed(forest.neighbours(frame(spark, rows), shard=128, block=7, enough=10 ** 9, trees=2))
    assert got == brute(rows)


def test_few_candidates_than_neighbours_and_empty(spark):
    rows = vectors(5, 2)
    assert listed(forest.neighbours(frame(spark, rows))) == brute(rows)
    assert forest.neighbours(frame(spark, [(1, [1.0] * 16)]).where("vec_id < 0")).collect() == []
    assert forest.neighbours(frame(spark, [(20, [1.0] * 16)])).collect() == []


def test_ascent_gives_the_deepest_common_depth_with_enough():
    rng = np.random.default_rng(4)
    data, queries = rng.standard_normal((400, 8)), rng.standard_normal((9, 8))
    longest = float(np.linalg.norm(data, axis=1).max())
    index = forest.Forest(data, longest, trees=3, bits=20, seed=1)
    extra = np.sqrt(np.maximum(longest ** 2 - (data ** 2).sum(1), 0))
    mine = forest.hash_strings(np.column_stack([data, extra]), 3, 20, 1)
    theirs = forest.hash_strings(np.column_stack([queries, np.zeros(9)]), 3, 20, 1)
    got = dict(index.candidates(queries, 60))
    for q in range(9):
        for depth in range(20, -1, -1):
            hits = [{i for i in range(400) if int(m[i]) >> (20 - depth) == int(t[q]) >> (20 - depth)} for m, t in zip(mine, theirs)]
            if sum(map(len, hits)) >= 60 or depth == 0:
                break
        assert set(got[q].tolist()) == set().union(*hits)


def test_recall_on_the_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    got = listed(forest.neighbours(table, shard=1000))
    vectors = np.array([r.embedding for r in rows], dtype=float)
    ids = np.array([r.vec_id for r in rows])
    hits = []
    for q, found in got.items():
        scores = vectors @ vectors[ids == q][0]
        scores[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -scores))[:20]].tolist())
        hits.append(len(want & {i for i, _ in found}) / 20)
    assert len(hits) == 100 and np.mean(hits) >= 0.9


@pytest.mark.parametrize("copies", [3000])
def test_a_vector_that_many_rows_share_is_indexed_once(spark, copies):
    rows = vectors(50, 6, copies)
    index = forest.distinct_vectors(forest.sound(frame(spark, rows)), 21).collect()
    assert len(index) == 50 and max(len(r.ids) for r in index) == 21
