import numpy as np
import pytest

from logweave.operators import anomaly as A
from logweave.operators import population as P


def told(df):
    return df.first().asDict()


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v], "ERROR") for i, v in enumerate(x)],
                                 "log_id bigint, embedding array<double>, level string")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return np.vstack([rng.normal(5, 1, (150, 6)), rng.normal(-2, 4, (30, 6))])


def check(got, x, center):
    d = np.linalg.norm(x - center, axis=1)
    mean = x.mean(axis=0)
    assert got["n"] == len(x)
    np.testing.assert_allclose(got["mean"], mean, rtol=1e-12)
    np.testing.assert_allclose(got["scatter"], ((x - mean) ** 2).sum(), rtol=1e-11)
    np.testing.assert_allclose(got["distance_mean"], d.mean(), rtol=1e-12)
    np.testing.assert_allclose(got["distance_m2"] / len(x), d.var(), rtol=1e-10)


def test_merged_parts_are_the_whole(spark, data):
    first = P.moments(vectors(spark, data[:70]))
    held = first
    for part in (data[70:71], data[71:]):
        held = P.merge(held, P.moments(vectors(spark, part), first))
    check(told(held), data, data[:70].mean(axis=0))
    assert told(held)["refreshed_n"] == 70
    check(told(P.refresh(vectors(spark, data))), data, data.mean(axis=0))


def test_empty_populations_change_nothing(spark, data):
    some = P.moments(vectors(spark, data))
    none = P.moments(vectors(spark, data).limit(0), some)
    assert told(none)["n"] == 0
    assert told(P.merge(some, none)) == told(some) == told(P.merge(P.empty(spark), some))


def test_scores_are_those_of_the_whole_scan(spark, data):
    vec = vectors(spark, data)
    got = {r.log_id: (r.anomaly_score, r.is_anomaly) for r in P.score(vec, P.refresh(vec)).collect()}
    want = A.score_logs(vec, vec, None, "zscore").collect()
    assert len(want) == len(data) and any(r.is_anomaly for r in want)
    for r in want:
        assert got[r.log_id][1] == r.is_anomaly and abs(got[r.log_id][0] - r.anomaly_score) < 1e-9


def test_no_spread_gives_no_score(spark, data):
    vec = vectors(spark, np.ones((3, 4)))
    assert {(r.anomaly_score, r.is_anomaly) for r in P.score(vec, P.refresh(vec)).collect()} == {(None, None)}
    one = vectors(spark, data[:1])
    assert [r.anomaly_score for r in P.score(one, P.refresh(one)).collect()] == [None]


def test_refresh_is_due_by_growth():
    assert not P.due({"n": 0, "refreshed_n": 0}, 0.1) and P.due({"n": 5, "refreshed_n": 0}, 0.1)
    assert P.due({"n": 101, "refreshed_n": 100}, 0.0) and not P.due({"n": 100, "refreshed_n": 100}, 0.0)
    assert not P.due({"n": 110, "refreshed_n": 100}, 0.1) and P.due({"n": 111, "refreshed_n": 100}, 0.1)


def test_scoring_reads_only_the_new_vectors(spark, data):
    held = spark.createDataFrame([tuple(P.refresh(vectors(spark, data)).first())], P.SCHEMA)
    plan = P.score(vectors(spark, data[:5]), held)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
