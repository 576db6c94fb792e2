import datetime as dt
import random

import numpy as np
import pytest

from logweave.operators import admission as AD

SCHEMA = "day date, batch_no bigint, est_cost_usd double, admitted string"


def plain(costs, spent, budget):
    out = []
    for c in costs:
        ok = spent + c <= budget
        out.append((ok, spent, spent + c if ok else spent))
        spent = out[-1][2]
    return out


@pytest.mark.parametrize("seed", range(30))
def test_fold_is_sequential(seed):
    rng = random.Random(seed)
    costs = [rng.choice([0, 1, 2, 7, 30, 500]) * 0.25 for _ in range(rng.randrange(1, 80))]
    budget = rng.choice([1.0, 9.0, 40.0, 100.0])
    admitted, after = AD.fold(np.array(costs), 1.0, budget)
    want = plain(costs, 1.0, budget)
    assert admitted.tolist() == [w[0] for w in want] and after.tolist() == [w[2] for w in want]


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_days_in_blocks_against_the_sequential_fold(spark, block):
    rng = random.Random(block)
    days = {dt.date(2024, 1, d): [rng.choice([1, 2, 3, 8, 21]) * 0.5 for _ in range(rng.randrange(1, 25))] for d in range(1, 6)}
    spent = {dt.date(2024, 1, 2): 18.0, dt.date(2024, 1, 9): 3.0}
    rows = [(d, i, c, "x") for d, costs in days.items() for i, c in enumerate(costs)]
    rng.shuffle(rows)
    batches = spark.createDataFrame([r[:3] for r in rows], "day date, batch_no bigint, est_cost_usd double")
    held = spark.createDataFrame([*spent.items(), (None, None)], "day date, spent_usd double")
    got = {(r.day, r.batch_no): (r.admitted, r.spent_before, r.spent_after, r.warning)
           for r in AD.admit(batches, 20.0, held, block=block).collect()}
    want = {(d, i): (*w, w[2] >= 16.0) for d, costs in days.items() for i, w in enumerate(plain(costs, spent.get(d, 0.0), 20.0))}
    assert got == want


def test_odd_rows_and_empty(spark):
    day = dt.date(2024, 1, 1)
    rows = [(day, 1, None), (None, 2, 1.0), (day, 3, -1.0), (day, 4, 1.0), (day, 4, 2.0)]
    batches = spark.createDataFrame(rows, "day date, batch_no bigint, est_cost_usd double")
    got = sorted(((r.batch_no, r.est_cost_usd, r.admitted, r.spent_after) for r in AD.admit(batches, 2.5).collect()), key=str)
    assert got == [(1, None, False, 0.0), (2, 1.0, False, 0.0), (3, -1.0, False, 0.0), (4, 1.0, True, 1.0), (4, 2.0, False, 1.0)]
    assert AD.admit(batches.limit(0), 1.0).collect() == []


def test_a_day_of_a_million_batches(spark):
    n = 1_000_000
    costs = ((np.arange(n) * 2654435761) % 97 + 1) / 64
    batches = spark.range(n).selectExpr("DATE'2024-01-01' AS day", "id AS batch_no", "(pmod(id * 2654435761, 97) + 1) / 64D AS est_cost_usd")
    budget = float(costs.sum() * 0.4)
    rows = AD.admit(batches, budget).agg({"admitted": "count", "spent_after": "max"}).first()
    admitted = AD.admit(batches, budget).where("admitted").count()
    want, after = AD.fold(costs, 0.0, budget)
    sequential = 0.0
    for c in costs.tolist():
        if sequential + c <= budget:
            sequential += c
    assert rows["count(admitted)"] == n and admitted == int(want.sum())
    assert rows["max(spent_after)"] == after[-1] == sequential
