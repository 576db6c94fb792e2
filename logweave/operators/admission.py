"""Daily-budget admission of whole batches (E4, B32), for days of any size.

A batch is admitted if spent(day) + estimate <= budget; a rejected batch adds nothing, so a day is a
sequential fold over its batches.  What the fold carries from one batch to the next is a
single number, so a day is cut into blocks of ``BLOCK`` batches in order and only that number crosses
blocks.  Most blocks need no fold: the room only shrinks, so a block whose sum fits is admitted
whole and one whose cheapest batch does not fit is rejected whole, both told from its sums (added up
in another order than one by one, so spent sums agree to rounding).  The
other blocks are folded one after the other within a day, those of all days at once, each in one
bounded task that returns its last spent sum.  At the end all blocks are replayed in parallel from
what was spent before them.

Building the plan runs these jobs; the driver holds one row a block.  No list of a day is built.

Batches with a null day, or a null or negative estimate, are not admitted and cost nothing; ties in
``batch_no`` are taken in order of their estimate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .numbering import number_rows

BLOCK = 1 << 16
BUDGET_WARNING_SHARE = 0.8
#: Block sums are added up in another order than a fold would; only sums clearly below the room settle a block.
MARGIN = 1e-9


def fold(costs: np.ndarray, spent: float, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """(admitted, spent after) of each batch in order; ``spent`` is the sum before the first."""
    admitted = np.zeros(len(costs), bool)
    after = np.empty(len(costs))
    at = 0
    while at < len(costs):
        # As long as all fit, the sums are running sums; the first that passes the budget is rejected.
        sums = np.cumsum(np.concatenate([[spent], costs[at:]]))[1:]
        fits = int(np.argmax(sums > budget)) if sums[-1] > budget else len(sums)
        admitted[at:at + fits] = True
        after[at:at + fits] = sums[:fits]
        if fits:
            spent = float(sums[fits - 1])
        at += fits
        # Batches too dear for the room that is left stay rejected: skip to the next that fits.
        rest = np.flatnonzero(spent + costs[at:] <= budget)
        skip = int(rest[0]) if len(rest) else len(costs) - at
        after[at:at + skip] = spent
        at += skip
    return admitted, after


def _advance(blocks: list, at: int, spent: float, budget: float, entry: dict) -> int:
    """Pass the blocks that their sums settle, noting what was spent before each; the first that needs a fold."""
    while at < len(blocks):
        b = blocks[at]
        entry[b["day"], b["block"]] = spent
        if spent + b["total"] * (1 + MARGIN) <= budget:
            spent += b["total"]
        elif spent + b["cheapest"] <= budget:
            break
        at += 1
    return at


def _entries(blocks: DataFrame, rows: DataFrame, budget: float, spent_by_day: dict) -> dict:
    """What was spent before each block: {(day, block): sum}."""
    days: dict = {}
    for b in sorted(blocks.collect(), key=lambda b: (str(b["day"]), b["block"])):  # one row a block
        days.setdefault(b["day"], []).append(b)
    entry: dict = {}
    open_days = {day: _advance(bs, 0, spent_by_day.get(day, 0.0), budget, entry) for day, bs in days.items()}
    spark = rows.sparkSession

    def last_sum(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_no")
        _, after = fold(part["_cost"].to_numpy(), float(part["_spent"].iloc[0]), budget)
        return pd.DataFrame({"day": part["day"].iloc[:1], "spent": [after[-1]]})

    while open_days := {day: at for day, at in open_days.items() if at < len(days[day])}:
        wanted = [(day, days[day][at]["block"], entry[day, days[day][at]["block"]]) for day, at in open_days.items()]
        picked = spark.createDataFrame(wanted, _typed(rows, "block bigint, _spent double"))
        kind = rows.schema["day"].dataType.simpleString()
        done = rows.join(picked, ["day", "block"]).groupBy("day").applyInPandas(last_sum, f"day {kind}, spent double")
        for row in done.collect():  # one row a day
            day = row["day"]
            open_days[day] = _advance(days[day], open_days[day] + 1, row["spent"], budget, entry)
    return entry


def _typed(rows: DataFrame, rest: str) -> str:
    return f"day {rows.schema['day'].dataType.simpleString()}, {rest}"


def admit(batches: DataFrame, daily_budget_usd: float, spent: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``batches(day, batch_no, est_cost_usd, ...)`` with ``admitted``, ``spent_before``, ``spent_after`` and
    ``warning`` (at least 80 % of the budget used).  ``spent(day, spent_usd)`` is what a day has used already."""
    budget = float(daily_budget_usd)
    sound = F.col("day").isNotNull() & F.col("est_cost_usd").isNotNull() & (F.col("est_cost_usd") >= 0)
    numbered = number_rows(batches.where(sound), ["batch_no", "est_cost_usd"], ["day"])
    rows = numbered.withColumn("block", F.floor((F.col("row_no") - 1) / block).cast("bigint")) \
        .withColumn("_cost", F.col("est_cost_usd").cast("double"))
    blocks = rows.groupBy("day", "block").agg(F.sum("_cost").alias("total"), F.min("_cost").alias("cheapest"))
    before = {r["day"]: float(r["spent_usd"]) for r in spent.where("spent_usd is not null").collect()} if spent is not None else {}
    entry = _entries(blocks, rows, budget, before)
    spark = batches.sparkSession
    starts = spark.createDataFrame([(day, b, s) for (day, b), s in entry.items()], _typed(rows, "block bigint, _spent double"))
    joined = rows.join(starts, ["day", "block"])
    names = [*batches.columns, "admitted", "spent_before", "spent_after"]
    schema = joined.select(*batches.columns, F.lit(True).alias("admitted"), F.lit(0.0).alias("spent_before"),
                           F.lit(0.0).alias("spent_after")).schema

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row_no")
        costs = part["_cost"].to_numpy()
        admitted, after = fold(costs, float(part["_spent"].iloc[0]), budget)
        earlier = np.concatenate([[part["_spent"].iloc[0]], after[:-1]])
        return part.assign(admitted=admitted, spent_before=earlier, spent_after=after)[names]

    told = joined.groupBy("day", "block").applyInPandas(replay, schema)
    zero = F.lit(0.0)
    left = batches.where(~F.coalesce(sound, F.lit(False))).select(
        *batches.columns, F.lit(False).alias("admitted"), zero.alias("spent_before"), zero.alias("spent_after"))
    return told.unionByName(left).withColumn("warning", F.col("spent_after") >= F.lit(budget * BUDGET_WARNING_SHARE))
