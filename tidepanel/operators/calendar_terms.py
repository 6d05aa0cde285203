"""Calendar terms over scaled mean reversion: what kind of day the target is moves its law by scale units.

Terms are flags of the target's day, known from the calendar beforehand; a scheduled settlement is public on the day before
and so enters at lead 1 only. A pair's response is its residual over the scale at its origin; the fitted terms, without the constant,
are taken out of the pool and put back, times the anchor's scale, at the forecast. With ``interact`` each term stands there a second
time, multiplied by the state (0 to 1) of the pair's own decision day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Tables
from . import benchmarks, calendars, regression, scaled_pools
from .scores import levels

#: A term of fewer pairs than this has no effect.
LEAST_FLAGGED = 3
#: Fixed value: the highest scarcity state; states are divided by it.
STATES = 3


@dataclass(frozen=True)
class Arm:
    """One way to fit: least squares or Huber's, the penalty on the terms, and whether the state multiplies them."""

    robust: bool = False
    penalty: float = 1.0
    interact: bool = False


def flags(panel: DataFrame) -> DataFrame:
    """pos, date and the terms of every row as numbers 0 and 1; coupon is null where no settlement is known."""
    typed = calendars.calendar_columns(panel)
    business = calendars.business_days(panel.sparkSession).select(F.col("day").alias("date"), "k", "e")
    typed = typed.join(business, "date", "left")
    terms = {
        "month_end": F.coalesce(F.col("e") <= 2, F.lit(False)),
        "quarter_end": F.coalesce((F.col("e") == 1) & (F.month("date") % 3 == 0), F.lit(False)),
        "tax_date": calendars.tax_day(F.col("date")),
        "late_teens": F.dayofmonth("date").between(19, 23),
        "month_start": F.coalesce(F.col("k") <= 3, F.lit(False)),
        "coupon": F.col("coupons") > 0,
    }
    return typed.select("pos", *(t.cast("double").alias(name) for name, t in terms.items()))


TERMS = ["month_end", "quarter_end", "tax_date", "late_teens", "month_start", "coupon"]
#: Terms that are known a day ahead only.
SCHEDULED = ["coupon"]


def read_at(lead: Column) -> list[Column]:
    """The terms as a forecast of that lead can read them: what is not yet public, or not known, is 0."""
    return [F.when((lead == 1) if t in SCHEDULED else F.lit(True), F.coalesce(t, F.lit(0.0))).otherwise(0.0).alias(t) for t in TERMS]


def columns(arm: Arm, enters: Column | None = None) -> Column:
    """The regressors: the constant, the terms that enter, and these times the state, 0 where it is unknown."""
    own = [F.col(t) if enters is None else F.when(F.get(enters, F.lit(i)), F.col(t)).otherwise(0.0) for i, t in enumerate(TERMS)]
    more = [c * F.coalesce("state", F.lit(0.0)) for c in own] if arm.interact else []
    return F.array(F.lit(1.0), *own, *more)


def training(tables: Tables, fitted: benchmarks.Refits, scale: DataFrame, days: DataFrame, states: DataFrame, arm: Arm) -> DataFrame:
    """block, lead, x and y of the pairs whose origin has a scale, written; terms with few flagged pairs are 0 throughout."""
    lag = F.col("k") - F.col("lead")
    pairs = scaled_pools.standardised(fitted, scale).select("block", "lead", "origin", "target", "z", (F.col("origin") + lag).alias("decision"))
    pairs = pairs.join(days.withColumnRenamed("pos", "target"), "target").join(states.withColumnRenamed("pos", "decision"), "decision", "left")
    read = pairs.select("block", "lead", "z", "state", *read_at(F.col("lead")))
    counts = read.groupBy("block", "lead").agg(F.array(*(F.sum(t) >= LEAST_FLAGGED for t in TERMS)).alias("enters"))
    return tables.keep(read.join(counts, ["block", "lead"]).select("block", "lead", columns(arm, F.col("enters")).alias("x"), F.col("z").alias("y")), "training")


def effects(tables: Tables, rows: DataFrame, arm: Arm) -> DataFrame:
    """block, lead, n, b and rounds: the fitted constant and terms of every refit and lead."""
    size = 1 + len(TERMS) * (2 if arm.interact else 1)
    if arm.robust:
        return regression.huber(tables, rows, ["block", "lead"], size, arm.penalty)
    return regression.ridge(rows, ["block", "lead"], size, arm.penalty).withColumn("rounds", F.lit(0))


def shift(b: Column, x: Column) -> Column:
    """The terms' part of a fit: all but the constant."""
    return regression.dot(b, x) - F.get(b, F.lit(0)) * F.get(x, F.lit(0))


def terms_walk(panel: DataFrame, states: DataFrame, arm: Arm = Arm(), variant: scaled_pools.Variant = scaled_pools.VARIANTS[0], every: int = 21, years: int = 2, least: int = 60) -> DataFrame:
    """decision, lead, fitted, scale, shift, b, rounds and q of every decision.

    panel has coupons (a settlement's size, null if unknown); states: pos and state, what a decision on that row could read.
    """
    tables = Tables(panel.sparkSession)
    fitted = benchmarks.refits(tables, panel.drop("coupons"), every, years, least)
    scale = tables.keep(scaled_pools.scales(panel, (variant,)), "scales")
    days, states = tables.keep(flags(panel), "flags"), tables.keep(states.select("pos", "state"), "states")
    rows = training(tables, fitted, scale, days, states, arm)
    b = tables.keep(effects(tables, rows, arm), "effects")
    left = rows.join(b.select("block", "lead", "b"), ["block", "lead"]).withColumn("left", F.col("y") - shift(F.col("b"), F.col("x")))
    pools = left.groupBy("block", "lead").agg(F.percentile("left", levels()).alias("pool"))
    now = benchmarks.centres(fitted).join(scale.select(F.col("pos").alias("anchor"), "scale"), "anchor").withColumn("pos", F.col("decision") + F.col("lead"))
    now = now.join(days, "pos").drop("pos").join(states.withColumnRenamed("pos", "decision"), "decision", "left")
    now = now.withColumns({t: c for t, c in zip(TERMS, read_at(F.col("lead")))}).withColumn("x", columns(arm))
    found = now.join(b, ["block", "lead"]).join(pools, ["block", "lead"]).withColumn("shift", shift(F.col("b"), F.col("x")))
    q = F.transform("pool", lambda z: F.col("centre") + F.col("scale") * (F.col("shift") + z))
    return found.select("decision", "lead", "fitted", "scale", "shift", "b", "rounds", q.alias("q"))
