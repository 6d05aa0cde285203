"""Mean reversion to a level: the rate of decay by grid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs(panel: DataFrame, leads: list[int]) -> DataFrame:
    """k, x and y: distances from today's level, now and k rows on, for rows with a level."""
    order = Window.orderBy("pos")
    ahead = [F.struct(F.lit(k).alias("k"), F.lead("spread", k).over(order).alias("later")) for k in leads]
    each = panel.withColumn("ahead", F.array(*ahead)).filter("level is not null").select("spread", "level", F.inline("ahead"))
    return each.filter("later is not null").select("k", (F.col("spread") - F.col("level")).alias("x"), (F.col("later") - F.col("level")).alias("y"))


def fit_phi(pairs: DataFrame, least: int = 60) -> DataFrame:
    """k, n, phi and loss: the phi of 0, 0.01 .. 1 of least squared error of y by phi^k x; the smaller on ties.

    The error is a polynomial of three sums, so the grid needs no row of its own: one
    partial aggregate a lead, whatever the number of pairs.
    """
    sums = pairs.groupBy("k").agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy"))).filter(F.col("n") >= least)

    def error(i):
        d = F.pow(i / 100, F.col("k"))
        return F.struct(F.round(F.col("yy") - 2 * d * F.col("xy") + d * d * F.col("xx"), 4).alias("loss"), (i / 100).alias("phi"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(100)), error))
    return sums.withColumn("best", best).select("k", "n", F.col("best.phi").alias("phi"), F.col("best.loss").alias("loss"))
