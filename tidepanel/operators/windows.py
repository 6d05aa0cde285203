"""Trailing windows, islands, ranks and event flags over a panel (pos, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_pos():
    return Window.orderBy("pos")



def rows(a: int, b: int):
    return by_pos().rowsBetween(a, b)


def full(value: Column, counted: Column, n: int, a: int, b: int = 0) -> Column:
    """value where all n rows of the frame have counted, else null."""
    return F.when(F.count(counted).over(rows(a, b)) == n, value)


def change(c: str, n: int) -> Column:
    return F.col(c) - F.lag(c, n).over(by_pos())


def realised_vol(panel: DataFrame, c: str, n: int) -> DataFrame:
    """Sample deviation of the last n one-row changes; null if one is missing."""
    d = panel.withColumn("d", change(c, 1))
    return d.withColumn("vol", full(F.stddev_samp("d").over(rows(1 - n, 0)), F.col("d"), n, 1 - n)).drop("d")


def mad_scale(panel: DataFrame, c: str, n: int = 20, floor: float = 0.5) -> DataFrame:
    """max(floor, 1.4826 * median of the last n absolute changes)."""
    d = panel.withColumn("d", F.abs(change(c, 1)))
    median = F.percentile("d", F.lit(0.5)).over(rows(1 - n, 0))
    return d.withColumn("scale", full(F.greatest(F.lit(floor), 1.4826 * median), F.col("d"), n, 1 - n)).drop("d")


def ewma_scale(panel: DataFrame, c: str, n: int = 40, half_life: float = 10.0, asym: float = 0.5) -> DataFrame:
    """sqrt(pi/2) times the weighted mean of absolute changes, rises weighted by 1 + asym, falls by 1 - asym."""
    d = panel.withColumn("d", change(c, 1)).withColumn("all", F.collect_list("d").over(rows(1 - n, 0)))
    weights = [0.5 ** ((n - 1 - i) / half_life) for i in range(n)]
    w = F.array(*map(F.lit, weights))
    part = F.zip_with("all", w, lambda x, y: y * F.abs(x) * F.when(x > 0, 1 + asym).otherwise(1 - asym))
    total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return d.withColumn("scale", F.when(F.size("all") == n, F.sqrt(F.lit(3.141592653589793 / 2)) * total / sum(weights))).drop("d", "all")


def range_stats(panel: DataFrame, c: str, n: int) -> DataFrame:
    frame = rows(1 - n, 0)
    sd = F.stddev_samp(c).over(frame)
    out = {"above_low": F.col(c) - F.min(c).over(frame), "below_high": F.max(c).over(frame) - F.col(c), "z": F.when(sd > 0, (F.col(c) - F.avg(c).over(frame)) / sd)}
    return panel.withColumns({k: full(v, F.col(c), n, 1 - n) for k, v in out.items()})


def carry_one_row_holes(panel: DataFrame, c: str) -> DataFrame:
    """A hole of a single row takes the value before it; longer holes stay."""
    before, after = F.lag(c).over(by_pos()), F.lead(c).over(by_pos())
    return panel.withColumn("carried", F.coalesce(F.col(c), F.when(before.isNotNull() & after.isNotNull(), before)))


def rows_since(panel: DataFrame, event: Column) -> DataFrame:
    """Rows since the last event, null before the first."""
    return panel.withColumn("since", F.col("pos") - F.last(F.when(event, F.col("pos")), True).over(rows(Window.unboundedPreceding, 0)))


def nearest_event(panel: DataFrame, event: Column) -> DataFrame:
    at = F.when(event, F.col("pos"))
    back = F.col("pos") - F.last(at, True).over(rows(Window.unboundedPreceding, 0))
    ahead = F.first(at, True).over(rows(0, Window.unboundedFollowing)) - F.col("pos")
    return panel.withColumn("distance", F.least(back, ahead))


def onsets(panel: DataFrame, event: Column, calm: int = 5) -> DataFrame:
    """at_risk: ``calm`` rows before, none of them an event; onset: an event at risk."""
    flag = panel.withColumn("event", event.cast("int"))
    quiet = (F.count("event").over(rows(-calm, -1)) == calm) & (F.sum("event").over(rows(-calm, -1)) == 0)
    return flag.withColumn("at_risk", F.coalesce(quiet, F.lit(False))).withColumn("onset", F.col("at_risk") & (F.col("event") == 1))


def episodes(panel: DataFrame, event: Column) -> DataFrame:
    """Runs of consecutive events: first and last pos, rows, peak spread."""
    hit = panel.filter(event).withColumn("island", F.col("pos") - F.row_number().over(by_pos()))
    return hit.groupBy("island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_rows"), F.max("spread").alias("peak")).drop("island")


def above_median_run(panel: DataFrame, c: str, n: int) -> DataFrame:
    """Length of the current run of rows above their own trailing median."""
    m = full(F.percentile(c, F.lit(0.5)).over(rows(1 - n, 0)), F.col(c), n, 1 - n)
    up = panel.withColumn("up", F.coalesce(F.col(c) > m, F.lit(False)))
    return up.withColumn("run", F.col("pos") - F.coalesce(F.max(F.when(~F.col("up"), F.col("pos"))).over(rows(Window.unboundedPreceding, 0)), F.lit(-1)))


def mid_ranks(df: DataFrame, c: str) -> DataFrame:
    """(rows below + half of the ties) / rows, in (0, 1); and the average rank. Only distinct values are ordered."""
    below = F.coalesce(F.sum("ties").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = df.groupBy(c).agg(F.count("*").alias("ties")).select(c, "ties", below.alias("below"), F.sum("ties").over(Window.partitionBy()).alias("rows"))
    out = df.join(ranks, c)
    return out.withColumn("mid_rank", (F.col("below") + F.col("ties") / 2) / F.col("rows")).withColumn("average_rank", F.col("below") + (F.col("ties") + 1) / 2).drop("ties", "below", "rows")


def top_k_hits(df: DataFrame, group: str, score: str, flag: str, k: int) -> DataFrame:
    """Expected hits among the k highest scores of each group: rows tied at the cut share what is left."""
    g = Window.partitionBy(group)
    ranked = df.withColumn("above", F.rank().over(g.orderBy(F.desc(score))) - 1).withColumn("ties", F.count("*").over(Window.partitionBy(group, score)))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k - F.col("above")) / F.col("ties")))
    return ranked.groupBy(group).agg(F.sum(share * F.col(flag)).alias("hits"), F.sum(flag).alias("events"))
