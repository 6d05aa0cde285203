"""Linear quantile regression on direct pairs of an expanding window: the last spread, a slow state and calendar terms.

A decision reads the state of its own row and a pair that of its own decision; pairs of unknown state are left out. The fitted
quantiles are sorted, so they never cross.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables
from . import asof, benchmarks, calendar_terms, regression

TERMS = calendar_terms.TERMS


def blocks(panel: DataFrame, every: int, least: int) -> DataFrame:
    """decisions with block: from the first with ``least`` pairs of the longest lead on, one refit every ``every``."""
    made = benchmarks.decisions(panel).filter(F.col("anchor") + 1 - max(benchmarks.LEADS) - F.col("lag") >= least)
    made = made.withColumn("block", F.floor((F.row_number().over(Window.orderBy("decision")) - 1) / every))
    return made.withColumn("fitted", F.min("decision").over(Window.partitionBy("block")))


def training(tables: Tables, made: DataFrame, panel: DataFrame, days: DataFrame, states: DataFrame) -> DataFrame:
    """block, lead, x and y of all pairs up to each refit's anchor, written."""
    fits = made.filter("decision = fitted").select("block", F.col("anchor").alias("upto"), F.col("lag").alias("own_lag"))
    seen_from = fits.select(F.lit(0).alias("zero"), (F.col("upto") + 1).alias("after"), (F.col("block") + 1).alias("next"))
    last = F.max("block").over(Window.partitionBy())
    rows = panel.select(F.lit(0).alias("zero"), F.col("pos").alias("target"), F.col("spread").alias("y"))
    rows = asof.asof_join(rows, seen_from, ["zero"], "target", "after", ["next"])
    each = fits.select("block", "own_lag", last.alias("last_block"))
    first = F.coalesce("next", F.lit(0).cast("long"))
    ends = each.select("last_block").distinct()
    # a row is in every refit from the first whose anchor is not before it
    spread_out = rows.join(F.broadcast(ends)).filter(first <= F.col("last_block")).withColumn("block", F.explode(F.sequence(first, F.col("last_block"))))
    pairs = spread_out.join(fits, "block").withColumn("lead", F.explode(F.array(*map(F.lit, benchmarks.LEADS))))
    pairs = pairs.withColumns({"origin": F.col("target") - F.col("lead") - F.col("own_lag"), "decision": F.col("target") - F.col("lead")})
    known = pairs.join(panel.select(F.col("pos").alias("origin"), F.col("spread").alias("last")), "origin").join(states.withColumnRenamed("pos", "decision").filter("state is not null"), "decision")
    read = known.join(days.withColumnRenamed("pos", "target"), "target").select("block", "lead", "y", "last", "state", *calendar_terms.read_at(F.col("lead")))
    counts = read.groupBy("block", "lead").agg(F.array(*(F.sum(t) >= calendar_terms.LEAST_FLAGGED for t in TERMS)).alias("enters"))
    own = [F.when(F.get("enters", F.lit(i)), F.col(t)).otherwise(0.0) for i, t in enumerate(TERMS)]
    return tables.keep(read.join(counts, ["block", "lead"]).select("block", "lead", F.array(F.lit(1.0), "last", "state", *own).alias("x"), "y"), "quantile-rows")


def quantile_walk(panel: DataFrame, states: DataFrame, levels: list[float], every: int = 250, least: int = 60, penalty: float = 0.01, rounds: int = 100) -> DataFrame:
    """decision, lead, fitted, n, rounds (of the slowest level), crossed and q (by ``levels``, which rise) of every decision whose state is known."""
    tables = Tables(panel.sparkSession)
    days, states = tables.keep(calendar_terms.flags(panel), "flags"), tables.keep(states.select("pos", "state"), "states")
    panel = tables.keep(panel, "panel")
    made = tables.keep(blocks(panel, every, least), "made")
    rows = training(tables, made, panel, days, states)
    found = regression.quantile(tables, rows, ["block", "lead"], 3 + len(TERMS), penalty, levels, rounds).filter(F.col("n") >= least)
    fits = found.groupBy("block", "lead").agg(F.sort_array(F.collect_list(F.struct("level", "b"))).alias("fits"), F.max("n").alias("n"), F.max("rounds").alias("rounds"))
    now = made.withColumn("lead", F.explode(F.array(*map(F.lit, benchmarks.LEADS)))).withColumn("pos", F.col("decision") + F.col("lead")).join(days, "pos").drop("pos")
    now = now.join(states.withColumnRenamed("pos", "decision").filter("state is not null"), "decision")
    now = now.select("decision", "block", "fitted", "lead", F.array(F.lit(1.0), "last", "state", *calendar_terms.read_at(F.col("lead"))).alias("x"))
    raw = F.transform("fits", lambda f: regression.dot(f.b, F.col("x")))
    out = now.join(fits, ["block", "lead"]).withColumn("raw", raw)
    q = F.sort_array("raw")
    return out.select("decision", "lead", "fitted", "n", "rounds", (q != F.col("raw")).alias("crossed"), q.alias("q"))
