"""As-of joins, information sets and their guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], tolerance: str | None = None) -> DataFrame:
    """left with the values of the latest right row of its key that is at or before it; null where there is none, or none within tolerance.

    Both sides go on one timeline and one sort carries the last right row forward: linear, and partitioned by the keys.
    """
    row = F.struct(F.col(right_at).alias("_at"), *values)
    a = left.select(*keys, F.col(left_at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(row).schema[0].dataType).alias("_right"))
    b = right.select(*keys, F.col(right_at).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), row.alias("_right")).filter(F.col("_t").isNotNull())
    timeline = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = a.unionByName(b).withColumn("_found", F.last("_right", ignorenulls=True).over(timeline)).filter("_side = 1")
    fresh = F.lit(True) if tolerance is None else F.col("_found._at") >= F.col("_t") - F.expr(f"INTERVAL {tolerance}")
    return found.select("_left.*", *(F.when(fresh, F.col(f"_found.{v}")).alias(v) for v in values))


def decisions(panel: DataFrame, horizon: int, hour: int = 18) -> DataFrame:
    """panel with deadline: the decision hour of the day ``horizon`` rows earlier."""
    order = Window.orderBy("pos")
    return panel.withColumn("deadline", F.lag("date", horizon).over(order).cast("timestamp") + F.make_interval(hours=F.lit(hour)))


def availability(panel: DataFrame, business_days: int, hour: int) -> DataFrame:
    """panel with available_at: ``hour`` of the day so many rows later, null beyond the panel."""
    return panel.withColumn("available_at", F.lead("date", business_days).over(Window.orderBy("pos")).cast("timestamp") + F.make_interval(hours=F.lit(hour)))


def anchors(panel: DataFrame, horizon: int = 1, business_days: int = 1, hour: int = 9) -> DataFrame:
    """pos, date, deadline, anchor and anchor_spread: the latest row that was public by each row's deadline."""
    scored = decisions(panel, horizon).filter("deadline is not null").select(F.lit(0).alias("k"), "pos", "date", "deadline")
    public = availability(panel, business_days, hour).select(F.lit(0).alias("k"), "available_at", F.col("pos").alias("anchor"), F.col("spread").alias("anchor_spread"))
    return asof_join(scored, public, ["k"], "deadline", "available_at", ["anchor", "anchor_spread"]).drop("k")


def in_force(entries: DataFrame, keys: list[str], effective: str, announced: str, target: Column, known: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """Of each key the entry that is effective by target and announced by known: the latest effective, then the latest announced, then the largest of ties."""
    order = Window.partitionBy(*keys).orderBy(*map(F.desc, (effective, announced, *ties)))
    return entries.filter((F.col(effective) <= target) & (F.col(announced) <= known)).withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def carried(series: DataFrame, at: str, days: DataFrame, day: str, values: list[str], within: int) -> DataFrame:
    """days with the values of the latest row of a daily series at or before each, null where it is older than so many days."""
    left = days.withColumns({"_k": F.lit(0), "_d": F.unix_date(day)})
    right = series.select(F.lit(0).alias("_k"), F.unix_date(at).alias("_a"), F.col(at).alias("read_day"), *values)
    found = asof_join(left, right, ["_k"], "_d", "_a", ["read_day", *values])
    fresh = F.datediff(day, "read_day") <= within
    return found.drop("_k", "_d").withColumns({v: F.when(fresh, F.col(v)) for v in values})


def refused(reads: DataFrame, scored: str, read: str, available: str, deadline: str, newer: str | None = None) -> DataFrame:
    """The reads that break a rule, with the rule: a row at or after the scored one, a value not public by its deadline, or one staler than the newest admissible row."""
    rule = F.when(F.col(read) >= F.col(scored), "look ahead").when(F.col(available) > F.col(deadline), "not public")
    if newer:
        rule = rule.when(F.col(newer) > F.col(read), "stale")
    return reads.withColumn("rule", rule).filter("rule is not null")


def require(reads: DataFrame, *columns: str, newer: str | None = None) -> DataFrame:
    """reads, or an error in the job where refused() names a row."""
    scored, read, available, deadline = columns
    bad = (F.col(read) >= F.col(scored)) | (F.col(available) > F.col(deadline))
    if newer:
        bad = bad | (F.col(newer) > F.col(read))
    return reads.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit("a read breaks the rule at row "), F.col(scored).cast("string"))).cast("boolean")).otherwise(F.lit(True)))


def first_published(observations: DataFrame) -> DataFrame:
    """The earliest vintage of each (series, ref_date)."""
    return observations.groupBy("series", "ref_date").agg(F.min(F.struct("available_at", "vintage", "value")).alias("v")).select("series", "ref_date", "v.*")


def latest_at(observations: DataFrame, cutoff: str) -> DataFrame:
    """The latest vintage of each (series, ref_date) that was available at the cutoff."""
    public = observations.filter(F.col("available_at") <= F.lit(cutoff).cast("timestamp"))
    return public.groupBy("series", "ref_date").agg(F.max(F.struct("available_at", "vintage", "value")).alias("v")).select("series", "ref_date", "v.*")
