"""When values become public, field by field, and what a decision may read of them.

A registry has one row a field: kind, business_days, at (a clock time, HH:mm) and zone. Kinds are

* lagged: public so many business days after its day, at that time of the zone (daylight saving counts);
* scheduled: announced so many business days before its day, and read of the target's day;
* observed: each value has the instant at which it became public, revisions too;
* calendar: known beforehand, and read of the target's day.

Business days are counted by ordinals of a calendar, so a lag is a join, whatever holidays lie between. A day that is none
counts as the next one for a lag, and as the one before for a schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof

KINDS = ("lagged", "scheduled", "observed", "calendar")
TIMED = ("lagged", "scheduled")


def checked(registry: DataFrame) -> DataFrame:
    """registry, or an error in the job that reads it: a field twice, an unknown kind, a lag below 0 or without time or zone, or a time where there is no lag."""
    twice = F.count("*").over(Window.partitionBy("field")) > 1
    timed = F.col("kind").isin(*TIMED)
    whole = F.col("business_days").isNotNull() & (F.col("business_days") >= 0) & F.coalesce(F.col("at").rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.lit(False)) & F.col("zone").isNotNull()
    none = F.col("business_days").isNull() & F.col("at").isNull() & F.col("zone").isNull()
    wrong = F.when(F.col("field").isNull(), "a field without a name").when(twice, "is there twice").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "has no such kind")
    wrong = wrong.when(timed & ~whole, "has no whole lag").when(~timed & ~none, "has a lag that its kind does not use")
    return registry.withColumn("_w", wrong).withColumn("kind", F.when(F.col("_w").isNull(), F.col("kind")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("registry:"), "field", "_w")))).drop("_w")


def ordinals(business: DataFrame) -> DataFrame:
    """day and ordinal (from 0) of the business days (day) of a calendar: a row a day."""
    return business.select("day").distinct().select("day", (F.row_number().over(Window.orderBy("day")) - 1).alias("ordinal"))


def instant(day: Column, at: Column, zone: Column) -> Column:
    """The instant of a clock time of a day in a zone, as a timestamp of a session in UTC."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), at), "yyyy-MM-dd HH:mm"), zone)


def published(values: DataFrame, registry: DataFrame, business: DataFrame) -> DataFrame:
    """values (field, day, value, and observed_at, used for observed fields) with kind and available_at, null beyond the calendar; fields that the registry does not name are an error."""
    known = values.join(checked(registry), "field", "left")
    known = known.withColumn("kind", F.coalesce("kind", F.raise_error(F.concat(F.lit("registry: no field "), "field"))))
    numbers = ordinals(business)
    days = known.filter(F.col("kind").isin(*TIMED)).select(F.lit(0).alias("zero"), "day").distinct()
    before = asof.asof_join(days, numbers.select(F.lit(0).alias("zero"), F.col("day").alias("at_day"), "ordinal"), ["zero"], "day", "at_day", ["ordinal", "at_day"])
    placed = before.select("day", F.when(F.col("at_day") == F.col("day"), F.col("ordinal")).otherwise(F.col("ordinal") + 1).alias("next"), F.col("ordinal").alias("last"))
    known = known.join(placed, "day", "left")
    number = F.when(F.col("kind") == "lagged", F.col("next") + F.col("business_days")).when(F.col("kind") == "scheduled", F.col("last") - F.col("business_days"))
    known = known.withColumn("number", number).join(numbers.select(F.col("ordinal").alias("number"), F.col("day").alias("on")), "number", "left")
    at = F.when(F.col("kind") == "observed", F.col("observed_at")).when(F.col("kind").isin(*TIMED), instant(F.col("on"), F.col("at"), F.col("zone")))
    at = at.when(F.col("kind") == "calendar", F.lit("0001-01-01 00:00:00").cast("timestamp"))
    return known.select("field", "kind", "day", "value", at.alias("available_at"))


def information(decisions: DataFrame, public: DataFrame) -> DataFrame:
    """decision, field, kind, day, available_at and value: what each decision (decision, decided_at, target) may read of each field.

    Of lagged and observed fields it is the latest day's value that is public, of the latest revision; of scheduled and calendar fields the
    target's own, where it is public by then. A read that is not public is an error of the job, whatever made it.
    """
    row = F.struct("day", "available_at", "value")
    past = public.filter(F.col("kind").isin("lagged", "observed") & F.col("available_at").isNotNull())
    fields = past.select("field", "kind").distinct()
    asked = decisions.crossJoin(F.broadcast(fields))  # every decision reads every field; a registry has few
    left = asked.select("field", F.col("decided_at").alias("_t"), F.lit(1).alias("_side"), F.struct("decision", "kind", "decided_at").alias("_left"), F.lit(None).cast(past.select(row).schema[0].dataType).alias("_row"))
    right = past.select("field", F.col("available_at").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_left"].dataType).alias("_left"), row.alias("_row"))
    line = Window.partitionBy("field").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = left.unionByName(right).withColumn("_best", F.max("_row").over(line)).filter("_side = 1").select("_left.decision", "field", "_left.kind", "_left.decided_at", "_best.*")
    ahead = public.filter(F.col("kind").isin("scheduled", "calendar")).withColumnRenamed("day", "target")
    named = decisions.join(ahead, "target").filter(F.col("available_at") <= F.col("decided_at")).select("decision", "field", "kind", "decided_at", F.col("target").alias("day"), "available_at", "value")
    found = latest.filter("available_at is not null").unionByName(named)
    return require_public(found).drop("decided_at")


def require_public(reads: DataFrame) -> DataFrame:
    """reads, or an error in the job where one was not public when it was decided on, or has no instant."""
    late = F.coalesce(F.col("available_at") > F.col("decided_at"), F.lit(True))
    return reads.filter(F.when(late, F.raise_error(F.concat(F.lit("a read of "), "field", F.lit(" was not public for decision "), F.col("decision").cast("string"))).cast("boolean")).otherwise(F.lit(True)))
