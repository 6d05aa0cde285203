"""Calendar columns of a panel's own market days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: First day of the first maintenance period counted from.
MAINTENANCE = "1995-01-04"


#: The months of tax deadlines.
TAX_MONTHS = [1, 4, 6, 9, 12]
#: Last day of month of each bucket but the last.
BUCKET_ENDS = [5, 14, 18, 23]
#: The days that calendars cover unless told otherwise.
FIRST, LAST = "1994-12-01", "2002-01-31"


def business_days(spark: SparkSession, first: str = FIRST, last: str = LAST, holidays: list[str] | None = None) -> DataFrame:
    """day, k and e (ordinal in its month from both ends) of all weekdays that are no holiday; first and last are a month's ends."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).filter(F.weekday("day") < 5)
    if holidays:
        days = days.filter(~F.col("day").isin([F.lit(h).cast("date") for h in holidays]))
    own = Window.partitionBy(F.trunc("day", "month"))
    return days.select("day", F.row_number().over(own.orderBy("day")).alias("k"), F.row_number().over(own.orderBy(F.desc("day"))).alias("e"))


def bucket(day_of_month: Column) -> Column:
    return sum(((day_of_month > end).cast("int") for end in BUCKET_ENDS), F.lit(0))


def tax_day(date: Column) -> Column:
    """The 15th of the tax months and the two days after it."""
    return F.month(date).isin(TAX_MONTHS) & F.dayofmonth(date).between(15, 17)


def calendar_columns(panel: DataFrame, first: str = FIRST, last: str = LAST, holidays: list[str] | None = None) -> DataFrame:
    """month, market-day ordinal from both ends, day type, maintenance day, day-of-month bucket, the Wednesday before and the penultimate business day.

    Turns are the business calendar's last day of a month and first of the next, whichever rows the panel has.
    """
    month = F.trunc("date", "month")
    own = Window.partitionBy("month")
    base = panel.withColumn("month", month).withColumn("bday", F.row_number().over(own.orderBy("date"))).withColumn("from_end", F.row_number().over(own.orderBy(F.desc("date"))))
    base = base.join(business_days(panel.sparkSession, first, last, holidays), F.col("date") == F.col("day"), "left").drop("day")
    turn = F.when(F.col("e") == 1, F.month("date")).when(F.col("k") == 1, F.month(F.add_months("date", -1)))
    kind = F.when(turn == 12, "year_end").when(turn % 3 == 0, "quarter_end_turn").when(turn.isNotNull(), "turn").when(tax_day(F.col("date")), "tax_date").otherwise("ordinary")
    return base.withColumns(
        {
            "day_type": kind,
            "maintenance_day": F.pmod(F.datediff("date", F.lit(MAINTENANCE).cast("date")), F.lit(14)),
            "bucket": bucket(F.dayofmonth("date")),
            "wednesday": F.date_sub("date", F.pmod(F.dayofweek("date") - 4, F.lit(7))),
            "penultimate": F.coalesce(F.col("e") == 2, F.lit(False)),
        }
    ).drop("k", "e")


def ramp(day: Column) -> Column:
    """0 up to the 18th and after the 25th, rising by sevenths between."""
    d = F.dayofmonth(day)
    return F.when(d.between(19, 25), (d - 18) / 7).otherwise(0.0)


def payment_days(business: DataFrame, day: int = 25) -> DataFrame:
    """month and paid: the first business day from ``day`` of each month on."""
    return business.filter(F.dayofmonth("day") >= day).groupBy(F.trunc("day", "month").alias("month")).agg(F.min("day").alias("paid"))


def roll_ramp(date: Column, paid: Column) -> Column:
    """The ramp whose top rolls from the 25th to the payment day."""
    return F.when(date == paid, 1.0).when(F.dayofmonth(date) >= 25, 0.0).otherwise(ramp(date))


def october_window(business: DataFrame) -> DataFrame:
    """date of the 15 October deadline, rolled forward, and of the two business days after it, each year."""
    late = business.filter((F.month("day") == 10) & (F.dayofmonth("day") >= 15))
    return late.withColumn("n", F.row_number().over(Window.partitionBy(F.year("day")).orderBy("day"))).filter("n <= 3").select(F.col("day").alias("date"))


def carried_days(panel: DataFrame) -> DataFrame:
    """Calendar days of the month that carry a day's rate: up to the next market day or the end of the month."""
    upto = F.least(F.coalesce(F.lead("date").over(Window.orderBy("date")), F.date_add("date", 1)), F.date_add(F.last_day("date"), 1))
    return panel.withColumn("carried_days", F.datediff(upto, "date"))
