"""Readers: tables, the daily panel and the point-in-time observations made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The policy rate of the demonstration panel, in per cent.
POLICY_RATE = 2.5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day: pos, date, n, rate, p25, p75, volume, spread (bp over the policy rate) and bp, the spread in whole bp.

    The days are few, so numbering them in one partition is cheap; orders are aggregated before.
    """
    days = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 1e5).alias("x")).groupBy("date")
    wide = days.agg(
        F.count("*").alias("n"),
        F.round(F.avg("x"), 10).alias("rate"),
        F.round(F.percentile("x", F.lit(0.25)), 9).alias("p25"),
        F.round(F.percentile("x", F.lit(0.75)), 9).alias("p75"),
        F.round(F.sum("x"), 7).alias("volume"),
    )
    spread = F.round(100 * (F.col("rate") - POLICY_RATE), 8)
    return wide.select((F.row_number().over(Window.orderBy("date")) - 1).alias("pos"), "*", spread.alias("spread"), F.bround(spread, 0).cast("int").alias("bp"))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long point-in-time observations: series, ref_date, available_at, vintage, value."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    vintage = F.concat_ws("-", "l_orderkey", "l_linenumber")
    return joined.select(F.col("l_returnflag").alias("series"), F.to_date("o_orderdate").alias("ref_date"), F.col("l_shipdate").alias("available_at"), vintage.alias("vintage"), F.col("l_extendedprice").alias("value"))


PANEL_SQL = f"""
d AS (SELECT o_orderdate::DATE AS date, o_totalprice / 1e5 AS x FROM orders),
w AS (SELECT date, count(*) AS n, round(avg(x), 10) AS rate, round(quantile_cont(x, 0.25), 9) AS p25, round(quantile_cont(x, 0.75), 9) AS p75, round(sum(x), 7) AS volume FROM d GROUP BY date),
panel AS (SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS pos, *, round(100 * (rate - {POLICY_RATE}), 8) AS spread, CAST(round_even(round(100 * (rate - {POLICY_RATE}), 8), 0) AS INTEGER) AS bp FROM w)
"""
VINTAGES_SQL = """
vintages AS (SELECT l_returnflag AS series, o_orderdate::DATE AS ref_date, l_shipdate AS available_at, l_orderkey || '-' || l_linenumber AS vintage, l_extendedprice AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
