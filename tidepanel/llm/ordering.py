"""Ranks within groups without a task that sees a whole group: range partitions and offsets of their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def ranked(scratch: common.Scratch, rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with rank (from 0) and total within their group, written.

    Rows that are alike in group and order may be ranked in any way, and lie in as many partitions as
    their number asks for. The only joined table has one row for each group that a partition holds.
    group has no nulls.
    """
    dealt = rows.withColumn(" turn", F.monotonically_increasing_id())
    placed = dealt.repartitionByRange(group, *order, " turn").sortWithinPartitions(group, *order).drop(" turn")
    part = F.shiftright(F.col(" id"), 33).alias(" part")
    placed = scratch.save(placed.withColumn(" id", F.monotonically_increasing_id()), name)
    counts = placed.groupBy(group, part).agg(F.min(" id").alias(" first"), F.count("*").alias(" n"))
    line = Window.partitionBy(group).orderBy(" part")
    before = F.coalesce(F.sum(" n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group), " part", (before - F.col(" first")).alias(" start"), F.sum(" n").over(Window.partitionBy(group)).alias("total"))
    known = placed.withColumn(" part", part).join(starts, [group, " part"])
    return known.withColumn("rank", F.col(" id") + F.col(" start")).drop(" id", " part", " start")
