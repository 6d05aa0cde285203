"""Isotonic fits over any number of partitions: reliability diagrams, CORP decompositions and Venn-Abers pairs.

Equal scores are one point. Points are range-partitioned by score; each partition pools its neighbours that violate
the order into blocks, and blocks of neighbouring partitions are pooled again, FAN partitions at a time, until one is left. Blocks that were pooled stay together in the whole fit, so
the result is that of one pass over all points, whatever the partitions; what moves is blocks, not rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables

#: Neighbouring partitions whose blocks are pooled by one task.
FAN = 16
BLOCK = "part long, low double, high double, n double, total double"
NAMES = ["low", "high", "n", "total"]


def pooled(low: np.ndarray, high: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order of their scores, pooled until their means rise."""
    out: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), n.tolist(), total.tolist()):
        block = list(block)
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:  # the mean before is not below
            before = out.pop()
            block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
        out.append(block)
    return tuple(np.array(c) for c in zip(*out)) if out else (low, high, n, total)


def _arrays(rows: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    return [rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy() for c in NAMES]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one range of points, its blocks; batches are pooled one after another."""
    held = [np.zeros(0)] * 4
    for batch in batches:
        held = list(pooled(*(np.concatenate([a, b]) for a, b in zip(held, _arrays(batch)))))
        part = batch.column(batch.schema.get_field_index("part"))[0].as_py() if batch.num_rows else 0
    if len(held[0]):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held[0]), part)), *map(pa.array, held)], ["part", *NAMES])


def _merge(blocks: pa.Table) -> pa.Table:
    blocks = blocks.sort_by("low")
    found = pooled(*_arrays(blocks))
    up = blocks.column("part")[0].as_py() // FAN
    return pa.table([pa.array(np.full(len(found[0]), up)), *map(pa.array, found)], ["part", *NAMES])


def blocks(tables: Tables, points: DataFrame, name: str = "blocks", parts: int | None = None) -> DataFrame:
    """low, high, n and total of the blocks of the isotonic fit of outcome by score; total / n is the fit between low and high.

    points: score, n and total (rows and the sum of their outcomes) of every different score; null scores are left out.
    """
    known = points.filter("score is not null").select(F.col("score").cast("double").alias("low"), F.col("score").cast("double").alias("high"), F.col("n").cast("double").alias("n"), F.col("total").cast("double").alias("total"))
    dealt = (known.repartitionByRange(parts, "low") if parts else known.repartitionByRange("low")).sortWithinPartitions("low")
    found = tables.keep(dealt.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_local, BLOCK), f"{name}-0")
    turn = 0
    while (found.agg(F.max("part")).first()[0] or 0) > 0:
        turn += 1
        found = tables.keep(found.groupBy(F.floor(F.col("part") / FAN).alias("up")).applyInArrow(_merge, BLOCK), f"{name}-{turn}")
    return found.drop("part")


def by_score(rows: DataFrame, score: str, outcome: str) -> DataFrame:
    """score, n and total of rows: what blocks() takes. Rows without an outcome are left out."""
    return rows.filter(F.col(outcome).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(outcome).alias("total"))


def corp(tables: Tables, rows: DataFrame, score: str, outcome: str, parts: int | None = None) -> DataFrame:
    """n, events, brier, miscalibration, discrimination and uncertainty; brier = miscalibration - discrimination + uncertainty.

    Recalibrated scores are the isotonic fit's; of equal scores one value stands for all.
    """
    points = tables.keep(by_score(rows, score, outcome).filter("score is not null"), "points")
    fit = blocks(tables, points, parts=parts)
    # a 0/1 outcome's squared error is total * (1 - p) ** 2 + (n - total) * p ** 2
    error = lambda p, n="n", t="total": F.col(t) * F.pow(1 - p, 2) + (F.col(n) - F.col(t)) * F.pow(p, 2)
    raw = points.agg(F.sum("n").alias("rows"), F.sum("total").alias("events"), F.sum(error(F.col("score"))).alias("raw"))
    best = fit.agg(F.sum(error(F.col("total") / F.col("n"))).alias("best"), F.count("*").alias("blocks"))
    both = raw.join(F.broadcast(best)).withColumn("share", F.col("events") / F.col("rows"))  # one row each
    n, base = F.col("rows"), F.col("share") * (1 - F.col("share"))
    return both.select(n.alias("n"), "events", "blocks", (F.col("raw") / n).alias("brier"), ((F.col("raw") - F.col("best")) / n).alias("miscalibration"), (base - F.col("best") / n).alias("discrimination"), base.alias("uncertainty"))


def recalibrated(rows: DataFrame, fit: DataFrame, score: str) -> DataFrame:
    """rows with fitted: the value of the block at or below the score, of the first block below all.

    Scores and blocks go on one line, which is cut by score into ranges of its own partitions; a range knows the last block before it.
    """
    line = fit.select(F.col("low").alias("_s"), F.lit(0).alias("_side"), (F.col("total") / F.col("n")).alias("_v"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    asked = rows.select(F.col(score).cast("double").alias("_s"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v"), F.struct("*").alias("_row"))
    dealt = line.unionByName(asked).repartitionByRange("_s", "_side").withColumn("_part", F.spark_partition_id())
    dealt = Tables(rows.sparkSession).keep(dealt, "line")
    ends = dealt.filter("_side = 0").groupBy("_part").agg(F.max_by("_v", "_s").alias("_end"), F.max("_s").alias("_top"))
    parts = dealt.select("_part").distinct().join(ends, "_part", "left")
    before = parts.select("_part", F.last("_end", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row for each partition
    first = F.broadcast(fit.agg(F.min_by(F.col("total") / F.col("n"), "low").alias("_first")))  # one row
    own = Window.partitionBy("_part").orderBy("_s", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("_own", F.last("_v", True).over(own)).filter("_side = 1").join(before, "_part").join(first)
    return found.select("_row.*", F.when(F.col("_s").isNotNull(), F.coalesce("_own", "_before", "_first")).alias("fitted"))
