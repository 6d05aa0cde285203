"""Mean reversion with scaled residuals: each pair's residual is divided by the scale that its origin had, a forecast multiplies by the anchor's.

A scale at a row reads the changes that end there and none after it, so it is public where the row is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import Tables
from . import benchmarks, windows
from .scores import levels


@dataclass(frozen=True)
class Variant:
    """A scale: the estimator (mad or sd) over ``window`` changes, at least ``floor``."""

    name: str
    estimator: str
    window: int
    floor: float

    def __post_init__(self) -> None:
        if self.estimator not in ("mad", "sd") or self.window < 2 or self.floor <= 0:
            raise ValueError(f"no such scale: {self}")


#: The variants that are compared unless told otherwise; the first is the base of other models.
VARIANTS = (
    Variant("mad20", "mad", 20, 0.5), Variant("mad10", "mad", 10, 0.5), Variant("mad40", "mad", 40, 0.5),
    Variant("mad20_low", "mad", 20, 0.25), Variant("mad20_high", "mad", 20, 1.0), Variant("sd20", "sd", 20, 0.5),
)


def scales(panel: DataFrame, variants: tuple[Variant, ...]) -> DataFrame:
    """variant, pos and scale of every row that has enough changes before it."""
    moved = panel.withColumn("move", windows.change("spread", 1))
    columns = []
    for v in variants:
        frame = windows.rows(1 - v.window, 0)
        size = 1.4826 * F.percentile(F.abs("move"), F.lit(0.5)).over(frame) if v.estimator == "mad" else F.stddev_samp("move").over(frame)
        columns.append(windows.full(F.greatest(F.lit(v.floor), size), F.col("move"), v.window, 1 - v.window).alias(v.name))
    wide = moved.select("pos", *columns)
    return wide.unpivot(["pos"], [v.name for v in variants], "variant", "scale").filter("scale is not null")


def standardised(fitted: benchmarks.Refits, scale: DataFrame) -> DataFrame:
    """Residuals of every variant: the pairs with variant, scale (of the origin) and z, raw divided by scale."""
    own = scale.select("variant", F.col("pos").alias("origin"), "scale")
    return benchmarks.residuals(fitted).join(own, "origin").withColumn("z", F.col("raw") / F.col("scale"))


def scaled_walk(panel: DataFrame, variants: tuple[Variant, ...] = VARIANTS, every: int = 21, years: int = 2, least: int = 60) -> DataFrame:
    """variant, decision, lead, fitted, phi, scale (the anchor's), n, left_out (pairs whose origin had no scale) and q.

    A decision without a scale of any variant is left out for all, so variants have the same days.
    """
    tables = Tables(panel.sparkSession)
    fitted = benchmarks.refits(tables, panel, every, years, least)
    scale = tables.keep(scales(panel, variants), "scales")
    pairs = fitted.pairs.groupBy("block", "lead").agg(F.count("*").alias("pairs"))
    pools = standardised(fitted, scale).groupBy("variant", "block", "lead").agg(F.count("*").alias("n"), F.percentile("z", levels()).alias("pool")).join(pairs, ["block", "lead"])
    whole = scale.groupBy(F.col("pos").alias("anchor")).agg(F.count("*").alias("known")).filter(F.col("known") == len(variants)).select("anchor")
    now = benchmarks.centres(fitted).join(whole, "anchor").join(scale.withColumnRenamed("pos", "anchor"), "anchor")
    found = now.join(pools, ["variant", "block", "lead"])
    q = F.transform("pool", lambda z: F.col("centre") + F.col("scale") * z)
    return found.select("variant", "decision", "lead", "fitted", "phi", "scale", "n", (F.col("pairs") - F.col("n")).alias("left_out"), q.alias("q"))
