"""Connected components of a link table by minimum labels and pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(scratch: common.Scratch, links: DataFrame, tag: str) -> DataFrame:
    """(node, comp) of every node in links (a, b): comp is the smallest node reachable.

    Each round a node takes the smallest label among itself and its neighbours, then the label
    of that label. Every round is written to the shared folder; stars settle in two or three.
    """
    both = scratch.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{tag}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), f"{tag}-labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        after = scratch.save(lower.join(jump, "low", "left").select("node", "was", F.least("low", "far").alias("comp")), f"{tag}-labels-{turn}")
        scratch.drop(f"{tag}-labels-{turn - 1}")
        labels = after.select("node", "comp")
        if after.filter("was <> comp").isEmpty():
            return labels
