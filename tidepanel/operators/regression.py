"""Many small regressions at once: Gram matrices are aggregates of groups, solved in column expressions.

Rows are (keys, x, y): x is an array of regressors whose first is the constant 1. Robust and quantile fits
reweight their rows: each round is one aggregate over all groups that still move, and the coefficients, a
few numbers a group, are written after it. No group is collected anywhere, so it may have any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables

#: Huber's threshold in robust deviations of the residuals, and the least such deviation.
HUBER, LEAST_SIGMA = 1.345, 1e-6
#: The least residual by which the check loss is reweighted.
EPSILON = 1e-3


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def system(rows: DataFrame, keys: list[str], size: int, penalty: float, weight: Column, target: Column) -> DataFrame:
    """keys, n and m: by group the augmented rows of (sum weight x x' + penalty) b = sum target x; the constant has no penalty."""
    x = [F.get("x", F.lit(i)) for i in range(size)]
    sums = {(i, j): F.sum(weight * x[i] * x[j]) for i in range(size) for j in range(i, size)} | {(i, size): F.sum(target * x[i]) for i in range(size)}
    flat = rows.groupBy(*keys).agg(F.count("*").alias("n"), *(s.alias(f"m{i}_{j}") for (i, j), s in sums.items()))
    cell = lambda i, j: F.col(f"m{min(i, j)}_{max(i, j)}") + F.lit(float(penalty) if i == j and i else 0.0)
    m = F.array(*(F.array(*(cell(i, j) for j in range(size + 1))) for i in range(size)))
    return flat.select(*keys, "n", m.alias("m"))


def solved(m: Column, size: int) -> Column:
    """The solution of an augmented positive definite system, by elimination without exchanges."""

    def eliminate(rows: Column, k: Column) -> Column:
        pivot = F.get(F.get(rows, k), k)
        head = F.transform(F.get(rows, k), lambda v: v / pivot)
        return F.transform(rows, lambda row, i: F.when(i == k, head).otherwise(F.zip_with(row, head, lambda a, b: a - F.get(row, k) * b)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), m, eliminate)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def ridge(rows: DataFrame, keys: list[str], size: int, penalty: float) -> DataFrame:
    """keys, n and b: least squares with an L2 penalty on every coefficient but the constant's."""
    return system(rows, keys, size, penalty, F.lit(1.0), F.col("y")).select(*keys, "n", solved(F.col("m"), size).alias("b"))


def _rounds(tables: Tables, name: str, start: DataFrame, keys: list[str], step, rounds: int, tolerance: float) -> DataFrame:
    """keys, n, b and rounds: step (active keys and b to keys and new b) until no coefficient of a group moves by tolerance or more."""
    found, active = tables.keep(start.withColumns({"rounds": F.lit(0), "done": F.lit(False)}), f"{name}-0"), 1
    for turn in range(1, rounds + 1):
        if not active:
            break
        new = step(found.filter("NOT done").select(*keys, "b")).select(*keys, F.col("b").alias("new"))
        moved = F.array_max(F.zip_with("new", "b", lambda u, v: F.abs(u - v)))
        after = found.join(new, keys, "left").withColumn("moved", moved)
        still = Observation()
        after = after.select(*keys, "n", F.coalesce("new", "b").alias("b"), F.when(F.col("done"), F.col("rounds")).otherwise(turn).alias("rounds"), F.coalesce(F.col("done") | (F.col("moved") < tolerance), F.lit(True)).alias("done"))
        found = tables.keep(after.observe(still, F.count_if(~F.col("done")).alias("active")), f"{name}-{turn}")
        tables.drop(f"{name}-{turn - 1}")
        active = still.get["active"]
    return found.drop("done")


def huber(tables: Tables, rows: DataFrame, keys: list[str], size: int, penalty: float, rounds: int = 50, tolerance: float = 1e-8, name: str = "huber") -> DataFrame:
    """keys, n, b and rounds: ridge least squares with rows beyond Huber's threshold of the current residuals weighted down.

    The threshold is that many times 1.4826 medians of the residuals' distance from their median. rows should be written, as they are read in every round.
    """
    group = Window.partitionBy(*keys)

    def step(active: DataFrame) -> DataFrame:
        known = rows.join(active, keys).withColumn("e", F.col("y") - dot(F.col("b"), F.col("x")))
        known = known.withColumn("far", F.abs(F.col("e") - F.percentile("e", F.lit(0.5)).over(group)))
        cut = HUBER * F.greatest(1.4826 * F.percentile("far", F.lit(0.5)).over(group), F.lit(LEAST_SIGMA))
        known = known.withColumn("cut", cut).withColumn("w", F.when(F.abs("e") <= F.col("cut"), 1.0).otherwise(F.col("cut") / F.abs("e")))
        new = system(known, keys, size, penalty, F.col("w"), F.col("w") * F.col("y"))
        return new.select(*keys, solved(F.col("m"), size).alias("b"))

    return _rounds(tables, name, ridge(rows, keys, size, penalty), keys, step, rounds, tolerance)


def quantile(tables: Tables, rows: DataFrame, keys: list[str], size: int, penalty: float, levels: list[float], rounds: int = 100, tolerance: float = 1e-3, name: str = "quantile") -> DataFrame:
    """keys, level, n, b and rounds: the least check loss of every level by reweighted squares, from the ridge fit on.

    At each round |residual| is bounded by a parabola through its value, no residual taken as smaller than EPSILON; all groups and
    levels share the round's aggregate. rows should be written.
    """
    start = ridge(rows, keys, size, penalty).withColumn("level", F.explode(F.array(*map(F.lit, levels))))

    def step(active: DataFrame) -> DataFrame:
        known = rows.join(active, keys).withColumn("w", 1 / (2 * F.greatest(F.abs(F.col("y") - dot(F.col("b"), F.col("x"))), F.lit(EPSILON))))
        new = system(known, [*keys, "level"], size, penalty, F.col("w"), F.col("w") * F.col("y") + (2 * F.col("level") - 1) / 2)
        return new.select(*keys, "level", solved(F.col("m"), size).alias("b"))

    return _rounds(tables, name, start, [*keys, "level"], step, rounds, tolerance)
