"""Forecast distributions, proper scores and tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The levels of a forecast's quantiles.
GRID = [0.01, 0.025, 0.05, *(round(0.05 * k, 2) for k in range(2, 19)), 0.95, 0.975, 0.99]


def levels() -> Column:
    return F.array(*map(F.lit, GRID))


def persistence(panel: DataFrame, lead: int, window: int = 500, least: int = 60) -> DataFrame:
    """pos, outcome and q: the last value plus the quantiles of its own changes over ``lead`` rows in the trailing window."""
    order = Window.orderBy("pos")
    moves = panel.withColumn("move", F.col("spread") - F.lag("spread", lead).over(order))
    trailing = order.rowsBetween(1 - window, 0)
    pool = moves.withColumn("pool", F.percentile("move", levels()).over(trailing)).withColumn("size", F.count("move").over(trailing))
    made = pool.withColumn("q", F.transform("pool", lambda x: x + F.col("spread"))).withColumn("outcome", F.lead("spread", lead).over(order))
    return made.filter((F.col("size") >= least) & F.col("outcome").isNotNull()).select("pos", "date", "outcome", "q")


def pinball(level: Column, q: Column, y: Column) -> Column:
    return F.greatest(level * (y - q), (level - 1) * (y - q))


def crps(q: Column, y: Column) -> Column:
    """Twice the mean check loss over the grid."""
    return 2 * F.aggregate(F.zip_with(q, levels(), lambda a, b: pinball(b, a, y)), F.lit(0.0), lambda s, x: s + x) / len(GRID)


def upper_tail_crps(q: Column, y: Column) -> Column:
    return crps(F.transform(q, lambda x: F.greatest(x, F.lit(0.0))), F.greatest(y, F.lit(0.0)))


def quantile(q: Column, level: float) -> Column:
    return F.element_at(q, GRID.index(level) + 1)


def cap(q: Column, line: Column) -> Column:
    return F.when(line.isNull(), q).otherwise(F.transform(q, lambda x: F.least(x, line)))


def chi2_1(x: Column) -> Column:
    """Tail of chi-square with one degree of freedom: one less the error function, by its series of positive terms."""
    half = F.least(x / 2, F.lit(40.0))  # beyond that the tail is 0 in doubles
    start = F.struct(F.sqrt(half).alias("term"), F.sqrt(half).alias("sum"))

    def add(kept: Column, n: Column) -> Column:
        term = kept.term * 2 * half / (2 * n + 1)
        return F.struct(term.alias("term"), (kept["sum"] + term).alias("sum"))

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(150)), start, add)["sum"]
    return F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-half) * whole)


def chi2_2(x: Column) -> Column:
    """Tail of chi-square with two degrees of freedom."""
    return F.exp(-x / 2)


def xlogy(n: Column, p: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(n * F.log(p))


def kupiec(df: DataFrame, hit: str, level: float) -> DataFrame:
    """n, hits, the likelihood ratio against ``level`` and its p-value."""
    c = df.agg(F.count("*").alias("n"), F.sum(hit).alias("hits")).withColumn("share", F.col("hits") / F.col("n"))
    miss = F.col("n") - F.col("hits")
    null = xlogy(F.col("hits"), F.lit(level)) + xlogy(miss, F.lit(1 - level))
    own = xlogy(F.col("hits"), F.col("share")) + xlogy(miss, 1 - F.col("share"))
    out = c.withColumn("lr", F.greatest(F.lit(0.0), 2 * (own - null)))
    return out.withColumn("p_value", chi2_1(F.col("lr")))


def transitions(df: DataFrame, hit: str) -> DataFrame:
    """n00, n01, n10 and n11 of neighbouring rows."""
    pairs = df.withColumn("was", F.lag(hit).over(Window.orderBy("pos"))).filter("was is not null")
    return pairs.agg(*(F.count_if((F.col("was") == a) & (F.col(hit) == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)))


def holm(df: DataFrame, key: str, p: str, alpha: float = 0.05) -> DataFrame:
    """rejected: by rising (p, key), as long as p <= alpha / (m - k + 1)."""
    order = Window.orderBy(p, key)
    held = F.col(p) <= alpha / (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1)
    return df.withColumn("ok", held.cast("int")).withColumn("rejected", F.min("ok").over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("ok")


def hac_variance(df: DataFrame, d: str, lags: int = 10) -> DataFrame:
    """n, mean and the Bartlett long-run variance of d along pos; autocovariances are divided by n."""
    centred = df.select("pos", (F.col(d) - F.avg(d).over(Window.partitionBy())).alias("e"), F.col(d).alias("d"))
    order = Window.orderBy("pos")
    sums = [F.sum(F.col("e") * F.col(f"e{k}")).alias(f"g{k}") for k in range(lags + 1)]
    got = centred.select("d", "e", *(F.lag("e", k).over(order).alias(f"e{k}") for k in range(lags + 1))).agg(F.count("*").alias("n"), F.avg("d").alias("mean"), *sums)
    total = F.col("g0")
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(f"g{k}", F.lit(0.0))
    return got.select("n", "mean", (total / F.col("n")).alias("variance"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney area, ties counted half; only distinct scores are ordered."""
    by_score = df.groupBy(score).agg(F.count("*").alias("rows"), F.sum(label).alias("hits"))
    below = F.coalesce(F.sum("rows").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = by_score.select("rows", "hits", (F.col("hits") * (below + (F.col("rows") + 1) / 2)).alias("r")).agg(F.sum("r").alias("s"), F.sum("hits").alias("n1"), F.sum("rows").alias("n"))
    return got.select("n", "n1", ((F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * (F.col("n") - F.col("n1")))).alias("auc"))


def independence(counts: DataFrame) -> DataFrame:
    """Likelihood ratio of a first-order chain against independence, from n00, n01, n10 and n11."""
    n00, n01, n10, n11 = (F.col(f"n{k}") for k in ("00", "01", "10", "11"))
    total, ones = n00 + n01 + n10 + n11, n01 + n11
    share = F.try_divide(ones, total)
    after = [(n00, n01, F.try_divide(n01, n00 + n01)), (n10, n11, F.try_divide(n11, n10 + n11))]
    chain = sum((F.coalesce(xlogy(a, 1 - p) + xlogy(b, p), F.lit(0.0)) for a, b, p in after), F.lit(0.0))
    return counts.withColumn("lr", F.greatest(F.lit(0.0), 2 * (chain - xlogy(total - ones, 1 - share) - xlogy(ones, share))))


def pit_bins(df: DataFrame, q: str, y: str, edges: list[float]) -> DataFrame:
    """bin and n: between which of the levels ``edges`` the outcome fell, 0 below the first; empty bins are absent."""
    below = F.array(*(quantile(F.col(q), e) for e in edges))
    return df.groupBy(F.size(F.filter(below, lambda x: x < F.col(y))).alias("bin")).agg(F.count("*").alias("n"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mean over hits of the precision at their score; rows of one score enter together, so only distinct scores are ordered."""
    by_score = df.groupBy(score).agg(F.count("*").alias("rows"), F.sum(label).alias("hits"))
    down = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    each = by_score.select("hits", (F.sum("hits").over(down) / F.sum("rows").over(down)).alias("precision"))
    return each.agg(F.sum("hits").alias("hits"), (F.sum(F.col("hits") * F.col("precision")) / F.sum("hits")).alias("average_precision"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks; rows that are alike in both count together."""
    both = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("m"))
    for c in ("x", "y"):
        below = F.coalesce(F.sum("rows").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = both.groupBy(c).agg(F.sum("m").alias("rows")).select(c, (below + (F.col("rows") + 1) / 2).alias(f"r{c}"))
        both = both.join(ranks, c)
    m, a, b = F.col("m"), F.col("rx"), F.col("ry")
    sums = both.agg(F.sum(m).alias("n"), *(F.sum(m * v).alias(k) for k, v in {"a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}.items()))
    n = F.col("n")
    cov = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / n
    return sums.select("n", (cov("a", "b", "ab") / F.sqrt(cov("a", "a", "aa") * cov("b", "b", "bb"))).alias("rho"))
