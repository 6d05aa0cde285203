"""Block bootstrap as joins: fixed blocks are prefix sums, geometric ones rows; replicates are groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def block_sums(series: DataFrame, value: str, length: int) -> DataFrame:
    """at, n and block: the sum of ``length`` values from each place on, wrapped around the end."""
    order = Window.orderBy("pos")
    numbered = series.select((F.row_number().over(order) - 1).alias("at"), F.count("*").over(Window.partitionBy()).alias("n"), F.col(value).alias("v"))
    wrapped = numbered.withColumn("at", F.explode(F.when(F.col("at") < length - 1, F.array("at", F.col("at") + F.col("n"))).otherwise(F.array("at"))))
    summed = wrapped.withColumn("block", F.sum("v").over(Window.orderBy("at").rowsBetween(0, length - 1)))
    return summed.filter(F.col("at") < F.col("n")).select("at", "n", "block")


def block_means(spark: SparkSession, series: DataFrame, value: str, length: int, replicates: int, seed: int = 0) -> DataFrame:
    """replicate and mean: circular blocks whose starts are the leading 32 bits of md5(seed-replicate-block) mod n."""
    blocks = block_sums(series, value, length)
    size = blocks.agg(F.max("n").alias("n")).filter("n is not null")
    draws = spark.range(replicates).withColumnRenamed("id", "replicate").join(F.broadcast(size))
    each = draws.withColumn("b", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / length) - 1)))
    digest = F.md5(F.concat_ws("-", F.lit(seed), "replicate", "b"))
    starts = each.select("replicate", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("n")).alias("at"))
    return starts.join(blocks, "at").groupBy("replicate").agg((F.sum("block") / (F.count("*") * length)).alias("mean"))


def interval(means: DataFrame, level: float = 0.9) -> DataFrame:
    cut = (1 - level) / 2
    return means.agg(F.count("*").alias("replicates"), F.percentile("mean", F.lit(cut)).alias("low"), F.percentile("mean", F.lit(1 - cut)).alias("high"))


def uniform(digest: Column, first: int) -> Column:
    """Eight hexadecimal digits of a digest, from the first on, as a whole number below 2 ** 32."""
    return F.conv(F.substring(digest, first, 8), 16, 10).cast("long")


def stationary_draws(spark: SparkSession, size: DataFrame, length: float, replicates: int, seed: int = 0) -> DataFrame:
    """replicate, n, start, t (the place in the resample of the block's first day) and days of the blocks of every resample of n days.

    Blocks start anywhere, have geometric lengths of mean ``length`` and wrap around the end; the last one is cut. size: one row with n.
    A start is 32 bits of md5(seed-replicate-block) mod n, a length comes from the next 32 bits; length 1 draws single days.
    An error says that four times the expected blocks and 64 more were too few.
    """
    draws = spark.range(replicates).withColumnRenamed("id", "replicate").join(F.broadcast(size.select("n")))
    most = F.ceil(4 * F.col("n") / length) + 64
    each = draws.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
    digest = F.md5(F.concat_ws("-", F.lit(seed), "replicate", "block"))
    drawn = each.withColumn("start", uniform(digest, 1) % F.col("n"))
    chance = (uniform(digest, 9) + 1) / float(1 << 32)  # above 0, at most 1
    days = F.lit(1).cast("long") if length <= 1 else 1 + F.floor(F.log(chance) / F.log(F.lit(1 - 1 / length)))
    order = Window.partitionBy("replicate").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = drawn.withColumn("whole", days).withColumn("end", F.sum("whole").over(order)).withColumn("t", F.col("end") - F.col("whole")).filter(F.col("t") < F.col("n"))
    cut = F.least("whole", F.col("n") - F.col("t"))
    short = (F.col("block") == most - 1) & (F.col("end") < F.col("n"))
    return ends.select("replicate", "n", "start", "t", F.when(short, F.raise_error(F.lit("too few blocks were drawn")).cast("long")).otherwise(cut).alias("days"))


def mean_and_variance(drawn: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """keys, drawn, mean and variance of rows (keys, n, t, value): the mean of a group's days in a sequence of n, and the Bartlett
    long-run variance of the group's deviations from it, 0 on the days of others, divided by n.

    Only the group's own days are rows: those within ``lags`` places of one are among the ``lags`` rows before it.
    """
    order, whole = Window.partitionBy(*keys).orderBy("t"), Window.partitionBy(*keys)
    off = drawn.withColumn("mean", F.avg("value").over(whole)).withColumn("u", F.col("value") - F.col("mean"))
    pairs = [F.struct(F.lag("t", i).over(order).alias("at"), F.lag("u", i).over(order).alias("u")) for i in range(1, lags + 1)]
    near = F.filter(F.array(*pairs), lambda p: F.col("t") - p["at"] <= lags)
    beside = F.aggregate(near, F.lit(0.0), lambda s, p: s + (1 - (F.col("t") - p["at"]) / (lags + 1)) * p.u)
    products = off.select(*keys, "n", "mean", (F.col("u") * (F.col("u") + 2 * beside)).alias("v"))
    return products.groupBy(*keys).agg(F.count("*").alias("drawn"), F.first("mean").alias("mean"), (F.sum("v") / F.first("n")).alias("variance"), F.first("n").alias("n"))


def domain_intervals(spark: SparkSession, series: DataFrame, members: DataFrame, length: float, replicates: int, level: float = 0.9, lags: int = 10, seed: int = 0) -> DataFrame:
    """domain, n (its days), mean, standard_error, draws, dropped, unavailable, lower and upper of every domain of a series.

    series: pos (in order) and value; members: pos and domain, domains may overlap. All domains share the resamples of the whole series, so a block
    never joins days that are far apart. Each resample's mean is studentised by its own long-run variance; an interval is
    the mean less the t-values' outer quantiles times the series' standard error. A resample without a day of the domain makes
    the interval unavailable; one without a variance above 0 is dropped and counted.
    """
    order = Window.orderBy("pos")
    numbered = series.select("pos", (F.row_number().over(order) - 1).alias("at"), F.col("value"))
    placed = numbered.join(members.select("pos", "domain").distinct(), "pos").select("domain", "at", "value")
    size = series.agg(F.count("*").alias("n")).filter("n > 0")
    own = mean_and_variance(placed.withColumnRenamed("at", "t").join(F.broadcast(size)), ["domain"], lags)
    error = F.when(F.col("variance") > 0, F.sqrt(F.col("variance") / F.col("n")) * F.col("n") / F.col("drawn"))
    own = own.select("domain", F.col("drawn").alias("days"), F.col("mean").alias("own"), error.alias("standard_error"))
    blocks = stationary_draws(spark, size, length, replicates, seed)
    step = blocks.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("days") - 1)))
    days = step.select("replicate", "n", (F.col("t") + F.col("i")).alias("t"), ((F.col("start") + F.col("i")) % F.col("n")).alias("at"))
    again = mean_and_variance(days.join(placed, "at"), ["replicate", "domain"], lags)
    each = again.join(own.select("domain", "own"), "domain").withColumn("se", F.when(F.col("variance") > 0, F.sqrt(F.col("variance") / F.col("n")) * F.col("n") / F.col("drawn")))
    found = each.withColumn("ratio", (F.col("mean") - F.col("own")) / F.col("se"))
    cut = (1 - level) / 2
    ends = found.groupBy("domain").agg(F.count("*").alias("draws"), F.count_if(F.col("ratio").isNull()).alias("dropped"), F.percentile("ratio", F.lit(cut)).alias("low"), F.percentile("ratio", F.lit(1 - cut)).alias("high"))
    out = own.join(ends, "domain", "left")
    why = F.when(F.col("standard_error").isNull(), "no long-run variance").when(F.coalesce("draws", F.lit(0)) < replicates, "a resample has no day").when(F.col("dropped") == F.col("draws"), "no resample has a variance")
    out = out.withColumn("unavailable", why)
    end = lambda q: F.when(F.col("unavailable").isNull(), F.col("own") - F.col(q) * F.col("standard_error"))
    return out.select("domain", F.col("days").alias("n"), F.col("own").alias("mean"), "standard_error", F.coalesce("draws", F.lit(0)).alias("draws"), F.coalesce("dropped", F.lit(0)).alias("dropped"), "unavailable", end("high").alias("lower"), end("low").alias("upper"))


def autocovariances(series: DataFrame, lags: int) -> DataFrame:
    """lag (0 to lags) and total, the sum of products of deviations from the mean so far apart, of a series (pos, value): one pass for all lags."""
    centred = series.select("pos", (F.col("value") - F.avg("value").over(Window.partitionBy())).alias("c"))
    ahead = centred.select("c", F.collect_list("c").over(Window.orderBy("pos").rowsBetween(0, lags)).alias("next"))
    each = ahead.select(F.posexplode(F.transform("next", lambda x: F.col("c") * x)).alias("lag", "product"))
    return each.groupBy("lag").agg(F.sum("product").alias("total"))


def block_length(series: DataFrame) -> DataFrame:
    """n, lag, truncation and length: the mean block length of the stationary bootstrap that suits the mean of a series (pos, value).

    lag is the first after which so many autocorrelations in a row lie within 2 * sqrt(log10(n) / n); a flat-topped window of twice
    that many lags gives the spectrum at 0 and its slope. A series of fewer than 20 values, or a constant one, has no length.
    """
    n = series.count()
    if n < 20:
        return series.sparkSession.createDataFrame([(n, None, None, None)], "n long, lag int, truncation int, length double")
    run = max(5, math.ceil(math.sqrt(math.log10(n))))
    most = min(math.ceil(math.sqrt(n)) + run, n - run - 2)
    sums = autocovariances(series, most + run).agg(F.sort_array(F.collect_list(F.struct("lag", "total"))).alias("g"))  # about sqrt(n) numbers
    gamma = sums.select(F.transform("g", lambda x: x.total / n).alias("gamma")).withColumn("rho", F.transform("gamma", lambda x: F.when(F.get("gamma", F.lit(0)) > 0, x / F.get("gamma", F.lit(0)))))
    band = 2 * math.sqrt(math.log10(n) / n)
    quiet = F.filter(F.sequence(F.lit(0), F.lit(most)), lambda m: F.forall(F.slice("rho", m + 2, run), lambda x: F.abs(x) < band))
    found = gamma.withColumn("lag", F.coalesce(F.get(quiet, F.lit(0)), F.lit(most)))
    found = found.withColumn("truncation", F.least(2 * F.greatest("lag", F.lit(1)), F.lit(most)))

    def windowed(times: Column | None) -> Column:
        def part(k: Column) -> Column:
            x = k / F.col("truncation")
            weight = F.when(x <= 0.5, 1.0).otherwise(2 * (1 - x))
            return 2 * weight * F.get("gamma", k) * (k if times is not None else F.lit(1.0))

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.col("truncation")), part), F.lit(0.0), lambda s, x: s + x)

    level, slope = F.get("gamma", F.lit(0)) + windowed(None), windowed(F.lit(1))
    length = F.when(level == 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.cbrt(slope * slope / (level * level)) * n ** (1 / 3)))
    return found.select(F.lit(n).cast("long").alias("n"), "lag", "truncation", F.when(F.get("rho", F.lit(0)).isNotNull(), length).alias("length"))
