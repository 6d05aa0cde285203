"""Walk-forward forecasts from what was public at each decision: changes (B1), day-type pools (B2), mean reversion.

A decision's training window is bounded by dates and by its anchor. A forecast of every decision reads its
window as one frame over the panel; the few decisions of refits are joined to their rows by months.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables
from . import asof, calendars, windows
from .scores import levels

LEADS = [1, 2, 3, 4, 5]
#: The pools that stand in for a day type with too few days.
CHAINS = {"year_end": ["year_end", "quarter_end_turn", "turn"], "quarter_end_turn": ["quarter_end_turn", "turn"], "turn": ["turn"], "tax_date": ["tax_date"], "ordinary": ["ordinary"]}


def decisions(panel: DataFrame) -> DataFrame:
    """decision (pos), day, anchor, last (the anchor's spread) and lag (rows from anchor to decision): the latest row public by 18:00 of the day.

    A read that was not public then, or is not of an earlier row, is an error.
    """
    a = asof.anchors(panel).filter("anchor is not null")
    public = asof.availability(panel, 1, 9).select(F.col("pos").alias("anchor"), "available_at")
    read = asof.require(a.join(public, "anchor"), "pos", "anchor", "available_at", "deadline")
    decision = F.col("pos") - 1
    return read.select(decision.alias("decision"), F.to_date("deadline").alias("day"), "anchor", F.col("anchor_spread").alias("last"), (decision - F.col("anchor")).alias("lag"))


def in_window(origins: DataFrame, rows: DataFrame, years: int) -> DataFrame:
    """Each origin (day, anchor) with the rows (at, date) dated after years before its day, up to its anchor."""
    start = F.add_months("day", -12 * years)
    months = F.sequence(F.trunc(start, "month"), F.trunc("day", "month"), F.expr("INTERVAL 1 MONTH"))
    binned = origins.withColumn("month", F.explode(months))
    return binned.join(rows.withColumn("month", F.trunc("date", "month")), "month").filter((F.col("date") > start) & (F.col("at") <= F.col("anchor"))).drop("month")


def seen(panel: DataFrame, values: dict[str, Column], years: int) -> DataFrame:
    """decisions with seen: an array (at, date, values) of the rows dated after years before the day, up to the anchor.

    One frame over the panel holds every window; a window has as many rows as its years have days.
    """
    frame = Window.orderBy(F.unix_date("date")).rangeBetween(-366 * years, 0)
    row = F.struct(F.col("pos").alias("at"), "date", *(F.col(k) for k in values))
    framed = panel.withColumns(values).select(F.col("pos").alias("decision"), F.collect_list(row).over(frame).alias("seen"))
    start = F.add_months("day", -12 * years)
    return decisions(panel).join(framed, "decision").withColumn("seen", F.filter("seen", lambda s: (s.date > start) & (s["at"] <= F.col("anchor"))))


def empirical(ordered: Column) -> Column:
    """The forecast's quantiles of a sorted array, linear between its values; null of an empty one."""
    top = F.size(ordered) - 1

    def at(level: Column) -> Column:
        place = level * top
        low = F.floor(place).cast("int")
        a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, top))
        return a + (b - a) * (place - low)

    return F.when(top >= 0, F.transform(levels(), at))


def changes_forecast(panel: DataFrame, years: int = 2) -> DataFrame:
    """decision, lead, n and q: the last value plus the quantiles of the window's changes over lead rows."""
    moves = F.array(*(F.col("spread") - F.lag("spread", h).over(windows.by_pos()) for h in LEADS))
    known = seen(panel, {"moves": moves}, years)
    own = lambda i: F.sort_array(F.filter(F.transform("seen", lambda s: s.moves[i]), lambda x: x.isNotNull()))
    each = known.select("decision", "last", F.inline(F.array(*(F.struct(F.lit(h).alias("lead"), own(i).alias("pool")) for i, h in enumerate(LEADS))))).filter(F.size("pool") > 0)
    return each.select("decision", "lead", F.size("pool").cast("long").alias("n"), F.transform(empirical(F.col("pool")), lambda x: x + F.col("last")).alias("q"))


def pool_forecast(panel: DataFrame, years: int = 1, least: int = 4) -> DataFrame:
    """decision, lead, pool, n and q: quantiles of the window's days of the target's pool, of all days where every step of its chain is short."""
    days = calendars.calendar_columns(panel).select("pos", "date", "day_type", "spread")
    known = seen(days, {"day_type": F.col("day_type"), "spread": F.col("spread")}, years)
    rows = lambda name: F.col("seen") if name == "all" else F.filter("seen", lambda s: s.day_type == name)
    sorted_ = F.inline(F.array(*(F.struct(F.lit(name).alias("pool"), F.sort_array(F.transform(rows(name), lambda s: s.spread)).alias("own")) for name in ["all", *CHAINS])))
    pools = known.select("decision", sorted_).filter(F.size("own") > 0).select("decision", "pool", F.size("own").cast("long").alias("n"), empirical(F.col("own")).alias("q"))
    large = pools.filter(F.col("n") >= least).groupBy("decision").agg(F.collect_set("pool").alias("large"))  # six pools at most
    targets = days.select(F.col("pos").alias("at"), F.col("day_type").alias("kind")).withColumn("lead", F.explode(F.array(*map(F.lit, LEADS)))).select((F.col("at") - F.col("lead")).alias("decision"), "lead", "kind")
    chain = F.create_map(*(x for kind, names in CHAINS.items() for x in (F.lit(kind), F.array(*map(F.lit, names)))))
    step = F.filter(chain[F.col("kind")], lambda name: F.array_contains(F.col("large"), name))
    chosen = targets.join(large, "decision", "left").withColumn("pool", F.coalesce(F.get(step, F.lit(0)), F.lit("all")))
    return chosen.join(pools, ["decision", "pool"]).select("decision", "lead", "pool", "n", "q")


def ordinary_levels(panel: DataFrame, days: int = 10) -> DataFrame:
    """panel with level: the median of the last ``days`` ordinary spreads at or before each row, null before there are so many."""
    typed = calendars.calendar_columns(panel)
    frame = windows.rows(1 - days, 0)
    own = typed.filter("day_type = 'ordinary'").select(F.col("pos").alias("p"), F.when(F.count("*").over(frame) == days, F.round(F.percentile("spread", F.lit(0.5)).over(frame), 9)).alias("own"))
    upto = windows.rows(Window.unboundedPreceding, 0)
    return panel.join(own, F.col("pos") == F.col("p"), "left").withColumn("level", F.last("own", True).over(upto)).drop("p", "own")


@dataclass(frozen=True)
class Refits:
    """A walk's training, written: what every model on the same pairs starts from.

    made: decision, day, anchor, last, lag, level (the anchor's) and block of the decisions from the first one on
    at which every lead has enough pairs; skipped: decision and day of those before it.
    pairs: block, fitted, lead, k (rows from origin to target), origin, target, x and y of each refit; x and y are
    distances from the origin's level. phis: block, fitted and phi.
    """

    made: DataFrame
    skipped: DataFrame
    pairs: DataFrame
    phis: DataFrame


def refits(tables: Tables, panel: DataFrame, every: int = 21, years: int = 2, least: int = 60) -> Refits:
    """The refits of a walk over all decisions of a panel, one every ``every`` decisions.

    A pair's origin has a level and lies lead + lag rows before its target, lag being the rows from the refit's own anchor to
    its decision; the target is in the refit's window. phi is the one of 0, 0.01 .. 1 of least squared error over
    all leads' pairs, the smaller on ties. A block whose refit has fewer than ``least`` pairs of a lead has no phi.
    """
    panel = tables.keep(panel, "panel")
    since = F.min(F.when(F.col("level").isNotNull(), F.col("pos"))).over(windows.rows(Window.unboundedPreceding, 0))
    levelled = tables.keep(ordinary_levels(panel).withColumn("since", since), "levels")
    known = decisions(panel).join(levelled.select(F.col("pos").alias("anchor"), "level", "since"), "anchor")
    # the rows up to the start of a decision's window
    before = panel.select(F.lit(0).alias("zero"), "date", (F.col("pos") + 1).alias("outside"))
    known = asof.asof_join(known.withColumns({"zero": F.lit(0), "start": F.add_months("day", -12 * years)}), before, ["zero"], "start", "date", ["outside"])
    first = F.greatest(F.coalesce("outside", F.lit(0)), F.col("since") + max(LEADS) + F.col("lag"))
    ready = F.coalesce(F.col("anchor") - first + 1 >= least, F.lit(False))
    known = known.withColumn("started", F.max(ready).over(Window.orderBy("decision").rowsBetween(Window.unboundedPreceding, 0)))
    skipped = known.filter("not started").select("decision", "day")
    made = known.filter("started").withColumn("block", F.floor((F.row_number().over(Window.orderBy("decision")) - 1) / every))
    made = tables.keep(made.select("decision", "day", "anchor", "last", "lag", "level", "block"), "made")
    fits = made.withColumn("r", F.min("decision").over(Window.partitionBy("block"))).filter("decision = r").select("block", F.col("decision").alias("fitted"), "day", "anchor", "lag")
    targets = in_window(fits, levelled.select(F.col("pos").alias("at"), "date", F.col("spread").alias("later")), years)
    each = targets.withColumn("lead", F.explode(F.array(*map(F.lit, LEADS)))).withColumn("k", F.col("lead") + F.col("lag"))
    origins = levelled.filter("level is not null").select(F.col("pos").alias("origin"), "spread", F.col("level").alias("own"))
    pairs = each.withColumn("origin", F.col("at") - F.col("k")).join(origins, "origin")
    pairs = tables.keep(pairs.select("block", "fitted", "lead", "k", "origin", F.col("at").alias("target"), (F.col("spread") - F.col("own")).alias("x"), (F.col("later") - F.col("own")).alias("y")), "pairs")
    sums = pairs.groupBy("block", "fitted", "lead", "k").agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy")))
    whole = sums.groupBy("block", "fitted").agg(F.collect_list(F.struct("k", "xx", "xy", "yy")).alias("s"), F.min("n").alias("n"), F.count("*").alias("leads")).filter((F.col("n") >= least) & (F.col("leads") == len(LEADS)))

    def loss(i: Column) -> Column:
        one = lambda t: t.yy - 2 * F.pow(i / 100, t.k) * t.xy + F.pow(i / 100, 2 * t.k) * t.xx
        total = F.aggregate(F.array_sort("s"), F.lit(0.0), lambda a, t: a + one(t))
        return F.struct(F.round(total, 3).alias("loss"), (i / 100).alias("phi"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(100)), loss))["phi"]
    return Refits(made, skipped, pairs, tables.keep(whole.select("block", "fitted", best.alias("phi")), "phis"))


def residuals(fitted: Refits) -> DataFrame:
    """The pairs with phi and raw: what mean reversion leaves of y."""
    return fitted.pairs.join(fitted.phis, ["block", "fitted"]).withColumn("raw", F.col("y") - F.pow("phi", "k") * F.col("x"))


def centres(fitted: Refits) -> DataFrame:
    """decision, anchor, block, fitted, phi, lead and centre of every forecast: the level and what is left of the last distance from it after lead + lag rows."""
    now = fitted.made.filter("level is not null").join(fitted.phis, "block").withColumn("lead", F.explode(F.array(*map(F.lit, LEADS))))
    centre = F.col("level") + F.pow("phi", F.col("lead") + F.col("lag")) * (F.col("last") - F.col("level"))
    return now.select("decision", "anchor", "block", "fitted", "phi", "lead", centre.alias("centre"))


def reversion_walk(panel: DataFrame, every: int = 21, years: int = 2, least: int = 60) -> DataFrame:
    """decision, lead, fitted (the fit's decision), phi and q: each lead has the pool of its own residuals around the centre."""
    fitted = refits(Tables(panel.sparkSession), panel, every, years, least)
    pools = residuals(fitted).groupBy("block", "lead").agg(F.percentile("raw", levels()).alias("pool"))
    return centres(fitted).join(pools, ["block", "lead"]).select("decision", "lead", "fitted", "phi", F.transform("pool", lambda x: x + F.col("centre")).alias("q"))
