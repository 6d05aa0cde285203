"""More queries with their SQL: walk-forward forecasts, guards, projections of single rows, joins of records, rolling checks, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import ANCHOR_SQL, BUSINESS_SQL, CAL_SQL, GRID_SQL, HITS_SQL, LAW_SQL, LEVELS_SQL, TAU, _forecasts, _states, _tail_hits, cdf_sql, forecast_sql, panel_sql, query, r, xlogy_sql
from .catalog import CHAIN_SQL, SCARCITY_SQL
from .operators import asof, benchmarks, calendars, laws, projections, scores, windows
from .sources.tables import VINTAGES_SQL, daily_panel, read, vintages
from .streaming import captures, drained, running_counts, source

THREE = ((0.05, "q05"), (0.5, "q50"), (0.95, "q95"))


def three(q, digits=6):
    return [r(scores.quantile(F.col(q), level), digits).alias(name) for level, name in THREE]


# --- walk-forward forecasts

DECISION_SQL = f"{ANCHOR_SQL}, dc AS (SELECT pos - 1 AS decision, deadline::DATE AS day, anchor, anchor_spread AS last FROM anchors WHERE anchor IS NOT NULL)"


@query(
    panel_sql(
        "SELECT decision, CAST(lead AS INTEGER) AS lead, count(*) AS n, round(any_value(last) + quantile_cont(move, 0.05), 10) AS q05, round(any_value(last) + quantile_cont(move, 0.5), 10) AS q50, round(any_value(last) + quantile_cont(move, 0.95), 10) AS q95 "
        "FROM dc JOIN ch ON ch.pos <= anchor AND ch.date > day - INTERVAL 24 MONTH GROUP BY decision, lead",
        DECISION_SQL + ", ch AS (SELECT a.pos, a.date, k AS lead, a.spread - b.spread AS move FROM panel a, unnest([1, 2, 3, 4, 5]) AS u(k), panel b WHERE b.pos = a.pos - k)",
    )
)
def benchmark_changes(spark, d):
    """B1: at each decision the last public value plus two years of its own changes, by lead."""
    return benchmarks.changes_forecast(daily_panel(spark, d)).select("decision", "lead", "n", *three("q", 10))


POOLS_SQL = f"""{CAL_SQL}, {DECISION_SQL},
wn AS (SELECT decision, kind, count(*) AS n, quantile_cont(spread, [0.05, 0.5, 0.95]) AS q FROM dc JOIN (SELECT pos, date, spread, unnest([day_type, 'all']) AS kind FROM cal) c ON c.pos <= anchor AND c.date > day - INTERVAL 12 MONTH GROUP BY 1, 2),
tg AS (SELECT pos - k AS decision, CAST(k AS INTEGER) AS lead, day_type FROM cal, unnest([1, 2, 3, 4, 5]) AS u(k)),
cp AS (SELECT tg.decision, lead, CASE WHEN a.n >= 4 THEN day_type WHEN day_type = 'year_end' AND b.n >= 4 THEN 'quarter_end_turn' WHEN day_type IN ('year_end', 'quarter_end_turn') AND c.n >= 4 THEN 'turn' ELSE 'all' END AS pool
  FROM tg LEFT JOIN wn a ON a.decision = tg.decision AND a.kind = day_type LEFT JOIN wn b ON b.decision = tg.decision AND b.kind = 'quarter_end_turn' LEFT JOIN wn c ON c.decision = tg.decision AND c.kind = 'turn')"""


@query(panel_sql("SELECT cp.decision, lead, pool, n, round(q[1], 10) AS q05, round(q[2], 10) AS q50, round(q[3], 10) AS q95 FROM cp JOIN wn ON wn.decision = cp.decision AND wn.kind = pool", POOLS_SQL))
def benchmark_pools(spark, d):
    """B2: quantiles of the year's days of the target's type, with the fallback chain."""
    return benchmarks.pool_forecast(daily_panel(spark, d)).select("decision", "lead", "pool", "n", *three("q", 10))


#: Decisions from the first that has 60 pairs of every lead on, refits every 21 of them, their pairs, phis and pools of residuals.
PAIRS_SQL = f"""{CAL_SQL}, {LEVELS_SQL}, {DECISION_SQL},
si AS (SELECT min(pos) AS since FROM lev WHERE level IS NOT NULL),
kn AS (SELECT d.*, d.decision - d.anchor AS lag, lev.level, coalesce(since <= d.anchor AND d.anchor - greatest((SELECT count(*) FROM panel WHERE date <= day - INTERVAL 24 MONTH), since + 5 + d.decision - d.anchor) + 1 >= 60, false) AS ready FROM dc d JOIN lev ON lev.pos = d.anchor, si),
md AS (SELECT *, (row_number() OVER (ORDER BY decision) - 1) // 21 AS block FROM kn WHERE decision >= (SELECT min(decision) FROM kn WHERE ready)),
ft AS (SELECT block, arg_min(day, decision) AS day, arg_min(anchor, decision) AS anchor, arg_min(lag, decision) AS lag, min(decision) AS fitted FROM md GROUP BY 1),
ins AS (SELECT block, fitted, CAST(h AS INTEGER) AS lead, h + lag AS k, a.pos AS origin, t.pos AS target, a.spread - a.level AS x, t.spread - a.level AS y FROM ft JOIN panel t ON t.pos <= anchor AND t.date > day - INTERVAL 24 MONTH, unnest([1, 2, 3, 4, 5]) AS u(h), lev a WHERE a.pos = t.pos - h - lag AND a.level IS NOT NULL),
sm AS (SELECT block, fitted, lead, k, count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM ins GROUP BY 1, 2, 3, 4),
ls AS (SELECT block, i / 100 AS phi, round(sum(yy - 2 * power(i / 100, k) * xy + power(i / 100, 2 * k) * xx), 3) AS loss, min(n) AS least, count(*) AS leads FROM sm, unnest(range(0, 101)) AS g(i) GROUP BY 1, 2),
ph AS (SELECT block, phi FROM ls WHERE least >= 60 AND leads = 5 QUALIFY row_number() OVER (PARTITION BY block ORDER BY loss, phi) = 1),
rs AS (SELECT ins.*, phi, y - power(phi, k) * x AS raw FROM ins JOIN ph USING (block)),
ce AS (SELECT decision, anchor, block, fitted, phi, CAST(lead AS INTEGER) AS lead, level + power(phi, lead + lag) * (last - level) AS centre FROM md JOIN ph USING (block) JOIN (SELECT block, fitted FROM ft) USING (block), unnest([1, 2, 3, 4, 5]) AS u(lead) WHERE level IS NOT NULL)"""
WALK_SQL = f"""{PAIRS_SQL},
po AS (SELECT block, lead, quantile_cont(raw, [0.05, 0.5, 0.95]) AS pool FROM rs GROUP BY 1, 2),
wk AS (SELECT * FROM ce JOIN po USING (block, lead))"""


@query(panel_sql("SELECT decision, lead, fitted, phi, round(centre + pool[1], 5) AS q05, round(centre + pool[2], 5) AS q50, round(centre + pool[3], 5) AS q95 FROM wk", WALK_SQL))
def reversion_walk(spark, d):
    """Mean reversion, refitted every 21 decisions on what was public; one row a decision and lead."""
    w = benchmarks.reversion_walk(daily_panel(spark, d))
    return w.select("decision", "lead", "fitted", "phi", *(r(scores.quantile(F.col("q"), level), 5).alias(name) for level, name in THREE))


@query(panel_sql("SELECT lead, count(*) AS n, round(avg(abs(centre + pool[2] - p.spread)), 5) AS mae, round(avg((p.spread BETWEEN centre + pool[1] AND centre + pool[3])::INTEGER), 6) AS coverage_90 FROM wk JOIN panel p ON p.pos = decision + lead GROUP BY 1", WALK_SQL))
def reversion_scores(spark, d):
    p = daily_panel(spark, d)
    w = benchmarks.reversion_walk(p).join(p.select("pos", "spread"), F.col("pos") == F.col("decision") + F.col("lead"))
    q, y = F.col("q"), F.col("spread")
    inside = y.between(scores.quantile(q, 0.05), scores.quantile(q, 0.95)).cast("int")
    return w.groupBy("lead").agg(F.count("*").alias("n"), r(F.avg(F.abs(scores.quantile(q, 0.5) - y)), 5).alias("mae"), r(F.avg(inside)).alias("coverage_90"))


# --- as-of reads and guards


@query(panel_sql("SELECT rule, count(*) AS n FROM (SELECT CASE WHEN anchor + pos % 3 >= pos THEN 'look ahead' WHEN anchor + pos % 3 > anchor THEN 'not public' WHEN pos % 7 = 0 THEN 'stale' END AS rule FROM anchors WHERE anchor IS NOT NULL) WHERE rule IS NOT NULL GROUP BY 1", ANCHOR_SQL))
def refused_reads(spark, d):
    """Reads that were planted wrong: up to two rows too new, or a row too old, named by the rule they break."""
    p = daily_panel(spark, d)
    a = asof.anchors(p).filter("anchor is not null").withColumn("read", F.when(F.col("pos") % 7 == 0, F.col("anchor") - F.when(F.col("pos") % 3 == 0, 1).otherwise(0)).otherwise(F.col("anchor")) + F.col("pos") % 3)
    public = asof.availability(p, 1, 9).select(F.col("pos").alias("read"), "available_at")
    # what the rule says of a read: its row, when it was public, and the newest row that was
    bad = asof.refused(a.join(public, "read", "left"), "pos", "read", "available_at", "deadline", "anchor")
    return bad.groupBy("rule").agg(F.count("*").alias("n"))


@query(panel_sql("SELECT pos, anchor, anchor_spread, p.n AS anchor_n, w.date AS week_day, round(w.volume, 6) AS week_volume, CAST(date_diff('day', w.date, a.deadline::DATE) AS INTEGER) AS week_age FROM anchors a LEFT JOIN panel p ON p.pos = a.anchor ASOF LEFT JOIN (SELECT * FROM panel WHERE isodow(date) = 3) w ON a.deadline >= w.date + INTERVAL 42 HOUR", ANCHOR_SQL).replace("SELECT pos, anchor,", "SELECT a.pos, a.anchor,"))
def information_set(spark, d):
    """What a forecast of each row may read: the anchor of the daily columns, and the latest Wednesday published by 18:00 of the Thursday after."""
    p = daily_panel(spark, d)
    a = asof.anchors(p).withColumn("k", F.lit(0))
    week = p.filter(F.weekday("date") == 2).select(F.lit(0).alias("k"), (F.col("date").cast("timestamp") + F.make_dt_interval(hours=F.lit(42))).alias("at"), F.col("date").alias("week_day"), "volume")
    both = asof.asof_join(a, week, ["k"], "deadline", "at", ["week_day", "volume"])
    own = p.select(F.col("pos").alias("anchor"), F.col("n").alias("anchor_n"))
    age = F.datediff(F.to_date("deadline"), "week_day")
    return both.join(own, "anchor", "left").select("pos", "anchor", "anchor_spread", "anchor_n", "week_day", r("volume").alias("week_volume"), age.alias("week_age"))


@query(panel_sql("SELECT w.day, p.date AS read_day, CASE WHEN date_diff('day', p.date, w.day) <= 3 THEN p.bp END AS bp FROM (SELECT day FROM bd) w ASOF LEFT JOIN (SELECT * FROM panel WHERE n > 5) p ON w.day >= p.date", BUSINESS_SQL))
def carried_prints(spark, d):
    """The latest well-covered print of each business day, at most three days old."""
    p = daily_panel(spark, d).filter("n > 5")
    return asof.carried(p, "date", calendars.business_days(spark).select("day"), "day", ["bp"], 3).select("day", "read_day", "bp")


@query(f"WITH {VINTAGES_SQL}, f AS (SELECT series, ref_date, arg_min(value, struct_pack(a := available_at, v := vintage, x := value)) AS first_value, arg_max(value, struct_pack(a := available_at, v := vintage, x := value)) AS last_value, count(*) AS n FROM vintages GROUP BY 1, 2) SELECT series, ref_date, first_value, last_value, n FROM f WHERE first_value <> last_value")
def revisions(spark, d):
    """Observations whose latest vintage differs from the first."""
    order = F.struct("available_at", "vintage", "value")
    got = vintages(spark, d).groupBy("series", "ref_date").agg(F.min_by("value", order).alias("first_value"), F.max_by("value", order).alias("last_value"), F.count("*").alias("n"))
    return got.filter("first_value <> last_value")


@query("SELECT kind, count(*) FILTER (announced <= TIMESTAMP '1999-02-10') AS known, count(*) FILTER (announced <= TIMESTAMP '1999-02-10' AND o_orderdate > TIMESTAMP '1999-02-10') AS announced_only, max(o_orderdate) FILTER (announced <= TIMESTAMP '1999-02-10' AND o_orderdate <= TIMESTAMP '1999-02-10') AS in_force_since FROM (SELECT o_orderpriority AS kind, o_orderdate, o_orderdate - INTERVAL 1 DAY * (o_orderkey % 40) AS announced FROM orders) GROUP BY 1")
def policy_state(spark, d):
    """Of each kind, what was announced by an instant, what of it was not in force yet, and since when the rest was."""
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("kind"), "o_orderdate", (F.col("o_orderdate") - F.make_dt_interval(F.col("o_orderkey") % 40)).alias("announced"))
    now = F.lit("1999-02-10").cast("timestamp")
    known, begun = F.col("announced") <= now, F.col("o_orderdate") <= now
    return o.groupBy("kind").agg(F.count_if(known).alias("known"), F.count_if(known & ~begun).alias("announced_only"), F.max(F.when(known & begun, F.col("o_orderdate"))).alias("in_force_since"))


# --- calendars

MONTH_END = "date_diff('day', date, last_day(date))"
FLAGS_SQL = f"fl AS (SELECT *, (month(date) % 3 = 0 AND {MONTH_END} = 0)::DOUBLE AS quarter_end, (month(date) IN (1, 4, 6, 9, 12) AND day(date) BETWEEN 15 AND 17)::DOUBLE AS tax, CAST({MONTH_END} AS DOUBLE) AS to_end, CASE WHEN n <> 7 THEN greatest(0, n - 8) END AS coupons FROM panel)"


def _flags(spark, d):
    p = daily_panel(spark, d)
    to_end = F.datediff(F.last_day("date"), "date").cast("double")
    quarter = ((F.month("date") % 3 == 0) & (to_end == 0)).cast("double")
    tax = calendars.tax_day(F.col("date")).cast("double")
    return p.withColumns({"quarter_end": quarter, "tax": tax, "to_end": to_end, "coupons": F.when(F.col("n") != 7, F.greatest(F.lit(0), F.col("n") - 8))})


@query(panel_sql("SELECT date, CASE WHEN coupons IS NOT NULL THEN (quarter_end = 1 OR tax = 1 OR to_end <= 1 OR coupons > 0)::DOUBLE END AS settlement_day, CASE WHEN quarter_end = 1 THEN 'quarter_end' WHEN to_end <= 1 THEN 'month_end' WHEN tax = 1 THEN 'tax_date' ELSE 'ordinary' END AS split_type, quarter_end = 1 OR tax = 1 OR coalesce(coupons, 0) > 0 AS risk, month(date) = 12 AND day(date) = 26 AS december_26 FROM fl", FLAGS_SQL))
def day_flags(spark, d):
    f, c = _flags(spark, d), F.col
    return f.select(
        "date",
        projections.settlement_day(c("quarter_end"), c("tax"), c("to_end"), c("coupons")).alias("settlement_day"),
        projections.split_day_type(c("quarter_end"), c("to_end"), c("tax")).alias("split_type"),
        projections.scheduled_risk(c("quarter_end"), c("tax"), c("coupons")).alias("risk"),
        ((F.month("date") == 12) & (F.dayofmonth("date") == 26)).alias("december_26"),
    )


@query(panel_sql("SELECT split_type, day_type, count(*) AS n FROM (SELECT date, CASE WHEN quarter_end = 1 THEN 'quarter_end' WHEN to_end <= 1 THEN 'month_end' WHEN tax = 1 THEN 'tax_date' ELSE 'ordinary' END AS split_type FROM fl) JOIN cal USING (date) WHERE split_type <> day_type GROUP BY 1, 2", f"{CAL_SQL}, {FLAGS_SQL}"))
def day_set_changes(spark, d):
    """Days whose label differs between two definitions of day types."""
    c = F.col
    mine = _flags(spark, d).select("date", projections.split_day_type(c("quarter_end"), c("to_end"), c("tax")).alias("split_type"))
    other = calendars.calendar_columns(daily_panel(spark, d)).select("date", "day_type")
    return mine.join(other, "date").filter("split_type <> day_type").groupBy("split_type", "day_type").agg(F.count("*").alias("n"))


@query(panel_sql("SELECT date, round(CASE WHEN day(date) BETWEEN 19 AND 25 THEN (day(date) - 18) / 7 ELSE 0 END, 6) AS ramp, round(CASE WHEN date = paid THEN 1 WHEN day(date) >= 25 THEN 0 WHEN day(date) >= 19 THEN (day(date) - 18) / 7 ELSE 0 END, 6) AS roll_ramp, paid, ow.day IS NOT NULL AS october_window FROM panel JOIN (SELECT date_trunc('month', day)::DATE AS m, min(day) AS paid FROM bd WHERE day(day) >= 25 GROUP BY 1) ON m = date_trunc('month', date)::DATE LEFT JOIN (SELECT day FROM bd WHERE month(day) = 10 AND day(day) >= 15 QUALIFY row_number() OVER (PARTITION BY year(day) ORDER BY day) <= 3) ow ON ow.day = date", BUSINESS_SQL))
def payment_calendar(spark, d):
    business = calendars.business_days(spark)
    p = daily_panel(spark, d).select("date", F.trunc("date", "month").alias("month")).join(calendars.payment_days(business), "month")
    october = calendars.october_window(business).withColumn("in_window", F.lit(True))
    p = p.join(october, "date", "left")
    return p.select("date", r(calendars.ramp(F.col("date"))).alias("ramp"), r(calendars.roll_ramp(F.col("date"), F.col("paid"))).alias("roll_ramp"), "paid", F.coalesce("in_window", F.lit(False)).alias("october_window"))


# --- projections

RATIO_SQL = "ra AS (SELECT date, spread, rate, CASE WHEN n > 3 THEN volume END AS buffer, CASE WHEN n <> 5 THEN n / 50.0 END AS ratio, spread - lag(spread) OVER (ORDER BY pos) AS flow FROM panel)"


@query(
    panel_sql(
        "SELECT date, (buffer < 12)::DOUBLE AS depleted, round(rate * (buffer < 12)::DOUBLE, 10) AS level_when_depleted, round(exp((0.12 - ratio) / 0.02), 6) AS slope, round(CASE WHEN ratio IS NOT NULL THEN exp(greatest(0, 0.12 - ratio) / 0.02) END, 6) AS kinked_slope, "
        "round(CASE WHEN buffer IS NOT NULL AND flow IS NOT NULL THEN greatest(0, greatest(0, flow) - buffer) END, 10) AS shortfall, round(CASE WHEN buffer IS NOT NULL AND flow IS NOT NULL THEN least(greatest(flow, 0), greatest(buffer, 0)) - flow END, 10) AS reserve_change, "
        "round(ratio - 0.12, 6) AS distance, ((round_even(flow, 0) % 25) + 25) % 25 <> 0 AS technical, CASE WHEN spread IS NULL THEN NULL WHEN spread <= -20 THEN 'low' WHEN spread <= 5 THEN 'calm' ELSE 'high' END AS bucket FROM ra",
        RATIO_SQL,
    )
)
def liquidity_projections(spark, d):
    p = daily_panel(spark, d)
    buffer, ratio = F.when(F.col("n") > 3, F.col("volume")), F.when(F.col("n") != 5, F.col("n") / 50.0)
    p = p.select("date", "spread", "rate", buffer.alias("buffer"), ratio.alias("ratio"), windows.change("spread", 1).alias("flow"))
    c = F.col
    return p.select(
        "date",
        projections.depleted(c("buffer"), 12).alias("depleted"),
        r(projections.when_depleted(c("rate"), c("buffer"), 12), 10).alias("level_when_depleted"),
        r(projections.elasticity(c("ratio"))).alias("slope"),
        r(projections.elasticity(c("ratio"), kinked=True)).alias("kinked_slope"),
        r(projections.shortfall(c("flow"), c("buffer")), 10).alias("shortfall"),
        r(projections.reserve_change(c("flow"), c("buffer")), 10).alias("reserve_change"),
        r(c("ratio") - 0.12).alias("distance"),
        projections.technical(c("flow")).alias("technical"),
        projections.bucket_label(c("spread"), [("low", None, -20), ("calm", -20, 5), ("high", 5, None)]).alias("bucket"),
    )


@query("SELECT user_id, round(list_product([1 - h[1], 1 - h[2], 1 - h[3], 1 - h[4], 1 - h[5]]), 9) AS survival_5, round(h[3] * (1 - h[1]) * (1 - h[2]), 9) AS passage_3, round(1 - (1 - h[1]) * (1 - h[2]), 9) AS within_2, round(ln(greatest(1e-6, least(1 - 1e-6, h[1])) / (1 - greatest(1e-6, least(1 - 1e-6, h[1])))), 6) AS logit_1 FROM (SELECT user_id, list_transform([1, 2, 3, 4, 5], lambda i: least(1, i * errors / n)) AS h FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1))")
def hazard_curves(spark, d):
    """First-passage probabilities of users whose hazard rises with each step."""
    e = read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    h = e.select("user_id", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.least(F.lit(1.0), i * F.col("errors") / F.col("n"))).alias("h"))
    s = projections.survival(F.col("h"))
    return h.select("user_id", r(F.element_at(s, 5), 9).alias("survival_5"), r(F.element_at(projections.first_passage(F.col("h")), 3), 9).alias("passage_3"), r(1 - F.element_at(s, 2), 9).alias("within_2"), r(projections.logit(F.element_at("h", 1))).alias("logit_1"))


@query(panel_sql("SELECT pos, round(least(q[21], 4.0), 6) AS capped_95, round(0.25 * q[3] + 0.75 * (q[3] + q[12]) / 2, 6) AS blended_05, round(greatest(q[21] - q[3], 1), 6) AS width, round((list_sort(list_transform(q, lambda x, i: x + CASE WHEN i <= 3 THEN 40 ELSE 0 END)))[1], 6) AS lowest, round(abs(q[12] - outcome), 6) AS median_error FROM fc", forecast_sql()))
def quantile_vectors(spark, d):
    """Operations on whole forecasts: a cap, a blend, the width, a correction that would cross, the median's error."""
    f, q = _forecasts(spark, d), F.col("q")
    middle = F.transform(q, lambda x: (x + scores.quantile(q, 0.5)) / 2)
    shift = F.array(*(F.lit(40.0 if i < 3 else 0.0) for i in range(len(scores.GRID))))
    return f.select(
        "pos",
        r(scores.quantile(projections.capped(q, F.lit(4.0)), 0.95)).alias("capped_95"),
        r(scores.quantile(projections.blended(q, middle, 0.25), 0.05)).alias("blended_05"),
        r(F.greatest(scores.quantile(q, 0.95) - scores.quantile(q, 0.05), F.lit(1.0))).alias("width"),
        r(F.element_at(projections.corrected(q, shift), 1)).alias("lowest"),
        r(F.abs(scores.quantile(q, 0.5) - F.col("outcome"))).alias("median_error"),
    )


# --- scores and tests


@query(panel_sql(f"SELECT pos, round({cdf_sql('(round_even(outcome, 0) - 0.5)')}, 6) AS low, round({cdf_sql('(round_even(outcome, 0) + 0.5)')}, 6) AS high FROM law", LAW_SQL))
def pit_intervals(spark, d):
    low, high = laws.pit_interval(F.col("q"), F.col("outcome"))
    return _forecasts(spark, d).select("pos", r(low).alias("low"), r(high).alias("high"))


@query(panel_sql("SELECT tau, count(*) AS n, round(avg(power(p - e, 2)), 6) AS brier, round(min(p), 6) AS least, CAST(count(*) FILTER (p = 0 AND e = 1) AS BIGINT) AS zero_on_events FROM (" + " UNION ALL ".join(f"SELECT {tau} AS tau, 1 - ({cdf_sql(str(tau + 0.5))}) AS p, (outcome > {tau + 0.5})::INTEGER AS e FROM law" for tau in (0, 5, 10, 20)) + ") GROUP BY 1", LAW_SQL))
def brier_by_threshold(spark, d):
    """Brier score at several thresholds, and events that were given no probability."""
    each = F.array(*(F.struct(F.lit(t).alias("tau"), laws.exceedance(F.col("q"), t).alias("p"), (F.col("outcome") > t + 0.5).cast("int").alias("e")) for t in (0, 5, 10, 20)))
    f = _forecasts(spark, d).select(F.inline(each))
    return f.groupBy("tau").agg(F.count("*").alias("n"), r(F.avg(F.pow(F.col("p") - F.col("e"), 2))).alias("brier"), r(F.min("p")).alias("least"), F.count_if((F.col("p") == 0) & (F.col("e") == 1)).alias("zero_on_events"))


COVER_SQL = f"{xlogy_sql('(n00 + n01 + n10 + n11 - h)', '0.95')} + {xlogy_sql('h', '0.05')}"
OWN_SQL = f"{xlogy_sql('(n00 + n01 + n10 + n11 - h)', '(1 - h / (n00 + n01 + n10 + n11))')} + {xlogy_sql('h', '(h / (n00 + n01 + n10 + n11))')}"


@query(panel_sql(f"SELECT round(lr, 6) AS lr, round(exp(-lr / 2), 6) AS p_value FROM (SELECT greatest(0, 2 * ({CHAIN_SQL})) + greatest(0, 2 * (({OWN_SQL}) - ({COVER_SQL}))) AS lr FROM (SELECT *, n01 + n11 AS h FROM nn))", f"{forecast_sql()}, {HITS_SQL}"))
def conditional_coverage(spark, d):
    """Christoffersen's joint test: coverage (of the rows that have a row before them) and independence, chi-square with two degrees."""
    counts = scores.independence(scores.transitions(_tail_hits(spark, d), "hit")).withColumn("n", F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")).withColumn("h", F.col("n01") + F.col("n11"))
    n, h = F.col("n"), F.col("h")
    own = scores.xlogy(h, h / n) + scores.xlogy(n - h, 1 - h / n)
    null = scores.xlogy(h, F.lit(0.05)) + scores.xlogy(n - h, F.lit(0.95))
    lr = F.col("lr") + F.greatest(F.lit(0.0), 2 * (own - null))
    return counts.select(r(lr).alias("lr"), r(scores.chi2_2(lr)).alias("p_value"))


@query(panel_sql("SELECT pos, CASE WHEN count(*) OVER a = 60 THEN round(avg(inside) OVER a, 6) END AS coverage_60, CASE WHEN count(*) OVER b = 125 THEN round(avg(above) OVER b, 6) END AS above_125 FROM (SELECT pos, (outcome BETWEEN q[3] AND q[21])::INTEGER AS inside, (outcome > q[12])::INTEGER AS above FROM fc) WINDOW a AS (ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), b AS (ORDER BY pos ROWS BETWEEN 124 PRECEDING AND CURRENT ROW)", forecast_sql()))
def rolling_coverage(spark, d):
    """Coverage over each day's last 60 forecasts and the share above the median over 125; null until there are so many."""
    q, y = F.col("q"), F.col("outcome")
    f = _forecasts(spark, d).select("pos", y.between(scores.quantile(q, 0.05), scores.quantile(q, 0.95)).cast("int").alias("inside"), (y > scores.quantile(q, 0.5)).cast("int").alias("above"))
    over = lambda c, n: F.when(F.count("*").over(windows.rows(1 - n, 0)) == n, r(F.avg(c).over(windows.rows(1 - n, 0))))
    return f.select("pos", over("inside", 60).alias("coverage_60"), over("above", 125).alias("above_125"))


@query(panel_sql("SELECT day_type, count(*) AS n, round((list_sort(list(abs(q[12] - outcome))))[CAST(least(count(*), greatest(1, ceil(0.9::DOUBLE * (count(*) + 1)))) AS BIGINT)], 6) AS conformal_90, CASE WHEN count(*) < 20 THEN 'none' WHEN count(*) < 60 THEN 'thin' ELSE 'full' END AS support FROM fc JOIN (SELECT pos - 1 AS pos, day_type FROM cal) USING (pos) GROUP BY 1", f"{CAL_SQL}, {forecast_sql()}"))
def conformal_by_day_type(spark, d):
    """The 90 % order statistic of absolute errors of each day type, and how far its days suffice."""
    target = calendars.calendar_columns(daily_panel(spark, d)).select((F.col("pos") - 1).alias("pos"), "day_type")
    error = F.abs(scores.quantile(F.col("q"), 0.5) - F.col("outcome"))
    got = _forecasts(spark, d).join(target, "pos").groupBy("day_type").agg(F.count("*").alias("n"), F.collect_list(error).alias("errors"))  # one number a day
    return got.select("day_type", "n", r(projections.conformal_quantile(F.col("errors"), 0.9)).alias("conformal_90"), F.when(F.col("n") < 20, "none").when(F.col("n") < 60, "thin").otherwise("full").alias("support"))


@query(panel_sql("SELECT year, CAST(sum(flag) FILTER (place <= 20) AS BIGINT) AS hits, round(sum(flag) FILTER (place <= 20) / 20, 6) AS precision, round(sum(flag) FILTER (place <= 20) / nullif(sum(flag), 0), 6) AS recall FROM (SELECT CAST(year(date) AS INTEGER) AS year, (bp > 5)::INTEGER AS flag, row_number() OVER (PARTITION BY year(date) ORDER BY n DESC, pos) AS place FROM panel) GROUP BY 1"))
def top_k_first(spark, d):
    """Precision and recall among each year's 20 highest counts, earlier days first among equals."""
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "pos"))
    p = daily_panel(spark, d).select(F.year("date").alias("year"), "n", "pos", (F.col("bp") > TAU).cast("int").alias("flag")).withColumn("place", place)
    got = p.groupBy("year").agg(F.sum(F.when(F.col("place") <= 20, F.col("flag"))).alias("hits"), F.sum("flag").alias("events"))
    return got.select("year", "hits", r(F.col("hits") / 20).alias("precision"), r(F.try_divide("hits", "events")).alias("recall"))


# --- windows and joins of records


@query(panel_sql("SELECT pos, CASE WHEN count(*) OVER w = 20 THEN round(avg((p75 > rate + 0.2)::INTEGER) OVER w, 6) END AS share_above, coalesce(n = lag(n) OVER (ORDER BY pos) AND bp = lag(bp) OVER (ORDER BY pos), false) AS copied FROM panel WINDOW w AS (ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def share_above(spark, d):
    """Share of the last 20 rows with the upper quartile well over the mean; and rows that repeat the one before."""
    p, order, frame = daily_panel(spark, d), windows.by_pos(), windows.rows(-19, 0)
    share = F.when(F.count("*").over(frame) == 20, r(F.avg((F.col("p75") > F.col("rate") + 0.2).cast("int")).over(frame)))
    same = (F.col("n") == F.lag("n").over(order)) & (F.col("bp") == F.lag("bp").over(order))
    return p.select("pos", share.alias("share_above"), F.coalesce(same, F.lit(False)).alias("copied"))


@query(panel_sql("SELECT state_a, state_b, count(*) AS n FROM (SELECT a.state AS state_a, b.state AS state_b FROM st a JOIN st b ON b.date = a.date + 1) GROUP BY 1, 2", SCARCITY_SQL))
def state_transitions(spark, d):
    """How often one day's state is followed by the next day's; unknown states count."""
    s = _states(spark, d).select("date", "state")
    pairs = s.withColumnRenamed("state", "state_a").join(s.select(F.date_sub("date", 1).alias("date"), F.col("state").alias("state_b")), "date")
    return pairs.groupBy("state_a", "state_b").agg(F.count("*").alias("n"))


@query("""WITH days AS (SELECT user_id, ts::DATE AS day, event_type FROM events), a AS (SELECT DISTINCT user_id, day FROM days WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id, day FROM days WHERE event_type = 'click')
    SELECT CASE WHEN b.day IS NULL THEN 'gone' WHEN a.day IS NULL THEN 'new' ELSE 'both' END AS found, count(*) AS n FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day GROUP BY 1""")
def compared_sets(spark, d):
    """Two sets of (user, day): in both, only in the first, only in the second."""
    e = read(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    marked = e.filter(F.col("event_type").isin("view", "click")).groupBy("user_id", "day").agg(F.max((F.col("event_type") == "view").cast("int")).alias("a"), F.max((F.col("event_type") == "click").cast("int")).alias("b"))
    return marked.groupBy(F.when(F.col("b") == 0, "gone").when(F.col("a") == 0, "new").otherwise("both").alias("found")).agg(F.count("*").alias("n"))


@query("""WITH due AS (SELECT user_id, day FROM (SELECT DISTINCT user_id FROM events), (SELECT CAST(unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM events) WHERE isodow(day) < 6)
    SELECT user_id, count(*) AS misses, min(day) AS first_miss FROM due d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.user_id AND e.ts::DATE = d.day) AND NOT (d.user_id % 5 = 0 AND day(d.day) = 10) GROUP BY 1""")
def unlisted_misses(spark, d):
    """Business days of each user without a record that are not on the list of known misses."""
    e = read(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    ends = e.groupBy("user_id").agg(F.lit(0).alias("k")).join(e.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.lit(0).alias("k")), "k")  # one row on the right
    due = ends.select("user_id", F.explode(F.sequence("a", "b")).alias("day")).filter(F.weekday("day") < 5)
    listed = due.filter("user_id % 5 = 0 and dayofmonth(day) = 10")
    missed = due.join(e.distinct(), ["user_id", "day"], "left_anti").join(listed, ["user_id", "day"], "left_anti")
    return missed.groupBy("user_id").agg(F.count("*").alias("misses"), F.min("day").alias("first_miss"))


@query("SELECT a.kind AS kind, b.kind AS other, count(*) AS overlaps FROM (SELECT o_orderpriority AS kind, year(o_orderdate) AS y, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1, 2) a JOIN (SELECT o_orderpriority AS kind, year(o_orderdate) AS y, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1, 2) b ON a.y = b.y AND a.kind < b.kind AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY 1, 2")
def overlapping_windows(spark, d):
    """Event windows of two kinds in one year that overlap."""
    o = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind"), F.year("o_orderdate").alias("y")).agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    other = o.toDF("other", "y", "lo2", "hi2")
    return o.join(other, "y").filter("kind < other and lo <= hi2 and lo2 <= hi").groupBy("kind", "other").agg(F.count("*").alias("overlaps"))


@query("SELECT kind, sha256(kind || '|' || CAST(lo AS VARCHAR) || '|' || CAST(hi AS VARCHAR)) AS digest FROM (SELECT o_orderpriority AS kind, min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders GROUP BY 1)")
def window_digests(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    return o.select("kind", F.sha2(F.concat_ws("|", "kind", "lo", "hi"), 256).alias("digest"))


# --- streams

def _stream(spark, d):
    path = f"{d}/events.parquet"
    return source(spark, path, spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    """The events read as a stream until it has drained: all days, those still open and late events included."""
    return drained(running_counts(_stream(spark, d)), keys=["day", "event_type"])


@query(
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts FROM events WHERE event_type = 'view'),
    m AS (SELECT p.event_id, p.ts, max(v.ts <= p.ts + INTERVAL 6 HOUR) AS soon FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.ts BETWEEN p.ts AND p.ts + INTERVAL 24 HOUR GROUP BY 1, 2)
    SELECT event_id, CASE WHEN soon IS NULL THEN 'missed' WHEN soon THEN 'captured' ELSE 'late' END AS status FROM m
    WHERE soon IS NOT NULL OR ts + INTERVAL 24 HOUR < least((SELECT max(ts) FROM p), (SELECT max(ts) FROM v)) - INTERVAL 1 DAY"""
)
def stream_captures(spark, d):
    """After each purchase a view of its user is due within 6 hours, late up to 24; what is missed shows when both streams are past that."""
    due = _stream(spark, d).filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("due_id"), F.col("ts").alias("due_at"))
    views = _stream(spark, d).filter("event_type = 'view'").select("user_id", F.col("ts").alias("at"))
    met = drained(captures(due, views, ["user_id"], "6 HOURS", "24 HOURS"))
    # a due row has a record for every view; the earliest status in time tells
    return met.groupBy(F.col("due_id").alias("event_id")).agg(F.min("status").alias("status"))
