"""Forecast models with their SQL: scaled pools, calendar terms, quantile regression, calibration, resampling, trackers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import BUSINESS_SQL, CAL_SQL, LAW_SQL, SCARCITY_SQL, TAU, _forecasts, _states, cdf_sql, panel_sql, query, r
from .catalog_daily import PAIRS_SQL, THREE, three
from .operators import availability, benchmarks, calendar_terms, calendars, isotonic, laws, regimes, resampling, scaled_pools, scores, trackers, windows
from .operators import quantile_terms as quantile_terms_
from .plans.tables import Tables
from .sources.tables import VINTAGES_SQL, daily_panel, read, vintages
from .streaming import journal


@query(panel_sql("SELECT decision, day FROM kn WHERE decision < (SELECT min(decision) FROM kn WHERE ready)", PAIRS_SQL))
def reversion_skipped(spark, d):
    """The decisions before the first refit, for want of history."""
    return benchmarks.refits(Tables(spark), daily_panel(spark, d)).skipped


# --- scaled pools

#: By variant, the scale of the row from the last changes (moves) or their sizes.
SCALE_SQL = {
    v.name: f"CASE WHEN count(move) OVER w{v.window} = {v.window} THEN greatest({v.floor}, " + (f"1.4826 * quantile_cont(abs(move), 0.5) OVER w{v.window}" if v.estimator == "mad" else f"stddev_samp(move) OVER w{v.window}") + ") END"
    for v in scaled_pools.VARIANTS
}
FRAMES_SQL = ", ".join(f"w{n} AS (ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in sorted({v.window for v in scaled_pools.VARIANTS}))
SCALED_SQL = f"""{PAIRS_SQL},
mv AS (SELECT pos, spread - lag(spread) OVER (ORDER BY pos) AS move FROM panel),
sw AS (SELECT pos, {", ".join(f"{x} AS {name}" for name, x in SCALE_SQL.items())} FROM mv WINDOW {FRAMES_SQL}),
sc AS (SELECT pos, variant, scale FROM (UNPIVOT sw ON {", ".join(SCALE_SQL)} INTO NAME variant VALUE scale)),
zp AS (SELECT variant, block, lead, count(*) AS n, quantile_cont(raw / scale, [0.05, 0.5, 0.95]) AS pool FROM rs JOIN sc ON sc.pos = origin GROUP BY 1, 2, 3),
np AS (SELECT block, lead, count(*) AS pairs FROM ins GROUP BY 1, 2),
sl AS (SELECT variant, decision, lead, fitted, phi, scale, n, pairs - n AS left_out, centre, pool FROM ce
  JOIN (SELECT pos FROM sc GROUP BY 1 HAVING count(*) = {len(SCALE_SQL)}) a ON a.pos = anchor JOIN sc ON sc.pos = anchor JOIN zp USING (variant, block, lead) JOIN np USING (block, lead))"""


@query(panel_sql("SELECT variant, decision, lead, fitted, phi, round(scale, 6) AS scale, n, left_out, round(centre + scale * pool[1], 5) AS q05, round(centre + scale * pool[2], 5) AS q50, round(centre + scale * pool[3], 5) AS q95 FROM sl", SCALED_SQL))
def scaled_walk(spark, d):
    """Mean reversion with residuals scaled at their origins, six scales: one row a variant, decision and lead."""
    w = scaled_pools.scaled_walk(daily_panel(spark, d))
    return w.select("variant", "decision", "lead", "fitted", "phi", r("scale").alias("scale"), "n", "left_out", *three("q", 5))


@query(panel_sql("SELECT variant, lead, count(*) AS n, round(avg(abs(centre + scale * pool[2] - p.spread)), 5) AS mae, round(avg((p.spread BETWEEN centre + scale * pool[1] AND centre + scale * pool[3])::INTEGER), 6) AS coverage_90 FROM sl JOIN panel p ON p.pos = decision + lead GROUP BY 1, 2", SCALED_SQL))
def scaled_scores(spark, d):
    """Errors and coverage of every scale on the same days."""
    p = daily_panel(spark, d)
    w = scaled_pools.scaled_walk(p).join(p.select("pos", "spread"), F.col("pos") == F.col("decision") + F.col("lead"))
    q, y = F.col("q"), F.col("spread")
    inside = y.between(scores.quantile(q, 0.05), scores.quantile(q, 0.95)).cast("int")
    return w.groupBy("variant", "lead").agg(F.count("*").alias("n"), r(F.avg(F.abs(scores.quantile(q, 0.5) - y)), 5).alias("mae"), r(F.avg(inside)).alias("coverage_90"))


# --- calendar and state terms

SIZE = 1 + 2 * len(calendar_terms.TERMS)
OWN_SQL = [f"CASE WHEN e_{t} THEN {t} ELSE 0 END" for t in calendar_terms.TERMS]
NOW_SQL = list(calendar_terms.TERMS)
COUPON_SQL = "CASE WHEN lead = 1 THEN coupon ELSE 0 END AS coupon"
OTHERS_SQL = ", ".join(t for t in calendar_terms.TERMS if t != "coupon")


def _regressors_sql(own: list[str]) -> str:
    return "[1, " + ", ".join(own) + ", " + ", ".join(f"s * ({x})" for x in own) + "]"


def _gram_sql(size: int, penalty: float) -> str:
    cell = lambda i, j: f"sum(x[{i}] * x[{j}])" + (f" + {penalty}" if i == j and i > 1 else "")
    return "[" + ", ".join("[" + ", ".join([cell(i, j) for j in range(1, size + 1)] + [f"sum(x[{i}] * y)"]) + "]" for i in range(1, size + 1)) + "]"


def solve_sql(groups: str, size: int, penalty: float) -> str:
    """Tables gm, gj and co (groups, b) from xs (groups, x, y): the normal equations of each group and their elimination."""
    return f"""gm AS (SELECT {groups}, {_gram_sql(size, penalty)} AS m FROM xs GROUP BY ALL),
gj AS (SELECT {groups}, 1 AS k, m FROM gm UNION ALL
  SELECT {groups}, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda v: v / m[k][k]) ELSE list_transform(row, lambda v, j: v - row[k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= {size}),
co AS (SELECT {groups}, list_transform(m, lambda row: row[{size + 1}]) AS b FROM gj WHERE k = {size + 1})"""


TERMS_SQL = f"""{SCALED_SQL}, {SCARCITY_SQL},
fg AS (SELECT pos, coalesce(e <= 2, false)::DOUBLE AS month_end, coalesce(e = 1 AND month(date) % 3 = 0, false)::DOUBLE AS quarter_end, (month(date) IN (1, 4, 6, 9, 12) AND day(date) BETWEEN 15 AND 17)::DOUBLE AS tax_date,
  (day(date) BETWEEN 19 AND 23)::DOUBLE AS late_teens, coalesce(k <= 3, false)::DOUBLE AS month_start, coalesce((CASE WHEN n <> 7 THEN greatest(0, n - 8) END > 0)::DOUBLE, 0) AS coupon FROM panel LEFT JOIN bd ON day = date),
sd AS (SELECT decision, state / 3 AS state FROM dc JOIN panel p ON p.pos = anchor JOIN st ON st.date = p.date),
tr AS (SELECT block, lead, raw / scale AS y, coalesce(state, 0) AS s, {OTHERS_SQL}, {COUPON_SQL} FROM rs JOIN sc ON sc.pos = origin AND variant = 'mad20' JOIN fg ON fg.pos = target LEFT JOIN sd ON sd.decision = origin + rs.k - lead),
en AS (SELECT block, lead, {", ".join(f"sum({t}) >= {calendar_terms.LEAST_FLAGGED} AS e_{t}" for t in calendar_terms.TERMS)} FROM tr GROUP BY 1, 2),
xs AS (SELECT block, lead, y, {_regressors_sql(OWN_SQL)} AS x FROM tr JOIN en USING (block, lead)),
{solve_sql("block, lead", SIZE, 1.0)},
tp AS (SELECT block, lead, quantile_cont(y - list_dot_product(b[2:], x[2:]), [0.05, 0.5, 0.95]) AS pool FROM xs JOIN co USING (block, lead) GROUP BY 1, 2),
nw AS (SELECT decision, lead, block, fitted, centre, scale, coalesce(state, 0) AS s, {OTHERS_SQL}, {COUPON_SQL} FROM ce JOIN sc ON sc.pos = anchor AND variant = 'mad20' JOIN fg ON fg.pos = decision + lead LEFT JOIN sd USING (decision)),
tw AS (SELECT decision, lead, fitted, scale, centre, pool, list_dot_product(b[2:], {_regressors_sql(NOW_SQL)}[2:]::DOUBLE[]) AS shift, b FROM nw JOIN co USING (block, lead) JOIN tp USING (block, lead))"""


def _with_states(spark, d, state):
    """The panel with coupons, written, and the state (a column of scarcity states) that a decision on each row could read: its anchor's."""
    p = daily_panel(spark, d)
    p = Tables(spark).keep(p.withColumn("coupons", F.when(F.col("n") != 7, F.greatest(F.lit(0), F.col("n") - 8))), "panel")
    own = _states(spark, d).select("date", state.alias("state")).join(p.select("date", F.col("pos").alias("anchor")), "date")
    return p, benchmarks.decisions(p).join(own, "anchor").select(F.col("decision").alias("pos"), "state")


def _terms(spark, d, arm):
    return calendar_terms.terms_walk(*_with_states(spark, d, F.col("state") / calendar_terms.STATES), arm)


@query(panel_sql("SELECT decision, lead, fitted, round(scale, 6) AS scale, round(shift, 6) AS shift, round(b[1], 6) AS constant, round(b[2], 6) AS month_end, round(b[7], 6) AS coupon, round(b[8], 6) AS month_end_state, round(centre + scale * (shift + pool[1]), 5) AS q05, round(centre + scale * (shift + pool[2]), 5) AS q50, round(centre + scale * (shift + pool[3]), 5) AS q95 FROM tw", TERMS_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def state_terms(spark, d):
    """Calendar terms and their products with the scarcity state, by ridge least squares at every refit and lead."""
    w = _terms(spark, d, calendar_terms.Arm(interact=True))
    b = [r(F.get("b", F.lit(i))).alias(name) for i, name in ((0, "constant"), (1, "month_end"), (6, "coupon"), (7, "month_end_state"))]
    return w.select("decision", "lead", "fitted", r("scale").alias("scale"), r("shift").alias("shift"), *b, *three("q", 5))


@query()
def robust_terms(spark, d):
    """Calendar terms by Huber's fit with a penalty of five pseudo-days."""
    w = _terms(spark, d, calendar_terms.Arm(robust=True, penalty=5.0))
    return w.select("decision", "lead", "fitted", "rounds", r("shift").alias("shift"), *three("q", 5))


@query()
def quantile_terms(spark, d):
    """Quantile regression on the last spread, the reserves ratio and calendar terms, refitted every 250 decisions, in at most 40 rounds."""
    w = quantile_terms_.quantile_walk(*_with_states(spark, d, F.col("ratio")), [level for level, _ in THREE], rounds=40)
    q = [r(F.get("q", F.lit(i)), 5).alias(name) for i, (_, name) in enumerate(THREE)]
    return w.select("decision", "lead", "fitted", "n", "rounds", "crossed", *q)


# --- calibration

SCORED_SQL = f"{LAW_SQL}, sp AS (SELECT pos, round(1 - ({cdf_sql(str(TAU + 0.5))}), 6) AS p, (outcome > {TAU + 0.5})::INTEGER AS e FROM law)"
#: The isotonic fit as the largest, over earlier starts, of the least, over later ends, of the means between.
ISOTONIC_SQL = f"""{SCORED_SQL},
pt AS (SELECT p, count(*) AS n, sum(e) AS total FROM sp GROUP BY 1),
pn AS (SELECT *, row_number() OVER (ORDER BY p) AS i, sum(n) OVER (ORDER BY p) AS n_to, sum(total) OVER (ORDER BY p) AS total_to FROM pt),
pp AS (SELECT a.i AS a, b.i AS i, (b.total_to - a.total_to + a.total) / (b.n_to - a.n_to + a.n) AS m FROM pn a JOIN pn b ON b.i >= a.i),
pm AS (SELECT a, i, min(m) OVER (PARTITION BY a ORDER BY i DESC) AS least FROM pp),
fi AS (SELECT p, n, total, max(least) AS fit FROM pm JOIN pn USING (i) GROUP BY ALL)"""


def _scored(spark, d):
    p, e = laws.exceedance(F.col("q"), TAU), (F.col("outcome") > TAU + 0.5).cast("int")
    return _forecasts(spark, d).select("pos", F.round(p, 6).alias("p"), e.alias("e"))


@query(
    panel_sql(
        "SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS events, count(DISTINCT round(fit, 12)) AS blocks, round(any_value(raw), 8) AS brier, round(any_value(raw) - any_value(best), 8) AS miscalibration, round(any_value(base) - any_value(best), 8) AS discrimination, round(any_value(base), 8) AS uncertainty "
        "FROM fi, (SELECT sum(total * power(1 - p, 2) + (n - total) * power(p, 2)) / sum(n) AS raw, sum(total * power(1 - fit, 2) + (n - total) * power(fit, 2)) / sum(n) AS best, sum(total) / sum(n) * (1 - sum(total) / sum(n)) AS base FROM fi)",
        ISOTONIC_SQL,
    )
)
def corp_decomposition(spark, d):
    """The Brier score of a threshold's probabilities, in three parts, by an isotonic fit."""
    c = isotonic.corp(Tables(spark), _scored(spark, d), "p", "e")
    return c.select("n", "events", "blocks", *(r(k, 8).alias(k) for k in ("brier", "miscalibration", "discrimination", "uncertainty")))


@query(panel_sql("SELECT pos, sp.p, round(fit, 8) AS fitted FROM sp JOIN fi USING (p)", ISOTONIC_SQL))
def isotonic_recalibration(spark, d):
    """Each probability with its value on the isotonic fit of all."""
    tables = Tables(spark)
    rows = tables.keep(_scored(spark, d), "scored")
    fit = isotonic.blocks(tables, isotonic.by_score(rows, "p", "e"))
    return isotonic.recalibrated(rows, fit, "p").select("pos", "p", r("fitted", 8).alias("fitted"))


# --- resampling

LENGTH, REPLICATES, LAGS = 10, 200, 10
DRAWS_SQL = f"""sn AS (SELECT count(*) AS n FROM se),
dg AS (SELECT rep, b, n, md5('0-' || CAST(rep AS VARCHAR) || '-' || CAST(b AS VARCHAR)) AS h FROM sn, unnest(range({REPLICATES})) AS u(rep), unnest(range(CAST(ceil(4 * n / {LENGTH}) AS BIGINT) + 64)) AS v(b)),
dr AS (SELECT rep, b, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % n AS start, 1 + CAST(floor(ln((CAST('0x' || substr(h, 9, 8) AS BIGINT) + 1) / 4294967296) / ln(1 - 1 / {LENGTH})) AS BIGINT) AS whole FROM dg),
bl AS (SELECT * FROM (SELECT *, sum(whole) OVER (PARTITION BY rep ORDER BY b) - whole AS t FROM dr) WHERE t < n),
dy AS (SELECT rep, n, t + i AS t, (start + i) % n AS spot FROM (SELECT *, unnest(range(CAST(least(whole, n - t) AS BIGINT))) AS i FROM bl))"""
DOMAIN_SQL = f"""{CAL_SQL},
se AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS spot, abs(move) AS value FROM (SELECT pos, spread - lag(spread) OVER (ORDER BY pos) AS move FROM panel) WHERE move IS NOT NULL),
mb AS (SELECT pos, unnest([day_type, 'all']) AS domain FROM cal), pl AS (SELECT domain, spot, value FROM se JOIN mb USING (pos)), {DRAWS_SQL},
al AS (SELECT rep, domain, n, t, value FROM dy JOIN pl USING (spot) UNION ALL SELECT -1, domain, n, spot, value FROM pl, sn),
au AS (SELECT *, value - avg(value) OVER (PARTITION BY rep, domain) AS u FROM al),
co AS (SELECT a.rep, a.domain, sum(a.u * b.u * (1 - abs(a.t - b.t) / {LAGS + 1})) AS v FROM au a JOIN au b ON a.rep = b.rep AND a.domain = b.domain AND abs(a.t - b.t) <= {LAGS} GROUP BY 1, 2),
mv AS (SELECT rep, domain, count(*) AS k, avg(value) AS mean, any_value(n) AS n FROM al GROUP BY 1, 2),
st AS (SELECT rep, domain, k, mean, CASE WHEN v / n > 0 THEN sqrt(v / n / n) * n / k END AS se FROM mv JOIN co USING (rep, domain)),
ow AS (SELECT * FROM st WHERE rep = -1),
rt AS (SELECT s.domain, (s.mean - o.mean) / s.se AS ratio FROM st s JOIN ow o USING (domain) WHERE s.rep >= 0),
en AS (SELECT domain, count(*) AS draws, count(*) FILTER (ratio IS NULL) AS dropped, quantile_cont(ratio, 0.05) AS low, quantile_cont(ratio, 0.95) AS high FROM rt GROUP BY 1)"""


@query(panel_sql(f"SELECT domain, k AS n, round(mean, 6) AS mean, round(se, 6) AS standard_error, coalesce(draws, 0) AS draws, coalesce(dropped, 0) AS dropped, CASE WHEN coalesce(draws, 0) < {REPLICATES} THEN 'a resample has no day' END AS unavailable, CASE WHEN draws = {REPLICATES} THEN round(mean - high * se, 5) END AS lower, CASE WHEN draws = {REPLICATES} THEN round(mean - low * se, 5) END AS upper FROM ow LEFT JOIN en USING (domain)", DOMAIN_SQL))
def domain_intervals(spark, d):
    """Mean size of a day's move by day type, with studentised intervals from a stationary bootstrap of the whole series."""
    days = calendars.calendar_columns(daily_panel(spark, d)).withColumn("value", F.abs(windows.change("spread", 1)))
    days = Tables(spark).keep(days.select("pos", "day_type", "value"), "days")
    members = days.select("pos", F.explode(F.array("day_type", F.lit("all"))).alias("domain"))
    found = resampling.domain_intervals(spark, days.filter("value is not null").select("pos", "value"), members, LENGTH, REPLICATES, 0.9, LAGS)
    return found.select("domain", "n", r("mean").alias("mean"), r("standard_error").alias("standard_error"), "draws", "dropped", "unavailable", r("lower", 5).alias("lower"), r("upper", 5).alias("upper"))


# --- online calibration


def _tracked(spark, d):
    """Mean reversion's outer quantiles of every decision and lead as a series a lead, with the target's calendar flags and outcome."""
    p, tables = daily_panel(spark, d), Tables(spark)
    p = tables.keep(p.withColumn("coupons", F.when(F.col("n") != 7, F.greatest(F.lit(0), F.col("n") - 8))), "panel")
    dates = p.select("pos", F.col("date").alias("day"), F.col("spread").alias("actual"))
    w = tables.keep(benchmarks.reversion_walk(p.drop("coupons")).select("decision", "lead", *three("q", 10)), "walk")
    made = benchmarks.decisions(p).select("decision", "anchor")
    known = w.join(made, "decision").withColumn("pos", F.col("decision") + F.col("lead")).join(dates, "pos").join(calendar_terms.flags(p), "pos")
    known = known.join(dates.select(F.col("pos").alias("anchor"), F.col("day").alias("read")), "anchor")
    marks = F.array(*(F.coalesce(t, F.lit(0.0)) for t in ("month_end", "quarter_end", "tax_date")))
    return known.select(F.concat(F.lit("lead "), "lead").alias("series"), "day", F.col("read").alias("anchor"), F.col("q05").alias("low"), F.col("q95").alias("high"), marks.alias("flags"), "actual")


@query()
def conformal_bands(spark, d):
    """Bands of mean reversion put right from day to day by their own misses, one state a lead."""
    b = trackers.bands(_tracked(spark, d), flags=3)
    return b.select("series", "day", "observed", r("width").alias("width"), r("scorecast").alias("scorecast"), "saturated", r("lower").alias("lower"), r("upper").alias("upper"))


@query()
def conformal_coverage(spark, d):
    """By lead, how often the outer quantiles and the bands held the outcome."""
    f = Tables(spark).keep(_tracked(spark, d), "tracked")
    b = trackers.bands(f, flags=3).select("series", "day", "lower", "upper").join(f, ["series", "day"])
    share = lambda low, high: r(F.avg(F.col("actual").between(F.col(low), F.col(high)).cast("int")))
    return b.groupBy("series").agg(F.count("*").alias("n"), share("low", "high").alias("raw"), share("lower", "upper").alias("calibrated"))


BLOCK_SQL = """
se AS (SELECT pos, abs(move) AS value FROM (SELECT pos, spread - lag(spread) OVER (ORDER BY pos) AS move FROM panel) WHERE move IS NOT NULL),
sz AS (SELECT count(*) AS n, greatest(5, CAST(ceil(sqrt(log10(count(*)))) AS BIGINT)) AS run FROM se),
mx AS (SELECT n, run, CAST(ceil(sqrt(n)) AS BIGINT) + run AS most FROM sz),
ce AS (SELECT pos, value - avg(value) OVER () AS c FROM se),
gm AS (SELECT b.pos - a.pos AS k, sum(a.c * b.c) / any_value(n) AS gamma FROM ce a, mx, ce b WHERE b.pos BETWEEN a.pos AND a.pos + most + run GROUP BY 1),
gl AS (SELECT list(gamma ORDER BY k) AS gamma FROM gm),
fd AS (SELECT n, run, most, gamma, coalesce(list_min(list_filter(range(0, most + 1), lambda m: len(list_filter(gamma[m + 2:m + 1 + run], lambda x: abs(x / gamma[1]) >= 2 * sqrt(log10(n) / n))) = 0)), most) AS lag FROM gl, mx),
tr AS (SELECT *, least(2 * greatest(lag, 1), most) AS truncation FROM fd),
sp AS (SELECT *, gamma[1] + list_sum(list_transform(range(1, truncation + 1), lambda k: 2 * gamma[k + 1] * CASE WHEN k / truncation <= 0.5 THEN 1 ELSE 2 * (1 - k / truncation) END)) AS level,
  list_sum(list_transform(range(1, truncation + 1), lambda k: 2 * k * gamma[k + 1] * CASE WHEN k / truncation <= 0.5 THEN 1 ELSE 2 * (1 - k / truncation) END)) AS slope FROM tr)
"""


@query(panel_sql("SELECT n, CAST(lag AS INTEGER) AS lag, CAST(truncation AS INTEGER) AS truncation, round(greatest(1, cbrt(slope * slope / (level * level)) * power(n, 1 / 3)), 6) AS length FROM sp", BLOCK_SQL))
def block_length(spark, d):
    """The block length that suits the mean size of a day's move."""
    moves = daily_panel(spark, d).select("pos", F.abs(windows.change("spread", 1)).alias("value")).filter("value is not null")
    return resampling.block_length(Tables(spark).keep(moves, "moves")).withColumn("length", r("length"))


# --- availability by registry

REGISTRY = [("rate", "lagged", 1, "09:00", "America/New_York"), ("volume", "lagged", 2, "16:30", "America/New_York"), ("coupons", "scheduled", 1, "15:00", "America/New_York"), ("month", "calendar", None, None, None), ("lines", "observed", None, None, None)]
DECIDED_AT, ZONE = "16:00", "America/New_York"
REGISTRY_SQL = f"""{BUSINESS_SQL}, {VINTAGES_SQL},
od AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS o FROM bd),
rv AS (SELECT 'rate' AS field, 'lagged' AS kind, date AS day, rate AS value FROM panel UNION ALL SELECT 'volume', 'lagged', date, volume FROM panel WHERE isodow(date) = 3),
lg AS (SELECT field, kind, rv.day, value, (((n.day || ' ' || CASE WHEN field = 'rate' THEN '09:00' ELSE '16:30' END)::TIMESTAMP AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC') AS available_at
  FROM rv JOIN od n ON n.o = (SELECT min(o) FROM od WHERE od.day >= rv.day) + CASE WHEN field = 'rate' THEN 1 ELSE 2 END),
ob AS (SELECT 'lines' AS field, 'observed' AS kind, ref_date AS day, available_at, max(value) AS value FROM vintages WHERE series = 'N' GROUP BY ALL),
dn AS (SELECT pos AS decision, (((date || ' {DECIDED_AT}')::TIMESTAMP AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC') AS decided_at, lead(date) OVER (ORDER BY pos) AS target FROM panel),
ls AS (SELECT decision, field, kind, max(struct_pack(day := p.day, available_at := available_at, value := value)) AS v FROM dn JOIN (SELECT * FROM lg UNION ALL SELECT field, kind, day, value, available_at FROM ob) p ON p.available_at <= decided_at GROUP BY ALL),
ah AS (SELECT decision, 'coupons' AS field, 'scheduled' AS kind, p.date AS day, (((b.day || ' 15:00')::TIMESTAMP AT TIME ZONE '{ZONE}') AT TIME ZONE 'UTC') AS available_at, CAST(greatest(0, n - 8) AS DOUBLE) AS value, decided_at
  FROM dn JOIN panel p ON p.date = target JOIN od b ON b.o = (SELECT max(o) FROM od WHERE od.day <= p.date) - 1)
"""


@query(panel_sql("SELECT decision, field, kind, v.day AS day, v.available_at AS available_at, round(v.value, 6) AS value FROM ls UNION ALL SELECT decision, field, kind, day, available_at, round(value, 6) FROM ah WHERE available_at <= decided_at UNION ALL SELECT decision, 'month', 'calendar', target, TIMESTAMP '0001-01-01', month(target) FROM dn WHERE target IS NOT NULL", REGISTRY_SQL))
def registry_information(spark, d):
    """What a decision at 16:00 in New York may read of five fields of four kinds: one row a decision and field."""
    p = Tables(spark).keep(daily_panel(spark, d), "panel")
    registry = spark.createDataFrame(REGISTRY, "field string, kind string, business_days int, at string, zone string")
    own = lambda field, value: p.select(F.lit(field).alias("field"), F.col("date").alias("day"), value.cast("double").alias("value"), F.lit(None).cast("timestamp").alias("observed_at"))
    lines = vintages(spark, d).filter("series = 'N'").groupBy(F.lit("lines").alias("field"), F.col("ref_date").alias("day"), F.col("available_at").cast("timestamp").alias("observed_at")).agg(F.max("value").alias("value"))
    values = own("rate", F.col("rate")).unionByName(own("volume", F.col("volume")).filter(F.weekday("day") == 2)).unionByName(own("coupons", F.greatest(F.lit(0), F.col("n") - 8))).unionByName(own("month", F.month("date"))).unionByName(lines)
    target = F.lead("date").over(windows.by_pos())
    made = p.select(F.col("pos").alias("decision"), availability.instant(F.col("date"), F.lit(DECIDED_AT), F.lit(ZONE)).alias("decided_at"), target.alias("target"))
    found = availability.information(made, availability.published(values, registry, calendars.business_days(spark)))
    return found.select("decision", "field", "kind", "day", F.col("available_at").cast("timestamp_ntz").alias("available_at"), r("value").alias("value"))


# --- regimes

REGIME = (0.6, 1.8, 0.05, 0.9)
REGIME_SQL = f"""
sw AS (SELECT pos, move, CASE WHEN count(move) OVER w = 20 THEN greatest(0.5, 1.4826 * quantile_cont(abs(move), 0.5) OVER w) END AS scale FROM (SELECT pos, spread - lag(spread) OVER (ORDER BY pos) AS move FROM panel) WINDOW w AS (ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
zs AS (SELECT pos, move / lag(scale) OVER (ORDER BY pos) AS z FROM sw),
fs AS (SELECT -1 AS pos, {REGIME[2]} / ({REGIME[2]} + 1 - {REGIME[3]}) AS stress, NULL::DOUBLE AS z UNION ALL
  SELECT pos, CASE WHEN z IS NULL THEN prior ELSE prior * exp(-0.5 * power(z / {REGIME[1]}, 2)) / {REGIME[1]} / (prior * exp(-0.5 * power(z / {REGIME[1]}, 2)) / {REGIME[1]} + (1 - prior) * exp(-0.5 * power(z / {REGIME[0]}, 2)) / {REGIME[0]}) END, z
  FROM (SELECT zs.pos, zs.z, (1 - stress) * {REGIME[2]} + stress * {REGIME[3]} AS prior FROM fs JOIN zs ON zs.pos = fs.pos + 1))"""


def _residuals(spark, d):
    """Moves over the scale that was public before them, as one series."""
    p = Tables(spark).keep(daily_panel(spark, d), "panel")
    scale = scaled_pools.scales(p, scaled_pools.VARIANTS[:1]).select((F.col("pos") + 1).alias("pos"), "scale")
    moves = p.select("pos", windows.change("spread", 1).alias("move")).join(scale, "pos", "left")
    return moves.select(F.lit("moves").alias("series"), F.col("pos").alias("t"), (F.col("move") / F.col("scale")).alias("z"))


@query(panel_sql("SELECT pos, round(z, 6) AS z, round(stress, 6) AS stress FROM fs WHERE pos >= 0", REGIME_SQL).replace("WITH ", "WITH RECURSIVE ", 1))
def regime_filter(spark, d):
    """The probability, after each day's move, of the stressed of two states with given scales."""
    rows = _residuals(spark, d)
    parameters = spark.createDataFrame([("moves", *REGIME)], "series string, " + ", ".join(f"{k} double" for k in regimes.PARAMETERS))
    found = regimes.filtered(Tables(spark), rows, parameters)
    return found.select(F.col("t").alias("pos"), r("z").alias("z"), r("stress").alias("stress"))


@query()
def regime_fit(spark, d):
    """The two states' scales and transitions, by at most 12 rounds of expectation maximisation."""
    found = regimes.fit(Tables(spark), _residuals(spark, d), rounds=12)
    return found.select("series", *(r(k).alias(k) for k in regimes.PARAMETERS), r("likelihood", 4).alias("likelihood"), "rounds", "degenerate")


# --- journals


def _batch_sql(batch: int, before: str) -> str:
    return f"""l{batch} AS (SELECT h % parts AS part, list(digest ORDER BY key) AS ds FROM dg JOIN sz USING (batch), {before} WHERE batch = {batch} GROUP BY 1),
n{batch} AS (SELECT part, list_reduce(list_prepend(sha256(head || ':' || CAST(part AS VARCHAR)), ds), lambda a, d: sha256(a || d)) AS last FROM l{batch}, {before}),
h{batch} AS (SELECT sha256(any_value(head) || string_agg(last, '' ORDER BY part)) AS head FROM n{batch}, {before})"""


JOURNAL_SQL = f"""
WITH e0 AS (SELECT '{journal.EMPTY}' AS head),
  en AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus || '|' || o_orderpriority || '|' || CAST(o_orderdate::DATE AS VARCHAR) AS payload, CASE WHEN year(o_orderdate) <= 1996 THEN 0 ELSE 1 END AS batch FROM orders),
  dg AS (SELECT *, sha256(CAST(strlen(key) AS VARCHAR) || ':' || key || '=' || payload) AS digest, CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) AS h FROM en),
  sz AS (SELECT batch, count(*) AS n, CAST(ceil(count(*) / {journal.PART}.0) AS BIGINT) AS parts FROM dg GROUP BY 1),
  {_batch_sql(0, "e0")}, {_batch_sql(1, "h0")}
SELECT CAST(batch AS BIGINT) AS batch, parts, n, CASE batch WHEN 0 THEN (SELECT head FROM h0) ELSE (SELECT head FROM h1) END AS head FROM sz
"""


@query(JOURNAL_SQL)
def journal_heads(spark, d):
    """Orders as records of a journal: the early ones first, then all, of which the early ones are replays."""
    path = f"{Tables(spark).root}/journal"
    o = read(spark, d, "orders")
    records = o.select(F.col("o_orderkey").cast("string").alias("key"), F.concat_ws("|", "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").cast("string")).alias("payload"), F.year("o_orderdate").alias("year"))
    journal.append(path, records.filter("year <= 1996"))
    journal.append(path, records)
    return journal.heads(spark, path)
