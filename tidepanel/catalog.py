"""All queries of the library but those of the llm subpackage, each with DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import asof, benchmarks, calendars, laws, resampling, reversion, scores, windows
from .sources.tables import PANEL_SQL, VINTAGES_SQL, daily_panel, read, vintages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "persistence_scores_by_day_type"
TAU = 5


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def panel_sql(body: str, more: str = "") -> str:
    return f"WITH {PANEL_SQL}{', ' + more if more else ''} {body}"


# --- sources, builds, records


@query(panel_sql("SELECT * FROM panel"))
def panel_build(spark, d):
    return daily_panel(spark, d)


@query(panel_sql("SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (rate IS NULL) AS missing_rate, CAST(date_diff('day', min(date), max(date)) + 1 - count(*) AS BIGINT) AS gap_days FROM panel"))
def panel_audit(spark, d):
    p = daily_panel(spark, d)
    gap = F.datediff(F.max("date"), F.min("date")) + 1 - F.count("*")
    return p.agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("rate").isNull()).alias("missing_rate"), gap.alias("gap_days"))


@query(panel_sql("SELECT CAST(year(date) AS INTEGER) AS year, sha256(string_agg(CAST(date AS VARCHAR) || '|' || CAST(n AS VARCHAR) || '|' || CAST(bp AS VARCHAR), ';' ORDER BY date)) AS digest FROM panel GROUP BY 1"))
def panel_digest(spark, d):
    line = F.concat_ws("|", "date", "n", "bp")
    p = daily_panel(spark, d).groupBy(F.year("date").alias("year")).agg(F.sort_array(F.collect_list(F.struct("date", line.alias("line")))).alias("lines"))
    return p.select("year", F.sha2(F.array_join("lines.line", ";"), 256).alias("digest"))


@query("SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS event_id, count(*) AS versions FROM events GROUP BY ALL")
def latest_record(spark, d):
    e = read(spark, d, "events").groupBy("user_id", "event_type")
    return e.agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"), F.count("*").alias("versions"))


@query(
    """WITH days AS (SELECT CAST(unnest(generate_series(min(ts)::DATE::TIMESTAMP, max(ts)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM events),
    got AS (SELECT ts::DATE AS day, count(*) AS n, max(value) AS top FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT day, CASE WHEN n IS NULL THEN 'missed' ELSE 'captured' END AS status, n, top, CASE WHEN n IS NULL THEN 'no record' END AS reason FROM days LEFT JOIN got USING (day)"""
)
def capture_status(spark, d):
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = e.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    got = e.filter("event_type = 'signup'").groupBy("day").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    none = F.col("n").isNull()
    return days.join(got, "day", "left").select("day", F.when(none, "missed").otherwise("captured").alias("status"), "n", "top", F.when(none, "no record").alias("reason"))


@query(panel_sql("SELECT date, series, value FROM (UNPIVOT (SELECT date, rate, p25, p75 FROM panel) ON rate, p25, p75 INTO NAME series VALUE value)"))
def panel_unpivot(spark, d):
    return daily_panel(spark, d).unpivot(["date"], ["rate", "p25", "p75"], "series", "value")


# --- as-of


@query(f"WITH {VINTAGES_SQL} SELECT series, ref_date, arg_min(struct_pack(a := available_at, v := vintage, x := value), struct_pack(a := available_at, v := vintage)).a AS available_at, arg_min(vintage, struct_pack(a := available_at, v := vintage)) AS vintage, arg_min(value, struct_pack(a := available_at, v := vintage)) AS value FROM vintages GROUP BY 1, 2")
def first_published(spark, d):
    return asof.first_published(vintages(spark, d))


@query(f"WITH {VINTAGES_SQL} SELECT series, ref_date, max(available_at) AS available_at, arg_max(vintage, struct_pack(a := available_at, v := vintage)) AS vintage, arg_max(value, struct_pack(a := available_at, v := vintage)) AS value FROM vintages WHERE available_at <= TIMESTAMP '1998-06-30' GROUP BY 1, 2")
def latest_vintage_at_cutoff(spark, d):
    return asof.latest_at(vintages(spark, d), "1998-06-30")


@query(f"WITH {VINTAGES_SQL}, f AS (SELECT series, ref_date, arg_min(value, struct_pack(a := available_at, v := vintage)) AS value FROM vintages GROUP BY 1, 2) SELECT ref_date, max(value) FILTER (series = 'A') AS \"A\", max(value) FILTER (series = 'N') AS \"N\", max(value) FILTER (series = 'R') AS \"R\" FROM f GROUP BY 1")
def panel_pivot(spark, d):
    return asof.first_published(vintages(spark, d)).groupBy("ref_date").pivot("series", ["A", "N", "R"]).agg(F.max("value"))


ANCHOR_SQL = """
dl AS (SELECT pos, date, lag(date, 1) OVER (ORDER BY pos)::TIMESTAMP + INTERVAL 18 HOUR AS deadline FROM panel),
av AS (SELECT pos AS anchor, spread AS anchor_spread, lead(date, 1) OVER (ORDER BY pos)::TIMESTAMP + INTERVAL 9 HOUR AS available_at FROM panel),
anchors AS (SELECT dl.pos, dl.date, dl.deadline, av.anchor, av.anchor_spread FROM dl ASOF LEFT JOIN av ON dl.deadline >= av.available_at WHERE dl.deadline IS NOT NULL)
"""


@query(panel_sql("SELECT * FROM anchors", ANCHOR_SQL))
def asof_anchor(spark, d):
    return asof.anchors(daily_panel(spark, d))


@query(panel_sql("SELECT pos - anchor AS rows_before, count(*) AS n, min(date_diff('hour', (date - 0)::TIMESTAMP, deadline)) AS least_hours FROM anchors GROUP BY 1", ANCHOR_SQL))
def information_summary(spark, d):
    a = asof.anchors(daily_panel(spark, d))
    hours = F.timestamp_diff("HOUR", F.col("date").cast("timestamp"), "deadline")
    return a.groupBy((F.col("pos") - F.col("anchor")).alias("rows_before")).agg(F.count("*").alias("n"), F.min(hours).alias("least_hours"))


@query(panel_sql("SELECT count(*) FILTER (anchor >= pos) AS look_ahead, count(*) FILTER (anchor IS NULL) AS without_read, count(*) AS n FROM anchors", ANCHOR_SQL))
def look_ahead_guard(spark, d):
    a = asof.anchors(daily_panel(spark, d))
    return a.agg(F.count_if(F.col("anchor") >= F.col("pos")).alias("look_ahead"), F.count_if(F.col("anchor").isNull()).alias("without_read"), F.count("*").alias("n"))


@query(panel_sql("SELECT pos, CAST((row_number() OVER (ORDER BY pos) - 1) // 21 AS BIGINT) AS block, first_value(pos) OVER (PARTITION BY (pos - 251) // 21 ORDER BY pos) AS block_start FROM anchors WHERE anchor + 1 >= 250 AND pos >= 251", ANCHOR_SQL))
def refit_blocks(spark, d):
    a = asof.anchors(daily_panel(spark, d)).filter("anchor + 1 >= 250 and pos >= 251")
    b = a.withColumn("block", F.floor((F.row_number().over(windows.by_pos()) - 1) / 21))
    return b.select("pos", "block", F.min("pos").over(Window.partitionBy("block")).alias("block_start"))


EVENT_ASOF = "SELECT p.event_id, p.user_id, p.ts, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts"


def _purchases(spark, d, tolerance=None):
    e = read(spark, d, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("value").alias("seen"))
    return asof.asof_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "at", ["seen"], tolerance)


@query(EVENT_ASOF)
def asof_by_key(spark, d):
    return _purchases(spark, d)


@query(f"SELECT event_id, user_id, ts, CASE WHEN seen_at >= ts - INTERVAL 6 HOUR THEN seen END AS seen FROM ({EVENT_ASOF.replace('v.value AS seen', 'v.value AS seen, v.ts AS seen_at')})")
def asof_with_tolerance(spark, d):
    return _purchases(spark, d, "6 HOURS")


@query("SELECT o_orderpriority AS kind, o_orderkey, o_orderdate, announced FROM (SELECT *, o_orderdate - INTERVAL 1 DAY * (o_orderkey % 40) AS announced FROM orders) WHERE o_orderdate <= TIMESTAMP '1999-03-01' AND announced <= TIMESTAMP '1999-02-10' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, announced DESC, o_orderkey DESC) = 1")
def policy_in_force(spark, d):
    """Of what was announced by 10 February, the entry in force on 1 March."""
    o = read(spark, d, "orders").withColumn("announced", F.col("o_orderdate") - F.make_dt_interval(F.col("o_orderkey") % 40))
    o = o.select(F.col("o_orderpriority").alias("kind"), "o_orderkey", "o_orderdate", "announced")
    target, known = (F.lit(x).cast("timestamp") for x in ("1999-03-01", "1999-02-10"))
    return asof.in_force(o, ["kind"], "o_orderdate", "announced", target, known, ("o_orderkey",))


TIERS = [("development", "1995-01-01", "1998-12-31"), ("holdout", "1999-01-01", "2000-06-30"), ("locked", "2000-07-01", "2099-12-31")]
TIERS_SQL = "tiers(tier, first_day, last_day) AS (VALUES " + ", ".join(f"('{t}', DATE '{a}', DATE '{b}')" for t, a, b in TIERS) + ")"


@query(panel_sql("SELECT tier, count(*) AS n_days, round(avg(spread), 6) AS mean_spread FROM panel JOIN tiers ON date BETWEEN first_day AND last_day GROUP BY 1", TIERS_SQL))
def tier_ranges(spark, d):
    tiers = F.broadcast(spark.createDataFrame(TIERS, "tier string, first_day string, last_day string"))  # three rows
    p = daily_panel(spark, d)
    joined = p.join(tiers, p.date.between(F.col("first_day").cast("date"), F.col("last_day").cast("date")), "left")
    outside = F.raise_error(F.concat(F.lit("no tier holds "), F.col("date").cast("string")))
    return joined.withColumn("tier", F.coalesce("tier", outside)).groupBy("tier").agg(F.count("*").alias("n_days"), r(F.avg("spread")).alias("mean_spread"))


# --- calendars, projections

BUSINESS_SQL = f"""bd AS (SELECT d::DATE AS day, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d) AS k, row_number() OVER (PARTITION BY date_trunc('month', d) ORDER BY d DESC) AS e
  FROM unnest(generate_series(TIMESTAMP '{calendars.FIRST}', TIMESTAMP '{calendars.LAST}', INTERVAL 1 DAY)) AS t(d) WHERE isodow(d) < 6)"""
CAL_SQL = f"""
{BUSINESS_SQL},
c0 AS (SELECT panel.*, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS bday, coalesce(e = 2, false) AS penultimate, CASE WHEN e = 1 THEN month(date) WHEN k = 1 THEN month(date - INTERVAL 1 MONTH) END AS turn_of FROM panel LEFT JOIN bd ON date = day),
cal AS (SELECT *, CASE WHEN turn_of = 12 THEN 'year_end' WHEN turn_of IN (3, 6, 9) THEN 'quarter_end_turn' WHEN turn_of IS NOT NULL THEN 'turn'
  WHEN month(date) IN (1, 4, 6, 9, 12) AND day(date) BETWEEN 15 AND 17 THEN 'tax_date' ELSE 'ordinary' END AS day_type FROM c0)
"""


@query(panel_sql(f"SELECT date, CAST(bday AS INTEGER) AS bday, day_type, CAST(((date_diff('day', DATE '{calendars.MAINTENANCE}', date) % 14) + 14) % 14 AS INTEGER) AS maintenance_day, CAST(CASE WHEN day(date) <= 5 THEN 0 WHEN day(date) <= 14 THEN 1 WHEN day(date) <= 18 THEN 2 WHEN day(date) <= 23 THEN 3 ELSE 4 END AS INTEGER) AS bucket, (date - CAST((dayofweek(date) + 4) % 7 AS INTEGER))::DATE AS wednesday, penultimate FROM cal", CAL_SQL))
def day_types(spark, d):
    return calendars.calendar_columns(daily_panel(spark, d)).select("date", "bday", "day_type", "maintenance_day", "bucket", "wednesday", "penultimate")


@query(panel_sql("SELECT CAST(month(date) AS INTEGER) AS month, CAST(sum(c) AS BIGINT) AS days FROM (SELECT date, CAST(date_diff('day', date, least(coalesce(lead(date) OVER (ORDER BY date), date + 1), (last_day(date) + 1)::DATE)) AS BIGINT) AS c FROM panel) GROUP BY 1"))
def carried_days(spark, d):
    return calendars.carried_days(daily_panel(spark, d)).groupBy(F.month("date").alias("month")).agg(F.sum("carried_days").alias("days"))


SCARCITY_SQL = """
s AS (SELECT date, CASE WHEN volume > 0 THEN n / volume END AS ratio, CASE WHEN n > 3 THEN volume END AS buffer FROM panel),
st AS (SELECT date, ratio, CASE WHEN ratio IS NULL OR buffer IS NULL THEN NULL ELSE CASE WHEN ratio >= 0.5 THEN 0 WHEN ratio >= 0.4 THEN 1 ELSE 2 END + CASE WHEN buffer < 12 THEN 1 ELSE 0 END END AS state FROM s)
"""


def _states(spark, d):
    p = daily_panel(spark, d).withColumn("ratio", F.when(F.col("volume") > 0, F.col("n") / F.col("volume"))).withColumn("buffer", F.when(F.col("n") > 3, F.col("volume")))
    level = F.when(F.col("ratio") >= 0.5, 0).when(F.col("ratio") >= 0.4, 1).otherwise(2)
    known = F.col("ratio").isNotNull() & F.col("buffer").isNotNull()
    return p.withColumn("state", F.when(known, level + F.when(F.col("buffer") < 12, 1).otherwise(0)))


@query(panel_sql("SELECT date, round(ratio, 6) AS ratio, CAST(state AS INTEGER) AS state, round(greatest(0, 100 * (0.45 - ratio)), 6) AS hinge, CASE WHEN state IS NULL THEN 'unknown' WHEN state < 2 THEN 'low' ELSE 'high' END AS state_group FROM st", SCARCITY_SQL))
def scarcity_state(spark, d):
    group = F.when(F.col("state").isNull(), "unknown").when(F.col("state") < 2, "low").otherwise("high")
    return _states(spark, d).select("date", r("ratio").alias("ratio"), "state", r(F.greatest(F.lit(0.0), 100 * (0.45 - F.col("ratio")))).alias("hinge"), group.alias("state_group"))


@query(panel_sql("SELECT CAST(state AS INTEGER) AS state, CAST(year(date) AS INTEGER) AS year, count(*) AS n FROM st GROUP BY GROUPING SETS ((state), (state, year(date)))", SCARCITY_SQL))
def state_table(spark, d):
    s = _states(spark, d).withColumn("year", F.year("date"))
    return s.groupingSets([["state"], ["state", "year"]], "state", "year").agg(F.count("*").alias("n"))


# --- windows


@query(panel_sql("SELECT pos, round(spread - lag(spread, 5) OVER (ORDER BY pos), 8) AS change_5, lag(bp, 1) OVER (ORDER BY pos) AS bp_before FROM panel"))
def lag_change(spark, d):
    return daily_panel(spark, d).select("pos", r(windows.change("spread", 5), 8).alias("change_5"), F.lag("bp").over(windows.by_pos()).alias("bp_before"))


@query(panel_sql("SELECT pos, round(CASE WHEN count(dd) OVER w = 20 THEN stddev_samp(dd) OVER w END, 6) AS vol FROM (SELECT pos, spread - lag(spread) OVER (ORDER BY pos) AS dd FROM panel) WINDOW w AS (ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def realised_vol(spark, d):
    return windows.realised_vol(daily_panel(spark, d), "spread", 20).select("pos", r("vol").alias("vol"))


@query(panel_sql("SELECT pos, round(CASE WHEN count(dd) OVER w = 20 THEN greatest(0.5, 1.4826 * quantile_cont(dd, 0.5) OVER w) END, 6) AS scale FROM (SELECT pos, abs(spread - lag(spread) OVER (ORDER BY pos)) AS dd FROM panel) WINDOW w AS (ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def mad_scale(spark, d):
    return windows.mad_scale(daily_panel(spark, d), "spread").select("pos", r("scale").alias("scale"))


@query(
    panel_sql(
        "SELECT b.pos, round(CASE WHEN count(a.dd) = 40 THEN sqrt(pi() / 2) * sum(pow(0.5, (b.pos - a.pos) / 10.0) * abs(a.dd) * CASE WHEN a.dd > 0 THEN 1.5 ELSE 0.5 END) / (SELECT sum(pow(0.5, i / 10.0)) FROM range(40) t(i)) END, 6) AS scale FROM dd b LEFT JOIN dd a ON a.pos BETWEEN b.pos - 39 AND b.pos GROUP BY b.pos",
        "dd AS (SELECT pos, spread - lag(spread) OVER (ORDER BY pos) AS dd FROM panel)",
    )
)
def ewma_scale(spark, d):
    return windows.ewma_scale(daily_panel(spark, d), "spread").select("pos", r("scale").alias("scale"))


@query(panel_sql("SELECT pos, round(CASE WHEN c = 60 THEN spread - lo END, 8) AS above_low, round(CASE WHEN c = 60 THEN hi - spread END, 8) AS below_high, round(CASE WHEN c = 60 AND sd > 0 THEN (spread - m) / sd END, 6) AS z FROM (SELECT pos, spread, count(spread) OVER w AS c, min(spread) OVER w AS lo, max(spread) OVER w AS hi, avg(spread) OVER w AS m, stddev_samp(spread) OVER w AS sd FROM panel WINDOW w AS (ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"))
def range_stats(spark, d):
    return windows.range_stats(daily_panel(spark, d), "spread", 60).select("pos", *(r(c, 8).alias(c) for c in ("above_low", "below_high")), r("z").alias("z"))


@query(panel_sql("SELECT pos, CASE WHEN x IS NOT NULL THEN x WHEN lag(x) OVER (ORDER BY pos) IS NOT NULL AND lead(x) OVER (ORDER BY pos) IS NOT NULL THEN lag(x) OVER (ORDER BY pos) END AS carried FROM (SELECT pos, CASE WHEN n > 4 THEN spread END AS x FROM panel)"))
def carry_one_row_holes(spark, d):
    p = daily_panel(spark, d).select("pos", F.when(F.col("n") > 4, F.col("spread")).alias("x"))
    return windows.carry_one_row_holes(p, "x").select("pos", "carried")


EVENT = f"(bp > {TAU})"


@query(panel_sql(f"SELECT pos, pos - max(CASE WHEN {EVENT} THEN pos END) OVER (ORDER BY pos) AS since FROM panel"))
def rows_since_event(spark, d):
    return windows.rows_since(daily_panel(spark, d), F.col("bp") > TAU).select("pos", "since")


@query(panel_sql(f"SELECT pos, least(pos - max(CASE WHEN {EVENT} THEN pos END) OVER (ORDER BY pos), min(CASE WHEN {EVENT} THEN pos END) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos) AS distance FROM panel"))
def nearest_event(spark, d):
    return windows.nearest_event(daily_panel(spark, d), F.col("bp") > TAU).select("pos", "distance")


ONSET_SQL = f"on_ AS (SELECT pos, date, {EVENT}::INTEGER AS event, coalesce(count(*) OVER w = 5 AND sum({EVENT}::INTEGER) OVER w = 0, false) AS at_risk FROM panel WINDOW w AS (ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"


@query(panel_sql("SELECT pos, event, at_risk, at_risk AND event = 1 AS onset FROM on_", ONSET_SQL))
def onset_flags(spark, d):
    return windows.onsets(daily_panel(spark, d), F.col("bp") > TAU).select("pos", "event", "at_risk", "onset")


@query(panel_sql(f"SELECT min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_rows, max(spread) AS peak FROM (SELECT *, pos - row_number() OVER (ORDER BY pos) AS island FROM panel WHERE {EVENT}) GROUP BY island"))
def episodes(spark, d):
    return windows.episodes(daily_panel(spark, d), F.col("bp") > TAU)


@query(panel_sql("SELECT pos, pos - coalesce(max(CASE WHEN NOT up THEN pos END) OVER (ORDER BY pos), -1) AS run FROM (SELECT pos, coalesce(count(*) OVER w = 30 AND spread > quantile_cont(spread, 0.5) OVER w, false) AS up FROM panel WINDOW w AS (ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"))
def above_median_run(spark, d):
    return windows.above_median_run(daily_panel(spark, d), "spread", 30).select("pos", "run")


@query(panel_sql("SELECT pos, round(CASE WHEN count(*) OVER w >= 63 THEN quantile_cont(n / volume, 0.1) OVER w ELSE 0.12 END, 6) AS level FROM panel WINDOW w AS (ORDER BY pos ROWS BETWEEN 503 PRECEDING AND CURRENT ROW)"))
def rolling_level(spark, d):
    frame = windows.rows(-503, 0)
    p = daily_panel(spark, d).withColumn("ratio", F.col("n") / F.col("volume"))
    return p.select("pos", r(F.when(F.count("ratio").over(frame) >= 63, F.percentile("ratio", F.lit(0.1)).over(frame)).otherwise(0.12)).alias("level"))


@query(panel_sql("SELECT pos, round((rank() OVER (ORDER BY bp) - 1 + count(*) OVER (PARTITION BY bp) / 2.0) / count(*) OVER (), 6) AS mid_rank, rank() OVER (ORDER BY bp) + (count(*) OVER (PARTITION BY bp) - 1) / 2.0 AS average_rank FROM panel"))
def mid_ranks(spark, d):
    return windows.mid_ranks(daily_panel(spark, d), "bp").select("pos", r("mid_rank").alias("mid_rank"), "average_rank")


@query(panel_sql("SELECT CAST(year(date) AS INTEGER) AS year, round(sum(greatest(0, least(1, (20 - above) / ties)) * flag), 6) AS hits, CAST(sum(flag) AS BIGINT) AS events FROM (SELECT date, (bp > 5)::INTEGER AS flag, rank() OVER (PARTITION BY year(date) ORDER BY n DESC) - 1 AS above, count(*) OVER (PARTITION BY year(date), n) AS ties FROM panel) GROUP BY 1"))
def top_k_expected_hits(spark, d):
    p = daily_panel(spark, d).select(F.year("date").alias("year"), "n", (F.col("bp") > TAU).cast("int").alias("flag"))
    return windows.top_k_hits(p, "year", "n", "flag", 20).select("year", r("hits").alias("hits"), "events")


@query(panel_sql("SELECT pos, CASE WHEN b > 0 AND a < 0 THEN 'peak' ELSE 'trough' END AS kind FROM (SELECT pos, spread - lag(spread) OVER (ORDER BY pos) AS b, lead(spread) OVER (ORDER BY pos) - spread AS a FROM panel) WHERE (b >= 5 AND a <= -5) OR (b <= -5 AND a >= 5)"))
def turning_points(spark, d):
    p = daily_panel(spark, d).select("pos", windows.change("spread", 1).alias("b"), (F.lead("spread").over(windows.by_pos()) - F.col("spread")).alias("a"))
    return p.filter("(b >= 5 and a <= -5) or (b <= -5 and a >= 5)").select("pos", F.when(F.col("b") > 0, "peak").otherwise("trough").alias("kind"))


@query(panel_sql("SELECT CAST(k AS INTEGER) AS k, round(corr(a.spread, b.spread), 6) AS r FROM panel a, range(1, 11) t(k), panel b WHERE b.pos = a.pos - k GROUP BY 1"))
def lag_correlations(spark, d):
    p = daily_panel(spark, d)
    shifted = p.select("spread", *(F.lag("spread", k).over(windows.by_pos()).alias(str(k)) for k in range(1, 11))).unpivot(["spread"], [str(k) for k in range(1, 11)], "k", "other")
    return shifted.groupBy(F.col("k").cast("int").alias("k")).agg(r(F.corr("spread", "other")).alias("r"))


@query(panel_sql("SELECT date, round(avg(x), 6) AS week_mean FROM (SELECT w.date, (SELECT arg_max(p.spread, p.date) FROM panel p WHERE p.date <= w.date - i AND p.date > w.date - i - 10) AS x FROM panel w, unnest([0, 1, 2, 3, 4, 5, 6]) AS t(i)) GROUP BY 1 HAVING count(x) = 7"))
def week_average(spark, d):
    """The mean over seven calendar days; a day without a row carries the level before it."""
    p = daily_panel(spark, d)
    upto = F.coalesce(F.lead("date").over(Window.orderBy("date")), F.date_add("date", 1))
    last = p.select("spread", F.col("date").alias("own"), F.date_sub(F.least(upto, F.date_add("date", 10)), 1).alias("until"))
    carried = last.select("spread", "own", F.explode(F.sequence("own", "until")).alias("date"))
    frame = Window.orderBy(F.unix_date("date")).rangeBetween(-6, 0)
    return carried.select("date", "own", r(F.avg("spread").over(frame)).alias("week_mean"), F.count("*").over(frame).alias("n")).filter("date = own and n = 7").select("date", "week_mean")


@query(panel_sql("SELECT pos, round(sum(volume) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 7) AS ahead FROM panel"))
def window_sum_ahead(spark, d):
    return daily_panel(spark, d).select("pos", r(F.sum("volume").over(windows.rows(1, 5)), 7).alias("ahead"))


LEVELS_SQL = """ol AS (SELECT pos, CASE WHEN count(*) OVER w = 10 THEN round(quantile_cont(spread, 0.5) OVER w, 9) END AS own FROM cal WHERE day_type = 'ordinary' WINDOW w AS (ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
lev AS (SELECT p.pos, p.date, p.spread, ol.own AS level FROM panel p ASOF LEFT JOIN ol ON p.pos >= ol.pos)"""


@query(panel_sql("SELECT pos, level FROM lev", f"{CAL_SQL}, {LEVELS_SQL}"))
def ordinary_levels(spark, d):
    return benchmarks.ordinary_levels(daily_panel(spark, d)).select("pos", "level")


# --- aggregates, settlement

NET_SQL = """
SELECT l_shipdate::DATE AS settle, o_orderpriority AS kind, count(*) AS auctions, count(*) FILTER (o_orderdate <= TIMESTAMP '1998-01-01') AS announced,
CASE WHEN count(*) FILTER (o_orderdate <= TIMESTAMP '1998-01-01') = 0 THEN 'unannounced' WHEN count(*) FILTER (o_orderdate <= TIMESTAMP '1998-01-01') < count(*) THEN 'incomplete' ELSE 'complete' END AS state,
CASE WHEN count(*) FILTER (o_orderdate <= TIMESTAMP '1998-01-01') < count(*) THEN 0 ELSE round(sum(l_extendedprice) - max(l_quantity * 100), 2) END AS net
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
"""


@query(NET_SQL)
def net_settlement(spark, d):
    lines, orders = read(spark, d, "lineitem"), read(spark, d, "orders")
    due = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    known = F.count_if(F.col("o_orderdate") <= F.lit("1998-01-01").cast("timestamp"))
    out = due.groupBy(F.to_date("l_shipdate").alias("settle"), F.col("o_orderpriority").alias("kind")).agg(
        F.count("*").alias("auctions"), known.alias("announced"), F.sum("l_extendedprice").alias("offering"), F.max(F.col("l_quantity") * 100).alias("maturing")
    )
    whole = F.col("announced") == F.col("auctions")
    state = F.when(F.col("announced") == 0, "unannounced").when(~whole, "incomplete").otherwise("complete")
    return out.select("settle", "kind", "auctions", "announced", state.alias("state"), F.when(whole, r(F.col("offering") - F.col("maturing"), 2)).otherwise(0.0).alias("net"))


@query("SELECT l_shipdate::DATE AS settle, round(sum(l_extendedprice) FILTER (l_linestatus = 'F'), 2) AS \"F\", round(sum(l_extendedprice) FILTER (l_linestatus = 'O'), 2) AS \"O\" FROM lineitem GROUP BY 1")
def gross_by_day(spark, d):
    return read(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("settle")).pivot("l_linestatus", ["F", "O"]).agg(r(F.sum("l_extendedprice"), 2))


@query(panel_sql("SELECT count(*) FILTER (was = 0 AND e = 0) AS n00, count(*) FILTER (was = 0 AND e = 1) AS n01, count(*) FILTER (was = 1 AND e = 0) AS n10, count(*) FILTER (was = 1 AND e = 1) AS n11 FROM (SELECT (bp > 5)::INTEGER AS e, lag((bp > 5)::INTEGER) OVER (ORDER BY pos) AS was FROM panel)"))
def transition_counts(spark, d):
    return scores.transitions(daily_panel(spark, d).withColumn("hit", (F.col("bp") > TAU).cast("int")), "hit")


@query(panel_sql("SELECT day_type, count(*) AS n, round(250.0 * sum((bp > 5)::INTEGER) / count(*), 6) AS per_year, round(avg(spread), 6) AS mean_spread FROM cal GROUP BY 1", CAL_SQL))
def flag_rate_by_day_type(spark, d):
    c = calendars.calendar_columns(daily_panel(spark, d))
    return c.groupBy("day_type").agg(F.count("*").alias("n"), r(250.0 * F.sum((F.col("bp") > TAU).cast("int")) / F.count("*")).alias("per_year"), r(F.avg("spread")).alias("mean_spread"))


@query(panel_sql("SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n_days FROM (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INTEGER) AS island FROM panel WHERE n <= 3) GROUP BY island"))
def suppressed_runs(spark, d):
    low = daily_panel(spark, d).filter("n <= 3").withColumn("island", F.date_sub("date", F.row_number().over(Window.orderBy("date"))))
    return low.groupBy("island").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_days")).drop("island")


@query(panel_sql("SELECT a.pos, round(avg((b.bp > 5)::INTEGER), 6) AS share, count(*) AS pool FROM cal a JOIN cal b ON a.day_type = b.day_type AND b.pos BETWEEN a.pos - 250 AND a.pos - 1 GROUP BY 1", CAL_SQL))
def climatology(spark, d):
    c = calendars.calendar_columns(daily_panel(spark, d)).withColumn("e", (F.col("bp") > TAU).cast("int"))
    frame = Window.partitionBy("day_type").orderBy("pos").rangeBetween(-250, -1)
    got = c.select("pos", r(F.avg("e").over(frame)).alias("share"), F.count("*").over(frame).alias("pool"))
    return got.filter("pool > 0")


# --- forecasts and scores

GRID_SQL = "[" + ", ".join(map(str, scores.GRID)) + "]"


def forecast_sql(lead: int = 1, window: int = 500, least: int = 60) -> str:
    return f"""
mv AS (SELECT pos, date, spread, lead(spread, {lead}) OVER (ORDER BY pos) AS outcome, spread - lag(spread, {lead}) OVER (ORDER BY pos) AS move FROM panel),
fc AS (SELECT pos, date, outcome, list_transform(pool, lambda x: x + spread) AS q FROM (
  SELECT *, quantile_cont(move, {GRID_SQL}) OVER w AS pool, count(move) OVER w AS size FROM mv WINDOW w AS (ORDER BY pos ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))
  WHERE size >= {least} AND outcome IS NOT NULL)"""


def crps_sql(q: str, y: str) -> str:
    return f"2 * list_sum(list_transform(range(1, {len(scores.GRID) + 1}), lambda i: greatest({GRID_SQL}[i] * ({y} - {q}[i]), ({GRID_SQL}[i] - 1) * ({y} - {q}[i])))) / {len(scores.GRID)}"


def _forecasts(spark, d, lead=1):
    return scores.persistence(daily_panel(spark, d), lead)


@query(panel_sql("SELECT pos, outcome, round(q[1], 6) AS q01, round(q[12], 6) AS q50, round(q[23], 6) AS q99 FROM fc", forecast_sql(3)))
def persistence_forecast(spark, d):
    f = _forecasts(spark, d, 3)
    return f.select("pos", "outcome", *(r(scores.quantile(F.col("q"), x)).alias(n) for x, n in ((0.01, "q01"), (0.5, "q50"), (0.99, "q99"))))


@query(panel_sql(f"SELECT pos, round({crps_sql('q', 'outcome')}, 6) AS crps, round({crps_sql('list_transform(q, lambda z: greatest(z, 0))', 'greatest(outcome, 0)')}, 6) AS tail_crps FROM fc", forecast_sql()))
def grid_crps(spark, d):
    q, y = F.col("q"), F.col("outcome")
    return _forecasts(spark, d).select("pos", r(scores.crps(q, y)).alias("crps"), r(scores.upper_tail_crps(q, y)).alias("tail_crps"))


@query(panel_sql(f"SELECT day_type, count(*) AS n, round(avg({crps_sql('q', 'outcome')}), 6) AS crps, round(avg(abs(q[12] - outcome)), 6) AS mae, round(avg((outcome BETWEEN q[3] AND q[21])::INTEGER), 6) AS coverage_90 FROM fc JOIN (SELECT pos - 1 AS pos, day_type FROM cal) USING (pos) GROUP BY 1", CAL_SQL + "," + forecast_sql()))
def persistence_scores_by_day_type(spark, d):
    """Forecasts of the next day by persistence, scored by the target's day type."""
    target = calendars.calendar_columns(daily_panel(spark, d)).select((F.col("pos") - 1).alias("pos"), "day_type")
    q, y = F.col("q"), F.col("outcome")
    inside = y.between(scores.quantile(q, 0.05), scores.quantile(q, 0.95)).cast("int")
    mae = F.abs(scores.quantile(q, 0.5) - y)
    return _forecasts(spark, d).join(target, "pos").groupBy("day_type").agg(F.count("*").alias("n"), r(F.avg(scores.crps(q, y))).alias("crps"), r(F.avg(mae)).alias("mae"), r(F.avg(inside)).alias("coverage_90"))


@query(panel_sql(f"SELECT l AS level, round(avg(greatest(l * (outcome - x), (l - 1) * (outcome - x))), 6) AS loss FROM (SELECT outcome, unnest(q) AS x, unnest({GRID_SQL}::DOUBLE[]) AS l FROM fc) GROUP BY 1", forecast_sql()))
def loss_by_level(spark, d):
    each = _forecasts(spark, d).select("outcome", F.explode(F.arrays_zip("q", scores.levels().alias("level"))).alias("z"))
    return each.groupBy(F.col("z.level").alias("level")).agg(r(F.avg(scores.pinball(F.col("z.level"), F.col("z.q"), F.col("outcome")))).alias("loss"))


@query(panel_sql("SELECT count(*) AS n, CAST(sum((outcome > q[21])::INTEGER) AS BIGINT) AS hits FROM fc", forecast_sql()), "upper_tail_hits")
def upper_tail_hits(spark, d):
    return _forecasts(spark, d).agg(F.count("*").alias("n"), F.sum((F.col("outcome") > scores.quantile(F.col("q"), 0.95)).cast("int")).alias("hits"))


@query(panel_sql("SELECT n, hits, round(hits / n, 6) AS share, round(greatest(0, 2 * (CASE WHEN hits = 0 THEN 0 ELSE hits * ln(hits / n) END + CASE WHEN n = hits THEN 0 ELSE (n - hits) * ln(1 - hits / n) END - hits * ln(0.05) - (n - hits) * ln(0.95))), 6) AS lr FROM (SELECT count(*) AS n, CAST(sum((outcome > q[21])::INTEGER) AS BIGINT) AS hits FROM fc)", forecast_sql()))
def kupiec_ratio(spark, d):
    hit = _forecasts(spark, d).withColumn("hit", (F.col("outcome") > scores.quantile(F.col("q"), 0.95)).cast("int"))
    return scores.kupiec(hit, "hit", 0.05).select("n", "hits", r("share").alias("share"), r("lr").alias("lr"))


#: The tail of chi-square with one degree of freedom at lr: one less the error function of the square root of lr / 2.
TAIL_SQL = "CASE WHEN lr <= 0 THEN 1.0 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-lr / 2) * list_sum(list_transform(range(0, 200), lambda i: exp(2 * i * ln(2) + (2 * i + 1) * ln(sqrt(lr / 2)) + lgamma(i + 1) - lgamma(2 * i + 2))))) END"


@query(panel_sql(f"SELECT n, hits, round({TAIL_SQL}, 6) AS p_value FROM (SELECT n, hits, greatest(0, 2 * (CASE WHEN hits = 0 THEN 0 ELSE hits * ln(hits / n) END + CASE WHEN n = hits THEN 0 ELSE (n - hits) * ln(1 - hits / n) END - hits * ln(0.05) - (n - hits) * ln(0.95))) AS lr FROM (SELECT count(*) AS n, CAST(sum((outcome > q[21])::INTEGER) AS BIGINT) AS hits FROM fc))", forecast_sql()))
def kupiec_p_value(spark, d):
    hit = _forecasts(spark, d).withColumn("hit", (F.col("outcome") > scores.quantile(F.col("q"), 0.95)).cast("int"))
    return scores.kupiec(hit, "hit", 0.05).select("n", "hits", r("p_value").alias("p_value"))


KNOTS_SQL = """list_concat([q[1] - 0.01 * (q[2] + 1e-6 - q[1]) / (0.025 - 0.01)], list_transform(q, lambda x, i: x + 1e-6 * (i - 1)), [q[23] + 22e-6 + (1 - 0.99) * (q[23] + 1e-6 - q[22]) / (0.99 - 0.975)])"""
LEVEL_ENDS_SQL = f"list_concat([0.0], {GRID_SQL}, [1.0])"


def cdf_sql(x: str) -> str:
    """F(x) from columns e, the knots, and g, their levels."""
    n = f"len(list_filter(e, lambda z: z < {x}))"
    return f"CASE WHEN {n} = 0 THEN 0.0 WHEN {n} = 25 THEN 1.0 ELSE g[{n}] + ({x} - e[{n}]) / (e[{n} + 1] - e[{n}]) * (g[{n} + 1] - g[{n}]) END"


LAW_SQL = f"{forecast_sql()}, law AS (SELECT pos, date, outcome, q, {KNOTS_SQL} AS e, {LEVEL_ENDS_SQL} AS g FROM fc)"


@query(panel_sql(f"SELECT CAST(year(date) AS INTEGER) AS year, round(avg(power(1 - ({cdf_sql('5.5')}) - (outcome > 5.5)::INTEGER, 2)), 6) AS brier, CAST(sum((outcome > 5.5)::INTEGER) AS BIGINT) AS events FROM law GROUP BY 1", LAW_SQL))
def brier_by_year(spark, d):
    p, e = laws.exceedance(F.col("q"), TAU), (F.col("outcome") > TAU + 0.5).cast("int")
    f = _forecasts(spark, d).select("date", p.alias("p"), e.alias("e"))
    return f.groupBy(F.year("date").alias("year")).agg(r(F.avg(F.pow(F.col("p") - F.col("e"), 2))).alias("brier"), F.sum("e").alias("events"))


DIFF_SQL = f"""{forecast_sql()}, cr AS (SELECT pos, {crps_sql('q', 'outcome')} - abs(q[12] - outcome) AS dd FROM fc),
ce AS (SELECT pos, dd, dd - avg(dd) OVER () AS e FROM cr), cl AS (SELECT e, row_number() OVER (ORDER BY pos) AS i, dd FROM ce)"""


@query(panel_sql("SELECT count(*) AS n, round(avg(dd), 6) AS mean, round((sum(e * e) + 2 * (SELECT sum((1 - (b.i - a.i) / 11.0) * a.e * b.e) FROM cl a JOIN cl b ON b.i > a.i AND b.i <= a.i + 10)) / count(*), 6) AS variance FROM cl", DIFF_SQL))
def hac_variance(spark, d):
    """Long-run variance of the difference between two scores."""
    f = _forecasts(spark, d).withColumn("dd", scores.crps(F.col("q"), F.col("outcome")) - F.abs(scores.quantile(F.col("q"), 0.5) - F.col("outcome")))
    return scores.hac_variance(f, "dd").select("n", r("mean").alias("mean"), r("variance").alias("variance"))


@query(panel_sql("SELECT key, p, min(ok) OVER (ORDER BY p, key ROWS UNBOUNDED PRECEDING) = 1 AS rejected FROM (SELECT key, p, (p <= 0.05 / (count(*) OVER () - row_number() OVER (ORDER BY p, key) + 1))::INTEGER AS ok FROM (SELECT CAST(year(date) AS VARCHAR) AS key, round(exp(-avg(spread) / 20), 6) AS p FROM panel GROUP BY 1))"))
def holm_rejections(spark, d):
    p = daily_panel(spark, d).groupBy(F.year("date").cast("string").alias("key")).agg(r(F.exp(-F.avg("spread") / 20)).alias("p"))
    return scores.holm(p, "key", "p").select("key", "p", "rejected")


@query(panel_sql("SELECT n, n1, round((s - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) AS auc FROM (SELECT count(*) AS n, CAST(sum(e) AS BIGINT) AS n1, sum(CASE WHEN e = 1 THEN rk END) AS s FROM (SELECT (bp > 5)::INTEGER AS e, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rk FROM panel))"))
def auc_of_counts(spark, d):
    p = daily_panel(spark, d).select("n", (F.col("bp") > TAU).cast("int").alias("e"))
    return scores.auc(p, "n", "e").select("n", "n1", r("auc").alias("auc"))


HITS_SQL = "ht AS (SELECT pos, (outcome > q[21])::INTEGER AS e, lag((outcome > q[21])::INTEGER) OVER (ORDER BY pos) AS was FROM fc), nn AS (SELECT count(*) FILTER (was = 0 AND e = 0) AS n00, count(*) FILTER (was = 0 AND e = 1) AS n01, count(*) FILTER (was = 1 AND e = 0) AS n10, count(*) FILTER (was = 1 AND e = 1) AS n11 FROM ht)"


def xlogy_sql(n: str, p: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE {n} * ln({p}) END)"


CHAIN_SQL = f"""{xlogy_sql('n00', 'n00 / (n00 + n01)')} + {xlogy_sql('n01', 'n01 / (n00 + n01)')} + {xlogy_sql('n10', 'n10 / (n10 + n11)')} + {xlogy_sql('n11', 'n11 / (n10 + n11)')}
- {xlogy_sql('(n00 + n10)', '(n00 + n10) / (n00 + n01 + n10 + n11)')} - {xlogy_sql('(n01 + n11)', '(n01 + n11) / (n00 + n01 + n10 + n11)')}"""


def _tail_hits(spark, d):
    return _forecasts(spark, d).withColumn("hit", (F.col("outcome") > scores.quantile(F.col("q"), 0.95)).cast("int"))


@query(panel_sql(f"SELECT n00, n01, n10, n11, round(greatest(0, 2 * ({CHAIN_SQL})), 6) AS lr FROM nn", f"{forecast_sql()}, {HITS_SQL}"))
def christoffersen_independence(spark, d):
    got = scores.independence(scores.transitions(_tail_hits(spark, d), "hit"))
    return got.select("n00", "n01", "n10", "n11", r("lr").alias("lr"))


@query(panel_sql("SELECT CAST(list_sum(list_transform([q[3], q[7], q[12], q[17], q[21]], lambda x: (x < outcome)::INTEGER)) AS INTEGER) AS bin, count(*) AS n FROM fc GROUP BY 1", forecast_sql()))
def pit_histogram(spark, d):
    return scores.pit_bins(_forecasts(spark, d), "q", "outcome", [0.05, 0.25, 0.5, 0.75, 0.95])


@query(panel_sql("SELECT count(*) AS n, round(avg(dd) / sqrt((sum(e * e) + 2 * (SELECT sum((1 - (b.i - a.i) / 11.0) * a.e * b.e) FROM cl a JOIN cl b ON b.i > a.i AND b.i <= a.i + 10)) / count(*) / count(*)), 5) AS statistic FROM cl", DIFF_SQL))
def diebold_mariano(spark, d):
    f = _forecasts(spark, d).withColumn("dd", scores.crps(F.col("q"), F.col("outcome")) - F.abs(scores.quantile(F.col("q"), 0.5) - F.col("outcome")))
    return scores.hac_variance(f, "dd").select("n", r(F.col("mean") / F.sqrt(F.col("variance") / F.col("n")), 5).alias("statistic"))


@query(panel_sql("SELECT CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, round(max(outcome), 6) AS peak, round(max(q[21]), 6) AS highest_forecast, count(*) AS n FROM fc GROUP BY 1, 2", forecast_sql()))
def quarter_peaks(spark, d):
    top = F.max(scores.quantile(F.col("q"), 0.95))
    return _forecasts(spark, d).groupBy(F.year("date").alias("year"), F.quarter("date").alias("quarter")).agg(r(F.max("outcome")).alias("peak"), r(top).alias("highest_forecast"), F.count("*").alias("n"))


@query(panel_sql("SELECT CAST(sum(hits) AS BIGINT) AS hits, round(sum(hits * top / seen) / sum(hits), 6) AS average_precision FROM (SELECT hits, sum(hits) OVER w AS top, sum(m) OVER w AS seen FROM (SELECT n, count(*) AS m, sum((bp > 5)::INTEGER) AS hits FROM panel GROUP BY n) WINDOW w AS (ORDER BY n DESC ROWS UNBOUNDED PRECEDING))"))
def average_precision(spark, d):
    p = daily_panel(spark, d).select("n", (F.col("bp") > TAU).cast("int").alias("e"))
    return scores.average_precision(p, "n", "e").select("hits", r("average_precision").alias("average_precision"))


@query(panel_sql("SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS a, rank() OVER (ORDER BY bp) + (count(*) OVER (PARTITION BY bp) - 1) / 2.0 AS b FROM panel)"))
def spearman(spark, d):
    return scores.spearman(daily_panel(spark, d), "n", "bp").select("n", r("rho").alias("rho"))


@query(panel_sql("""SELECT k, n, phi, loss FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY loss, phi) AS place FROM (
  SELECT k, n, i / 100 AS phi, round(yy - 2 * power(i / 100, k) * xy + power(i / 100, 2 * k) * xx, 4) AS loss FROM (
    SELECT k, count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM pr GROUP BY k HAVING count(*) >= 60), unnest(range(0, 101)) AS g(i))) WHERE place = 1""",
  """lv AS (SELECT *, CASE WHEN count(*) OVER w = 10 THEN round(quantile_cont(spread, 0.5) OVER w, 9) END AS level FROM panel WINDOW w AS (ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
  pr AS (SELECT CAST(k AS INTEGER) AS k, a.spread - a.level AS x, b.spread - a.level AS y FROM lv a, unnest([1, 2, 3, 4, 5]) AS u(k), panel b WHERE b.pos = a.pos + k AND a.level IS NOT NULL)"""))
def mean_reversion_phi(spark, d):
    before = windows.rows(-10, -1)
    level = F.when(F.count("spread").over(before) == 10, r(F.percentile("spread", F.lit(0.5)).over(before), 9))
    return reversion.fit_phi(reversion.pairs(daily_panel(spark, d).withColumn("level", level), [1, 2, 3, 4, 5]))


@query(panel_sql("""SELECT count(*) AS replicates, round(quantile_cont(mean, 0.05), 6) AS low, round(quantile_cont(mean, 0.95), 6) AS high FROM (
  SELECT replicate, sum(block) / (count(*) * 10) AS mean FROM st JOIN bl USING (place) GROUP BY replicate)""",
  """sz AS (SELECT count(*) AS n FROM panel),
  wr AS (SELECT pos AS place, spread FROM panel UNION ALL SELECT pos + sz.n AS place, spread FROM panel, sz WHERE pos < 9),
  bl AS (SELECT place, sum(spread) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS block FROM wr),
  st AS (SELECT replicate, CAST(('0x' || left(md5('0-' || replicate || '-' || b), 8))::BIGINT % n AS INTEGER) AS place FROM sz, unnest(range(0, 500)) AS g(replicate), unnest(range(0, CAST(ceil(n / 10) AS BIGINT))) AS h(b))"""))
def block_bootstrap_interval(spark, d):
    """Interval of the mean spread from 500 resamples in circular blocks of ten days."""
    means = resampling.block_means(spark, daily_panel(spark, d), "spread", 10, 500)
    return resampling.interval(means).select("replicates", r("low").alias("low"), r("high").alias("high"))
