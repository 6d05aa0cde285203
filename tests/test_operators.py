import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel import catalog_daily, streaming
from tidepanel.operators import asof, benchmarks, calendar_terms, calendars, isotonic, laws, projections, regimes, regression, resampling, scaled_pools, scores, trackers, windows
from tidepanel.plans.tables import Tables
from tidepanel.streaming import journal


def test_asof_takes_the_latest_row_at_or_before_and_minds_the_tolerance(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), (None, 3)], "k string, t long").withColumn("t", F.timestamp_seconds("t"))
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 2, 20.0), ("b", 1, 10.0), ("b", None, 0.0)], "k string, u long, v double").withColumn("u", F.timestamp_seconds("u"))
    got = {(r["k"], r["t"].second): r["v"] for r in asof.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {("a", 5): 50.0, ("a", 1): None, ("b", 9): 10.0, (None, 3): None}
    near = {(r["k"], r["t"].second): r["v"] for r in asof.asof_join(left, right, ["k"], "t", "u", ["v"], "3 SECONDS").collect()}
    assert near[("b", 9)] is None and near[("a", 5)] == 50.0


def test_no_later_value_moves_an_anchor(spark):
    rows = [(i, f"2024-01-{i + 1:02d}", float(i)) for i in range(12)]
    panel = spark.createDataFrame(rows, "pos int, date string, spread double").withColumn("date", F.to_date("date"))
    whole = {r["pos"]: r["anchor"] for r in asof.anchors(panel).collect()}
    cut = {r["pos"]: r["anchor"] for r in asof.anchors(panel.filter("pos <= 7")).collect()}
    assert all(whole[k] == v for k, v in cut.items())
    assert all(v is None or v < k for k, v in whole.items())


def test_chi_square_tail(spark):
    got = spark.range(1, 20).select(F.col("id"), scores.chi2_1(F.col("id") / 3).alias("p")).collect()
    assert all(abs(r["p"] - math.erfc(math.sqrt(r["id"] / 6))) < 1e-12 for r in got)


def test_onset_needs_calm_rows(spark):
    panel = spark.createDataFrame(list(enumerate([9, 0, 0, 0, 0, 0, 9, 9, 0])), "pos int, bp int")
    got = [r["pos"] for r in windows.onsets(panel, F.col("bp") > 5).filter("onset").collect()]
    assert got == [6]


def test_single_holes_are_carried_and_longer_ones_stay(spark):
    panel = spark.createDataFrame(list(enumerate([1.0, None, 3.0, None, None, 6.0])), "pos int, x double")
    assert [r["carried"] for r in windows.carry_one_row_holes(panel, "x").orderBy("pos").collect()] == [1.0, 1.0, 3.0, None, None, 6.0]


def panel(spark, n=1500):
    own = random.Random(8)
    rows = [(i, float(round(own.gauss(0, 3), 3))) for i in range(n)]
    days = spark.createDataFrame(rows, "pos int, spread double")
    return days.withColumn("date", F.date_add(F.lit("1995-01-01").cast("date"), "pos")).withColumn("bp", F.bround("spread").cast("int"))


def test_a_truncated_panel_gives_the_same_forecasts(spark):
    whole = panel(spark).cache()
    cut = whole.filter("pos <= 900")
    two = scaled_pools.VARIANTS[:1]

    def terms(days):
        days = days.withColumn("coupons", F.col("pos") % 3)
        return calendar_terms.terms_walk(days, days.select("pos", (F.col("pos") % 4 / 3).alias("state")), calendar_terms.Arm(interact=True))

    for make in (benchmarks.changes_forecast, benchmarks.reversion_walk, lambda days: scaled_pools.scaled_walk(days, two), terms):
        a = {(r["decision"], r["lead"]): r["q"] for r in make(whole).filter("decision <= 890").collect()}
        b = {(r["decision"], r["lead"]): r["q"] for r in make(cut).filter("decision <= 890").collect()}
        assert a and a.keys() == b.keys() and all(max(abs(x - y) for x, y in zip(a[k], b[k])) < 1e-9 for k in a)


def test_day_types_follow_the_business_calendar(spark):
    days = spark.createDataFrame([("2000-01-28",), ("2000-01-31",), ("2000-02-01",), ("2000-09-29",), ("2000-09-30",), ("2000-10-02",), ("2000-12-29",), ("2001-01-01",), ("2001-01-02",), ("2001-06-15",)], "d string").select(F.to_date("d").alias("date"))
    got = {str(r["date"]): r["day_type"] for r in calendars.calendar_columns(days, holidays=["2001-01-01"]).collect()}
    assert got["2000-01-28"] == got["2000-09-30"] == "ordinary" and got["2001-06-15"] == "tax_date"
    assert got["2000-01-31"] == got["2000-02-01"] == "turn" and got["2000-09-29"] == got["2000-10-02"] == "quarter_end_turn"
    assert got["2000-12-29"] == got["2001-01-02"] == "year_end" and got["2001-01-01"] == "ordinary"  # a holiday is no turn


def test_a_law_runs_from_zero_to_one_and_reads_its_quantiles_back(spark):
    q = [float(i) for i in range(23)]
    row = spark.range(1).select(F.array(*map(F.lit, q)).alias("q"))
    got = row.select(*(laws.cdf(F.col("q"), x).alias(f"c{i}") for i, x in enumerate((-5.0, 0.0, 11.0, 22.0, 30.0))), laws.exceedance(F.col("q"), 21.9).alias("p")).first()
    assert got["c0"] == 0 and got["c4"] == 1 and abs(got["c1"] - 0.01) < 1e-4 and abs(got["c2"] - 0.5) < 1e-4 and abs(got["c3"] - 0.99) < 1e-4 and abs(got["p"] - (1 - 0.9825)) < 1e-4


def test_reads_that_break_a_rule_are_refused(spark):
    reads = spark.createDataFrame([(5, 3, 10, 20, 3), (5, 5, 10, 20, 5), (5, 4, 30, 20, 4), (5, 2, 10, 20, 3)], "pos int, read int, at int, deadline int, newest int")
    assert [r["rule"] for r in asof.refused(reads, "pos", "read", "at", "deadline", "newest").collect()] == ["look ahead", "not public", "stale"]
    assert asof.require(reads.limit(1), "pos", "read", "at", "deadline", newer="newest").count() == 1
    with pytest.raises(Exception, match="breaks the rule at row 5"):
        asof.require(reads, "pos", "read", "at", "deadline").collect()


def test_projections_keep_nulls_and_hazards_of_one(spark):
    one = spark.range(1).select(F.lit(None).cast("double").alias("x"), F.array(F.lit(0.5), F.lit(1.0), F.lit(0.2)).alias("h"), F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0)).alias("v"))
    got = one.select(
        projections.shortfall(F.col("x"), F.lit(1.0)).alias("a"), projections.settlement_day(F.lit(1.0), F.lit(0.0), F.lit(9.0), F.col("x")).alias("b"), projections.survival(F.col("h")).alias("s"),
        projections.first_passage(F.col("h")).alias("p"), projections.conformal_quantile(F.col("v"), 0.5).alias("c"), projections.elasticity(F.col("x"), kinked=True).alias("e"),
    ).first()
    assert got["a"] is None and got["b"] is None and got["e"] is None and got["c"] == 2.0
    assert got["s"] == [0.5, 0.0, 0.0] and got["p"] == [0.5, 0.5, 0.0]


def test_a_short_pool_falls_down_its_chain(spark):
    days = [f"2000-{m:02d}-{d:02d}" for m in range(1, 8) for d in range(1, 29) if not (m > 3 and d > 12)]
    rows = [(k, d, float(k)) for k, d in enumerate(sorted({*days, "2000-01-31", "2000-02-29", "2000-03-31", "2000-04-28", "2000-05-31", "2000-06-30"}))]
    days = spark.createDataFrame(rows, "pos int, d string, spread double").withColumn("date", F.to_date("d"))
    typed = {r["pos"]: r["day_type"] for r in calendars.calendar_columns(days).collect()}
    got = {(r["decision"], r["lead"]): r for r in benchmarks.pool_forecast(days, least=4).collect()}
    quarter = [(p - h, h) for p, kind in typed.items() if kind == "quarter_end_turn" and p > 110 for h in (1, 2) if (p - h, h) in got]
    assert quarter and all(got[k]["pool"] == "turn" and got[k]["n"] >= 4 for k in quarter)  # two quarter ends before, but many turns
    early = [k for k in got if k[0] < 20]
    assert early and all(got[k]["pool"] in ("ordinary", "all") for k in early)


def test_both_ends_of_a_bucket_belong_to_it(spark):
    rows = spark.createDataFrame([(-20.0,), (-19.9,), (5.0,), (5.1,), (None,)], "v double")
    buckets = [("low", None, -20), ("calm", -20, 5), ("high", 5, None)]
    assert [r["b"] for r in rows.select(projections.bucket_label(F.col("v"), buckets).alias("b")).collect()] == ["low", "calm", "calm", "high", None]


def small_regressions(spark):
    own = np.random.default_rng(5)
    data = []
    for g in range(3):
        for _ in range(60 + 30 * g):
            x = [1.0, float(own.normal()), float(own.integers(0, 2))]
            data.append((g, x, float(2 * x[1] - x[2] + own.standard_t(2) + g)))
    return data, spark.createDataFrame(data, "g long, x array<double>, y double").repartition(3).cache()


def least(x, y, w, penalty, shift=0.0):
    penalties = np.diag([0] + [penalty] * (x.shape[1] - 1))
    return np.linalg.solve(x.T @ (x * w[:, None]) + penalties, x.T @ (w * y) + shift * x.sum(0))


def of_group(data, g):
    return np.array([d[1] for d in data if d[0] == g]), np.array([d[2] for d in data if d[0] == g])


def test_huber_fits_are_those_of_a_plain_loop(spark):
    data, rows = small_regressions(spark)
    for r in regression.huber(Tables(spark), rows, ["g"], 3, 5.0).collect():
        x, y = of_group(data, r["g"])
        b = least(x, y, np.ones(len(y)), 5.0)
        for turn in range(1, 51):
            e = y - x @ b
            cut = 1.345 * max(1.4826 * np.median(abs(e - np.median(e))), 1e-6)
            b, was = least(x, y, np.where(abs(e) <= cut, 1, cut / np.maximum(abs(e), 1e-300)), 5.0), b
            if abs(b - was).max() < 1e-8:
                break
        assert r["rounds"] == turn and r["n"] == len(y) and abs(np.array(r["b"]) - b).max() < 1e-10


def test_quantile_fits_are_those_of_a_plain_loop_and_near_the_least_loss(spark):
    data, rows = small_regressions(spark)
    levels = [0.1, 0.5]
    got = regression.quantile(Tables(spark), rows, ["g"], 3, 0.0, levels, rounds=25).collect()
    assert len(got) == 6
    for r in got:
        (x, y), tau = of_group(data, r["g"]), r["level"]
        b = least(x, y, np.ones(len(y)), 0.0)
        for _ in range(r["rounds"]):
            b = least(x, y, 1 / (2 * np.maximum(abs(y - x @ b), 1e-3)), 0.0, (2 * tau - 1) / 2)
        assert abs(np.array(r["b"]) - b).max() < 1e-8
        loss = lambda b: np.maximum(tau * (y - x @ b), (tau - 1) * (y - x @ b)).sum()  # noqa: B023, E731
        # an exact solution passes through three points
        exact = min(loss(np.linalg.solve(x[[i, j, k]], y[[i, j, k]])) for i in range(30) for j in range(i) for k in range(j) if abs(np.linalg.det(x[[i, j, k]])) > 1e-9)
        assert loss(np.array(r["b"])) <= exact * 1.01


def direct_isotonic(points):
    """The largest, over earlier starts, of the least, over later ends, of the means between."""
    n, t = np.array([p[1] for p in points], float), np.array([p[2] for p in points], float)
    fit = []
    for i in range(len(points)):
        fit.append(max(min(t[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(points))) for a in range(i + 1)))
    return fit


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_isotonic_fits_are_direct_ones_for_any_partitions(spark, parts):
    own = random.Random(parts)
    rows = [(own.randrange(90) / 90, int(own.random() < 0.4)) for _ in range(400)] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "p double, e int").repartition(5)
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    points = [(p, sum(r[0] == p for r in known), sum(r[1] for r in known if r[0] == p)) for p in sorted({r[0] for r in known})]
    want = direct_isotonic(points)
    tables = Tables(spark)
    fit = isotonic.blocks(tables, isotonic.by_score(df, "p", "e"), parts=parts).orderBy("low").collect()
    for (p, _, _), value in zip(points, want):
        (block,) = [b for b in fit if b["low"] <= p <= b["high"]]
        assert abs(block["total"] / block["n"] - value) < 1e-12
    c = isotonic.corp(Tables(spark), df, "p", "e", parts=parts).first()
    assert c["n"] == len(known) and abs(c["miscalibration"] - c["discrimination"] + c["uncertainty"] - c["brier"]) < 1e-12
    read = isotonic.recalibrated(spark.createDataFrame([(-1.0,), (0.31,), (2.0,), (None,)], "s double"), spark.createDataFrame(fit), "s").collect()
    value = {r["s"]: r["fitted"] for r in read}
    assert abs(value[-1.0] - want[0]) < 1e-12 and abs(value[2.0] - want[-1]) < 1e-12 and value[None] is None
    assert abs(value[0.31] - want[max(k for k, p in enumerate(points) if p[0] <= 0.31)]) < 1e-12
    none = isotonic.corp(Tables(spark), df.limit(0), "p", "e").first()
    assert none["n"] is None and none["brier"] is None


def test_stationary_blocks_fill_their_resamples_and_have_their_mean_length(spark):
    size = spark.range(1).select(F.lit(500).cast("long").alias("n"))
    got = resampling.stationary_draws(spark, size, 8.0, 60).collect()
    for k in range(60):
        own = sorted((r["t"], r["days"]) for r in got if r["replicate"] == k)
        assert [t for t, _ in own] == [sum(d for _, d in own[:i]) for i in range(len(own))] and sum(d for _, d in own) == 500
    assert 7 < 60 * 500 / len(got) < 9
    assert {r["days"] for r in resampling.stationary_draws(spark, size, 1.0, 2).collect()} == {1}


def test_studentised_intervals_are_those_of_a_plain_computation(spark):
    own, n = np.random.default_rng(2), 120
    v, member = own.normal(size=n), own.random(n) < 0.4
    series = spark.createDataFrame([(3 * k, float(v[k])) for k in range(n)], "pos long, value double")
    members = spark.createDataFrame([(3 * k, d) for k in range(n) for d in ("all", "some") if d == "all" or member[k]] + [(0, "one"), (0, "one")], "pos long, domain string")
    got = {r["domain"]: r for r in resampling.domain_intervals(spark, series, members, 5.0, 50, 0.9, 4).collect()}
    draws = resampling.stationary_draws(spark, spark.range(1).select(F.lit(n).cast("long").alias("n")), 5.0, 50).collect()

    def variance(u):
        return (u @ u + 2 * sum((1 - k / 5) * (u[k:] @ u[:-k]) for k in range(1, 5))) / len(u)

    for name, inside in (("all", np.ones(n, bool)), ("some", member)):
        mean, k = v[inside].mean(), inside.sum()
        error = math.sqrt(variance(np.where(inside, v - mean, 0)) / n) * n / k
        ratios = []
        for rep in range(50):
            at = np.concatenate([(r["start"] + np.arange(r["days"])) % n for r in sorted((r for r in draws if r["replicate"] == rep), key=lambda r: r["t"])])
            own_mean = v[at][inside[at]].mean()
            ratios.append((own_mean - mean) / (math.sqrt(variance(np.where(inside[at], v[at] - own_mean, 0)) / n) * n / inside[at].sum()))
        r = got[name]
        assert r["n"] == k and abs(r["standard_error"] - error) < 1e-10 and r["unavailable"] is None
        assert abs(r["lower"] - (mean - np.quantile(ratios, 0.95) * error)) < 1e-8 and abs(r["upper"] - (mean - np.quantile(ratios, 0.05) * error)) < 1e-8
    assert got["one"]["unavailable"] and got["one"]["lower"] is None and got["one"]["n"] == 1


def test_streams_read_folders_drop_late_rows_and_go_on_from_their_state(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-02 10:00:00", "a", 2.0)])
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    run = lambda: streaming.drained(streaming.daily_counts(streaming.source(spark, str(tmp_path / "in"), schema), "1 day"), str(tmp_path / "run"))
    assert run().count() == 0  # no day is closed yet
    write([("2024-01-09 10:00:00", "a", 3.0), ("2024-01-01 11:00:00", "a", 9.0)])  # the second is late, yet its day is still open
    assert {(str(r["day"]), r["n"], r["top"]) for r in run().collect()} == {("2024-01-01", 2, 9.0), ("2024-01-02", 1, 2.0)}
    write([("2024-01-03 10:00:00", "a", 7.0), ("2024-01-20 10:00:00", "a", 4.0)])  # the first comes after its day was dropped
    assert {(str(r["day"]), r["n"]) for r in run().collect()} == {("2024-01-01", 2), ("2024-01-02", 1), ("2024-01-09", 1)}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    assert streaming.drained(streaming.daily_counts(streaming.source(spark, str(tmp_path / "none"), schema))).count() == 0


def test_streamed_daily_counts_have_all_days_and_late_events(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "a", 1.0), ("2024-01-20 10:00:00", "a", 2.0)]  # the last day is still open
    late = [("2024-01-01 11:00:00", "a", 9.0), ("2024-01-20 09:00:00", "a", None), (None, "b", None), (None, "b", 4.0)]
    frame = lambda x: spark.createDataFrame(x, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    frame(rows + late).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = {("2024-01-01", "a", 2, 9.0), ("2024-01-20", "a", 2, 2.0), ("None", "b", 2, 4.0)}
    told = lambda df: {(str(r["day"]), r["event_type"], r["n"], r["top"]) for r in df.collect()}
    assert told(catalog_daily.stream_daily_counts(spark, str(tmp_path))) == want
    for part in (rows, late):  # a run that goes on from its state, long after the first day
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming.source(spark, str(tmp_path / "in"), frame(rows).schema)
        got = streaming.drained(streaming.running_counts(stream), str(tmp_path / "run"), ["day", "event_type"])
    assert told(got) == want
    frame([]).write.parquet(str(tmp_path / "none"))
    assert not told(streaming.drained(streaming.running_counts(streaming.source(spark, str(tmp_path / "none"), frame(rows).schema)), keys=["day", "event_type"]))


def test_captures_are_on_time_late_or_missed_in_one_batch_or_several(spark, tmp_path):
    due = [("u", 1, "2024-01-01 00:00:00"), ("u", 2, "2024-01-02 00:00:00"), ("v", 3, "2024-01-01 00:00:00"), ("v", 9, "2024-01-20 00:00:00")]
    records = [("u", "2024-01-01 01:00:00"), ("u", "2024-01-02 09:00:00"), ("w", "2024-01-01 02:00:00"), ("v", "2024-01-19 00:00:00")]
    found = []
    for case, order in (("whole", [(due, records)]), ("parts", [(due[:1] + due[2:3], records[1:3]), (due[1:2], records[:1]), (due[3:], records[3:])])):
        for left, right in order:
            spark.createDataFrame(left, "k string, due_id int, t string").select("k", "due_id", F.to_timestamp("t").alias("due_at")).coalesce(1).write.mode("append").parquet(str(tmp_path / case / "due"))
            spark.createDataFrame(right, "k string, t string").select("k", F.to_timestamp("t").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / case / "records"))
            read = [streaming.source(spark, str(tmp_path / case / n), spark.read.parquet(str(tmp_path / case / n)).schema) for n in ("due", "records")]
            got = streaming.drained(streaming.captures(*read, ["k"], "6 HOURS", "24 HOURS"), str(tmp_path / case / "run"))
        found.append({(r["due_id"], r["status"]) for r in got.collect()})
    assert found[0] == found[1] == {(1, "captured"), (2, "late"), (3, "missed")}


def plain_bands(rows, gains, flags):
    """The update written out over lists, every sum taken afresh."""
    done, out = [], []
    for k, (day, anchor, low, high, flag, actual) in enumerate(rows):
        seen = [d for d in done if d[0] <= anchor]
        tracker = errors = 0.0
        for i, d in enumerate(seen):
            before = [x[2] for x in seen[:i]][-100:]
            scale = max(1.0, max(before) - min(before)) if before else 1.0
            tracker += gains.step * scale * (d[3] - gains.miss)
            errors += d[3] - gains.miss
        recent = [d[2] for d in seen][-100:]
        scale = max(1.0, max(recent) - min(recent)) if recent else 1.0
        n = len(seen)
        part = gains.gain * scale * math.tan(max(-1.5, min(1.5, errors * math.log(n + 1) / (gains.saturation * (n + 1)))))
        cast = 0.0
        if n >= gains.scorecast_from:
            x = np.array([[1.0, *d[1]] for d in seen])
            use = [0] + [c for c in range(1, flags + 1) if 5 <= x[:, c].sum() <= n - 5]
            cast = float(np.linalg.lstsq(x[:, use], np.array([d[2] for d in seen]), rcond=None)[0] @ np.array([1.0, *flag])[use])
        width = tracker + part + cast
        lower, upper = low - width, high + width
        if lower > upper:
            lower = upper = (lower + upper) / 2
        out.append((day, n, width, lower, upper))
        if actual is not None:
            done.append((day, flag, max(low - actual, actual - high), float(not lower <= actual <= upper)))
    return out


def test_bands_are_those_of_a_plain_fold_in_one_batch_and_in_several(spark, tmp_path):
    own = random.Random(4)
    days = [f"2024-{m:02d}-{d:02d}" for m in range(1, 5) for d in range(1, 29)]
    rows = {s: [(days[k], days[k - 2], -1.0, 1.0, [float(k % 3 == 0)], None if k % 17 == 0 else own.gauss(0, 1.5)) for k in range(2, len(days))] for s in "ab"}
    schema = "series string, day date, anchor date, low double, high double, flags array<double>, actual double"

    def frame(keep):
        flat = [(s, d, a, lo, hi, f, y) for s in rows for d, a, lo, hi, f, y in rows[s] if keep(d)]
        made = spark.createDataFrame(flat, "series string, day string, anchor string, low double, high double, flags array<double>, actual double")
        return made.select("series", F.to_date("day").alias("day"), F.to_date("anchor").alias("anchor"), "low", "high", "flags", "actual")

    gains = trackers.Gains(step=0.2, saturation=5.0)
    want = {(s, d): (n, w, lo, hi) for s in rows for d, n, w, lo, hi in plain_bands(rows[s], gains, 1)}
    whole = {(r["series"], str(r["day"])): (r["observed"], r["width"], r["lower"], r["upper"]) for r in trackers.bands(frame(lambda d: True), gains, 1).collect()}
    assert whole.keys() == want.keys() and all(np.allclose(whole[k], want[k], atol=1e-7) for k in want)
    for k, month in enumerate(("2024-01", "2024-02", "2024-03", "2024-04")):
        frame(lambda d, m=month: d.startswith(m)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming.source(spark, str(tmp_path / "in"), spark.read.schema(schema).parquet(str(tmp_path / "in")).schema)
        got = streaming.drained(trackers.bands_of_stream(stream, gains, 1), str(tmp_path / "run"))
    parts = {(r["series"], str(r["day"])): (r["observed"], r["width"], r["lower"], r["upper"]) for r in got.collect()}
    assert parts.keys() == whole.keys() and all(np.allclose(parts[k], whole[k], atol=1e-9) for k in whole)
    with pytest.raises(Exception, match="would be known before its band"):
        trackers.bands(frame(lambda d: True).withColumn("anchor", F.col("day")), gains, 1).collect()


def test_block_lengths_are_those_of_a_plain_computation(spark):
    own = np.random.default_rng(6)
    x = [0.0]
    for e in own.normal(size=399):
        x.append(float(0.7 * x[-1] + e))
    n, c = len(x), np.array(x) - np.mean(x)
    gamma = np.array([(c[k:] @ c[: n - k]) / n for k in range(60)])
    run, most, band = 5, 25, 2 * math.sqrt(math.log10(n) / n)
    lag = next(m for m in range(most + 1) if (abs(gamma[m + 1 : m + 1 + run] / gamma[0]) < band).all())
    cut = min(2 * max(lag, 1), most)
    weight = [1 if k / cut <= 0.5 else 2 * (1 - k / cut) for k in range(1, cut + 1)]
    level = gamma[0] + 2 * sum(w * g for w, g in zip(weight, gamma[1:]))
    slope = 2 * sum(k * w * g for k, (w, g) in enumerate(zip(weight, gamma[1:]), 1))
    got = resampling.block_length(spark.createDataFrame(list(enumerate(x)), "pos int, value double").repartition(3)).first()
    assert (got["n"], got["lag"], got["truncation"]) == (n, lag, cut) and abs(got["length"] - (slope**2 / level**2 * n) ** (1 / 3)) < 1e-9
    assert resampling.block_length(spark.createDataFrame([(k, 1.0) for k in range(30)], "pos int, value double")).first()["length"] is None
    assert resampling.block_length(spark.createDataFrame([(1, 2.0)], "pos int, value double")).first()["length"] is None


def plain_filter(z, s0, s1, entry, stay, start):
    p, out, log = start, [], 0.0
    for v in z:
        p = (1 - p) * entry + p * stay
        if v is not None:
            a, b = ((1 - q) * math.exp(-0.5 * (v / s) ** 2) / s for q, s in ((p, s0), (1 - p, s1)))
            log += math.log(a + b)
            p = b / (a + b)
        out.append(p)
    return out, log


@pytest.mark.parametrize("size", [7, 1024])
def test_regimes_are_those_of_a_plain_recursion_whatever_the_segments(spark, size):
    own = np.random.default_rng(9)
    state, z = 0, []
    for k in range(400):
        state = int(own.random() < (0.9 if state else 0.05))
        z.append(None if k % 41 == 0 else float(own.normal() * (3.0 if state else 0.7)))
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(z)] + [("b", k, v) for k, v in enumerate(z[:50])], "series string, t int, z double").repartition(3)
    parameters = spark.createDataFrame([(s, 0.7, 3.0, 0.05, 0.9) for s in "ab"], "series string, sigma_calm double, sigma_stress double, entry double, stay double")
    got = regimes.filtered(Tables(spark), rows, parameters, size).collect()
    for name, values in (("a", z), ("b", z[:50])):
        want, _ = plain_filter(values, 0.7, 3.0, 0.05, 0.9, 0.05 / 0.15)
        mine = sorted((r["t"], r["stress"], r["smoothed"]) for r in got if r["series"] == name)
        assert len(mine) == len(values) and max(abs(m[1] - w) for m, w in zip(mine, want)) < 1e-10
        assert abs(mine[-1][2] - mine[-1][1]) < 1e-12 and all(0 <= m[2] <= 1 for m in mine)
    fitted = {r["series"]: r for r in regimes.fit(Tables(spark), rows, rounds=6, size=size).collect()}
    trace = fitted["a"]["trace"]
    assert len(trace) == 6 and all(b >= a - 1e-9 for a, b in zip(trace, trace[1:])) and not fitted["a"]["degenerate"] and fitted["b"]["degenerate"]
    known = [v for v in z if v is not None]
    rms = math.sqrt(sum(v * v for v in known) / len(known))
    assert abs(trace[0] - plain_filter(z, 0.6 * rms, 1.8 * rms, 0.05, 0.9, 0.05 / 0.15)[1]) < 1e-8
    assert 0.5 < fitted["a"]["sigma_calm"] < 1.0 and 2.0 < fitted["a"]["sigma_stress"] < 4.0


def test_a_journal_keeps_records_once_refuses_changes_and_finds_what_is_broken(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(journal, "PART", 7)
    path = str(tmp_path / "journal")
    frame = lambda rows: spark.createDataFrame(rows, "key string, payload string").repartition(3)
    first = [(f"k{i:02d}", None if i == 4 else f"v{i}") for i in range(20)]
    assert journal.append(path, frame(first + first[:3])) == 20
    assert journal.append(path, frame(first)) == 0  # a replay
    assert journal.append(path, frame(first[5:] + [("new", "x"), ("é", "")])) == 2
    for bad, what in (([("k01", "other")], "another payload"), ([("a", "1"), ("a", "2")], "another payload"), ([("k04", "")], "another payload"), ([(None, "1")], "no key")):
        with pytest.raises(Exception, match=what):
            journal.append(path, frame(bad))
    kept = journal.entries(spark, path).collect()
    assert len(kept) == 22 and {r["key"]: r["payload"] for r in kept} == dict(first) | {"new": "x", "é": ""}
    head = journal.EMPTY
    for top in sorted(journal.heads(spark, path).collect(), key=lambda r: r["batch"]):
        ends = []
        for part in range(top["parts"]):
            own = sorted((r["key"], r["digest"], r["link"]) for r in kept if r["batch"] == top["batch"] and r["part"] == part)
            links = journal.chained(hashlib.sha256(f"{head}:{part}".encode()).hexdigest(), [d for _, d, _ in own])
            assert links == [x for _, _, x in own]
            ends += links[-1:]
        head = hashlib.sha256((head + "".join(ends)).encode()).hexdigest()
        assert head == top["head"]
    assert journal.broken(spark, path).count() == 0
    # an entry whose payload was changed in the files, and a batch that lost entries
    tampered = spark.read.schema("part long, key string, payload string, digest string, link string").parquet(f"{path}/entries/batch=0").withColumn("payload", F.when(F.col("key") == "k07", "forged").otherwise(F.col("payload"))).collect()
    spark.createDataFrame(tampered, "part long, key string, payload string, digest string, link string").write.mode("overwrite").parquet(f"{path}/entries/batch=0")
    found = {(r["batch"], r["key"], r["what"]) for r in journal.broken(spark, path).collect()}
    assert (0, "k07", "digest") in found and {w for _, _, w in found} <= {"digest", "link"} and all(b == 0 for b, _, _ in found)
    spark.createDataFrame(tampered[1:], "part long, key string, payload string, digest string, link string").write.mode("overwrite").parquet(f"{path}/entries/batch=0")
    assert (0, None, "head") in {(r["batch"], r["key"], r["what"]) for r in journal.broken(spark, path).collect()}


def test_a_stream_of_records_is_kept_once(spark, tmp_path):
    for rows in ([("a", "1"), ("b", "2")], [("b", "2"), ("c", "3")]):
        spark.createDataFrame(rows, "key string, payload string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming.source(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1)
        journal.kept_once(stream, str(tmp_path / "journal"), str(tmp_path / "checkpoint"))
    assert {r["key"] for r in journal.entries(spark, str(tmp_path / "journal")).collect()} == {"a", "b", "c"} and journal.broken(spark, str(tmp_path / "journal")).count() == 0
