"""A two-state chain of scales, calm and stressed: filtered and smoothed probabilities and their fit, as scans by segments.

A row's step is a 2 x 2 matrix: transitions times what each state's normal law says of the residual (ones where it is missing).
Segments of SEGMENT rows are multiplied on their own, the products carry the state's law from segment to segment in both directions,
and each segment is then passed through from its own two ends. So no task holds a series, only a segment or its series' products;
many series are done at once. A round of expectation maximisation is one such scan and a sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import Tables

SEGMENT = 1024
#: Starting scales over the residuals' root mean square, entry and stay probabilities, and the bounds of all.
SIGMAS, ENTRY, STAY = (0.6, 1.8), 0.05, 0.90
LEAST_SIGMA, LEAST_P = 1e-3, 1e-3
#: A stressed scale below this multiple of the calm one is no second state.
LEAST_RATIO = 1.05
PARAMETERS = ["sigma_calm", "sigma_stress", "entry", "stay"]
PRODUCT = "series string, segment long, m00 double, m01 double, m10 double, m11 double, log double"
SUMS = ["calm", "stress", "calm_squares", "stress_squares", "from_calm", "entered", "from_stress", "stayed"]


def stationary(entry: Column, stay: Column) -> Column:
    return entry / (entry + 1 - stay)


def starting(rows: DataFrame) -> DataFrame:
    """series and the parameters that a fit starts from."""
    rms = F.sqrt(F.avg(F.col("z") * F.col("z")))
    sigma = [F.greatest(F.lit(LEAST_SIGMA), s * F.coalesce(rms, F.lit(1.0))) for s in SIGMAS]
    return rows.groupBy("series").agg(sigma[0].alias("sigma_calm"), sigma[1].alias("sigma_stress"), F.lit(ENTRY).alias("entry"), F.lit(STAY).alias("stay"))


def segmented(tables: Tables, rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """rows (series, t, z) with segment, written: ranks within a series by t, so many to a segment."""
    rank = F.row_number().over(Window.partitionBy("series").orderBy("t")) - 1
    return tables.keep(rows.select("series", "t", F.col("z").cast("double").alias("z"), F.floor(rank / size).alias("segment")), "segments")


def _first(rows: pa.Table, name: str) -> float:
    return rows.column(name)[0].as_py()


def _steps(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The matrices of a segment's rows in order, each over a factor, and the logarithms of these factors."""
    z = rows.column("z").to_numpy(zero_copy_only=False).astype(float)
    sigma = np.array([_first(rows, "sigma_calm"), _first(rows, "sigma_stress")])
    entry, stay = _first(rows, "entry"), _first(rows, "stay")
    log = -0.5 * (z[:, None] / sigma) ** 2 - np.log(sigma)
    log[np.isnan(z)] = 0
    top = log.max(1)
    moves = np.array([[1 - entry, entry], [1 - stay, stay]])
    return moves[None] * np.exp(log - top[:, None])[:, None, :], top


def _product(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("t")
    steps, tops = _steps(rows)
    whole, log = np.eye(2), float(tops.sum())
    for step in steps:
        whole = whole @ step
        size = whole.sum()
        whole /= size
        log += float(np.log(size))
    return pa.table({"series": rows.column("series")[:1], "segment": rows.column("segment")[:1], **{f"m{i}{j}": [whole[i, j]] for i in (0, 1) for j in (0, 1)}, "log": [log]})


def _ends(rows: pa.Table) -> pa.Table:
    """Of one series, each segment's law before its first row and weights after its last; the series' likelihood stands with all."""
    rows = rows.sort_by("segment")
    products = np.stack([rows.column(f"m{i}{j}").to_numpy() for i in (0, 1) for j in (0, 1)], 1).reshape(-1, 2, 2)
    start = _first(rows, "start")
    law, likelihood = np.array([1 - start, start]), float(np.sum(rows.column("log").to_numpy()))
    before, after = np.empty((len(products), 2)), np.empty((len(products), 2))
    for k, p in enumerate(products):
        before[k] = law
        law = law @ p
        likelihood += float(np.log(law.sum()))
        law = law / law.sum()
    weights = np.ones(2)
    for k in range(len(products) - 1, -1, -1):
        after[k] = weights
        weights = products[k] @ weights
        weights = weights / weights.sum()
    return pa.table({"series": rows.column("series"), "segment": rows.column("segment"), "a0": before[:, 0], "a1": before[:, 1], "b0": after[:, 0], "b1": after[:, 1], "likelihood": np.full(len(products), likelihood)})


def _passed(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The segment in order, its filtered laws, and the joint laws of the states before and after each row given all rows."""
    rows = rows.sort_by("t")
    steps, _ = _steps(rows)
    law, weights = np.array([_first(rows, "a0"), _first(rows, "a1")]), np.array([_first(rows, "b0"), _first(rows, "b1")])
    before, filtered, later = np.empty((len(steps), 2)), np.empty((len(steps), 2)), np.empty((len(steps), 2))
    for k, step in enumerate(steps):
        before[k] = law
        law = law @ step
        law = law / law.sum()
        filtered[k] = law
    for k in range(len(steps) - 1, -1, -1):
        later[k] = weights
        weights = steps[k] @ weights
        weights = weights / weights.sum()
    joint = before[:, :, None] * steps * later[:, None, :]
    return rows, filtered, joint / joint.sum((1, 2), keepdims=True)


def _sums(rows: pa.Table) -> pa.Table:
    rows, _, joint = _passed(rows)
    z = rows.column("z").to_numpy(zero_copy_only=False).astype(float)
    known, after = ~np.isnan(z), joint.sum(1)
    calm, stress = after[known, 0], after[known, 1]
    squares = z[known] ** 2
    values = [calm.sum(), stress.sum(), calm @ squares, stress @ squares, joint[:, 0].sum(), joint[:, 0, 1].sum(), joint[:, 1].sum(), joint[:, 1, 1].sum()]
    return pa.table({"series": rows.column("series")[:1], "likelihood": [_first(rows, "likelihood")], **{k: [float(v)] for k, v in zip(SUMS, values)}})


def _probabilities(rows: pa.Table) -> pa.Table:
    rows, filtered, joint = _passed(rows)
    return rows.select(["series", "t", "z"]).append_column("stress", pa.array(filtered[:, 1])).append_column("smoothed", pa.array(joint.sum(1)[:, 1]))


def _scanned(segments: DataFrame, parameters: DataFrame) -> DataFrame:
    """segments with the parameters and both ends of theirs."""
    known = segments.join(parameters, "series")
    products = known.groupBy("series", "segment").applyInArrow(_product, PRODUCT).join(parameters.select("series", "start"), "series")
    ends = products.groupBy("series").applyInArrow(_ends, "series string, segment long, a0 double, a1 double, b0 double, b1 double, likelihood double")
    return known.join(ends, ["series", "segment"])


def filtered(tables: Tables, rows: DataFrame, parameters: DataFrame, size: int = SEGMENT) -> DataFrame:
    """series, t, z, stress (given the rows up to t) and smoothed (given all): probabilities of the stressed state.

    rows: series, t and z, null where there is no residual; parameters: series and PARAMETERS. Series start from their stationary law.
    """
    known = parameters.select("series", *PARAMETERS, stationary(F.col("entry"), F.col("stay")).alias("start"))
    kind = rows.schema["t"].dataType.simpleString()
    scanned = _scanned(segmented(tables, rows, size), known)
    return scanned.groupBy("series", "segment").applyInArrow(_probabilities, f"series string, t {kind}, z double, stress double, smoothed double")


def fit(tables: Tables, rows: DataFrame, rounds: int = 60, tolerance: float = 1e-6, least: int = 120, size: int = SEGMENT) -> DataFrame:
    """series, PARAMETERS, likelihood (of the last round's start), rounds, trace (the likelihood of every round) and degenerate.

    The law before the first row is held at the starting parameters' stationary one, so no round lowers the likelihood but by the bounds.
    A series of fewer than ``least`` residuals, or without a second scale, is degenerate.
    """
    segments = segmented(tables, rows, size)
    own = starting(segments).withColumn("start", stationary(F.col("entry"), F.col("stay")))
    found = own.withColumns({"trace": F.array().cast("array<double>"), "done": F.lit(False)})
    found = tables.keep(found, "regimes-0")
    schema = "series string, likelihood double, " + ", ".join(f"{k} double" for k in SUMS)
    bounded = lambda p: F.least(F.greatest(p, F.lit(LEAST_P)), F.lit(1 - LEAST_P))
    for turn in range(1, rounds + 1):
        active = found.filter("NOT done")
        if active.isEmpty():
            break
        scanned = _scanned(segments, active.select("series", *PARAMETERS, "start"))
        sums = scanned.groupBy("series", "segment").applyInArrow(_sums, schema).groupBy("series").agg(F.first("likelihood").alias("likelihood"), *(F.sum(k).alias(k) for k in SUMS))
        new = {
            "sigma_calm": F.greatest(F.lit(LEAST_SIGMA), F.sqrt(F.try_divide("calm_squares", "calm"))),
            "sigma_stress": F.greatest(F.lit(LEAST_SIGMA), F.sqrt(F.try_divide("stress_squares", "stress"))),
            "entry": bounded(F.try_divide("entered", "from_calm")),
            "stay": bounded(F.try_divide("stayed", "from_stress")),
        }
        joined = found.join(sums, "series", "left")
        gained = F.col("likelihood") - F.element_at("trace", -1)
        still = F.col("likelihood").isNotNull() & ~F.col("done")
        step = joined.select(
            "series", "start", *(F.when(still, F.coalesce(c, k)).otherwise(F.col(k)).alias(k) for k, c in new.items()),
            F.when(still, F.concat("trace", F.array("likelihood"))).otherwise(F.col("trace")).alias("trace"),
            F.when(still & (F.size("trace") > 0), gained < tolerance).otherwise(F.col("done") | F.col("likelihood").isNull()).alias("done"),
        )
        found = tables.keep(step, f"regimes-{turn}")
        tables.drop(f"regimes-{turn - 1}")
    counts = segments.groupBy("series").agg(F.count("z").alias("n"))
    single = (F.col("n") < least) | (F.col("sigma_stress") < LEAST_RATIO * F.col("sigma_calm"))
    return found.join(counts, "series").select("series", *PARAMETERS, F.element_at("trace", -1).alias("likelihood"), F.size("trace").alias("rounds"), "trace", single.alias("degenerate"))
