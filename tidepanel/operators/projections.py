"""Columns of single rows: indicators, day kinds, curves, hazards and operations on quantile arrays. All are null where an input is, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict(value: Column, *inputs: Column) -> Column:
    """value where no input is null; greatest, least and or pass over nulls by themselves."""
    known = F.lit(True)
    for c in inputs:
        known = known & c.isNotNull()
    return F.when(known, value)


def depleted(buffer: Column, floor: float) -> Column:
    return F.when(buffer.isNull(), None).otherwise((buffer < floor).cast("double"))


def when_depleted(level: Column, buffer: Column, floor: float) -> Column:
    return level * depleted(buffer, floor)


def settlement_day(quarter_end: Column, tax_date: Column, days_to_month_end: Column, coupons: Column, last_days: int = 1) -> Column:
    """1 on a quarter-end, tax date, one of the last days of a month or a coupon settlement."""
    flagged = (quarter_end == 1) | (tax_date == 1) | (days_to_month_end <= last_days) | (coupons > 0)
    return strict(flagged.cast("double"), quarter_end, tax_date, days_to_month_end, coupons)


def split_day_type(quarter_end: Column, days_to_month_end: Column, tax_date: Column, window: int = 1) -> Column:
    kind = F.when(quarter_end == 1, "quarter_end").when(days_to_month_end <= window, "month_end").when(tax_date == 1, "tax_date").otherwise("ordinary")
    return strict(kind, quarter_end, days_to_month_end, tax_date)


def scheduled_risk(quarter_end: Column, tax_date: Column, coupons: Column) -> Column:
    """Never null: what is unknown is no risk."""
    zero = F.lit(0.0)
    return (F.coalesce(quarter_end, zero) == 1) | (F.coalesce(tax_date, zero) == 1) | (F.coalesce(coupons, zero) > 0)


def elasticity(ratio: Column, satiation: float = 0.12, length: float = 0.02, kinked: bool = False) -> Column:
    """Slope of the demand curve: 1 at satiation, falling above it, or flat above it if kinked."""
    return strict(F.exp(F.greatest(F.lit(0.0), satiation - ratio) / length), ratio) if kinked else F.exp((satiation - ratio) / length)


def shortfall(net: Column, buffer: Column) -> Column:
    return strict(F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), net) - buffer), net, buffer)


def reserve_change(flow: Column, buffer: Column) -> Column:
    """A drain is absorbed by the buffer first, a paydown raises reserves."""
    return strict(F.least(F.greatest(flow, F.lit(0.0)), F.greatest(buffer, F.lit(0.0))) - flow, flow, buffer)


def technical(change_bps: Column) -> Column:
    return F.pmod(F.bround(change_bps, 0), F.lit(25)) != 0


def in_bucket(value: Column, low: float | None, high: float | None) -> Column:
    """low <= value <= high, an end that is None is open; of two buckets that meet, the first has the end."""
    ok = value.isNotNull()
    if low is not None:
        ok = ok & (value >= low)
    return ok if high is None else ok & (value <= high)


def bucket_label(value: Column, buckets: list[tuple[str, float | None, float | None]]) -> Column:
    label = F.lit(None).cast("string")
    for name, low, high in reversed(buckets):
        label = F.when(in_bucket(value, low, high), name).otherwise(label)
    return label


def clipped(p: Column, epsilon: float = 1e-6) -> Column:
    return strict(F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon)), p)


def logit(p: Column) -> Column:
    return F.log(clipped(p) / (1 - clipped(p)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def survival(hazards: Column) -> Column:
    """Running products of 1 - hazard. A product, as the sum of logarithms fails where a hazard is 1."""
    start = F.array().cast("array<double>")
    return F.aggregate(hazards, start, lambda s, h: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(1.0)) * (1 - h))))


def first_passage(hazards: Column) -> Column:
    """hazard times the survival up to the step before."""
    before = F.concat(F.array(F.lit(1.0)), survival(hazards))
    return F.zip_with(hazards, F.slice(before, 1, F.size(hazards)), lambda h, s: h * s)


def capped(q: Column, line: Column, margin: float = 0.0) -> Column:
    return F.when(line.isNull(), q).otherwise(F.transform(q, lambda x: F.least(x, line + margin)))


def blended(a: Column, b: Column, weight: float) -> Column:
    return F.zip_with(a, b, lambda x, y: weight * x + (1 - weight) * y)


def corrected(q: Column, shift: Column) -> Column:
    """Each level moved, then sorted so that none cross."""
    return F.array_sort(F.zip_with(q, shift, lambda x, s: x + s))


def shrunk(raw: Column, n: Column, k: float) -> Column:
    return 1 + n / (n + k) * (raw - 1)


def conformal_quantile(values: Column, level: float) -> Column:
    """The ceil(level * (n + 1))-th smallest of an array, within its ends."""
    n = F.size(values)
    place = F.least(F.greatest(F.ceil(level * (n + 1)), F.lit(1)), n).cast("int")
    return F.when(n > 0, F.element_at(F.array_sort(values), place))
