"""Piecewise linear laws of quantile arrays: distribution function, exceedance, PIT intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import GRID

#: Ties between knots are parted by so many bp a level.
NUDGE = 1e-6


def knots(q: Column) -> Column:
    """The places of levels 0, GRID and 1: quantiles nudged apart, the outer slopes carried on to both ends."""
    inner = F.transform(q, lambda x, i: x + NUDGE * i)
    n = len(GRID)
    low = (F.element_at(inner, 2) - F.element_at(inner, 1)) / (GRID[1] - GRID[0])
    high = (F.element_at(inner, n) - F.element_at(inner, n - 1)) / (GRID[-1] - GRID[-2])
    return F.concat(F.array(F.element_at(inner, 1) - GRID[0] * low), inner, F.array(F.element_at(inner, n) + (1 - GRID[-1]) * high))


def cdf(q: Column, x: Column | float) -> Column:
    """F(x) of the law of a quantile array."""
    x = x if isinstance(x, Column) else F.lit(x)
    edges, levels = knots(q), F.array(*map(F.lit, [0.0, *GRID, 1.0]))
    below = F.size(F.filter(edges, lambda e: e < x))
    a, b = F.try_element_at(edges, F.greatest(below, F.lit(1))), F.try_element_at(edges, below + 1)
    p, r = F.try_element_at(levels, F.greatest(below, F.lit(1))), F.try_element_at(levels, below + 1)
    return F.when(q.isNull() | x.isNull(), None).when(below == 0, 0.0).when(below == len(GRID) + 2, 1.0).otherwise(p + (x - a) / (b - a) * (r - p))


def exceedance(q: Column, tau: float) -> Column:
    """Probability of more than tau whole bp."""
    return 1 - cdf(q, math.floor(tau) + 0.5)


def pit_interval(q: Column, outcome: Column) -> tuple[Column, Column]:
    """F half a bp below and above the outcome in whole bp."""
    k = F.bround(outcome, 0)
    return cdf(q, k - 0.5), cdf(q, k + 0.5)
