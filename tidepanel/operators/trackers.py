"""Online conformal bands: an ordered state for every series, folded the same way in a batch and in a stream.

A band's half width over the law's outer quantiles is a tracker that rises after misses and falls after hits, an integrator of
all misses so far, and a scorecaster, a least squares forecast of the score from calendar flags. A band uses only labels of
days up to its anchor: later ones wait in the state. The state of a series is a few dozen numbers, the last scores and
the days whose labels are not yet public.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.tables import importable

#: Scores whose range is the step's scale, and the least scale.
WINDOW, LEAST_SCALE = 100, 1.0
#: The integrator's tangent is taken within this.
LIMIT = 1.5
#: Labels with and without a flag before the scorecaster reads it.
FLAGGED = 5
OUT = "series string, day date, observed long, width double, scorecast double, saturated boolean, lower double, upper double"


@dataclass(frozen=True)
class Gains:
    """Step of the tracker, gain and saturation of the integrator, labels before the scorecaster starts (None: never), and the wanted share of misses."""

    step: float = 0.05
    gain: float = 0.1
    saturation: float = 1.0
    scorecast_from: int | None = 20
    miss: float = 0.1


class Tracker:
    """The state of one series."""

    def __init__(self, gains: Gains, flags: int, kept: dict | None = None):
        self.gains = gains
        size = flags + 1
        kept = kept or {"tracker": 0.0, "errors": 0.0, "n": 0, "scores": [], "gram": np.zeros((size, size)).tolist(), "moment": [0.0] * size, "waiting": [], "last": None}
        self.__dict__.update(kept)
        self.gram, self.moment = np.array(self.gram), np.array(self.moment)

    def kept(self) -> dict:
        names = ("tracker", "errors", "n", "scores", "waiting", "last")
        return {k: getattr(self, k) for k in names} | {"gram": self.gram.tolist(), "moment": self.moment.tolist()}

    def scale(self) -> float:
        return max(LEAST_SCALE, max(self.scores) - min(self.scores)) if self.scores else LEAST_SCALE

    def integrator(self) -> tuple[float, bool]:
        n = self.n
        angle = self.errors * math.log(n + 1) / (self.gains.saturation * (n + 1))
        return self.gains.gain * self.scale() * math.tan(min(LIMIT, max(-LIMIT, angle))), abs(angle) > LIMIT

    def scorecast(self, flags: list[float]) -> float:
        """The forecast score: flags of too few labels are left out, then the last ones until the system has one solution."""
        if self.gains.scorecast_from is None or self.n < self.gains.scorecast_from:
            return 0.0
        seen = self.gram[0]  # labels of each flag, as flags are 0 or 1
        active = [0] + [k for k in range(1, len(seen)) if FLAGGED <= seen[k] <= self.n - FLAGGED]
        while np.linalg.matrix_rank(self.gram[np.ix_(active, active)]) < len(active):
            active.pop()
        fit = np.linalg.solve(self.gram[np.ix_(active, active)], self.moment[active])
        return float(fit @ np.array([1.0, *flags])[active])

    def learn(self, row: list[float], score: float, missed: bool) -> None:
        error = float(missed) - self.gains.miss
        self.tracker += self.gains.step * self.scale() * error
        self.errors += error
        self.n += 1
        self.scores = [*self.scores[1 - WINDOW :], score]
        x = np.array(row)
        self.gram += np.outer(x, x)
        self.moment += score * x

    def issue(self, day: str, anchor: str, low: float, high: float, flags: list[float], actual: float | None) -> tuple:
        """The day's band, after the labels up to its anchor have been learned; its own label waits."""
        if anchor >= day:
            raise ValueError(f"the label of {day} would be known before its band: its anchor is {anchor}")
        if self.last is not None and (day <= self.last[0] or anchor < self.last[1]):
            raise ValueError(f"{day} (anchor {anchor}) comes after {self.last[0]} (anchor {self.last[1]})")
        self.last = [day, anchor]
        ready = 0
        while ready < len(self.waiting) and self.waiting[ready][0] <= anchor:
            _, row, score, missed = self.waiting[ready]
            self.learn(row, score, missed)
            ready += 1
        self.waiting = self.waiting[ready:]
        part, saturated = self.integrator() if self.n else (0.0, False)
        cast = self.scorecast(flags)
        width = self.tracker + part + cast
        lower, upper = low - width, high + width
        if lower > upper:  # a band that has shrunk past itself is its middle
            lower = upper = (lower + upper) / 2
        if actual is not None:
            self.waiting = [*self.waiting, [day, [1.0, *flags], max(low - actual, actual - high), not lower <= actual <= upper]]
        return self.n, width, cast, saturated, lower, upper


def _issued(tracker: Tracker, series: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for day, anchor, low, high, flags, actual in sorted(zip(rows["day"], rows["anchor"], rows["low"], rows["high"], rows["flags"], rows["actual"]), key=lambda r: r[0]):
        known = None if actual is None or math.isnan(actual) else float(actual)
        out.append((series, day, *tracker.issue(str(day), str(anchor), float(low), float(high), [float(f) for f in flags], known)))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def bands(forecasts: DataFrame, gains: Gains = Gains(), flags: int = 0) -> DataFrame:
    """series, day, observed, width, scorecast, saturated, lower and upper of every forecast (series, day, anchor, low, high, flags, actual).

    low and high are the law's outer quantiles, flags (0 or 1) the day's calendar, actual its label, null if there is none; anchor is the
    latest day whose label the forecast could read. A series has one row a day. Days out of order and anchors not before their days are errors.
    """
    importable(forecasts.sparkSession)

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _issued(Tracker(gains, flags), key[0], rows)

    return forecasts.groupBy("series").applyInPandas(fold, OUT)


def bands_of_stream(forecasts: DataFrame, gains: Gains = Gains(), flags: int = 0) -> DataFrame:
    """bands() of a stream in append mode: each batch goes on from the state of its series. Days must arrive in order, a batch's own in any."""
    importable(forecasts.sparkSession)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(gains, flags, json.loads(state.get[0]) if state.exists else None)
        found = _issued(tracker, key[0], pd.concat(list(batches)))
        state.update((json.dumps(tracker.kept()),))
        yield found

    return forecasts.groupBy("series").applyInPandasWithState(fold, OUT, "kept string", "append", GroupStateTimeout.NoTimeout)
