"""Section limits while a trajectory is still coming in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sections import FIELDS, GAP, HALF, MIN_S, THRESHOLD

#: Points that a piece's state holds: what one score, and those of its two neighbours, look at.
KEPT = 2 * HALF + 3
STATE = "seen long, last long, last_time double, times array<double>, " + ", ".join(f"{f} array<double>, {f}_lo double, {f}_hi double" for f in FIELDS)


class Live:
    """The limits of one piece, point by point. A limit is known a few points after its place.

    Scores are those of `sections.change_score`, over the ranges seen so far instead of those of the whole piece; maxima are accepted GAP
    points and MIN_S seconds apart. The state is a handful of points, whatever the length of the piece.
    """

    def __init__(self, state: tuple | None = None):
        self.seen, self.last, self.last_time = 0, -1000, 0.0
        self.times: list[float] = []
        self.values = {f: [] for f in FIELDS}
        self.lo, self.hi = dict.fromkeys(FIELDS, np.inf), dict.fromkeys(FIELDS, -np.inf)
        if state is not None:
            self.seen, self.last, self.last_time, times, *rest = state
            self.times = list(times)
            for i, f in enumerate(FIELDS):
                values, self.lo[f], self.hi[f] = rest[3 * i : 3 * i + 3]
                self.values[f] = list(values)

    def state(self) -> tuple:
        return (self.seen, self.last, self.last_time, self.times, *[x for f in FIELDS for x in (self.values[f], float(self.lo[f]), float(self.hi[f]))])

    def _score(self, at: int) -> float:
        total = 0.0
        for f in FIELDS:
            v, span = self.values[f], self.hi[f] - self.lo[f]
            total += abs(np.mean(v[at : at + HALF]) - np.mean(v[at - HALF : at])) / (span or 1.0)
        return total / len(FIELDS)

    def add(self, time: float, values: dict[str, float]) -> float | None:
        """The time of a limit if this point settles one."""
        self.times.append(time)
        for f in FIELDS:
            self.values[f].append(values[f])
            self.lo[f], self.hi[f] = min(self.lo[f], values[f]), max(self.hi[f], values[f])
        self.seen += 1
        found = None
        if len(self.times) == KEPT:
            before, own, after = (self._score(i) for i in (HALF, HALF + 1, HALF + 2))
            place, at = self.seen - KEPT + HALF + 1, self.times[HALF + 1]
            if own >= THRESHOLD and own >= before and own >= after and place - self.last >= GAP and at - self.last_time >= MIN_S:
                self.last, self.last_time, found = place, at, at
            self.times = self.times[1:]
            self.values = {f: v[1:] for f, v in self.values.items()}
        return found


def limits(points: DataFrame, key: str = "filename") -> DataFrame:
    """(key, t): section limits of a stream of points(key, time, energy, brightness, roughness, tension).

    Points of a piece are expected in the order of their times from batch to batch; within a batch they are sorted.
    """
    kind = points.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = Live(state.get if state.exists else None)
        rows = pd.concat(list(frames)).sort_values("time")
        found = [t for r in rows.itertuples(index=False) if (t := live.add(float(r.time), {f: float(getattr(r, f)) for f in FIELDS})) is not None]
        state.update(live.state())
        yield pd.DataFrame({key: [k[0]] * len(found), "t": found})

    own = points.select(key, "time", *FIELDS)
    return own.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t double", STATE, "append", GroupStateTimeout.NoTimeout)
