"""Bounded sets of frames that cover the light, by situation.

A situation is the pair of sorted present and absent bins; its frames are
points (median_sat, median_val).  What a situation holds is bounded by its
capacity, so order-dependent decisions stream its frames, sorted, past a
couple of dozen members.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .raster import by_frame

#: Members of a situation, and the distance under which frames are the same.
CAPACITY = math.ceil(1 + 100 / 5)
SAME = 1.0 / 255.0


def _distances(points: np.ndarray) -> np.ndarray:
    d = np.abs(points[:, None, :] - points[None, :, :]).max(2)
    np.fill_diagonal(d, np.inf)
    return d


def _separation_without(points: np.ndarray) -> np.ndarray:
    """For each member, the smallest distance among all others: the smallest
    of all, except for the two members that have it."""
    d = _distances(points)
    closest = np.unravel_index(int(d.argmin()), d.shape)
    out = np.full(len(points), d[closest])
    for i in closest:
        rest = d.copy()
        rest[i, :] = rest[:, i] = np.inf
        out[i] = rest.min()
    return out


def decide(retained: list[tuple[str, tuple[float, float]]], candidate: tuple[float, float], capacity: int = CAPACITY) -> tuple[bool, str, str | None]:
    """(accept, reason, evicted path) for one more frame."""
    points = np.array([p for _, p in retained], float).reshape(-1, 2)
    if len(points) and np.abs(points - np.array(candidate)).max(1).min() < SAME:
        return False, "duplicate", None
    if len(points) < capacity:
        return True, "filled", None
    gain = _separation_without(np.vstack((np.array(candidate)[None, :], points)))
    best = int(gain.argmax())
    return (False, "no_improvement", None) if best == 0 else (True, "replaced", retained[best - 1][0])


class _Thinning:
    """Points of which one after the other goes, each with its nearest other.

    Only points whose nearest has gone look for another, so a removal costs
    about one pass over the points, and nothing holds all distances.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.alive = points, np.ones(len(points), bool)
        self.nearest, self.distance = np.full(len(points), -1), np.full(len(points), np.inf)
        for i in range(len(points)):
            self._look(i)

    def _look(self, i: int, without: int = -1) -> tuple[int, float]:
        d = np.abs(self.points - self.points[i]).max(1)
        d[~self.alive] = np.inf
        d[i] = np.inf
        if without >= 0:
            d[without] = np.inf
            return int(d.argmin()), float(d.min())
        self.nearest[i], self.distance[i] = int(d.argmin()), float(d.min())
        return self.nearest[i], self.distance[i]

    def _left_without(self, gone: int) -> float:
        """The smallest distance among the others."""
        own = self.alive.copy()
        own[gone] = False
        orphans = np.flatnonzero(own & (self.nearest == gone))
        own[orphans] = False
        found = [float(self.distance[own].min())] if own.any() else []
        return min([*found, *(self._look(int(i), gone)[1] for i in orphans)], default=np.inf)

    def drop(self) -> int:
        """Remove the first point whose absence leaves the most separation:
        one of the closest pair, or, if that changes nothing, the first."""
        left = np.flatnonzero(self.alive)
        a = int(left[self.distance[left].argmin()])
        closest = float(self.distance[a])
        pair = sorted((a, int(self.nearest[a])))
        gain = [self._left_without(i) for i in pair]
        gone = pair[int(np.argmax(gain))] if max(gain) > closest else int(left[0])
        self.alive[gone] = False
        for i in np.flatnonzero(self.alive & (self.nearest == gone)):
            self._look(int(i))
        return gone


def trim(retained: list[tuple[str, tuple[float, float]]], capacity: int = CAPACITY) -> list[str]:
    """Paths to drop until the capacity holds, most redundant first."""
    thin = _Thinning(np.array([p for _, p in retained], float).reshape(-1, 2))
    return [retained[thin.drop()][0] for _ in range(max(len(retained) - capacity, 0))]


def replay(frames: DataFrame, keys: list[str], order: str, capacity: int = CAPACITY) -> DataFrame:
    """The decision on each frame (path, sat, val), taken in order within its
    situation, each on top of the ones before.

    The frames pass sorted; a task holds a batch and one situation's members,
    however many frames the situation has."""
    names = [*keys, order, "path", "accept", "reason", "evict"]
    schema = ", ".join([*(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys), f"{order} {frames.schema[order].dataType.simpleString()}", "path string, accept boolean, reason string, evict string"])

    def run(batches):
        held: list[tuple[str, tuple[float, float]]] = []
        now = None
        for part in batches:
            rows = []
            for r in part.itertuples(index=False):
                key = tuple(getattr(r, k) for k in keys)
                if key != now:
                    now, held = key, []
                accept, reason, evict = decide(held, (r.sat, r.val), capacity)
                if accept:
                    held = [x for x in held if x[0] != evict] + [(r.path, (r.sat, r.val))]
                rows.append([*key, getattr(r, order), r.path, accept, reason, evict])
            yield pd.DataFrame(rows, columns=names).astype({c: object for c in ("path", "reason", "evict")})

    return frames.select(*keys, order, "path", "sat", "val").repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def over_capacity(frames: DataFrame, keys: list[str], order: str, capacity: int = CAPACITY) -> DataFrame:
    """Paths that each situation would drop, with their turn."""
    schema = ", ".join([*(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys), "path string, turn int"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        gone = trim(list(zip(part.path, zip(part.sat, part.val))), capacity)
        rows = [[*(part[k].iloc[0] for k in keys), path, turn] for turn, path in enumerate(gone, 1)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    return by_frame(frames.select(*keys, order, "path", "sat", "val"), keys, run, schema)


def situations(entries: DataFrame) -> DataFrame:
    """``entries`` with their situation: sorted present and absent bins."""
    return entries.withColumn("situation", F.concat_ws("|", F.concat_ws(",", F.array_sort("present")), F.concat_ws(",", F.array_sort("absent"))))


def closest(sat: np.ndarray, val: np.ndarray) -> float:
    """Smallest Chebyshev distance of two points, infinite under two: sorted
    by one light, each point is compared with the next ones, as long as some
    are nearer in it than the best pair."""
    order = np.lexsort((val, sat))
    sat, val = sat[order], val[order]
    best = np.inf
    for step in range(1, len(sat)):
        gap = sat[step:] - sat[:-step]
        near = gap < best
        if not near.any():
            break
        best = min(best, float(np.maximum(gap, np.abs(val[step:] - val[:-step]))[near].min()))
    return best


def min_separation(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Smallest distance between two frames of a group, infinite under two,
    and the group's size; a task holds one group's points."""
    schema = ", ".join([*(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys), "n long, min_separation double"])
    names = [*keys, "n", "min_separation"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        least = closest(part.sat.to_numpy(float), part.val.to_numpy(float))
        return pd.DataFrame([[*(part[k].iloc[0] for k in keys), len(part), least]], columns=names)

    return by_frame(frames.select(*keys, "sat", "val"), keys, run, schema)


def describe(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Count, separation and covered light of each situation."""
    light = frames.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in ("sat", "val") for n, f in (("min", F.min), ("max", F.max))))
    return min_separation(frames, keys, order).join(light, keys)


def reference_rects(samples: DataFrame) -> DataFrame:
    """Each bin's newest usable entry and its rectangles: by hand, not
    excluded, of the current view and appearance; the last one stored wins.

    ``samples``: bin_id, path, ord, auto, excluded, current_view,
    current_epoch and what else is to be kept.
    """
    usable = samples.where(~F.col("auto") & ~F.col("excluded") & F.col("current_view") & F.col("current_epoch"))
    newest = Window.partitionBy("bin_id").orderBy(F.col("ord").desc())
    return usable.withColumn("_r", F.rank().over(newest)).where("_r = 1").drop("_r")
