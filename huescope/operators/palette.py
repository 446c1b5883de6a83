"""Colour bands learned from weighted histograms of colours.

Frames are 8-bit, so a bin's marked pixels fall on a bounded number of
distinct colours however many there are.  A :class:`Palette` holds each of
them once, with its mass (every image has one vote) and the weights of its
first and last pixel in image order.  That is all a weighted percentile with
midpoints, a circular mean or a mixture's likelihood needs: the same answers
as over the pixels themselves, from a relation that the cluster aggregates.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import QUANTUM, log_bessel_i0

#: Percentiles of the band and of the floors, the share of another colour that is warned of.
BAND_Q, FLOOR_Q, JUNK_WARN = 95.0, 5.0, 0.05
STEP = 60.0 * QUANTUM  # degrees of hue that one 8-bit step makes at full chroma
COLOURS = ("hue", "sat", "val")


class CalibrationError(ValueError):
    """The marked pixels do not define a colour."""


def palettes(pixels: DataFrame) -> DataFrame:
    """Marked pixels (bin_id, image_id, hue, sat, val) as one row for each bin
    and colour: n, mass, and image and weight of its first and last pixel.

    A pixel weighs 1 / its image's number of pixels in the bin.  Two
    aggregations, both with map-side parts: by image, and over images.
    """
    by_image = pixels.groupBy("bin_id", "image_id", *COLOURS).agg(F.count("*").alias("k"))
    weight = 1.0 / F.sum("k").over(Window.partitionBy("bin_id", "image_id"))
    weighed = by_image.withColumn("w", weight)
    return weighed.groupBy("bin_id", *COLOURS).agg(
        F.sum("k").alias("n"), F.sum(F.col("k") * F.col("w")).alias("mass"), F.min("image_id").alias("first"), F.min_by("w", "image_id").alias("w_first"),
        F.max("image_id").alias("last"), F.max_by("w", "image_id").alias("w_last"))


@dataclass
class Palette:
    """Distinct colours of one bin; hue is NaN where it is undefined."""

    hue: np.ndarray
    sat: np.ndarray
    val: np.ndarray
    n: np.ndarray
    mass: np.ndarray
    first: np.ndarray
    w_first: np.ndarray
    last: np.ndarray
    w_last: np.ndarray

    @classmethod
    def of_rows(cls, rows) -> "Palette":
        """From rows of :func:`palettes` (a pandas frame)."""
        rows = rows.sort_values(list(COLOURS), kind="stable")
        exact = {"n": np.int64, "first": np.int64, "last": np.int64}
        return cls(**{c: rows[c].to_numpy(exact.get(c, float)) for c in cls.__dataclass_fields__})

    @classmethod
    def of_pixels(cls, hue, sat, val, weights=None) -> "Palette":
        """Each pixel a row of its own, in the order given."""
        hue, sat, val = (np.asarray(x, float) for x in (hue, sat, val))
        place = np.arange(len(hue))
        w = np.ones(len(hue)) if weights is None else np.asarray(weights, float)
        return cls(hue, sat, val, np.ones(len(hue), np.int64), w, place, w, place, w)

    def take(self, keep: np.ndarray) -> "Palette":
        return replace(self, **{c: getattr(self, c)[keep] for c in self.__dataclass_fields__})

    def share(self, part: np.ndarray) -> float:
        return float(self.mass[part].sum() / self.mass.sum())

    def percentile(self, values: np.ndarray, q: float) -> float:
        """Linear between the midpoints of the pixels' running weight.

        Pixels of one value lie together, so only the outermost two of each
        value are corners of the line.
        """
        distinct, at = np.unique(values, return_inverse=True)
        mass = np.bincount(at, self.mass, len(distinct))
        ahead = np.lexsort((self.first, at))
        behind = np.lexsort((self.last, at))
        starts = np.searchsorted(at[ahead], np.arange(len(distinct)))
        stops = np.append(starts[1:], len(at)) - 1
        upto = np.cumsum(mass)
        corners = np.column_stack((upto - mass + self.w_first[ahead[starts]] / 2, upto - self.w_last[behind[stops]] / 2))
        return float(np.interp(q / 100.0 * upto[-1], corners.ravel(), np.repeat(distinct, 2)))

    def direction(self) -> complex:
        """Mean of the unit vectors of the hues; its length is the resultant."""
        if not len(self.hue) or self.mass.sum() <= 0:
            raise CalibrationError("no defined hue with weight")
        return complex((self.mass * np.exp(1j * np.radians(self.hue))).sum() / self.mass.sum())


def degrees(direction: complex) -> float:
    """Angle of a mean direction in [0, 360)."""
    return float(np.degrees(np.angle(direction)) % 360.0) % 360.0


def apart(hue: np.ndarray, centre: float) -> np.ndarray:
    """Degrees along the shorter arc."""
    turn = np.abs(hue - centre) % 360.0
    return np.minimum(turn, 360.0 - turn)


def concentration(resultant: float) -> float:
    """Von Mises concentration for a mean resultant length."""
    if resultant >= 1:
        return np.inf
    return max(resultant, 0.0) * (2 - resultant**2) / (1 - resultant**2)


@dataclass
class Mixture:
    """A von Mises bump over a uniform rest."""

    centre: float
    kappa: float
    weight: float
    likelihood: float = -np.inf
    belongs: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rounds: int = 0


class BumpFit:
    """Expectation maximisation over the distinct hues of a palette.

    The odds of the bump against the rest are ``weight / (1 - weight) *
    exp(kappa cos) / I0(kappa)``; everything else follows from them.
    """

    def __init__(self, palette: Palette, kappa_max: float):
        self.hues, self.at = np.unique(palette.hue, return_inverse=True)
        self.mass = np.bincount(self.at, palette.mass)
        self.unit = np.exp(1j * np.radians(self.hues))
        self.pixels, self.kappa_max = int(palette.n.sum()), kappa_max
        # no less than one pixel's share may be the rest's, or the bump's
        self.least = float(min(palette.w_first.min(), palette.w_last.min()) / palette.mass.sum())

    def _bounded(self, m: Mixture) -> Mixture:
        return replace(m, weight=float(np.clip(m.weight, self.least, 1 - self.least)), kappa=float(np.clip(m.kappa, 0.0, self.kappa_max)))

    def judged(self, m: Mixture) -> Mixture:
        """The state with its likelihood and each hue's share of the bump."""
        towards = np.exp(1j * np.radians(m.centre))
        odds = m.weight / (1 - m.weight) * np.exp(m.kappa * (self.unit * np.conj(towards)).real - log_bessel_i0(m.kappa))
        likelihood = float((self.mass * np.log1p(odds)).sum() + self.mass.sum() * np.log((1 - m.weight) / (2 * np.pi)))
        return replace(m, likelihood=likelihood, belongs=odds / (1 + odds))

    def moved(self, m: Mixture) -> Mixture | None:
        """Where the hues pull the bump; nowhere if none belongs to it."""
        pull = self.mass * m.belongs
        if pull.sum() <= 0:
            return None
        mean = complex((pull * self.unit).sum() / pull.sum())
        return self._bounded(Mixture(degrees(mean), concentration(abs(mean)), float(pull.sum() / self.mass.sum())))

    def _climb(self, start: Mixture) -> Iterator[Mixture]:
        """States as they follow each other, one round a pixel at most, until
        the gain is within rounding."""
        state, before = self._bounded(start), -np.inf
        for rounds in itertools.takewhile(lambda _: state is not None, range(1, self.pixels + 1)):
            state = replace(self.judged(state), rounds=rounds)
            yield state
            if state.likelihood - before <= max(abs(state.likelihood), 1.0) * np.finfo(float).eps * self.pixels:
                return
            before, state = state.likelihood, self.moved(state)

    def from_start(self, start: Mixture) -> Mixture:
        """The likeliest state on the way."""
        if self.pixels == 1:
            return Mixture(float(self.hues[0]), self.kappa_max, 1.0, 0.0, np.ones(1))
        return max(self._climb(start), key=lambda m: m.likelihood)

    def around(self, palette: Palette, centre: float) -> Mixture:
        """Fit from the half circle about a centre: its excess over an even
        half is the bump's weight, its resultant the concentration."""
        half = apart(palette.hue, centre) < 90
        spread = abs(palette.take(half).direction()) if palette.mass[half].sum() > 0 else 0.0
        return self.from_start(Mixture(centre, concentration(spread), 2 * palette.share(half) - 1))


@dataclass
class ColorModel:
    """A learned colour band with its statistics and warnings."""

    hue: float
    tol: float
    sat_min: float
    val_min: float
    stats: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def fullest_hue(palette: Palette) -> float:
    """Centre of the first fullest hue bin, one 8-bit step at the median
    chroma wide."""
    chroma = palette.percentile(palette.sat * palette.val, 50.0)
    bins = max(int(np.ceil(360.0 * chroma / STEP)), 1)
    slot = np.minimum((palette.hue * bins / 360.0).astype(int), bins - 1)
    return (int(np.bincount(slot, palette.mass, bins).argmax()) + 0.5) * 360.0 / bins


def learn_band(palette: Palette, *, trust_marks: bool = False) -> ColorModel:
    """The colour that more than half of a palette's mass agrees on.

    A mixture is fitted from the fullest hue and from the mean direction, and
    the likelier kept.  The band reaches to the 95th percentile of the hue
    distance of the colours that belong to the bump, the floors are their 5th
    percentiles of saturation and value.  With ``trust_marks`` a missing
    majority or a band as wide as the circle is warned of only, and the floors
    are those of all marked colours.
    """
    if not len(palette.hue):
        raise CalibrationError("no pixels")
    marked, palette = int(palette.n.sum()), palette.take(~np.isnan(palette.hue))
    if not len(palette.hue):
        raise CalibrationError("no defined hue")
    notes: list[str] = []

    def refuse(reason: str, note: str) -> None:
        if not trust_marks:
            raise CalibrationError(reason)
        notes.append(note)

    finest = STEP / float((palette.sat * palette.val).max())
    fit = BumpFit(palette, 1.0 / np.radians(finest / 2) ** 2)
    mean = palette.direction()
    starts = [fullest_hue(palette), *([degrees(mean)] if abs(mean) > 0 else [])]
    best = max((fit.around(palette, c) for c in starts), key=lambda m: m.likelihood)

    mine = best.belongs[fit.at] >= 0.5
    share = palette.share(mine)
    if share <= 0.5:
        refuse(f"no majority colour: {share:.0%} of the marks agree", "no majority colour")
    core = palette.take(mine) if mine.any() else palette
    tol = core.percentile(apart(core.hue, best.centre), BAND_Q) or finest / 2
    if tol >= 90:
        refuse("the hue band is as wide as the circle", "hue band as wide as the circle")
        tol = float(np.nextafter(90.0, 0))
    base = palette if trust_marks else core
    if FLOOR_Q / 100 * (int(base.n.sum()) - 1) < 1:
        notes.append("few pixels: the floors are the smallest values seen")
    if 1 - share > JUNK_WARN:
        notes.append(f"{1 - share:.0%} of the marked pixels are another colour")
    stats = {
        "n_sample_px": marked, "n_valid_hue_px": int(palette.n.sum()), "n_coherent_px": int(palette.n[mine].sum()), "junk_fraction": 1 - share,
        "mixture_weight": best.weight, "kappa": best.kappa, "em_iterations": best.rounds, "resultant_r": abs(mean),
    }
    return ColorModel(best.centre, tol, base.percentile(base.sat, FLOOR_Q), base.percentile(base.val, FLOOR_Q), stats, notes)
