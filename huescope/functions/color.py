"""Colour arithmetic as column expressions, all inside generated code.

An undefined hue is NULL and never matches anything.  Hues are degrees in
[0, 360), saturation and value lie in [0, 1].
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Below these a chroma or a maximum counts as zero.
EPS = 1e-12
#: Fixed value: 8-bit quantisation step of one channel.
QUANTUM = 1.0 / 255.0


def rgb_to_hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """hue (NULL for grey), sat and val of channels in [0, 1]; ties of the
    largest channel go to red, then green."""
    r, g, b = (c.cast("double") for c in (r, g, b))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    chroma = top - low
    sextant = F.when(top == r, F.pmod((g - b) / chroma, F.lit(6.0))).when(top == g, (b - r) / chroma + 2.0).otherwise((r - g) / chroma + 4.0)
    hue = F.when(chroma > EPS, F.pmod(sextant * 60.0, F.lit(360.0)))
    return {"hue": hue, "sat": F.when(top > EPS, chroma / top).otherwise(F.lit(0.0)), "val": top}


def circular_distance(hue: Column, centre: Column) -> Column:
    """Degrees between two hues along the shorter arc, in [0, 180]."""
    return F.abs(F.pmod(hue - centre + 180.0, F.lit(360.0)) - 180.0)


def kappa_from_resultant(resultant: Column) -> Column:
    """Von Mises concentration for a mean resultant length."""
    square = resultant * resultant
    return F.when(resultant <= 0, 0.0).when(resultant >= 1, float("inf")).otherwise(resultant * (2.0 - square) / (1.0 - square))


@F.pandas_udf(DoubleType())
def log_i0(x: pd.Series) -> pd.Series:
    """Logarithm of the modified Bessel function I0.

    Spark has no such function; past the double range its asymptote is used.
    """
    return pd.Series(log_bessel_i0(x.to_numpy(float)))


def log_bessel_i0(x) -> np.ndarray:
    """numpy form of :func:`log_i0`."""
    x = np.abs(np.asarray(x, float))
    safe = np.minimum(x, 700.0)
    far = x - 0.5 * np.log(2 * np.pi * np.maximum(x, 1.0))
    return np.where(x <= 700.0, np.log(np.i0(safe)), far)


def chroma(sat: Column, val: Column) -> Column:
    return sat * val


def hue_quantum(chroma_: Column) -> Column:
    """Hue step in degrees that one 8-bit step makes at this chroma."""
    return F.when(chroma_ > 0, 60.0 / (255.0 * chroma_))


def kappa_cap(chroma_: Column) -> Column:
    """Largest concentration that 8-bit hues of this chroma can show."""
    half = F.radians(hue_quantum(chroma_) / 2.0)
    return F.when(chroma_ > 0, 1.0 / (half * half))


def is_clipped(r8: Column, g8: Column, b8: Column) -> Column:
    """Value at least 1 - 1/255, on 8-bit channels."""
    return F.greatest(r8, g8, b8) >= 254


def regime_distance(sat_a: Column, val_a: Column, sat_b: Column, val_b: Column) -> Column:
    """Chebyshev distance of two light regimes."""
    return F.greatest(F.abs(sat_a - sat_b), F.abs(val_a - val_b))


def bin_match(hue: Column, sat: Column, val: Column, centre: Column, tolerance: Column, sat_min: Column, val_min: Column) -> dict[str, Column]:
    """Whether a pixel belongs to a model's band, and its hue distance
    (infinite where the hue is undefined)."""
    distance = circular_distance(hue, centre)
    accepted = F.coalesce((distance <= tolerance) & (sat >= sat_min) & (val >= val_min), F.lit(False))
    return {"accepted": accepted, "distance": F.coalesce(distance, F.lit(float("inf")))}


def hue_bands_overlap(centre_a: Column, tol_a: Column, centre_b: Column, tol_b: Column) -> Column:
    return circular_distance(centre_a, centre_b) <= tol_a + tol_b
