"""Presence, uncertainty and plausibility as column expressions.

Statistics may be NULL where nothing was observed, which differs from zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def presence(area_frac: Column, min_area_frac: Column) -> dict[str, Column]:
    """present (inclusive) and the margin by which."""
    return {"present": area_frac >= min_area_frac, "margin": area_frac / min_area_frac}


def is_uncertain(area_frac: Column, min_pos: Column, max_neg: Column) -> Column:
    """Strictly between the smallest positive and the largest negative area,
    in either order; certain where one of them was never observed."""
    inside = (area_frac > F.least(min_pos, max_neg)) & (area_frac < F.greatest(min_pos, max_neg))
    return F.when(min_pos.isNull() | max_neg.isNull(), False).otherwise(inside)


def uncertain_verdict(uncertain: Column, conflict: Column, present: Column) -> Column:
    return uncertain | (conflict & present)


def shape_plausible(area: Column, w: Column, h: Column, shape_n: Column, log_aspect_min: Column, log_aspect_max: Column, fill_min: Column) -> Column:
    """Aspect within bounds and box filled enough; with under two learned
    shapes everything is plausible.  The area itself is no criterion."""
    aspect = F.log(w / h)
    ok = (w > 0) & (h > 0) & (area > 0) & (aspect >= log_aspect_min) & (aspect <= log_aspect_max) & (area / (w * h) >= fill_min)
    return F.when(F.coalesce(shape_n, F.lit(0)) < 2, True).otherwise(F.coalesce(ok, F.lit(False)))


def edge_band(n: Column, value: Column) -> Column:
    """The learned band's depth, NULL while it is not in force."""
    return F.when((F.coalesce(n, F.lit(0)) >= 2) & (value > 0), value)


def veto_qualified(separable: Column, provisional: Column, bar: Column, area_frac: Column) -> Column:
    """May a blob of this area veto what it encloses?  Without statistics: no."""
    return F.coalesce(separable, F.lit(False)) & ~F.coalesce(provisional, F.lit(True)) & F.coalesce(area_frac >= bar, F.lit(False))


def gap_ratio(min_pos: Column, max_neg: Column) -> Column:
    """Smallest positive over largest negative area."""
    return F.when(min_pos.isNull() | max_neg.isNull(), None).when(max_neg <= 0, float("inf")).otherwise(min_pos / max_neg)


def geometric_threshold(min_pos: Column, max_neg: Column) -> Column:
    return F.sqrt(min_pos * max_neg)


def rotated_fill(log_aspect: Column, fill: Column) -> Column:
    """Box fill that the same shape has when it stands diagonally."""
    a = F.exp(F.abs(log_aspect))
    return fill * 2.0 * a / ((1.0 + a) * (1.0 + a))


def frame_gate(median_sat: Column, median_val: Column, clip_frac: Column, row_dup_frac: Column, limits: dict[str, Column]) -> dict[str, Column]:
    """The three suspicions of a frame and, by priority, its outcome."""
    damaged = row_dup_frac > limits["row_dup_max"]
    grey = median_sat < limits["sat_min"]
    over = (clip_frac > limits["clip_max"]) | (median_val > limits["val_max"])
    outcome = F.when(damaged, "integrity").when(grey, "grayscale").when(over, "overexposed").otherwise("ok")
    return {"damaged": damaged, "grayscale": grey, "overexposed": over, "outcome": outcome}


#: Everything that an analysis can end with.
OUTCOMES = (
    "no_run_yet", "ok", "hold_greyscale", "hold_overexposure", "hold_greyscale_and_overexposure", "hold_frame_integrity",
    "ambiguous_cold_start", "camera_error", "detect_error", "not_calibrated", "watchdog_timeout", "previous_run_still_busy",
)


def hold_outcome(unreadable: Column, damaged: Column, grayscale: Column, overexposed: Column) -> Column:
    """Why a frame changes nothing, ``ok`` if it may: integrity before light,
    and both lights named where both fail."""
    return (
        F.when(unreadable, "detect_error").when(damaged, "hold_frame_integrity").when(grayscale & overexposed, "hold_greyscale_and_overexposure")
        .when(grayscale, "hold_greyscale").when(overexposed, "hold_overexposure").otherwise("ok")
    )


def teaches_light(damaged: Column, grayscale: Column) -> Column:
    """May a frame's light move the gates?  Clean ones and merely overexposed
    ones may; grey ones would disarm the night gate, damaged ones lie."""
    return ~F.coalesce(damaged, F.lit(True)) & ~F.coalesce(grayscale, F.lit(True))
