"""Detection on encoded frames, one pass a frame.

A frame is decoded, cut to its region, turned into hue, saturation and value,
judged for its light and resolved into candidates inside one map: only the
candidates leave the task, no pixel is ever a row and nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import verdicts
from ..functions.color import EPS
from ..sources import frames as pictures
from . import raster
from .raster import Model

#: Limits that no frame fails.
OPEN = {"sat_min": 0.0, "val_max": 1.0, "clip_max": 1.0, "row_dup_max": 1.0}
FRAME = "image_id long, error string, bin_id string, area long, provisional_area long, excluded_by string, conflict_with string, x0 int, y0 int, x1 int, y1 int, cx double, cy double, denom long, median_sat double, median_val double, clip_frac double, row_dup_frac double"
_KINDS = {name: {"long": "Int64", "int": "Int32", "string": object, "double": float}[kind] for name, kind in map(str.split, FRAME.split(", "))}
_NAMES = list(_KINDS)


def hsv_planes(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees (NaN for grey), saturation and value of 8-bit RGB."""
    c = rgb / 255.0
    top = c.max(2)
    chroma = top - c.min(2)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        sextant = np.where(top == r, np.mod((g - b) / chroma, 6.0), np.where(top == g, (b - r) / chroma + 2.0, (r - g) / chroma + 4.0))
        hue = np.where(chroma > EPS, np.mod(60.0 * sextant, 360.0), np.nan)
        return hue, np.where(top > EPS, chroma / top, 0.0), top


def frame_light(rgb: np.ndarray, sat: np.ndarray, val: np.ndarray) -> dict[str, float]:
    """Medians, clipped share and repeated rows of a whole frame."""
    clipped = rgb.max(2) >= 254
    step = np.abs(np.diff(rgb.astype(np.int16), axis=0)).sum(2)
    told = ~(clipped[1:] & clipped[:-1])
    counted = told.any(1)
    repeats = (np.where(told, step, 0).max(1, initial=0) <= 3)[counted] if counted.any() else np.zeros(1, bool)
    return {"median_sat": float(np.median(sat)), "median_val": float(np.median(val)), "clip_frac": float(clipped.mean()), "row_dup_frac": float(repeats.mean())}


class Geometry:
    """Region mask and depth by frame size and crop; a worker works each out
    once (a camera's frames share them)."""

    def __init__(self, rings, most: int = 8):
        self.rings, self.most, self.held = rings, most, {}

    def __call__(self, shape: tuple[int, int], crop: tuple) -> tuple[np.ndarray, np.ndarray]:
        key = shape, crop
        if key not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            mask = np.ones(shape, bool) if self.rings is None else pictures.polygon_raster(self.rings, crop, *shape)
            self.held[key] = mask, raster.interior_depth(mask)
        return self.held[key]


def candidates(frames: DataFrame, models: list[Model], *, roi=(0.0, 0.0, 1.0, 1.0), working_width: int | None = None, resample: str = "bilinear", rings=None, exclusion: bool = True, veto: bool = True) -> DataFrame:
    """One row for each frame (image_id, content) and model, with the frame's
    light; a frame that cannot be read is one row with its ``error``."""
    def run(parts):
        geometry = Geometry(rings)
        for part in parts:
            rows = []
            for r in part.itertuples():
                try:
                    whole = pictures.decode_frame(r.content)
                    box = pictures.crop_box(roi, whole.shape[1], whole.shape[0])
                    rgb = pictures.working_frame(whole, roi, working_width, resample)
                except pictures.FrameError as e:
                    rows.append({"image_id": r.image_id, "error": str(e)})
                    continue
                mask, depth = geometry(rgb.shape[:2], pictures.relative(box, whole.shape[1], whole.shape[0]))
                hue, sat, val = hsv_planes(rgb)
                light = frame_light(rgb, sat, val) | {"image_id": r.image_id, "denom": int(mask.sum())}
                for c in raster.resolve(models, hue, sat, val, mask, depth=depth, exclusion=exclusion, veto=veto):
                    box, mid = c.pop("box") or (None,) * 4, c.pop("centroid") or (None, None)
                    rows.append(light | c | dict(zip(("x0", "y0", "x1", "y1"), box)) | {"cx": mid[0], "cy": mid[1]})
            out = pd.DataFrame(rows, columns=_NAMES)
            yield out.astype(_KINDS)

    return frames.select("image_id", "content").mapInPandas(run, FRAME)


def judged(found: DataFrame, models: list[Model], limits: dict[str, float] | None = None) -> DataFrame:
    """Candidates with their verdicts and their frame's gates and outcome."""
    spark = found.sparkSession
    stats = spark.createDataFrame([(m.id, m.min_area_frac, m.stat("min_pos_area_frac"), m.stat("max_neg_area_frac")) for m in models], "bin_id string, min_area_frac double, min_pos double, max_neg double")
    got = found.join(F.broadcast(stats), "bin_id", "left").withColumn("area_frac", F.col("area") / F.col("denom"))
    got = got.withColumns(verdicts.presence(F.col("area_frac"), F.col("min_area_frac")))
    unsure = verdicts.is_uncertain(F.col("area_frac"), F.col("min_pos"), F.col("max_neg"))
    got = got.withColumn("uncertain", verdicts.uncertain_verdict(unsure, F.col("conflict_with").isNotNull(), F.col("present"))).drop("min_pos", "max_neg")
    gate = verdicts.frame_gate(*(F.col(c) for c in ("median_sat", "median_val", "clip_frac", "row_dup_frac")), {k: F.lit(v) for k, v in (limits or OPEN).items()})
    got = got.withColumns({k: gate[k] for k in ("damaged", "grayscale", "overexposed")})
    return got.withColumn("outcome", verdicts.hold_outcome(F.col("error").isNotNull(), F.col("damaged"), F.col("grayscale"), F.col("overexposed")))


def detect(frames: DataFrame, models: list[Model], limits: dict[str, float] | None = None, **view) -> DataFrame:
    """Verdicts on encoded frames (image_id, content); ``view`` as for
    :func:`candidates`."""
    return judged(candidates(frames, models, **view), models, limits)
