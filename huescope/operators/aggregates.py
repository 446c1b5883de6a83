"""Aggregates over pixels, frames and evidence, as window and group plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, verdicts


def circular_mean(df: DataFrame, keys: list[str], hue: str, weight: str | None = None) -> DataFrame:
    """mean_deg in [0, 360) and resultant of the defined hues of each group;
    NULL where a group has none, or no weight."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rad = F.radians(hue)
    used = df.where(F.col(hue).isNotNull()).groupBy(*keys).agg(F.sum(w * F.cos(rad)).alias("_c"), F.sum(w * F.sin(rad)).alias("_s"), F.sum(w).alias("_w"))
    angle = F.pmod(F.degrees(F.atan2("_s", "_c")), F.lit(360.0))
    some = F.col("_w") > 0
    return used.select(*keys, F.when(some, F.when(angle >= 360, 0.0).otherwise(angle)).alias("mean_deg"), F.when(some, F.hypot("_c", "_s") / F.col("_w")).alias("resultant"))


def weighted_percentile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, order: list[str], name: str = "percentile") -> DataFrame:
    """The q-th percentile (0 to 100) with each row's weight centred on it:
    linear between the midpoints of the running weight, clamped at the ends.

    ``order`` makes ties among equal values repeatable.  The window sorts
    each group once; groups are images or bins and spread over the cluster.
    """
    by = Window.partitionBy(*keys).orderBy(value, *order)
    total = Window.partitionBy(*keys)
    used = df.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    p = used.withColumn("_w", F.col(weight).cast("double")).withColumn("_p", (F.sum("_w").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w") / 2) / F.sum("_w").over(total))
    step = p.withColumns({"_np": F.lead("_p").over(by), "_nv": F.lead(value).over(by), "_n": F.row_number().over(by)})
    at = F.lit(q / 100.0)
    inner = F.when(F.col("_np").isNull() | (at <= F.col("_p")), F.col(value)).otherwise(F.col(value) + (F.col("_nv") - F.col(value)) * (at - F.col("_p")) / (F.col("_np") - F.col("_p")))
    hit = ((F.col("_p") <= at) & (F.col("_np").isNull() | (at < F.col("_np")))) | ((F.col("_n") == 1) & (at < F.col("_p")))
    return step.where(hit).select(*keys, inner.cast("double").alias(name))


def percentile(value: str, q: float) -> Column:
    """Exact percentile, linear between order statistics."""
    return F.percentile(F.col(value), F.lit(q / 100.0))


def successive_slack(df: DataFrame, keys: list[str], value: str, order: list[str], name: str = "slack") -> DataFrame:
    """Median absolute step between neighbours in order; 0 for one row."""
    by = Window.partitionBy(*keys).orderBy(*order)
    steps = df.where(F.col(value).isNotNull()).withColumn("_d", F.abs(F.col(value) - F.lag(value).over(by)))
    return steps.groupBy(*keys).agg(F.coalesce(F.median("_d"), F.lit(0.0)).alias(name))


def frame_light(pixels: DataFrame, by: str = "image_id") -> DataFrame:
    """median_sat, median_val and clip_frac of each whole frame."""
    clipped = F.avg(color.is_clipped(F.col("r8"), F.col("g8"), F.col("b8")).cast("double"))
    return pixels.groupBy(by).agg(F.median("sat").alias("median_sat"), F.median("val").alias("median_val"), clipped.alias("clip_frac"))


def row_duplicate_fraction(pixels: DataFrame) -> DataFrame:
    """Share of neighbouring row pairs that repeat each other.

    A pair repeats if no column differs by more than 3 in the sum of its
    8-bit channels; columns clipped in both rows say nothing, and a pair
    without any telling column does not count.  0 without countable pairs.
    """
    column = Window.partitionBy("image_id", "x").orderBy("y")
    channels = ("r8", "g8", "b8")
    diff = sum((F.abs(F.col(c) - F.lag(c).over(column)) for c in channels[1:]), F.abs(F.col("r8") - F.lag("r8").over(column)))
    clip = color.is_clipped(*(F.col(c) for c in channels))
    told = pixels.withColumns({"_diff": diff, "_before": F.lag("y").over(column), "_clip": clip}).withColumn("_both", F.col("_clip") & F.lag("_clip").over(column))
    pair = told.where((F.col("_before") == F.col("y") - 1) & ~F.col("_both")).groupBy("image_id", "y").agg(F.max("_diff").alias("_most"))
    got = pair.groupBy("image_id").agg(F.avg((F.col("_most") <= 3).cast("double")).alias("row_dup_frac"))
    return pixels.select("image_id").distinct().join(got, "image_id", "left").select("image_id", F.coalesce("row_dup_frac", F.lit(0.0)).alias("row_dup_frac"))


def frame_gates(pixels: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Light, repetition, the three suspicions and the outcome of each frame."""
    got = frame_light(pixels).join(row_duplicate_fraction(pixels), "image_id")
    verdict = verdicts.frame_gate(*(F.col(c) for c in ("median_sat", "median_val", "clip_frac", "row_dup_frac")), {k: F.lit(v) for k, v in limits.items()})
    return got.withColumns(verdict)


def hue_mode(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Centre of the fullest hue bin; the bin width is one 8-bit step at the
    group's median chroma, the first of equally full bins wins."""
    used = pixels.where(F.col("hue").isNotNull())
    width = used.groupBy(*keys).agg(color.hue_quantum(F.median(F.col("sat") * F.col("val"))).alias("width"))
    bins = F.greatest(F.ceil(360.0 / F.col("width")), F.lit(1))
    # the few groups' widths are joined back to the pixels of the group
    binned = used.join(width, keys).withColumns({"n_bins": bins}).withColumn("slot", F.least(F.floor(F.col("hue") / (360.0 / F.col("n_bins"))), F.col("n_bins") - 1))
    counts = binned.groupBy(*keys, "n_bins", "slot").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys, "n_bins").agg(F.min(F.struct(-F.col("n"), "slot")).alias("top"))
    return best.select(*keys, F.col("n_bins").cast("long").alias("n_bins"), ((F.col("top.slot") + 0.5) * 360.0 / F.col("n_bins")).alias("mode_deg"), (-F.col("top.col1")).alias("n"))


def quality_gates(samples: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Limits for the four gate values: the extreme seen, widened by the
    median successive step, within [0, 1].  ``samples`` has median_sat,
    median_val, clip_frac and row_dup_frac."""
    by = Window.partitionBy(*keys).orderBy(*order)
    names = ("median_sat", "median_val", "clip_frac", "row_dup_frac")
    steps = samples.withColumns({f"_{n}": F.abs(F.col(n) - F.lag(n).over(by)) for n in names})
    slack = {n: F.coalesce(F.median(f"_{n}"), F.lit(0.0)) for n in names}
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return steps.groupBy(*keys).agg(
        unit(F.min("median_sat") - slack["median_sat"]).alias("daylight_sat_min"), unit(F.max("median_val") + slack["median_val"]).alias("daylight_val_max"),
        unit(F.max("clip_frac") + slack["clip_frac"]).alias("overexposure_clip_max"), unit(F.max("row_dup_frac") + slack["row_dup_frac"]).alias("row_dup_max"))


def widened(old: dict[str, Column], new: dict[str, Column]) -> dict[str, Column]:
    """Gates only ever widen: the saturation floor falls, the rest rises."""
    return {k: (F.least if k == "daylight_sat_min" else F.greatest)(old[k], new[k]) for k in old}


def area_threshold(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest area that counts as present, from (label, area_frac) rows.

    Between the smallest positive and the largest negative area lies their
    geometric mean; without (or with only empty) negatives half the smallest
    positive.  provisional: no negatives at all; separable: they do not
    cross.  Groups without a positive of some area give no row.
    """
    pos, neg = F.col("label") == "present", F.col("label") == "absent"
    got = evidence.groupBy(*keys).agg(
        F.count(F.when(pos, 1)).alias("n_pos"), F.count(F.when(neg, 1)).alias("n_neg"),
        F.min(F.when(pos, F.col("area_frac"))).alias("min_pos_area_frac"), F.max(F.when(neg, F.col("area_frac"))).alias("max_neg_area_frac"))
    p, n = F.col("min_pos_area_frac"), F.col("max_neg_area_frac")
    half = n.isNull() | (n <= 0)
    return got.where(p > 0).withColumns({"min_area_frac": F.when(half, p * 0.5).otherwise(verdicts.geometric_threshold(p, n)), "provisional": n.isNull(), "separable": F.coalesce(n, F.lit(0.0)) < p})


def shape_bounds(shapes: DataFrame, keys: list[str], order: list[str], pooled_span: Column) -> DataFrame:
    """Bounds on log aspect and box fill from observed (area, w, h).

    The aspect band is symmetric; both bounds are widened by the largest of
    the successive slack, one pixel's worth and (aspect) the pooled span.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    log_aspect, fill = F.log(F.col("w") / F.col("h")), F.col("area") / (F.col("w") * F.col("h"))
    seen = shapes.withColumns({"_l": log_aspect, "_f": fill, "_one": F.log(1 + 1 / F.col("w")) + F.log(1 + 1 / F.col("h")), "_rim": 2.0 * (F.col("w") + F.col("h")) / (F.col("w") * F.col("h"))})
    seen = seen.withColumns({"_r": verdicts.rotated_fill(F.col("_l"), F.col("_f")), "_dl": F.abs(F.col("_l") - F.lag("_l").over(by)), "_df": F.abs(F.col("_f") - F.lag("_f").over(by))})
    half = F.max(F.abs("_l")) + F.greatest(F.coalesce(F.median("_dl"), F.lit(0.0)), F.max("_one"), F.max(pooled_span))
    floor = F.least(F.min("_r"), F.min("_f")) - F.greatest(F.coalesce(F.median("_df"), F.lit(0.0)), F.max("_rim"))
    return seen.groupBy(*keys).agg(F.count("*").alias("shape_n"), (-half).alias("shape_log_aspect_min"), half.alias("shape_log_aspect_max"), F.greatest(floor, F.lit(0.0)).alias("shape_fill_min"))


def learn_edge_band(touches: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """How deep a real object's blob at least reaches: the smallest seen, less
    the successive slack, not below 0."""
    slack = successive_slack(touches, keys, value, order)
    got = touches.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("obs_min_frac"))
    return got.join(slack, keys).withColumn("min_frac", F.greatest(F.col("obs_min_frac") - F.col("slack"), F.lit(0.0)))


def one_vote_weights(pixels: DataFrame, keys: list[str], image: str = "image_id") -> DataFrame:
    """Every image has one vote: weight 1 / its number of pixels."""
    return pixels.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy(*keys, image)))


def coherent_share(df: DataFrame, keys: list[str], posterior: str, weight: str) -> DataFrame:
    """Weighted share of observations that belong to the colour."""
    w = F.col(weight)
    return df.groupBy(*keys).agg((F.sum(F.when(F.col(posterior) >= 0.5, w).otherwise(0.0)) / F.sum(w)).alias("coherent_share"))


def pooled_aspect_span(shapes: DataFrame) -> DataFrame:
    """One row: the span of log aspect over all observations."""
    aspect = F.log(F.col("w") / F.col("h"))
    return shapes.agg((F.max(aspect) - F.min(aspect)).alias("span"))


def clutter_reach(named: DataFrame, depths: DataFrame, width: Column) -> DataFrame:
    """Per bin, how deep components that touch the rim reach, by frame width."""
    keys = ["image_id", "bin_id", "seed_y", "seed_x"]
    deep = named.join(depths, ["image_id", "y", "x"]).groupBy(*keys).agg(F.min("depth").alias("least"), F.max("depth").alias("most"))
    return deep.where("least = 1").groupBy("bin_id").agg((F.max("most") / width).alias("clutter_max_frac"))


def daylight_extrema(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Gate limits from frames that may teach light: of the current view, not
    taken automatically, not excluded."""
    may = F.col("current_view") & ~F.col("auto") & ~F.col("excluded")
    return quality_gates(frames.where(may), keys, order)
