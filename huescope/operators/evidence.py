"""Labelled evidence as append-only, versioned tables.

Tables: ``bins`` (bin_id, name, active, appearance_epoch), ``images`` (path,
ord, view_epoch, excluded, auto, label_roi, label_rings), ``labels`` (path,
bin_id, label, label_epoch) and ``samples`` (path, bin_id, ord, rect, roi,
epoch); ``config`` is one row (roi, rings, working_width, view_epoch).
Commands return the new table; nothing is deleted, only flagged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from . import regions


def active_bins(bins: DataFrame) -> DataFrame:
    return bins.where("active")


def usable_samples(samples: DataFrame, images: DataFrame, bins: DataFrame) -> DataFrame:
    """Colour samples that count: active bin, current appearance, image not
    excluded.  Views and regions do not matter, a sample carries its own."""
    now = active_bins(bins).select("bin_id", F.col("appearance_epoch").alias("epoch"))
    shown = images.where(~F.col("excluded")).select("path")
    return samples.join(now, ["bin_id", "epoch"], "left_semi").join(shown, "path", "left_semi")


def usable_labels(labels: DataFrame, images: DataFrame, samples: DataFrame, bins: DataFrame, config: DataFrame) -> DataFrame:
    """Every label of an active bin on a shown image with ``usable``.

    present: its appearance is current, the view is current, and the current
    region holds either the region it was given in or every rectangle of the
    bin in that image, of any appearance.  absent: the view is current and
    the label's region holds the current one; recolouring does not matter.
    """
    c = config.select(F.col("roi").alias("now_roi"), F.col("rings").alias("now_rings"), "working_width", F.col("view_epoch").alias("now_view"))
    shown = images.where(~F.col("excluded")).select("path", "view_epoch", "label_roi", "label_rings")
    one = F.broadcast(c.limit(1))  # the configuration is one row
    rects = samples.join(one).select("path", "bin_id", regions.contains(F.col("now_roi"), F.col("now_rings"), F.col("rect"), F.lit(None).cast(config.schema["rings"].dataType), F.col("working_width")).alias("in"))
    proof = rects.groupBy("path", "bin_id").agg(F.bool_and("in").alias("all_in"))
    now = active_bins(bins).select("bin_id", "appearance_epoch")
    got = labels.join(now, "bin_id").join(shown, "path").join(proof, ["path", "bin_id"], "left").join(one)
    current = F.col("view_epoch") == F.col("now_view")
    in_now = regions.contains(F.col("now_roi"), F.col("now_rings"), F.col("label_roi"), F.col("label_rings"), F.col("working_width"))
    now_in = regions.contains(F.col("label_roi"), F.col("label_rings"), F.col("now_roi"), F.col("now_rings"), F.col("working_width"))
    known = F.col("label_roi").isNotNull()
    present = (F.col("label_epoch") == F.col("appearance_epoch")) & current & ((known & in_now) | F.coalesce("all_in", F.lit(False)))
    usable = F.when(F.col("label") == "present", present).otherwise(current & known & now_in)
    return got.select("path", "bin_id", "label", F.coalesce(usable, F.lit(False)).alias("usable"))


def warnings(labels: DataFrame, samples: DataFrame, images: DataFrame, bins: DataFrame) -> DataFrame:
    """What was set aside, one row an item: (kind, item); ``labels`` with
    their ``usable``."""
    now = active_bins(bins).select("bin_id", "appearance_epoch")
    shown = images.where(~F.col("excluded")).select("path")
    stale = samples.join(shown, "path", "left_semi").join(now, "bin_id").where("epoch <> appearance_epoch")
    name = F.concat_ws(":", "path", "bin_id")
    listed = lambda df, kind, item: df.select(F.lit(kind).alias("kind"), item.alias("item")).distinct()
    out = [listed(images.where("excluded"), "excluded_images", F.col("path")), listed(stale, "dormant_samples", name)]
    out += [listed(labels.where((F.col("label") == k) & ~F.col("usable")), f"stale_{k}", name) for k in ("present", "absent")]
    return reduce(DataFrame.unionByName, out)


def violations(rules: list[tuple[str, DataFrame, Column, Column]]) -> DataFrame:
    """(rule, item) of every row that breaks a rule: (name, table, broken
    condition, what to name).  Conditions that are NULL count as broken."""
    return reduce(DataFrame.unionByName, [df.where(F.coalesce(bad, F.lit(True))).select(F.lit(name).alias("rule"), item.cast("string").alias("item")) for name, df, bad, item in rules])


def store_violations(bins: DataFrame, images: DataFrame, labels: DataFrame, samples: DataFrame, config: DataFrame) -> DataFrame:
    """Everything that makes the evidence invalid, as (rule, item) rows."""
    view = F.broadcast(config.select(F.col("view_epoch").alias("now_view")).limit(1))
    of = bins.select("bin_id", "appearance_epoch")
    name = F.concat_ws(":", "path", "bin_id")
    twice = lambda df, *k: df.groupBy(*k).count().where("count > 1")
    both = labels.groupBy("path", "bin_id").agg(F.count_distinct("label").alias("k")).where("k > 1")
    aged = labels.where("label_epoch is not null").join(of, "bin_id")
    drawn = samples.join(of, "bin_id")
    no = F.lit(True)
    return violations([
        ("empty bin id", bins, F.coalesce(F.col("bin_id"), F.lit("")) == "", F.col("name")),
        ("duplicate bin id", twice(bins, "bin_id"), no, F.col("bin_id")),
        ("negative appearance epoch", bins, F.col("appearance_epoch") < 0, F.col("bin_id")),
        ("duplicate image", twice(images, "path"), no, F.col("path")),
        ("undeclared bin in a label", labels.join(of, "bin_id", "left_anti"), no, name),
        ("undeclared bin in a sample", samples.join(of, "bin_id", "left_anti"), no, name),
        ("present and absent", both, no, name),
        ("view epoch out of range", images.join(view), (F.col("view_epoch") < 0) | (F.col("view_epoch") > F.col("now_view")), F.col("path")),
        ("label region invalid", images.where("label_roi is not null"), geometry.clamp_unit(F.col("label_roi")).isNull(), F.col("path")),
        ("label rings invalid", images.where("label_rings is not null"), geometry.rings_error(F.col("label_rings")).isNotNull(), F.col("path")),
        ("label epoch out of range", aged, (F.col("label_epoch") < 0) | (F.col("label_epoch") > F.col("appearance_epoch")), name),
        ("sample epoch out of range", drawn, (F.col("epoch") < 0) | (F.col("epoch") > F.col("appearance_epoch")), name),
        ("sample outside its region", samples, geometry.image_to_roi(F.col("rect"), F.col("roi")).isNull(), name),
        ("region box differs from its rings", config.where("rings is not null"), ~geometry.equal(geometry.rings_bbox(F.col("rings")), F.col("roi")), F.lit("config")),
        ("working width not positive", config.where("working_width is not null"), F.col("working_width") <= 0, F.lit("config")),
    ])


def profile_violations(profile: DataFrame, models: DataFrame) -> DataFrame:
    """Everything that makes a learned profile invalid."""
    unit = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1)
    shaped, banded = models.where("shape_n >= 2"), models.where("region_edge_depth_n >= 2")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rules = [(f"{c} outside [0, 1]", profile, ~unit(c), F.lit("profile")) for c in ("daylight_sat_min", "overexposure_clip_max", "daylight_val_max", "row_dup_max")]
    rules += [(f"{c} outside [0, 1]", models, ~unit(c), F.col("bin_id")) for c in ("sat_min", "val_min")]
    rules += [(f"{c} outside [0, 1]", models.where(F.col(c).isNotNull()), ~unit(c), F.col("bin_id")) for c in ("min_pos_area_frac", "max_neg_area_frac", "veto_qualify_min_area_frac")]
    rules += [(f"{c} not finite", shaped, ~finite(c), F.col("bin_id")) for c in ("shape_log_aspect_min", "shape_log_aspect_max", "shape_fill_min")]
    return violations([
        *rules,
        ("unknown resample", profile, ~F.col("resample").isin("bilinear", "nearest"), F.lit("profile")),
        ("working width not positive", profile.where("working_width is not null"), F.col("working_width") <= 0, F.lit("profile")),
        ("empty bin id", models, F.coalesce(F.col("bin_id"), F.lit("")) == "", F.lit("")),
        ("duplicate bin id", models.groupBy("bin_id").count().where("count > 1"), F.lit(True), F.col("bin_id")),
        ("hue centre out of range", models, (F.col("hue_center") < 0) | (F.col("hue_center") >= 360), F.col("bin_id")),
        ("hue tolerance out of range", models, (F.col("hue_tol") <= 0) | (F.col("hue_tol") * 2 >= 180), F.col("bin_id")),
        ("minimum area out of range", models, (F.col("min_area_frac") <= 0) | (F.col("min_area_frac") > 1), F.col("bin_id")),
        ("negative shape_n", models.where("shape_n is not null"), F.col("shape_n") < 0, F.col("bin_id")),
        ("shape bounds inverted", shaped, F.col("shape_log_aspect_min") > F.col("shape_log_aspect_max"), F.col("bin_id")),
        ("shape fill outside [0, 1]", shaped, ~unit("shape_fill_min"), F.col("bin_id")),
        ("edge band not finite", banded, ~finite("region_edge_depth_min_frac") | (F.col("region_edge_depth_min_frac") < 0), F.col("bin_id")),
    ])


# Set operations -------------------------------------------------------------------------


def label_conflicts(entries: DataFrame) -> DataFrame:
    """(path, bin_id) of bins given as present and absent at once."""
    return entries.select("path", F.explode(F.array_intersect("present", "absent")).alias("bin_id"))


def unmaterialised(archive: DataFrame, images: DataFrame) -> DataFrame:
    """Archived files without an image entry."""
    return archive.join(images.select("path"), "path", "left_anti")


def untrained(bins: DataFrame, models: DataFrame) -> DataFrame:
    return active_bins(bins).select("bin_id").exceptAll(models.select("bin_id"))


def stale_models(models: DataFrame, bins: DataFrame) -> DataFrame:
    return models.select("bin_id").exceptAll(active_bins(bins).select("bin_id"))


def new_mistakes(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Candidate's mistakes that the baseline does not make, repeats kept."""
    return candidate.join(baseline.select("path", "bin_id"), ["path", "bin_id"], "left_anti")


# Commands -------------------------------------------------------------------------------


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace what has their keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def ensure_images(images: DataFrame, paths: DataFrame, capture_epochs: DataFrame, view_epoch: int) -> DataFrame:
    """Entries for paths that have none; a frame captured before the view
    changed keeps the view of its capture."""
    new = unmaterialised(paths.select("path").distinct(), images).join(capture_epochs, "path", "left")
    last = images.agg(F.max("ord")).first()[0]
    # ordered by a distributed sort; the numbers rise but may have gaps
    numbered = new.orderBy("path").withColumn("ord", F.lit(0 if last is None else int(last) + 1) + F.monotonically_increasing_id())
    return images.unionByName(numbered.select("path", "ord", F.coalesce("capture_epoch", F.lit(view_epoch)).alias("view_epoch"), F.lit(False).alias("excluded"), F.lit(False).alias("auto")), allowMissingColumns=True)


def set_labels(labels: DataFrame, given: DataFrame, bins: DataFrame) -> DataFrame:
    """Newly given labels move a bin to the list named and stamp its epoch.

    Conflicting or undeclared ones are an error, before anything changes.
    """
    both = given.groupBy("path", "bin_id").agg(F.count_distinct("label").alias("k")).where("k > 1")
    unknown = given.join(bins, "bin_id", "left_anti")
    if not both.isEmpty() or not unknown.isEmpty():
        raise ValueError("a bin is undeclared, or given as present and absent at once")
    stamped = given.select("path", "bin_id", "label").distinct().join(bins.select("bin_id", F.col("appearance_epoch").alias("label_epoch")), "bin_id")
    return upsert(labels, stamped, ["path", "bin_id"])


def add_samples(samples: DataFrame, drawn: DataFrame, bins: DataFrame) -> DataFrame:
    """Rectangles (path, bin_id, ord, rect, roi) with the bin's epoch; drift
    is clamped, and one outside its region is an error."""
    stamped = drawn.withColumn("rect", geometry.clamp_unit(F.col("rect"))).join(bins.select("bin_id", F.col("appearance_epoch").alias("epoch")), "bin_id")
    if not stamped.where(F.col("rect").isNull() | geometry.image_to_roi(F.col("rect"), F.col("roi")).isNull()).isEmpty():
        raise ValueError("a rectangle lies outside its region")
    return samples.unionByName(stamped.select(*samples.columns))


def set_excluded(images: DataFrame, paths: DataFrame, excluded: bool) -> DataFrame:
    """Forget or restore images."""
    hit = images.join(paths.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    return hit.withColumn("excluded", F.when(F.col("_hit"), F.lit(excluded)).otherwise(F.col("excluded"))).drop("_hit")


def set_auto_excluded(images: DataFrame, excluded: bool) -> DataFrame:
    """Discard or restore everything that was collected automatically."""
    return images.withColumn("excluded", F.when(F.col("auto"), F.lit(excluded)).otherwise(F.col("excluded")))


def has_auto_evidence(images: DataFrame) -> bool:
    return not images.where(F.col("auto") & ~F.col("excluded")).isEmpty()


def confirm_view(images: DataFrame, path: str, roi: Column, rings: Column, view_epoch: int) -> DataFrame:
    """The image still shows the same: restamp region and view, not the
    appearance epochs."""
    mine = F.col("path") == path
    return images.withColumns({"label_roi": F.when(mine, roi).otherwise(F.col("label_roi")), "label_rings": F.when(mine, rings).otherwise(F.col("label_rings")), "view_epoch": F.when(mine, F.lit(view_epoch)).otherwise(F.col("view_epoch"))})


def mark_appearance_changed(bins: DataFrame, bin_id: str) -> DataFrame:
    return bins.withColumn("appearance_epoch", F.col("appearance_epoch") + F.when(F.col("bin_id") == bin_id, 1).otherwise(0))


def set_region(config: DataFrame, rings: Column) -> DataFrame:
    """A new region: its box follows from the rings, and rings that are just
    their box are stored as none."""
    box = geometry.rings_bbox(rings)
    plain = geometry.rings_equal(rings, geometry.rect_as_rings(box))
    return config.withColumns({"roi": box, "rings": F.when(~plain, rings)})


def bump_view(config: DataFrame, capture_epochs: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The camera moved: the next view begins, and files without an entry
    keep the view that they were captured in."""
    now = F.broadcast(config.select(F.col("view_epoch").alias("capture_epoch")).limit(1))
    kept = pending.select("path").join(capture_epochs, "path", "left_anti").join(now)
    return config.withColumn("view_epoch", F.col("view_epoch") + 1), capture_epochs.unionByName(kept)


def gates_survive(before: DataFrame, after: DataFrame) -> bool:
    """Do the rolling gate samples still describe the frames?  A new box,
    working width or view starts them again; a polygon alone does not, since
    light is judged on the whole crop."""
    c = lambda df, p: df.select(F.col("roi").alias(f"{p}_roi"), F.col("working_width").alias(f"{p}_width"), F.col("view_epoch").alias(f"{p}_view")).limit(1)
    (a,), (b,) = c(before, "a").collect(), c(after, "b").collect()
    near = all(abs(a.a_roi[k] - b.b_roi[k]) <= 1e-9 for k in ("x", "y", "w", "h"))
    return near and a.a_width == b.b_width and a.a_view == b.b_view


def reconcile_bins(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Full outer merge of the declared bins (bin_id, name) with the stored:
    new ones start, missing ones retire, names follow the declaration."""
    d = declared.select("bin_id", F.col("name").alias("new_name"))
    got = stored.join(d, "bin_id", "full")
    return got.select("bin_id", F.coalesce("new_name", "name").alias("name"), F.col("new_name").isNotNull().alias("active"), F.coalesce("appearance_epoch", F.lit(0)).alias("appearance_epoch"))


def profile_stale(profile: DataFrame, config: DataFrame, models: DataFrame, bins: DataFrame) -> bool:
    """Was the profile learned for another region, width or view, or for a
    bin that has retired?"""
    p = profile.select(F.col("roi").alias("p_roi"), F.col("rings").alias("p_rings"), F.col("working_width").alias("p_width")).limit(1)
    c = config.limit(1).join(F.broadcast(p))
    same = geometry.equal(F.col("roi"), F.col("p_roi")) & geometry.rings_equal(F.col("rings"), F.col("p_rings")) & F.col("working_width").eqNullSafe(F.col("p_width"))
    return not c.where(~same).isEmpty() or not stale_models(models, bins).isEmpty()


def same_source(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (camera, roi) that an entry of the same camera and an equal
    region duplicates; cameras meet by equality, regions within it."""
    held = entries.select("camera", F.col("roi").alias("held_roi"))
    return candidates.join(held, (candidates["camera"] == held["camera"]) & geometry.equal(F.col("roi"), F.col("held_roi")), "left_semi")


def mixed_aspects(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose frames (width, height) do not all share one aspect ratio."""
    return sizes.groupBy(*keys).agg(F.count_distinct(geometry.reduced_aspect(F.col("width"), F.col("height"))).alias("aspects")).where("aspects > 1")


def active_results(results: DataFrame, bins: DataFrame) -> DataFrame:
    """Results of bins that have not retired."""
    return results.join(active_bins(bins).select("bin_id"), "bin_id", "left_semi")
