"""Learning colour, shape, edge and area models from labelled pixels.

A bin's marked pixels are aggregated to a histogram of their colours
(:mod:`.palette`), which is all that comes together in one task; everything
over frames stays relational, and only models, a handful, reach the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import verdicts
from . import aggregates, assign, raster
from .palette import JUNK_WARN, CalibrationError, Palette, learn_band, palettes  # noqa: F401
from .raster import Model

COLOR = "bin_id string, hue_center double, hue_tol double, sat_min double, val_min double, n_sample_px long, n_coherent_px long, junk_fraction double, kappa double, warnings array<string>, error string"


def learn_color_models(pixels: DataFrame, *, trust_marks: bool = False) -> DataFrame:
    """One colour model a bin from its sampled pixels (bin_id, image_id, hue,
    sat, val); every image has one vote.  A bin that cannot be trained has
    NULLs and its error."""
    names = [c.split()[0] for c in COLOR.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        row = dict.fromkeys(names) | {"bin_id": rows.bin_id.iloc[0], "n_sample_px": int(rows.n.sum()), "warnings": []}
        try:
            m = learn_band(Palette.of_rows(rows), trust_marks=trust_marks)
        except CalibrationError as e:
            row["error"] = str(e)
        else:
            alone = ["samples from under two images"] if rows["first"].min() == rows["last"].max() else []
            row |= {"hue_center": m.hue, "hue_tol": m.tol, "sat_min": m.sat_min, "val_min": m.val_min, "warnings": sorted(m.warnings + alone)}
            row |= {k: m.stats[k] for k in ("n_coherent_px", "junk_fraction", "kappa")}
        return pd.DataFrame([row]).astype({"n_coherent_px": "Int64"})

    return palettes(pixels).groupBy("bin_id").applyInPandas(run, COLOR)


def _region(pixels: DataFrame) -> DataFrame:
    """The pixels that count: all, or those of the frame's region."""
    return pixels.where("in_region") if "in_region" in pixels.columns else pixels


def object_observations(pixels: DataFrame, models: DataFrame, seeds: DataFrame) -> DataFrame:
    """What each image shows of each bin's object: (image_id, bin_id, area, w,
    h, depth), of the component under the bin's own marks.

    No edge band is applied, as it is learned from this: ``depth`` is how deep
    the component reaches into the region, by the grid's width, and NULL where
    it does not touch the region's rim.
    """
    inside = _region(pixels)
    masks = assign.exclusive_masks(inside, models).select("image_id", "bin_id", "y", "x")
    hit = raster.seeded_component(masks, seeds)
    shown = hit.select("image_id").distinct()
    depths = raster.interior_depths(inside.join(shown, "image_id", "left_semi").select("image_id", "y", "x"))
    width = pixels.join(shown, "image_id", "left_semi").groupBy("image_id").agg((F.max("x") + 1).alias("width"))
    seen = hit.join(depths, ["image_id", "y", "x"]).groupBy("image_id", "bin_id").agg(
        F.count("*").alias("area"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        F.min("depth").alias("least"), F.max("depth").alias("most"))
    return seen.join(width, "image_id").select("image_id", "bin_id", "area", "w", "h", F.when(F.col("least") == 1, F.col("most") / F.col("width")).alias("depth"))


def to_models(rows: list) -> list[Model]:
    """Driver-side models (a handful) from collected rows."""
    out = []
    for r in rows:
        d = r.asDict()
        out.append(Model(d["bin_id"], d["hue_center"], d["hue_tol"], d["sat_min"], d["val_min"], d.get("min_area_frac") or 0.0, {k: v for k, v in d.items() if v is not None}))
    return sorted(out, key=lambda m: m.id)


def _put(model: Model, row, names: dict[str, str]) -> None:
    """Take statistics of a row into a model under their stored names."""
    model.stats |= {stored: row[name] for stored, name in names.items()}


#: Stored names of what is learned, by the column that holds it.
_SHAPE = {k: k for k in ("shape_n", "shape_log_aspect_min", "shape_log_aspect_max", "shape_fill_min")}
_EDGE = {"region_edge_depth_n": "n", "region_edge_depth_min_frac": "min_frac"}
_VETO = {"veto_qualify_min_area_frac": "min_area_frac", "veto_qualify_separable": "separable", "veto_qualify_provisional": "provisional"}
_AREA = {k: k for k in ("min_pos_area_frac", "max_neg_area_frac", "provisional", "separable", "n_pos", "n_neg")}


def _table(spark, models: list[Model]) -> DataFrame:
    return spark.createDataFrame([(m.id, m.hue, m.tol, m.sat_min, m.val_min) for m in models], "bin_id string, hue_center double, hue_tol double, sat_min double, val_min double")


def _without_band(model: Model) -> Model:
    return Model(model.id, model.hue, model.tol, model.sat_min, model.val_min, model.min_area_frac, {k: v for k, v in (model.stats or {}).items() if k not in _EDGE})


def _observe(models: list[Model], seen: DataFrame) -> None:
    """Shape bounds and edge band of each model from its observed objects."""
    whole = seen.where("w > 0 and h > 0")
    span = aggregates.pooled_aspect_span(whole).first().span or 0.0
    shapes = {r.bin_id: r for r in aggregates.shape_bounds(whole, ["bin_id"], ["image_id"], F.lit(float(span))).collect()}
    edges = {r.bin_id: r for r in aggregates.learn_edge_band(seen.where("depth is not null"), ["bin_id"], "depth", ["image_id"]).collect()}
    for m in models:
        for found, names in ((shapes, _SHAPE), (edges, _EDGE)):
            if m.id in found:
                _put(m, found[m.id], names)


def _areas(pixels: DataFrame, models: list[Model], told: DataFrame, veto: bool) -> DataFrame:
    """Labelled areas as the detector measures them; positives of no area
    say nothing about how small an object may be."""
    areas = raster.resolve_candidates(pixels, models, veto=veto).select("image_id", "bin_id", (F.col("area") / F.col("denom")).alias("area_frac"))
    return areas.join(told, ["image_id", "bin_id"]).where((F.col("label") == "absent") | (F.col("area_frac") > 0))


def lost_to_the_band(pixels: DataFrame, models: list[Model], failed: list[str], shown: DataFrame) -> list[str]:
    """Failed bins whose object would be found if no edge band were applied."""
    if not failed:
        return []
    free = [_without_band(m) if m.id in failed else m for m in models]
    found = raster.resolve_candidates(pixels, free).where((F.col("area") > 0) & F.col("bin_id").isin(failed)).join(shown, ["image_id", "bin_id"], "left_semi")
    return sorted(r.bin_id for r in found.select("bin_id").distinct().collect())


def learn_profile(samples: DataFrame, pixels: DataFrame, labels: DataFrame, seeds: DataFrame, *, trust_marks: bool = False) -> tuple[list[Model], list[str]]:
    """Colour bands, shapes, edge bands, veto bars and area thresholds, and
    warnings.

    ``samples``: (bin_id, image_id, hue, sat, val) under the marks;
    ``pixels``: (image_id, y, x, hue, sat, val) of all labelled frames, with
    ``in_region`` where only part of the frame counts;
    ``labels``: usable (image_id, bin_id, label, auto); ``seeds``: marked
    pixels of images taken by hand (image_id, bin_id, y, x).

    Bins that cannot be trained leave the competition and the rest is
    measured again, since their pixels fall to others; at most one round a
    bin.  Areas are measured by the very function that detects.
    """
    rows = learn_color_models(samples, trust_marks=trust_marks).collect()  # one row a bin
    warnings = [f"{r.bin_id}: {t}" for r in rows for t in (r.warnings or [])] + [f"{r.bin_id}: {r.error}" for r in rows if r.error]
    models = to_models([r for r in rows if r.error is None])
    # a frame taken automatically may teach colour and absence, never a positive area
    may = labels.where(~(F.col("auto") & (F.col("label") == "present")))
    shown = labels.where((F.col("label") == "present") & ~F.col("auto")).select("image_id", "bin_id")
    while models:
        for m in models:  # nothing measured among other competitors stays
            m.stats = {k: v for k, v in m.stats.items() if k not in {**_SHAPE, **_EDGE, **_VETO, **_AREA}}
        seen = object_observations(pixels, _table(pixels.sparkSession, models), seeds).join(shown, ["image_id", "bin_id"], "left_semi")
        _observe(models, seen)
        failed: list[str] = []
        for veto, names in ((False, _VETO), (True, _AREA)):
            got = {r.bin_id: r for r in aggregates.area_threshold(_areas(pixels, models, may, veto), ["bin_id"]).collect()}
            failed = [m.id for m in models if m.id not in got]
            if failed:
                break
            for m in models:
                _put(m, got[m.id], names)
                m.min_area_frac = got[m.id].min_area_frac
        if not failed:
            break
        hidden = lost_to_the_band(pixels, models, failed, shown)
        warnings += [f"{b}: not found in any image that shows it" + (": its objects lie within the learned edge band" if b in hidden else "") for b in failed]
        models = [m for m in models if m.id not in failed]
    if len(models) > 1:
        pairs = assign.hue_overlap_pairs(_table(pixels.sparkSession, models)).collect()
        warnings += [f"{r.a}/{r.b}: hue bands overlap" for r in pairs]
    return models, sorted(warnings)


def learn_gates(pixels: DataFrame, frames: DataFrame) -> dict[str, float]:
    """Limits of the four frame gates from the frames that may teach light.

    ``frames``: image_id, ord, current_view, auto, excluded.  Light is that of
    the whole crop, whatever the region.  Without such a frame no gate is armed.
    """
    light = aggregates.frame_light(pixels).join(aggregates.row_duplicate_fraction(pixels), "image_id").join(frames, "image_id")
    r = aggregates.daylight_extrema(light.withColumn("_all", F.lit(1)), ["_all"], ["ord"]).first()
    if r is None:
        return {"daylight_sat_min": 0.0, "daylight_val_max": 1.0, "overexposure_clip_max": 1.0, "row_dup_max": 1.0}
    return {k: float(r[k]) for k in ("daylight_sat_min", "daylight_val_max", "overexposure_clip_max", "row_dup_max")}


def widen_gates(old: dict[str, float], new: dict[str, float]) -> dict[str, float]:
    """Gates only ever widen: the saturation floor falls, the others rise."""
    return {k: (min if k == "daylight_sat_min" else max)(old.get(k, v), v) for k, v in new.items()}


def detect(pixels: DataFrame, models: list[Model]) -> DataFrame:
    """Each frame's verdict on each model: present, margin, uncertain and the
    blob behind it."""
    spark = pixels.sparkSession
    stats = spark.createDataFrame([(m.id, m.min_area_frac, m.stat("min_pos_area_frac"), m.stat("max_neg_area_frac")) for m in models], "bin_id string, min_area_frac double, min_pos double, max_neg double")
    got = raster.resolve_candidates(pixels, models).join(F.broadcast(stats), "bin_id").withColumn("area_frac", F.col("area") / F.col("denom"))
    got = got.withColumns(verdicts.presence(F.col("area_frac"), F.col("min_area_frac")))
    unsure = verdicts.is_uncertain(F.col("area_frac"), F.col("min_pos"), F.col("max_neg"))
    return got.withColumn("uncertain", verdicts.uncertain_verdict(unsure, F.col("conflict_with").isNotNull(), F.col("present"))).drop("min_pos", "max_neg")


def misclassified(detected: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels given by hand that detection contradicts."""
    told = labels.where(~F.col("auto")).select("image_id", "bin_id", "label")
    return detected.join(told, ["image_id", "bin_id"]).where(F.col("present") != (F.col("label") == "present")).select("image_id", "bin_id", "label")


def adoption_regressions(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """(bin_id, reason) against adopting the candidate's models.

    Both tables: bin_id, hue_center, hue_tol, separable, min_pos, max_neg.
    A bin may not vanish, stop separating, or lose ground where it did not
    separate; and no new pair of hue bands may overlap.
    """
    c = candidate.select("bin_id", F.lit(True).alias("_there"), F.col("separable").alias("c_sep"), verdicts.gap_ratio(F.col("min_pos"), F.col("max_neg")).alias("c_gap"))
    got = baseline.withColumn("b_gap", verdicts.gap_ratio(F.col("min_pos"), F.col("max_neg"))).join(c, "bin_id", "left")
    reason = F.when(F.col("_there").isNull(), "no longer trainable").when(F.col("separable") & ~F.coalesce("c_sep", F.lit(False)), "stopped separating").when(~F.coalesce("separable", F.lit(True)) & (F.col("c_gap") < F.col("b_gap")), "overlap grew")
    pairs = assign.hue_overlap_pairs(candidate).exceptAll(assign.hue_overlap_pairs(baseline)).select(F.concat_ws("/", "a", "b").alias("bin_id"), F.lit("hue bands now overlap").alias("reason"))
    return got.withColumn("reason", reason).where("reason is not null").select("bin_id", "reason").unionByName(pairs)


MISTAKES = 100  # named in a refusal; all of them count


def relearn(learn, baseline_evidence, full_evidence, mistakes, *, gates=None, trust_marks: bool = False, save=None) -> dict:
    """Learn with and without the automatically collected evidence and adopt
    the larger set only if it makes nothing worse, or if the marks are trusted.

    ``learn`` turns evidence into (models table, anything); ``mistakes``
    gives the holdout mistakes (path, bin_id) of a models table.  ``gates`` is
    (limits so far, limits now): the result's are widened, never narrowed.
    What was adopted is handed to ``save`` with them.
    """
    from .evidence import new_mistakes

    base, _ = learn(baseline_evidence)
    cand, _ = learn(full_evidence)
    against = [f"{r.bin_id}: {r.reason}" for r in adoption_regressions(base, cand).collect()]  # a few a bin
    worse = new_mistakes(mistakes(base), mistakes(cand))
    against += [f"{r.path}:{r.bin_id}: new mistake" for r in worse.orderBy("path", "bin_id").limit(MISTAKES).collect()]
    adopted = not against or trust_marks
    out = {"models": cand if adopted else base, "adopted": adopted, "forced": adopted and bool(against), "regressions": sorted(against), "pause_collection": not adopted}
    if gates is not None:
        out["gates"] = widen_gates(*gates)
    if save is not None:
        save(out["models"], out.get("gates"))
    return out


def rank_components(regions: DataFrame) -> DataFrame:
    """Components with their rank by area within image and bin."""
    order = Window.partitionBy("image_id", "bin_id").orderBy(F.col("area").desc(), "seed_y", "seed_x")
    return regions.withColumn("rank", F.row_number().over(order))
