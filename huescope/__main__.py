"""Command line: keep a store of evidence, learn from it, detect.

python -m huescope init STORE --roi X Y W H [--width N] [--resample KIND] --bin ID=NAME ...
python -m huescope sample STORE --image PATH --bin ID --rect X Y W H [--space roi|image]
python -m huescope label STORE --image PATH [--present ID ...] [--absent ID ...]
python -m huescope validate STORE
python -m huescope view STORE
python -m huescope learn STORE FRAMES PROFILE [--trust-marks]
python -m huescope detect PROFILE FRAMES [--json]

Stores and profiles are JSON documents; FRAMES is a folder of PNG or JPEG
files.  The exit status is 1 after an error or where nothing was learned.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color, geometry
from .operators import detector, evidence, learning, raster
from .sources import frames, store

WHOLE = (0.0, 0.0, 1.0, 1.0)


@dataclass
class Learned:
    """What one run of learning found, and the view that it holds for."""

    models: list[raster.Model]
    warnings: list[str]
    gates: dict[str, float]
    roi: tuple
    rings: list | None = None
    width: int | None = None
    resample: str = "bilinear"
    stats: dict[str, float] = field(default_factory=dict)


def _named(spark: SparkSession, folder: str) -> DataFrame:
    return frames.read_frames(spark, folder).withColumn("file", F.regexp_extract("path", "[^/]+$", 0)).withColumn("image_id", F.xxhash64("file"))


def _frame_id(path: str = "path"):
    return F.xxhash64(F.regexp_extract(path, "[^/]+$", 0))


def _hsv(px: DataFrame) -> DataFrame:
    return px.withColumns(color.rgb_to_hsv(*(F.col(c) / 255.0 for c in ("r8", "g8", "b8"))))


def _rings(rings) -> list | None:
    return None if rings is None else [[(p["x"], p["y"]) for p in ring] for ring in rings]


def learn(spark: SparkSession, store_path: str, folder: str, trust_marks: bool = False) -> Learned:
    """Models, gates and warnings from what the store's learning view lets count."""
    tables = store.tables(store.open_store(spark, store_path))
    order = [tables[k] for k in ("bins", "images", "labels", "samples", "config")]
    bad = evidence.store_violations(*order)
    broken = bad.orderBy("rule", "item").limit(20).collect()
    if broken:
        raise ValueError(f"{bad.count()} violations, among them " + "; ".join(f"{r.rule}: {r.item}" for r in broken))
    config = tables["config"].first()
    out = Learned([], [], {}, tuple(config.roi), _rings(config.rings), config.working_width, config.resample or "bilinear")
    named = _named(spark, folder)
    pixels = _hsv(frames.frame_pixels(named, out.roi, out.width, out.resample, out.rings))
    images = tables["images"].withColumn("image_id", _frame_id())
    told = evidence.usable_labels(tables["labels"], tables["images"], tables["samples"], tables["bins"], tables["config"]).where("usable").join(images.select("path", "auto", "image_id"), "path")
    labels = told.select("image_id", "bin_id", "label", "auto")
    drawn = evidence.usable_samples(tables["samples"], tables["images"], tables["bins"]).join(images.select("path", "auto", "image_id", "view_epoch"), "path")
    # colours are taken on the grid of the region that each mark was drawn in, of any view
    marked = frames.marked_pixels(named, drawn.select("image_id", "bin_id", "auto", "ord", "rect", "roi"), out.width, out.resample)
    samples = _hsv(marked.where("error is null")).select("bin_id", "image_id", "hue", "sat", "val")
    # shapes are looked up on the grid of the region that counts now
    size = pixels.where("y is not null").groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    box = geometry.to_pixels(geometry.image_to_roi(F.col("rect"), geometry.rect(*(F.lit(v) for v in out.roi))), F.col("w"), F.col("h"))
    own = drawn.where(~F.col("auto") & (F.col("view_epoch") == config.view_epoch)).join(size, "image_id").withColumn("box", box).where("box is not null").select("image_id", "bin_id", "box.*")
    cells = own.select("image_id", "bin_id", "x0", "x1", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y")).select("image_id", "bin_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")).distinct()
    readable = pixels.where("y is not null")
    out.models, out.warnings = learning.learn_profile(samples, readable, labels, cells, trust_marks=trust_marks)
    light = images.select("image_id", "ord", (F.col("view_epoch") == config.view_epoch).alias("current_view"), "auto", "excluded")
    out.gates = learning.learn_gates(readable, light)
    unread = named.join(pixels.where("y is null"), "image_id", "left_semi").select("file")
    missing = tables["images"].where(~F.col("excluded")).withColumn("image_id", _frame_id()).join(named, "image_id", "left_anti").select("path")
    aspects = evidence.mixed_aspects(size.select(F.lit("all").alias("k"), F.col("w").alias("width"), F.col("h").alias("height")), ["k"])
    out.warnings += [f"{r.file}: cannot be read" for r in unread.orderBy("file").limit(100).collect()] + [f"{r.path}: missing" for r in missing.orderBy("path").limit(100).collect()]
    out.warnings += [] if aspects.isEmpty() else ["frames of different aspect ratios"]
    set_aside = evidence.warnings(evidence.usable_labels(tables["labels"], tables["images"], tables["samples"], tables["bins"], tables["config"]), tables["samples"], tables["images"], tables["bins"])
    out.warnings += [f"{r.kind}: {r.n}" for r in set_aside.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()]
    return out


def profile_document(spark: SparkSession, learned: Learned) -> DataFrame:
    """What was learned as a one-row profile document."""
    keys = [f.split(":")[0].strip() for f in store.PROFILE.split("learning_stats: STRUCT<")[1].split(">>>")[0].split(",")]
    bins = [(m.id, m.id, m.hue, m.tol, m.sat_min, m.val_min, m.min_area_frac, tuple(m.stat(k) for k in keys)) for m in learned.models]
    rings = None if learned.rings is None else [[list(p) for p in ring] for ring in learned.rings]
    g = learned.gates
    return spark.createDataFrame([(store.PROFILE_VERSION, tuple(map(float, learned.roi)), learned.width, learned.resample, g["daylight_sat_min"], g["overexposure_clip_max"], g["daylight_val_max"], g["row_dup_max"], rings, True, None, bins)], store.PROFILE)


def detect(spark: SparkSession, profile_path: str, folder: str) -> DataFrame:
    """Verdicts on every frame of the folder, one row a frame and model; a
    frame that cannot be read is one row with its error."""
    doc = store.read_profile(spark, profile_path)
    head = doc.first()
    models = learning.to_models(store.profile_models(doc).collect())
    bad = evidence.profile_violations(doc, store.profile_models(doc)).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.item}" for r in bad))
    limits = {"sat_min": head.daylight_sat_min, "val_max": head.daylight_val_max, "clip_max": head.overexposure_clip_max, "row_dup_max": head.row_dup_max}
    named = _named(spark, folder)
    found = detector.detect(named, models, limits, roi=tuple(head.roi), working_width=head.working_width, resample=head.resample or "bilinear", rings=head.roi_polygons, exclusion=bool(head.mutual_exclusion))
    return found.join(named.select("image_id", "file"), "image_id")


def _bin(spec: str) -> tuple[str, str]:
    name, eq, title = spec.partition("=")
    if not eq or not name:
        raise argparse.ArgumentTypeError(f"{spec!r} must be ID=NAME")
    return name, title or name


def _create(spark: SparkSession, given) -> int:
    empty = spark.createDataFrame([(store.STORE_VERSION, tuple(given.roi), None, given.width, given.resample, 0, {}, [(i, n, True, 0) for i, n in given.bin], [])], store.STORE)
    tables = store.tables(empty)
    broken = evidence.store_violations(*(tables[k] for k in ("bins", "images", "labels", "samples", "config"))).collect()
    roi = tuple(given.roi)
    if broken or min(roi) < 0 or roi[2] <= 0 or roi[3] <= 0 or roi[0] + roi[2] > 1 + 1e-9 or roi[1] + roi[3] > 1 + 1e-9:
        raise ValueError("; ".join(f"{r.rule}: {r.item}" for r in broken) or "the region leaves the frame")
    store.write_document(empty, given.store)
    print(f"{given.store}: {len(given.bin)} bins")
    return 0


def _with_image(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    view = tables["config"].first().view_epoch
    paths = spark.createDataFrame([(path,)], "path string")
    return tables | {"images": evidence.ensure_images(tables["images"], paths, tables["captures"], view).withColumn("ord", F.col("ord").cast("int"))}


def _sample(spark: SparkSession, given) -> int:
    tables = _with_image(spark, store.tables(store.open_store(spark, given.store)), given.image)
    config = tables["config"].first()
    rect = geometry.rect(*(F.lit(float(v)) for v in given.rect))
    roi = geometry.rect(*(F.lit(float(v)) for v in config.roi))
    if given.space == "roi":
        rect = geometry.roi_to_image(rect, roi)
    known = tables["samples"].where((F.col("path") == given.image) & (F.col("bin_id") == given.bin)).count()
    # drawn in the current region where that holds it, else on the whole frame
    grid = F.when(geometry.contains(roi, rect), roi).otherwise(geometry.rect(*(F.lit(v) for v in WHOLE)))
    one = spark.range(1).select(F.lit(given.image).alias("path"), F.lit(given.bin).alias("bin_id"), F.lit(known).alias("ord"), rect.alias("rect"), grid.alias("roi"))
    if one.where("rect is not null").join(tables["bins"], "bin_id").isEmpty():
        raise ValueError("an undeclared bin, or a rectangle outside the frame")
    store.save_store(tables | {"samples": evidence.add_samples(tables["samples"], one, tables["bins"])}, given.store)
    print(f"{given.image}: a mark of {given.bin}")
    return 0


def _label(spark: SparkSession, given) -> int:
    tables = _with_image(spark, store.tables(store.open_store(spark, given.store)), given.image)
    said = [(given.image, b, k) for k, bins in (("present", given.present), ("absent", given.absent)) for b in bins]
    if not said:
        raise ValueError("no label given")
    labels = evidence.set_labels(tables["labels"], spark.createDataFrame(said, "path string, bin_id string, label string"), tables["bins"])
    config = tables["config"].first()
    now = geometry.rect(*(F.lit(float(v)) for v in config.roi))
    rings = tables["config"].select("rings").first().rings
    rings = F.lit(None).cast(tables["images"].schema["label_rings"].dataType) if rings is None else F.array(*(F.array(*(F.struct(F.lit(p.x).alias("x"), F.lit(p.y).alias("y")) for p in ring)) for ring in rings))
    images = evidence.confirm_view(tables["images"], given.image, now, rings, config.view_epoch)
    store.save_store(tables | {"labels": labels, "images": images}, given.store)
    print(f"{given.image}: present {', '.join(given.present) or '-'}; absent {', '.join(given.absent) or '-'}")
    return 0


def _validate(spark: SparkSession, given) -> int:
    tables = store.tables(store.open_store(spark, given.store))
    n = 0
    for r in evidence.store_violations(*(tables[k] for k in ("bins", "images", "labels", "samples", "config"))).orderBy("rule", "item").toLocalIterator():
        n += 1
        print(f"{r.rule}: {r.item}")
    return 1 if n else 0


def _view(spark: SparkSession, given) -> int:
    tables = store.tables(store.open_store(spark, given.store))
    told = evidence.usable_labels(tables["labels"], tables["images"], tables["samples"], tables["bins"], tables["config"])
    for r in told.orderBy("path", "bin_id").toLocalIterator():
        print(f"{r.path} {r.bin_id} {r.label} {'counts' if r.usable else 'set aside'}")
    return 0


def _learn(spark: SparkSession, given) -> int:
    found = learn(spark, given.store, given.frames, given.trust_marks)
    store.write_document(profile_document(spark, found), given.profile)
    print(f"learned {', '.join(m.id for m in found.models) or 'nothing'}")
    for m in found.models:
        print(f"  {m.id}: hue {m.hue:.1f} +- {m.tol:.1f}, sat from {m.sat_min:.2f}, val from {m.val_min:.2f}, area from {m.min_area_frac:.4f} ({m.stat('n_pos')} positive, {m.stat('n_neg')} negative, separable {m.stat('separable')})")
    print(*found.warnings, sep="\n", file=sys.stderr)
    return 0 if found.models else 1


def _detect(spark: SparkSession, given) -> int:
    found = detect(spark, given.profile, given.frames).orderBy("file", "bin_id")
    if given.json:
        found = found.select(frames.to_result_json(F.struct("*")).alias("json"))
    for r in found.toLocalIterator():
        if given.json:
            print(r.json)
        elif r.error:
            print(f"{r.file}: cannot be read ({r.error})")
        else:
            print(f"{r.file}: {'PRESENT' if r.present else 'absent '} {r.bin_id} (area {r.area_frac:.4f} against {r.min_area_frac:.4f}, margin {r.margin:.2f}{', uncertain' if r.uncertain else ''}, {r.outcome})")
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="huescope", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, *places: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for p in places:
            sub.add_argument(p)
        sub.set_defaults(run=run)
        return sub

    init = command("init", _create, "store")
    init.add_argument("--roi", nargs=4, type=float, required=True, metavar=("X", "Y", "W", "H"))
    init.add_argument("--width", type=int)
    init.add_argument("--resample", choices=("bilinear", "nearest"), default="bilinear")
    init.add_argument("--bin", action="append", type=_bin, required=True, metavar="ID=NAME")
    sample = command("sample", _sample, "store")
    sample.add_argument("--image", required=True)
    sample.add_argument("--bin", required=True)
    sample.add_argument("--rect", nargs=4, type=float, required=True, metavar=("X", "Y", "W", "H"))
    sample.add_argument("--space", choices=("roi", "image"), default="roi")
    label = command("label", _label, "store")
    label.add_argument("--image", required=True)
    label.add_argument("--present", action="append", default=[])
    label.add_argument("--absent", action="append", default=[])
    command("validate", _validate, "store")
    command("view", _view, "store")
    command("learn", _learn, "store", "frames", "profile").add_argument("--trust-marks", action="store_true")
    command("detect", _detect, "profile", "frames").add_argument("--json", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    given = parser().parse_args(argv)
    spark = SparkSession.builder.appName("huescope").getOrCreate()
    try:
        return given.run(spark, given)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
