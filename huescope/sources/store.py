"""Evidence and profiles as JSON documents with a fixed, versioned schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECT = "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"
RINGS = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
#: The document versions written.
STORE_VERSION, PROFILE_VERSION = 4, 1
STORE = f"""schema_version INT, roi {RECT}, roi_polygons {RINGS}, working_width INT, resample STRING, view_epoch INT,
capture_epochs MAP<STRING, INT>, bins ARRAY<STRUCT<id: STRING, name: STRING, active: BOOLEAN, appearance_epoch: INT>>,
images ARRAY<STRUCT<path: STRING, samples: MAP<STRING, ARRAY<STRUCT<rect: {RECT}, roi: {RECT}, epoch: INT>>>, present: ARRAY<STRING>,
absent: ARRAY<STRING>, label_roi: {RECT}, label_polygons: {RINGS}, label_epoch: MAP<STRING, INT>, view_epoch: INT, excluded: BOOLEAN,
auto: STRUCT<median_sat: DOUBLE, median_val: DOUBLE>>>"""
PROFILE = f"""schema_version INT, roi {RECT}, working_width INT, resample STRING, daylight_sat_min DOUBLE, overexposure_clip_max DOUBLE,
daylight_val_max DOUBLE, row_dup_max DOUBLE, roi_polygons {RINGS}, mutual_exclusion BOOLEAN, daylight_stats MAP<STRING, DOUBLE>,
bins ARRAY<STRUCT<id: STRING, name: STRING, hue_center_deg: DOUBLE, hue_tol_deg: DOUBLE, sat_min: DOUBLE, val_min: DOUBLE,
min_area_frac: DOUBLE, learning_stats: STRUCT<shape_n: INT, shape_log_aspect_min: DOUBLE, shape_log_aspect_max: DOUBLE,
shape_fill_min: DOUBLE, region_edge_depth_n: INT, region_edge_depth_min_frac: DOUBLE, veto_qualify_min_area_frac: DOUBLE,
veto_qualify_separable: BOOLEAN, veto_qualify_provisional: BOOLEAN, min_pos_area_frac: DOUBLE, max_neg_area_frac: DOUBLE,
separable: BOOLEAN, provisional: BOOLEAN>>>"""


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file; malformed ones fail the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store of version 2 to 4, brought up to date: later versions only
    added fields, which get their defaults."""
    doc = read_document(spark, path, STORE)
    if not doc.where(f"schema_version is null or schema_version not between 2 and {STORE_VERSION}").isEmpty():
        raise ValueError("unsupported store version")
    return doc.withColumns({"schema_version": F.lit(STORE_VERSION), "view_epoch": F.coalesce("view_epoch", F.lit(0)), "capture_epochs": F.coalesce("capture_epochs", F.create_map().cast("map<string,int>"))})


V1 = f"roi {RECT}, working_width INT, resample STRING, bins ARRAY<STRUCT<id: STRING, name: STRING>>, images ARRAY<STRUCT<path: STRING, samples: MAP<STRING, ARRAY<{RECT}>>, present: ARRAY<STRING>, absent: ARRAY<STRING>>>"


def migrate_v1(old: DataFrame) -> DataFrame:
    """Version 1 kept rectangles relative to the region: they become image
    rectangles with that region as their grid; empty ones are dropped."""
    roi = F.col("roi")
    moved = lambda r: F.struct(F.struct((roi["x"] + r["x"] * roi["w"]).alias("x"), (roi["y"] + r["y"] * roi["h"]).alias("y"), (r["w"] * roi["w"]).alias("w"), (r["h"] * roi["h"]).alias("h")).alias("rect"), roi.alias("roi"), F.lit(0).alias("epoch"))
    samples = lambda m: F.transform_values(m, lambda _, rects: F.transform(F.filter(rects, lambda r: (r["w"] > 0) & (r["h"] > 0)), moved))
    zero = lambda e: F.map_from_entries(F.transform(F.array_union(F.coalesce(e["present"], F.array().cast("array<string>")), F.coalesce(e["absent"], F.array().cast("array<string>"))), lambda b: F.struct(b, F.lit(0))))
    rings = F.lit(None).cast(RINGS)
    image = lambda e: F.struct(e["path"].alias("path"), samples(e["samples"]).alias("samples"), e["present"].alias("present"), e["absent"].alias("absent"), roi.alias("label_roi"), rings.alias("label_polygons"), zero(e).alias("label_epoch"), F.lit(0).alias("view_epoch"), F.lit(False).alias("excluded"), F.lit(None).cast("struct<median_sat:double,median_val:double>").alias("auto"))
    bin_ = lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), F.lit(True).alias("active"), F.lit(0).alias("appearance_epoch"))
    return old.select(F.lit(STORE_VERSION).alias("schema_version"), "roi", rings.alias("roi_polygons"), "working_width", "resample", F.lit(0).alias("view_epoch"), F.create_map().cast("map<string,int>").alias("capture_epochs"), F.transform("bins", bin_).alias("bins"), F.transform("images", image).alias("images"))


def tables(store: DataFrame) -> dict[str, DataFrame]:
    """The document as normalised tables (see ``operators.evidence``)."""
    points = lambda c: F.transform(c, lambda ring: F.transform(ring, lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y"))))
    each = store.select(F.posexplode("images").alias("ord", "e"))
    bins = store.select(F.inline("bins")).withColumnRenamed("id", "bin_id")
    images = each.select("e.path", "ord", "e.view_epoch", "e.excluded", F.col("e.auto").isNotNull().alias("auto"), F.col("e.auto").alias("light"), "e.label_roi", points(F.col("e.label_polygons")).alias("label_rings"))
    said = [each.select("e.path", F.explode(f"e.{k}").alias("bin_id"), F.lit(k).alias("label"), F.col("e.label_epoch").alias("m")) for k in ("present", "absent")]
    labels = said[0].unionByName(said[1]).select("path", "bin_id", "label", F.try_element_at("m", F.col("bin_id")).alias("label_epoch"))
    drawn = each.select("e.path", F.explode("e.samples").alias("bin_id", "r")).select("path", "bin_id", F.posexplode("r").alias("ord", "s"))
    samples = drawn.select("path", "bin_id", "ord", "s.rect", "s.roi", "s.epoch")
    config = store.select("roi", points(F.col("roi_polygons")).alias("rings"), "working_width", "resample", "view_epoch")
    captures = store.select(F.explode("capture_epochs").alias("path", "capture_epoch"))
    return {"bins": bins, "images": images, "labels": labels, "samples": samples, "config": config, "captures": captures}


def document(tables: dict[str, DataFrame]) -> DataFrame:
    """The one-row store document of normalised tables: the other way round."""
    pairs = lambda c: F.transform(c, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    said = tables["labels"].groupBy("path").agg(
        *(F.array_sort(F.collect_set(F.when(F.col("label") == k, F.col("bin_id")))).alias(k) for k in ("present", "absent")),
        F.map_from_entries(F.array_sort(F.collect_set(F.when(F.col("label_epoch").isNotNull(), F.struct("bin_id", "label_epoch"))))).alias("label_epoch"))
    drawn = tables["samples"].groupBy("path", "bin_id").agg(F.array_sort(F.collect_list(F.struct("ord", "rect", "roi", "epoch"))).alias("s"))
    rects = F.transform("s", lambda x: F.struct(x["rect"].alias("rect"), x["roi"].alias("roi"), x["epoch"].alias("epoch")))
    drawn = drawn.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin_id", rects.alias("r"))))).alias("samples"))
    light = "struct<median_sat:double,median_val:double>"
    own = tables["images"].join(said, "path", "left").join(drawn, "path", "left")
    none = F.array().cast("array<string>")
    entry = F.struct(
        "ord", "path", F.coalesce("samples", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<array<struct<rect:{RECT},roi:{RECT},epoch:int>>>"))).alias("samples"),
        F.coalesce("present", none).alias("present"), F.coalesce("absent", none).alias("absent"), "label_roi", pairs(F.col("label_rings")).alias("label_polygons"),
        F.coalesce("label_epoch", F.map_from_arrays(none, F.array().cast("array<int>"))).alias("label_epoch"), "view_epoch", "excluded",
        F.when(F.col("auto"), F.coalesce(F.col("light"), F.struct(F.lit(None).cast("double").alias("median_sat"), F.lit(None).cast("double").alias("median_val")).cast(light))).alias("auto"))
    in_order = lambda a, b: F.signum(a["ord"] - b["ord"]).cast("int")
    images = own.agg(F.array_sort(F.collect_list(entry), in_order).alias("i"))
    images = images.select(F.transform("i", lambda e: F.struct(*(e[c].alias(c) for c in ("path", "samples", "present", "absent", "label_roi", "label_polygons", "label_epoch", "view_epoch", "excluded", "auto")))).alias("images"))
    bins = tables["bins"].agg(F.array_sort(F.collect_list(F.struct(F.col("bin_id").alias("id"), "name", "active", "appearance_epoch"))).alias("bins"))
    captures = tables["captures"].agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "capture_epoch")))).alias("capture_epochs"))
    whole = tables["config"].limit(1)
    for part in (captures, bins, images):  # each is one row
        whole = whole.withColumn("_k", F.lit(1)).join(part.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return whole.select(F.lit(STORE_VERSION).alias("schema_version"), "roi", pairs(F.col("rings")).alias("roi_polygons"), "working_width", "resample", "view_epoch", "capture_epochs", "bins", "images")


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """A store of any version, brought up to date; one of version 1 is first
    copied beside itself, once, before anything can overwrite it."""
    version = spark.read.schema("schema_version INT").option("multiLine", True).json(path).first()
    if version is None or version.schema_version != 1:
        return read_store(spark, path)
    old = read_document(spark, path, V1)
    write_document(old.withColumn("schema_version", F.lit(1)), f"{path}.v1.bak", "ignore")
    return migrate_v1(old)


def save_store(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables' document.  It is brought together first, as it may
    replace the very file that the tables read."""
    doc = document(tables)
    spark = doc.sparkSession
    write_document(spark.createDataFrame(doc.collect(), doc.schema), path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    doc = read_document(spark, path, PROFILE)
    if not doc.where(f"schema_version is null or schema_version <> {PROFILE_VERSION}").isEmpty():
        raise ValueError("unsupported profile version")
    return doc


def profile_models(profile: DataFrame) -> DataFrame:
    """One row a model, statistics as columns."""
    return profile.select(F.inline("bins")).select(F.col("id").alias("bin_id"), "name", F.col("hue_center_deg").alias("hue_center"), F.col("hue_tol_deg").alias("hue_tol"), "sat_min", "val_min", "min_area_frac", "learning_stats.*")


def write_document(doc: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The one-row document as one JSON file; ``mode`` "ignore" makes a backup
    once and never again."""
    doc.limit(1).coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def preserve_unknown(mirror: DataFrame, store: DataFrame, path: str) -> bool:
    """Keep a copy of the mirror if it knows images that the store does not."""
    paths = lambda d: d.select(F.explode("images.path").alias("path"))
    if paths(mirror).join(paths(store), "path", "left_anti").isEmpty():
        return False
    write_document(mirror, path)
    return True
