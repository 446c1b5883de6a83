"""Further queries: commands on evidence, validation, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, verdicts
from ..operators import aggregates, evidence, learning, raster, regions
from .adapters import catalog, cte, grid8, label_ev, scan, table
from .queries import _NOW, _RECT, _RING, _evidence, _mask, _rects, _rings, query, r

_IMAGES = "img AS (SELECT CAST(image_id AS VARCHAR) AS path, image_id, view_epoch, excluded, auto FROM label_ev)"


@query(cte("label_ev", more=_IMAGES) + " SELECT path, CASE WHEN image_id % 5 = 0 THEN TRUE ELSE excluded END AS excluded FROM img")
def forget_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _evidence(spark, sf_dir)["images"]
    return evidence.set_excluded(images, images.where("ord % 5 = 0"), True).select("path", "excluded")


@query(cte("label_ev", more=_IMAGES) + " SELECT path, auto OR excluded AS excluded FROM img")
def discard_auto_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.set_auto_excluded(_evidence(spark, sf_dir)["images"], True).select("path", "excluded")


@query(cte("label_ev") + """, b(bin_id, a) AS (VALUES ('AUTOMOBILE', 1), ('BUILDING', 2), ('FURNITURE', 0), ('HOUSEHOLD', 0), ('MACHINERY', 3))
SELECT CAST(image_id AS VARCHAR) AS path, bin_id, CASE WHEN image_id % 4 = 0 THEN 'absent' ELSE label END AS label, CASE WHEN image_id % 4 = 0 THEN a ELSE label_epoch END AS label_epoch FROM label_ev JOIN b USING (bin_id) WHERE label IS NOT NULL OR image_id % 4 = 0""")
def set_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth image is labelled anew."""
    t = _evidence(spark, sf_dir)
    given = label_ev(spark, sf_dir).where("image_id % 4 = 0").select(F.col("image_id").cast("string").alias("path"), "bin_id", F.lit("absent").alias("label"))
    return evidence.set_labels(t["labels"], given, t["bins"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 0 WHEN c_custkey % 2 = 0 THEN 1 ELSE 7 END AS view_epoch FROM customer")
def ensure_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries for customers without orders, at the view of their capture."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_custkey").alias("ord"))
    ordered = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ord")).distinct()
    held = c.join(ordered, "ord", "left_semi").select("path", "ord", F.lit(0).alias("view_epoch"), F.lit(False).alias("excluded"), F.lit(False).alias("auto"))
    epochs = c.where("ord % 2 = 0").select("path", F.lit(1).alias("capture_epoch"))
    return evidence.ensure_images(held, c, epochs, 7).select("path", "view_epoch")


@query("SELECT coalesce(n.n_name, o.name) AS name, coalesce(n.n_nationkey, o.k) AS k, n.n_nationkey IS NOT NULL AS active FROM (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n FULL JOIN (SELECT n_nationkey + 2 AS k, 'old' || n_nationkey AS name FROM nation) o ON o.k = n.n_nationkey")
def reconcile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    declared = n.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("bin_id"), F.col("n_name").alias("name"))
    stored = n.select((F.col("n_nationkey") + 2).alias("bin_id"), F.concat(F.lit("old"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(True).alias("active"), F.lit(0).alias("appearance_epoch"))
    return evidence.reconcile_bins(declared, stored).select("name", F.col("bin_id").alias("k"), "active")


@query(cte("catalog") + " SELECT bin_id FROM catalog WHERE separable AND NOT active UNION ALL SELECT 'REGION ' || r_name FROM region")
def stale_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    ghosts = table(spark, sf_dir, "region").select(F.concat(F.lit("REGION "), "r_name").alias("bin_id"))
    return evidence.stale_models(c.where("separable").select("bin_id").union(ghosts), c)


@query(cte("catalog") + """ SELECT 'minimum area out of range' AS rule, bin_id AS item FROM catalog WHERE max_neg * 9 > 1
UNION ALL SELECT 'hue centre out of range', bin_id FROM catalog WHERE hue_center + 100 >= 360
UNION ALL SELECT 'hue tolerance out of range', bin_id FROM catalog WHERE hue_tol * 6 * 2 >= 180
UNION ALL SELECT 'max_neg_area_frac outside [0, 1]', bin_id FROM catalog WHERE max_neg * 8 > 1
UNION ALL SELECT 'daylight_val_max outside [0, 1]', 'profile' FROM region WHERE r_regionkey = 0""")
def profile_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile with some values out of range."""
    none = lambda t: F.lit(None).cast(t)
    m = catalog(spark, sf_dir).select("bin_id", (F.col("hue_center") + 100).alias("hue_center"), (F.col("hue_tol") * 6).alias("hue_tol"), F.lit(0.2).alias("sat_min"), F.lit(0.2).alias("val_min"), (F.col("max_neg") * 9).alias("min_area_frac"), F.col("min_pos").alias("min_pos_area_frac"), (F.col("max_neg") * 8).alias("max_neg_area_frac"),
        *(none("double").alias(c) for c in ("veto_qualify_min_area_frac", "shape_log_aspect_min", "shape_log_aspect_max", "shape_fill_min", "region_edge_depth_min_frac")), *(none("int").alias(c) for c in ("shape_n", "region_edge_depth_n")))
    p = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit(0.1).alias("daylight_sat_min"), F.lit(1.0).alias("overexposure_clip_max"), F.lit(1.5).alias("daylight_val_max"), F.lit(1.0).alias("row_dup_max"), F.lit("bilinear").alias("resample"), F.lit(640).alias("working_width"))
    return evidence.profile_violations(p, m)


@query(cte("label_ev", "bins") + " SELECT image_id, label FROM label_ev WHERE NOT auto AND label IS NOT NULL AND (area_frac >= 0.25) <> (label = 'present')")
def misclassified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels given by hand that a fixed threshold contradicts."""
    e = label_ev(spark, sf_dir).where("label is not null")
    seen = e.select("image_id", "bin_id", verdicts.presence(F.col("area_frac"), F.lit(0.25))["present"].alias("present"))
    return learning.misclassified(seen, e).select("image_id", "label")


@query("WITH e AS (SELECT c_nationkey AS camera, round((c_custkey % 4) / 8.0::DOUBLE, 3) AS x FROM customer) SELECT s_suppkey AS k FROM supplier WHERE EXISTS (SELECT 1 FROM e WHERE e.camera = s_nationkey AND abs(e.x - (s_suppkey % 8) / 8.0::DOUBLE) <= 1e-9)")
def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras already set up with the same region."""
    roi = lambda x: geometry.rect(x, F.lit(0.0), F.lit(0.2), F.lit(1.0))
    held = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("camera"), (F.col("c_custkey") % 4).alias("x")).distinct().select("camera", roi(F.col("x") / 8.0).alias("roi"))
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("camera"), roi(F.col("s_suppkey") % 8 / 8.0).alias("roi"))
    return evidence.same_source(held, asked).select("k")


@query("SELECT p_brand, count(DISTINCT CAST((p_size * 2) / gcd(p_size * 2, p_size % 3 + 1) AS BIGINT) || ':' || CAST((p_size % 3 + 1) / gcd(p_size * 2, p_size % 3 + 1) AS BIGINT)) AS aspects FROM part WHERE p_size >= 1 GROUP BY 1 HAVING aspects > 1")
def mixed_aspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "part").where("p_size >= 1").select("p_brand", (F.col("p_size") * 2).alias("width"), (F.col("p_size") % 3 + 1).alias("height"))
    return evidence.mixed_aspects(sizes, ["p_brand"])


@query(cte("label_ev") + " SELECT bin_id, count(*) AS n FROM label_ev WHERE bin_id <> 'FURNITURE' GROUP BY 1")
def active_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.active_results(label_ev(spark, sf_dir), _evidence(spark, sf_dir)["bins"]).groupBy("bin_id").agg(F.count("*").alias("n"))


@query("WITH " + _RING + " SELECT image_id, round(sum(least(greatest(px * 2 - 0.5, 0), 1)), 6) AS sx, round(sum(least(greatest(py * 2 - 0.5, 0), 1)), 6) AS sy, min(px * 2 - 0.5) < -1e-9 OR min(py * 2 - 0.5) < -1e-9 OR max(px * 2 - 0.5) > 1 + 1e-9 OR max(py * 2 - 0.5) > 1 + 1e-9 AS outside FROM pt GROUP BY 1")
def ring_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings drawn twice as large: clamped, and whether they were valid."""
    big = F.transform("rings", lambda ring: F.transform(ring, lambda p: F.struct((p["x"] * 2 - 0.5).alias("x"), (p["y"] * 2 - 0.5).alias("y"))))
    d = _rings(spark, sf_dir).withColumn("big", big).withColumn("cut", geometry.clamp_rings(F.col("big")))
    total = lambda k: F.aggregate(F.flatten("cut"), F.lit(0.0), lambda a, p: a + p[k])
    return d.select("image_id", r(total("x")).alias("sx"), r(total("y")).alias("sy"), F.coalesce(geometry.rings_error(F.col("big")) == "a vertex lies outside the frame", F.lit(False)).alias("outside"))


@query("WITH " + _RECT + " SELECT k, n, TRUE AS same, CASE WHEN w <= 0 OR h <= 0 THEN NULL ELSE TRUE END AS as_rings, x + w <= 1 + 1e-9 AND y + h <= 1 + 1e-9 AS unit FROM rects")
def ring_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = F.col("rect")
    box = geometry.rings_bbox(geometry.rect_as_rings(rect))
    nudged = geometry.rect_as_rings(geometry.rect(rect["x"] + 1e-10, rect["y"], rect["w"], rect["h"]))
    return _rects(spark, sf_dir).select("k", "n", geometry.rings_equal(geometry.rect_as_rings(rect), nudged).alias("same"), geometry.equal(box, rect).alias("as_rings"), geometry.clamp_unit(rect).isNotNull().alias("unit"))


@query(cte("grid8") + " SELECT image_id, y, x FROM grid8 WHERE (y BETWEEN 1 AND 2 AND x BETWEEN 0 AND 3) OR (y BETWEEN 2 AND 5 AND x = image_id % 8)")
def rect_seed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels under any of a frame's marks."""
    g = grid8(spark, sf_dir).select("image_id", "y", "x")
    ids, i = g.select("image_id").distinct(), lambda v: F.lit(v).cast("int")
    col = (F.col("image_id") % 8).cast("int")
    rects = ids.select("image_id", i(0).alias("x0"), i(1).alias("y0"), i(4).alias("x1"), i(3).alias("y1")).union(ids.select("image_id", col, i(2), col + 1, i(6)))
    return regions.rect_pixels(g, rects)


@query(cte("scan") + ", d AS (SELECT *, event_type <> 'view' AS cur, seq % 3 = 0 AS auto FROM scan), k AS (SELECT camera, median_sat, median_val, clip_frac, row_dup_frac, abs(median_val - lag(median_val) OVER w) AS s FROM d WHERE cur AND NOT auto AND event_type <> 'error' WINDOW w AS (PARTITION BY camera ORDER BY seq)) SELECT camera, round(least(greatest(max(median_val) + coalesce(median(s), 0), 0), 1), 9) AS daylight_val_max FROM k GROUP BY 1")
def daylight_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates from the frames that may teach light."""
    s = scan(spark, sf_dir).withColumns({"current_view": F.col("event_type") != "view", "auto": F.col("seq") % 3 == 0, "excluded": F.col("event_type") == "error"})
    return aggregates.daylight_extrema(s, ["camera"], ["seq"]).select("camera", r("daylight_val_max", 9).alias("daylight_val_max"))


@query(cte("grid8") + ", a AS (SELECT image_id, y, x FROM grid8 WHERE m), b AS (SELECT image_id, y, x FROM grid8 WHERE e > 0.1 OR y < 2) SELECT 'and' AS op, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'or', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'minus', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid8(spark, sf_dir)
    a, b = g.where("m").select("image_id", "y", "x"), g.where("e > 0.1 or y < 2").select("image_id", "y", "x")
    n = lambda d, op: d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return n(regions.mask_and(a, b), "and").union(n(regions.mask_or(a, b), "or")).union(n(regions.mask_minus(a, b), "minus"))


@query(cte("scan") + " SELECT event_id, round(CASE WHEN area_frac > 0 THEN area_frac * 2 * exp(abs(ln(median_sat + 0.1))) / ((1 + exp(abs(ln(median_sat + 0.1)))) * (1 + exp(abs(ln(median_sat + 0.1))))) ELSE 0 END, 8) AS rotated, round(sqrt(area_frac * clip_frac), 8) AS threshold, area_frac > 0.1 AND area_frac < 0.3 OR (clip_frac > 0.5 AND area_frac >= 0.2) AS uncertain FROM scan")
def scalar_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("area_frac")
    unsure = verdicts.uncertain_verdict(verdicts.is_uncertain(a, F.lit(0.3), F.lit(0.1)), F.col("clip_frac") > 0.5, a >= 0.2)
    return scan(spark, sf_dir).select("event_id", r(verdicts.rotated_fill(F.log(F.col("median_sat") + 0.1), a), 8).alias("rotated"), r(verdicts.geometric_threshold(a, F.col("clip_frac")), 8).alias("threshold"), unsure.alias("uncertain"))


@query(cte("ccl") + ", g AS (SELECT image_id, bin_id, seed_y, seed_x, count(*) AS area FROM named GROUP BY ALL) SELECT image_id, bin_id, area, CAST(row_number() OVER (PARTITION BY image_id, bin_id ORDER BY area DESC, seed_y, seed_x) AS INTEGER) AS rank FROM g")
def ranked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.rank_components(raster.component_regions(_mask(spark, sf_dir))).select("image_id", "bin_id", "area", "rank")


@query(cte("label_ev", more=_NOW) + " SELECT bin_id, appearance_epoch + CASE WHEN bin_id = 'BUILDING' THEN 1 ELSE 0 END AS appearance_epoch, (SELECT count(*) FROM label_ev e WHERE e.bin_id = now.bin_id AND label = 'present' AND image_id % 3 = 0 AND NOT excluded AND label_epoch = now.appearance_epoch + CASE WHEN now.bin_id = 'BUILDING' THEN 1 ELSE 0 END) AS samples FROM now")
def appearance_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that count after one bin got a new colour."""
    t = _evidence(spark, sf_dir)
    changed = evidence.mark_appearance_changed(t["bins"], "BUILDING")
    n = evidence.usable_samples(t["samples"], t["images"], changed).groupBy("bin_id").agg(F.count("*").alias("samples"))
    return evidence.active_bins(changed).select("bin_id", "appearance_epoch").join(n, "bin_id", "left").select("bin_id", "appearance_epoch", F.coalesce("samples", F.lit(0)).alias("samples"))
