"""One query for each operator, and the same in DuckDB's SQL where it can.

Doubles are rounded on both sides, since the driver compares values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, geometry, verdicts
from ..operators import aggregates, assign, evidence, learning, raster, regions, reservoir
from ..streaming import stability
from .adapters import bins, catalog, cte, grid8, hsv, label_ev, px, scan, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6) -> Column:
    return F.round(c, digits)


LIMITS = {"sat_min": 0.5, "val_max": 0.85, "clip_max": 0.06, "row_dup_max": 0.5}
_DISTANCE = "abs((CASE WHEN hue - hue_center + 180 < 0 THEN (hue - hue_center + 180) + 360 ELSE (hue - hue_center + 180) % 360 END) - 180)"
PLAIN = f"m AS (SELECT h.*, b.bin_id, {_DISTANCE} AS d FROM hsv h JOIN bins b ON {_DISTANCE} <= hue_tol AND sat >= sat_min AND val >= val_min)"


# Flagship ---------------------------------------------------------------------------------


@query(cte("hsv", "bins", more=PLAIN) + """
, a AS (SELECT image_id, bin_id, count(*) AS area FROM m GROUP BY ALL), n AS (SELECT image_id, count(*) AS denom FROM px GROUP BY ALL)
SELECT image_id, b.bin_id, CAST(coalesce(area, 0) AS BIGINT) AS area, round(coalesce(area, 0) / denom, 9) AS area_frac, coalesce(area, 0) / denom >= min_area_frac AS present,
  round(coalesce(area, 0) / denom / min_area_frac, 9) AS margin
FROM n CROSS JOIN bins b LEFT JOIN a USING (image_id, bin_id)""")
def bin_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which classes are present in each frame?"""
    p, b = hsv(spark, sf_dir), bins(spark)
    area = assign.match_models(p, b).groupBy("image_id", "bin_id").agg(F.count("*").alias("area"))
    # a frame with each of the few models, whether it found pixels or not
    every = p.groupBy("image_id").agg(F.count("*").alias("denom")).join(assign.models_side(b.select("bin_id", "min_area_frac")))
    got = every.join(area, ["image_id", "bin_id"], "left").withColumn("area", F.coalesce("area", F.lit(0)))
    v = verdicts.presence(F.col("area") / F.col("denom"), F.col("min_area_frac"))
    return got.select("image_id", "bin_id", "area", r(F.col("area") / F.col("denom"), 9).alias("area_frac"), v["present"].alias("present"), r(v["margin"], 9).alias("margin"))


# Scalars ----------------------------------------------------------------------------------


@query(cte("hsv") + " SELECT image_id, y, x, round(hue, 6) AS hue, round(sat, 6) AS sat, round(val, 6) AS val FROM hsv")
def rgb_to_hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hsv(spark, sf_dir).select("image_id", "y", "x", *(r(c).alias(c) for c in ("hue", "sat", "val")))


@query(cte("hsv", "bins") + " SELECT image_id, y, x, bin_id, round(abs((hue - hue_center + 540) % 360 - 180), 6) AS distance FROM hsv CROSS JOIN bins")
def circular_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = hsv(spark, sf_dir)
    d = color.circular_distance(F.col("hue"), F.col("hue_center"))
    return p.join(assign.models_side(bins(spark))).select("image_id", "y", "x", "bin_id", r(d).alias("distance"))


_MEAN = """, s AS (SELECT image_id, sum({w} * cos(radians(hue))) AS c, sum({w} * sin(radians(hue))) AS s, sum({w}) AS w FROM hsv WHERE hue IS NOT NULL GROUP BY 1)
SELECT image_id, round(CASE WHEN degrees(atan2(s, c)) < 0 THEN degrees(atan2(s, c)) + 360 ELSE degrees(atan2(s, c)) END, 6) AS mean_deg, round(sqrt(c * c + s * s) / w, 6) AS resultant FROM s"""


@query(cte("hsv") + _MEAN.replace("{w}", "1.0::DOUBLE"))
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aggregates.circular_mean(hsv(spark, sf_dir), ["image_id"], "hue")
    return got.select("image_id", r("mean_deg").alias("mean_deg"), r("resultant").alias("resultant"))


@query(cte("hsv") + _MEAN.replace("{w}", "sat * val"))
def circular_mean_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = hsv(spark, sf_dir).withColumn("w", color.chroma(F.col("sat"), F.col("val")))
    got = aggregates.circular_mean(p, ["image_id"], "hue", "w")
    return got.select("image_id", r("mean_deg").alias("mean_deg"), r("resultant").alias("resultant"))


@query(cte("scan") + " SELECT event_id, round(CASE WHEN area_frac <= 0 THEN 0 WHEN area_frac >= 1 THEN 1e9 ELSE area_frac * (2 - area_frac * area_frac) / (1 - area_frac * area_frac) END, 6) AS kappa FROM scan")
def kappa_from_resultant(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = color.kappa_from_resultant(F.col("area_frac"))
    return scan(spark, sf_dir).select("event_id", r(F.when(k == float("inf"), 1e9).otherwise(k)).alias("kappa"))


# the integral of exp(x cos t) over a circle, by equal steps; past the double range its leading term
@query(cte("scan") + """ SELECT event_id, round(CASE WHEN abs(area_frac * 50) <= 700
THEN abs(area_frac * 50) + ln(list_sum(list_transform(range(0, 1024), lambda k: exp(abs(area_frac * 50) * (cos(2 * pi() * k / 1024) - 1)))) / 1024)
ELSE abs(area_frac * 50) - 0.5::DOUBLE * ln(2 * pi() * abs(area_frac * 50)) END, 6) AS log_i0 FROM scan""")
def log_i0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).select("event_id", r(color.log_i0(F.col("area_frac") * 50)).alias("log_i0"))


@query(cte("hsv") + " SELECT image_id, y, x, round(60 / (255 * sat * val), 6) AS quantum, round(1 / (radians(60 / (255 * sat * val) / 2) ** 2), 3) AS kappa_cap, greatest(r8, g8, b8) >= 254 AS clipped FROM hsv WHERE hue IS NOT NULL AND sat * val > 0.01")
def hue_quantum(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = color.chroma(F.col("sat"), F.col("val"))
    p = hsv(spark, sf_dir).where(F.col("hue").isNotNull() & (c > 0.01))
    return p.select("image_id", "y", "x", r(color.hue_quantum(c)).alias("quantum"), r(color.kappa_cap(c), 3).alias("kappa_cap"), color.is_clipped(F.col("r8"), F.col("g8"), F.col("b8")).alias("clipped"))


@query(cte("scan") + ", l AS (SELECT *, lag(median_sat) OVER w AS ps, lag(median_val) OVER w AS pv FROM scan WINDOW w AS (PARTITION BY camera ORDER BY seq)) SELECT camera, seq, round(greatest(abs(median_sat - ps), abs(median_val - pv)), 9) AS distance FROM l WHERE ps IS NOT NULL")
def regime_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("camera").orderBy("seq")
    s = scan(spark, sf_dir).withColumns({"ps": F.lag("median_sat").over(by), "pv": F.lag("median_val").over(by)}).where("ps is not null")
    return s.select("camera", "seq", r(color.regime_distance(*(F.col(c) for c in ("median_sat", "median_val", "ps", "pv"))), 9).alias("distance"))


# Geometry ---------------------------------------------------------------------------------

_RECT = """rects AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey % 50) / 100.0::DOUBLE AS x, (l_suppkey % 50) / 100.0::DOUBLE AS y, (l_quantity + 0.5) / 110.0::DOUBLE AS w, (l_quantity % 20 + 1) / 41.0::DOUBLE AS h, CAST(l_quantity AS INTEGER) * 8 AS width, 200 + l_linenumber AS height FROM lineitem)"""


def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    rect = geometry.rect(F.col("l_partkey") % 50 / 100.0, F.col("l_suppkey") % 50 / 100.0, (q + 0.5) / 110.0, (q % 20 + 1) / 41.0)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), rect.alias("rect"), (q.cast("int") * 8).alias("width"), (F.lit(200) + F.col("l_linenumber")).alias("height"))


def _flat(c: Column, *names: str, digits: int | None = 9) -> list[Column]:
    return [(r(c[n], digits) if digits else c[n]).alias(n) for n in names]


_BOX = """, b AS (SELECT *, x + w <= 1 + 1e-9 AND y + h <= 1 + 1e-9 AS ok,
  least(greatest(CAST(round_even(x * width, 0) AS INTEGER), 0), width) AS bx0, least(greatest(CAST(round_even((x + w) * width, 0) AS INTEGER), 0), width) AS bx1,
  least(greatest(CAST(round_even(y * height, 0) AS INTEGER), 0), height) AS by0, least(greatest(CAST(round_even((y + h) * height, 0) AS INTEGER), 0), height) AS by1 FROM rects)"""


@query("WITH " + _RECT + _BOX + """
SELECT k, n, CASE WHEN ok AND bx1 > bx0 AND by1 > by0 THEN bx0 END AS x0, CASE WHEN ok AND bx1 > bx0 AND by1 > by0 THEN by0 END AS y0,
  CASE WHEN ok AND bx1 > bx0 AND by1 > by0 THEN bx1 END AS x1, CASE WHEN ok AND bx1 > bx0 AND by1 > by0 THEN by1 END AS y1,
  CASE WHEN NOT ok THEN 'outside the frame' WHEN NOT (bx1 > bx0 AND by1 > by0) THEN 'no pixel left' END AS error FROM b""")
def roi_to_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rects(spark, sf_dir)
    box = geometry.to_pixels(F.col("rect"), F.col("width"), F.col("height"))
    return d.select("k", "n", *_flat(box, "x0", "y0", "x1", "y1", digits=None), geometry.to_pixels_error(F.col("rect"), F.col("width"), F.col("height")).alias("error"))


@query("WITH " + _RECT + ", c AS (SELECT *, x >= 0.1 - 1e-9 AND y >= 0.05 - 1e-9 AND x + w <= 0.9 + 1e-9 AND y + h <= 0.95 + 1e-9 AS ok FROM rects)"
       " SELECT k, n, CASE WHEN ok THEN round(greatest((x - 0.1) / 0.8, 0), 9) END AS x, CASE WHEN ok THEN round(greatest((y - 0.05) / 0.9, 0), 9) END AS y,"
       " CASE WHEN ok THEN round(least(w / 0.8, 1 - greatest((x - 0.1) / 0.8, 0)), 9) END AS w, CASE WHEN ok THEN round(least(h / 0.9, 1 - greatest((y - 0.05) / 0.9, 0)), 9) END AS h FROM c".replace("0.8", "0.8::DOUBLE").replace("0.9)", "0.9::DOUBLE)"))
def image_rect_in_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = geometry.image_to_roi(F.col("rect"), geometry.rect(0.1, 0.05, 0.8, 0.9))
    return _rects(spark, sf_dir).select("k", "n", *_flat(got, "x", "y", "w", "h"))


@query("WITH " + _RECT + " SELECT k, n, round(0.1 + x * 0.8, 9) AS x, round(0.05 + y * 0.9, 9) AS y, round(w * 0.8, 9) AS w, round(h * 0.9, 9) AS h FROM rects WHERE x + w <= 1 AND y + h <= 1")
def roi_rect_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rects(spark, sf_dir).where("rect.x + rect.w <= 1 and rect.y + rect.h <= 1")
    return d.select("k", "n", *_flat(geometry.roi_to_image(F.col("rect"), geometry.rect(0.1, 0.05, 0.8, 0.9)), "x", "y", "w", "h"))


@query("WITH " + _RECT + _BOX + " SELECT k, n, round(0.1 + bx0 * 0.5 / width, 6) AS x, round(0.2 + by0 * 0.4 / height, 6) AS y, round((bx1 - bx0) * 0.5 / width, 6) AS w, round((by1 - by0) * 0.4 / height, 6) AS h, round(0.1 + (bx0 + 0.5) * 0.5 / width, 6) AS cx, round(0.2 + (by0 + 0.5) * 0.4 / height, 6) AS cy FROM b WHERE ok AND bx1 > bx0 AND by1 > by0")
def box_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop, w, h = geometry.rect(0.1, 0.2, 0.5, 0.4), F.col("width"), F.col("height")
    d = _rects(spark, sf_dir).withColumn("box", geometry.to_pixels(F.col("rect"), w, h)).where("box is not null")
    mid = geometry.point_to_image(F.col("box.x0"), F.col("box.y0"), w, h, crop)
    return d.select("k", "n", *_flat(geometry.box_to_image(F.col("box"), w, h, crop), "x", "y", "w", "h", digits=6), r(mid["x"]).alias("cx"), r(mid["y"]).alias("cy"))


@query("WITH " + _RECT + " SELECT k, n, x >= 0.1 - 1e-9 AND y >= 0.1 - 1e-9 AND x + w <= 0.7 + 1e-9 AND y + h <= 0.8 + 1e-9 AS inside, abs(x - 0.3) <= 1e-9 AND abs(y - 0.3) <= 1e-9 AS same_corner, greatest(CAST(round_even(CAST(320 * h / w AS DOUBLE), 0) AS INTEGER), 1) AS grid_h FROM rects")
def roi_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = F.col("rect")
    corner = geometry.equal(rect, geometry.rect(F.lit(0.3), F.lit(0.3), rect["w"], rect["h"]))
    return _rects(spark, sf_dir).select("k", "n", geometry.contains(geometry.rect(0.1, 0.1, 0.6, 0.7), rect).alias("inside"), corner.alias("same_corner"), geometry.region_grid(rect, F.lit(320))["h"].alias("grid_h"))


_RING = "ring AS (SELECT vec_id AS image_id, unnest(range(0, 6)) AS v, embedding FROM embeddings), pt AS (SELECT image_id, v, 0.5 + CAST(embedding[2 * v + 1] AS DOUBLE) AS px, 0.5 + CAST(embedding[2 * v + 2] AS DOUBLE) AS py FROM ring)"


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of six vertices from each embedding's first twelve components."""
    at = lambda v, k: F.element_at("embedding", 2 * v + k).cast("double") + 0.5
    ring = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda v: F.struct(at(v, 1).alias("x"), at(v, 2).alias("y")))
    return table(spark, sf_dir, "embeddings").where("size(embedding) >= 12").select(F.col("vec_id").alias("image_id"), F.array(ring).alias("rings"))


@query("WITH " + _RING + " SELECT image_id, round(min(px), 9) AS x, round(min(py), 9) AS y, round(max(px) - min(px), 9) AS w, round(max(py) - min(py), 9) AS h FROM pt GROUP BY 1")
def rings_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("image_id", *_flat(geometry.rings_bbox(F.col("rings")), "x", "y", "w", "h"))


_EDGE = ", e AS (SELECT a.image_id, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS b_y FROM pt a JOIN pt b ON a.image_id = b.image_id AND b.v = (a.v + 1) % 6)"


@query("WITH " + _RING + _EDGE + """, cell AS (SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, (x + 0.5) / 16.0::DOUBLE AS cx, (y + 0.5) / 12.0::DOUBLE AS cy FROM range(12) t(y) CROSS JOIN range(16) u(x))
SELECT image_id, y, x FROM cell JOIN e ON ay <> b_y AND least(ay, b_y) <= cy AND cy < greatest(ay, b_y) AND cx < ax + (cy - ay) * (bx - ax) / (b_y - ay) GROUP BY ALL HAVING count(*) % 2 = 1""")
def polygon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = regions.pixel_grid(_rings(spark, sf_dir).withColumns({"width": F.lit(16), "height": F.lit(12)}))
    return regions.polygon_mask(grid, F.col("rings"), geometry.rect(0, 0, 1, 1)).select("image_id", "y", "x")


@query("WITH " + _RING + _EDGE + ", q AS (SELECT image_id, count(*) FILTER (WHERE ay <> b_y AND least(ay, b_y) <= 0.5 AND 0.5 < greatest(ay, b_y) AND 0.5 < ax + (0.5 - ay) * (bx - ax) / (b_y - ay)) AS n FROM e GROUP BY 1) SELECT image_id, n % 2 = 1 AS inside FROM q")
def point_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rings(spark, sf_dir).select("image_id", geometry.point_in_region(F.col("rings"), F.lit(0.5), F.lit(0.5)).alias("inside"))


@query(cte("grid8") + """, c AS (SELECT image_id, y, x FROM grid8 WHERE m OR (y BETWEEN 2 AND 5)), n AS (SELECT DISTINCT image_id, y + dy AS ry, x + dx AS rx FROM c, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)),
rim AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.image_id = n.image_id AND c.y = n.ry AND c.x = n.rx))
SELECT c.image_id, c.y, c.x, CAST(min(greatest(abs(c.y - ry), abs(c.x - rx))) AS INTEGER) AS depth FROM c JOIN rim USING (image_id) GROUP BY ALL""")
def interior_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.interior_depths(grid8(spark, sf_dir).where("m or y between 2 and 5"))


@query("WITH " + _RING + _EDGE + """, bb AS (SELECT image_id, min(px) AS ox, min(py) AS oy, max(px) - min(px) AS ow, max(py) - min(py) AS oh FROM pt GROUP BY 1),
g AS (SELECT *, greatest(CAST(round_even(CAST(20 * oh / ow AS DOUBLE), 0) AS INTEGER), 1) AS gh FROM bb),
c AS (SELECT image_id, ox + (i + 0.5) / 20 * ow AS cx, oy + (j + 0.5) / gh * oh AS cy, 0.45 AS lo, 0.55 AS hi FROM g, range(20) t(i), range(200) u(j) WHERE j < gh),
k AS (SELECT * FROM c WHERE lo < cx AND cx < hi AND lo <= cy AND cy < hi),
o AS (SELECT k.image_id, cx, cy, count(ax) % 2 = 1 AS inside FROM k LEFT JOIN e ON e.image_id = k.image_id AND ay <> b_y AND least(ay, b_y) <= cy AND cy < greatest(ay, b_y) AND cx < ax + (cy - ay) * (bx - ax) / (b_y - ay) GROUP BY ALL),
v AS (SELECT image_id, bool_and(inside) AS all_in FROM o GROUP BY 1)
SELECT image_id, ox <= 0.45 + 1e-9 AND oy <= 0.45 + 1e-9 AND ox + ow >= 0.55 - 1e-9 AND oy + oh >= 0.55 - 1e-9 AND coalesce(all_in, FALSE) AS contains FROM bb LEFT JOIN v USING (image_id)""")
def region_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each polygon hold the square in the middle?"""
    d = _rings(spark, sf_dir).withColumn("box", geometry.rings_bbox(F.col("rings")))
    got = regions.contains(F.col("box"), F.col("rings"), geometry.rect(0.45, 0.45, 0.1, 0.1), F.lit(None).cast(d.schema["rings"].dataType), F.lit(20))
    return d.select("image_id", F.coalesce(got, F.lit(False)).alias("contains"))


@query("""WITH p AS (SELECT p_partkey AS k, unnest(range(0, 3)) AS pos, p_size FROM part), t AS (SELECT k, pos, ((p_size * (pos + 3) * 7) % 50) / 50.0::DOUBLE AS x, ((p_size * (pos + 1) * 11 + pos * 17) % 50) / 50.0::DOUBLE AS y FROM p),
d AS (SELECT a.k, min(sqrt(((a.x - b.x) * 1.6) * ((a.x - b.x) * 1.6) + (a.y - b.y) * (a.y - b.y))) / 2 AS rr FROM t a JOIN t b ON a.k = b.k AND a.pos < b.pos GROUP BY 1)
SELECT k, CAST(pos AS INTEGER) AS pos, round(greatest(x - rr / 1.6, 0), 9) AS px, round(greatest(y - rr, 0), 9) AS py, round(least(x + rr / 1.6, 1) - greatest(x - rr / 1.6, 0), 9) AS pw, round(least(y + rr, 1) - greatest(y - rr, 0), 9) AS ph FROM t JOIN d USING (k)""")
def tap_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("pos"), "p_size")
    t = t.select("k", "pos", (F.col("p_size") * (F.col("pos") + 3) * 7 % 50 / 50.0).alias("x"), ((F.col("p_size") * (F.col("pos") + 1) * 11 + F.col("pos") * 17) % 50 / 50.0).alias("y"))
    return regions.tap_patches(t, ["k"], F.lit(1.6)).select("k", "pos", *(r(c, 9).alias(c) for c in ("px", "py", "pw", "ph")))


@query("SELECT p_partkey AS k, regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g') AS slug, CAST(p_size / gcd(p_size, p_partkey % 40 + 1) AS BIGINT) || ':' || CAST((p_partkey % 40 + 1) / gcd(p_size, p_partkey % 40 + 1) AS BIGINT) AS aspect, '/media/' || p_type || '.jpg' AS path, p_type || '.jpg' AS relative, TRUE AS plain FROM part WHERE p_size > 0")
def names_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, base = F.concat(F.col("p_type"), F.lit(".jpg")), F.lit("/media")
    path = geometry.resolve_path(name, base)
    return table(spark, sf_dir, "part").where("p_size > 0").select(F.col("p_partkey").alias("k"), geometry.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"), geometry.reduced_aspect(F.col("p_size"), F.col("p_partkey") % 40 + 1).alias("aspect"), path.alias("path"), geometry.store_relative(path, base).alias("relative"), geometry.is_plain_filename(name).alias("plain"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S_') || lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0') || '.jpg' AS name FROM events")
def capture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", geometry.capture_name(F.col("ts")).alias("name"))


# Assignment -------------------------------------------------------------------------------


@query(cte("hsv", "bins", more=PLAIN) + " SELECT image_id, y, x, bin_id, round(d, 6) AS distance FROM m")
def bin_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.match_models(hsv(spark, sf_dir), bins(spark)).select("image_id", "y", "x", "bin_id", r("distance").alias("distance"))


_EXCLUSIVE = cte("hsv", "bins", more=PLAIN) + ", w AS (SELECT *, min(d) OVER p AS best FROM m WINDOW p AS (PARTITION BY image_id, y, x)), u AS (SELECT *, count(*) OVER (PARTITION BY image_id, y, x) AS n FROM w WHERE d = best), ex AS (SELECT * FROM u WHERE n = 1)"


@query(_EXCLUSIVE + " SELECT image_id, y, x, bin_id FROM ex")
def exclusive_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.exclusive_masks(hsv(spark, sf_dir), bins(spark)).select("image_id", "y", "x", "bin_id")


@query(_EXCLUSIVE + " SELECT bin_id, round(coalesce((SELECT count(*) FROM ex WHERE ex.bin_id = b.bin_id) / nullif((SELECT count(*) FROM m WHERE m.bin_id = b.bin_id), 0), 1), 9) AS keep_frac FROM bins b")
def exclusive_keep_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.exclusive_keep_frac(hsv(spark, sf_dir), bins(spark)).select("bin_id", r("keep_frac", 9).alias("keep_frac"))


@query(cte("catalog") + " SELECT a.bin_id AS a, b.bin_id AS b FROM catalog a JOIN catalog b ON a.bin_id < b.bin_id AND abs((a.hue_center - b.hue_center + 540) % 360 - 180) <= a.hue_tol + b.hue_tol")
def hue_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign.hue_overlap_pairs(catalog(spark, sf_dir))


# Components -------------------------------------------------------------------------------


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid8(spark, sf_dir).where("m").select("image_id", "bin_id", "y", "x")


_REGIONS = cte("ccl") + """, reg AS (SELECT image_id, bin_id, seed_y, seed_x, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, avg(x) AS cx, avg(y) AS cy FROM named GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id, bin_id ORDER BY area DESC, seed_y, seed_x) AS INTEGER) AS component FROM reg)"""
_REGION_COLUMNS = "image_id, bin_id, component, area, x0, y0, x1, y1, round(cx, 6) AS cx, round(cy, 6) AS cy, seed_y, seed_x"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"cx": r("cx"), "cy": r("cy")})


@query(_REGIONS + f" SELECT {_REGION_COLUMNS} FROM ranked")
def component_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.component_regions(_mask(spark, sf_dir)))


@query(_REGIONS + f" SELECT {_REGION_COLUMNS} FROM ranked WHERE component = 1")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.largest_component(raster.component_regions(_mask(spark, sf_dir))))


@query(cte("ccl") + ", hit AS (SELECT DISTINCT image_id, bin_id, seed_y, seed_x FROM named WHERE y = 3 AND x IN (2, 5)) SELECT image_id, bin_id, y, x FROM named JOIN hit USING (image_id, bin_id, seed_y, seed_x)")
def seeded_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _mask(spark, sf_dir)
    return raster.seeded_component(m, m.where("y = 3 and x in (2, 5)"))


@query("WITH RECURSIVE " + cte("grid8")[5:] + """, free AS (SELECT image_id, y, x FROM grid8 WHERE NOT m),
out AS (SELECT image_id, y, x FROM free WHERE y IN (0, 7) OR x IN (0, 7) UNION SELECT f.image_id, f.y, f.x FROM out o JOIN free f ON f.image_id = o.image_id AND abs(f.y - o.y) <= 1 AND abs(f.x - o.x) <= 1)
SELECT image_id, y, x FROM free f WHERE NOT EXISTS (SELECT 1 FROM out o WHERE o.image_id = f.image_id AND o.y = f.y AND o.x = f.x) AND image_id IN (SELECT image_id FROM out)""")
def component_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.component_holes(grid8(spark, sf_dir))


_SHAPE = "ln((x1 - x0) / (y1 - y0)) BETWEEN -0.7 AND 0.7 AND area / ((x1 - x0) * (y1 - y0)) >= 0.6"


def _plausible() -> Column:
    return verdicts.shape_plausible(F.col("area"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(3), F.lit(-0.7), F.lit(0.7), F.lit(0.6))


@query(_REGIONS + f" SELECT image_id, bin_id, component, {_SHAPE} AS plausible FROM ranked")
def shape_plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.component_regions(_mask(spark, sf_dir)).select("image_id", "bin_id", "component", _plausible().alias("plausible"))


@query(_REGIONS + f", ok AS (SELECT *, row_number() OVER (PARTITION BY image_id, bin_id ORDER BY area DESC, seed_y, seed_x) AS n FROM ranked WHERE {_SHAPE}) SELECT {_REGION_COLUMNS} FROM ok WHERE n = 1")
def select_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(raster.largest_component(raster.component_regions(_mask(spark, sf_dir)), _plausible()))


_DEPTHS = "depths AS (SELECT image_id, y, x, least(y, x, 7 - y, 7 - x) + 1 AS depth FROM grid8)"


def _square_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid8(spark, sf_dir).select("image_id", "y", "x", (F.least(F.col("y"), F.col("x"), 7 - F.col("y"), 7 - F.col("x")) + 1).alias("depth"))


@query(cte("ccl", more=_DEPTHS) + ", k AS (SELECT image_id, bin_id, seed_y, seed_x FROM named JOIN depths USING (image_id, y, x) GROUP BY ALL HAVING min(depth) > 1 OR max(depth) >= 3) SELECT image_id, bin_id, y, x FROM named JOIN k USING (image_id, bin_id, seed_y, seed_x)")
def edge_band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.edge_band_filter(raster.pixel_components(_mask(spark, sf_dir)), _square_depths(spark, sf_dir), 3.0)


@query(cte("ccl", more=_DEPTHS) + ", k AS (SELECT bin_id, max(depth) AS most FROM named JOIN depths USING (image_id, y, x) GROUP BY image_id, bin_id, seed_y, seed_x HAVING min(depth) = 1) SELECT bin_id, round(max(most) / 8, 9) AS clutter_max_frac FROM k GROUP BY 1")
def clutter_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aggregates.clutter_reach(raster.pixel_components(_mask(spark, sf_dir)), _square_depths(spark, sf_dir), F.lit(8.0))
    return got.select("bin_id", r("clutter_max_frac", 9).alias("clutter_max_frac"))


# Percentiles, light and gates -------------------------------------------------------------


def _percentile_sql(q: float) -> str:
    return cte("scan") + f""", w AS (SELECT camera, area_frac AS v, clip_frac + 0.01 AS w, seq FROM scan), p AS (SELECT camera, v, seq, (sum(w) OVER o - w / 2) / sum(w) OVER (PARTITION BY camera) AS p FROM w WINDOW o AS (PARTITION BY camera ORDER BY v, seq ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, lead(p) OVER o AS np, lead(v) OVER o AS nv, row_number() OVER o AS k FROM p WINDOW o AS (PARTITION BY camera ORDER BY v, seq))
SELECT camera, round(CASE WHEN np IS NULL OR {q} <= p THEN v ELSE v + (nv - v) * ({q} - p) / (np - p) END, 6) AS percentile FROM n WHERE (p <= {q} AND (np IS NULL OR {q} < np)) OR (k = 1 AND {q} < p)"""


@query(_percentile_sql(0.95))
def weighted_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark, sf_dir).withColumn("w", F.col("clip_frac") + 0.01)
    return aggregates.weighted_percentile(s, ["camera"], "area_frac", "w", 95.0, ["seq"]).select("camera", r("percentile").alias("percentile"))


@query(cte("scan") + " SELECT camera, round(quantile_cont(area_frac, 0.05), 9) AS p5, round(quantile_cont(area_frac, 0.5), 9) AS p50, round(quantile_cont(area_frac, 0.95), 9) AS p95 FROM scan GROUP BY 1")
def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir).groupBy("camera").agg(*(r(aggregates.percentile("area_frac", q), 9).alias(f"p{q}") for q in (5, 50, 95)))


@query(cte("hsv") + """, wd AS (SELECT image_id, greatest(ceil(360 / (60 / (255 * median(sat * val)))), 1) AS n FROM hsv WHERE hue IS NOT NULL GROUP BY 1),
s AS (SELECT image_id, n, least(floor(hue / (360 / n)), n - 1) AS slot, count(*) AS k FROM hsv JOIN wd USING (image_id) WHERE hue IS NOT NULL GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY k DESC, slot) AS o FROM s)
SELECT image_id, CAST(n AS BIGINT) AS n_bins, round((slot + 0.5) * 360 / n, 6) AS mode_deg, k AS n FROM t WHERE o = 1""")
def hue_histogram_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.hue_mode(hsv(spark, sf_dir), ["image_id"]).withColumn("mode_deg", r("mode_deg"))


_LIGHT = "lt AS (SELECT image_id, median(sat) AS median_sat, median(val) AS median_val, avg(CASE WHEN greatest(r8, g8, b8) >= 254 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS clip_frac FROM hsv GROUP BY 1)"
_DUP = """l AS (SELECT *, lag(r8) OVER w AS pr, lag(g8) OVER w AS pg, lag(b8) OVER w AS pb, lag(y) OVER w AS py FROM px WINDOW w AS (PARTITION BY image_id, x ORDER BY y)),
pr AS (SELECT image_id, y, max(abs(r8 - pr) + abs(g8 - pg) + abs(b8 - pb)) AS most FROM l WHERE py = y - 1 AND NOT (greatest(r8, g8, b8) >= 254 AND greatest(pr, pg, pb) >= 254) GROUP BY ALL),
dup AS (SELECT image_id, coalesce((SELECT avg(CASE WHEN most <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM pr WHERE pr.image_id = i.image_id), 0) AS row_dup_frac FROM (SELECT DISTINCT image_id FROM px) i)"""


@query(cte("hsv", more=_LIGHT) + " SELECT image_id, round(median_sat, 9) AS median_sat, round(median_val, 9) AS median_val, round(clip_frac, 9) AS clip_frac FROM lt")
def frame_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aggregates.frame_light(hsv(spark, sf_dir))
    return got.select("image_id", *(r(c, 9).alias(c) for c in ("median_sat", "median_val", "clip_frac")))


@query(cte("px", more=_DUP) + " SELECT image_id, round(row_dup_frac, 9) AS row_dup_frac FROM dup")
def row_duplicate_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.row_duplicate_fraction(px(spark, sf_dir)).select("image_id", r("row_dup_frac", 9).alias("row_dup_frac"))


@query(cte("hsv", more=_LIGHT + ",\n" + _DUP) + """, g AS (SELECT *, row_dup_frac > 0.5 AS damaged, median_sat < 0.5 AS grayscale, clip_frac > 0.06 OR median_val > 0.85 AS overexposed FROM lt JOIN dup USING (image_id))
SELECT image_id, damaged, grayscale, overexposed, CASE WHEN damaged THEN 'integrity' WHEN grayscale THEN 'grayscale' WHEN overexposed THEN 'overexposed' ELSE 'ok' END AS outcome FROM g""")
def frame_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.frame_gates(hsv(spark, sf_dir), LIMITS).select("image_id", "damaged", "grayscale", "overexposed", "outcome")


_STEPS = ", d AS (SELECT *, " + ", ".join(f"abs({c} - lag({c}) OVER w) AS s_{c}" for c in ("median_sat", "median_val", "clip_frac", "row_dup_frac", "area_frac")) + " FROM scan WINDOW w AS (PARTITION BY camera ORDER BY seq))"


@query(cte("scan") + _STEPS + " SELECT camera, round(coalesce(median(s_area_frac), 0), 9) AS slack FROM d GROUP BY 1")
def successive_diff_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.successive_slack(scan(spark, sf_dir), ["camera"], "area_frac", ["seq"]).select("camera", r("slack", 9).alias("slack"))


_GATES = """round(greatest(least(min(median_sat) - coalesce(median(s_median_sat), 0), 1), 0), 9) AS daylight_sat_min, round(least(greatest(max(median_val) + coalesce(median(s_median_val), 0), 0), 1), 9) AS daylight_val_max,
  round(least(greatest(max(clip_frac) + coalesce(median(s_clip_frac), 0), 0), 1), 9) AS overexposure_clip_max, round(least(greatest(max(row_dup_frac) + coalesce(median(s_row_dup_frac), 0), 0), 1), 9) AS row_dup_max"""
GATES = ("daylight_sat_min", "daylight_val_max", "overexposure_clip_max", "row_dup_max")


@query(cte("scan") + _STEPS + f" SELECT camera, {_GATES} FROM d GROUP BY 1")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.quality_gates(scan(spark, sf_dir), ["camera"], ["seq"]).select("camera", *(r(c, 9).alias(c) for c in GATES))


@query(cte("scan") + _STEPS + f", g AS (SELECT camera, {_GATES} FROM d GROUP BY 1) SELECT camera, least(daylight_sat_min, 0.1) AS daylight_sat_min, greatest(daylight_val_max, 0.9) AS daylight_val_max, greatest(overexposure_clip_max, 0.99) AS overexposure_clip_max, greatest(row_dup_max, 0.1) AS row_dup_max, daylight_sat_min < 0.1 OR daylight_val_max > 0.9 OR overexposure_clip_max > 0.99 OR row_dup_max > 0.1 AS changed FROM g")
def widen_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile's gates after the day's samples."""
    now = dict(zip(GATES, (0.1, 0.9, 0.99, 0.1)))
    g = quality_gates(spark, sf_dir)
    new = aggregates.widened({k: F.lit(v) for k, v in now.items()}, {k: F.col(k) for k in GATES})
    changed = (F.col(GATES[0]) < now[GATES[0]]) | (F.col(GATES[1]) > now[GATES[1]]) | (F.col(GATES[2]) > now[GATES[2]]) | (F.col(GATES[3]) > now[GATES[3]])
    return g.select("camera", *(new[k].alias(k) for k in GATES), changed.alias("changed"))


@query(cte("scan") + """, d AS (SELECT *, abs(median_val - lag(median_val) OVER w) AS s FROM scan WINDOW w AS (PARTITION BY camera ORDER BY seq)),
g AS (SELECT camera, seq, max(median_val) OVER w8 AS mx, median(s) OVER w7 AS md FROM d WINDOW w8 AS (PARTITION BY camera ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), w7 AS (PARTITION BY camera ORDER BY seq ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT camera, seq, round(least(greatest(mx + coalesce(md, 0), 0), 1), 9) AS median_val_limit FROM g""")
def gate_rolling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stability.rolling_gates(scan(spark, sf_dir), 8)
    return got.select("camera", "seq", r("median_val_limit", 9).alias("median_val_limit"))


# Learning aggregates ----------------------------------------------------------------------

_AREA = """, th AS (SELECT bin_id, count(*) FILTER (WHERE label = 'present') AS n_pos, count(*) FILTER (WHERE label = 'absent') AS n_neg, min(area_frac) FILTER (WHERE label = 'present') AS p, max(area_frac) FILTER (WHERE label = 'absent') AS n FROM label_ev WHERE NOT excluded GROUP BY 1)"""


@query(cte("label_ev") + _AREA + " SELECT bin_id, n_pos, n_neg, round(CASE WHEN n IS NULL OR n <= 0 THEN p / 2 ELSE sqrt(p * n) END, 9) AS min_area_frac, n IS NULL AS provisional, coalesce(n, 0) < p AS separable, round(CASE WHEN n <= 0 THEN 1e9 ELSE p / n END, 9) AS gap FROM th WHERE p > 0")
def area_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aggregates.area_threshold(label_ev(spark, sf_dir).where("not excluded"), ["bin_id"])
    gap = verdicts.gap_ratio(F.col("min_pos_area_frac"), F.col("max_neg_area_frac"))
    return got.select("bin_id", "n_pos", "n_neg", r("min_area_frac", 9).alias("min_area_frac"), "provisional", "separable", r(F.when(gap == float("inf"), 1e9).otherwise(gap), 9).alias("gap"))


@query(cte("scan", "bins") + " SELECT event_id, bin_id, CASE WHEN min_pos IS NULL OR max_neg IS NULL THEN FALSE ELSE area_frac > least(min_pos, max_neg) AND area_frac < greatest(min_pos, max_neg) END AS uncertain, separable AND area_frac >= min_area_frac AS qualified FROM scan CROSS JOIN bins")
def is_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(spark, sf_dir).join(assign.models_side(bins(spark)))
    q = verdicts.veto_qualified(F.col("separable"), F.lit(False), F.col("min_area_frac"), F.col("area_frac"))
    return d.select("event_id", "bin_id", verdicts.is_uncertain(F.col("area_frac"), F.col("min_pos"), F.col("max_neg")).alias("uncertain"), q.alias("qualified"))


@query(_REGIONS + """, o AS (SELECT bin_id, image_id, area, ln((x1 - x0) / (y1 - y0)) AS l, area / ((x1 - x0) * (y1 - y0)) AS f, ln(1 + 1 / (x1 - x0)) + ln(1 + 1 / (y1 - y0)) AS one, 2 * ((x1 - x0) + (y1 - y0)) / ((x1 - x0) * (y1 - y0)) AS rim FROM ranked WHERE component = 1),
sp AS (SELECT max(l) - min(l) AS span FROM o), q AS (SELECT *, f * 2 * exp(abs(l)) / ((1 + exp(abs(l))) * (1 + exp(abs(l)))) AS rot, abs(l - lag(l) OVER w) AS dl, abs(f - lag(f) OVER w) AS df FROM o WINDOW w AS (PARTITION BY bin_id ORDER BY image_id)),
h AS (SELECT bin_id, count(*) AS shape_n, max(abs(l)) + greatest(coalesce(median(dl), 0), max(one), (SELECT span FROM sp)) AS half, greatest(least(min(rot), min(f)) - greatest(coalesce(median(df), 0), max(rim)), 0) AS fm FROM q GROUP BY 1)
SELECT bin_id, shape_n, round(-half, 9) AS shape_log_aspect_min, round(half, 9) AS shape_log_aspect_max, round(fm, 9) AS shape_fill_min FROM h""")
def shape_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = raster.largest_component(raster.component_regions(_mask(spark, sf_dir)))
    shapes = big.select("bin_id", "image_id", "area", (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    span = F.broadcast(aggregates.pooled_aspect_span(shapes))  # one row
    got = aggregates.shape_bounds(shapes.join(span), ["bin_id"], ["image_id"], F.col("span"))
    return got.select("bin_id", "shape_n", *(r(c, 9).alias(c) for c in ("shape_log_aspect_min", "shape_log_aspect_max", "shape_fill_min")))


@query(cte("scan") + ", d AS (SELECT *, abs(area_frac - lag(area_frac) OVER (PARTITION BY camera ORDER BY seq)) AS s FROM scan), g AS (SELECT camera, count(*) AS n, min(area_frac) AS o, coalesce(median(s), 0) AS k FROM d GROUP BY 1) SELECT camera, n, round(greatest(o - k, 0), 9) AS min_frac, CASE WHEN n >= 2 AND greatest(o - k, 0) > 0 THEN round(greatest(o - k, 0), 9) END AS band FROM g")
def edge_band_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aggregates.learn_edge_band(scan(spark, sf_dir), ["camera"], "area_frac", ["seq"])
    return got.select("camera", "n", r("min_frac", 9).alias("min_frac"), r(verdicts.edge_band(F.col("n"), F.col("min_frac")), 9).alias("band"))


@query(cte("hsv", "bins", more=PLAIN) + ", v AS (SELECT bin_id, sat, 1 / count(*) OVER (PARTITION BY bin_id, image_id) AS w, d FROM m) SELECT bin_id, round(sum(CASE WHEN d <= 10 THEN w ELSE 0 END) / sum(w), 9) AS coherent_share, round(sum(w), 6) AS images FROM v GROUP BY 1")
def one_vote_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = aggregates.one_vote_weights(assign.match_models(hsv(spark, sf_dir), bins(spark)), ["bin_id"]).withColumn("near", (F.col("distance") <= 10).cast("double"))
    share = aggregates.coherent_share(v, ["bin_id"], "near", "weight")
    return share.join(v.groupBy("bin_id").agg(r(F.sum("weight")).alias("images")), "bin_id").select("bin_id", r("coherent_share", 9).alias("coherent_share"), "images")


# Evidence ---------------------------------------------------------------------------------

_NOW = "now(bin_id, appearance_epoch) AS (VALUES ('AUTOMOBILE', 1), ('BUILDING', 2), ('HOUSEHOLD', 0), ('MACHINERY', 3))"


def _evidence(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of evidence from the labelled orders; one bin has retired."""
    e = label_ev(spark, sf_dir).withColumn("path", F.col("image_id").cast("string"))
    b = spark.createDataFrame([("AUTOMOBILE", "a", True, 1), ("BUILDING", "b", True, 2), ("FURNITURE", "f", False, 0), ("HOUSEHOLD", "h", True, 0), ("MACHINERY", "m", True, 3)], "bin_id string, name string, active boolean, appearance_epoch int")
    rings = F.lit(None).cast("array<array<struct<x:double,y:double>>>")
    label_roi = geometry.rect(F.lit(0.0), F.lit(0.0), 0.5 + F.col("image_id") % 6 / 10.0, F.lit(1.0))
    images = e.select("path", F.col("image_id").alias("ord"), "view_epoch", "excluded", "auto", label_roi.alias("label_roi"), rings.alias("label_rings"))
    labels = e.where("label is not null").select("path", "bin_id", "label", "label_epoch")
    drawn = geometry.rect(F.col("image_id") % 7 / 10.0, F.lit(0.1), F.lit(0.2), F.lit(0.3))
    samples = e.where("label = 'present' and image_id % 3 = 0").select("path", "bin_id", F.lit(0).alias("ord"), drawn.alias("rect"), geometry.rect(0, 0, 1, 1).alias("roi"), F.col("label_epoch").alias("epoch"))
    config = spark.range(1).select(geometry.rect(0, 0, 0.7, 1).alias("roi"), rings.alias("rings"), F.lit(640).alias("working_width"), F.lit(2).alias("view_epoch"))
    return {"bins": b, "images": images, "labels": labels, "samples": samples, "config": config}


_USABLE = """, l AS (SELECT CAST(image_id AS VARCHAR) AS path, e.bin_id, label, appearance_epoch, label_epoch, view_epoch = 2 AS cur, 0.5 + (image_id % 6) / 10.0::DOUBLE AS lw,
  label = 'present' AND image_id % 3 = 0 AS drawn, (image_id % 7) / 10.0::DOUBLE + 0.2::DOUBLE AS right_ FROM label_ev e JOIN now USING (bin_id) WHERE NOT excluded AND label IS NOT NULL),
u AS (SELECT *, CASE WHEN label = 'present' THEN label_epoch = appearance_epoch AND cur AND (lw <= 0.7 + 1e-9 OR (drawn AND right_ <= 0.7 + 1e-9)) ELSE cur AND lw >= 0.7 - 1e-9 END AS usable FROM l)"""


@query(cte("label_ev", more=_NOW) + _USABLE + " SELECT path, bin_id, label, usable FROM u")
def learning_view_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _evidence(spark, sf_dir)
    return evidence.usable_labels(t["labels"], t["images"], t["samples"], t["bins"], t["config"])


@query(cte("label_ev", more=_NOW) + " SELECT CAST(image_id AS VARCHAR) AS path, bin_id, round((image_id % 7) / 10.0::DOUBLE, 9) AS x FROM label_ev JOIN now USING (bin_id) WHERE label = 'present' AND image_id % 3 = 0 AND label_epoch = appearance_epoch AND NOT excluded")
def learning_view_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _evidence(spark, sf_dir)
    return evidence.usable_samples(t["samples"], t["images"], t["bins"]).select("path", "bin_id", r(F.col("rect.x"), 9).alias("x"))


@query(cte("label_ev", more=_NOW) + _USABLE + """ SELECT 'excluded_images' AS kind, count(*) AS n FROM label_ev WHERE excluded HAVING count(*) > 0
UNION ALL SELECT 'dormant_samples', count(*) FROM label_ev JOIN now USING (bin_id) WHERE label = 'present' AND image_id % 3 = 0 AND label_epoch <> appearance_epoch AND NOT excluded HAVING count(*) > 0
UNION ALL SELECT 'stale_' || label, count(*) FROM u WHERE NOT usable GROUP BY label""")
def learning_view_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _evidence(spark, sf_dir)
    return evidence.warnings(evidence.usable_labels(t["labels"], t["images"], t["samples"], t["bins"], t["config"]), t["samples"], t["images"], t["bins"]).groupBy("kind").agg(F.count("*").alias("n"))


@query(cte("label_ev") + """, b(bin_id, a) AS (VALUES ('AUTOMOBILE', 1), ('BUILDING', 2), ('FURNITURE', 0), ('HOUSEHOLD', 0), ('MACHINERY', 3)), v AS (
SELECT 'label epoch out of range' AS rule, CAST(image_id AS VARCHAR) || ':' || bin_id AS item FROM label_ev JOIN b USING (bin_id) WHERE label IS NOT NULL AND label_epoch > a
UNION ALL SELECT 'sample epoch out of range', CAST(image_id AS VARCHAR) || ':' || bin_id FROM label_ev JOIN b USING (bin_id) WHERE label = 'present' AND image_id % 3 = 0 AND label_epoch > a
UNION ALL SELECT 'label region invalid', CAST(image_id AS VARCHAR) FROM label_ev WHERE 0.5 + (image_id % 6) / 10.0::DOUBLE > 1 + 1e-9) SELECT * FROM v""")
def store_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _evidence(spark, sf_dir)
    return evidence.store_violations(t["bins"], t["images"], t["labels"], t["samples"], t["config"])


@query("""WITH e AS (SELECT o_custkey AS path, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F'))) AS p, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O'))) AS a FROM orders GROUP BY 1)
SELECT path, unnest(list_intersect(p, a)) AS bin_id FROM e""")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    return evidence.label_conflicts(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(of("F").alias("present"), of("O").alias("absent")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unmaterialized_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"))
    return evidence.unmaterialised(files, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("path")))


@query(cte("catalog") + " SELECT bin_id FROM catalog WHERE active AND (min_pos IS NULL OR NOT separable)")
def untrained_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return evidence.untrained(c, c.where("min_pos is not null and separable"))


@query(cte("label_ev") + " SELECT CAST(image_id AS VARCHAR) AS path, bin_id FROM label_ev WHERE area_frac > 0.3 AND label = 'absent' AND NOT EXISTS (SELECT 1 FROM label_ev b WHERE b.area_frac > 0.25 AND b.label = 'absent' AND b.image_id = label_ev.image_id AND b.image_id % 2 = 0)")
def new_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = label_ev(spark, sf_dir).where("label = 'absent'").select(F.col("image_id").cast("string").alias("path"), "bin_id", "area_frac", "image_id")
    return evidence.new_mistakes(e.where("area_frac > 0.25 and image_id % 2 = 0"), e.where("area_frac > 0.3").select("path", "bin_id"))


_NEAR = "abs(({0}.hue_center - {1}.hue_center + 540) % 360 - 180) <= {0}.hue_tol + {1}.hue_tol"


@query(cte("catalog") + f""", c AS (SELECT bin_id, CASE WHEN hue_center < 150 THEN (hue_center + 11) % 360 ELSE hue_center END AS hue_center, hue_tol, separable AND max_neg < 0.1 AS separable, min_pos, max_neg * 1.1 AS max_neg FROM catalog WHERE active),
j AS (SELECT b.bin_id, CASE WHEN c.bin_id IS NULL THEN 'no longer trainable' WHEN b.separable AND NOT c.separable THEN 'stopped separating' WHEN NOT b.separable AND c.min_pos / c.max_neg < b.min_pos / b.max_neg THEN 'overlap grew' END AS reason FROM catalog b LEFT JOIN c USING (bin_id))
SELECT * FROM j WHERE reason IS NOT NULL
UNION ALL SELECT a.bin_id || '/' || b.bin_id, 'hue bands now overlap' FROM c a JOIN c b ON a.bin_id < b.bin_id AND {_NEAR.format("a", "b")}
WHERE NOT EXISTS (SELECT 1 FROM catalog p JOIN catalog q ON p.bin_id = a.bin_id AND q.bin_id = b.bin_id AND {_NEAR.format("p", "q")})""")
def adoption_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = catalog(spark, sf_dir)
    moved = F.when(F.col("hue_center") < 150, F.pmod(F.col("hue_center") + 11, F.lit(360.0))).otherwise(F.col("hue_center"))
    c = b.where("active").withColumns({"hue_center": moved, "separable": F.col("separable") & (F.col("max_neg") < 0.1), "max_neg": F.col("max_neg") * 1.1})
    return learning.adoption_regressions(b, c)


# Reservoir --------------------------------------------------------------------------------


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retained frames: a camera's events, its type the situation, of which
    every fourth is kept."""
    s = scan(spark, sf_dir)
    return s.select("camera", "event_type", "seq", F.col("event_id").cast("string").alias("path"), F.col("median_sat").alias("sat"), F.col("median_val").alias("val"))


@query(cte("scan") + ", p AS (SELECT a.camera, a.event_type, min(greatest(abs(a.median_sat - b.median_sat), abs(a.median_val - b.median_val))) AS s FROM scan a JOIN scan b ON a.camera = b.camera AND a.event_type = b.event_type AND a.seq < b.seq GROUP BY ALL), n AS (SELECT camera, event_type, count(*) AS n, min(median_sat) AS sat_min, max(median_sat) AS sat_max, min(median_val) AS val_min, max(median_val) AS val_max FROM scan GROUP BY ALL) SELECT camera, event_type, n, round(coalesce(s, 1e9), 9) AS min_separation, round(sat_min, 9) AS sat_min, round(sat_max, 9) AS sat_max, round(val_min, 9) AS val_min, round(val_max, 9) AS val_max FROM n LEFT JOIN p USING (camera, event_type)")
def light_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reservoir.describe(_frames(spark, sf_dir), ["camera", "event_type"], "seq")
    s = F.col("min_separation")
    return got.select("camera", "event_type", "n", r(F.when(s == float("inf"), 1e9).otherwise(s), 9).alias("min_separation"), *(r(c, 9).alias(c) for c in ("sat_min", "sat_max", "val_min", "val_max")))


@query("""WITH e AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F'))) AS p, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O'))) AS a FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT coalesce(array_to_string(p, ','), '') || '|' || coalesce(array_to_string(a, ','), '') AS situation, count(*) AS n FROM e GROUP BY 1""")
def situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    e = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(of("F").alias("present"), of("O").alias("absent"))
    return reservoir.situations(e).groupBy("situation").agg(F.count("*").alias("n"))


@query(cte("label_ev", more=_NOW) + ", u AS (SELECT *, row_number() OVER (PARTITION BY bin_id ORDER BY image_id DESC) AS k FROM label_ev JOIN now USING (bin_id) WHERE label = 'present' AND NOT auto AND NOT excluded AND view_epoch = 2 AND label_epoch = appearance_epoch) SELECT bin_id, CAST(image_id AS VARCHAR) AS path FROM u WHERE k = 1")
def reference_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = evidence.active_bins(_evidence(spark, sf_dir)["bins"]).select("bin_id", "appearance_epoch")
    e = label_ev(spark, sf_dir).where("label = 'present'").join(F.broadcast(now), "bin_id")
    s = e.select("bin_id", F.col("image_id").cast("string").alias("path"), F.col("image_id").alias("ord"), "auto", "excluded", (F.col("view_epoch") == 2).alias("current_view"), (F.col("label_epoch") == F.col("appearance_epoch")).alias("current_epoch"))
    return reservoir.reference_rects(s).select("bin_id", "path")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of larger situations: of 400 events in a row, those of one type
    and half of the cameras, so that most hold more than the capacity."""
    f = _frames(spark, sf_dir).withColumn("ord", F.col("path").cast("long"))
    return f.select((F.floor(F.col("ord") / 400) * 2 + F.col("camera") % 2).alias("camera"), "event_type", "ord", "path", "sat", "val")


_KEPT = """kept AS (SELECT event_id // 400 * 2 + camera % 2 AS camera, event_type, event_id AS ord, CAST(event_id AS VARCHAR) AS path, median_sat AS sat, median_val AS val,
  row_number() OVER (PARTITION BY event_id // 400, camera % 2, event_type ORDER BY event_id) AS n FROM scan)"""
_PAIRS = "flatten(list_transform(range(1, len(u) + 1), lambda j: list_transform(range(j + 1, len(u) + 1), lambda k: {'j': j, 'k': k, 'd': greatest(abs(u[j].sat - u[k].sat), abs(u[j].val - u[k].val))})))"
_GAINS = "list_transform(range(1, len(u) + 1), lambda i: list_min(list_transform(list_filter(pairs, lambda p: p.j <> i AND p.k <> i), lambda p: p.d)))"
_POINTS = "STRUCT(path VARCHAR, sat DOUBLE, val DOUBLE)[]"


@query(cte("scan", more=_KEPT) + f""", walk AS (
  WITH RECURSIVE w(camera, event_type, n, held, ord, path, accept, reason, evict) AS (
    SELECT DISTINCT camera, event_type, 0::BIGINT, []::{_POINTS}, NULL::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, NULL::VARCHAR, NULL::VARCHAR FROM kept
    UNION ALL
    SELECT camera, event_type, n, CASE reason WHEN 'filled' THEN list_append(held, me) WHEN 'replaced' THEN list_append(list_filter(held, lambda h: h.path <> evict), me) ELSE held END,
      ord, path, reason IN ('filled', 'replaced'), reason, evict
    FROM (SELECT *, coalesce(early, CASE WHEN best = 1 THEN 'no_improvement' ELSE 'replaced' END) AS reason, CASE WHEN early IS NULL AND best > 1 THEN u[best].path END AS evict
    FROM (SELECT *, list_position(gains, list_max(gains)) AS best
    FROM (SELECT *, CASE WHEN early IS NULL THEN {_GAINS} END AS gains
    FROM (SELECT *, CASE WHEN early IS NULL THEN {_PAIRS} END AS pairs
    FROM (SELECT w.camera, w.event_type, k.n, held, k.ord, k.path, {{'path': k.path, 'sat': k.sat, 'val': k.val}} AS me, list_prepend({{'path': k.path, 'sat': k.sat, 'val': k.val}}, held) AS u,
      CASE WHEN len(list_filter(held, lambda h: greatest(abs(h.sat - k.sat), abs(h.val - k.val)) < 1::DOUBLE / 255)) > 0 THEN 'duplicate' WHEN len(held) < {reservoir.CAPACITY} THEN 'filled' END AS early
      FROM w JOIN kept k ON k.camera = w.camera AND k.event_type = w.event_type AND k.n = w.n + 1)))))
  ) SELECT * FROM w WHERE n > 0)
SELECT camera, event_type, ord, path, accept, reason, evict FROM walk""")
def reservoir_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.replay(_kept(spark, sf_dir), ["camera", "event_type"], "ord")


# whoever is not in every closest pair leaves the closest distance as it is
@query(cte("scan", more=_KEPT) + f""", walk AS (
  WITH RECURSIVE w(camera, event_type, u, turn, path) AS (
    SELECT camera, event_type, list({{'path': path, 'sat': sat, 'val': val}} ORDER BY ord)::{_POINTS}, 0, NULL::VARCHAR FROM kept GROUP BY camera, event_type
    UNION ALL
    SELECT camera, event_type, list_filter(u, lambda x, i: i <> gone), turn + 1, u[gone].path
    FROM (SELECT *, CASE WHEN len(two) = 0 THEN 1 ELSE list_extract(list_transform(list_sort(list_transform(two, lambda i: {{'g': -list_min(list_transform(list_filter(pairs, lambda p: p.j <> i AND p.k <> i), lambda p: p.d)), 'i': i}})), lambda x: x.i), 1) END AS gone
    FROM (SELECT *, list_filter([closest[1].j, closest[1].k], lambda i: len(list_filter(closest, lambda p: p.j <> i AND p.k <> i)) = 0) AS two
    FROM (SELECT *, list_filter(pairs, lambda p: p.d = least_d) AS closest
    FROM (SELECT *, list_min(list_transform(pairs, lambda p: p.d)) AS least_d
    FROM (SELECT *, {_PAIRS} AS pairs FROM w WHERE len(u) > {reservoir.CAPACITY})))))
  ) SELECT * FROM w WHERE turn > 0)
SELECT camera, event_type, path, turn FROM walk""")
def reservoir_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reservoir.over_capacity(_kept(spark, sf_dir), ["camera", "event_type"], "ord")


# Time -------------------------------------------------------------------------------------


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading a frame of the bin 'door': errors are damaged frames, small
    remainders of the value's band uncertain."""
    s = scan(spark, sf_dir)
    return s.select("camera", F.lit("door").alias("bin_id"), "seq", (F.col("event_type") != "error").alias("ok"), (F.col("area_frac") >= 0.1).alias("present"), ((F.col("area_frac") > 0.08) & (F.col("area_frac") < 0.12)).alias("uncertain"))


def _stability_sql(k: int) -> str:
    return cte("scan") + f""", rd AS (SELECT camera, seq, event_type <> 'error' AS ok, area_frac >= 0.1 AS present, area_frac > 0.08 AND area_frac < 0.12 AS uncertain FROM scan),
v AS (SELECT *, CASE WHEN ok AND NOT uncertain THEN present END AS v FROM rd), s AS (SELECT *, CASE WHEN v IS NOT DISTINCT FROM lag(v) OVER w AND seq > 1 THEN 0 ELSE 1 END AS st, sum(CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END) OVER w AS nth FROM v WINDOW w AS (PARTITION BY camera ORDER BY seq)),
g AS (SELECT *, sum(st) OVER (PARTITION BY camera ORDER BY seq) AS run FROM s), h AS (SELECT *, CASE WHEN v IS NOT NULL AND (row_number() OVER (PARTITION BY camera, run ORDER BY seq) >= {k} OR nth = 1) THEN v END AS hold FROM g)
SELECT camera, seq, last_value(hold IGNORE NULLS) OVER (PARTITION BY camera ORDER BY seq ROWS UNBOUNDED PRECEDING) AS accepted FROM h"""


@query(_stability_sql(1))
def stability_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.stability_batch(_readings(spark, sf_dir), 1).select("camera", "seq", "accepted")


@query(_stability_sql(2))
def stability_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability.stability_batch(_readings(spark, sf_dir), 2).select("camera", "seq", "accepted")


@query(cte("scan") + """, f AS (SELECT camera, seq, event_type = 'error' AS damaged, median_sat < 0.2 AS grayscale, median_val > 0.6 AS overexposed, CASE WHEN area_frac > 0.08 AND area_frac < 0.12 THEN 0 ELSE 1 END AS nc FROM scan),
l AS (SELECT *, coalesce(max(CASE WHEN NOT damaged AND NOT grayscale AND NOT overexposed AND nc > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS live FROM f)
SELECT camera, seq, CASE WHEN damaged THEN 'hold_frame_integrity' WHEN grayscale AND overexposed THEN 'hold_greyscale_and_overexposure' WHEN grayscale THEN 'hold_greyscale' WHEN overexposed THEN 'hold_overexposure' WHEN nc = 0 AND NOT live THEN 'ambiguous_cold_start' ELSE 'ok' END AS outcome FROM l""")
def gate_order_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(spark, sf_dir)
    unsure = (F.col("area_frac") > 0.08) & (F.col("area_frac") < 0.12)
    f = s.select("camera", "seq", (F.col("event_type") == "error").alias("damaged"), (F.col("median_sat") < 0.2).alias("grayscale"), (F.col("median_val") > 0.6).alias("overexposed"), F.when(unsure, 0).otherwise(1).alias("n_confident"))
    return stability.outcomes(f).select("camera", "seq", "outcome")


@query(_stability_sql(2))
def stream_stability_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live machine over the same readings, read as a stream from a table
    in the shared folder; its result is what :func:`stability_k2` gives."""
    return stability.replay(_readings(spark, sf_dir), 2).select("camera", "seq", "accepted")


# Models -----------------------------------------------------------------------------------


@query()
def learn_color_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour models from the pixels that the models' bands hold."""
    p = assign.exclusive_masks(hsv(spark, sf_dir), bins(spark)).select("bin_id", "image_id", "hue", "sat", "val")
    return learning.learn_color_models(p)


@query()
def resolve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.resolve_candidates(hsv(spark, sf_dir), _models(spark))


@query()
def detect_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.detect(hsv(spark, sf_dir), _models(spark))


def _models(spark: SparkSession) -> list[raster.Model]:
    return [raster.Model(b.bin_id, b.hue_center, b.hue_tol, b.sat_min, b.val_min, b.min_area_frac / 20, {"min_pos_area_frac": b.min_pos, "max_neg_area_frac": b.max_neg}) for b in bins(spark).orderBy("bin_id").collect()]
