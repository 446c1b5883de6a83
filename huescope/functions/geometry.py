"""Rectangles, rings and pixel grids as column expressions.

A rectangle is a struct x, y, w, h in relative coordinates; a ring is an
array of structs x, y; a region is an array of rings, combined even-odd.
Where the input is invalid an expression gives NULL, and the ``*_error``
forms say why.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: relative coordinates may miss a bound by this much.
REL_EPS = 1e-9


def rect(x, y, w, h) -> Column:
    as_col = lambda v, n: (v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n)
    return F.struct(as_col(x, "x"), as_col(y, "y"), as_col(w, "w"), as_col(h, "h"))


def to_pixels(r: Column, width: Column, height: Column) -> Column:
    """Half-open pixel box x0, y0, x1, y1: both edges rounded half to even
    and clamped.  NULL if the rectangle leaves the unit square by more than
    the tolerance or no pixel is left."""
    edge = lambda v, n: F.least(F.greatest(F.bround(v * n, 0).cast("int"), F.lit(0)), n.cast("int"))
    x0, x1 = edge(r["x"], width), edge(r["x"] + r["w"], width)
    y0, y1 = edge(r["y"], height), edge(r["y"] + r["h"], height)
    ok = in_unit(r) & (x1 > x0) & (y1 > y0)
    return F.when(ok, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def in_unit(r: Column) -> Column:
    low, high = F.lit(-REL_EPS), F.lit(1 + REL_EPS)
    return (r["x"] >= low) & (r["y"] >= low) & (r["x"] + r["w"] <= high) & (r["y"] + r["h"] <= high)


def to_pixels_error(r: Column, width: Column, height: Column) -> Column:
    return F.when(~in_unit(r), "outside the frame").when(to_pixels(r, width, height).isNull(), "no pixel left")


def clamp_unit(r: Column) -> Column:
    """Drift within the tolerance is cut off; NULL where there is more, or no extent."""
    x, y = F.greatest(r["x"], F.lit(0.0)), F.greatest(r["y"], F.lit(0.0))
    w, h = F.least(r["w"], 1.0 - x), F.least(r["h"], 1.0 - y)
    return F.when(in_unit(r) & (r["w"] > 0) & (r["h"] > 0), rect(x, y, w, h))


def image_to_roi(r: Column, roi: Column) -> Column:
    """An image-relative rectangle in the region's own coordinates; NULL
    unless the region contains it."""
    moved = rect((r["x"] - roi["x"]) / roi["w"], (r["y"] - roi["y"]) / roi["h"], r["w"] / roi["w"], r["h"] / roi["h"])
    return F.when(contains(roi, r), clamp_unit(moved))


def roi_to_image(r: Column, roi: Column) -> Column:
    """A region-relative rectangle in image coordinates."""
    return clamp_unit(rect(roi["x"] + r["x"] * roi["w"], roi["y"] + r["y"] * roi["h"], r["w"] * roi["w"], r["h"] * roi["h"]))


def contains(outer: Column, inner: Column) -> Column:
    e = F.lit(REL_EPS)
    return (inner["x"] >= outer["x"] - e) & (inner["y"] >= outer["y"] - e) & (inner["x"] + inner["w"] <= outer["x"] + outer["w"] + e) & (inner["y"] + inner["h"] <= outer["y"] + outer["h"] + e)


def equal(a: Column, b: Column) -> Column:
    close = [F.abs(a[f] - b[f]) <= REL_EPS for f in "xywh"]
    return close[0] & close[1] & close[2] & close[3]


def box_to_image(box: Column, width: Column, height: Column, crop: Column) -> Column:
    """A half-open pixel box of the working grid as an image-relative rectangle."""
    sx, sy = crop["w"] / width, crop["h"] / height
    return rect(crop["x"] + box["x0"] * sx, crop["y"] + box["y0"] * sy, (box["x1"] - box["x0"]) * sx, (box["y1"] - box["y0"]) * sy)


def point_to_image(px: Column, py: Column, width: Column, height: Column, crop: Column) -> Column:
    """A pixel's centre in image coordinates."""
    return F.struct((crop["x"] + (px + 0.5) / width * crop["w"]).alias("x"), (crop["y"] + (py + 0.5) / height * crop["h"]).alias("y"))


def box_inside(inner: Column, outer: Column) -> Column:
    return (inner["x0"] >= outer["x0"]) & (inner["y0"] >= outer["y0"]) & (inner["x1"] <= outer["x1"]) & (inner["y1"] <= outer["y1"])


def region_grid(bbox: Column, width: Column) -> Column:
    """(w, h) of the canonical grid of a region."""
    h = F.greatest(F.bround(width * bbox["h"] / bbox["w"], 0).cast("int"), F.lit(1))
    return F.struct(width.cast("int").alias("w"), h.alias("h"))


def rings_bbox(rings: Column) -> Column:
    """Bounding rectangle of all vertices; NULL if it has no extent."""
    xs = F.transform(F.flatten(rings), lambda p: p["x"])
    ys = F.transform(F.flatten(rings), lambda p: p["y"])
    x0, y0 = F.array_min(xs), F.array_min(ys)
    w, h = F.array_max(xs) - x0, F.array_max(ys) - y0
    return F.when((w > 0) & (h > 0), rect(x0, y0, w, h))


def rect_as_rings(r: Column) -> Column:
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    right, low = r["x"] + r["w"], r["y"] + r["h"]
    return F.array(F.array(point(r["x"], r["y"]), point(right, r["y"]), point(right, low), point(r["x"], low)))


def clamp_rings(rings: Column) -> Column:
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y"))))


def rings_equal(a: Column, b: Column) -> Column:
    """Same structure and coordinates within the tolerance; NULL equals NULL only."""
    point = lambda p: (F.abs(p["a"]["x"] - p["b"]["x"]) <= REL_EPS) & (F.abs(p["a"]["y"] - p["b"]["y"]) <= REL_EPS)
    pair = lambda x, y: F.arrays_zip(x.alias("a"), y.alias("b"))
    ring = lambda r: (F.size(r["a"]) == F.size(r["b"])) & F.forall(pair(r["a"], r["b"]), point)
    same = (F.size(a) == F.size(b)) & F.forall(pair(a, b), ring)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def rings_error(rings: Column) -> Column:
    """Why rings are invalid (too few vertices, or outside the unit square), else NULL."""
    few = F.exists(rings, lambda r: F.size(r) < 3)
    bad = lambda v: v.isNull() | F.isnan(v) | (v < -REL_EPS) | (v > 1 + REL_EPS)
    outside = F.exists(F.flatten(rings), lambda p: bad(p["x"]) | bad(p["y"]))
    return F.when(F.size(rings) == 0, "no rings").when(few, "a ring has under three vertices").when(outside, "a vertex lies outside the frame").when(rings_bbox(rings).isNull(), "no extent")


def region_payload_error(x: Column, y: Column, w: Column, h: Column, rings: Column) -> Column:
    """Why a given region is invalid, else NULL: rings, or all four numbers
    of a rectangle inside the frame."""
    box = rect(x, y, w, h)
    missing = x.isNull() | y.isNull() | w.isNull() | h.isNull()
    plain = F.when(missing, "either rings or all four numbers are required").when(clamp_unit(box).isNull(), "outside the frame, or no extent")
    return F.when(rings.isNotNull(), rings_error(rings)).otherwise(plain)


def crossings(rings: Column, x: Column, y: Column) -> Column:
    """Number of edges whose crossing of the height y lies right of x; edges
    count from their lower end up to, not including, their upper end."""
    def of_ring(ring: Column) -> Column:
        n = F.size(ring)

        def hit(i: Column) -> Column:
            p, q = F.element_at(ring, i + 1), F.element_at(ring, (i + 1) % n + 1)
            low, high = F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])
            at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])
            return F.when((p["y"] != q["y"]) & (low <= y) & (y < high) & (x < at), 1).otherwise(0)

        return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), hit), F.lit(0), lambda a, b: a + b)

    return F.aggregate(F.transform(rings, of_ring), F.lit(0), lambda a, b: a + b)


def point_in_region(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd test of one point."""
    return crossings(rings, x, y) % 2 == 1


def slug(name: Column) -> Column:
    """Identifier from a display name; NULL if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s != "", s)


def capture_name(ts: Column) -> Column:
    """File name of a frame taken at ``ts``."""
    return F.concat(F.date_format(ts, "yyyyMMdd_HHmmss_SSSSSS"), F.lit(".jpg"))


def resolve_path(path: Column, base: Column) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))


def store_relative(path: Column, base: Column) -> Column:
    """Relative to the store's folder where the path lies below it."""
    prefix = F.concat(base, F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


def is_plain_filename(name: Column) -> Column:
    return name.isNotNull() & (name != "") & ~name.rlike(r"[/\\]") & ~name.isin(".", "..")


def reduced_aspect(width: Column, height: Column) -> Column:
    """width : height in lowest terms, as one string; the divisor is found by
    Euclid's steps on a fixed-length fold (enough for 64-bit sides)."""
    start = F.struct(width.cast("long").alias("a"), height.cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % s["b"]).alias("b"))
    d = F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]
    return F.concat_ws(":", (width / d).cast("long"), (height / d).cast("long"))
