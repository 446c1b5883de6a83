"""Regions as pixel sets, and containment between regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def pixel_grid(frames: DataFrame) -> DataFrame:
    """Cells (y, x) of each frame's grid: ``frames`` holds width and height."""
    rows = frames.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))


def centre(crop: Column, x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return crop["x"] + (x + 0.5) / width * crop["w"], crop["y"] + (y + 0.5) / height * crop["h"]


def polygon_mask(grid: DataFrame, rings: Column, crop: Column) -> DataFrame:
    """Cells whose centre lies in the even-odd region.

    ``rings`` is a column or literal of the same row, so the test runs in
    the projection: no join between pixels and edges.
    """
    cx, cy = centre(crop, F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return grid.where(geometry.point_in_region(rings, cx, cy))


def region_mask(grid: DataFrame, rings: Column | None, crop: Column) -> DataFrame:
    """The region's cells; the whole grid where there is no region."""
    return grid if rings is None else polygon_mask(grid, rings, crop)


_CELL = ["image_id", "y", "x"]


def mask_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells (image_id, y, x) of both masks."""
    return a.select(*_CELL).intersect(b.select(*_CELL))


def mask_or(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of either mask, each once."""
    return a.select(*_CELL).union(b.select(*_CELL)).distinct()


def mask_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of the first mask that the second one has not."""
    return a.select(*_CELL).distinct().join(b.select(*_CELL), _CELL, "left_anti")


def depth_in_polygon(cells: DataFrame) -> DataFrame:
    """Chessboard depth of every region cell (image_id, y, x) in relational
    form: the smallest distance to a cell outside, border included.

    Only cells next to the region can be nearest, so the outside is the
    region's ring of neighbours, not its complement; still a join by image
    of all pairs cell x rim, meant for small canonical grids.  The grouped
    map :func:`.raster.interior_depths` is the form for large ones.
    """
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)))
    near = cells.select("image_id", "y", "x", around.alias("d")).select("image_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()
    rim = near.join(cells, ["image_id", "y", "x"], "left_anti").select("image_id", F.col("y").alias("ry"), F.col("x").alias("rx"))
    far = F.greatest(F.abs(F.col("y") - F.col("ry")), F.abs(F.col("x") - F.col("rx")))
    return cells.join(rim, "image_id").groupBy("image_id", "y", "x").agg(F.min(far).cast("int").alias("depth"))


def contains(outer_bbox: Column, outer_rings: Column, inner_bbox: Column, inner_rings: Column, working_width: Column) -> Column:
    """Does the outer region hold the inner one?

    Boxes decide first; a rectangular outer region (NULL rings) needs no
    more, nor do equal rings.  Otherwise every cell of the outer's canonical
    grid whose centre lies in the inner region must lie in the outer one.
    Without a working width, or a region that holds no cell: no.
    """
    inner = F.coalesce(inner_rings, geometry.rect_as_rings(inner_bbox))
    grid = geometry.region_grid(outer_bbox, working_width)
    at_x = lambda i: outer_bbox["x"] + (i + 0.5) / grid["w"] * outer_bbox["w"]
    at_y = lambda j: outer_bbox["y"] + (j + 0.5) / grid["h"] * outer_bbox["h"]
    # only cells under the inner box can lie in the inner region
    xs = F.filter(F.sequence(F.lit(0), grid["w"] - 1), lambda i: (at_x(i) >= inner_bbox["x"]) & (at_x(i) <= inner_bbox["x"] + inner_bbox["w"]))
    ys = F.filter(F.sequence(F.lit(0), grid["h"] - 1), lambda j: (at_y(j) >= inner_bbox["y"]) & (at_y(j) <= inner_bbox["y"] + inner_bbox["h"]))

    def row(j: Column) -> Column:
        states = F.transform(xs, lambda i: F.when(geometry.point_in_region(inner, at_x(i), at_y(j)), F.when(geometry.point_in_region(outer_rings, at_x(i), at_y(j)), 1).otherwise(2)).otherwise(0))
        return F.array_max(states)

    worst = F.array_max(F.transform(ys, row))
    same = geometry.rings_equal(outer_rings, inner_rings)
    return F.when(~geometry.contains(outer_bbox, inner_bbox), False).when(outer_rings.isNull() | same, True).when(working_width.isNull() | (working_width < 1), False).otherwise(F.coalesce(worst == 1, F.lit(False)))


def rect_pixels(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """Pixels under any of the pixel boxes (image_id, x0, y0, x1, y1): the
    boxes' cells are generated and joined by equality, not by range."""
    cells = rects.select("image_id", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1").select("image_id", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x")).distinct()
    return pixels.join(cells, ["image_id", "y", "x"], "left_semi")


def tap_patches(points: DataFrame, keys: list[str], aspect: Column) -> DataFrame:
    """Square patches around tapped points (pos, x, y): the side is the
    smallest distance between two taps with x scaled by the aspect, cut at
    the frame.  A frame's taps are few; under two give no patch."""
    a = points.alias("a")
    b = points.select(*keys, F.col("pos").alias("pos2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    near = a.join(b, keys).where("pos < pos2").groupBy(*keys).agg((F.min(F.hypot((F.col("x") - F.col("x2")) * aspect, F.col("y") - F.col("y2"))) / 2).alias("r"))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    got = points.join(near, keys)
    x0, x1, y0, y1 = unit(F.col("x") - F.col("r") / aspect), unit(F.col("x") + F.col("r") / aspect), unit(F.col("y") - F.col("r")), unit(F.col("y") + F.col("r"))
    return got.select(*keys, "pos", x0.alias("px"), y0.alias("py"), (x1 - x0).alias("pw"), (y1 - y0).alias("ph"))
