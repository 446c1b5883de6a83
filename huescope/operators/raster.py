"""Raster algorithms without a relational form, as grouped maps by frame.

A frame is the unit of parallelism and is bounded by its working width; the
pixel relation is sparse: (image_id, y, x, flag columns).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPONENT = "image_id long, bin_id string, component int, area long, x0 int, y0 int, x1 int, y1 int, cx double, cy double, seed_y int, seed_x int"


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected component numbers (from 1, by first pixel in reading
    order), 0 outside.

    Row runs are the nodes; a run touches the runs of the next row that it
    overlaps with one pixel of slack.  Numbers sink to the smallest
    neighbour's by hooking and pointer jumping, all in array operations.
    """
    if mask.ndim != 2:
        raise ValueError("a mask has two dimensions")
    height, width = mask.shape
    out = np.zeros(mask.shape, np.int64)
    if not mask.any():
        return out
    # padded to one line per row, so that runs never join across rows
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    stride = width + 2
    # runs of the row above that overlap [begin - 1, end + 1)
    keys_end, keys_begin = row * stride + end, row * stride + begin
    low = np.searchsorted(keys_end, (row - 1) * stride + begin, side="left")
    high = np.searchsorted(keys_begin, (row - 1) * stride + end, side="right")
    high = np.maximum(high, low)
    count = high - low
    a = np.repeat(np.arange(len(row)), count)
    b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    root = np.arange(len(row))
    while True:
        ra, rb = root[a], root[b]
        least = np.minimum(ra, rb)
        new = root.copy()
        np.minimum.at(new, ra, least)
        np.minimum.at(new, rb, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    _, number = np.unique(root, return_inverse=True)
    starts, length = row * width + begin, end - begin
    flat = out.reshape(-1)
    at = np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(length.sum())
    flat[at] = np.repeat(number + 1, length)
    return out


def components(labels: np.ndarray) -> pd.DataFrame:
    """Area, half-open box, centroid and first pixel of every component,
    largest first; equal areas by first pixel in reading order."""
    y, x = np.nonzero(labels)
    which = labels[y, x]
    order = np.argsort(which, kind="stable")  # reading order within a component
    y, x, which = y[order], x[order], which[order]
    start = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, int)
    area = np.diff(np.append(start, len(which)))
    over = lambda f, v: f.reduceat(v, start) if len(start) else np.zeros(0, int)
    found = {"component": which[start], "area": area, "x0": over(np.minimum, x), "y0": over(np.minimum, y), "x1": over(np.maximum, x) + 1, "y1": over(np.maximum, y) + 1, "cx": over(np.add, x) / np.maximum(area, 1), "cy": over(np.add, y) / np.maximum(area, 1), "seed_y": y[start], "seed_x": x[start]}
    rank = np.lexsort((found["seed_x"], found["seed_y"], -area))
    return pd.DataFrame({k: v[rank] for k, v in found.items()})


def interior_depth(region: np.ndarray) -> np.ndarray:
    """Chessboard distance to the nearest cell outside the region; the grid's
    border counts as outside.  Separable: a running distance along rows, then
    the lower envelope along columns, peeled at most half the height deep."""
    depth, core = np.zeros(region.shape, np.int32), region.copy()
    while core.any():
        depth += core
        p = np.pad(core, 1)
        rows = p[:, :-2] & p[:, 1:-1] & p[:, 2:]
        core = rows[:-2] & rows[1:-1] & rows[2:]
    return depth


def edge_band_keep(labels: np.ndarray, depth: np.ndarray, band: float) -> np.ndarray:
    """The mask without components that touch the region's rim (depth 1) yet
    reach nowhere ``band`` deep."""
    top = int(labels.max())
    if not top:
        return labels > 0
    deepest = np.zeros(top + 1, np.int64)
    np.maximum.at(deepest, labels.ravel(), depth.ravel())
    rim = np.zeros(top + 1, bool)
    rim[labels[depth == 1]] = True
    keep = ~rim | (deepest >= band)
    keep[0] = False
    return keep[labels]


def holes(component: np.ndarray, universe: np.ndarray, depth: np.ndarray) -> np.ndarray | None:
    """Free cells that cannot be reached from the rim without crossing the
    component; None if no free cell lies on the rim."""
    free = universe & ~component
    rim = free & (depth == 1)
    if not rim.any():
        return None
    parts = label(free)
    outside = np.zeros(parts.max() + 1, bool)
    outside[parts[rim]] = True
    return free & ~outside[parts]


def seeded(labels: np.ndarray, seed: np.ndarray) -> np.ndarray | None:
    """All components that the seed mask touches, None if it touches none."""
    hit = np.unique(labels[seed & (labels > 0)])
    return np.isin(labels, hit) if len(hit) else None


@dataclass
class Model:
    """One object class: its colour band and what was learned about it."""

    id: str
    hue: float
    tol: float
    sat_min: float
    val_min: float
    min_area_frac: float = 0.0
    stats: dict | None = None

    def stat(self, key: str, default=None):
        value = (self.stats or {}).get(key)
        return default if value is None else value


def match(model: Model, hue: np.ndarray, sat: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(accepted, hue distance); an undefined (NaN) hue is infinitely far."""
    distance = np.abs(np.mod(hue - model.hue + 180.0, 360.0) - 180.0)
    distance = np.where(np.isnan(distance), np.inf, distance)
    return (distance <= model.tol) & (sat >= model.sat_min) & (val >= model.val_min), distance


def exclusive(models: list[Model], hue, sat, val, enabled: bool = True) -> list[np.ndarray]:
    """One mask a model; with ``enabled`` a pixel goes to the closest
    accepting hue, and to nobody on an exact tie."""
    got = [match(m, hue, sat, val) for m in models]
    if not enabled or len(models) < 2:
        return [a for a, _ in got]
    distances = np.stack([np.where(a, d, np.inf) for a, d in got])
    best = distances.min(0)
    winners = (distances == best) & np.isfinite(best)
    alone = winners.sum(0) == 1
    return [w & alone for w in winners]


def plausible(model: Model, part) -> bool:
    w, h, area = part.x1 - part.x0, part.y1 - part.y0, part.area
    if model.stat("shape_n", 0) < 2:
        return True
    if min(w, h, area) <= 0:
        return False
    return model.stat("shape_log_aspect_min", -np.inf) <= np.log(w / h) <= model.stat("shape_log_aspect_max", np.inf) and area / (w * h) >= model.stat("shape_fill_min", 0.0)


class Layer:
    """One model's mask while candidates are resolved."""

    def __init__(self, model: Model, mask: np.ndarray):
        self.model, self.excluded_by = model, None
        self.reset(mask)
        self.first_area = self.area

    def reset(self, mask: np.ndarray) -> None:
        self.mask, self.labels = mask, label(mask)
        self.best = next((p for p in components(self.labels).itertuples() if plausible(self.model, p)), None)
        self.blob = self.labels == self.best.component if self.best is not None else None
        self.area = int(self.best.area) if self.best is not None else 0


def _nested(a, b) -> bool:
    return a.x0 >= b.x0 and a.y0 >= b.y0 and a.x1 <= b.x1 and a.y1 <= b.y1


def resolve(models: list[Model], hue, sat, val, universe: np.ndarray, *, depth: np.ndarray | None = None, exclusion: bool = True, veto: bool = True) -> list[dict]:
    """Each model's blob after pixels, edge band and vetoes are settled.

    A blob that lies wholly in the holes of a credible blob is an object seen
    inside another one, which cannot be: those holes are taken from its mask
    and it is chosen again, until nothing changes (at most once a model).  A
    container may veto only if its own area qualifies and no qualified blob
    encloses it.  An enclosure that nobody may veto is reported as conflict.
    """
    depth, cells = interior_depth(universe) if depth is None else depth, max(int(universe.sum()), 1)
    layers = []
    for model, mask in zip(models, exclusive(models, hue, sat, val, exclusion)):
        mask = mask & universe
        band = model.stat("region_edge_depth_min_frac", 0.0) * mask.shape[1] if model.stat("region_edge_depth_n", 0) >= 2 else 0.0
        layers.append(Layer(model, edge_band_keep(label(mask), depth, band) if band > 1.0 else mask))
    inside: dict[int, list[int]] = {i: [] for i in range(len(layers))}
    for _ in range(len(layers) if exclusion and veto else 0):
        found = [i for i, x in enumerate(layers) if x.best is not None]
        pairs = [(i, j) for i in found for j in found if i != j and _nested(layers[i].best, layers[j].best)]
        hole = {j: holes(layers[j].blob, universe, depth) for j in {j for _, j in pairs}}
        inside = {i: [] for i in range(len(layers))}
        for i, j in pairs:
            if hole[j] is not None and hole[j][layers[i].blob].all():
                inside[i].append(j)

        def credible(j: int) -> bool:
            m = layers[j].model
            return hole.get(j) is not None and bool(m.stat("veto_qualify_separable", False)) and not m.stat("veto_qualify_provisional", True) and layers[j].area / cells >= m.stat("veto_qualify_min_area_frac", np.inf)

        sure = {j for j in hole if credible(j)}
        moves = {}
        for i, around in inside.items():
            by = [j for j in around if j in sure and not sure.intersection(inside[j])]
            if by:
                moves[i] = (np.logical_or.reduce([hole[j] for j in by]), min(by, key=lambda j: (-layers[j].area, layers[j].model.id)))
        names = {i: layers[j].model.id for i, (_, j) in moves.items()}
        for i, (gone, _) in moves.items():
            layers[i].excluded_by = names[i]
            layers[i].reset(layers[i].mask & ~gone)
        if not moves:
            break
    out = []
    for i, x in enumerate(layers):
        b = x.best
        conflict = layers[inside[i][0]].model.id if b is not None and x.excluded_by is None and inside[i] else None
        out.append({"bin_id": x.model.id, "area": x.area, "provisional_area": x.first_area, "excluded_by": x.excluded_by, "conflict_with": conflict,
                    "box": None if b is None else (int(b.x0), int(b.y0), int(b.x1), int(b.y1)), "centroid": None if b is None else (float(b.cx), float(b.cy))})
    return out


def _grid(part: pd.DataFrame, flag: str | None = None) -> tuple[np.ndarray, int, int]:
    y0, x0 = int(part.y.min()), int(part.x.min())
    mask = np.zeros((int(part.y.max()) - y0 + 1, int(part.x.max()) - x0 + 1), bool)
    mask[part.y.to_numpy() - y0, part.x.to_numpy() - x0] = True if flag is None else part[flag].to_numpy(bool)
    return mask, y0, x0


def by_frame(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run`` on each group's rows as one pandas frame.

    Groups arrive sorted and in batches, so thousands of small frames cost
    no round trip each, and a task holds a batch and one group at most.
    """
    def parts(batches):
        held: list[pd.DataFrame] = []  # pieces of the group that may go on
        for rows in batches:
            if not len(rows):
                continue
            keyed = rows[keys]
            cut = np.flatnonzero((keyed != keyed.shift()).any(axis=1).to_numpy())
            if held and (held[-1][keys].iloc[-1] == keyed.iloc[0]).all():
                held.append(rows.iloc[: cut[1]] if len(cut) > 1 else rows)
                cut = cut[1:]
            if not len(cut):
                continue
            done = [held] if held else []
            done += [[rows.iloc[a:b]] for a, b in zip(cut[:-1], cut[1:])]
            held = [rows.iloc[cut[-1] :]]
            out = [run(g[0] if len(g) == 1 else pd.concat(g, ignore_index=True)) for g in done]
            out = [x for x in out if len(x)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(parts, schema)


def component_regions(pixels: DataFrame) -> DataFrame:
    """Components of each (image_id, bin_id) among the mask's pixels
    (image_id, bin_id, y, x), numbered by area, largest first."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        mask, y0, x0 = _grid(part)
        out = components(label(mask))
        out[["y0", "y1", "cy", "seed_y"]] += y0
        out[["x0", "x1", "cx", "seed_x"]] += x0
        out["component"] = range(1, len(out) + 1)
        return out.assign(image_id=part.image_id.iloc[0], bin_id=part.bin_id.iloc[0])[[c.split()[0] for c in COMPONENT.split(", ")]]

    return by_frame(pixels.select("image_id", "bin_id", "y", "x"), ["image_id", "bin_id"], run, COMPONENT)


def pixel_components(pixels: DataFrame) -> DataFrame:
    """The mask's pixels with their component's first pixel as its name."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        mask, y0, x0 = _grid(part)
        labels = label(mask)
        named = components(labels).set_index("component")
        which = labels[part.y.to_numpy() - y0, part.x.to_numpy() - x0]
        return part[["image_id", "bin_id", "y", "x"]].assign(seed_y=named.seed_y.loc[which].to_numpy() + y0, seed_x=named.seed_x.loc[which].to_numpy() + x0)

    return by_frame(pixels.select("image_id", "bin_id", "y", "x"), ["image_id", "bin_id"], run, "image_id long, bin_id string, y int, x int, seed_y int, seed_x int")


def largest_component(regions: DataFrame, condition: Column | None = None) -> DataFrame:
    """The largest component of each (image_id, bin_id) that meets the condition."""
    kept = regions if condition is None else regions.where(condition)
    order = Window.partitionBy("image_id", "bin_id").orderBy(F.col("area").desc(), "seed_y", "seed_x")
    return kept.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def seeded_component(pixels: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pixels of the components that the seeds (image_id, bin_id, y, x) touch."""
    named = pixel_components(pixels)
    hit = named.join(seeds.select("image_id", "bin_id", "y", "x"), ["image_id", "bin_id", "y", "x"], "left_semi").select("image_id", "bin_id", "seed_y", "seed_x").distinct()
    return named.join(hit, ["image_id", "bin_id", "seed_y", "seed_x"], "left_semi").select("image_id", "bin_id", "y", "x")


def component_holes(grid: DataFrame) -> DataFrame:
    """Cells of each frame's region enclosed by the mask: ``grid`` holds the
    whole region as (image_id, y, x, m); no rows where no free cell is on the
    rim."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        universe, y0, x0 = _grid(part)
        mask, _, _ = _grid(part, "m")
        found = holes(mask, universe, interior_depth(universe))
        y, x = np.nonzero(found) if found is not None else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"image_id": np.full(len(y), part.image_id.iloc[0], np.int64), "y": y + y0, "x": x + x0})

    return by_frame(grid.select("image_id", "y", "x", "m"), ["image_id"], run, "image_id long, y int, x int")


def interior_depths(region: DataFrame) -> DataFrame:
    """Depth of every cell of each region (image_id, y, x)."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        mask, y0, x0 = _grid(part)
        return part[["image_id", "y", "x"]].assign(depth=interior_depth(mask)[part.y.to_numpy() - y0, part.x.to_numpy() - x0])

    return by_frame(region.select("image_id", "y", "x"), ["image_id"], run, "image_id long, y int, x int, depth int")


def edge_band_filter(named: DataFrame, depths: DataFrame, band: float) -> DataFrame:
    """Pixels of :func:`pixel_components` without the components that touch
    depth 1 and never reach ``band``: one aggregate by component, and a join
    back on its name."""
    keys = ["image_id", "bin_id", "seed_y", "seed_x"]
    deep = named.join(depths, ["image_id", "y", "x"])
    kept = deep.groupBy(*keys).agg(F.min("depth").alias("least"), F.max("depth").alias("most")).where((F.col("least") > 1) | (F.col("most") >= band))
    return named.join(kept.select(*keys), keys, "left_semi").select("image_id", "bin_id", "y", "x")


CANDIDATE = "image_id long, bin_id string, area long, provisional_area long, excluded_by string, conflict_with string, x0 int, y0 int, x1 int, y1 int, cx double, cy double, denom long"


def resolve_candidates(pixels: DataFrame, models: list[Model], *, exclusion: bool = True, veto: bool = True) -> DataFrame:
    """:func:`resolve` on every frame: one row for each frame and model.

    ``pixels``: image_id, y, x, hue (NULL: undefined), sat, val and, if only
    part of the frame counts, a boolean in_region.
    """
    has_region = "in_region" in pixels.columns

    def run(part: pd.DataFrame) -> pd.DataFrame:
        grid, y0, x0 = _grid(part)
        at = (part.y.to_numpy() - y0, part.x.to_numpy() - x0)
        planes = []
        for name in ("hue", "sat", "val"):
            plane = np.full(grid.shape, np.nan if name == "hue" else 0.0)
            plane[at] = part[name].to_numpy(float)
            planes.append(plane)
        universe = grid.copy()
        if has_region:
            universe[at] = part.in_region.to_numpy(bool)
        denom, rows = int(universe.sum()), []
        for c in resolve(models, *planes, universe, exclusion=exclusion, veto=veto):
            box, mid = c.pop("box") or (None,) * 4, c.pop("centroid") or (None, None)
            rows.append(c | {"x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "cx": mid[0], "cy": mid[1]})
        out = pd.DataFrame(rows, columns=["bin_id", "area", "provisional_area", "excluded_by", "conflict_with", "x0", "y0", "x1", "y1", "cx", "cy"])
        shift = {"x0": x0, "x1": x0, "cx": x0, "y0": y0, "y1": y0, "cy": y0}
        for c, by in shift.items():
            out[c] = out[c].astype("Int32" if c[0] != "c" else float) + by
        return out.assign(image_id=part.image_id.iloc[0], denom=denom)[[c.split()[0] for c in CANDIDATE.split(", ")]]

    keep = ["image_id", "y", "x", "hue", "sat", "val", *(["in_region"] if has_region else [])]
    return by_frame(pixels.select(*keep), ["image_id"], run, CANDIDATE)
