import numpy as np
import pytest

from huescope.operators import raster
from huescope.operators.raster import Model


def flood(mask):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for i in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for j in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[i, j] and not out[i, j]:
                        out[i, j] = n
                        todo.append((i, j))
    return out


def art(*rows):
    return np.array([[c == "#" for c in r] for r in rows])


@pytest.mark.parametrize("density", [0.05, 0.3, 0.45, 0.6, 0.9])
def test_labels_equal_a_flood_fill(density):
    rng = np.random.default_rng(int(density * 100))
    for shape in ((1, 1), (1, 30), (30, 1), (25, 33)):
        for _ in range(20):
            mask = rng.random(shape) < density
            got, want = raster.label(mask), flood(mask)
            pairs = {(a, b) for a, b in zip(got.ravel(), want.ravel())}
            assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_by_hand():
    assert raster.components(raster.label(art(".....", "....."))).empty
    got = raster.components(raster.label(art("##...", "#...#", "...##")))
    assert got.area.tolist() == [3, 3] and got[["x0", "y0", "x1", "y1"]].values.tolist() == [[0, 0, 2, 2], [3, 1, 5, 3]]
    assert len(raster.components(raster.label(art("#.", ".#")))) == 1
    with pytest.raises(ValueError):
        raster.label(np.zeros(3, bool))


def test_depth_equals_its_definition():
    rng = np.random.default_rng(2)
    region = rng.random((12, 15)) < 0.85
    depth = raster.interior_depth(region)
    padded = np.pad(region, 1)
    outside = np.argwhere(~padded) - 1
    for y in range(12):
        for x in range(15):
            want = np.abs(outside - [y, x]).max(1).min() if region[y, x] else 0
            assert depth[y, x] == want


def test_edge_band_drops_what_only_touches_the_rim():
    region = np.ones((9, 9), bool)
    depth = raster.interior_depth(region)
    mask = art("##.......", "##.......", ".........", "...###...", "...###...", ".........", "......#..", "......#..", "......#..")
    kept = raster.edge_band_keep(raster.label(mask), depth, 3.0)
    assert kept[3:5, 3:6].all() and not kept[:2].any() and kept[6:, 6].all()


def test_exclusive_closest_wins_and_ties_go_to_nobody():
    models = [Model("a", 10, 30, 0, 0), Model("b", 30, 30, 0, 0)]
    hue = np.array([[5.0, 20.0, 33.0, np.nan, 100.0]])
    one = np.ones_like(hue)
    a, b = raster.exclusive(models, hue, one, one)
    assert a.tolist() == [[True, False, False, False, False]] and b.tolist() == [[False, False, True, False, False]]
    a, b = raster.exclusive(models, hue, one, one, enabled=False)
    assert a.tolist() == [[True, True, True, False, False]]


def nested():
    hue = np.full((60, 60), np.nan)
    hue[10:50, 10:50] = 220
    hue[20:40, 20:40] = 120
    hue[25:35, 25:35] = 0
    return hue, np.ones((60, 60))


def sure(id_, hue, area=0.001, separable=True):
    return Model(id_, hue, 20, 0.1, 0.1, 0.01, {"veto_qualify_min_area_frac": area, "veto_qualify_separable": separable, "veto_qualify_provisional": False})


def test_an_object_inside_another_is_vetoed_whatever_the_order():
    hue, one = nested()
    models = [sure("blue", 220), sure("green", 120), sure("red", 0)]
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        got = {c["bin_id"]: c for c in raster.resolve([models[i] for i in order], hue, one, one, np.ones((60, 60), bool))}
        assert got["blue"]["area"] == 1600 - 400 and got["blue"]["excluded_by"] is None
        assert got["green"]["area"] == 0 and got["green"]["excluded_by"] == "blue" and got["green"]["provisional_area"] == 300
        assert got["red"]["area"] == 0 and got["red"]["excluded_by"] == "blue"


def test_an_incredible_container_only_conflicts():
    hue, one = nested()
    models = [sure("blue", 220, separable=False), sure("green", 120, separable=False)]
    got = {c["bin_id"]: c for c in raster.resolve(models, hue, one, one, np.ones((60, 60), bool))}
    assert got["green"]["area"] == 300 and got["green"]["conflict_with"] == "blue"
    plain = {c["bin_id"]: c for c in raster.resolve(models, hue, one, one, np.ones((60, 60), bool), veto=False)}
    assert plain["green"]["conflict_with"] is None


def test_holes_need_an_outside():
    ring = art("#####", "#...#", "#####")
    whole = np.ones((3, 5), bool)
    assert raster.holes(ring, whole, raster.interior_depth(whole)) is None
    wide = np.pad(ring, 1)
    universe = np.ones_like(wide)
    assert raster.holes(wide, universe, raster.interior_depth(universe)).sum() == 3
    assert raster.seeded(raster.label(ring), np.zeros_like(ring)) is None


class Naive:
    """The resolution by sets of pixels, step by step from its definition."""

    def __init__(self, models, hue, sat, val, region, exclusion, veto):
        self.models, self.region = models, {(int(y), int(x)) for y, x in zip(*np.nonzero(region))}
        self.shape = region.shape
        self.rim = {p for p in self.region if any(q not in self.region for q in self.around(p))}
        self.masks = []
        near = {}
        for p in sorted(self.region):
            for k, m in enumerate(models):
                d = abs((hue[p] - m.hue + 180) % 360 - 180)
                if d <= m.tol and sat[p] >= m.sat_min and val[p] >= m.val_min:
                    near.setdefault(p, []).append((d, k))
        for k, m in enumerate(models):
            mine = set()
            for p, found in near.items():
                best = min(d for d, _ in found)
                winners = [j for d, j in found if d == best] if exclusion and len(models) > 1 else [j for _, j in found]
                if k in winners and (len(winners) == 1 or not exclusion or len(models) < 2):
                    mine.add(p)
            self.masks.append(self.banded(m, mine))
        self.blobs = [self.chosen(m, mask) for m, mask in zip(models, self.masks)]
        self.provisional = [len(b) if b else 0 for b in self.blobs]
        self.named = [None] * len(models)
        self.conflict = [None] * len(models)
        for _ in range(len(models) if exclusion and veto else 0):
            if not self.vetoed():
                break

    def around(self, p):
        return [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]

    def parts(self, cells):
        left, out = set(cells), []
        while left:
            todo, part = [min(left)], set()
            while todo:
                p = todo.pop()
                if p in left:
                    left.discard(p)
                    part.add(p)
                    todo += self.around(p)
            out.append(part)
        return out

    def depth(self, p):
        d = 1
        while all((p[0] + a, p[1] + b) in self.region for a in range(-d, d + 1) for b in range(-d, d + 1)):
            d += 1
        return d

    def banded(self, m, cells):
        band = m.stat("region_edge_depth_min_frac", 0.0) * self.shape[1] if m.stat("region_edge_depth_n", 0) >= 2 else 0
        if band <= 1:
            return cells
        return {p for part in self.parts(cells) if not part & self.rim or max(map(self.depth, part)) >= band for p in part}

    def box(self, part):
        ys, xs = zip(*part)
        return min(xs), min(ys), max(xs) + 1, max(ys) + 1

    def chosen(self, m, cells):
        for part in sorted(self.parts(cells), key=lambda c: (-len(c), min(c))):
            x0, y0, x1, y1 = self.box(part)
            w, h = x1 - x0, y1 - y0
            if m.stat("shape_n", 0) < 2 or m.stat("shape_log_aspect_min") <= np.log(w / h) <= m.stat("shape_log_aspect_max") and len(part) / (w * h) >= m.stat("shape_fill_min"):
                return part
        return None

    def holes(self, j):
        free = self.region - self.blobs[j]
        if not free & self.rim:
            return None
        return {p for part in self.parts(free) if not part & self.rim for p in part}

    def vetoed(self):
        boxes = [self.box(b) if b else None for b in self.blobs]
        holes, inside = {}, {i: [] for i in range(len(self.models))}
        for i, a in enumerate(boxes):
            for j, b in enumerate(boxes):
                if i != j and a and b and a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2] and a[3] <= b[3]:
                    holes.setdefault(j, self.holes(j))
                    if holes[j] is not None and self.blobs[i] <= holes[j]:
                        inside[i].append(j)
        sure = {j for j, h in holes.items() if h is not None and self.models[j].stat("veto_qualify_separable", False) and not self.models[j].stat("veto_qualify_provisional", True) and len(self.blobs[j]) / len(self.region) >= self.models[j].stat("veto_qualify_min_area_frac", np.inf)}
        changes = {}
        for i, by in inside.items():
            may = [j for j in by if j in sure and not sure & set(inside[j])]
            if may:
                changes[i] = (set().union(*(holes[j] for j in may)), min(may, key=lambda j: (-len(self.blobs[j]), self.models[j].id)))
        names = {i: self.models[j].id for i, (_, j) in changes.items()}
        for i, (gone, _) in changes.items():
            self.named[i] = names[i]
            self.masks[i] -= gone
        for i in changes:
            self.blobs[i] = self.chosen(self.models[i], self.masks[i])
        self.conflict = [self.models[inside[i][0]].id if self.blobs[i] and not self.named[i] and inside[i] else None for i in range(len(self.models))]
        return bool(changes)


def ringed(rng):
    """A small frame with rings inside rings in three hues, some noise, and a region."""
    h, w = int(rng.integers(8, 17)), int(rng.integers(8, 17))
    hue = np.full((h, w), 300.0)
    for _ in range(int(rng.integers(2, 6))):
        y0, x0 = int(rng.integers(0, h - 3)), int(rng.integers(0, w - 3))
        y1, x1 = int(rng.integers(y0 + 2, h + 1)), int(rng.integers(x0 + 2, w + 1))
        inner = hue[y0 + 1 : y1 - 1, x0 + 1 : x1 - 1].copy()
        hue[y0:y1, x0:x1] = rng.choice([40.0, 120.0, 220.0])
        if rng.random() < 0.7:
            hue[y0 + 1 : y1 - 1, x0 + 1 : x1 - 1] = inner
    if rng.random() < 0.7:  # something inside a ring, perhaps with a ring of its own
        a, b = rng.permutation([40.0, 120.0, 220.0])[:2]
        hue[1 : h - 1, 1 : w - 1] = a
        hue[2 : h - 2, 2 : w - 2] = 300.0
        hue[3 : h - 3, 3 : w - 3] = b
        if rng.random() < 0.5 and min(h, w) > 9:
            hue[4 : h - 4, 4 : w - 4] = 300.0
            hue[5 : h - 5, 5 : w - 5] = rng.choice([40.0, 120.0, 220.0])
    spots = rng.random((h, w)) < rng.choice([0.0, 0.02, 0.08])
    hue[spots] = rng.choice([40.0, 45.0, 120.0, 220.0, 80.0], spots.sum())
    region = np.ones((h, w), bool)
    if rng.random() < 0.5:
        region[: int(rng.integers(0, 3))] = False
        region[:, w - int(rng.integers(0, 3)) :] = False
    return hue, region


def trained(rng):
    def stats():
        out = {}
        if rng.random() < 0.8:
            out |= {"veto_qualify_separable": bool(rng.random() < 0.9), "veto_qualify_provisional": bool(rng.random() < 0.1), "veto_qualify_min_area_frac": float(rng.choice([0.01, 0.05, 0.2]))}
        if rng.random() < 0.4:
            out |= {"shape_n": 2, "shape_log_aspect_min": -0.8, "shape_log_aspect_max": 0.8, "shape_fill_min": 0.2}
        if rng.random() < 0.4:
            out |= {"region_edge_depth_n": 2, "region_edge_depth_min_frac": float(rng.choice([0.05, 0.2, 0.3]))}
        return out

    return [Model(n, h, t, 0.3, 0.3, 0.01, stats()) for n, h, t in (("a", 40.0, 45.0), ("b", 120.0, 45.0), ("c", 220.0, 40.0))]


def test_resolution_equals_its_definition():
    rng = np.random.default_rng(31)
    told = {"excluded_by": 0, "conflict_with": 0}
    for _ in range(250):
        hue, region = ringed(rng)
        models, exclusion = trained(rng), bool(rng.random() < 0.9)
        sat, val = np.where(rng.random(hue.shape) < 0.05, 0.1, 0.8), np.full(hue.shape, 0.8)
        got = raster.resolve(models, hue, sat, val, region, exclusion=exclusion)
        want = Naive(models, hue, sat, val, region, exclusion, True)
        for i, r in enumerate(got):
            blob = want.blobs[i]
            assert (r["area"], r["provisional_area"], r["excluded_by"]) == (len(blob) if blob else 0, want.provisional[i], want.named[i])
            assert r["box"] == (want.box(blob) if blob else None)
            assert r["conflict_with"] == want.conflict[i]
            for k in told:
                told[k] += r[k] is not None
    assert min(told.values()) > 5, told


def test_resolution_of_the_tables_frames_equals_its_definition(spark):
    """The registered queries' own rows, frame by frame."""
    from huescope.operators import learning
    from huescope.plans import queries
    from huescope.plans.adapters import hsv

    from .conftest import SF

    models = queries._models(spark)
    pixels = hsv(spark, SF).toPandas()
    candidates = {(r.image_id, r.bin_id): r for r in queries.resolve_candidates(spark, SF).collect()}
    verdicts = {(r.image_id, r.bin_id): r for r in queries.detect_frames(spark, SF).collect()}
    assert candidates.keys() == verdicts.keys() == {(i, m.id) for i in pixels.image_id.unique() for m in models}
    assert learning  # the module that the query goes through
    for image, part in pixels.groupby("image_id"):
        shape = part.y.max() + 1, part.x.max() + 1
        planes = []
        for name in ("hue", "sat", "val"):
            plane = np.full(shape, -1e9 if name == "hue" else 0.0)
            plane[part.y, part.x] = part[name].fillna(-1e9)
            planes.append(plane)
        region = np.zeros(shape, bool)
        region[part.y, part.x] = True
        planes[1][planes[0] < -1e8] = -1.0  # no hue matches nothing
        want = Naive(models, *planes, region, True, True)
        for i, m in enumerate(models):
            c, v = candidates[image, m.id], verdicts[image, m.id]
            area = len(want.blobs[i]) if want.blobs[i] else 0
            assert (c.area, c.provisional_area, c.excluded_by, c.conflict_with, c.denom) == (area, want.provisional[i], want.named[i], want.conflict[i], len(part))
            frac = area / len(part)
            assert v.present == (frac >= m.min_area_frac) and v.margin == pytest.approx(frac / m.min_area_frac)
            low, high = (m.stat(k) for k in ("min_pos_area_frac", "max_neg_area_frac"))
            between = low is not None and high is not None and min(low, high) < frac < max(low, high)
            assert v.uncertain == (between or (want.conflict[i] is not None and v.present))


def test_depths_equal_the_relational_form(spark):
    from huescope.operators import regions
    from huescope.plans.adapters import grid8

    from .conftest import SF

    cells = grid8(spark, SF).where("m or y between 2 and 5").select("image_id", "y", "x")
    assert sorted(map(tuple, raster.interior_depths(cells).collect())) == sorted(map(tuple, regions.depth_in_polygon(cells).collect()))


def test_groups_that_span_batches_come_whole(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in (1, 2, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            df = spark.createDataFrame([(k, i) for k in range(9) for i in range(1 + 3 * (k % 4))], "k long, i long")
            got = raster.by_frame(df, ["k"], lambda p: p.groupby("k", as_index=False).agg(n=("i", "size"), s=("i", "sum")), "k long, n long, s long").collect()
            assert sorted(map(tuple, got)) == [(k, 1 + 3 * (k % 4), sum(range(1 + 3 * (k % 4)))) for k in range(9)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_closest_points_equal_all_pairs():
    from huescope.operators import reservoir

    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 40, 300):
        for digits in (1, 6):
            p = rng.random((n, 2)).round(digits)
            want = min((np.abs(p[i] - p[j]).max() for i in range(n) for j in range(i)), default=np.inf)
            assert reservoir.closest(p[:, 0], p[:, 1]) == want


def test_many_models_are_matched_by_degree(spark, monkeypatch):
    from huescope.operators import assign

    rng = np.random.default_rng(8)
    px = [(0, i, 0, None if i % 11 == 0 else float(h), float(a), float(v)) for i, (h, a, v) in enumerate(zip(rng.uniform(0, 360, 400).round(1), rng.random(400), rng.random(400)))]
    pixels = spark.createDataFrame(px, "image_id long, y int, x int, hue double, sat double, val double")
    models = spark.createDataFrame([(f"m{k:02}", float(c), float(t), 0.2, 0.2) for k, (c, t) in enumerate(zip(rng.uniform(0, 360, 40).round(1), rng.choice([0.4, 3.0, 20.0, 89.0, 200.0], 40)))], "bin_id string, hue_center double, hue_tol double, sat_min double, val_min double")
    plain = lambda df: sorted((r.y, r.bin_id) for r in df.collect())
    want = [plain(f(pixels, models)) for f in (assign.match_models, assign.exclusive_masks)]
    monkeypatch.setattr(assign, "MOST", 10)
    assert [plain(f(pixels, models)) for f in (assign.match_models, assign.exclusive_masks)] == want
    assert assign.exclusive_masks(pixels, models).columns == [*pixels.columns, "bin_id"]
