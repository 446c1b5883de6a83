import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from huescope.functions import color
from huescope.operators import learning, palette, raster, reservoir
from huescope.sources import frames

YELLOW, BLUE, BROWN = (0.95, 0.80, 0.10), (0.15, 0.35, 0.85), (0.55, 0.30, 0.12)
SPOTS = {"yellow": (YELLOW, (0.30, 0.30, 0.10, 0.10)), "blue": (BLUE, (0.45, 0.35, 0.10, 0.10)), "brown": (BROWN, (0.58, 0.50, 0.09, 0.12))}


def test_hsv_equals_the_standard_library(spark):
    import colorsys

    rng = np.random.default_rng(42)
    rows = [tuple(map(float, rng.random(3))) for _ in range(400)] + [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (1.0, 0.0, 0.2)]
    df = spark.createDataFrame(rows, "r double, g double, b double")
    for got in df.withColumns(color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))).collect():
        h, s, v = colorsys.rgb_to_hsv(got.r, got.g, got.b)
        assert abs(got.sat - s) < 1e-9 and abs(got.val - v) < 1e-12
        assert got.hue is None if s == 0 else abs((got.hue - h * 360 + 180) % 360 - 180) < 1e-6


def pixel_percentile(values, weights, q):
    """The definition, pixel by pixel: each holds its weight about its midpoint."""
    points, run = [], 0.0
    for v, _, w in sorted((v, i, w) for i, (v, w) in enumerate(zip(values, weights))):
        points.append(((run + w / 2) / sum(weights), v))
        run += w
    below = [p for p in points if p[0] <= q / 100]
    above = [p for p in points if p[0] > q / 100]
    if not below or not above:
        return (below[-1] if below else above[0])[1]
    (p0, v0), (p1, v1) = below[-1], above[0]
    return v0 + (v1 - v0) * (q / 100 - p0) / (p1 - p0)


def marked(rng, images=6, good=60, junk=25, centre=50.0):
    """Marked pixels of several images with coarse, repeated colours."""
    rows = []
    for i in range(images):
        n, m = int(rng.integers(1, good)), int(rng.integers(0, junk))
        hue = np.concatenate((rng.normal(centre, 4, n), rng.uniform(0, 360, m))).round() % 360
        rows += [(i, h, s, v) for h, s, v in zip(hue, rng.integers(120, 230, n + m) // 10 / 25.5, rng.integers(120, 230, n + m) // 10 / 25.5)]
    return pd.DataFrame(rows, columns=["image_id", "hue", "sat", "val"])


def test_percentiles_of_a_palette_are_those_of_its_pixels(spark):
    rng = np.random.default_rng(4)
    for _ in range(8):
        px = marked(rng).assign(bin_id="a")
        weights = 1 / px.groupby("image_id").hue.transform("size")
        p = palette.Palette.of_rows(palette.palettes(spark.createDataFrame(px)).toPandas())
        assert len(p.hue) < len(px) and np.isclose(p.mass.sum(), px.image_id.nunique()) and p.n.sum() == len(px)
        for q in (0, 3, 5, 20, 50, 77, 95, 100):
            assert np.isclose(p.percentile(p.sat, q), pixel_percentile(px.sat, weights, q))
            assert np.isclose(p.percentile(palette.apart(p.hue, 48.0), q), pixel_percentile(palette.apart(px.hue.to_numpy(), 48.0), weights, q))
    assert palette.Palette.of_pixels([1.0, 2, 3], [1.0] * 3, [1.0] * 3).percentile(np.array([1.0, 2, 3]), 50) == 2.0


def test_circular_statistics():
    around = palette.Palette.of_pixels([358.0, 359, 1, 2], np.ones(4), np.ones(4)).direction()
    assert min(palette.degrees(around), 360 - palette.degrees(around)) < 1e-9 and abs(around) > 0.99
    assert np.isclose(color.log_bessel_i0(5.0), np.log(np.i0(5.0))) and np.isfinite(color.log_bessel_i0(5000.0))
    assert palette.apart(np.array([359.0]), 1.0) == 2 and palette.concentration(1.0) == np.inf and palette.concentration(0.0) == 0


def fit_of(hue, kappa_max=1e4):
    p = palette.Palette.of_pixels(hue, np.ones(len(hue)), np.ones(len(hue)))
    return p, palette.BumpFit(p, kappa_max)


def density(hue, m):
    """Of the mixture, by its formula."""
    return m.weight * np.exp(m.kappa * np.cos(np.radians(hue - m.centre))) / (2 * np.pi * np.i0(m.kappa)) + (1 - m.weight) / (2 * np.pi)


def test_mixture_finds_the_bump_within_n_rounds():
    rng = np.random.default_rng(21)
    hue = np.concatenate((rng.normal(120, 5, 800), rng.uniform(0, 360, 200))) % 360
    _, fit = fit_of(hue)
    m = fit.from_start(palette.Mixture(100.0, 1.0, 0.5))
    assert abs(m.centre - 120) < 1 and abs(m.weight - 0.8) < 0.05 and m.rounds <= 1000
    assert np.isclose(m.likelihood, np.log(density(hue, m)).sum())
    # no state close by is likelier
    for change in ({"centre": m.centre + 0.3}, {"centre": m.centre - 0.3}, {"kappa": m.kappa * 1.05}, {"kappa": m.kappa / 1.05}, {"weight": m.weight + 0.02}, {"weight": m.weight - 0.02}):
        other = palette.replace(m, **change)
        assert np.log(density(hue, other)).sum() < m.likelihood + 0.2
    assert fit_of(np.array([7.0]), 10)[1].from_start(palette.Mixture(0, 1, 0.5)).centre == 7.0


def test_a_palette_learns_what_its_pixels_teach(spark):
    rng = np.random.default_rng(11)
    for trust in (False, True):
        px = marked(rng, images=9).assign(bin_id="a")
        weights = 1 / px.groupby("image_id").hue.transform("size")
        each = palette.learn_band(palette.Palette.of_pixels(px.hue, px.sat, px.val, weights), trust_marks=trust)
        both = palette.learn_band(palette.Palette.of_rows(palette.palettes(spark.createDataFrame(px).repartition(5)).toPandas()), trust_marks=trust)
        for name in ("hue", "tol", "sat_min", "val_min"):
            assert np.isclose(getattr(each, name), getattr(both, name), rtol=1e-6), name
        assert each.stats["n_coherent_px"] == both.stats["n_coherent_px"] and each.warnings == both.warnings
        # the band and the floors, from the pixels that belong
        belongs = np.array([m.belongs for m in [palette.BumpFit(palette.Palette.of_pixels(px.hue, px.sat, px.val, weights), 1e9).judged(palette.Mixture(each.hue, each.stats["kappa"], each.stats["mixture_weight"]))]][0])
        hues = np.unique(px.hue)
        mine = px[px.hue.isin(hues[belongs >= 0.5])]
        assert np.isclose(each.tol, pixel_percentile(palette.apart(mine.hue.to_numpy(), each.hue), weights[mine.index], 95))
        base = px if trust else mine
        assert np.isclose(each.sat_min, pixel_percentile(base.sat, weights[base.index], 5))


def test_color_model_needs_a_majority():
    rng = np.random.default_rng(3)

    def learned_from(good, junk, **options):
        hue = np.concatenate((rng.normal(50, 3, good), rng.uniform(0, 360, junk))) % 360
        return palette.learn_band(palette.Palette.of_pixels(hue, rng.uniform(0.6, 0.9, good + junk), rng.uniform(0.5, 0.9, good + junk)), **options)

    model = learned_from(1200, 800)
    assert abs(model.hue - 50) < 1 and 4 < model.tol < 12 and model.warnings
    with pytest.raises(palette.CalibrationError):
        learned_from(500, 1500)
    assert learned_from(500, 1500, trust_marks=True).warnings
    for nothing in (np.full(5, np.nan), np.zeros(0)):
        with pytest.raises(palette.CalibrationError):
            palette.learn_band(palette.Palette.of_pixels(nothing, np.ones(len(nothing)), np.ones(len(nothing))))
    two = np.concatenate((rng.normal(50, 3, 700), rng.normal(200, 3, 300)))
    assert abs(palette.learn_band(palette.Palette.of_pixels(two, np.full(1000, 0.8), np.full(1000, 0.8))).hue - 50) < 1
    same = palette.learn_band(palette.Palette.of_pixels(np.full(40, 77.0), np.full(40, 0.5), np.full(40, 0.5)))
    assert same.hue == pytest.approx(77) and same.tol == pytest.approx(60 / 255 / 0.25 / 2)


def picture(names, seed):
    return frames.scene(rects=[SPOTS[n] for n in names], seed=seed)


def pixels_of(spark, pictures):
    rows = [(i, bytearray(frames.encode_png(p))) for i, p in pictures.items()]
    px = frames.frame_pixels(spark.createDataFrame(rows, "image_id long, content binary"), working_width=160)
    return px.withColumns(color.rgb_to_hsv(*(F.col(c) / 255.0 for c in ("r8", "g8", "b8"))))


@pytest.fixture(scope="module")
def learned(spark):
    pictures = {1: picture(SPOTS, 0), 2: picture(["blue", "brown"], 1), 3: picture(["yellow"], 2), 4: picture(SPOTS, 3), 5: picture([], 4)}
    shown = {1: set(SPOTS), 2: {"blue", "brown"}, 3: {"yellow"}, 4: set(SPOTS), 5: set()}
    px = pixels_of(spark, pictures)
    labels = spark.createDataFrame([(i, b, "present" if b in s else "absent", False) for i, s in shown.items() for b in SPOTS], "image_id long, bin_id string, label string, auto boolean")
    marks = []
    for b, (_, (x, y, w, h)) in SPOTS.items():
        for i, s in shown.items():
            if b in s:
                marks += [(i, b, yy, xx) for yy in range(int((y + h / 4) * 100) + 1, int((y + 3 * h / 4) * 100)) for xx in range(int((x + w / 4) * 160) + 1, int((x + 3 * w / 4) * 160))]
    seeds = spark.createDataFrame(marks, "image_id long, bin_id string, y int, x int")
    samples = px.join(seeds, ["image_id", "y", "x"]).select("bin_id", "image_id", "hue", "sat", "val")
    models, warnings = learning.learn_profile(samples, px, labels, seeds)
    return models, warnings, px, labels


def test_learned_models_detect_what_they_saw(spark, learned):
    models, warnings, px, labels = learned
    assert [m.id for m in models] == sorted(SPOTS)
    for m, hue in zip(models, (222.9, 25.1, 49.4)):
        assert abs(m.hue - hue) < 3 and m.stats["separable"] and 0 < m.min_area_frac < 0.02
    found = learning.detect(px, models)
    assert learning.misclassified(found, labels).count() == 0


def test_learned_models_detect_moved_objects_and_grey_frames(spark, learned):
    models = learned[0]
    moved = frames.scene(rects=[(YELLOW, SPOTS["blue"][1]), (BLUE, (0.7, 0.6, 0.1, 0.1))], seed=2)
    grey = np.repeat(picture(SPOTS, 0).mean(2, keepdims=True), 3, 2).astype(np.uint8)
    got = {(r.image_id, r.bin_id): r.present for r in learning.detect(pixels_of(spark, {1: moved, 2: grey}), models).collect()}
    assert got[1, "yellow"] and got[1, "blue"] and not got[1, "brown"]
    assert not any(got[2, b] for b in SPOTS)


def test_png_modes_orientation_and_damage():
    rgb = picture(SPOTS, 0)
    assert (frames.decode_png(frames.encode_png(rgb)) == rgb).all()
    exif = b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0\0\0\0\0"
    turned = frames.decode_png(frames.encode_png(np.rot90(rgb, 1), exif))
    assert (turned == rgb).all()
    for bad in (b"", b"nothing", frames.encode_png(rgb)[:120]):
        with pytest.raises(frames.FrameError):
            frames.decode_png(bad)
    assert frames.working_frame(rgb, (0.25, 0.25, 0.5, 0.5), 80).shape == (50, 80, 3)
    assert (frames.resize(rgb, 320, "nearest") == rgb).all()
    assert abs(frames.resize(rgb, 64, "bilinear").mean() - rgb.mean()) < 1
    with pytest.raises(frames.FrameError):
        frames.crop_box((0.5, 0, 0.6, 1), 10, 10)


def test_unreadable_frames_do_not_fail_the_job(spark):
    rows = [(1, bytearray(b"broken")), (2, bytearray(frames.encode_png(picture([], 0)[:4, :5])))]
    got = frames.frame_pixels(spark.createDataFrame(rows, "image_id long, content binary")).groupBy("image_id").agg(F.count("y").alias("n")).collect()
    assert {r.image_id: r.n for r in got} == {1: 0, 2: 20}


def test_the_archive_lists_names(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"broken")
    (tmp_path / "b.jpg").write_bytes(b"broken")
    assert [r.path for r in frames.archive(spark, str(tmp_path)).collect()] == ["b.jpg"]
    assert sorted(r.path for r in frames.archive(spark, str(tmp_path), frames.PICTURES).collect()) == ["a.png", "b.jpg"]


def test_reservoir_keeps_its_promises():
    rng = np.random.default_rng(7)
    held, least = [], 0.0
    for i in range(400):
        point = tuple(map(float, rng.random(2)))
        ok, reason, evict = reservoir.decide(held, point)
        if ok:
            held = [x for x in held if x[0] != evict] + [(str(i), point)]
        assert len(held) <= reservoir.CAPACITY
        if len(held) == reservoir.CAPACITY:
            d = reservoir._distances(np.array([p for _, p in held])).min()
            assert d >= least - 1e-12
            least = d
    assert reservoir.decide(held, held[0][1]) == (False, "duplicate", None)
    assert len(reservoir.trim(held, 5)) == reservoir.CAPACITY - 5


def test_models_from_tables(spark):
    rng = np.random.default_rng(1)
    px = pd.DataFrame({"bin_id": ["a"] * 200 + ["b"] * 50, "image_id": list(rng.integers(0, 3, 200)) + [0] * 50, "hue": np.concatenate((rng.normal(200, 2, 200), rng.uniform(0, 360, 50))), "sat": 0.8, "val": 0.7})
    got = {r.bin_id: r for r in learning.learn_color_models(spark.createDataFrame(px)).collect()}
    assert abs(got["a"].hue_center - 200) < 1 and got["a"].error is None
    assert got["b"].error or got["b"].warnings
    assert len(learning.to_models([got["a"]])) == 1 and isinstance(learning.to_models([got["a"]])[0], raster.Model)
