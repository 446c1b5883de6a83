import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from huescope import __main__ as cli
from huescope.functions import color, geometry
from huescope.operators import aggregates, detector, evidence, learning
from huescope.operators.raster import Model
from huescope.sources import catalog, frames, store
from huescope.streaming import collector, stability

from .test_evidence_and_time import DOC
from .test_frames import jvm_encoded
from .test_learning import SPOTS, picture

LIMITS = {"sat_min": 0.02, "val_max": 0.95, "clip_max": 0.2, "row_dup_max": 0.5}


def pixels(spark, pictures):
    rows = [(i, bytearray(frames.encode_png(p))) for i, p in pictures.items()]
    px = frames.frame_pixels(spark.createDataFrame(rows, "image_id long, content binary"))
    return px.withColumns(color.rgb_to_hsv(*(F.col(c) / 255.0 for c in ("r8", "g8", "b8"))))


def test_frames_are_judged_by_light_and_patch(spark):
    good = picture(["yellow"], 1)[:80, :120]
    smeared = good.copy()
    smeared[10:] = smeared[9]
    grey = np.repeat(good.mean(2, keepdims=True), 3, 2).astype(np.uint8)
    px = pixels(spark, {1: good, 2: good, 3: smeared, 4: grey, 5: np.clip(good.astype(int) + 60, 0, 255).astype(np.uint8)})
    inside = px.where("y between 62 and 75 and x between 100 and 115").withColumn("bin_id", F.lit("yellow"))
    got = {r.image_id: (r.accept, r.reason) for r in collector.evaluate_frames(px, inside.where("image_id <> 5"), LIMITS, "s", 1).collect()}
    assert got[1] == (True, "filled") and got[2] == (False, "duplicate")
    assert got[3] == (False, "frame_integrity") and got[4] == (False, "greyscale") and got[5][0] is False


def test_conditions_and_declarations(spark):
    state = {c: F.col(c) for c in collector.CONDITIONS}
    rows = [tuple(i == k for k in range(len(collector.CONDITIONS))) for i in range(len(collector.CONDITIONS) + 1)] + [(False, True, True, False, False, True, False)]
    got = [r[0] for r in spark.createDataFrame(rows, ", ".join(f"{c} boolean" for c in collector.CONDITIONS)).select(collector.skip_reason(state)).collect()]
    assert got == [*collector.CONDITIONS, None, "busy"]
    bins = spark.createDataFrame([("a", True), ("b", False)], "bin_id string, active boolean")
    junk = spark.createDataFrame([("a", 0.2)], "bin_id string, junk_fraction double")
    said = spark.createDataFrame([("a", "present")], "bin_id string, state string")
    assert collector.declaration(said, bins, junk).first().fragile
    with pytest.raises(ValueError):
        collector.declaration(said.limit(0), bins, junk)


def test_accepted_frames_become_evidence(spark, tmp_path):
    (tmp_path / "store.json").write_text(json.dumps(DOC))
    tables = store.tables(store.read_store(spark, str(tmp_path / "store.json")))
    declared = spark.createDataFrame([("a", "present"), ("b", "absent")], "bin_id string, state string")
    accepted = spark.createDataFrame([("new.png", 9, "two.jpg")], "path string, ord int, evict string")
    after = collector.record_frames(tables, accepted, declared, tables["samples"], 1)
    images = {r.path: (r.auto, r.excluded) for r in after["images"].collect()}
    assert images["new.png"] == (True, False) and images["two.jpg"] == (True, True)
    assert {(r.bin_id, r.label, r.label_epoch) for r in after["labels"].where("path = 'new.png'").collect()} == {("a", "present", 1), ("b", "absent", 0)}
    assert after["samples"].where("path = 'new.png'").count() == 1
    with pytest.raises(ValueError):
        collector.record_frames(tables, accepted.withColumn("path", F.lit("one.jpg")), declared, tables["samples"], 1)


def test_too_many_declarations_are_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "store.json").write_text(json.dumps(DOC))
    tables = store.tables(store.read_store(spark, str(tmp_path / "store.json")))
    declared = spark.createDataFrame([("a", "present"), ("b", "absent")], "bin_id string, state string")
    accepted = spark.createDataFrame([("new.png", 9, None)], "path string, ord int, evict string")
    for name, most, works in (("MOST_DECLARED", 2, True), ("MOST_DECLARED", 1, False), ("MOST_RECTS", 1, True), ("MOST_RECTS", 0, False)):
        with monkeypatch.context() as m:
            m.setattr(collector, name, most)
            if works:
                assert collector.record_frames(tables, accepted, declared, tables["samples"], 1)["labels"].where("path = 'new.png'").count() == 2
            else:
                with pytest.raises(ValueError):
                    collector.record_frames(tables, accepted, declared, tables["samples"], 1)


def test_documents_survive_the_way_through_tables(spark, tmp_path):
    (tmp_path / "store.json").write_text(json.dumps(DOC))
    read = store.read_store(spark, str(tmp_path / "store.json"))
    store.save_store(store.tables(read), str(tmp_path / "again"))
    plain = lambda d: json.loads(d.toJSON().first())
    before, after = plain(read), plain(store.read_store(spark, str(tmp_path / "again")))
    before["bins"].sort(key=lambda b: b["id"])
    assert after == before
    v1 = {"schema_version": 1, "roi": DOC["roi"], "working_width": 640, "resample": "bilinear", "bins": [{"id": "a", "name": "A"}], "images": [{"path": "x.jpg", "samples": {}, "present": ["a"], "absent": []}]}
    (tmp_path / "old").write_text(json.dumps(v1))
    for _ in range(2):
        assert store.open_store(spark, str(tmp_path / "old")).first().schema_version == 4
    assert spark.read.json(str(tmp_path / "old.v1.bak")).first().schema_version == 1


SHOWN = {"1": set(SPOTS), "2": {"blue", "brown"}, "3": {"yellow"}, "4": set(SPOTS)}


@pytest.fixture()
def evidence_folder(spark, tmp_path):
    """A store and JPEG frames made by the command line and the JVM's writer."""
    folder = tmp_path / "frames"
    folder.mkdir()
    path = str(tmp_path / "store")
    assert cli.main(["init", path, "--roi", "0", "0", "1", "1", "--width", "160", *(x for b in sorted(SPOTS) for x in ("--bin", f"{b}={b.title()}"))]) == 0
    for k, (name, names) in enumerate(SHOWN.items()):
        jvm_encoded(spark, picture(sorted(names), k), folder / f"{name}.jpg", quality=0.95)
        for b in sorted(names):
            x, y, _, _ = SPOTS[b][1]
            assert cli.main(["sample", path, "--image", f"{name}.jpg", "--bin", b, "--rect", str(x + 0.02), str(y + 0.02), "0.05", "0.05"]) == 0
        given = [a for b in sorted(SPOTS) for a in ("--present" if b in names else "--absent", b)]
        assert cli.main(["label", path, "--image", f"{name}.jpg", *given]) == 0
    return path, folder


def test_from_nothing_to_verdicts_on_the_command_line(spark, evidence_folder, tmp_path, capsys):
    path, folder = evidence_folder
    assert cli.main(["validate", path]) == 0
    assert cli.main(["sample", path, "--image", "1.jpg", "--bin", "nobody", "--rect", "0", "0", "0.1", "0.1"]) == 1
    assert cli.main(["label", path, "--image", "1.jpg", "--present", "blue", "--absent", "blue"]) == 1
    assert cli.main(["init", str(tmp_path / "bad"), "--roi", "0.5", "0", "0.9", "1", "--bin", "a=A"]) == 1
    (folder / "5.jpg").write_bytes(b"broken")
    assert cli.main(["learn", path, str(folder), str(tmp_path / "profile")]) == 0
    out = capsys.readouterr()
    assert "learned blue, brown, yellow" in out.out and "5.jpg: cannot be read" in out.err
    doc = store.read_profile(spark, str(tmp_path / "profile")).first()
    # every gate is armed by what the frames showed
    assert 0 < doc.daylight_sat_min < 0.2 and 0.3 < doc.daylight_val_max < 1 and doc.overexposure_clip_max < 1 and doc.row_dup_max < 1
    assert cli.main(["detect", str(tmp_path / "profile"), str(folder)]) == 0
    out = capsys.readouterr().out
    assert out.count("PRESENT") == 9 and "5.jpg: cannot be read" in out
    assert cli.main(["detect", str(tmp_path / "profile"), str(folder), "--json"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert len(rows) == 13 and {r["outcome"] for r in rows if r["error"]} == {"detect_error"}
    assert {(r["file"][0], r["bin_id"]) for r in rows if r["present"]} == {(n, b) for n, names in SHOWN.items() for b in names}


def test_detection_stream_reads_jpegs_and_reports_what_it_cannot_read(spark, evidence_folder, tmp_path):
    _, folder = evidence_folder
    (folder / "broken.png").write_bytes(b"nothing")
    models = [Model("yellow", 49.4, 15, 0.4, 0.4, 0.002)]
    query = collector.detection_stream(collector.frame_stream(spark, str(folder)), models, str(tmp_path / "out"), str(tmp_path / "state"), working_width=160)
    assert collector.watched(query, 120) == "ok"
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("present").count() == 3 and got.where("outcome = 'detect_error'").count() == 1 and got.count() == 5
    # a region that leaves the object out
    rings = [[(0.5, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 1.0)]]
    query = collector.detection_stream(collector.frame_stream(spark, str(folder)), models, str(tmp_path / "out2"), str(tmp_path / "state2"), working_width=160, rings=rings)
    assert collector.watched(query, 120) == "ok"
    assert spark.read.parquet(str(tmp_path / "out2")).where("present").count() == 0
    query = collector.detection_stream(collector.frame_stream(spark, str(folder)), [], str(tmp_path / "out3"), str(tmp_path / "state3"))
    query.awaitTermination()
    assert {r.outcome for r in spark.read.parquet(str(tmp_path / "out3")).collect()} == {"not_calibrated"}
    assert collector.run_status(None, [], None) == "not_calibrated" and collector.run_status(query, models, None) == "no_run_yet" and collector.run_status(query, models, "ok") == "ok"


def test_the_watchdog_stops_a_batch_that_takes_too_long(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"x")
    stream = collector.frame_stream(spark, str(tmp_path / "in"))
    slow = stream.writeStream.foreachBatch(lambda batch, n: time.sleep(60)).option("checkpointLocation", str(tmp_path / "slow")).start()
    time.sleep(2)
    assert collector.run_status(slow, [Model("a", 1, 1, 0, 0)], "ok") == "previous_run_still_busy"
    assert collector.watched(slow, 3) == "watchdog_timeout" and not slow.isActive


def test_one_pass_detection_equals_the_relational_one(spark):
    """The fused map against pixel tables, gates and grouped resolution."""
    pictures = {i: picture(sorted(n), i) for i, n in enumerate(SHOWN.values())} | {9: np.full((60, 80, 3), 255, np.uint8), 10: np.repeat(picture(SPOTS, 0)[:1], 50, 0)}
    rows = [(i, bytearray(frames.encode_png(p))) for i, p in pictures.items()]
    table = spark.createDataFrame(rows, "image_id long, content binary")
    models = [Model("yellow", 49.4, 15, 0.4, 0.4, 0.002, {"min_pos_area_frac": 0.004, "max_neg_area_frac": 0.001}), Model("blue", 222.9, 15, 0.4, 0.4, 0.002), Model("brown", 25.1, 12, 0.4, 0.3, 0.002)]
    rings = [[(0.2, 0.2), (0.9, 0.25), (0.6, 0.9)], [(0.4, 0.4), (0.5, 0.4), (0.45, 0.5)]]
    for shape in (None, rings):
        px = frames.frame_pixels(table, (0.1, 0.1, 0.8, 0.8), 120, rings=shape).withColumns(color.rgb_to_hsv(*(F.col(c) / 255.0 for c in ("r8", "g8", "b8"))))
        want = {(r.image_id, r.bin_id): r for r in learning.detect(px, models).collect()}
        light = {r.image_id: r for r in aggregates.frame_gates(px, LIMITS).collect()}
        got = detector.detect(table, models, LIMITS, roi=(0.1, 0.1, 0.8, 0.8), working_width=120, rings=shape).collect()
        assert len(got) == len(want) == 3 * len(pictures)
        for r in got:
            w, g = want[r.image_id, r.bin_id], light[r.image_id]
            for c in ("area", "provisional_area", "denom", "x0", "y0", "x1", "y1", "present", "uncertain", "conflict_with", "excluded_by"):
                assert r[c] == w[c], (r.image_id, c)
            for c in ("median_sat", "median_val", "clip_frac", "row_dup_frac"):
                assert r[c] == pytest.approx(g[c], abs=1e-9), (r.image_id, c)
            assert (r.damaged, r.grayscale, r.overexposed) == (g.damaged, g.grayscale, g.overexposed)


def test_polygons_as_rasters_and_as_expressions(spark):
    rng = np.random.default_rng(3)
    for _ in range(5):
        rings = [[tuple(map(float, p)) for p in rng.random((int(rng.integers(3, 7)), 2))] for _ in range(int(rng.integers(1, 4)))]
        crop = (0.1, 0.2, 0.7, 0.6)
        mask = frames.polygon_raster(rings, crop, 23, 31)
        grid = spark.createDataFrame([(y, x) for y in range(23) for x in range(31)], "y int, x int")
        lit = F.array(*(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ring)) for ring in rings))
        inside = geometry.point_in_region(lit, F.lit(crop[0]) + (F.col("x") + 0.5) / 31 * crop[2], F.lit(crop[1]) + (F.col("y") + 0.5) / 23 * crop[3])
        assert {(r.y, r.x) for r in grid.where(inside).collect()} == set(zip(*map(list, np.nonzero(mask))))


def test_marks_are_read_in_the_region_they_were_drawn_in(spark):
    whole = picture(["yellow"], 0)
    table = spark.createDataFrame([(1, bytearray(frames.encode_png(whole))), (2, bytearray(b"broken"))], "image_id long, content binary")
    box = "struct<x:double,y:double,w:double,h:double>"
    rect, roi = (0.32, 0.32, 0.06, 0.06), (0.25, 0.25, 0.25, 0.25)
    rows = [(1, "yellow", False, 0, rect, (0.0, 0.0, 1.0, 1.0)), (1, "yellow", False, 1, rect, roi), (1, "yellow", True, 2, (0.9, 0.9, 0.0001, 0.0001), (0.0, 0.0, 1.0, 1.0)), (2, "yellow", False, 0, rect, roi)]
    marks = spark.createDataFrame(rows, f"image_id long, bin_id string, auto boolean, ord int, rect {box}, roi {box}")
    got = frames.marked_pixels(table, marks, 160).toPandas()
    wide, close = frames.working_frame(whole, working_width=160), frames.working_frame(whole, roi, 160)
    for n, grid, (x0, y0, x1, y1) in ((0, wide, frames.crop_box(rect, 160, 100)), (1, close, frames.crop_box((0.28, 0.28, 0.24, 0.24), 160, 100))):
        mine = got[(got.image_id == 1) & (got.ord == n)].sort_values(["y", "x"])
        assert (mine[["r8", "g8", "b8"]].to_numpy(int) == grid[y0:y1, x0:x1].reshape(-1, 3)).all() and len(mine) == (x1 - x0) * (y1 - y0)
    assert sorted((r.image_id, r.ord) for r in got[got.error.notna()].itertuples()) == [(1, 2), (2, 0)]


def test_edge_band_is_learned_and_its_losses_are_told(spark):
    """Objects at the rim teach how deep they reach; a bin whose objects all
    lie shallower than that is not found, and the reason is given."""
    red, green = (0.9, 0.1, 0.1), (0.1, 0.8, 0.2)
    place = {1: (0.0, 0.3, 0.2, 0.2), 2: (0.0, 0.5, 0.25, 0.2), 3: (0.8, 0.2, 0.2, 0.25)}
    pictures = {i: frames.scene(rects=[(red, r), (green, (0.4, 0.4, 0.1, 0.1))], seed=i) for i, r in place.items()}
    px = pixels(spark, pictures).withColumn("in_region", F.lit(True))
    seeds, labels = [], []
    for i, (x, y, w, h) in place.items():
        seeds += [(i, b, cy + d, cx) for b, cy, cx in (("red", int((y + h / 2) * 200), int((x + w / 2) * 320)), ("green", 90, 144)) for d in range(9)]
        labels += [(i, "red", "present", False), (i, "green", "present", False)]
    seeds, labels = spark.createDataFrame(seeds, "image_id long, bin_id string, y int, x int"), spark.createDataFrame(labels, "image_id long, bin_id string, label string, auto boolean")
    near = seeds.select("image_id", "bin_id", "y", F.explode(F.sequence(F.col("x") - 5, F.col("x") + 5)).alias("x"))
    samples = px.join(near, ["image_id", "y", "x"]).select("bin_id", "image_id", "hue", "sat", "val")
    models, warnings = learning.learn_profile(samples, px, labels, seeds)
    got = {m.id: m for m in models}
    # 64, 80 and 64 columns of 320 deep from the side, less the median step of 16
    assert got["red"].stat("region_edge_depth_n") == 3 and got["red"].stat("region_edge_depth_min_frac") == pytest.approx(48 / 320)
    assert got["green"].stat("region_edge_depth_n") is None
    shallow = Model("red", got["red"].hue, got["red"].tol, got["red"].sat_min, got["red"].val_min, 0.001, {"region_edge_depth_n": 2, "region_edge_depth_min_frac": 0.2})
    assert learning.lost_to_the_band(px, [shallow], ["red"], labels.where("label = 'present'")) == ["red"]
    assert learning.lost_to_the_band(px, [got["green"]], [], labels) == []


def test_gates_heal_from_what_may_teach_them(spark):
    rows = [("c", 1, 0.5, 0.5, 0.1, False, False), ("c", 2, 0.1, 0.9, 0.5, True, False), ("c", 3, 0.05, 0.4, 0.1, False, True), ("c", 4, 0.6, 0.7, 0.3, False, False), ("c", 5, 0.4, 0.5, 0.2, False, False), ("d", 1, 0.1, 0.1, 0.1, True, True)]
    table = spark.createDataFrame(rows, "camera string, seq int, median_sat double, median_val double, clip_frac double, damaged boolean, grayscale boolean")
    got = {(r.camera, r.seq): (r.median_sat_limit, r.median_val_limit) for r in stability.healing_gates(table, 2).collect()}
    near = lambda a, b: a == pytest.approx(b)
    assert near(got["c", 1], (0.5, 0.5)) and got["c", 1] == got["c", 2] == got["c", 3]
    assert near(got["c", 4], (0.4, 0.9)) and near(got["c", 5], (0.2, 0.9)) and got["d", 1] == (None, None)


def test_relearning_widens_gates_and_saves(spark):
    schema = "bin_id string, hue_center double, hue_tol double, separable boolean, min_pos double, max_neg double"
    good, bad = (spark.createDataFrame([("a", 10.0, 5.0, ok, 0.2, 0.1)], schema) for ok in (True, False))
    none = spark.createDataFrame([], "path string, bin_id string")
    old, new = {"daylight_sat_min": 0.2, "daylight_val_max": 0.8}, {"daylight_sat_min": 0.3, "daylight_val_max": 0.9}
    saved = []
    for worse, trust in ((good, False), (bad, False), (bad, True)):
        saved.append(learning.relearn(lambda e: (e, None), good, worse, lambda m: none, gates=(old, new), trust_marks=trust, save=lambda m, g: saved.append((m, g))))
    assert [s["adopted"] for s in saved[1::2]] == [True, False, True] and [s["forced"] for s in saved[1::2]] == [False, False, True]
    assert saved[0] == (good, {"daylight_sat_min": 0.2, "daylight_val_max": 0.9}) and saved[2][0] is good and saved[4][0] is bad
    assert saved[3]["pause_collection"] and saved[3]["regressions"]


def test_gate_samples_end_with_the_view_they_describe(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    config = lambda roi=(0.1, 0.1, 0.5, 0.5), width=640, view=1: spark.createDataFrame([(roi, None, width, view)], f"roi {box}, rings array<array<struct<x:double,y:double>>>, working_width int, view_epoch int")
    assert evidence.gates_survive(config(), config()) and evidence.gates_survive(config(), config().withColumn("rings", F.array()))
    assert not evidence.gates_survive(config(), config(roi=(0.1, 0.1, 0.5, 0.6))) and not evidence.gates_survive(config(), config(width=320)) and not evidence.gates_survive(config(), config(view=2))


def test_entries_archives_and_vaults(spark, tmp_path):
    assert catalog.resolve_entry(["a"]) == "a" and catalog.resolve_entry(["a", "b"], "b") == "b"
    for loaded, asked in (([], None), (["a", "b"], None), (["a"], "b")):
        with pytest.raises(ValueError):
            catalog.resolve_entry(loaded, asked)
    assert catalog.archive_folder({"z": "/z", "local": "/l"}, "/c", "e") == "/l/huescope/e"
    assert catalog.archive_folder({"z": "/z", "b": "/b"}, "/c", "e") == "/b/huescope/e" and catalog.mirror_path({}, "/c", "e") == "/c/media/huescope/e/store.json"
    (tmp_path / "store.json").write_text(json.dumps(DOC))
    tables = store.tables(store.read_store(spark, str(tmp_path / "store.json")))
    mirror = catalog.mirror_path({"local": str(tmp_path / "media")}, "", "e")
    vault = catalog.Vault(spark, str(tmp_path / "own"), mirror)
    assert vault.save(tables) and store.read_store(spark, mirror).count() == 1
    assert vault.save(vault.load() | {"labels": tables["labels"].limit(0)}) and vault.load()["labels"].count() == 0
    late = catalog.Vault(spark, str(tmp_path / "own"), mirror)
    late.close()
    assert not late.save(tables) and vault.load()["labels"].count() == 0
    assert vault.remove() and not (tmp_path / "own").exists() and not vault.save(tables)
    assert store.tables(store.read_store(spark, mirror))["images"].count() == 3


def test_region_payloads(spark):
    point = "struct<x:double,y:double>"
    rows = [(0.1, 0.1, 0.5, 0.5, None), (0.1, None, 0.5, 0.5, None), (0.6, 0.1, 0.5, 0.5, None), (None, None, None, None, [[(0.1, 0.1), (0.5, 0.1), (0.3, 0.9)]]), (None, None, None, None, [[(0.1, 0.1), (0.5, 0.1)]])]
    table = spark.createDataFrame(rows, f"x double, y double, w double, h double, rings array<array<{point}>>")
    got = [r[0] for r in table.select(geometry.region_payload_error(*(F.col(c) for c in ("x", "y", "w", "h", "rings")))).collect()]
    assert [g is None for g in got] == [True, False, False, True, False]
