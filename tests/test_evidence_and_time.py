import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from huescope.functions import geometry
from huescope.operators import evidence
from huescope.sources import store
from huescope.streaming import stability

DOC = {
    "schema_version": 4, "roi": {"x": 0.1, "y": 0.1, "w": 0.8, "h": 0.8}, "roi_polygons": None, "working_width": 640, "resample": "bilinear", "view_epoch": 1, "capture_epochs": {"old.jpg": 0},
    "bins": [{"id": "a", "name": "A", "active": True, "appearance_epoch": 1}, {"id": "b", "name": "B", "active": True, "appearance_epoch": 0}, {"id": "gone", "name": "G", "active": False, "appearance_epoch": 0}],
    "images": [
        {"path": "one.jpg", "samples": {"a": [{"rect": {"x": 0.2, "y": 0.2, "w": 0.1, "h": 0.1}, "roi": {"x": 0, "y": 0, "w": 1, "h": 1}, "epoch": 1}]}, "present": ["a"], "absent": ["b"], "label_roi": {"x": 0, "y": 0, "w": 1, "h": 1}, "label_polygons": None, "label_epoch": {"a": 1, "b": 0}, "view_epoch": 1, "excluded": False, "auto": None},
        {"path": "two.jpg", "samples": {}, "present": ["a"], "absent": [], "label_roi": {"x": 0, "y": 0, "w": 1, "h": 1}, "label_polygons": None, "label_epoch": {"a": 1}, "view_epoch": 0, "excluded": False, "auto": {"median_sat": 0.4, "median_val": 0.5}},
        {"path": "three.jpg", "samples": {}, "present": [], "absent": ["b"], "label_roi": {"x": 0.2, "y": 0.2, "w": 0.2, "h": 0.2}, "label_polygons": None, "label_epoch": {"b": 0}, "view_epoch": 1, "excluded": False, "auto": None},
    ],
}


@pytest.fixture()
def tables(spark, tmp_path):
    (tmp_path / "store.json").write_text(json.dumps(DOC))
    return store.tables(store.read_store(spark, str(tmp_path / "store.json")))


def test_learning_view(tables):
    got = {(r.path, r.bin_id): r.usable for r in evidence.usable_labels(tables["labels"], tables["images"], tables["samples"], tables["bins"], tables["config"]).collect()}
    # the rectangle proves the first; the view of the second is old; the third's region is too small
    assert got == {("one.jpg", "a"): True, ("one.jpg", "b"): True, ("two.jpg", "a"): False, ("three.jpg", "b"): False}
    assert evidence.usable_samples(tables["samples"], tables["images"], tables["bins"]).count() == 1
    recoloured = evidence.mark_appearance_changed(tables["bins"], "a")
    assert evidence.usable_samples(tables["samples"], tables["images"], recoloured).count() == 0


def test_validation(spark, tables):
    order = ("bins", "images", "labels", "samples", "config")
    assert evidence.store_violations(*(tables[k] for k in order)).count() == 0
    tables["labels"] = tables["labels"].union(spark.createDataFrame([("one.jpg", "a", "absent", 9), ("one.jpg", "zzz", "present", 0)], tables["labels"].schema))
    got = {r.rule for r in evidence.store_violations(*(tables[k] for k in order)).collect()}
    assert got == {"undeclared bin in a label", "present and absent", "label epoch out of range"}


def test_commands(spark, tables):
    given = spark.createDataFrame([("one.jpg", "b", "present"), ("new.jpg", "a", "absent")], "path string, bin_id string, label string")
    after = {(r.path, r.bin_id): (r.label, r.label_epoch) for r in evidence.set_labels(tables["labels"], given, tables["bins"]).collect()}
    assert after["one.jpg", "b"] == ("present", 0) and after["new.jpg", "a"] == ("absent", 1) and len(after) == 5
    with pytest.raises(ValueError):
        evidence.set_labels(tables["labels"], given.withColumn("bin_id", F.lit("zzz")), tables["bins"])
    forgotten = evidence.set_excluded(tables["images"], given, True)
    assert {r.path: r.excluded for r in forgotten.collect()} == {"one.jpg": True, "two.jpg": False, "three.jpg": False}
    assert evidence.has_auto_evidence(tables["images"]) and not evidence.has_auto_evidence(evidence.set_auto_excluded(tables["images"], True))
    epochs = spark.createDataFrame([("late.jpg", 0)], "path string, capture_epoch int")
    images = evidence.ensure_images(tables["images"], spark.createDataFrame([("late.jpg",), ("now.jpg",), ("one.jpg",)], "path string"), epochs, 1)
    assert {r.path: (r.ord, r.view_epoch) for r in images.collect() if r.ord > 2} == {"late.jpg": (3, 0), "now.jpg": (4, 1)}
    box = geometry.rect_as_rings(geometry.rect(0.1, 0.2, 0.3, 0.4))
    assert evidence.set_region(tables["config"], box).first().rings is None
    config, kept = evidence.bump_view(tables["config"], epochs, spark.createDataFrame([("x.jpg",)], "path string"))
    assert config.first().view_epoch == 2 and {tuple(r) for r in kept.collect()} == {("late.jpg", 0), ("x.jpg", 1)}
    merged = evidence.reconcile_bins(spark.createDataFrame([("a", "A2"), ("n", "N")], "bin_id string, name string"), tables["bins"])
    assert {r.bin_id: (r.name, r.active, r.appearance_epoch) for r in merged.collect()} == {"a": ("A2", True, 1), "b": ("B", False, 0), "gone": ("G", False, 0), "n": ("N", True, 0)}


def test_documents(spark, tmp_path):
    (tmp_path / "store.json").write_text(json.dumps(DOC))
    doc = store.read_store(spark, str(tmp_path / "store.json"))
    store.write_document(doc, str(tmp_path / "out"))
    assert store.read_store(spark, str(tmp_path / "out")).collect() == doc.collect()
    (tmp_path / "bad.json").write_text(json.dumps(DOC | {"schema_version": 9}))
    with pytest.raises(ValueError):
        store.read_store(spark, str(tmp_path / "bad.json"))
    v1 = {"roi": {"x": 0.5, "y": 0.5, "w": 0.5, "h": 0.5}, "working_width": 320, "resample": "nearest", "bins": [{"id": "a", "name": "A"}], "images": [{"path": "p", "samples": {"a": [{"x": 0.0, "y": 0.5, "w": 0.5, "h": 0.5}, {"x": 0, "y": 0, "w": 0, "h": 0.1}]}, "present": ["a"], "absent": None}]}
    (tmp_path / "v1.json").write_text(json.dumps(v1))
    new = store.tables(store.migrate_v1(store.read_document(spark, str(tmp_path / "v1.json"), store.V1)))
    assert [tuple(r.rect) for r in new["samples"].collect()] == [(0.5, 0.75, 0.25, 0.25)] and new["labels"].first().label_epoch == 0


def simulate(rows, confirm):
    state, out = {}, []
    for camera, bin_id, seq, ok, present, uncertain in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held, streak = state.get((camera, bin_id), (None, 0))
        if not ok or uncertain:
            streak = 0
        elif held is None or held == present:
            held, streak = present, 0
        else:
            streak += 1
            if streak >= confirm:
                held, streak = present, 0
        state[camera, bin_id] = (held, streak)
        out.append((camera, bin_id, seq, held))
    return sorted(out, key=str)


@pytest.mark.parametrize("confirm", [1, 2, 4])
def test_stability_batch_and_stream_equal_a_simulation(spark, confirm):
    rng = np.random.default_rng(confirm)
    rows = [(int(c), b, s, bool(rng.random() > 0.1), bool(rng.random() > 0.4), bool(rng.random() > 0.85)) for c in range(4) for b in ("a", "b") for s in range(1, 80)]
    df = spark.createDataFrame(rows, "camera long, bin_id string, seq long, ok boolean, present boolean, uncertain boolean")
    want = simulate(rows, confirm)
    batch = stability.stability_batch(df, confirm).select("camera", "bin_id", "seq", "accepted").collect()
    assert sorted(map(tuple, batch), key=str) == want
    if confirm == 2:
        live = stability.replay(df, confirm).select("camera", "bin_id", "seq", "accepted").collect()
        assert sorted(map(tuple, live), key=str) == want


def test_rolling_gates_forget(spark):
    rows = [(1, s, 0.5, 0.9 if s == 1 else 0.5, 0.0) for s in range(1, 12)]
    df = spark.createDataFrame(rows, "camera long, seq long, median_sat double, median_val double, clip_frac double")
    got = {r.seq: r.median_val_limit for r in stability.rolling_gates(df, 4).collect()}
    assert got[1] == 0.9 and got[4] == 0.9 and got[6] == 0.5
    assert stability.rolling_window(900) == 96
