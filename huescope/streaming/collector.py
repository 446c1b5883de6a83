"""Collecting frames on its own: sources, conditions, evaluation, recording.

A learning session declares which bins are present and which are away; while
it runs, frames that bring new light are kept as evidence, each situation
within its capacity.
"""

from __future__ import annotations

import json
import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates, detector, evidence, reservoir
from ..operators.palette import JUNK_WARN, CalibrationError, Palette, learn_band
from ..operators.raster import Model
from ..sources import frames

CONDITIONS = ("paused", "busy", "no_profile", "relearning", "no_declaration", "dark", "no_mark")


def frame_stream(spark: SparkSession, folder: str, pattern: str = frames.PICTURES, per_trigger: int = 64) -> DataFrame:
    """Frames as they land in a folder, a bounded number each trigger."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)


def skip_reason(state: dict[str, Column]) -> Column:
    """Why a tick collects nothing, the cheapest question first; NULL: go on.

    ``state`` has a condition for each of :data:`CONDITIONS`.
    """
    out = F.lit(None).cast("string")
    for name in reversed(CONDITIONS):
        out = F.when(F.coalesce(state[name], F.lit(False)), F.lit(name)).otherwise(out)
    return out


def declaration(declared: DataFrame, bins: DataFrame, junk: DataFrame, junk_warn: float = JUNK_WARN) -> DataFrame:
    """The declaration (bin_id, state) of active bins, with a warning on bins
    whose marks held much of another colour; undeclared bins are an error."""
    active = evidence.active_bins(bins).select("bin_id")
    missing = active.join(declared, "bin_id", "left_anti").union(declared.select("bin_id").join(active, "bin_id", "left_anti"))
    if not missing.isEmpty():
        raise ValueError("the declaration must name every active bin and no other")
    return declared.join(junk, "bin_id", "left").select("bin_id", "state", (F.coalesce("junk_fraction", F.lit(0.0)) > junk_warn).alias("fragile"))


def patch_coherence(patches: DataFrame, trust_marks: bool = False) -> DataFrame:
    """Per frame, whether each marked patch shows one colour, whichever:
    (image_id, coherent, n_patches).  Never asks the models, which would
    refuse just the frames that bring something new."""
    schema = "image_id long, bin_id string, coherent boolean"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        try:
            learn_band(Palette.of_pixels(part.hue, part.sat, part.val), trust_marks=trust_marks)
            ok = True
        except CalibrationError:
            ok = False
        return pd.DataFrame({"image_id": [part.image_id.iloc[0]], "bin_id": [part.bin_id.iloc[0]], "coherent": [ok]})

    one = patches.select("image_id", "bin_id", "hue", "sat", "val").groupBy("image_id", "bin_id").applyInPandas(run, schema)
    return one.groupBy("image_id").agg(F.bool_and("coherent").alias("coherent"), F.count("*").alias("n_patches"))


def evaluate_frames(pixels: DataFrame, patches: DataFrame, limits: dict[str, float], situation: str, references: int, *, trust_marks: bool = False, capacity: int = reservoir.CAPACITY) -> DataFrame:
    """Does each frame (in order of image_id) earn a place in its situation?

    Damaged and grey frames never do; over-exposed ones only with
    ``trust_marks``.  Every one of the ``references`` marked bins must show a
    coherent patch.  What is left competes for the light it covers.
    Returns image_id, sat, val, accept, reason, evict.
    """
    light = aggregates.frame_gates(pixels, limits).select("image_id", F.col("median_sat").alias("sat"), F.col("median_val").alias("val"), "damaged", "grayscale", "overexposed")
    got = light.join(patch_coherence(patches, trust_marks), "image_id", "left")
    whole = F.coalesce("n_patches", F.lit(0)) >= references
    over = F.col("overexposed") & F.lit(not trust_marks)
    reason = F.when(F.col("damaged"), "frame_integrity").when(F.col("grayscale"), "greyscale").when(over, "overexposed").when(~whole, "empty_patch").when(~F.coalesce("coherent", F.lit(True)), "incoherent_patch")
    judged = got.withColumns({"refused": reason, "situation": F.lit(situation), "path": F.col("image_id").cast("string")})
    kept = reservoir.replay(judged.where("refused is null"), ["situation"], "image_id", capacity).select("image_id", "accept", "reason", "evict")
    out = judged.join(kept, "image_id", "left")
    return out.select("image_id", "sat", "val", F.coalesce("accept", F.lit(False)).alias("accept"), F.coalesce("refused", "reason").alias("reason"), "evict")


#: Declarations and rectangles of one session; an installation has a handful.
MOST_DECLARED, MOST_RECTS = 1_000, 10_000


def _few(rows: DataFrame, most: int, what: str) -> list:
    """All rows, which must not be more than ``most``."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"over {most} {what}")
    return got


def _for_each(frames: DataFrame, rows: list, schema: str) -> DataFrame:
    """Every frame with every one of a few rows."""
    some = frames.sparkSession.createDataFrame(rows, schema).select(F.collect_list(F.struct("*")).alias("x")).first().x
    literal = F.from_json(F.lit(json.dumps([r.asDict(True) for r in some])), f"array<struct<{schema}>>")
    return frames.select("path", F.explode(literal).alias("r")).select("path", "r.*")


def record_frames(tables: dict[str, DataFrame], accepted: DataFrame, declared: DataFrame, rects: DataFrame, view_epoch: int) -> dict[str, DataFrame]:
    """The evidence tables with the accepted frames (path, ord, evict) added:
    an automatic entry each, its declared labels, its reference rectangles
    as samples; evicted frames are forgotten.  Everything is checked before
    anything is returned, so a batch is written whole or not at all; a
    declaration or rectangles beyond what a session can have are an error."""
    new = accepted.select("path", "ord", F.lit(view_epoch).alias("view_epoch"), F.lit(False).alias("excluded"), F.lit(True).alias("auto"))
    if not new.join(tables["images"], "path", "left_semi").isEmpty():
        raise ValueError("a frame is recorded already")
    said = _few(declared.select("bin_id", F.col("state").alias("label")), MOST_DECLARED, "declared bins")
    shown = declared.where("state = 'present'").select("bin_id")
    box = "struct<x:double,y:double,w:double,h:double>"
    marks = _few(rects.join(shown, "bin_id", "left_semi").select("bin_id", "ord", "rect", "roi"), MOST_RECTS, "reference rectangles")
    labels = evidence.set_labels(tables["labels"], _for_each(accepted, said, "bin_id string, label string"), tables["bins"]) if said else tables["labels"]
    samples = evidence.add_samples(tables["samples"], _for_each(accepted, marks, f"bin_id string, ord int, rect {box}, roi {box}"), tables["bins"]) if marks else tables["samples"]
    images = tables["images"].unionByName(new, allowMissingColumns=True)
    gone = accepted.where("evict is not null").select(F.col("evict").alias("path"))
    return tables | {"images": evidence.set_excluded(images, gone, True), "labels": labels, "samples": samples}


def detection_stream(stream: DataFrame, models: list[Model], folder: str, checkpoint: str, *, roi=(0.0, 0.0, 1.0, 1.0), working_width: int | None = 640, resample: str = "bilinear", rings=None, limits: dict[str, float] | None = None, every: float | None = None):
    """Detect on every landing frame and write verdicts, light and outcome by
    batch; frames that cannot be read are rows with their error.

    A batch writes into a folder of its own number, so that a batch that is
    repeated after a failure replaces what it had written.  With ``every``
    seconds the stream goes on at that cadence, one batch at a time; without
    it, it ends when all frames at hand are done.  Without models nothing is
    detected: each frame's outcome is ``not_calibrated``.
    """
    def handle(batch: DataFrame, number: int) -> None:
        named = batch.withColumn("image_id", F.xxhash64("path"))
        if models:
            found = detector.detect(named, models, limits, roi=roi, working_width=working_width, resample=resample, rings=rings)
        else:
            found = named.select("image_id", F.lit("not_calibrated").alias("outcome"))
        found.join(named.select("image_id", "path", "modificationTime"), "image_id").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=f"{every} seconds")).start()


def watched(query, seconds: float, poll: float = 0.2) -> str:
    """Let one batch of a stream take at most ``seconds``: its scan interval.

    Returns how the watch ended: ``ok`` when the stream ended by itself,
    ``detect_error`` when it failed, ``watchdog_timeout`` after stopping it.
    """
    began, batch = time.monotonic(), None
    while not query.awaitTermination(poll):
        progress = query.lastProgress
        now = (progress or {}).get("batchId") if isinstance(progress, dict) else getattr(progress, "batchId", None)
        if now != batch or not query.status["isTriggerActive"]:
            began, batch = time.monotonic(), now
        elif time.monotonic() - began > seconds:
            query.stop()
            return "watchdog_timeout"
    return "detect_error" if query.exception() is not None else "ok"


def run_status(query, models: list[Model], last: str | None) -> str:
    """What a look at the stream finds now: a batch still at work, nothing
    learned yet, nothing run yet, or the ``last`` frame's outcome."""
    if query is not None and query.isActive and query.status["isTriggerActive"]:
        return "previous_run_still_busy"
    if not models:
        return "not_calibrated"
    return last or "no_run_yet"
