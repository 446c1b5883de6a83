"""Pixels against models, and theta joins among models.

The models' side is small by nature (object classes of one installation);
``few`` checks that before it is broadcast or put into expressions.  A larger
side meets the pixels by the degree of their hue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color


MOST = 1_000  # models that are broadcast, or become expressions


def few(models: DataFrame) -> bool:
    return models.limit(MOST + 1).count() <= MOST


def models_side(models: DataFrame) -> DataFrame:
    """The models, marked for broadcast if they are a few."""
    return F.broadcast(models) if few(models) else models


def _by_degree(models: DataFrame) -> DataFrame:
    """Each model once for every degree of hue that its band touches."""
    low, high = F.floor(F.col("hue_center") - F.col("hue_tol")), F.floor(F.col("hue_center") + F.col("hue_tol"))
    degrees = F.when(F.col("hue_tol") >= 180, F.sequence(F.lit(0).cast("long"), F.lit(359).cast("long"))).otherwise(F.array_distinct(F.transform(F.sequence(low, high), lambda d: F.pmod(d, F.lit(360).cast("long")))))
    return models.select("*", F.explode(degrees).alias("_degree"))


def match_models(pixels: DataFrame, models: DataFrame) -> DataFrame:
    """Every pixel that some model accepts, with the model and the distance.

    ``models``: bin_id, hue_center, hue_tol, sat_min, val_min.  A few models
    are broadcast and the conditions evaluated in the join; more of them are
    joined by degree of hue, where only neighbours meet.
    """
    m = models.select("bin_id", "hue_center", "hue_tol", "sat_min", "val_min")
    got = color.bin_match(*(F.col(c) for c in ("hue", "sat", "val", "hue_center", "hue_tol", "sat_min", "val_min")))
    if few(m):
        joined = pixels.join(F.broadcast(m), got["accepted"])
    else:
        degree = F.pmod(F.floor("hue"), F.lit(360).cast("long"))
        joined = pixels.withColumn("_degree", degree).join(_by_degree(m), "_degree").where(got["accepted"]).drop("_degree")
    return joined.withColumn("distance", got["distance"]).drop("hue_center", "hue_tol", "sat_min", "val_min")


def exclusive_masks(pixels: DataFrame, models: DataFrame, keys: list[str] = ["image_id", "y", "x"]) -> DataFrame:
    """Each pixel's one model: the smallest hue distance, nobody on a tie.

    Pixels are judged alone, so the (few) models' distances become columns
    of the pixel's own row instead of a window over pixel keys: no shuffle,
    and all of it inside generated code.  More than a few models are matched
    by degree of hue and settled by a window over ``keys``.
    """
    m = models.select("bin_id", "hue_center", "hue_tol", "sat_min", "val_min").orderBy("bin_id").limit(MOST + 1).collect()
    if len(m) > MOST:
        pixel = Window.partitionBy(*keys)
        near = match_models(pixels, models).withColumn("_best", F.min("distance").over(pixel)).where("distance = _best")
        return near.withColumn("_n", F.count("*").over(pixel)).where("_n = 1").drop("_best", "_n", "distance")
    if not m:
        return pixels.withColumn("bin_id", F.lit(None).cast("string")).where(F.lit(False))
    claims = {}
    for i, r in enumerate(m):
        got = color.bin_match(F.col("hue"), F.col("sat"), F.col("val"), *(F.lit(float(r[c])) for c in ("hue_center", "hue_tol", "sat_min", "val_min")))
        claims[f"_d{i}"] = F.when(got["accepted"], got["distance"])
    best = F.least(*(F.col(c) for c in claims)) if len(m) > 1 else F.col("_d0")
    won = [F.col(f"_d{i}") == F.col("_best") for i in range(len(m))]
    alone = sum((F.coalesce(w.cast("int"), F.lit(0)) for w in won), F.lit(0)) == 1
    name = F.coalesce(*(F.when(w, F.lit(r.bin_id)) for w, r in zip(won, m)))
    tagged = pixels.withColumns(claims).withColumn("_best", best)
    # exploding drops unassigned pixels; a filter would be pushed below the
    # distances and copy their expressions into every mention
    return tagged.select(*pixels.columns, F.explode(F.when(alone, F.array(name))).alias("bin_id"))


def exclusive_keep_frac(pixels: DataFrame, models: DataFrame) -> DataFrame:
    """Per model, the share of its plain mask that exclusivity leaves; 1
    where the plain mask is empty."""
    plain = match_models(pixels, models).groupBy("bin_id").agg(F.count("*").alias("total"))
    kept = exclusive_masks(pixels, models).groupBy("bin_id").agg(F.count("*").alias("kept"))
    got = models.select("bin_id").join(plain, "bin_id", "left").join(kept, "bin_id", "left")
    return got.select("bin_id", F.coalesce(F.coalesce("kept", F.lit(0)) / F.col("total"), F.lit(1.0)).alias("keep_frac"))


def hue_overlap_pairs(models: DataFrame) -> DataFrame:
    """(a, b), a < b, of models whose hue bands overlap."""
    a, b = (models.select(F.col("bin_id").alias(n), F.col("hue_center").alias(f"{n}_c"), F.col("hue_tol").alias(f"{n}_t")) for n in "ab")
    near = color.hue_bands_overlap(*(F.col(c) for c in ("a_c", "a_t", "b_c", "b_t")))
    return a.join(models_side(b), (F.col("a") < F.col("b")) & near).select("a", "b")


def area_fractions(masks: DataFrame, denominators: DataFrame) -> DataFrame:
    """area and area_frac of each (image_id, bin_id) over the frame's cells."""
    area = masks.groupBy("image_id", "bin_id").agg(F.count("*").alias("area"))
    return area.join(denominators, "image_id").withColumn("area_frac", F.col("area") / F.col("denom"))


def best_per_image(df: DataFrame, order: list) -> DataFrame:
    """The first row of each (image_id, bin_id)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("image_id", "bin_id").orderBy(*order))).where("_n = 1").drop("_n")
