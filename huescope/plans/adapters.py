"""The driver's tables read as frames, readings and labelled evidence.

There are no images among the test tables, so pseudo-frames are built from
columns; each has a bounded number of pixels and their number grows with the
data.  Every adapter has the same definition in SQL, in ``CTE``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color

WIDTH = 24
#: (bin_id, hue_center, hue_tol, sat_min, val_min, min_area_frac, min_pos, max_neg, separable)
BINS = [("blue", 220.0, 40.0, 0.2, 0.2, 0.16, 0.12, 0.05, True), ("brown", 25.0, 30.0, 0.3, 0.2, 0.14, 0.15, 0.06, True), ("green", 130.0, 45.0, 0.2, 0.2, 0.2, 0.17, 0.19, False), ("red", 355.0, 25.0, 0.3, 0.2, 0.12, 0.1, 0.02, True), ("yellow", 52.0, 24.0, 0.3, 0.3, 0.11, None, 0.04, False)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bins(spark: SparkSession) -> DataFrame:
    """The five models."""
    return spark.createDataFrame(BINS, "bin_id string, hue_center double, hue_tol double, sat_min double, val_min double, min_area_frac double, min_pos double, max_neg double, separable boolean")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models out of a table: a nation is a bin, its keys give band and areas."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("bin_id"), (key * 47 % 360).cast("double").alias("hue_center"), (region * 3 + 4).cast("double").alias("hue_tol"), (key % 4 != 0).alias("separable"),
        F.when(key % 7 != 3, (region * 3 + 5) / 100.0).alias("min_pos"), ((key % 5 * 3 + 2) / 100.0).alias("max_neg"), (key % 5 != 1).alias("active"))


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels: a supplier's line items in order fill a frame 24 wide."""
    by = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    items = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(by) - 1)
    channel = lambda c: c.cast("int")
    return items.select(F.col("l_suppkey").alias("image_id"), F.floor(F.col("i") / WIDTH).cast("int").alias("y"), (F.col("i") % WIDTH).cast("int").alias("x"),
        channel(F.col("l_partkey") * 37 % 256).alias("r8"), channel((F.col("l_orderkey") * 11 + F.col("l_linenumber") * 53) % 256).alias("g8"), channel(F.col("l_quantity").cast("long") * 5 % 256).alias("b8"))


def hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with hue, sat and val."""
    p = px(spark, sf_dir)
    return p.withColumns(color.rgb_to_hsv(*(F.col(c) / 255.0 for c in ("r8", "g8", "b8"))))


def grid8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 grids: an embedding's components in reading order, those above
    zero are the mask; its label names the bin."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.concat(F.lit("bin"), F.col("label").cast("string")).alias("bin_id"), F.posexplode("embedding").alias("i", "e"))
    return e.select("image_id", "bin_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), (F.col("e") > 0).alias("m"), F.col("e").cast("double").alias("e"))


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings over time: a user is a camera, its events in order are frames.

    area_frac from the value; errors are damaged frames, views grey ones and
    signups over-exposed by value; light from the value and the properties.
    """
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(by).cast("long"))
    return e.select(F.col("user_id").alias("camera"), "seq", "event_id", "ts", "event_type", (F.col("value") / 400.0).alias("area_frac"), (k / 100.0).alias("median_sat"), (F.least(F.col("value"), F.lit(250.0)) / 250.0).alias("median_val"), (F.col("event_id") % 97 / 97.0).alias("clip_frac"), (F.col("event_id") % 89 / 890.0).alias("row_dup_frac"))


def label_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: an order is an image, a customer's segment its bin; status F is
    present, O absent, P unlabelled; the priority's digit is its epoch."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("bin_id")), "o_custkey")
    label = F.when(F.col("o_orderstatus") == "F", "present").when(F.col("o_orderstatus") == "O", "absent")
    return o.select(F.col("o_orderkey").alias("image_id"), "bin_id", label.alias("label"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("label_epoch"), (F.col("o_custkey") % 3).cast("int").alias("view_epoch"), (F.col("o_orderkey") % 10 == 7).alias("excluded"), (F.col("o_orderkey") % 4 == 1).alias("auto"), (F.col("o_totalprice") / 1000000.0).alias("area_frac"))


_VALUES = ", ".join("(" + ", ".join("NULL::DOUBLE" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v}::DOUBLE" for v in r) + ")" for r in BINS)
CTE = {
    "bins": f"bins(bin_id, hue_center, hue_tol, sat_min, val_min, min_area_frac, min_pos, max_neg, separable) AS (VALUES {_VALUES})",
    "catalog": """catalog AS (
  SELECT n_name AS bin_id, CAST(n_nationkey * 47 % 360 AS DOUBLE) AS hue_center, CAST(n_regionkey * 3 + 4 AS DOUBLE) AS hue_tol, n_nationkey % 4 <> 0 AS separable,
    CASE WHEN n_nationkey % 7 <> 3 THEN (n_regionkey * 3 + 5) / 100.0::DOUBLE END AS min_pos, (n_nationkey % 5 * 3 + 2) / 100.0::DOUBLE AS max_neg, n_nationkey % 5 <> 1 AS active
  FROM nation)""",
    "px": """px AS (
  SELECT image_id, CAST(i // 24 AS INTEGER) AS y, CAST(i % 24 AS INTEGER) AS x, r8, g8, b8 FROM (
    SELECT l_suppkey AS image_id,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS i,
      CAST(l_partkey * 37 % 256 AS INTEGER) AS r8, CAST((l_orderkey * 11 + l_linenumber * 53) % 256 AS INTEGER) AS g8,
      CAST(CAST(l_quantity AS BIGINT) * 5 % 256 AS INTEGER) AS b8
    FROM lineitem))""",
    "hsv": """rgb AS (SELECT *, r8 / 255.0::DOUBLE AS r, g8 / 255.0::DOUBLE AS g, b8 / 255.0::DOUBLE AS b FROM px),
mm AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS c FROM rgb),
sx AS (SELECT *, CASE WHEN c <= 1e-12 THEN NULL WHEN mx = r THEN (CASE WHEN g < b THEN (g - b) / c + 6.0::DOUBLE ELSE (g - b) / c END) WHEN mx = g THEN (b - r) / c + 2.0::DOUBLE ELSE (r - g) / c + 4.0::DOUBLE END AS s6 FROM mm),
hsv AS (SELECT image_id, y, x, r8, g8, b8, CASE WHEN s6 * 60 >= 360 THEN s6 * 60 - 360 ELSE s6 * 60 END AS hue, CASE WHEN mx > 1e-12 THEN c / mx ELSE 0.0::DOUBLE END AS sat, mx AS val FROM sx)""",
    "grid8": """g0 AS (SELECT vec_id AS image_id, 'bin' || CAST(label AS VARCHAR) AS bin_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS e FROM embeddings),
grid8 AS (SELECT image_id, bin_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, e > 0 AS m, CAST(e AS DOUBLE) AS e FROM g0)""",
    "scan": """scan AS (
  SELECT user_id AS camera, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, event_type,
    value / 400.0::DOUBLE AS area_frac, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0::DOUBLE AS median_sat,
    least(value, 250.0::DOUBLE) / 250.0::DOUBLE AS median_val, (event_id % 97) / 97.0::DOUBLE AS clip_frac, (event_id % 89) / 890.0::DOUBLE AS row_dup_frac
  FROM events)""",
    "label_ev": """label_ev AS (
  SELECT o_orderkey AS image_id, c_mktsegment AS bin_id, CASE o_orderstatus WHEN 'F' THEN 'present' WHEN 'O' THEN 'absent' END AS label,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS label_epoch, CAST(o_custkey % 3 AS INTEGER) AS view_epoch,
    o_orderkey % 10 = 7 AS excluded, o_orderkey % 4 = 1 AS auto, o_totalprice / 1000000.0::DOUBLE AS area_frac
  FROM orders JOIN customer ON c_custkey = o_custkey)""",
    "ccl": """mask AS (SELECT image_id, bin_id, y, x, y * 8 + x AS id FROM grid8 WHERE m),
walk AS (
  WITH RECURSIVE w(image_id, id, y, x, root) AS (
    SELECT image_id, id, y, x, id FROM mask
    UNION
    SELECT a.image_id, b.id, b.y, b.x, a.root FROM w a JOIN mask b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.root < b.id
  ) SELECT image_id, id, min(root) AS root FROM w GROUP BY image_id, id),
named AS (SELECT m.image_id, m.bin_id, m.y, m.x, CAST(root // 8 AS INTEGER) AS seed_y, CAST(root % 8 AS INTEGER) AS seed_x FROM mask m JOIN walk USING (image_id, id))""",
}


def cte(*names: str, more: str = "") -> str:
    """A WITH clause of the named adapters, each after what it builds on."""
    needs = {"hsv": ["px"], "ccl": ["grid8"]}
    order: list[str] = []
    for n in names:
        for k in [*needs.get(n, []), n]:
            if k not in order:
                order.append(k)
    return "WITH " + ",\n".join([CTE[n] for n in order] + ([more] if more else []))
