"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: set[str] = set()
_TABLES: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column's text form, modulo ``modulus``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def in_fold(column: str, modulus: int, remainder: int) -> Column:
    """True where the row lies in the fold; a null id lies in none."""
    return F.coalesce(crc_mod(column, modulus) == F.lit(remainder), F.lit(False))


def outside_fold(column: str, modulus: int, remainder: int) -> Column:
    """True where the row may be learned from; a null id never is."""
    return F.coalesce(crc_mod(column, modulus) != F.lit(remainder), F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session, whose driver is its executor, may do without one:
    a temporary folder is put into its setting.  On a cluster that names
    none this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="huescope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write the rows as a table in the shared folder and read them again.

    It cuts the lineage: a lost executor costs a re-read, never a recompute
    of the Python work that made the rows.  Tables lie in a folder of the
    application, which is removed when the driver ends its session; tables
    of passed rounds go earlier by :func:`discard`.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/huescope-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_removed, spark, root)
    path = f"{root}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    _TABLES.append(path)  # not the frame: that would keep its plan alive on the driver
    return back


def _removed(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's file systems, if the session still runs."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def written_since(mark: int | None = None) -> int | list[str]:
    """Without a mark: one for now.  With it: the paths written since."""
    return len(_TABLES) if mark is None else _TABLES[mark:]


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of :func:`written` that nothing will read again."""
    for table_ in tables:
        path = getattr(table_, "_written_path", None)
        if path:
            _removed(table_.sparkSession, path)
            table_._written_path = None


def discard_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Remove all tables written since the mark but one."""
    for path in written_since(mark):
        if path != getattr(keep, "_written_path", None):
            _removed(spark, path)


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Let Arrow batches of texts hold a few MB instead of Spark's 64: texts
    are copied a few times on their way through Python and back.  A session
    that has chosen its own size keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, most)


def hash_share(column: Column, share: float) -> Column:
    """A repeatable pseudo-random choice of about ``share`` of the values."""
    if share >= 1:
        return F.lit(True)
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(1_000_003)) < F.lit(int(share * 1_000_003))


def sample_rows(df: DataFrame, columns: list[str], most: int) -> list:
    """At most ``most`` rows, those whose columns hash lowest: the same rows
    whatever the partitions, and no more than ``most`` from each of them."""
    order = F.xxhash64(*columns)
    return df.orderBy(order, *columns).limit(most).collect()


def strings(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes without decoding; null becomes the empty text."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch with the schema's types, columns given by name."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)


_HELD: dict[str, tuple] = {}


def held(kind: str, key, make):
    """One object of each kind for the life of a Python worker, so that
    caches and models outlast a task; another key replaces it."""
    if kind not in _HELD or _HELD[kind][0] != key:
        _HELD[kind] = (key, make())
    return _HELD[kind][1]
