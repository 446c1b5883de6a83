"""Where an installation's entries keep what they know.

An entry is one camera with its evidence and profile.  Its archive holds the
frames and a mirror of the store, so it is complete by itself; a
:class:`Vault` writes both and stops writing once another one took over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import store

MIRROR = "store.json"


def resolve_entry(loaded: list[str], asked: str | None = None) -> str:
    """The entry that a command is meant for.

    Without a name there must be exactly one; a name must be one of them.
    """
    if asked:
        if asked not in loaded:
            raise ValueError(f"no entry {asked} is loaded")
        return asked
    if len(loaded) != 1:
        raise ValueError("no entry is loaded" if not loaded else f"one of {len(loaded)} entries must be named")
    return loaded[0]


def archive_folder(media: dict[str, str], config: str, entry: str, product: str = "huescope") -> str:
    """An entry's archive: below the media folder called local, else the one
    whose name comes first, else the configuration's own."""
    base = media[min(media, key=lambda k: (k != "local", k))] if media else f"{config}/media"
    return f"{base}/{product}/{entry}"


def mirror_path(media: dict[str, str], config: str, entry: str) -> str:
    """The mirror beside an entry's frames; relative image paths start here."""
    return f"{archive_folder(media, config, entry)}/{MIRROR}"


class Vault:
    """One entry's store, profile and mirror as documents.

    A closed vault (its entry was loaded again) writes nothing any more, so
    that a late relearn cannot bring back what has changed meanwhile.
    """

    def __init__(self, spark: SparkSession, folder: str, mirror: str):
        self.spark, self.folder, self.mirror, self.closed = spark, folder, mirror, False

    def close(self) -> None:
        self.closed = True

    def save(self, tables: dict[str, DataFrame], profile: DataFrame | None = None) -> bool:
        """Write store, mirror and profile; whether anything was written."""
        if self.closed:
            return False
        doc = store.document(tables)
        doc = self.spark.createDataFrame(doc.collect(), doc.schema)  # one row; it may replace what it was read from
        for path in (f"{self.folder}/store", self.mirror):
            store.write_document(doc, path)
        if profile is not None:
            store.write_document(profile, f"{self.folder}/profile")
        return True

    def load(self) -> dict[str, DataFrame]:
        return store.tables(store.open_store(self.spark, f"{self.folder}/store"))

    def remove(self) -> bool:
        """Delete the entry's documents, after an export to the mirror where
        there is evidence; frames are never deleted.  Whether it exported."""
        doc = store.read_store(self.spark, f"{self.folder}/store")
        row = doc.collect()
        kept = any(r.images for r in row)
        if kept:
            store.write_document(self.spark.createDataFrame(row, doc.schema), self.mirror)
        self.closed = True
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        return kept
