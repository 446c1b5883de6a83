"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame) -> DataFrame | None:
    """(node, root): the smallest node reachable, for every node in ``links``.

    ``links`` has long columns a and b.  Each round, every node points to
    its smallest neighbour, pointers are followed once more, and the links
    are rewritten to the targets, which at least halves the nodes left; the
    rounds grow with the logarithm of the nodes.  Each round's small tables
    lie in the shared folder, so a lost executor repeats one round's step;
    they go when the next round has been written.  None if there are no links.
    """
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mapping = None
    while not links.isEmpty():
        near = links.union(links.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
        parent = near.select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        onward = parent.select(F.col("node").alias("root"), F.col("root").alias("further"))
        parent = written(parent.join(onward, "root").select("node", F.col("further").alias("root")), "parent")
        if mapping is None:
            mapping = parent
        else:
            step = parent.select(F.col("node").alias("root"), F.col("root").alias("further"))
            before, mapping = mapping, written(mapping.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "mapping")
            discard(before)
        of_a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        of_b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = links.join(of_a, "a").join(of_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        before, links = links, written(rest, "links")
        discard(before, parent if mapping is not parent else None)
    discard(links)
    return mapping
