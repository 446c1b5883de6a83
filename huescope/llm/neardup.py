"""Near-duplicates by exact similarity, with SimHash covering as the first
source of candidates.

Two texts are near-duplicates if the Jaccard similarity of their sets of
word shingles reaches the threshold.  A 64-bit SimHash only vouches for very
close pairs at a radius that can be covered, so candidates come from two
sources: the covering tables over the whole text's fingerprint, and
sub-fingerprints over consistent samples of its shingles.  The shingles are
dealt by hash into groups; a group's sub-fingerprint stands for its smallest
few.  A pair of similarity s agrees in a group's three with about s ** 3, so
all of 16 groups miss a pair of 0.8 once in some 90,000.

Texts with equal sets are one class from the start.  A bucket compares its
classes by small sketches and names the links of a spanning tree over those
that the sketches let pass, closest first; each link is checked exactly on the
whole shingle sets and what it connects becomes one component.  A bucket whose
links all hold is settled.  The others get their classes' whole sets and work
out all similarities in one task, which returns a spanning tree of those that
reach the threshold: never a row for each pair.  The first group's buckets go
first, so that a large group of copies is mostly one component before the
others look at it.  A bucket over the limit is first compared in random parts,
which joins what is dense; if several components are left, it is dealt again
by the sketches, and what then is over the limit is compared block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, utf8, written
from .components import components
from .simhash import links_within, shingle_hashes, simhash

GROUPS_LOG2, SAMPLE, SLOTS_LOG2 = 4, 3, 7
MARGIN = 0.18  # below the similarity; a pair that reaches it agrees in fewer of 128 bytes once in some 700,000
BUCKET, BUCKET_BYTES = 2_048, 48 << 20  # classes of a bucket, and bytes of their sets, in one task
COLUMNS = 4_096  # shared shingles that are counted at once
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(3).integers(0, 1 << 63, 1 << SLOTS_LOG2, np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCHES = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("cls", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("size", pa.int64())])
_SKETCHES_SQL = "doc_id long, hash long, cls long, fp long, keys array<long>, sketch binary, size long"


def group_keys(shingles: np.ndarray) -> list[int]:
    """One signed key for each group that holds a shingle."""
    mixed = np.sort(shingles * _MIX)
    start = np.searchsorted(mixed, np.arange(1 << GROUPS_LOG2, dtype=np.uint64) << np.uint64(64 - GROUPS_LOG2))
    ends = np.append(start[1:], len(mixed))
    return [xxhash.xxh64_intdigest(mixed[a : min(b, a + SAMPLE)].tobytes(), g) - (1 << 63) for g, (a, b) in enumerate(zip(start.tolist(), ends.tolist())) if b > a]


def sketch(shingles: np.ndarray) -> bytes:
    """One byte of the smallest hash under each of 128 hash functions.  Each
    byte agrees by itself with at least the sets' similarity, however few
    shingles they have, so the share that agrees is a binomial one."""
    least = np.full(1 << SLOTS_LOG2, ~np.uint64(0))
    for k in range(0, len(shingles), 2_048):
        np.minimum(least, (shingles[None, k : k + 2_048] * _FACTORS[:, None]).min(1), out=least)
    return ((least * _MIX) >> np.uint64(24)).astype(np.uint8).tobytes()


def sketches(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """What is needed of each row to find its candidates."""
    def run(batches):
        for b in batches:
            cls, fps, keys, marks, sizes = [], [], [], [], []
            for text in utf8(b.column("t")):
                hashes = shingle_hashes(text, shingle)
                unique = np.unique(hashes)
                cls.append(xxhash.xxh64_intdigest(unique.tobytes(), 7) - (1 << 63))
                fps.append(simhash(hashes))
                keys.append(group_keys(unique))
                marks.append(sketch(unique))
                sizes.append(len(unique))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(cls, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64())], schema=_SKETCHES)

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("t")).mapInArrow(run, _SKETCHES_SQL)


def _agreement(marks: np.ndarray, n: np.ndarray, least: float, similarity: float, mine: slice) -> np.ndarray:
    """Equal sketch bytes of some rows with all, -1 where the pair cannot be similar."""
    same = (marks[mine, None] == marks[None]).sum(2, dtype=np.int16)
    near = (same >= least * marks.shape[1]) & (np.minimum(n[mine, None], n) >= similarity * np.maximum(n[mine, None], n))
    near[np.arange(len(near)), np.arange(len(n))[mine]] = False
    return np.where(near, same, np.int16(-1))


def _tree(comp: np.ndarray, same: np.ndarray) -> list[tuple[int, int]]:
    """Links that join whatever the agreements connect beyond the components
    given, closest first: each component takes its closest link, and again."""
    label, out = np.unique(comp, return_inverse=True)[1], []
    while True:
        away = np.where(label[:, None] != label[None], same, same.dtype.type(-1))
        to = away.argmax(1)
        best = away[np.arange(len(to)), to]
        rows = np.flatnonzero(best >= 0)
        if not len(rows):
            return out
        rows = rows[np.lexsort((rows, -best[rows], label[rows]))]
        rows = rows[np.concatenate(([True], label[rows][1:] != label[rows][:-1]))]
        for i in rows.tolist():
            j = int(to[i])
            if label[i] != label[j]:
                out.append((i, j))
                label[label == max(label[i], label[j])] = min(label[i], label[j])


def _by_key(pairs_of):
    """Over rows sorted by key: links (a, b, key) of each bucket that holds
    more than one component, by ``pairs_of(its rows, their components)``."""
    def run(batches):
        held: list[pa.Table] = []

        def found(table):
            keys = table.column("key").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
            cls, comp = table.column("cls").to_numpy(), table.column("comp").to_numpy()
            out = set()
            for s, e in zip(cut.tolist(), np.append(cut[1:], len(keys)).tolist()):
                if e - s < 2 or (comp[s:e] == comp[s]).all():
                    continue
                for i, j in pairs_of(table.slice(s, e - s), comp[s:e]):
                    x, y = int(cls[s + i]), int(cls[s + j])
                    out.add((min(x, y), max(x, y), int(keys[s])))
            rows = sorted(out)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table(batch.columns, names=batch.schema.names)
            last = table.column("key")[-1].as_py()
            open_ = int(np.searchsorted(table.column("key").to_numpy() == last, True))  # where the last bucket starts
            if open_ or held and held[-1].column("key")[-1].as_py() != last:
                yield found(pa.concat_tables([*held, table.slice(0, open_)]).combine_chunks())
                held = []
            held.append(table.slice(open_))
        if held:
            yield found(pa.concat_tables(held).combine_chunks())

    return run


def _sketch_tree(least: float, similarity: float):
    """Links of a spanning tree over what the sketches let pass."""
    slots = 1 << SLOTS_LOG2

    def pairs(rows, comp):
        marks = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, slots)
        step = max(1, (1 << 21) // (len(comp) * slots))
        n = rows.column("n").to_numpy()
        return _tree(comp, np.concatenate([_agreement(marks, n, least, similarity, slice(a, a + step)) for a in range(0, len(comp), step)]))

    return _by_key(pairs)


def _exact_tree(similarity: float):
    """Links of a spanning tree over the pairs whose sets reach the similarity."""
    def pairs(rows, comp):
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("s").to_pylist()]
        n = np.array(list(map(len, sets)))
        shingles, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, shared = np.repeat(np.arange(len(sets)), n), (often > 1)[at]
        column = np.cumsum(often > 1)[at[shared]] - 1
        owner = owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int((often > 1).sum()), COLUMNS):
            s, e = np.searchsorted(column, (a, a + COLUMNS))
            held = np.zeros((len(sets), COLUMNS), np.float32)
            held[owner[s:e], column[s:e] - a] = 1
            common += held @ held.T
        common = common.astype(np.int64)
        near = common >= similarity * (n[:, None] + n[None] - common)
        near &= (n[:, None] > 0) & (n[None] > 0)
        np.fill_diagonal(near, False)
        return _tree(comp, np.where(near, common, -1))

    return _by_key(pairs)


def _similar(similarity: float):
    """Keep the links whose shingle sets reach the similarity."""
    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _sets(docs: DataFrame, shingle: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array([np.unique(shingle_hashes(t, shingle)).tobytes() for t in utf8(b.column("t"))], pa.binary())], names=["cls", "s"])

    return docs.mapInArrow(run, "cls long, s binary")


def rebanded(rows: DataFrame) -> DataFrame:
    """Rows of hot buckets dealt again, by 16 threes of their sketch's bytes."""
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.xxhash64("key", i, F.substring("sketch", 3 * i + 1, F.lit(3)))))
    return rows.select(bands.alias("key"), "cls", "n", "sketch")


def blocks(rows: DataFrame, bucket: int, size: int = BUCKET_BYTES) -> DataFrame:
    """Rows (key, comp, cls, n, sketch) dealt into blocks and each two blocks
    of a key under a key of their own, so that each two classes meet somewhere
    unless they are of one component that fills blocks by itself.  Two blocks
    hold about half a bucket's classes, or half of ``size`` bytes of sets."""
    limits = rows.groupBy("key").agg(F.greatest(F.least(F.lit(bucket // 4), F.floor(F.lit(size // 32) / F.greatest(F.max("n"), F.lit(1)))), F.lit(1)).cast("long").alias("part_size"))
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("k")).join(limits, "key")
    large = sizes.where(F.col("k") > F.col("part_size")).drop("part_size")
    small = sizes.where(F.col("k") <= F.col("part_size")).groupBy("key").agg(F.sum("k").alias("rest"))
    placed = rows.join(limits, "key").join(large, ["key", "comp"], "left").join(small, "key", "left")
    alone = F.col("k").isNotNull()
    parts_of = lambda c: F.ceil(F.col(c) / F.col("part_size")).cast("long")
    block = F.struct(alone.alias("alone"), F.when(alone, F.col("comp")).otherwise(0).alias("comp"),
        F.when(alone, F.pmod(F.xxhash64("cls", F.lit(1)), parts_of("k"))).otherwise(F.pmod(F.xxhash64("comp", F.lit(1)), parts_of("rest"))).alias("part"))
    placed = placed.select("key", "comp", "cls", "n", "sketch", block.alias("block"))
    parts = written(placed.select("key", "block").distinct(), "blocks")
    other = parts.select("key", F.col("block").alias("other"))
    pairs = parts.join(other, "key").where((F.col("block") <= F.col("other")) & ~(F.col("block.alone") & F.col("other.alone") & (F.col("block.comp") == F.col("other.comp"))))
    pairs = pairs.withColumn("task", F.xxhash64("key", "block", "other"))
    tasks = pairs.select("key", "block", "task").union(pairs.select("key", "other", "task")).distinct()
    return placed.join(tasks, ["key", "block"]).select(F.col("task").alias("key"), "cls", "n", "sketch")


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components (node, root) after further links (a, b): only the links
    between roots are contracted, and the nodes follow their roots."""
    if roots is None:
        return components(links)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(between)
    if moved is None:
        return roots
    step = moved.select(F.col("node").alias("root"), F.col("root").alias("further"))
    known = roots.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    new = moved.join(roots, "node", "left_anti")
    out = written(known.union(new.select("node", "root")), "roots")
    discard(roots, moved)
    return out


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that no column of the frame has."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def keep_one(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, radius: int = 4, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, columns unchanged.

    Groups are connected by links of at least ``similarity``.  Kept is the
    row with the group's smallest id (nulls last); of several such rows the
    one whose text hashes lowest, of equal rows one.  Texts without words
    (null, empty, white space) are one group.  Extra columns may have any
    name.  The texts are read again to check the candidates.
    """
    bounded_batches(docs.sparkSession)
    marked = written(sketches(docs, shingle, id_col, text_col), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "hash"))
    classes = written(marked.groupBy("cls").agg(first.alias("best"), F.min("fp").alias("fp"), F.min(F.struct("keys", "sketch", "size")).alias("s"), F.count("*").alias("n")), "classes")
    # fingerprints may be shared by classes: each class hangs on its fingerprint's smallest
    by_fp = written(classes.groupBy("fp").agg(F.min("cls").alias("head")), "heads")
    names = lambda c: by_fp.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}"))
    covered = links_within(by_fp.select("fp"), radius).join(names("a"), "a").join(names("b"), "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    shared = classes.join(by_fp, "fp").where("cls <> head").select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b"))
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t"))
    sets, roots = None, None
    least = similarity - MARGIN

    def with_sets(nodes: DataFrame) -> DataFrame:
        """(cls, s) of at least these classes; texts are read for new ones."""
        nonlocal sets
        if sets is not None:
            nodes = nodes.join(sets.select("cls"), "cls", "left_anti")
        wanted = written(classes.join(nodes, "cls", "left_semi").select("cls", F.col("best.doc_id").alias("_id"), F.col("best.hash").alias("_hash")), "wanted")
        if sets is None or not wanted.isEmpty():
            read = texts.join(wanted, F.col("i").eqNullSafe(F.col("_id")) & (F.xxhash64("t") == F.col("_hash"))).select("cls", "t")
            read = written(_sets(read, shingle).dropDuplicates(["cls"]), "sets")
            sets = read if sets is None else sets.union(read)
        discard(wanted)
        return sets

    def verify(candidates: DataFrame) -> DataFrame:
        """Check the links exactly and renew the components; those that hold."""
        nonlocal roots
        have = with_sets(candidates.select(F.col("a").alias("cls")).union(candidates.select("b")).distinct())
        pairs = candidates.join(have.select(F.col("cls").alias("a"), F.col("s").alias("x")), "a").join(have.select(F.col("cls").alias("b"), F.col("s").alias("y")), "b")
        good = written(pairs.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"), "similar")
        roots = joined(roots, good)
        return good

    def in_components(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("comp", F.col("cls"))
        return rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")

    def several(rows: DataFrame) -> DataFrame:
        """Rows of the buckets that hold more than one component, with it."""
        rows = in_components(rows)
        keys = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
        return rows.join(keys, "key", "left_semi")

    def compare(rows: DataFrame, others: DataFrame | None = None) -> None:
        """Link the classes of equal key until no two of different components
        are left that are similar and that their sketches let pass."""
        nonlocal roots
        dealt = in_components(rows).select("key", "cls", "comp", "n", "sketch").repartition("key").sortWithinPartitions("key", "cls")
        found = written(dealt.mapInArrow(_sketch_tree(least, similarity), "a long, b long, key long"), "close")
        named = found.select("a", "b")
        good = verify((named if others is None else named.union(others)).distinct())
        open_ = written(found.join(good, ["a", "b"], "left_anti").select("key").distinct(), "open")
        discard(found)
        if not open_.isEmpty():
            left = written(several(rows.join(open_, "key", "left_semi")).select("key", "comp", "cls", "n", "sketch"), "unsettled")
            heavy = left.groupBy("key").agg(F.sum("n").alias("m")).where(F.col("m") > BUCKET_BYTES // 8).select("key")
            light = left.join(heavy, "key", "left_anti").select("key", "cls", "n", "sketch")
            whole = in_components(light.union(blocks(left.join(heavy, "key", "left_semi"), bucket))).select("key", "cls", "comp")
            have = with_sets(left.select("cls").distinct())
            sorted_ = whole.join(have, "cls").repartition("key").sortWithinPartitions("key", "cls")
            links = written(sorted_.mapInArrow(_exact_tree(similarity), "a long, b long, key long"), "exact")
            roots = joined(roots, links.select("a", "b"))
            discard(links, left)
        discard(good, open_)

    def parted(rows: DataFrame, hot: DataFrame) -> DataFrame:
        """Rows of hot buckets dealt at random into smaller ones."""
        part = F.pmod(F.xxhash64("cls", "key"), F.ceil(F.col("m") / (bucket // 2)).cast("long"))
        marked_ = rows.join(hot, "key", "left")
        return marked_.withColumn("key", F.when(F.col("m").isNull(), F.col("key")).otherwise(F.xxhash64("key", part))).drop("m")

    def unsettled(rows: DataFrame, hot: DataFrame) -> DataFrame:
        """Rows of the hot buckets that hold more than one component."""
        return several(rows.join(hot.select("key"), "key", "left_semi")).drop("comp")

    def hot_of(rows: DataFrame) -> DataFrame:
        return written(rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > bucket), "hot")

    own = classes.select("cls", F.col("s.sketch").alias("sketch"), F.col("s.size").alias("n"), F.posexplode("s.keys").alias("g", "key"))
    dealt = own.select(F.xxhash64("key").alias("key"), "cls", "n", "sketch", "g")
    hot = hot_of(dealt)
    spread = parted(dealt, hot)
    compare(spread.where("g = 0").drop("g"), covered.union(shared))
    compare(spread.where("g > 0").drop("g"))
    if not hot.isEmpty():
        again = written(rebanded(unsettled(dealt, hot)), "again")
        hotter = hot_of(again)
        compare(parted(again, hotter))
        if not hotter.isEmpty():
            compare(written(blocks(in_components(unsettled(again, hotter)), bucket), "tasks"))
    if roots is None:
        best = classes.select("best", "n")
    else:
        grouped = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select(F.coalesce("root", "cls").alias("root"), "best")
        best = grouped.groupBy("root").agg(F.min("best").alias("best"))
    hash_, id_, kept_ = _fresh(docs, "_hash", "_id", "_kept")
    kept = best.select(F.col("best.doc_id").alias(id_), F.col("best.hash").alias(kept_))
    often = marked.groupBy("doc_id", "hash").count().where("count > 1")
    base = docs.withColumn(hash_, F.xxhash64(text))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.col(hash_) == F.col(kept_))
    left = base.join(kept, same, "left_semi")
    if often.isEmpty():
        return left.drop(hash_)
    again = often.select(F.col("doc_id").alias(id_), F.col("hash").alias(kept_))
    return left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates([id_col, hash_])).drop(hash_)
