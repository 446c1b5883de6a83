"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position i has a nonzero vector m(i) of radius + 1 bits; for every
nonzero v of that length one table masks the fingerprint to the positions
with <m(i), v> odd.  Up to ``radius`` differing positions span too few
dimensions to hit every v, so each pair within the radius agrees in some
table: candidates are complete by construction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, utf8, written
from .components import components

BUCKET = 1_024  # members of a bucket compared in one task; larger ones are dealt finer
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.int32())])


def shingle_hashes(text: bytes, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of each word shingle of the text with A-Z lower-cased, repeats
    included; of the whole sequence if it is shorter; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, hash_ = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hash_(joined, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate(([0], ends[:-shingle])).tolist()
    last = (ends[shingle - 1 :] - 1).tolist()
    return np.array([hash_(joined[a:b], seed) for a, b in zip(first, last)], "<u8")


def simhash(hashes: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes; 0 of none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over the text's word shingles."""
    return simhash(shingle_hashes(text, shingle, seed))


def masks(radius: int, level: int = 0) -> list[int]:
    """The covering family's masks; each level deals the bits differently."""
    count = (1 << (radius + 1)) - 1
    vector = [(i * (1, 5, 11, 19, 27, 45)[level % 6] + 7 * level) % 64 % count + 1 for i in range(64)]
    out = [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, count + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def fingerprints(docs: DataFrame, *, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; null text is empty."""
    bounded_batches(docs.sparkSession)
    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in utf8(b.column("t"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, fp long")


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (smallest, member) of each component within a bucket."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= radius
    left, out = np.ones(len(members), bool), []
    while left.any():
        seed = int(left.argmax())
        group = np.zeros(len(members), bool)
        group[seed] = True
        edge = group
        while edge.any():
            grown = near[edge].any(0) & ~group
            group, edge = group | grown, grown
        left &= ~group
        mine = members[group].view(np.int64)
        root = int(mine.min())
        out += [(root, int(x)) for x in mine if x != root]
    return out


def _linker(radius: int, bucket: int):
    """Over rows sorted by (t, key): links inside each bucket of at most
    ``bucket`` members; members of larger ones come out as hot rows (fp, t)."""
    def run(batches):
        tail = [np.zeros(0, np.int64)] * 3
        over = None  # the bucket that is already known to be too large

        def links(t, key, fp, final):
            nonlocal tail, over
            cut = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])))) if len(t) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(t))[: len(cut)]
            size, hot_runs = ends - cut, []
            if len(cut) and over is not None and over != (t[0], key[0]):
                over = None
            elif len(cut) and over is not None:
                hot_runs.append(0)
            tail = [x[len(t) :] for x in (t, key, fp)]
            if len(cut) and not final and hot_runs != [len(cut) - 1]:
                last = cut[-1]
                if size[-1] > bucket:  # its further rows are streamed on as hot ones
                    over = (t[last], key[last])
                else:
                    tail = [x[last:] for x in (t, key, fp)]
                    cut, ends, size = cut[:-1], ends[:-1], size[:-1]
            hot_runs += [i for i in np.flatnonzero(size > bucket) if i not in hot_runs]
            cool = np.ones(len(cut), bool)
            cool[hot_runs] = False
            two = cut[cool & (size == 2)]
            two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius] if len(two) else two
            a, b, hot = [fp[two]], [fp[two + 1]], [np.zeros(len(two), np.int32)]
            for i in hot_runs:
                s, e = cut[i], ends[i]
                a.append(fp[s:e]), b.append(t[s:e]), hot.append(np.ones(e - s, np.int32))
            for i in np.flatnonzero(cool & (size > 2)):
                found = np.array(_forest(fp[cut[i] : ends[i]].view(np.uint64), radius), np.int64).reshape(-1, 2)
                a.append(found[:, 0]), b.append(found[:, 1]), hot.append(np.zeros(len(found), np.int32))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b)), pa.array(np.concatenate(hot))], schema=_LINK)

        for batch in batches:
            t, key, fp = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(tail, ("t", "key", "fp")))
            yield links(t, key, fp, False)
        yield links(*tail, True)

    return run


def _blocks(members: DataFrame, bucket: int) -> DataFrame:
    """Members (fp, t, key) of each bucket dealt into blocks, and each two
    blocks under a table number of their own, so that any two members meet."""
    sizes = members.groupBy("t", "key").agg(F.count("*").alias("m"))
    parts = F.ceil(F.col("m") / (bucket // 2)).cast("int")
    mine = members.join(sizes, ["t", "key"]).withColumns({"parts": parts}).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.select(F.xxhash64("t", "key", F.least("part", "other"), F.greatest("part", "other")).alias("t"), "key", "fp")


def links_within(fps: DataFrame, radius: int = 4, levels: int = 6, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect whatever lies within ``radius`` bits.

    ``fps`` has distinct fingerprints fp.  Inside a bucket only a spanning
    forest comes out, never all pairs.  Buckets over the size limit are
    dealt again by a second covering family on top of the first, and so on;
    each level fixes about half of the bits that were left free.  What is
    over the limit after all levels is compared block by block.
    """
    out, members = [], fps.select("fp", F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("mask"))
    for level in range(levels + 1):
        if level < levels:
            family = masks(radius, level)
            # t numbers the path of tables taken, mask is all bits that they hold fixed
            tables = F.explode(F.array(*(F.struct(F.lit(v + 1).cast("long").alias("v"), F.lit(m).cast("long").alias("m")) for v, m in enumerate(family))))
            dealt = members.select("fp", "t", "mask", tables.alias("x")).select("fp", (F.col("t") * 64 + F.col("x.v")).alias("t"), F.col("mask").bitwiseOR(F.col("x.m")).alias("mask"))
            dealt, limit = dealt.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), bucket
        else:
            dealt, limit = _blocks(members.select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), bucket), 1 << 62
        found = written(dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_linker(radius, limit), "a long, b long, hot int"), f"links{level}")
        out.append(found.where("hot = 0").select("a", "b"))
        hot = found.where("hot = 1")
        if hot.isEmpty():
            break
        # the path's masks, from its table numbers
        mask, path = F.lit(0).cast("long"), F.col("b")
        for k in range(level, -1, -1):
            each = masks(radius, k)
            mask = mask.bitwiseOR(F.element_at(F.array(*(F.lit(m).cast("long") for m in each)), (path % 64).cast("int")))
            path = F.floor(path / 64).cast("long") if k else path
        members = hot.select(F.col("a").alias("fp"), F.col("b").alias("t"), mask.alias("mask"))
    links = out[0]
    for x in out[1:]:
        links = links.union(x)
    return links


def near_duplicates(docs: DataFrame, *, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, its own included.  Null and empty texts, and
    texts of white space, have fingerprint zero and are linked like any
    other.  Repeated rows come out as often as they stand; rows with a null
    id are linked too and have a null component_id if no member has an id.
    """
    marked = written(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links_within(classes, radius))
    if roots is None:
        of = classes.select("fp", F.col("first").alias("component_id"))
    else:
        joined = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
        of = joined.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
