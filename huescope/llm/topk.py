"""Exact inner-product top-k by ball-tree branch and bound in each shard.

A bounded sample gives pivots; every candidate belongs to the ball of its
nearest pivot, and a ball is one shard, or several by a hash of the id where
it holds more bytes than a task should.  A shard's task collapses equal
vectors, builds a ball tree over the distinct ones and streams query rows past
it in blocks.  Nodes leave a heap in the order of their best inner-product
upper bound (q . centre + |q| radius) and a query drops a node whose bound
lies under the k-th score it holds by then.

The k-th score is shared between shards, too: the sample gives each query a
first one, the candidates of a first wave (one in eight, by a hash of the id)
a better one, and the second wave starts from that.  A query is only sent to
a shard whose whole ball can still reach its k-th score.  A shared score can
only be too low, never too high, so no result is lost.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sample_rows, written

LEAF = 256
WAVES = 8  # one candidate in so many belongs to the first wave
_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _number_kind(a: np.ndarray, b: np.ndarray):
    """The cheapest type in which every inner product of the two is exact."""
    if not a.size or not b.size:
        return np.float64
    bound = max(abs(int(a.min())), abs(int(a.max()))) * max(abs(int(b.min())), abs(int(b.max()))) * a.shape[1]
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


class BallTree:
    """Distinct integer vectors of one shard, with the ids that carry them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        once = np.ones(len(ids), bool)  # a repeated row counts once
        once[1:] = (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(1)
        ids, vectors = ids[once], vectors[once]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        start = np.flatnonzero(new)
        place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
        kept = place <= k  # one more than k: a query may have to leave out itself
        owner = np.cumsum(new) - 1
        self.points = vectors[start]
        self.float_points = self.points.astype(np.float64)
        self.order, self.nodes = np.arange(len(start)), []
        self._split(0, len(start))
        # ids by distinct vector, vectors in tree order
        rank = np.empty(len(start), np.int64)
        rank[self.order] = np.arange(len(start))
        by = np.lexsort((ids[kept], rank[owner[kept]]))
        self.ids, at = ids[kept][by], rank[owner[kept]][by]
        self.owner, self.first = at, np.searchsorted(at, np.arange(len(start) + 1))
        self.points = self.points[self.order]
        self.centres = np.array([n[2] for n in self.nodes])
        self.radii = np.array([n[3] for n in self.nodes])
        del self.float_points

    def _split(self, a: int, b: int) -> int:
        me, part = len(self.nodes), self.float_points[self.order[a:b]]
        centre = part.mean(0)
        self.nodes.append([a, b, centre, float(np.sqrt(((part - centre) ** 2).sum(1).max())), -1, -1])
        if b - a > LEAF:
            axis = int((part.max(0) - part.min(0)).argmax())
            half = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], half)]
            self.nodes[me][4:] = self._split(a, a + half), self._split(a + half, b)
        return me

    def search(self, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int):
        """(row, id, score) of the k best for each query, scores under
        ``least`` left out; ties go to smaller ids."""
        kind = _number_kind(queries, self.points)
        number = np.float64 if kind is np.float32 else kind
        least = least.astype(number) if kind is object else least.copy()
        q, length = queries.astype(np.float64), np.sqrt((queries.astype(np.float64) ** 2).sum(1))
        bound = q @ self.centres.T + length[:, None] * self.radii
        bound += 1e-6 + 1e-9 * (np.abs(bound) + length[:, None] * (self.radii + np.sqrt((self.centres**2).sum(1))))
        exact = queries.astype(kind)
        row, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, number)
        heap = [(-float(bound[:, 0].max()), 0)]
        while heap:
            _, node = heapq.heappop(heap)
            open_ = np.flatnonzero(bound[:, node] >= least)
            if not len(open_):
                continue
            a, b, _, _, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(heap, (-float(bound[open_, child].max()), child))
                continue
            s = (exact[open_] @ self.points[a:b].astype(kind).T).astype(number)
            s = s[:, self.owner[self.first[a] : self.first[b]] - a]
            cand = self.ids[self.first[a] : self.first[b]]
            r, c = np.nonzero((s >= least[open_, None]) & (cand[None, :] != query_ids[open_, None]))
            if not len(r):
                continue
            row, ids, score = np.concatenate((row, open_[r])), np.concatenate((ids, cand[c])), np.concatenate((score, s[r, c]))
            best = np.lexsort((-score, ids, row))  # of an id with several vectors the best
            best = best[np.concatenate(([True], (row[best][1:] != row[best][:-1]) | (ids[best][1:] != ids[best][:-1])))]
            row, ids, score = row[best], ids[best], score[best]
            best = np.lexsort((ids, -score, row))
            row, ids, score = row[best], ids[best], score[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, ids, score = row[place < k], ids[place < k], score[place < k]
            full = np.flatnonzero(place[place < k] == k - 1)
            least[row[full]] = np.maximum(least[row[full]], score[full])
        return row, ids, score


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _searcher(k: int, block: int):
    def run(batches):
        held, tree, queries, key = [], None, [], None

        def answer():
            if queries and tree is not None:
                ids, vectors, least = (np.concatenate(x) for x in zip(*queries))
                row, found, score = tree.search(ids, vectors, least, k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array([int(x) for x in score], pa.int64())], schema=_OUT)
            queries.clear()

        for batch in batches:
            dims, shards, sides = (batch.column(c).to_numpy() for c in ("dim", "shard", "side"))
            cuts = np.flatnonzero(np.concatenate(([True], (dims[1:] != dims[:-1]) | (shards[1:] != shards[:-1]) | (sides[1:] != sides[:-1]))))
            for a, b in zip(cuts, np.append(cuts[1:], len(dims))):
                part, now = batch.slice(a, b - a), (dims[a], shards[a])
                if now != key:
                    yield from answer()
                    held, tree, key = [], None, now
                ids = part.column("id").to_numpy()
                vectors = _vectors(part.column("v")) if dims[a] else np.zeros((b - a, 0), np.int64)
                if not sides[a]:
                    held.append((ids, vectors))
                    continue
                if tree is None and held:
                    tree, held = BallTree(*(np.concatenate(x) for x in zip(*held)), k), []
                queries.append((ids, vectors, part.column("least").to_numpy(zero_copy_only=False)))
                if sum(len(x[0]) for x in queries) >= block:
                    yield from answer()
        yield from answer()

    return run


class Pivots:
    """Centres for each vector length, from a bounded sample, and how many
    shards each ball takes in each wave; at most some hundred vectors."""

    def __init__(self, sample: list[tuple[int, list[int]]], most: int):
        by_dim: dict[int, list] = {}
        for i, v in sample:
            if v:
                by_dim.setdefault(len(v), []).append((i, v))
        self.seeds = {d: (np.array([i for i, _ in x], np.int64), np.array([v for _, v in x], np.int64)) for d, x in by_dim.items()}
        self.centres, self.first, at = {}, {}, 0
        for d, (_, points) in sorted(self.seeds.items()):
            points = np.unique(points.astype(np.float64), axis=0)
            share = max(1, round(most * len(points) / max(1, len(sample))))
            centres = points[np.random.default_rng(d).permutation(len(points))[:share]]
            for _ in range(4):
                near = self._nearest(points, centres)[0]
                sums = np.zeros_like(centres)
                np.add.at(sums, near, points)
                count = np.bincount(near, minlength=len(centres))
                centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
            self.centres[d], self.first[d] = centres, at
            at += len(centres)
        self.shards: dict[tuple[int, int], int] = {}  # (wave, pivot) -> shards
        self.radius: dict[tuple[int, int], float] = {}

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = (((centres**2).sum(1) / 2)[None, :] - points @ centres.T).argmin(1)
        return near, np.sqrt(((points - centres[near]) ** 2).sum(1))

    def place(self, dims: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pivot and distance of each vector; -1 where its length has no pivot."""
        pivot, distance = np.full(len(dims), -1), np.zeros(len(dims))
        for d in np.unique(dims):
            if int(d) in self.centres:
                at = np.flatnonzero(dims == d)
                near, distance[at] = self._nearest(_vectors(column.take(pa.array(at))).astype(np.float64), self.centres[int(d)])
                pivot[at] = near + self.first[int(d)]
        return pivot, distance

    def salt(self, wave: np.ndarray, pivot: np.ndarray, dims: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Which of its ball's shards each vector belongs to; where there is
        no pivot, all vectors of one length go together."""
        count = np.array([self.shards.get((w, p), 1) for w, p in zip(wave.tolist(), pivot.tolist())])
        return np.where(pivot < 0, dims, hashes) % count

    def start(self, d: int, ids: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The k-th score among the sample, -inf where it has too few."""
        least = np.full(len(ids), -np.inf)
        seed_ids, seed = self.seeds.get(d, (np.zeros(0, np.int64), None))
        if len(seed_ids) <= k:
            return least
        kind = _number_kind(q, seed)
        if kind is object:
            return least
        s = (q.astype(kind) @ seed.astype(kind).T).astype(np.float64)
        s[ids[:, None] == seed_ids[None, :]] = -np.inf
        return np.partition(s, -k, axis=1)[:, -k]

    def reach(self, wave: int, d: int, q: np.ndarray) -> np.ndarray:
        """Upper bound of each query's inner product with each ball's members."""
        centres, first = self.centres[d], self.first[d]
        radius = np.array([self.radius.get((wave, first + i), -np.inf) for i in range(len(centres))])
        q = q.astype(np.float64)
        length = np.sqrt((q**2).sum(1))[:, None]
        known = np.isfinite(radius)
        r = np.where(known, radius, 0.0)
        bound = q @ centres.T + length * r
        bound += 1e-6 + 1e-9 * (np.abs(bound) + length * (r + np.sqrt((centres**2).sum(1))))
        return np.where(known[None, :], bound, -np.inf)


def top_k(vectors: DataFrame, is_query, *, k: int = 5, id_col: str = "vec_id", vec_col: str = "vector", shard_bytes: int = 32 << 20, pivots: int = 96, seed_rows: int = 1_024, block: int = 4_096) -> DataFrame:
    """The ``k`` highest integer inner products of each query id.

    ``vec_col`` is an array of integers, ``is_query`` a condition on the
    columns.  Returns query_id, rank (from 1), vec_id, score; equal scores
    rank by smaller id.  Rows with a null id, a null vector or a null
    component take no part; vectors are compared with those of their own
    length only.  A query's candidates are all rows of another id.  Repeated
    rows count once; ids that stand with several vectors are compared by the
    best of their products.  No queries or no candidates: no rows.  A score
    outside 64 bits is an error.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<bigint>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = base.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).withColumn("dim", F.size("v"))
    model = Pivots([(r.id, r.v) for r in sample_rows(base.select("id", "v"), ["id", "v"], seed_rows)], pivots)
    held = spark.sparkContext.broadcast(model)
    wave = F.when(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(WAVES)) == 0, 0).otherwise(1)

    def measure(batches):
        for b in batches:
            dims, waves = b.column("dim").to_numpy(), b.column("wave").to_numpy()
            pivot, distance = held.value.place(dims, b.column("v"))
            key = pivot * 2 + waves
            kinds, at = np.unique(key, return_inverse=True)
            size, far = np.zeros(len(kinds)), np.zeros(len(kinds))
            np.add.at(size, at, 8.0 * dims + 8)
            np.maximum.at(far, at, distance)
            yield pa.RecordBatch.from_arrays([pa.array(kinds % 2, pa.int32()), pa.array(kinds // 2, pa.int32()), pa.array(size), pa.array(far)], names=["wave", "pivot", "size", "far"])

    stats = base.select("v", "dim", wave.alias("wave")).mapInArrow(measure, "wave int, pivot int, size double, far double")
    for r in stats.groupBy("wave", "pivot").agg(F.sum("size").alias("size"), F.max("far").alias("far")).collect():  # two rows a pivot at most
        model.shards[r.wave, r.pivot] = max(1, -(-int(r.size) // shard_bytes))
        model.radius[r.wave, r.pivot] = r.far * (1 + 1e-9) + 1e-6
    placed = spark.sparkContext.broadcast(model)

    def deal(batches):
        for b in batches:
            dims, waves = b.column("dim").to_numpy(), b.column("wave").to_numpy()
            pivot, _ = placed.value.place(dims, b.column("v"))
            salt = placed.value.salt(waves, pivot, dims, b.column("h").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("wave"), b.column("dim"), pa.array(pivot * (1 << 32) + salt), b.column("id"), b.column("v")], names=["wave", "dim", "shard", "id", "v"])

    hashed = F.shiftrightunsigned(F.xxhash64("id", F.lit(9)), 1).alias("h")
    candidates = base.select("id", "v", "dim", wave.alias("wave"), hashed).mapInArrow(deal, "wave int, dim int, shard long, id long, v array<bigint>")

    def send(number: int):
        def run(batches):
            m = placed.value
            for b in batches:
                ids, dims, given, column = b.column("id").to_numpy(), b.column("dim").to_numpy(), b.column("least").to_numpy(zero_copy_only=False), b.column("v")
                row, shard, bar = [], [], []
                for d in np.unique(dims):
                    at, d = np.flatnonzero(dims == d), int(d)
                    if d not in m.centres:
                        row.append(at), shard.append(np.full(len(at), -(1 << 32) + d % m.shards.get((number, -1), 1))), bar.append(np.nan_to_num(given[at], nan=-np.inf))
                        continue
                    q = _vectors(column.take(pa.array(at)))
                    least = np.fmax(given[at], m.start(d, ids[at], q, k))
                    reach = m.reach(number, d, q)
                    i, p = np.nonzero((reach >= least[:, None]) & (reach > -np.inf))
                    p = p + m.first[d]
                    count = np.array([m.shards[number, x] for x in p.tolist()], np.int64)
                    each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    row.append(np.repeat(at[i], count)), shard.append(np.repeat(p, count) * (1 << 32) + each), bar.append(np.repeat(least[i], count))
                if row:
                    row, shard, bar = np.concatenate(row), np.concatenate(shard), np.concatenate(bar)
                    for a in range(0, len(row), 4_096):
                        part = pa.array(row[a : a + 4_096])
                        yield pa.RecordBatch.from_arrays([b.column("dim").take(part), pa.array(shard[a : a + 4_096]), b.column("id").take(part), column.take(part), pa.array(bar[a : a + 4_096])], names=["dim", "shard", "id", "v", "least"])

        return run

    queries, found = base.where("q").select("id", "v", "dim"), None
    for number in (0, 1):
        given = queries.withColumn("least", F.lit(None).cast("double"))
        if found is not None:
            # the k-th score so far, a little lower where a double may round it up
            best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
            kth = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") == k)
            low = F.col("score").cast("double")
            kth = kth.select(F.col("query_id").alias("id"), F.when(F.abs(low) < float(1 << 52), low).otherwise(low - F.abs(low) * 1e-15).alias("least"))
            given = queries.join(kth, "id", "left")
        right = given.mapInArrow(send(number), "dim int, shard long, id long, v array<bigint>, least double").withColumn("side", F.lit(1))
        left = candidates.where(F.col("wave") == number).select("dim", "shard", "id", "v", F.lit(None).cast("double").alias("least"), F.lit(0).alias("side"))
        dealt = left.unionByName(right).select("dim", "shard", "side", "id", "v", "least").repartition("dim", "shard").sortWithinPartitions("dim", "shard", "side")
        hits = dealt.mapInArrow(_searcher(k, block), "query_id long, vec_id long, score long")
        found = written(hits, "top_k_wave") if found is None else found.union(hits)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
