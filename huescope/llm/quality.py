"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in its features (shares of characters and
words, repetition, line shape; each also as a step function of its
quantiles).  Preference pairs put a good document over a bad one; the weights
maximise the logistic likelihood of the pairs' feature differences.  The
score is cut at the quantile that leaves the share of good documents seen in
training, and a one-dimensional logistic fit turns the distance from the cut
into a probability.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_share, utf8

_BYTES = np.arange(256)
#: The byte classes whose shares are features.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\x0b\x0c\r", b".", b"!?", b",", b";:", b"'\"`", b"()[]", b"{}<>", b"|", b"#", b"%", b"*", b"&", b"$", b"@", b"/\\", b"_", b"=+~^", b"-", bytes(range(128, 256)), bytes([*range(9), *range(14, 32), 127])]
_TABLE = np.stack([np.isin(_BYTES, list(c)) for c in CLASSES], 1).astype(float)


def features(text: bytes) -> np.ndarray:
    """Features of one whole text; the empty text has defined ones, too."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    n = max(len(text), 1)
    share = counts / n
    seen = share[share > 0]
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    w, k = max(len(words), 1), max(len(lines), 1)
    different = set(words)
    letters = max(share @ _TABLE[:, 0] + share @ _TABLE[:, 1] + share @ _TABLE[:, 24], 1e-9)
    ends = counts[[46, 33, 63]].sum()
    shape = [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / w, len(different) / w, len(different) / w**0.7, sum(map(eq, words, words[1:])) / w,
        -(seen * np.log2(seen)).sum(), len(set(lines)) / k, np.log1p(len(text) / k), ends / w, np.log1p(w / max(ends, 1)), 1 - letters,
        (share @ _TABLE[:, 1]) / letters, max(map(len, words), default=0),
    ]
    return np.concatenate((share @ _TABLE, shape))


class RankingModel:
    """Weights over step and linear features, cut and slope."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = 40_000, steps: int = 12, rounds: int = 300, ridge: float = 1e-4):
        rng = np.random.default_rng(8)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, steps + 1)[1:-1])) for c in x.T]
        z = self._expand(x)
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        self.weight = np.zeros(z.shape[1])
        self.cut, self.slope, self.base = 0.0, 0.0, float((len(good) + 0.5) / (len(y) + 1))
        if not len(good) or not len(bad):
            return
        over, under = rng.choice(good, pairs), rng.choice(bad, pairs)
        moment, rate = np.zeros_like(self.weight), 0.5
        look = self.weight.copy()
        for step in range(rounds):  # Nesterov's accelerated gradient on the pairs' logistic loss
            s = z @ look
            pull = 1 / (1 + np.exp(np.clip(s[over] - s[under], -50, 50)))
            # a document's features count by the sum over its pairs, so no difference is ever stored
            grad = ridge * look - z.T @ (np.bincount(over, pull, len(z)) - np.bincount(under, pull, len(z))) / pairs
            new = look - rate * grad
            look = new + step / (step + 3) * (new - moment)
            moment = new
        self.weight = moment
        s = z @ self.weight
        self.cut = float(np.quantile(s, 1 - self.base))
        spread = s.std() + 1e-9
        d, a = (s - self.cut) / spread, 1.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-a * d))
            a = float(np.clip(a + ((y - p) @ d) / (p * (1 - p) @ d**2 + 1e-6), 0.05, 30))
        self.slope = a / spread

    def _expand(self, x: np.ndarray) -> np.ndarray:
        steps = [np.concatenate([c[:, None] > e[None, :]], 1).astype(np.float64) for c, e in zip(x.T, self.edges)]
        return np.concatenate((np.clip((x - self.mean) / self.spread, -4, 4), *steps), 1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.slope:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(np.clip(-self.slope * (self._expand(x) @ self.weight - self.cut), -700, 700)))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, *, sample: int = 16_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RankingModel | None:
    """A model from about ``sample`` labelled documents at most, chosen by a
    hash of the id.

    Null ids and labels other than 0 and 1 are left out, repeated labels count
    once, contradictory ones both.  A document that stands several times
    counts once for each label, by the least of its rows' features; a null
    text is an empty one.  Features are of whole texts, however long.  Labels
    of one kind only give that kind's base rate for every text, no labelled
    documents give None.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).distinct()
    n = known.count()
    chosen = known.where(hash_share(F.col("i"), sample / max(n, 1)))

    def run(batches):
        for b in batches:
            x = [features(t).tolist() for t in utf8(b.column("t"))]
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["i", "y", "x"])

    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    # the sample is bounded, so broadcasting its ids spares a shuffle of all texts
    rows = texts.join(F.broadcast(chosen), "i").select(F.col("i").cast("long").alias("i"), F.col("y").cast("int").alias("y"), "t").mapInArrow(run, "i long, y int, x array<double>")
    rows = rows.groupBy("i", "y").agg(F.min("x").alias("x")).collect()  # one row a chosen label
    if not rows:
        return None
    rows.sort(key=lambda r: (r.i, r.y, r.x))
    return RankingModel(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: RankingModel | None, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    A null text counts as empty.  Without a model every score is 0.5.
    Each row is judged alone: repeated rows get equal scores.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = utf8(b.column("t"))
            p = m.probability(np.stack([features(t) for t in texts])) if m is not None and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), held_out.alias("h"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: RankingModel | None, *, text_col: str = "text") -> DataFrame:
    """The rows that the model does not reject, with all their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            if m is not None and b.num_rows:
                p = m.probability(np.stack([features(t) for t in utf8(b.column(text_col))]))
                b = b.filter(pa.array(p >= 0.5))
            yield b

    return docs.mapInArrow(run, docs.schema)
