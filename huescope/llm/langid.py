"""Language identification by prediction by partial matching.

For each language a byte-context trie (:mod:`.ppm`) is learned from a bounded
sample of labelled texts and then frozen.  A text is coded word by word with
each trie; the language with the shortest exact code length wins.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hash_share, held, strings
from .ppm import ByteTrie, blocks, distinct_grams

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])
CACHE, LONGEST, GRAMS = 400_000, 48, 1_000_000  # words whose costs a Python worker keeps, their length in bytes, and grams


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, sample_chars: int = 1_500_000) -> dict[str, ByteTrie]:
    """One frozen trie for each non-null language of ``docs``.

    The sample is bounded: about ``sample_chars`` characters a language, as
    whole texts chosen by a hash of id and text.  Rows without a language or
    text teach nothing, repeated rows count once; a single language is the
    only answer, and without any the result is empty.  The words are counted
    by the tasks; only their counts come to the driver.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("l is not null and t is not null")
    sizes = {r.l: r.n for r in labelled.groupBy("l").agg(F.sum(F.length("t")).alias("n")).collect()}
    if not sizes:
        return {}
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen |= (F.col("l") == F.lit(lang)) & hash_share(F.xxhash64("i", "t"), sample_chars / max(n, 1))

    def run(batches):
        for b in batches:
            counts: dict[str, Counter] = {}
            for lang, t in zip(b.column("l").to_pylist(), strings(b.column("t"))):
                counts.setdefault(lang, Counter()).update(t.lower().encode().split())
            for lang, c in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["l", "word", "c"])

    rows = labelled.where(chosen).dropDuplicates(["i", "t", "l"]).select("l", "t")
    words = rows.mapInArrow(run, "l string, word binary, c long").groupBy("l", "word").agg(F.sum("c").alias("c")).toArrow()
    out = {}
    for lang in sorted(sizes):
        mine = words.filter(pa.compute.equal(words.column("l"), lang)).sort_by("word")
        out[lang] = ByteTrie.of_words(mine.column("word").to_pylist(), mine.column("c").to_numpy().astype(float), order)
    return out


class WordCosts:
    """Code lengths of words under each trie, those of short words kept.

    At most :data:`CACHE` words of :data:`LONGEST` bytes and :data:`GRAMS`
    grams are kept; when they are too many, the table starts again.
    """

    def __init__(self, tries: list[ByteTrie]):
        self.tries, self.index, self.costs = tries, {}, np.zeros((0, len(tries)))
        self.grams, self.gram_costs = np.zeros(0, np.uint64), np.zeros((0, len(tries)))

    def _gram_costs(self, code: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Costs of distinct grams in order, the new ones worked out."""
        at = np.searchsorted(self.grams, code)
        new = np.ones(len(code), bool)
        inside = at < len(self.grams)
        new[inside] = self.grams[at[inside]] != code[inside]
        fresh = np.stack([t.cost(code[new], reach[new]) for t in self.tries], 1)
        out = np.empty((len(code), len(self.tries)))
        out[new], out[~new] = fresh, self.gram_costs[at[~new]]
        if len(self.grams) + int(new.sum()) > GRAMS:
            self.grams, self.gram_costs = code, out
        else:
            self.grams, self.gram_costs = np.insert(self.grams, at[new], code[new]), np.insert(self.gram_costs, at[new], fresh, axis=0)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        """One row a word, worked out in blocks of a bounded number of bytes."""
        out = [np.zeros((0, len(self.tries)))]
        for part in blocks(words):
            code, reach, at, first = distinct_grams(part, self.tries[0].top)
            out.append(np.add.reduceat(self._gram_costs(code, reach)[at], first))
        return np.concatenate(out)

    def totals(self, texts: list[list[bytes]]) -> np.ndarray:
        """Summed code lengths of each text's words."""
        seen = set().union(*texts)
        new = [w for w in seen - self.index.keys() if len(w) <= LONGEST]
        if len(self.index) + len(new) > CACHE:
            self.index.clear()
            self.costs, new = self.costs[:0], [w for w in seen if len(w) <= LONGEST]
        self.index.update(zip(new, range(len(self.costs), len(self.costs) + len(new))))
        self.costs = np.concatenate((self.costs, self.of(new)))
        long_ = [w for w in seen if len(w) > LONGEST]
        extra = dict(zip(long_, self.of(long_))) if long_ else {}
        out = np.zeros((len(texts), len(self.tries)))
        for i, words in enumerate(texts):
            if extra:
                for w in words:
                    if w in extra:
                        out[i] += extra[w]
                words = [w for w in words if w not in extra]
            out[i] += self.costs[list(map(self.index.__getitem__, words))].sum(0)
        return out


def predict(docs: DataFrame, tries: dict[str, ByteTrie], held_out: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits for every row.

    ``score`` is the winner's share of the probabilities that the tries give
    the whole text; equal lengths go to the first language by name.  A null
    text, one without a letter, or no learned language: ``und``, score 0.
    Each row is judged alone, so repeated rows get equal answers.
    """
    bounded_batches(docs.sparkSession)
    names = sorted(tries)
    model = docs.sparkSession.sparkContext.broadcast([tries[n] for n in names])
    which = uuid.uuid4().hex  # a Python worker keeps its words from task to task

    def run(batches):
        costs = held("language costs", which, lambda: WordCosts(model.value))
        for batch in batches:
            texts = strings(batch.column("t"))
            words = [x.lower().encode().split() for x in texts]
            pred, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if names:
                totals = costs.totals(words)
            for i, x in enumerate(texts):
                if not names or not any(map(str.isalpha, x)):
                    continue
                total = totals[i]
                k = int(total.argmin())
                pred[i], bits[i] = names[k], total[k]
                score[i] = 1 / np.exp2(np.maximum(total[k] - total, -1000)).sum()
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("h"), pa.array(pred, pa.string()), pa.array(score), pa.array(bits)], schema=_OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), held_out.alias("h"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits double")
