"""Language-model scores by prediction by partial matching.

All training texts are counted: the words with their counts form one table,
the byte grams of its words (up to ``order`` context bytes, at every size of
the input) another: a trie (:mod:`.ppm`) with escape estimation and symbol
exclusion, dealt over the cluster.  A gram's statistics are all about contexts
that end in the same two bytes, so the grams are dealt by these; only the
levels below, at most 65,792 grams of bytes, are sent to all.  Each distinct
gram is coded once, each distinct word is the sum of its grams, and a
document the sum of its words and one end mark.  Contexts end at word borders.

The most frequent words (a bounded number) are broadcast and settle most
tokens inside the scan; the rest, which no single word can dominate, meet
the word table in a shuffle join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, utf8, written
from .ppm import END, ByteTrie, blocks, count_grams, distinct_grams

LOG2_10 = math.log2(10)
COUNTED, COUNTED_BYTES = 400_000, 64 << 20  # different words, and bytes of text, after which a task passes its counts on
HOT_BYTES = 48  # longest word that may be broadcast
BASE = 2  # levels of the trie that every task has
_WORD = pa.schema([("word", pa.binary()), ("c", pa.int64())])
_PART = pa.schema([("uid", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64())])
_PART_SQL = "uid long, word binary, tf long, doc_id long, held_out boolean, n_tokens long, known long, base double, bits double"


def _count(batches):
    """Words with their counts in training texts, 0 if they stand only
    elsewhere; sums over batches until they grow large."""
    train, other, held = Counter(), set(), 0

    def counted():
        for w in other - train.keys():
            train[w] = 0
        out = pa.RecordBatch.from_arrays([pa.array(list(train), pa.binary()), pa.array(list(train.values()), pa.int64())], schema=_WORD)
        train.clear(), other.clear()
        return out

    for b in batches:
        for text, use in zip(utf8(b.column("t")), b.column("use").to_pylist()):
            held += len(text)
            words = text.lower().split()
            if use:
                train.update(words)
                train[END] += 1
            else:
                other.update(words)
        other.add(END)
        if len(train) + len(other) > COUNTED or held > COUNTED_BYTES:
            held = 0
            yield counted()
    yield counted()


def _in_chunks(size: int):
    """Give each word the number of its chunk, of about ``size`` bytes."""
    def run(batches):
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            numbers = []
            for w in b.column("word").to_pylist():
                if held > size:
                    chunk, held = chunk + 1, 0
                held += len(w) + 1
                numbers.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(numbers, pa.int64())], names=["word", "c", "chunk"])

    return run


def _word_grams(order: int):
    def run(batches):
        for b in batches:
            words, c = b.column("word").to_pylist(), b.column("c").to_numpy().astype(float)
            at = 0
            for part in blocks(words):
                for k, (codes, counts) in enumerate(count_grams(part, c[at : at + len(part)], order)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), k, np.int32)), pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["k", "code", "n"])
                at += len(part)

    return run


def _asked(k: np.ndarray, code: np.ndarray, order: int) -> np.ndarray:
    """Grams that a word's byte is coded from: of the full order, or reaching
    back to the closing byte in front of the word."""
    return (k == order) | ((code >> (8 * k).astype(np.uint64)) == 32) & (k > 0)


def _trie(k: np.ndarray, code: np.ndarray, n: np.ndarray, levels: range, base: ByteTrie | None = None) -> ByteTrie:
    out = []
    for level in levels:
        mine = (k == level) & (n > 0)
        at = np.argsort(code[mine])
        out.append((code[mine][at], n[mine][at].astype(float)))
    return ByteTrie(out, base)


def _arrays(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return table.column("k").to_numpy(), table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()


def gram_costs(grams: DataFrame, order: int, chunk: int = 200_000) -> DataFrame:
    """(code, bits) of every gram that words are coded from.

    ``grams``: (k, code, n), n being 0 where the gram stands in no training
    text.  A task takes the grams by the last two bytes of their contexts,
    in groups of at least ``chunk`` rows.
    """
    low = grams.where(F.col("k") < BASE).toArrow()  # 256 and 65,536 rows at most
    k, code, n = _arrays(low)
    base = _trie(k, code, n, range(min(BASE, order + 1)))
    mine = _asked(k, code, order)
    first = grams.sparkSession.createDataFrame([(int(c), float(x)) for c, x in zip(code[mine], base.cost(code[mine], k[mine]))], "code long, bits double")
    if order < BASE:
        return first
    shared = grams.sparkSession.sparkContext.broadcast(base)

    def run(batches):
        rows, held, enough = [], 0, chunk

        def cost(table):
            k, code, n = _arrays(table)
            trie = _trie(k, code, n, range(BASE, order + 1), shared.value)
            at = _asked(k, code, order)
            return pa.RecordBatch.from_arrays([pa.array(code[at].view(np.int64)), pa.array(trie.cost(code[at], k[at]))], names=["code", "bits"])

        for b in batches:
            rows.append(pa.table(b.columns, names=b.schema.names))
            held += b.num_rows
            if held >= enough:
                table = pa.concat_tables(rows).combine_chunks()
                ends = table.column("ends").to_numpy()
                cut = int(np.searchsorted(ends, ends[-1]))  # the last group may go on
                if cut:
                    yield cost(table.slice(0, cut))
                rows, held = [table.slice(cut)], table.num_rows - cut
                enough = max(chunk, 2 * held)  # a group that goes on is looked at again when it has doubled
        if rows:
            yield cost(pa.concat_tables(rows).combine_chunks())

    ends = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit(0xFFFF)).alias("ends")
    dealt = grams.where(F.col("k") >= BASE).select("k", "code", "n", ends).repartition("ends").sortWithinPartitions("ends")
    return dealt.mapInArrow(run, "code long, bits double").union(first)


def word_bits(counted: DataFrame, order: int) -> DataFrame:
    """(word, c, bits) of the words (word, c, chunk), the trie being that of
    the words with c over 0."""
    grams = written(counted.mapInArrow(_word_grams(order), "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n")), "grams")
    costs = gram_costs(grams, order)

    def needs(batches):
        for b in batches:
            chunks = b.column("chunk").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1])))
            for a, e in zip(cut.tolist(), np.append(cut[1:], len(chunks)).tolist()):
                words = b.column("word").slice(a, e - a).to_pylist()
                code = np.unique(np.concatenate([distinct_grams(part, order)[0] for part in blocks(words)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), chunks[a])), pa.array(code.view(np.int64))], names=["chunk", "code"])

    asked = counted.mapInArrow(needs, "chunk long, code long").distinct().join(costs, "code").select("chunk", F.lit(0).alias("side"), "code", "bits", F.lit(None).cast("binary").alias("word"), F.lit(None).cast("long").alias("c"))
    own = counted.select("chunk", F.lit(1).alias("side"), F.lit(None).cast("long").alias("code"), F.lit(None).cast("double").alias("bits"), "word", "c")

    def summed(batches):
        now, codes, bits, ready = None, [], [], False
        for b in batches:
            chunks, sides = b.column("chunk").to_numpy(), b.column("side").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (chunks[1:] != chunks[:-1]) | (sides[1:] != sides[:-1]))))
            for a, e in zip(cut.tolist(), np.append(cut[1:], len(chunks)).tolist()):
                if chunks[a] != now:
                    now, codes, bits, ready = chunks[a], [], [], False
                part = b.slice(a, e - a)
                if not sides[a]:
                    codes.append(part.column("code").to_numpy().view(np.uint64)), bits.append(part.column("bits").to_numpy())
                    continue
                if not ready:
                    codes, bits, ready = np.concatenate(codes), np.concatenate(bits), True
                    order_ = np.argsort(codes)
                    codes, bits = codes[order_], bits[order_]
                words = part.column("word").to_pylist()
                out = []
                for some in blocks(words):
                    code, _, at, first = distinct_grams(some, order)
                    out.append(np.add.reduceat(bits[np.searchsorted(codes, code)][at], first))
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("c"), pa.array(np.concatenate(out))], names=["word", "c", "bits"])

    dealt = asked.union(own).repartition("chunk").sortWithinPartitions("chunk", "side")
    out = written(dealt.mapInArrow(summed, "word binary, c long, bits double"), "words")
    discard(grams)
    return out


def score(docs: DataFrame, train: Column, held_out: Column, *, order: int = 5, chunk_bytes: int = 2 << 20, hot_words: int = 150_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score
    for every row of ``docs``, learned from its rows where ``train`` holds.

    Null texts count as empty: just the end token.  Without training rows
    nothing is known, and every byte is equally likely.  Repeated rows are
    counted, and scored, as often as they stand.  ``order`` is the trie's at
    every size of the input; at most 6, a gram being seven bytes then.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("h"), F.coalesce(train, F.lit(False)).alias("use"), F.col(text_col).cast("string").alias("t"))
    each = rows.select("t", "use").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counted = written(each.mapInArrow(_in_chunks(chunk_bytes), "word binary, c long, chunk long"), "counted")
    sizes = counted.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, kinds = sizes.n or 0, sizes.v or 0
    words = word_bits(counted, order)
    discard(counted)
    # the least count that at most hot_words words reach, from a histogram of some hundred steps
    step = F.floor(F.log2("c") * 16).cast("int")
    may = (F.col("c") > 0) & (F.octet_length("word") <= HOT_BYTES)
    steps = sorted(((r.s, r["count"]) for r in words.where(may).groupBy(step.alias("s")).count().collect()), reverse=True)
    least, reached = None, 0
    for s, n in steps:
        if reached + n > hot_words:
            break
        least, reached = s, reached + n
    top = words.where(may).where(step >= least).toArrow() if least is not None else None
    end = words.where(F.col("word") == F.lit(END)).first()  # at hand even if it is not among the frequent
    hot = {} if top is None else {w: i for i, w in enumerate(top.column("word").to_pylist())}
    numbers = np.zeros((0, 2)) if top is None else np.stack((np.log10(top.column("c").to_numpy() + 1.0), top.column("bits").to_numpy()), 1)
    shared = spark.sparkContext.broadcast((hot, numbers, (end.c, end.bits) if end else (0, 8.0)))

    def split(batches):
        hot, numbers, (end_c, end_bits) = shared.value
        uid = TaskContext.get().partitionId() << 40
        for b in batches:
            out = [[] for _ in _PART]
            rare_uid, rare_word, rare_tf = [], [], []
            for doc_id, h, text in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), utf8(b.column("t"))):
                words = text.lower().split()
                at = list(map(hot.get, words))
                rare = Counter(w for w, i in zip(words, at) if i is None) if None in at else {}
                found = [i for i in at if i is not None] if rare else at
                sums = numbers[found].sum(0) if found else (0.0, 0.0)
                # the row's own word holds a space, so it meets no word and its rows spread evenly
                for column, value in zip(out, (uid, b" %d" % uid, 0, doc_id, h, len(words) + 1, len(found) + (end_c > 0), sums[0] + math.log10(end_c + 1), sums[1] + end_bits)):
                    column.append(value)
                rare_uid += [uid] * len(rare)
                rare_word += rare.keys()
                rare_tf += rare.values()
                uid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PART)], schema=_PART)
            for a in range(0, len(rare_uid), 200_000):
                n = len(rare_uid[a : a + 200_000])
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000], f.type) for x, f in zip((rare_uid, rare_word, rare_tf), _PART)] + [pa.nulls(n, f.type) for f in list(_PART)[3:]], schema=_PART)

    parts = rows.mapInArrow(split, _PART_SQL)
    rest = words if least is None else words.where(~(may & (step >= least)))
    joined = parts.join(rest, "word", "left")
    tf = F.col("tf").cast("double")
    by = joined.select("uid", "doc_id", "held_out", "n_tokens",
        F.coalesce("known", F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.coalesce("base", tf * F.log10(F.col("c") + 1), F.lit(0.0)).alias("base"), F.coalesce(parts["bits"], tf * rest["bits"], F.lit(0.0)).alias("bits"))
    summed = by.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.sum("bits").alias("bits"))
    each = math.log10(total + kinds + 1)
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(each)).alias("base_score"), (-F.col("bits") / F.lit(LOG2_10)).alias("score"))
