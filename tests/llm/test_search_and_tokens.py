import numpy as np
import pytest
from pyspark.sql import functions as F

from huescope.llm import packing, queries, tokencount, topk

from .data import ODD_TEXTS, as_rows, documents


def brute_top(rows, k):
    """Best product for each pair of ids, over all their rows."""
    best = {}
    for i, v in rows:
        for j, w in rows:
            if i % 50 == 0 and j != i and len(w) == len(v):
                s = sum(a * b for a, b in zip(v, w))
                best[i, j] = max(best.get((i, j), s), s)
    out = []
    for i in {i for i, _ in best}:
        scores = sorted((-s, j) for (q, j), s in best.items() if q == i)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vector array<long>").withColumns({"score": F.lit(0), "shard": F.lit(1)})


def test_top_k_equals_brute_force_with_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-3, 4, 6).tolist()) for i in range(700)] + [(i, [1, 2, 3, 4, 5, 6]) for i in range(700, 1100)] + [(i, [5, 5]) for i in (1150, 1151)]
    bad = [(2000, None), (2050, [1, None, 3, 4, 5, 6]), (None, [1, 1, 1, 1, 1, 1])]
    got = topk.top_k(vectors(spark, rows + bad), F.col("vec_id") % 50 == 0, shard_bytes=2_000, pivots=3, seed_rows=20, block=7)
    assert sorted(as_rows(got)) == brute_top(rows, 5)


def test_top_k_of_repeated_ids_and_rows(spark):
    same = [1, 2, 3, 4]
    few = [(50, same)] * 6 + [(51, same), (52, [0, 1, 1, 1])]
    got = topk.top_k(vectors(spark, few), F.col("vec_id") % 50 == 0)
    assert sorted(as_rows(got)) == [(50, 1, 51, 30), (50, 2, 52, 9)]
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(0, 160)), rng.integers(-2, 3, 4).tolist()) for _ in range(500)]
    rows += rows[::3]
    for pivots, size in ((1, 400), (40, 10**6)):
        got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, k=3, pivots=pivots, shard_bytes=size, seed_rows=60)
        assert sorted(as_rows(got)) == brute_top(rows, 3)


def test_top_k_of_many_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 10, 1 + i % 40).tolist()) for i in range(1200)] + [(1250, [])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, seed_rows=30, shard_bytes=3_000)
    assert sorted(as_rows(got)) == brute_top([r for r in rows if r[1]], 5)


def test_top_k_of_large_numbers_and_of_nothing(spark):
    rows = [(i, [(i + 1) << 24, -(i << 23), 7]) for i in range(60)]
    assert sorted(as_rows(topk.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0, shard_bytes=500))) == brute_top(rows, 5)
    assert as_rows(topk.top_k(vectors(spark, []), F.lit(True))) == []
    assert as_rows(topk.top_k(vectors(spark, [(0, [1, 2])]), F.lit(True))) == []


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


def library_ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_counts_equal_the_library(spark, sf, tokenizer):
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    got = as_rows(tokencount.count_tokens(documents(spark, ODD_TEXTS + real), queries.vocabulary_path()))
    texts = dict(enumerate(ODD_TEXTS + real))
    assert len(got) == len(texts) + 1
    for doc_id, n_bytes, n_tokens, over in got:
        want = len(library_ids(tokenizer, texts[doc_id]))
        assert (n_bytes, n_tokens, over) == (len((texts[doc_id] or "").encode()), want, want > 512), texts[doc_id]
    assert as_rows(tokencount.count_tokens(documents(spark, []), queries.vocabulary_path())) == []


LONG = ["a" * 60_000, " " * 300_000, "x" + " " * 5_000 + "\t" * 5_000 + "y", "\n \t" * 40_000 + "q", "1" * 50_000, "!" * 50_000, " " * 1_999 + "a", "\u4f60\u597d" * 20_000, "word " * 60_000]


def test_very_long_texts(spark, tokenizer):
    """Runs of white space that the merge library's own splitting cannot bear
    among them."""
    want = {i: (library_ids(tokenizer, t) + [0], 2 if i == 4 else 1) for i, t in enumerate(LONG)}
    docs = documents(spark, LONG)
    for doc_id, _, n, _ in as_rows(tokencount.count_tokens(docs, queries.vocabulary_path())):
        assert n == len(want[doc_id][0]) - 1
    check_packing(as_rows(packing.pack(docs, queries.vocabulary_path())), want)


def test_caches_keep_no_long_keys():
    from huescope.llm.bpe import Cache

    made = Cache(len, size=10, longest=5)
    assert [made["a" * n] for n in range(40)] == list(range(40)) and max(map(len, made)) == 5
    for i in range(1000):
        assert made[f"{i}"] == len(f"{i}")
    assert len(made) <= 10 and len(made.old) <= 10


def check_packing(got, want):
    """want: ids by document, in the order given; documents may repeat."""
    import zlib
    from collections import defaultdict

    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc_id, start, length, crc, total, seq, offset in got:
        by_doc[doc_id].append((start, length, crc, total))
        by_seq[seq].append((offset, length))
    for doc_id, (ids, copies) in want.items():
        pieces = sorted(by_doc.pop(doc_id))
        at = [0] * copies
        assert sum(p[1] for p in pieces) == copies * len(ids)
        for start, length, crc, total in pieces:
            assert total == len(ids) and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc
            k = at.index(start)
            at[k] += length
        assert set(at) == {len(ids)}
    assert not by_doc
    padding = 0
    for pieces in by_seq.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert 0 < end <= 1024
        padding += 0 if end & (end - 1) == 0 else 1024 - end
    return padding


def test_packing_is_an_exact_round_trip(spark, sf, tokenizer):
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = ODD_TEXTS + real
    got = as_rows(packing.pack(documents(spark, texts).repartition(3), queries.vocabulary_path()))
    want = {i: (library_ids(tokenizer, t) + [0], 2 if i == 4 else 1) for i, t in enumerate(texts)}
    padding = check_packing(got, want)
    assert padding < 0.02 * sum(len(ids) for ids, _ in want.values())
    assert as_rows(packing.pack(documents(spark, []), queries.vocabulary_path())) == []


def packed(lengths, capacity=64, **options):
    """Rows of a packer fed with documents of these lengths."""
    packer = packing.Packer(capacity, 0, **options)
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4").tobytes())
    packer.finish()
    return packer.out


def test_documents_that_fit_stay_whole():
    rng = np.random.default_rng(4)
    for lengths in (rng.integers(1, 400, 3000), rng.integers(1, 64, 900), rng.integers(60, 70, 50), rng.integers(1, 4, 700), [64] * 5, [1], [200], np.concatenate((rng.integers(1, 30, 500), [9000]))):
        out = packed(lengths.tolist() if hasattr(lengths, "tolist") else lengths)
        by_doc, by_seq = {}, {}
        for doc, start, length, _, total, seq, offset in out:
            by_doc.setdefault(doc, []).append((start, length))
            by_seq.setdefault(seq, []).append((offset, length))
            assert total == lengths[doc] and length > 0
        padding = 0
        for doc, n in enumerate(lengths):
            at = 0
            for start, length in sorted(by_doc[doc]):
                assert start == at
                at += length
            assert at == n
        for pieces in by_seq.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 64
            padding += 64 - at
        assert padding < 64  # the last sequence
        cut = sum(len(by_doc[i]) > 1 for i, n in enumerate(lengths) if n <= 64)
        if sum(n for n in lengths if n > 64) > sum(lengths) / 2:
            assert cut <= 0.02 * len(lengths)


def test_a_class_sequence_takes_a_fixed_count():
    out = packed([20, 10, 20, 10, 20, 10, 10, 10, 10, 500])
    first = [(doc, seq) for doc, _, _, _, _, seq, _ in out if doc != 9]
    assert {d for d, s in first if s == first[0][1]} == {0, 2, 4}  # 64 // 20 = 3 documents
    assert len({s for d, s in first if d in (1, 3, 5, 6, 7, 8)}) == 1
