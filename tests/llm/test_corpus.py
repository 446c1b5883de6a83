import math
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from huescope.llm import lmscore, neardup, simhash
from huescope.llm.common import in_fold, outside_fold
from huescope.llm.components import components
from huescope.llm.ppm import END, ByteTrie

from .data import ODD_TEXTS, as_rows, documents


def brute_fingerprint(text, k):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    root = {f: f for f in set(fps)}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    known = list(root)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = defaultdict(lambda: None)
    for i, f in zip(ids, fps):
        r = find(f)
        least[r] = i if least[r] is None else min(least[r], i)
    return [least[find(f)] for f in fps]


def test_near_duplicates_equal_brute_force(spark, sf):
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]
    base = real[0].split()
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, len(base), max(1, len(base) // 40))]
    texts = ODD_TEXTS + real + near
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    fps = [brute_fingerprint(t, 4) for t in texts]
    want = brute_components(range(len(texts)), fps, 4)
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert simhash.near_duplicates(documents(spark, texts)).count() == len(texts) + 1
    assert as_rows(simhash.near_duplicates(documents(spark, []))) == []


def test_covering_masks_miss_no_pair():
    rng = np.random.default_rng(4)
    for level in range(6):
        family = [m & (1 << 64) - 1 for m in simhash.masks(4, level)]
        for _ in range(3000):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(m & diff == 0 for m in family)


def test_large_buckets_are_dealt_finer(spark):
    rng = np.random.default_rng(6)
    seeds = [int(x) for x in rng.integers(0, 2**63, 5)]
    fps = sorted({s ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for s in seeds for _ in range(120)} | {int(x) for x in rng.integers(0, 2**63, 200)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    for levels in (6, 1, 2):
        check_links(spark, table, fps, signed, levels)


def check_links(spark, table, fps, signed, levels):
    links = simhash.links_within(table, 4, levels=levels, bucket=12).distinct().collect()
    got = {}
    roots = components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long"))
    mapped = {r.node: r.root for r in roots.collect()}
    for f in signed:
        got.setdefault(mapped.get(f, f), []).append(f)
    want = defaultdict(list)
    for f, c in zip(signed, brute_components(range(len(fps)), fps, 4)):
        want[c].append(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(300, 300), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200
    assert components(spark.createDataFrame([], "a long, b long")) is None


def test_lm_scores_equal_direct_counting(spark, sf):
    real = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("text").collect()]
    texts = ODD_TEXTS + real
    docs = documents(spark, texts)
    got = lmscore.score(docs, outside_fold("doc_id", 7, 2), in_fold("doc_id", 7, 2), order=3, hot_words=50).collect()
    assert len(got) == len(texts) + 1
    held = {r.doc_id: r.held_out for r in got}
    split = lambda t: (t or "").encode().lower().split()
    rows = [*enumerate(texts), (4, texts[4])]
    counts = Counter(w for i, t in rows if not held[i] for w in [*split(t), END])
    total, kinds = sum(counts.values()), len(counts)
    trie = ByteTrie.of_words(list(counts), np.array(list(counts.values()), float), 3)
    for r in got:
        words = [*split(texts[r.doc_id]), END]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words), rel_tol=1e-9)
        assert math.isclose(r.score, -trie.bits(words).sum() / math.log2(10), rel_tol=1e-9)
    assert as_rows(lmscore.score(documents(spark, []), F.lit(True), F.lit(False))) == []
    nothing = lmscore.score(documents(spark), F.lit(False), F.lit(True)).collect()
    assert len(nothing) == len(ODD_TEXTS) + 1 and {r.n_known for r in nothing} == {0}


def test_gram_costs_equal_the_whole_trie_at_the_real_order(spark, sf):
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(250).select("text").collect()]
    counts = Counter(w for t in real[:200] for w in (t or "").lower().encode().split())
    asked = Counter({w: 0 for t in real for w in (t or "").lower().encode().split()}) | counts
    rows = [(w, counts[w], i // 500) for i, w in enumerate({**asked, **{w: 0 for t in real for w in (t or "").lower().encode().split()}})]
    table = spark.createDataFrame(rows, "word binary, c long, chunk long")
    trie = ByteTrie.of_words([w for w, c, _ in rows if c], np.array([float(c) for _, c, _ in rows if c]), 5)
    grams = lmscore.written(table.mapInArrow(lmscore._word_grams(5), "k int, code long, n long").groupBy("k", "code").agg(F.sum("n").alias("n")), "g")
    for chunk in (1, 3_000):  # groups of contexts one by one, and some together
        costs = {r.code: r.bits for r in lmscore.gram_costs(grams, 5, chunk).collect()}
        for w, _, _ in rows[::17]:
            data = b" " + w + b" "
            codes = [int.from_bytes(data[max(0, p - 5) : p + 1], "big") for p in range(1, len(data))]
            assert math.isclose(sum(costs[c] for c in codes), trie.bits([w])[0], rel_tol=1e-9)
    got = {bytes(r.word): r.bits for r in lmscore.word_bits(table, 5).collect()}
    want = dict(zip([w for w, _, _ in rows], trie.bits([w for w, _, _ in rows])))
    assert got.keys() == want.keys() and all(math.isclose(got[w], want[w], rel_tol=1e-9) for w in want)


def test_lm_scores_at_the_default_order(spark):
    texts = ["the cat sat on the mat", "the cat sat", None, "zebra " * 50, "x" * 4_000] * 20
    got = {(r.doc_id, r.score) for r in lmscore.score(documents(spark, texts), F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1, chunk_bytes=40, hot_words=3).collect()}
    counts = Counter(w for i, t in [*enumerate(texts), (4, texts[4])] if i % 2 == 0 for w in [*(t or "").encode().split(), END])
    trie = ByteTrie.of_words(list(counts), np.array(list(counts.values()), float), 5)
    for i, s in got:
        assert math.isclose(s, -trie.bits([*(texts[i] or "").encode().split(), END]).sum() / math.log2(10), rel_tol=1e-9)


def shingle_set(text, k=5):
    return set(simhash.shingle_hashes((text or "").encode(), k).tolist())


def brute_kept(texts, similarity=0.8):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [i for i in range(len(texts)) if find(i) == i]


def test_keep_one_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", "solo words here", "solo words here"]
    for _ in range(25):
        base = rng.choice(words, int(rng.integers(5, 400))).tolist()
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 6))):
            copy = [w if rng.random() > rng.choice([0.005, 0.02, 0.05]) else "x" for w in base]
            texts.append(" ".join(copy).upper())
    docs = documents(spark, texts)
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_kept(texts)
    assert sorted(r.doc_id for r in neardup.keep_one(docs, bucket=4).collect()) == brute_kept(texts)
    assert as_rows(neardup.keep_one(documents(spark, []))) == []


def test_short_near_copies_are_found(spark):
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(300):
        words = [f"w{i}" for i in rng.integers(0, 10**6, 9)]
        texts += [" ".join(words[:8]), " ".join(words)]  # 4 of 5 shingles
    kept = sorted(r.doc_id for r in neardup.keep_one(documents(spark, texts)).where("doc_id <> 4").collect())
    assert kept == [i for i in brute_kept(texts) if i != 4]


def two_families(rng):
    """Two families of 10 close copies each, 0.8 to 0.9 between them."""
    base = [f"v{i}" for i in rng.integers(0, 10**6, 805)]
    other = base[:]
    for k in range(30, 800, 60):
        other[k] = "changed"
    out = []
    for family in (base, other):
        for k in range(10):
            copy = family[:]
            copy[5 + 80 * k] = f"x{len(out)}"
            out.append(" ".join(copy))
    return out


def test_dense_families_are_connected(spark):
    rng = np.random.default_rng(21)
    texts = [t for _ in range(12) for t in two_families(rng)]
    assert brute_kept(texts) == list(range(0, 240, 20))
    assert sorted({r.doc_id for r in neardup.keep_one(documents(spark, texts)).collect()}) == brute_kept(texts)


def test_clashing_columns_and_kept_rows(spark):
    texts = [None, " ", "a b c d e f g h", "a b c d e f g h", "one two three four five six", "A b c d e f g h"]
    docs = documents(spark, texts).withColumns({c: F.lit("x") for c in ("_hash", "_id", "_kept", "_found", "cls", "comp", "key", "hash")})
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r._hash, r._id, r._kept) for r in got.collect()) == [(i, "x", "x", "x") for i in (0, 2, 4)]


def test_trees_join_what_is_close():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(2, 40))
        same = rng.integers(0, 100, (n, n)).astype(np.int16)
        same = np.where(np.triu(same, 1) > 93, np.triu(same, 1), -1).astype(np.int16)
        same = np.maximum(same, same.T)
        comp = rng.integers(0, n, n)
        root = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, j in np.argwhere(same >= 0):
            root[find(comp[i])] = find(comp[j])
        want = [find(c) for c in comp]
        pairs = neardup._tree(comp, same)
        assert all(same[i, j] >= 0 for i, j in pairs)
        root.clear()
        for i, j in pairs:
            assert find(comp[i]) != find(comp[j])
            root[find(comp[i])] = find(comp[j])
        got = [find(c) for c in comp]
        assert all((want[i] == want[j]) == (got[i] == got[j]) for i in range(n) for j in range(n))


def test_components_grow_with_further_links(spark):
    rng = np.random.default_rng(12)
    roots, seen = None, []
    for _ in range(4):
        links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (9, 2)) if a != b]
        seen += links
        before, roots = roots, neardup.joined(roots, spark.createDataFrame(links, "a long, b long"))
        want = {r.node: r.root for r in components(spark.createDataFrame(seen, "a long, b long")).collect()}
        assert {r.node: r.root for r in roots.collect()} == want


def inverted_kept(texts, similarity=0.8):
    """brute_kept for many texts: pairs that share no shingle are not similar."""
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset(shingle_set(t)), []).append(i)
    known = sorted(sets, key=lambda s: sets[s][0])
    root, by = list(range(len(known))), defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(known):
        common = Counter(j for x in s for j in by[x])
        for j, c in common.items():
            if c >= similarity * (len(s) + len(known[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            by[x].append(i)
    return sorted(sets[known[i]][0] for i in range(len(known)) if find(i) == i)


def test_kept_documents_of_the_tables_are_exactly_the_right_ones(spark):
    """Recall measured, not calculated: no link of the test table is lost."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    ids, texts = zip(*rows.collect())
    got = sorted(r.doc_id for r in neardup.keep_one(rows).select("doc_id").collect())
    assert got == [ids[i] for i in inverted_kept(texts)]


def test_a_hot_passage_hides_no_pair(spark):
    """Thousands of texts share a passage; similar pairs among them are found."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = []
    for i in range(700):
        own = [f"v{x}" for x in rng.integers(0, 10**7, 30)]
        texts.append(f"{passage} {' '.join(own)}")
        if i % 50 == 0:
            own[10] = "changed"
            texts.append(f"{passage} {' '.join(own)}")
    docs = documents(spark, texts)
    assert sorted({r.doc_id for r in neardup.keep_one(docs, bucket=64).collect()}) == inverted_kept(texts)


def test_exact_trees_of_a_bucket_equal_all_pairs():
    import pyarrow as pa

    rng = np.random.default_rng(17)
    for trial in range(40):
        sets, comp = [], []
        for c in range(int(rng.integers(1, 6))):
            base = rng.integers(0, 2**63, int(rng.integers(3, 60)))
            for _ in range(int(rng.integers(1, 6))):
                own = np.unique(np.where(rng.random(len(base)) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 2**63, len(base)), base)).astype(np.uint64)
                sets.append(own)
                comp.append(int(rng.integers(0, 9)))
        keys = np.sort(rng.integers(0, 3, len(sets)))
        table = pa.table({"key": keys, "cls": np.arange(len(sets)), "comp": comp, "s": [x.tobytes() for x in sets]})
        batches = table.to_batches(max_chunksize=int(rng.integers(1, 9)))
        got = [(a, b, k) for out in neardup._exact_tree(0.8)(iter(batches)) for a, b, k in zip(*(out.column(i).to_pylist() for i in range(3)))]

        def linked(pairs):
            root = {}

            def find(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for a, b in pairs:
                root[find(a)] = find(b)
            return find

        for key in set(keys.tolist()):
            mine = np.flatnonzero(keys == key).tolist()
            true = [(i, j) for i in mine for j in mine if i < j and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
            of_comp = [(i, -1 - comp[i]) for i in mine]
            a, b = linked(true + of_comp), linked([(x, y) for x, y, k in got if k == key] + of_comp)
            assert all((a(i) == a(j)) == (b(i) == b(j)) for i in mine for j in mine)
            assert {(x, y) for x, y, k in got if k == key} <= set(true)


def test_blocks_let_all_classes_of_a_hot_bucket_meet(spark):
    rows = [(7, 1 if i < 40 else 2 if i < 70 else i, i, 9, b"s") for i in range(150)] + [(8, i % 2, i, 9, b"s") for i in range(30)]
    comp = {(k, i): c for k, c, i, _, _ in rows}
    got = defaultdict(set)
    for r in neardup.blocks(spark.createDataFrame(rows, "key long, comp long, cls long, n long, sketch binary"), 16).collect():
        got[r.key].add(r.cls)
    met = {(a, b) for x in got.values() for a in x for b in x}
    for key, n in ((7, 150), (8, 30)):
        assert all((a, b) in met for a in range(n) for b in range(n) if comp[key, a] != comp[key, b])
    assert max(map(len, got.values())) < 40


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert after.count() <= before.count()
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    # where a document is cut depends on its neighbours; that each is there whole does not
    whole = lambda df: sorted(as_rows(df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens"), F.min("start"))))
    assert whole(corpus_pipeline.run(spark, sf)) == whole(pieces)
