import numpy as np
import pytest

from huescope.llm.boost import BoostedTrees
from huescope.llm.ppm import ByteTrie

WORDS = [b"the", b"then", b"than", b"hat", b"at", b"", b"\xff\xfe", b"the" * 40]
COUNTS = np.array([50.0, 7, 3, 2, 9, 1, 1, 2])


def brute_bits(words, weights, order, word):
    """Code length by following the definition symbol by symbol."""
    seen = {}
    for w, c in zip(words, weights):
        s = b" " + w + b" "
        for p in range(1, len(s)):
            for k in range(min(order, p) + 1):
                seen.setdefault((k, s[p - k : p]), {}).setdefault(s[p], 0)
                seen[k, s[p - k : p]][s[p]] += c
    s, bits = b" " + word + b" ", 0.0
    for p in range(1, len(s)):
        gone = set()
        for k in range(min(order, p), -1, -1):
            full = seen.get((k, s[p - k : p]))
            if full is None:
                continue
            left = {a: c for a, c in full.items() if a not in gone}
            total, kinds = sum(left.values()), len(left)
            if s[p] in left:
                bits -= np.log2(left[s[p]] / (total + kinds))
                break
            if kinds:
                bits -= np.log2(kinds / (total + kinds))
            gone = set(full)
        else:
            bits += np.log2(256 - len(gone))
    return bits


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_code_lengths_follow_the_definition(order):
    trie = ByteTrie.of_words(WORDS, COUNTS, order)
    asked = [b"the", b"thee", b"hen", b"zebra", b"", b"\xff", b"that" * 9, b"a"]
    assert np.allclose(trie.bits(asked), [brute_bits(WORDS, COUNTS, order, w) for w in asked])


def test_probabilities_of_single_bytes_sum_to_one():
    trie = ByteTrie.of_words(WORDS, COUNTS, 3)
    # words of one byte, without the closing byte's share
    closing = {w: brute_bits(WORDS, COUNTS, 3, w) for w in [bytes([b]) for b in range(256) if b != 32]}
    first = []
    for b in range(256):
        if b == 32:
            first.append(2 ** -trie.bits([b""])[0])
        else:
            first.append(2 ** -closing[bytes([b])] / 2 ** -(closing[bytes([b])] - brute_first(b)))
    assert abs(sum(first) - 1) < 1e-9


def brute_first(b):
    whole = brute_bits(WORDS, COUNTS, 3, bytes([b]))
    # the closing byte after b, coded alone
    return whole - closing_bits(b)


def closing_bits(b):
    seen = {}
    for w, c in zip(WORDS, COUNTS):
        s = b" " + w + b" "
        for p in range(1, len(s)):
            for k in range(min(3, p) + 1):
                seen.setdefault((k, s[p - k : p]), {}).setdefault(s[p], 0)
                seen[k, s[p - k : p]][s[p]] += c
    s, bits, gone = b" " + bytes([b]) + b" ", 0.0, set()
    for k in (2, 1, 0):
        full = seen.get((k, s[2 - k : 2]))
        if full is None:
            continue
        left = {a: c for a, c in full.items() if a not in gone}
        total, kinds = sum(left.values()), len(left)
        if 32 in left:
            return bits - np.log2(left[32] / (total + kinds))
        if kinds:
            bits -= np.log2(kinds / (total + kinds))
        gone = set(full)
    return bits + np.log2(256 - len(gone))


def test_empty_model_codes_bytes_equally():
    trie = ByteTrie.of_words([], np.zeros(0), 2)
    assert np.allclose(trie.bits([b"ab", b""]), [24.0, 8.0])


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = BoostedTrees().fit(x[:3000], y[:3000])
    assert ((model.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert BoostedTrees().fit(x[:5], np.ones(5)).probability(x[:2]).min() > 0.8
