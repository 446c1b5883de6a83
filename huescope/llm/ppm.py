"""Prediction by partial matching over bytes, with frozen statistics.

Texts are coded word by word.  A word is its bytes and a closing 0x20, and
its contexts reach back at most to the 0x20 in front of it, so a word's code
length does not depend on its neighbours: it is worked out once for each
distinct word and a text's length is an exact sum.  Likewise a byte's code
length depends on its longest context and itself alone, its *gram*, and is
worked out once for each distinct gram.

Order ``k`` keeps the counts of every (k context bytes, next byte).  A byte
is coded in the longest known context by PPM method C: a context seen T
times with D different followers gives a follower with count c the share
c / (T + D) and an escape D / (T + D).  After an escape the followers of the
longer context are excluded from the shorter one.  Since every follower of
a context also follows its suffix, the excluded mass is one number for each
context and is stored beside T and D.  Below order 0 the bytes never seen
are equally likely.
"""

from __future__ import annotations

import numpy as np

END = b"\n"  # stands for the end of a text; no word can contain it
CHUNK = 1 << 19
MASKS = np.array([(1 << (8 * (k + 1))) - 1 for k in range(8)], np.uint64)  # the bytes of a gram by its context bytes


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted keys, and whether each wanted key is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with their borders, how far each byte's context
    reaches, and the index of each word's first coded byte."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) + 1
    reach = np.arange(len(data), dtype=np.int64) - np.repeat(np.concatenate(([0], first - 1)), np.concatenate(([1], lengths)))
    return data, reach, first


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte: the ``order`` bytes before it and itself, as a number."""
    code = data.astype(np.uint64)
    for k in range(1, order + 1):
        code[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return code


def count_grams(words: list[bytes], weights: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) for each order up to ``order``, of weighted words."""
    if not words:
        return [(np.zeros(0, np.uint64), np.zeros(0)) for _ in range(order + 1)]
    data, reach, _ = positions(words)
    weight = np.repeat(np.asarray(weights, np.float64), np.fromiter(map(len, words), np.int64, len(words)) + 1)
    out = []
    for k in range(order + 1):
        code, at = grams(data, k)[1:], reach[1:] >= k
        keys, inverse = np.unique(code[at], return_inverse=True)
        out.append((keys, np.bincount(inverse, weights=weight[at], minlength=len(keys))))
    return out


class ByteTrie:
    """Frozen context statistics; :meth:`bits` gives exact code lengths.

    ``levels``: (codes in order, counts over 0) for each number of context
    bytes; those that follow the levels of ``base``, if it is given.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], base: "ByteTrie | None" = None):
        self.levels = list(base.levels) if base is not None else []
        shorter = self.levels[-1][:2] if self.levels else None
        for k, (keys, counts) in enumerate(levels, len(self.levels)):
            context = keys >> np.uint64(8)
            start = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(counts, start) if len(keys) else np.zeros(0)
            kinds = np.diff(np.concatenate((start, [len(keys)]))).astype(np.float64) if len(keys) else np.zeros(0)
            excluded = np.zeros(len(start))
            if k and len(keys):
                at, _ = _find(shorter[0], keys & np.uint64((1 << (8 * k)) - 1))
                excluded = np.add.reduceat(shorter[1][at], start)
            self.levels.append((keys, counts, context[start], total, kinds, excluded))
            shorter = (keys, counts)

    @classmethod
    def of_words(cls, words: list[bytes], weights: np.ndarray, order: int) -> "ByteTrie":
        return cls(count_grams(words, weights, order))

    @property
    def top(self) -> int:
        return len(self.levels) - 1

    def cost(self, code: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram, of ``reach`` context bytes."""
        n = len(code)
        cost, less, kinds_less = np.zeros(n), np.zeros(n), np.zeros(n)
        open_ = np.arange(n)
        for k in range(self.top, -1, -1):
            keys, counts, contexts, total, kinds, excluded = self.levels[k]
            here = open_[reach[open_] >= k]
            wanted = code[here] & MASKS[k]
            at, known = _find(contexts, wanted >> np.uint64(8))
            here, at, wanted = here[known], at[known], wanted[known]
            room, escape = total[at] - less[here], kinds[at] - kinds_less[here]
            g, hit = _find(keys, wanted)
            cost[here[hit]] -= np.log2(counts[g[hit]] / (room[hit] + escape[hit]))
            miss = ~hit
            can = miss & (escape > 0)
            cost[here[can]] -= np.log2(escape[can] / (room[can] + escape[can]))
            less[here[miss]], kinds_less[here[miss]] = excluded[at[miss]], kinds[at[miss]]
            done = np.zeros(n, bool)
            done[here[hit]] = True
            open_ = open_[~done[open_]]
        cost[open_] += np.log2(np.maximum(256 - kinds_less[open_], 1))
        return cost

    def bits(self, words: list[bytes]) -> np.ndarray:
        """Code length in bits of each word with its closing byte."""
        out = [np.zeros(0)]
        for part in blocks(words):
            code, reach, at, first = distinct_grams(part, self.top)
            out.append(np.add.reduceat(self.cost(code, reach)[at], first))
        return np.concatenate(out)


def blocks(words: list[bytes], size: int = CHUNK):
    """Slices of the words of about ``size`` bytes each."""
    a = 0
    while a < len(words):
        b, n = a, 0
        while b < len(words) and n < size:
            n += len(words[b]) + 1
            b += 1
        yield words[a:b]
        a = b


def distinct_grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' distinct grams as (code, context bytes), which of them each
    coded byte has, and the index of each word's first coded byte.

    A gram with fewer than ``order`` context bytes starts with the closing
    byte in front of its word, which never stands inside one, so no two grams
    share a code.
    """
    data, reach, first = positions(words)
    reach = np.minimum(reach, order)[1:]
    code, which, at = np.unique(grams(data, order)[1:] & MASKS[reach], return_index=True, return_inverse=True)
    return code, reach[which], at, first - 1
