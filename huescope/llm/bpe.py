"""Byte-level byte-pair encoding read from a public tokenizer file."""

from __future__ import annotations

import heapq
import json

import regex

#: The split pattern of byte-level BPE as the public library applies it.
#: (White_Space is written out because Python's \s also takes U+001C to U+001F.)
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: A space that does not stand alone in front of a visible character.
_ODD_SPACE = regex.compile(r" (?=\s|$)")
CACHE, LONGEST = 200_000, 48  # entries of a cache's generation, and its keys' length in characters


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Vocabulary:
    """Merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        back = {c: b for b, c in letters.items()}
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normalizer are read")
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[bytes(back[c] for c in left), bytes(back[c] for c in right)] = rank
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None


def merged_count(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left of ``piece`` after byte-pair merging: its bytes minus the
    merges made.  The pairs wait in a heap by rank and place; the symbols
    form a linked list, so a merge costs O(log n)."""
    n = len(piece)
    if n < 2:
        return n
    symbol = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbol[i], symbol[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbol[i], symbol[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != left or j >= n or symbol[j] != right:
            continue  # one of the two has been merged meanwhile
        symbol[i], symbol[j] = left + right, b""
        k = after[i] = after[j]
        merges += 1
        if k < n:
            before[k] = i
            rank = ranks.get((symbol[i], symbol[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, symbol[i], symbol[k]))
        h = before[i]
        if h >= 0:
            rank = ranks.get((symbol[h], symbol[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, symbol[h], symbol[i]))
    return n - merges


def segments(text: str, vocabulary: Vocabulary) -> list[tuple[str, int | None]]:
    """(text, None) runs and (special string, id), in order."""
    if vocabulary.special_split is None or not any(s in text for s in vocabulary.special):
        return [(text, None)] if text else []
    return [(x, vocabulary.special.get(x)) for x in vocabulary.special_split.split(text) if x]


def chunks(text: str) -> list[str] | None:
    """The text cut before each lone space, where no token can reach across.

    None where white space stands in runs; then the cuts are not safe.
    """
    if _ODD_SPACE.search(text):
        return None
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


class Cache(dict):
    """Results by short key, in two generations whose bytes are bounded.

    Keys over ``longest`` characters are worked out anew each time, so a key
    and its result take ``longest`` times some small factor at most, and
    both generations together about ``2 * size`` entries of that.
    """

    def __init__(self, make, size: int = CACHE, longest: int = LONGEST):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
