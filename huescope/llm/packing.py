"""Harmonic packing of token sequences.

A document of n tokens, n at most the capacity, belongs to the class
k = capacity // n, whose sequences take k documents each: the lengths between
two reciprocals of the capacity.  Each worker fills the sequences of each
class by itself, in the order in which the documents come, so nothing is
searched and nothing shuffled.  Documents over the capacity have to be cut
anyway; they fill whole sequences and the gaps that the classes leave.  A
document that fits is cut only where no longer one is at hand, for the last
sequences of a worker.  Each worker pads little more than its last sequence.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT, Vocabulary, segments
from .common import bounded_batches, held

#: Fixed value: the split pattern as the merge library compiles it.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_SPACE = regex.compile(r"\s{2000}")
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: Vocabulary):
        by_rank = [vocabulary.ids[a + b] for a, b in sorted(vocabulary.ranks, key=vocabulary.ranks.get)]
        if by_rank != sorted(by_rank):
            raise ValueError("the ids of this vocabulary do not follow its merge ranks")
        self.vocabulary = vocabulary
        self.encoding = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=vocabulary.ids, special_tokens={})
        self.split = regex.compile(SPLIT)

    def __call__(self, text: str) -> bytes:
        out = []
        for part, special in segments(text, self.vocabulary):
            if special is not None:
                ids = [special]
            elif _LONG_SPACE.search(part):  # the library's own splitting overflows its stack on these
                ids = [i for piece in self.split.findall(part) for i in self.encoding._encode_single_piece(piece)]
            else:
                ids = self.encoding.encode_ordinary(part)
            out.append(np.array(ids, "<u4").tobytes())
        return b"".join(out)


class Piece:
    """Token ids [start, end) of one document."""

    __slots__ = ("doc_id", "ids", "total", "start", "end")

    def __init__(self, doc_id, ids: memoryview, total: int, start: int, end: int):
        self.doc_id, self.ids, self.total, self.start, self.end = doc_id, ids, total, start, end

    def __len__(self) -> int:
        return self.end - self.start

    def cut(self, n: int) -> "Piece":
        """Take the first n ids away, as a piece of their own."""
        first = Piece(self.doc_id, self.ids, self.total, self.start, self.start + n)
        self.start += n
        return first


class Packer:
    """One worker's sequences.

    Holds fewer than k documents for each class k, at most ``spare`` tokens
    (and one document) to fill gaps with, and at most ``waiting`` sequences
    whose gap could not be filled yet.
    """

    def __init__(self, capacity: int, first_sequence: int, spare: int = 1 << 16, waiting: int = 256):
        self.capacity, self.next, self.most_spare, self.most_waiting = capacity, first_sequence, spare, waiting
        self.classes: dict[int, list[Piece]] = {}
        self.spare: deque[Piece] = deque()
        self.spare_tokens = 0
        self.waiting: deque[list[Piece]] = deque()
        self.out: list[tuple] = []

    def _close(self, pieces: list[Piece], last: bool = False) -> None:
        """A sequence of these pieces and of what fills its gap; it waits if
        nothing can, unless it is the ``last``."""
        used = sum(map(len, pieces))
        while used < self.capacity and self.spare:
            front = self.spare[0]
            n = min(len(front), self.capacity - used)
            if n == len(front):
                self.spare.popleft()
            self.spare_tokens -= n
            used += n
            pieces.append(front.cut(n))
        if used < self.capacity and not last:
            self.waiting.append(pieces)
            return
        offset = 0
        for p in pieces:
            self.out.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids[4 * p.start : 4 * p.end]), p.total, self.next, offset))
            offset += len(p)
        self.next += 1

    def _lend(self, piece: Piece) -> None:
        """A document to be cut: for the sequences that wait, then spare."""
        self.spare.append(piece)
        self.spare_tokens += len(piece)
        while self.waiting and self.spare:
            self._close(self.waiting.popleft())
        while self.spare_tokens > max(self.most_spare, self.capacity):
            self._close([])  # a whole sequence of one or more long documents

    def _lend_emptiest(self) -> None:
        """Of the sequences that wait, the one with the largest gap gives its
        documents to the others."""
        at = min(range(len(self.waiting)), key=lambda i: sum(map(len, self.waiting[i])))
        pieces = self.waiting[at]
        del self.waiting[at]
        for p in pieces:
            self._lend(p)

    def add(self, doc_id, ids: bytes) -> None:
        """Place a document's ids (little-endian unsigned 32-bit)."""
        n = len(ids) // 4
        piece = Piece(doc_id, memoryview(ids), n, 0, n)
        if n > self.capacity:
            self._lend(piece)
            return
        k = self.capacity // n
        mine = self.classes.setdefault(k, [])
        mine.append(piece)
        if len(mine) == k:
            del self.classes[k]
            self._close(mine)
            if len(self.waiting) > self.most_waiting:
                self._lend_emptiest()

    def finish(self) -> None:
        """The classes' unfinished sequences: longest documents first, each
        into the first sequence with room for it.  Then gaps are filled, by
        the emptiest sequences' documents where no spare ones are left, until
        one sequence stays unfilled."""
        left = sorted((p for x in self.classes.values() for p in x), key=len, reverse=True)
        self.classes = {}
        bins: list[list[Piece]] = []
        room: list[int] = []
        for p in left:
            at = next((i for i, r in enumerate(room) if r >= len(p)), len(bins))
            if at == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[at].append(p)
            room[at] -= len(p)
        for pieces in bins:
            self._close(pieces)
        while len(self.waiting) > 1:
            self._lend_emptiest()
        while self.spare or self.waiting:
            self._close(self.waiting.popleft() if self.waiting else [], last=True)


def pack(docs: DataFrame, vocabulary_path: str, *, capacity: int = 1_024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its token ids and ``end_id``; a null or empty text is just
    ``end_id``.  Repeated rows are packed as often as they stand, rows with a
    null id, too.  Every id lies in exactly one piece, and a sequence's pieces
    follow each other without a gap.  Sequence ids differ between workers
    (the input partition is in their upper bits) and are not consecutive.
    Each worker packs its own partition in one pass; a partition that is
    worked out again after a loss gives the same rows.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = held("encoder", vocabulary_path, lambda: Encoder(vocabulary.value))
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)

        def done():
            rows, packer.out = packer.out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_OUT), _OUT)], schema=_OUT)

        for batch in batches:
            for doc_id, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                packer.add(doc_id, encode(text or "") + end)
            yield done()
        packer.finish()
        yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
