"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at special strings, then where no token can reach across, then
by the byte-level split pattern.  The count of a piece is its bytes minus the
merges (:func:`.bpe.merged_count`); no identifiers are made.  Pieces repeat,
so their counts are kept in bounded caches.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SPLIT, Cache, Vocabulary, chunks, merged_count, segments
from .common import bounded_batches, held

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class TokenCounter:
    """Counts the tokens of texts with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        ranks, split = vocabulary.ranks, regex.compile(SPLIT)
        self.vocabulary = vocabulary
        self.pieces = Cache(lambda piece: merged_count(piece.encode(), ranks))
        self.split = split
        self.chunk = Cache(self._count)

    def _count(self, text: str) -> int:
        return sum(map(self.pieces.__getitem__, self.split.findall(text)))

    def __call__(self, text: str) -> int:
        n = 0
        for part, special in segments(text, self.vocabulary):
            cut = None if special is not None else chunks(part)
            n += 1 if special is not None else self._count(part) if cut is None else sum(map(self.chunk.__getitem__, cut))
        return n


def count_tokens(docs: DataFrame, vocabulary_path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit``) for each row.

    Null counts as the empty text: no bytes, no tokens.  Special strings in a
    text count one token each, as the public library reads them by default.
    The vocabulary file is read on the driver and broadcast; it is a few MB,
    whatever the table's size.
    """
    bounded_batches(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches):
        count = held("token counter", vocabulary_path, lambda: TokenCounter(vocabulary.value))
        for batch in batches:
            texts = [x or "" for x in batch.column("t").to_pylist()]
            n = [count(x) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("b"), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], schema=_OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("b"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
