"""Token counts: batches balanced by bytes, long texts split at safe boundaries, lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.llm import tokens
from isoline.llm.words import LARGE_BATCH, WordIds, by_bytes, texts_of
from isoline.session import prepare


def count_tokens(docs: DataFrame, model: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, in one pass without a shuffle.

    Every text is split before each space that follows another sign: no piece of the vocabulary reaches over such a
    place, which is checked when the model is loaded (if one did, texts would be encoded whole). Distinct parts are
    encoded in batches and only their lengths are kept, so a text of any length costs no more memory than its parts.
    Null text counts as empty: 0 bytes, 0 tokens. Repeated ids each get a row; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        safe = tokens.load_pieces(model)[1]
        state: WordIds = tokens.worker_state(("lengths", model), lambda: Lengths(model))
        for b in by_bytes(batches, most=LARGE_BATCH):
            texts = texts_of(b)
            n = state.counts([tokens.split_pieces(t, safe) for t in texts])
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class Lengths(WordIds):
    """A bounded table of distinct parts and their number of tokens."""

    def __init__(self, model: str) -> None:
        self.model = model
        super().__init__(self.lengths)

    def lengths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = tokens.load_pieces(self.model)[0].encode([w.removeprefix("\0") for w in words], num_threads=1)
        return np.zeros(0, np.uint32), np.fromiter(map(len, found), np.int64, len(words))
