"""BPE encoding and decoding through a table of distinct words.

Documents are dealt into blocks of bounded size. The table of distinct words is dealt over buckets by a hash of the
word: the words of every block meet in the task of their bucket, which holds its part of the table and encodes each
distinct word of the corpus there, once; its ids return to the blocks that hold it, where they are joined back by
position. Decoding joins the ids with the id-to-piece table of the vocabulary (an Arrow take on the id).
Words and ids travel packed, one row per block and word bucket; no row per word occurrence is ever made. A frequent
word is one entry per block, read as a stream, so no word is hot.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.llm import tokens
from isoline.llm.words import WordIds, by_bytes, spread, texts_of
from isoline.session import prepare

BLOCK_BYTES = 12 << 20
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FULL = "doc_id long, ids array<int>, decoded string"
_CODE = ("utf-8", "surrogatepass")
_BETWEEN = "\udfff"  # a lone surrogate, which no text holds


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows of about `most` bytes of text, each with the number of its partition and its own within it."""
    held, size, n = [], 0, 0
    for b in by_bytes(batches):
        part = b.column("part")[0].as_py()
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield part << 32 | n, held
            held, size, n = [], 0, n + 1
    if held:
        yield part << 32 | n, held


def _pack(words: list[str]) -> bytes:
    return zstandard.compress(_BETWEEN.join(words).encode(*_CODE), 3)


def _unpack(data: bytes) -> list[str]:
    return zstandard.decompress(data).decode(*_CODE).split(_BETWEEN)


class _Known:
    """Ids of a block's words as they came back; a word without ids is encoded on the spot."""

    def __init__(self, tokenizer: str, table: pa.Table) -> None:
        self.tokenizer = tokenizer
        self.at: dict[str, int] = {}
        for data in table.column("words").to_pylist():
            for w in _unpack(data):
                self.at[w] = len(self.at)
        self.lens = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(zstandard.decompress(x), "<u4") for x in table.column("lens").to_pylist())]).astype(np.int64)
        self.ids = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(zstandard.decompress(x), "<u4") for x in table.column("ids").to_pylist())])
        self.start = np.cumsum(self.lens) - self.lens

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        try:
            k = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            return tokens.encode_flat(self.tokenizer, words)
        return self.ids[spread(self.start[k], self.lens[k])], self.lens[k]


def _decoded(pieces: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The pieces of the ids one after the other, and where each begins (and the last one ends)."""
    if not len(ids):
        return memoryview(b""), np.zeros(1, np.int64)
    _, places, text = pieces.take(pa.array(ids)).buffers()
    return memoryview(text), np.frombuffer(places, np.int64)


def encode_decode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", full: bool = False, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """One row per document: ids and decoded text (full) or their digests.

    Null text counts as empty: no ids, empty decoded text. Rows that share an id each get a row. Words are cut where
    the tokenizer itself always cuts; special strings inside texts become their special id, as the library does by
    default. A block whose rows were dealt anew after a lost executor encodes the words it misses itself. buckets is
    the number of parts of the word table, each held in one task (the shuffle partitions if not given). Other columns
    are ignored.
    """
    spark = prepare(docs.sparkSession)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, block_bytes):
            words: set[str] = set()
            for b in held:
                for t in texts_of(b):
                    words.update(tokens.split_keeping_space(t))
            cut = [(w, n) for w in words if (n := tokens.tail_at(w))]
            words.difference_update(w for w, _ in cut)
            words.update(w[:n] for w, n in cut)
            words.update(w[n:] for w, n in cut)
            dealt: list[list[str]] = [[] for _ in range(buckets)]
            for w in sorted(words):
                dealt[zlib.crc32(w.encode(*_CODE)) % buckets].append(w)
            full_ = [k for k in range(buckets) if dealt[k]]
            for k in range(0, len(full_), 64):
                part = full_[k : k + 64]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(part), pa.int64()), "bucket": pa.array(part, pa.int32()), "words": pa.array([_pack(dealt[x]) for x in part], pa.binary())})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordIds(lambda w: tokens.encode_flat(tokenizer, w), max_words=1 << 62)  # its bucket bounds it
        for b in batches:
            for k in range(b.num_rows):
                words = _unpack(b.column("words")[k].as_py())
                ids, _ = table.batch([words])
                lens = table.len[[table.codes[w] for w in words]]
                yield pa.RecordBatch.from_pydict({"block": b.column("block").slice(k, 1), "words": b.column("words").slice(k, 1), "lens": pa.array([zstandard.compress(lens.astype("<u4").tobytes(), 3)]), "ids": pa.array([zstandard.compress(ids.astype("<u4").tobytes(), 3)])})

    def texts_by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _blocks(batches, block_bytes):
            for b in held:  # about 1 MB of text, packed as one
                texts = [t.encode(*_CODE) for t in texts_of(b)]
                packed = zstandard.compress(b"".join(texts), 3)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "doc_ids": pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "packed": pa.array([packed], pa.binary())})

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = tokens.pieces(tokenizer)
        table = WordIds(_Known(tokenizer, right).encode, tokens.tail_at, max_words=1 << 62)  # a block bounds it
        keys: list[int | None] = []
        rows: list[list] = [[], [], []]
        for ids_, sizes, packed in zip(*(left.column(c).to_pylist() for c in ("doc_ids", "sizes", "packed")), strict=True):
            data, at = zstandard.decompress(packed), 0
            docs_ = []
            for n in sizes:
                docs_.append(tokens.split_keeping_space(data[at : at + n].decode(*_CODE)))
                at += n
            flat, counts = table.batch(docs_)
            keys += ids_
            text, places = _decoded(pieces, flat)
            end = 0
            for n in counts.tolist():
                own, decoded = flat[end : end + n], bytes(text[places[end] : places[end + n]])
                end += n
                if full:
                    rows[0].append(own.astype(np.int32))
                    rows[1].append(decoded.decode("utf-8", "replace"))
                else:
                    rows[0].append(n)
                    rows[1].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    rows[2].append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
        if full:
            return pa.table({"doc_id": pa.array(keys, pa.int64()), "ids": pa.array(rows[0], pa.list_(pa.int32())), "decoded": pa.array(rows[1], pa.string())})
        return pa.table({"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array(rows[0], pa.int64()), "ids_sha256": pa.array(rows[1], pa.string()), "decoded_sha256": pa.array(rows[2], pa.string())})

    coded = narrow.mapInArrow(words_of, "block long, bucket int, words binary").repartition(buckets, "bucket").mapInArrow(encode, "block long, words binary, lens binary, ids binary")
    texts = narrow.mapInArrow(texts_by_block, "block long, doc_ids array<long>, sizes array<long>, packed binary")
    return texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(join_back, FULL if full else RESULT)
