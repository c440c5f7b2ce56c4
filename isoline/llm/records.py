"""Token-id output: length-delimited binary records with masked checksums and a separate offset index.

A data file is a run of records: length (u64, little-endian), masked CRC-32C of those 8 bytes (u32), payload, masked
CRC-32C of the payload (u32). A payload is one document: doc_id (i64, the least i64 for null), width of an id in
bytes (u32: 2 where the vocabulary fits 16 bits, else 4), then the ids, little-endian. Beside each data file lies an
index: the byte offset of every record as u64, so that a reader can fetch records in any order.

Documents are dealt to files by ranges of doc_id and sorted, so files in order hold all documents in ascending
doc_id order. Every attempt of a task writes files of its own name and only the attempt that Spark commits is listed
in the manifest, so lost executors and repeated tasks leave no wrong records.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoline.llm import tokens
from isoline.llm.words import LARGE_BATCH, WordIds, by_bytes, texts_of
from isoline.session import cut, prepare, shared_path

#: Fixed values of the record format: reversed Castagnoli polynomial, mask of the checksums, null doc_id.
_POLY = 0x82F63B78
_MASK = 0xA282EAD8
_NULL_ID = -(1 << 63)
_PIECE = 1024
READ_BYTES = 8 << 20
MANIFEST = "part int, path string, first_doc long, n_docs long, n_tokens long, n_bytes long"


def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    t = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLY), t >> 1).astype(np.uint32)
    shift = [_byte_zeros()]
    for _ in range(40):
        m = shift[-1]
        shift.append(_apply(m, m))
    return t, shift


def _byte_zeros() -> np.ndarray:
    """The 32 columns of the map that appends one zero byte."""
    c = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLY), c >> 1).astype(np.uint32)
    return c


def _apply(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for bit in range(32):
        out ^= np.where((v >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


_CRC: list = []


def crc32c(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32C of many byte ranges of one buffer at once.

    Ranges are cut into pieces of fixed size from their end; all pieces advance together, two bytes a step, and the
    pieces of a range are then joined by appending zeros, which is linear.
    """
    if not _CRC:
        _CRC.extend(_tables())
    table, shift = _CRC
    n_pieces = (length + _PIECE - 1) // _PIECE
    crc = np.zeros(len(start), np.uint32)
    most = int(n_pieces.max(initial=0))
    rows = np.repeat(np.arange(len(start)), n_pieces)
    rank = np.arange(len(rows)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)  # 0 is a range's last piece
    end = (start + length)[rows] - rank * _PIECE
    lo = np.maximum(end - _PIECE, start[rows])
    raw = np.zeros(len(rows), np.uint32)
    for k in range(0, len(rows), 4096):
        grid = np.zeros((min(4096, len(rows) - k), _PIECE), np.uint8)
        for g, (a, b) in zip(grid, zip(lo[k : k + 4096].tolist(), end[k : k + 4096].tolist(), strict=True), strict=True):
            g[_PIECE - (b - a) :] = data[a:b]
        words = np.ascontiguousarray(grid.view("<u2").T).astype(np.uint32)
        state = np.zeros(grid.shape[0], np.uint32)
        for w in words:
            state ^= w
            state = table[state & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))
        raw[k : k + 4096] = state
    first = np.cumsum(n_pieces) - n_pieces
    step = shift[_PIECE.bit_length() - 1]
    for r in range(most - 1, -1, -1):
        has = np.flatnonzero(n_pieces > r)
        crc[has] = _apply(step, crc[has]) ^ raw[first[has] + r]
    seed = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for bit in range(int(length.max(initial=0)).bit_length()):
        has = np.flatnonzero((length >> bit) & 1)
        seed[has] = _apply(shift[bit], seed[has])
    return crc ^ seed ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The stored form of a checksum: rotated right by 15 bits plus a constant."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """(records one after the other, size of each record)."""
    lens = np.array([len(p) for p in payloads], np.int64)
    head = np.frombuffer(lens.astype("<u8").tobytes(), np.uint8)
    body = np.frombuffer(b"".join(payloads), np.uint8)
    at = np.arange(len(payloads), dtype=np.int64)
    c1 = masked(crc32c(head, at * 8, np.full(len(payloads), 8, np.int64))).astype("<u4")
    c2 = masked(crc32c(body, np.cumsum(lens) - lens, lens)).astype("<u4")
    out = []
    for p, n, a, b in zip(payloads, lens.tolist(), c1.tolist(), c2.tolist(), strict=True):
        out.append(struct.pack("<QI", n, a) + p + struct.pack("<I", b))
    return b"".join(out), lens + 16


def unframe(data: bytes) -> tuple[list[bytes], int]:
    """(payloads of the whole records at the start of data, bytes used). Raises where a checksum does not hold."""
    found, at = [], 0
    while at + 12 <= len(data):
        n, _ = struct.unpack_from("<QI", data, at)
        if at + 16 + n > len(data):
            break
        found.append((at, n))
        at += 16 + n
    if not found:
        return [], 0
    buf = np.frombuffer(data, np.uint8)
    start = np.array([a for a, _ in found], np.int64)
    lens = np.array([n for _, n in found], np.int64)
    for lo, size in ((start, np.full(len(start), 8, np.int64)), (start + 12, lens)):
        stored = np.array([struct.unpack_from("<I", data, a)[0] for a in (lo + size).tolist()], np.uint32)
        if (masked(crc32c(buf, lo, size)) != stored).any():
            raise ValueError("a record's checksum does not hold")
    return [data[a + 12 : a + 12 + n] for a, n in found], at


def write_records(docs: DataFrame, tokenizer: str, out: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Encode whole texts and write them as records in ascending order of id_col; returns the manifest.

    Null text counts as empty, so its record holds end_id alone. A null id sorts first. Rows that share an id keep a
    record each, side by side, in no set order. Other columns are ignored. An empty table gives no file.
    """
    spark = prepare(docs.sparkSession)
    out = out or shared_path(spark, "records")
    base = fs.FileSystem.from_uri(out)
    base[0].create_dir(base[1], recursive=True)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        where, folder = fs.FileSystem.from_uri(out)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        state: WordIds = tokens.worker_state(("ids", tokenizer), lambda: WordIds(lambda w: tokens.encode_flat(tokenizer, w), tokens.tail_at, max_words=1_000_000))
        wide = tokens.load(tokenizer).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        n_docs = n_tokens = at = 0
        first, sizes, data = None, [], None
        for b in by_bytes(batches, most=LARGE_BATCH):
            if data is None:
                data = where.open_output_stream(f"{folder}/{name}.rec", compression=None)
            ids, counts = state.batch([tokens.split_dropping_space(t) for t in texts_of(b)])
            ends = np.cumsum(counts)
            keys = b.column("doc_id").to_pylist()
            first = keys[0] if first is None else first
            ids = ids.astype("<u4" if wide else "<u2")
            tail = np.array([end_id], ids.dtype).tobytes()
            payloads = []
            for k, lo, hi in zip(keys, (ends - counts).tolist(), ends.tolist(), strict=True):
                payloads.append(struct.pack("<qI", _NULL_ID if k is None else k, ids.dtype.itemsize) + ids[lo:hi].tobytes() + tail)
            blob, size = frame(payloads)
            data.write(blob)
            sizes.append(size)
            n_docs, n_tokens, at = n_docs + len(keys), n_tokens + len(ids) + len(keys), at + len(blob)
        if data is None:
            return
        data.close()
        offsets = np.cumsum(np.concatenate(([0], *sizes)))[:-1].astype("<u8")
        with where.open_output_stream(f"{folder}/{name}.idx", compression=None) as index:
            index.write(offsets.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{out}/{name}.rec"], "first_doc": pa.array([first], pa.int64()), "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [at]})

    return cut(narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(write, MANIFEST), "manifest")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Read all files of a manifest back: doc_id, start, n_tokens, ids_crc32 of every record.

    Checksums are verified, and the offset index of every file against the places where its records begin.
    """
    prepare(spark)
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    files = manifest.withColumn("start", before)  # one row per file, never per document

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                where, name = fs.FileSystem.from_uri(path)
                sizes: list[int] = []
                with where.open_input_stream(name, compression=None) as data:
                    rest, more = b"", READ_BYTES
                    while part := data.read(more):
                        found, used = unframe(rest + part)
                        rest = (rest + part)[used:]
                        more = max(READ_BYTES, len(rest))
                        rows = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
                        sizes += [len(p) + 16 for p in found]
                        for p in found:
                            key, width = struct.unpack_from("<qI", p)
                            ids = np.frombuffer(p, "<u2" if width == 2 else "<u4", offset=12)
                            rows["doc_id"].append(None if key == _NULL_ID else key)
                            rows["start"].append(start)
                            rows["n_tokens"].append(len(ids))
                            rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                            start += len(ids)
                        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})
                    if rest:
                        raise ValueError(f"{path} ends within a record")
                if not np.array_equal(_index(where, name), np.cumsum([0, *sizes])[:-1]):
                    raise ValueError(f"the index of {path} does not hold")

    return files.select("path", "start").repartition(max(1, manifest.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _index(where: fs.FileSystem, name: str) -> np.ndarray:
    """Where the records of a file begin."""
    with where.open_input_stream(name.removesuffix(".rec") + ".idx", compression=None) as index:
        return np.frombuffer(index.read(), "<u8")


def read_at(path: str, picks: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one file by their number, in any order, through the offset index."""
    where, name = fs.FileSystem.from_uri(path)
    offsets, out = _index(where, name), []
    with where.open_input_file(name) as data:
        for k in picks:
            data.seek(int(offsets[k]))
            head = data.read(12)
            (payload,), _ = unframe(head + data.read(struct.unpack_from("<Q", head)[0] + 4))
            key, width = struct.unpack_from("<qI", payload)
            out.append((None if key == _NULL_ID else key, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=12).astype(np.uint32)))
    return out
