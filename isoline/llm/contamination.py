"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of shingles; a partition with upper bound u is searched for in windows of 2u
shingles that start every u shingles, so an item of the partition is at least a fair share of some window however
long the document is. An item and a window are a candidate pair if they share the minimum of any of HASHES hash
functions. A document with 0.8 n of an item's n >= FEW shingles, wherever they stand, has HASHES * 0.8 n / 2u >= 12.8
expected hits, so it is missed with a probability below 3e-6. Items of fewer than FEW shingles are looked up by all
their shingles and never missed. Items of fewer words than a shingle are looked up as a whole: their one shingle is the
sequence of all their words. Candidates are then decided on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.llm.words import Words, by_bytes, normal, texts_of
from isoline.session import cut, prepare

SHINGLE = 5
SIMILARITY = 0.8
HASHES = 64
#: Most items that are searched for in one pass; more items take more passes over the documents.
BLOCK_ITEMS = 20_000
BASE = 16
#: Items of fewer shingles are a small share of the smallest windows, so they are looked up by every shingle.
FEW = 8
PAIRS = "doc_id long, item_id long, containment double, n_shared int, n_item_shingles int"


def _hash_functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_611)
    return rng.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _bound(n: int) -> int:
    """Upper bound of the partition of items with n shingles."""
    return max(BASE, 1 << (n - 1).bit_length())


def shingle_set(words: list[bytes], k: int = SHINGLE) -> set[bytes]:
    """Distinct runs of k words."""
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


class ItemIndex:
    """MinHash index of a block of items, by size partition."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        mult, add = _hash_functions()
        self.sets: list[set[bytes]] = []
        self.ids: list[int] = []
        self.run: list[int] = []  # words of a shingle of each item
        keys: dict[int, list[list[tuple[int, int]]]] = {}
        small: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = normal(text).split()
            if not words:
                continue
            run = min(SHINGLE, len(words))
            found = shingle_set(words, run)
            h = _narrow(np.unique(Words([text]).shingles(run)[0]))
            if len(found) < FEW:
                small.setdefault(run, []).extend((int(x), len(self.ids)) for x in h)
            else:
                least = (h[None, :] * mult[:, None] + add[:, None]).min(1)
                at = keys.setdefault(_bound(len(found)), [[] for _ in range(HASHES)])
                for k in range(HASHES):
                    at[k].append((int(least[k]), len(self.ids)))
            self.ids.append(item_id)
            self.sets.append(found)
            self.run.append(run)
        self.parts = {u: [(np.array(sorted(p)).reshape(-1, 2)[:, 0].astype(np.uint32), np.array(sorted(p)).reshape(-1, 2)[:, 1]) for p in by] for u, by in keys.items()}
        # a first look that few windows pass; 64 KB per hash function and partition at most
        self.width = min(16, max(10, (128 * len(self.ids)).bit_length()))
        self.bits = {u: [_bitmap(p[0], self.width) for p in by] for u, by in self.parts.items()}
        self.small = []
        for run, pairs in sorted(small.items()):
            pairs.sort()
            h = np.array([x for x, _ in pairs], np.uint32)
            self.small.append((run, h, [i for _, i in pairs], _bitmap(h, 20)))

    def candidates(self, words: Words) -> set[tuple[int, int]]:
        """(document, item) pairs that share a minimum, or a shingle of a small item."""
        found: set[tuple[int, int]] = set()
        for run, keys, items, bits in self.small:
            found |= _lookup(words, run, keys, items, bits)
        h, first, count = words.shingles(SHINGLE) if self.parts else (None, None, np.zeros(0))
        has = np.flatnonzero(count)
        if not len(has):
            return found
        # every document's shingles are padded to whole base blocks by repeating its last shingle
        blocks = -(-count[has] // BASE)
        start = np.cumsum(blocks) - blocks
        pos = np.arange(int(blocks.sum()) * BASE) - np.repeat(start * BASE, blocks * BASE)
        at = np.repeat(first[has], blocks * BASE) + np.minimum(pos, np.repeat(count[has] - 1, blocks * BASE))
        grid = np.ascontiguousarray(_narrow(h)[at].reshape(-1, BASE).T)
        owner = np.repeat(has, blocks)
        mult, add = _hash_functions()
        for k in range(HASHES):
            least = np.minimum.reduce(grid * mult[k] + add[k], axis=0)
            own, width = owner, 1
            for u in sorted(self.parts):
                while width < u // BASE:  # minima of u shingles from those of u / 2
                    least, own = _halve(least, own)
                    width *= 2
                pair = np.where(own[:-1] == own[1:], np.minimum(least[:-1], least[1:]), least[:-1])
                window = np.append(pair, least[-1:])
                keys, items = self.parts[u][k]
                hits = np.flatnonzero(self.bits[u][k][window >> np.uint32(32 - self.width)])
                hits = hits[keys[np.minimum(np.searchsorted(keys, window[hits]), len(keys) - 1)] == window[hits]]
                for i in hits.tolist():
                    lo, hi = (np.searchsorted(keys, window[i], side=side) for side in ("left", "right"))
                    found.update((int(own[i]), int(j)) for j in items[lo:hi])
        return found

    def shared(self, item: int, words: list[bytes], sets: dict[int, set[bytes]]) -> int:
        """How many of an item's shingles a document's words hold; sets keeps the document's shingles by length."""
        run = self.run[item]
        if run not in sets:
            sets[run] = shingle_set(words, run)
        return len(self.sets[item] & sets[run])


def _lookup(words: Words, run: int, keys: np.ndarray, items: list[int], bits: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) pairs that share a shingle of `run` words, of items with few of them."""
    h, first, count = words.shingles(run)
    h, found = _narrow(h), set()
    hits = np.flatnonzero(bits[h >> np.uint32(12)])
    hits = hits[keys[np.minimum(np.searchsorted(keys, h[hits]), len(keys) - 1)] == h[hits]]
    owner = np.searchsorted(first + count, hits, side="right")
    lo, hi = (np.searchsorted(keys, h[hits], side=side) for side in ("left", "right"))
    for d, a, b in zip(owner.tolist(), lo.tolist(), hi.tolist(), strict=True):
        found.update((d, i) for i in items[a:b])
    return found


def _halve(least: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join each document's blocks two by two."""
    edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    rank = np.arange(len(own)) - np.repeat(edge, np.diff(np.append(edge, len(own))))
    heads = np.flatnonzero(rank % 2 == 0)
    return np.minimum.reduceat(least, heads), own[heads]


def _narrow(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def _bitmap(keys: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(1 << width, bool)
    bits[keys >> np.uint32(32 - width)] = True
    return bits


def _blocks(items: DataFrame, item_col: str, block_items: int) -> Iterator[tuple[ItemIndex, bool]]:
    """The index of one block of items after the other, and whether more than one is needed."""
    known = items.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    blocks = max(1, -(-known.count() // block_items))
    for k in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else known
        yield ItemIndex([(r.item_id, r.text) for r in part.toLocalIterator()]), blocks > 1


def find_items(docs: DataFrame, items: DataFrame, *, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(document, item) pairs in which the document holds at least `similarity` of the item's distinct shingles.

    Items are taken in blocks of about block_items by the hash of their id; each block is a bounded index that travels
    with the tasks, one block at a time, and documents are read once per block, whole and without a shuffle. An item
    of fewer words than a shingle must be held whole. Null or empty items and documents match nothing; a null id stays
    null. Equal pairs of repeated rows are repeated; other columns are ignored.
    """
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index, several in _blocks(items, item_col, block_items):
        found = narrow.mapInArrow(_search(index, similarity), PAIRS)
        found = cut(found, "leaks") if several else found  # the driver holds one index at a time
        out = found if out is None else out.unionByName(found)
    return out


def _search(index: ItemIndex, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            words = Words(texts_of(b))
            keys = b.column("doc_id").to_pylist()
            rows: list[list] = [[], [], [], [], []]
            last, split, sets = -1, [], {}
            for d, i in sorted(index.candidates(words)):
                if d != last:
                    last, split, sets = d, words.docs[d].split(), {}
                n, want = index.shared(i, split, sets), len(index.sets[i])
                if n >= similarity * want - 1e-9:
                    for col, v in zip(rows, (keys[d], index.ids[i], n / want, n, want), strict=True):
                        col.append(v)
            if rows[0]:
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(rows[0], pa.int64()), "item_id": pa.array(rows[1], pa.int64()), "containment": pa.array(rows[2], pa.float64()), "n_shared": pa.array(rows[3], pa.int32()), "n_item_shingles": pa.array(rows[4], pa.int32())})

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, *, similarity: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; one pass per block of items, no shuffle.

    Every row is judged by its own text, as by find_items: repeated and null ids play no part, null and empty texts
    stay.
    """
    prepare(docs.sparkSession)
    out = docs
    for index, several in _blocks(items, item_col, block_items):
        out = out.mapInArrow(_keep(index, similarity, text_col), docs.schema)
        out = cut(out, "clean") if several else out
    return out


def _keep(index: ItemIndex, similarity: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text_col):
            words = Words(texts_of(b, text_col))
            bad: set[int] = set()
            last, split, sets = -1, [], {}
            for d, i in sorted(index.candidates(words)):
                if d in bad:
                    continue
                if d != last:
                    last, split, sets = d, words.docs[d].split(), {}
                if index.shared(i, split, sets) >= similarity * len(index.sets[i]) - 1e-9:
                    bad.add(d)
            yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

    return run
