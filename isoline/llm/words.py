"""Word-level building blocks that the tokenizer and text operators share; they run in Arrow workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 1 << 20
#: For operators that hold little beside the text and work on many words of a batch at once.
LARGE_BATCH = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice Arrow batches into pieces of about `most` bytes of text; a longer text is a piece of its own."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0)).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(lo, hi - lo)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """Whole texts as Python strings; null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


class WordCodes(dict):
    """Gives each distinct word a small number; new words wait in `fresh` until they are resolved."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class WordIds:
    """A bounded table of distinct words and their ids, kept in an Arrow worker between tasks.

    encode turns a list of distinct words into (ids one after the other, number of ids of each). cut says where
    the end of a word is a word of its own (0: nowhere). The table starts anew beyond max_words, which bounds memory and changes no
    result: a word is then encoded once more.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut: Callable[[str], int] = lambda w: 0, max_words: int = 700_000) -> None:
        self.encode, self.cut, self.max_words = encode, cut, max_words
        self.reset()

    def reset(self) -> None:
        self.codes = WordCodes()
        self.at = np.zeros(1 << 16, np.int64)
        self.len = np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _put(self, codes: np.ndarray, flat: np.ndarray, lens: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.at[codes] = self.used + np.cumsum(lens) - lens
        self.len[codes] = lens
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def resolve(self) -> None:
        """Give ids to the words that came up since the last call."""
        table = self.codes
        whole, joined = [], []
        for w in table.fresh:  # grows while it is read: a first part may be new as well
            if n := self.cut(w):
                joined.append((table[w], table[w[:n]], table[w[n:]]))
            else:
                whole.append(w)
        table.fresh = []
        while len(table) > len(self.at):
            self.at, self.len = np.append(self.at, np.zeros_like(self.at)), np.append(self.len, np.zeros_like(self.len))
        for k in range(0, len(whole), 20_000):
            part = whole[k : k + 20_000]
            self._put(np.fromiter(map(table.__getitem__, part), np.int64, len(part)), *self.encode(part))
        if joined:
            j = np.array(joined, np.int64)
            pair = j[:, 1:].ravel()
            self._put(j[:, 0], self.ids[spread(self.at[pair], self.len[pair])], self.len[j[:, 1]] + self.len[j[:, 2]])

    def batch(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents one after the other, number of ids per document)."""
        if len(self.codes) > self.max_words:
            self.reset()
        get = self.codes.__getitem__
        codes = [np.fromiter(map(get, words), np.int64, len(words)) for words in docs]
        self.resolve()
        flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        lens = self.len[flat]
        ends = np.cumsum(lens)
        of = np.cumsum([0, *map(len, docs)])
        total = np.concatenate(([0], ends))
        return self.ids[spread(self.at[flat], lens)], (total[of[1:]] - total[of[:-1]])

    def counts(self, docs: list[list[str]]) -> np.ndarray:
        """Number of ids per document only."""
        if len(self.codes) > self.max_words:
            self.reset()
        get = self.codes.__getitem__
        codes = [np.fromiter(map(get, words), np.int64, len(words)) for words in docs]
        self.resolve()
        return np.array([int(self.len[c].sum()) for c in codes], np.int64)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The positions start[i] .. start[i] + length[i] - 1 of every i, one after the other."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)


_B = np.uint64(0x9E3779B97F4A7C15)
_BINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}
_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("b", ())) < n:
        n = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("b", _B), ("inv", _BINV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["b"], _POWERS["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def normal(text: str | None) -> bytes:
    """Lower case; ASCII signs that are neither letters nor digits become spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACE)


class Words:
    """The words of a batch of texts as arrays: hash, document, and byte range within the normalised document."""

    def __init__(self, texts: list[str]) -> None:
        docs = [normal(t) for t in texts]
        buf = np.frombuffer(b" " + b" ".join(docs) + b" ", np.uint8)
        base = np.cumsum([1, *(len(d) + 1 for d in docs)])
        word = buf != 32
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        lo, hi = edge[::2], edge[1::2]
        power, inverse = _powers(len(buf) + 1)
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
        self.docs, self.n = docs, len(docs)
        self.hash = mix((total[hi] - total[lo]) * inverse[lo])
        self.first = np.searchsorted(lo, base[:-1])  # of each document's words
        self.count = np.searchsorted(lo, base[1:]) - self.first
        self.lo, self.hi, self.base = lo, hi, base

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes of all runs of k words, first shingle of each document, number of shingles of each document)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + self.hash[j : j + n]
        count = np.maximum(self.count - k + 1, 0)
        keep = spread(self.first, count)
        return mix(h[keep]), np.cumsum(count) - count, count
