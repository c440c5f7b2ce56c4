"""Token records, BPE round trip and counts against the tokenizer libraries."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from isoline.llm import bpe, counts, records, tokens

from .conftest import TEXTS

WORDS, BYTES, PIECES = (tokens.default_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ORDERED = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_crc32c_known_values():
    data = b"123456789" + bytes(32) + bytes(range(256)) * 20
    start, size = np.array([0, 9, 41, 5]), np.array([9, 32, 5120, 0])
    got = records.crc32c(np.frombuffer(data, np.uint8), start, size)
    assert got[0] == 0xE3069283 and got[1] == 0x8A9136AA and got[3] == 0
    slow = 0xFFFFFFFF
    for b in data[41 : 41 + 5120]:
        slow ^= b
        for _ in range(8):
            slow = slow >> 1 ^ (0x82F63B78 if slow & 1 else 0)
    assert got[2] == slow ^ 0xFFFFFFFF


def test_records_round_trip(spark, awkward):
    manifest = records.write_records(awkward, WORDS)
    t = tokens.load(WORDS)
    want, start = Counter(), 0
    exact = []
    for k, x in ORDERED:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        exact.append((k, len(ids), zlib.crc32(packed(ids))))
    got = sorted(records.read_records(spark, manifest).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(exact)
    assert [r.doc_id for r in got] == [k for k, _ in ORDERED]
    for r in got:
        assert r.start == start
        start += r.n_tokens
    del want


def test_records_in_any_order_and_damage(spark, awkward):
    manifest = records.write_records(awkward, WORDS).orderBy("part").collect()
    part = max(manifest, key=lambda m: m.n_docs)
    order = list(range(part.n_docs))
    random.Random(1).shuffle(order)
    shuffled = dict(zip(order, records.read_at(part.path, order), strict=True))
    assert [shuffled[k][0] for k in range(part.n_docs)] == [k for k, _ in records.read_at(part.path, list(range(part.n_docs)))]
    path = part.path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data))
    index = path.removesuffix(".rec") + ".idx"
    places = bytearray(open(index, "rb").read())
    places[-8] ^= 1
    open(index, "wb").write(bytes(places))
    frame = spark.createDataFrame([part], records.MANIFEST)
    with pytest.raises(Exception, match="does not hold"):
        records.read_records(spark, frame).collect()


def test_bpe_equals_library(awkward):
    t = tokens.load(BYTES)
    want = Counter()
    for k, x in TEXTS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[k, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.encode_decode(awkward, BYTES).collect()) == want
    assert Counter(tuple(r) for r in bpe.encode_decode(awkward, BYTES, block_bytes=50).collect()) == want
    full = bpe.encode_decode(awkward, BYTES, full=True).collect()
    assert Counter((r.doc_id, r.decoded) for r in full) == Counter((k, x or "") for k, x in TEXTS)


def test_counts_equal_library(awkward):
    sp, safe = tokens.load_pieces(PIECES)
    assert safe
    want = Counter((k, len((x or "").encode()), len(sp.encode(x or "")), len(sp.encode(x or "")) > 100) for k, x in TEXTS)
    assert Counter(tuple(r) for r in counts.count_tokens(awkward, PIECES, limit=100).collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    signs = ["a", "B", "é", "İ", "ß", "Σ", " ", "  ", "\n", "\t", " ", " ", "\x1d", ".", ",", "...", "'s", "12", "▁", "漢", "é", "<|endoftext|>", "\x00", "word", " the", "-", "ﬁ", "😀", "​"]
    texts = [(k, "".join(r.choice(signs) for _ in range(r.randrange(30)))) for k in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    t, sp = tokens.load(BYTES), tokens.load_pieces(PIECES)[0]
    got = {x.doc_id: list(x.ids) for x in bpe.encode_decode(df, BYTES, full=True).collect()}
    assert got == {k: t.encode(x, add_special_tokens=False).ids for k, x in texts}
    n = {x.doc_id: x.n_tokens for x in counts.count_tokens(df, PIECES).collect()}
    assert n == {k: len(sp.encode(x)) for k, x in texts}
    w = tokens.load(WORDS)
    c = {x.doc_id: x.ids_crc32 for x in records.read_records(spark, records.write_records(df, WORDS)).collect()}
    assert c == {k: zlib.crc32(packed([*w.encode(x, add_special_tokens=False).ids, 1])) for k, x in texts}


def test_empty_tables(spark, empty):
    assert records.read_records(spark, records.write_records(empty, WORDS)).count() == 0
    assert bpe.encode_decode(empty, BYTES).count() == 0
    assert counts.count_tokens(empty, PIECES).count() == 0
