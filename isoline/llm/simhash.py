"""SimHash near-duplicates by tiled exact comparison.

A tile holds the distinct fingerprints whose eight bytes have the same population counts. Two fingerprints within
`radius` bits differ by at most radius in the sum of those eight counts, so every other tile pair is skipped without
looking at it; a pair of tiles that is left is compared whole, with exclusive-or and bit counts in numpy. Nothing is
approximate: no link is lost, and copies of one fingerprint are never compared with each other.

Within a tile and its visitors, links are reduced to a spanning forest before they leave the task, so a dense group of
n fingerprints gives at most n edges per tile and not n squared; components of the edges are found by star contraction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.llm.rows import located, without
from isoline.llm.words import by_bytes, texts_of
from isoline.operators.graph import connected_components
from isoline.session import cut, prepare

RADIUS = 2
SHINGLE = 3
SEED = 42
CHUNK = 1 << 16
PAIR_BLOCK = 1 << 20
#: Homes of a tile from which on its visitors are dealt to several tasks.
DENSE = 20_000
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")
_PLAIN = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles of a whole text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_PLAIN).split(b" ")
    if b"" in words:
        words = [w for w in words if w]
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    lo, hi = starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, len(lo), CHUNK):
        h = list(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(lo[k : k + CHUNK], hi[k : k + CHUNK], strict=True)], repeat(SEED)))
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > len(lo))))


def fingerprints(docs: DataFrame, *others: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, others) of every row; fp is the unsigned fingerprint's bits as a signed long. Null counts as empty."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            fp = np.array([fingerprint(t) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "fp": pa.array(fp), **{f"other{k}": b.column(f"other{k}") for k in range(len(others))}})

    named = [F.col(c).alias(f"other{k}") for k, c in enumerate(others)]
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *named)
    kinds = dict(narrow.dtypes)
    out = narrow.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"other{k} {kinds[f'other{k}']}" for k in range(len(others)))]))
    return out.withColumnsRenamed({f"other{k}": c for k, c in enumerate(others)})


def _moves(radius: int) -> np.ndarray:
    """Differences of eight byte counts whose absolute sum is within radius; of a difference and its opposite, one."""
    found = {(0,) * 8}
    for _ in range(radius):
        found |= {(*d[:i], d[i] + s, *d[i + 1 :]) for d, i, s in product(found, range(8), (-1, 1))}
    return np.array(sorted(d for d in found if d > (0,) * 8), np.int64)


def _tile(counts: np.ndarray) -> np.ndarray:
    """The tile of each row of eight byte counts, as one number."""
    return counts @ (16 ** np.arange(8, dtype=np.int64))


def tile_rows(radius: int):
    """Each fingerprint once at home in its tile, and as a visitor of its own and of each tile near on one side."""
    moves = np.concatenate([np.zeros((1, 8), np.int64), _moves(radius)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.asarray(b.column("fp"))
            for k in range(0, len(fps), 8192):
                fp = fps[k : k + 8192]
                counts = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"tile": pa.array(_tile(counts)), "visitor": pa.array(np.zeros(len(fp), bool)), "fp": pa.array(fp)})
                away = counts[:, None, :] + moves[None, :, :]
                ok = ((away >= 0) & (away <= 8)).all(2)
                yield pa.RecordBatch.from_pydict({"tile": pa.array(_tile(away[ok])), "visitor": pa.array(np.ones(int(ok.sum()), bool)), "fp": pa.array(np.repeat(fp, ok.sum(1)))})

    return run


#: The tile of column fp in SQL.
TILE = " + ".join(f"shiftleft(cast(bit_count(shiftright(fp, {8 * k}) & 255) as bigint), {4 * k})" for k in range(8))


def dealt_tiles(reps: DataFrame, radius: int, dense: int) -> DataFrame:
    """tile_rows, dealt by (tile, part): of a tile with more than `dense` homes every part has all homes and a share of
    the visitors, so that its pairs are spread over as many tasks as it has `dense` homes."""
    rows = reps.select("fp").mapInArrow(tile_rows(radius), "tile long, visitor boolean, fp long")
    crowds = cut(reps.groupBy(F.expr(TILE).alias("tile")).agg(F.count("*").alias("n")).where(F.col("n") > dense), "dense-tiles")
    if crowds.isEmpty():
        return rows.repartition("tile").withColumn("part", F.lit(0)).sortWithinPartitions("tile", "part", "visitor")
    parts = crowds.select("tile", F.ceil(F.col("n") / dense).cast("int").alias("parts"))
    rows = rows.join(parts, "tile", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.when(F.col("visitor"), F.array(F.pmod(F.hash("fp"), F.col("parts")))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return rows.select("tile", "visitor", "fp", F.explode(own).alias("part")).repartition("tile", "part").sortWithinPartitions("tile", "part", "visitor")


def compare_tiles(radius: int):
    """Read rows sorted by (tile, part, visitor): compare homes with visitors; yield a spanning forest of the links."""

    def links(homes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        step = max(1, PAIR_BLOCK // max(1, len(homes)))
        for k in range(0, len(part), step):
            i, j = np.nonzero(np.bitwise_count(homes[:, None] ^ part[None, k : k + step]) <= radius)
            other = homes[i] != part[j + k]
            left.append(homes[i[other]])
            right.append(part[j[other] + k])
        return np.concatenate(left), np.concatenate(right)

    def forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for a, b in pairs:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        return [(x, root(x)) for x in up if root(x) != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, homes = None, np.zeros(0, np.uint64)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[tuple[int, int]] = []

        def close() -> None:
            nonlocal pairs
            if pairs:
                edges.extend(forest(pairs))
                pairs = []

        for b in batches:
            t, part_no = np.asarray(b.column("tile")), np.asarray(b.column("part"))
            visitor = np.asarray(b.column("visitor").to_numpy(zero_copy_only=False))
            fp = np.asarray(b.column("fp")).view(np.uint64)
            cuts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (part_no[1:] != part_no[:-1]) | (visitor[1:] != visitor[:-1])))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(t)], strict=True):
                if (t[lo], part_no[lo]) != tile:
                    close()
                    tile, homes = (t[lo], part_no[lo]), np.zeros(0, np.uint64)
                if not visitor[lo]:
                    homes = np.concatenate([homes, fp[lo:hi]])
                elif len(homes):
                    x, y = links(homes, fp[lo:hi])
                    if len(x):
                        pairs.append((x, y))
                if sum(len(x) for x, _ in pairs) > PAIR_BLOCK:  # keep a forest in place of the links seen so far
                    kept = np.array(forest(pairs), np.uint64).reshape(-1, 2)
                    pairs = [(kept[:, 0], kept[:, 1])]
            if len(edges) > 10_000:
                yield _edges(edges)
                edges.clear()
        close()
        if edges:
            yield _edges(edges)

    return run


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array(edges, np.uint64).reshape(-1, 2)
    return pa.RecordBatch.from_pydict({"src": pa.array(np.ascontiguousarray(a[:, 0]).view(np.int64)), "dst": pa.array(np.ascontiguousarray(a[:, 1]).view(np.int64))})


def _components(fps: DataFrame, radius: int, dense: int) -> DataFrame:
    """(fp, component) of every fingerprint."""
    reps = fps.select("fp").distinct()
    edges = dealt_tiles(reps, radius, dense).mapInArrow(compare_tiles(radius), "src long, dst long")
    parts = connected_components(edges)
    return reps.join(parts, reps.fp == parts.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row.

    component_id is the smallest doc_id that links of at most `radius` differing bits reach. Null and empty texts have
    fingerprint zero and are linked like any other. A null doc_id takes part in links and keeps a row, but names no
    component unless its whole component has none. Repeated ids each get a row; other columns are ignored.
    """
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    named = cut(first.join(_components(fps, radius, dense), "fp"), "simhash-components")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(named, "fp").select("doc_id", hexed, "component_id")


def drop_near_copies(docs: DataFrame, *, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """Of every component one row, with all its columns: the one with the smallest doc_id, null last.

    Of rows that share that id the first by file and row number stays. Rows go by their place, so a repeated or null
    id takes no unlike row along.
    """
    here, file, row = located(docs)
    fps = fingerprints(here, file, row, id_col=id_col, text_col=text_col).withColumnsRenamed({file: "_f", row: "_r"})
    fps = cut(fps, "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_f", "_r")
    first = fps.groupBy("fp").agg(F.min(order).alias("first"))
    named = cut(first.join(_components(fps, radius, dense), "fp"), "simhash-components")
    kept = named.groupBy("component").agg(F.min("first").alias("kept"))
    named = named.join(kept, "component").select("fp", "kept")
    gone = fps.join(named, "fp").where("_f <> kept._f or _r <> kept._r").select("_f", "_r")
    return without(here, file, row, cut(gone, "near-copies"))
