"""Exact dedup by a stateful stream.

Documents become a log of (digest, doc_id, content locator) in the shared folder; the locator is the file of a row and
its number there. A stream reads the log batch by batch and keeps, per digest and without expiry, the largest doc_id
(the stable identifier), the locator of that row and how many rows had the digest; the state is on disk (RocksDB) with
its checkpoint in the shared folder, and a caller who names a state folder goes on from it with later documents. Rows of
a batch are combined before they reach the state, so a text with any number of copies sends one row per task.

A digest seen more than once is a hit, and hits are checked on their full bytes: texts of equal digest meet sorted, as
a stream, one per task and distinct text; contents of earlier calls are fetched by their locators. Digests whose texts
differ are regrouped by the texts themselves.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.llm.rows import located, without
from isoline.llm.words import by_bytes, texts_of
from isoline.session import cut, drop_path, path_exists, prepare, shared_path

#: Log files per micro-batch, and bytes of distinct text that a task holds before it hands them on.
FILES_PER_BATCH = 128
HOLD_BYTES = 24 << 20
#: Bits of the table (2 MB at any size) that spares most texts without a hit the way to the comparison of bytes.
HIT_BITS = 24
LOG = "digest binary, doc_id long, file string, row long, sha256 string"
GROUPS = "digest binary, keep_id long, file string, row long, group_size long"
#: State on disk; small stores neither reserve disk ahead nor write a whole snapshot per batch, and a store is in an
#: executor's memory only while its task runs, however many partitions there are.
_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.boundedMemoryUsage": "true",
    f"{_ROCKS}.maxMemoryUsageMB": "128",
    f"{_ROCKS}.allowFAllocate": "false",
    f"{_ROCKS}.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes of a whole text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def sha256(data: bytes) -> bytes:
    """The digest that keys the state."""
    return hashlib.sha256(data).digest()


def group_digests(spark: SparkSession, log: str, files_per_batch: int = FILES_PER_BATCH, state: str | None = None) -> DataFrame:
    """(digest, keep_id, file, row, group_size) of every digest of the log files at a path, by the stateful stream.

    With a state folder, only log files that it has not seen are read, and its digests go on from there.
    """
    work = state or shared_path(spark, "dedup")
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log)
        kept = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))

        def emit(batch: DataFrame, number: int) -> None:
            changed = batch.select("digest", F.col("keep.doc_id").alias("keep_id"), "keep.file", "keep.row", "group_size")
            changed.write.mode("overwrite").parquet(f"{work}/groups/batch={number}")

        kept.writeStream.outputMode("update").option("checkpointLocation", f"{work}/state").trigger(availableNow=True).foreachBatch(emit).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not path_exists(spark, f"{work}/groups"):  # an empty table makes no batch
        return spark.createDataFrame([], GROUPS)
    if state is None:  # the stream has ended and what it last said of each digest is written
        drop_path(spark, f"{work}/state")
    updates = spark.read.schema(GROUPS).parquet(f"{work}/groups")
    last = updates.groupBy("digest").agg(F.max(F.struct("keep_id", "file", "row")).alias("k"), F.max("group_size").alias("group_size"))
    return last.select("digest", "k.*", "group_size")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256, files_per_batch: int = FILES_PER_BATCH, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator of every row.

    Texts are equal if they are identical after lower-casing A-Z. Of equal texts one row is kept: the one with the
    largest doc_id and, where rows repeat both text and id, the last by file and row number. A null doc_id is smaller
    than any other. Null text counts as empty, and empty texts equal each other. locator is (file, row number).
    Other columns are ignored.

    state names a folder that later calls go on from: their groups then count, and keep ids of, all documents given to
    any call. Each call must bring new documents, and Parquet files of earlier ones must still be where they were.
    Should digests collide, texts are told apart among the rows of the call.
    """
    here, file, row = located(docs)
    return _groups(here, file, row, id_col, text_col, digest, files_per_batch, state)


def _groups(here: DataFrame, file: str, row: str, id_col: str, text_col: str, digest: Callable[[bytes], bytes], files_per_batch: int, state: str | None) -> DataFrame:
    spark = prepare(here.sparkSession)
    narrow = here.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(file).alias("file"), F.col(row).alias("row"))
    logs = f"{state}/log" if state else shared_path(spark, "digests")
    path = f"{logs}/call={uuid.uuid4().hex}"
    narrow.mapInArrow(_log(digest), LOG).write.parquet(path)
    log = spark.read.schema(LOG).parquet(path)
    groups = cut(group_digests(spark, f"{logs}/*", files_per_batch, state), "groups")
    texts = narrow.select("text")
    if state:
        earlier = spark.read.schema(LOG).parquet(f"{logs}/*").join(groups.where("group_size > 1"), "digest", "left_semi")
        earlier = cut(earlier.select(F.col("file").alias("_f"), F.col("row").alias("_r")).distinct(), "earlier")
        texts = texts.unionByName(_contents(spark, earlier, text_col))
    bad = cut(_mismatches(texts, groups, digest), "mismatches")
    named = groups.select("digest", "keep_id", F.col("file").alias("_f"), F.col("row").alias("_r"), "group_size")
    rows = log.join(named, "digest")
    kept = (F.col("file") == F.col("_f")) & (F.col("row") == F.col("_r"))
    result = ["doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha256").alias("text_sha256"), F.struct("file", "row").alias("locator")]
    if bad.isEmpty():
        return rows.select(*result)
    # texts of the digests whose bytes differ are grouped by the bytes
    hit = narrow.mapInArrow(_with_bytes(digest), f"{LOG}, data binary").join(bad, "digest", "left_semi")
    by_text = hit.groupBy("data").agg(F.max(F.struct("doc_id", "file", "row")).alias("k"), F.count("*").alias("group_size"))
    mended = hit.join(by_text.select("data", F.col("k.doc_id").alias("keep_id"), F.col("k.file").alias("_f"), F.col("k.row").alias("_r"), "group_size"), "data")
    return rows.join(bad, "digest", "left_anti").select(*result).unionByName(mended.select(*result))


def _contents(spark: SparkSession, places: DataFrame, text_col: str) -> DataFrame:
    """The texts at some places (_f, _r); the driver gets the names of the files that hold them, as for any read."""
    files = [r["_f"] for r in places.select("_f").distinct().toLocalIterator()]
    if not files:
        return spark.createDataFrame([], "text string")
    found = spark.read.parquet(*files)
    place = found.metadataColumn("_metadata")
    found = found.select(F.col(text_col).alias("text"), place["file_path"].alias("_file"), place["row_index"].alias("_row"))
    return found.join(places, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")), "left_semi").select("text")


def _log(digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            data = [normalised(t) for t in texts_of(b)]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([digest(x) for x in data], pa.binary()), "doc_id": b.column("doc_id"), "file": b.column("file"), "row": b.column("row"), "sha256": pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string())})

    return run


def _with_bytes(digest: Callable[[bytes], bytes]):
    log = _log(digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            (out,) = log(iter([b.replace_schema_metadata(None)]))
            yield out.append_column("data", pa.array([normalised(t) for t in texts_of(b)], pa.binary()))

    return run


def _hit_table(hits: DataFrame) -> np.ndarray:
    """HIT_BITS bits: which beginnings of digests have a hit. Its size does not depend on the number of hits."""
    start = f"coalesce(cast(conv(hex(substring(digest, 1, {HIT_BITS // 8})), 16, 10) as bigint), 0) + 1"  # positions count from 1
    blocks = hits.select(F.expr(f"bitmap_bucket_number({start})").alias("k"), F.expr(f"bitmap_bit_position({start})").alias("p")).groupBy("k").agg(F.expr("bitmap_construct_agg(p)").alias("bits"))
    table = np.zeros((1 << HIT_BITS) // 8, np.uint8)
    for r in blocks.collect():  # at most 2 ** HIT_BITS / 32768 blocks of 4 KB
        table[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return table


def _mismatches(texts: DataFrame, groups: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Digests with more than one text, from the full bytes of every hit."""
    hits = groups.where("group_size > 1").select("digest")
    table = _hit_table(hits)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], None] = {}
        size = 0
        for b in by_bytes(batches):
            for t in texts_of(b):
                data = normalised(t)
                d = digest(data)
                n = int.from_bytes(d[: HIT_BITS // 8], "big")
                if table[n >> 3] >> (n & 7) & 1 and (d, data) not in held:  # compares whole bytes
                    held[(d, data)] = None
                    size += len(data) + 200
            if size > HOLD_BYTES:
                yield from _texts(held)
                held, size = {}, 0
        yield from _texts(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, said = None, b"", False
        for b in batches:
            bad = []
            for key, data in zip(b.column("digest").to_pylist(), b.column("data").to_pylist(), strict=True):
                if key != last:
                    last, first, said = key, data, False
                elif data != first and not said:
                    bad.append(key)
                    said = True
            if bad:
                yield pa.RecordBatch.from_pydict({"digest": pa.array(bad, pa.binary())})

    found = texts.mapInArrow(distinct, "digest binary, data binary").join(hits, "digest", "left_semi")
    return found.repartition("digest").sortWithinPartitions("digest").mapInArrow(compare, "digest binary").distinct()


def _texts(held: dict[tuple[bytes, bytes], None]) -> Iterator[pa.RecordBatch]:
    keys = list(held)
    for k in range(0, len(keys), 2_000):
        part = keys[k : k + 2_000]
        yield pa.RecordBatch.from_pydict({"digest": pa.array([d for d, _ in part], pa.binary()), "data": pa.array([x for _, x in part], pa.binary())})


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Of every group of equal texts the one row that exact_groups keeps, with all its columns.

    Rows go by their place, so repeated and null ids lose no other row: of texts without any doc_id, and of rows that
    repeat both text and id, one stays as well.
    """
    here, file, row = located(docs)
    gone = _groups(here, file, row, id_col, text_col, digest, files_per_batch, None).where("not kept")
    return without(here, file, row, cut(gone.select(F.col("locator.file").alias("_f"), F.col("locator.row").alias("_r")), "copies"))
