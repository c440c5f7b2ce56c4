"""Session helpers: the shared folder of the cluster, lineage cuts, worker imports and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_LOCAL: dict[str, str] = {}


#: Bytes of an Arrow batch where the session leaves Spark's own 64 MB: a batch is held several times over.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it is run from a source checkout, and bound their batches."""
    key, default, own = ARROW_BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, own)
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *have])
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    A local session that names none gets a temporary folder of this process; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="isoline-")
    return _LOCAL[app]


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/isoline/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str, instead: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them back.

    A loop that hands over a list gets the path of its last round deleted as soon as the new one is written.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    if instead is not None:
        for old in instead:
            drop_path(spark, old)
        instead[:] = [path]
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What queries within shuffle is deleted from disk when they end, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Joins within stay in the tasks to which both sides were dealt by some of the join's keys."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of the shared folder exists."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
