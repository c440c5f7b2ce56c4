"""Progress events of jobs as a stream: steps from messages, last state per job, snapshots for late readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a message contains, and the step and percentage that it stands for, tried in this order.
STEPS = (
    ("OCR", "ocr_tiled", None),
    ("symbol", "symbol_detection", 65),
    ("equipment", "symbol_detection", 65),
    ("tracing", "line_tracing", 80),
    ("lines", "line_tracing", 80),
    ("tags", "association", 85),
    ("system", "grouping", 95),
    ("completed", "completed", 100),
    ("failed", "failed", 100),
)
TERMINAL = ("completed", "failed")


def percent(current: Column, total: Column) -> Column:
    """Share done in percent, rounded half to even; 0 of nothing."""
    return F.when(total > 0, F.bround(100.0 * current / F.nullif(total, F.lit(0))).cast("int")).otherwise(0)


def with_step(events: DataFrame) -> DataFrame:
    """Add step and pct to events with message, current, total."""
    own = F.least(percent(F.col("current"), F.col("total")), F.lit(100))
    step, pct = F.lit("processing"), own
    for part, name, fixed in reversed(STEPS):
        hit = F.lower("message").contains(part.lower())
        step = F.when(hit, name).otherwise(step)
        pct = F.when(hit, own if fixed is None else F.lit(fixed)).otherwise(pct)
    return events.withColumn("step", step).withColumn("pct", pct.cast("int"))


def status(step: Column, message: Column) -> Column:
    """State of a job after an event."""
    return F.when(step == "completed", "completed").when(step == "failed", "failed").when(F.lower(message) == "queued", "queued").otherwise("processing")


def job_state(events: DataFrame) -> DataFrame:
    """Per job: the last event's step, pct and status, and how many events came. Works on tables and on streams.

    A job that has ended stays ended: the last terminal event wins over anything later.
    """
    e = with_step(events).withColumn("status", status(F.col("step"), F.col("message"))).withColumn("ended", F.col("step").isin(*TERMINAL))
    last = F.max(F.struct("ended", "ts", "event_id", "step", "pct", "status")).alias("s")
    return e.groupBy("job_id").agg(last, F.count("*").alias("n_events")).select("job_id", "s.step", "s.pct", "s.status", "n_events")


def until_terminal(events: DataFrame) -> DataFrame:
    """Terminal events only: what a subscriber waits for."""
    return with_step(events).where(F.col("step").isin(*TERMINAL))


def stream_job_state(spark: SparkSession, path: str, schema: str, checkpoint: str, out: str, files_per_batch: int = 1) -> StreamingQuery:
    """Keep job states up to date from files that arrive at a path.

    Every batch writes the states that it changed to a table of its own below `out`; `snapshot` reads the latest of each
    job. A batch that is run again replaces its own table, so nothing is counted twice, and no state passes the driver.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

    def emit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return job_state(source).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(emit).start()


def snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The last state of every job from what stream_job_state wrote: what a late subscriber is told."""
    rows = spark.read.parquet(out)
    own = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*own), "batch").alias("s")).select("job_id", "s.*")


def latest_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The most recent jobs, newest first."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def jobs_of_project(jobs: DataFrame, sheets: DataFrame, project_id: object, limit: int = 50) -> DataFrame:
    """The most recent jobs of a project's sheets; the limit is the listing's own."""
    return latest_jobs(jobs.join(sheets.where(F.col("project_id") == F.lit(project_id)).select("sheet_id"), "sheet_id", "left_semi"), limit)


def latest_per_sheet(jobs: DataFrame) -> DataFrame:
    """The latest job of each sheet; of equal times the larger id."""
    return jobs.groupBy("sheet_id").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))
