"""Job state, expiry and de-duplicated submission on an event stream."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphflow.operators.jobs import fold_columns, last_error, with_status
from glyphflow.settings import QUEUED, Settings
from glyphflow.streaming.run import BatchTable


def stream_job_state(events: DataFrame, *, terminal_wins: bool = False) -> DataFrame:
    """Current state per job, updated by each micro-batch.

    The same fold as in batch, as a streaming aggregation: events of one job
    are combined before the shuffle and state stays in the JVM. Write it in
    update mode, e.g. with `streaming.run.upsert_batches`.
    """
    return with_status(events.groupBy("job_id").agg(*fold_columns(terminal_wins), last_error()))


def stream_sliding_expiry(events: DataFrame, settings: Settings, delay: str = "10 minutes") -> DataFrame:
    """Rows (job_id, last_event_at, expired_at) for jobs without an event for the time to live.

    Each event extends the life of its job, which is what a session window
    does; a row appears once the watermark has passed the end.
    """
    gap = f"{settings.job_ttl_hours} hours"
    return (
        events.withWatermark("ts", delay)
        .groupBy("job_id", F.session_window("ts", gap).alias("alive"))
        .agg(F.max("ts").alias("last_event_at"))
        .select("job_id", "last_event_at", F.col("alive.end").alias("expired_at"))
    )


def submitted_once(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that keeps the first submission per job id; read them with `read_batches`.

    That a job is new is a property of the stored result: each micro-batch adds
    the ids that no earlier one has stored, and a repeated micro-batch replaces
    what it wrote. So the answer does not depend on how the input is cut, and a
    job submitted again after any time stays one job.
    """
    submitted = BatchTable(spark, f"{folder}/submitted", "job_id string, ts timestamp")

    def take(batch: DataFrame, batch_id: int) -> None:
        first = batch.groupBy("job_id").agg(F.min("ts").alias("ts"))
        submitted.write(first.join(submitted.before(batch_id).select("job_id"), "job_id", "left_anti"), batch_id)

    return take


def fixed_expiry(
    spark: SparkSession, folder: str, settings: Settings, delay: timedelta = timedelta(minutes=10)
) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that reports each job once when its time to live, from creation, has passed.

    Time is the latest creation seen, less `delay`. Creations, the clock and the
    reported jobs are stored by micro-batch, so that a job is reported once
    however the input is cut. Creations count in milliseconds.
    """
    created = BatchTable(spark, f"{folder}/created", "job_id string, created_at timestamp")
    clock = BatchTable(spark, f"{folder}/clock", "ts timestamp")
    expired = BatchTable(spark, f"{folder}/expired", "job_id string, created_at timestamp, expired_at timestamp")
    ttl = F.expr(f"INTERVAL '{settings.job_ttl_hours}' HOUR")

    def take(batch: DataFrame, batch_id: int) -> None:
        queued = batch.where(F.col("kind") == QUEUED).select("job_id", F.date_trunc("millisecond", "ts").alias("ts"))
        created.write(queued.groupBy("job_id").agg(F.min("ts").alias("created_at")), batch_id)
        clock.write(queued.agg(F.max("ts").alias("ts")), batch_id)
        now = clock.before(batch_id + 1).agg(F.max("ts").alias("ts")).first()["ts"]
        if now is None:
            return
        open_jobs = created.before(batch_id + 1).join(expired.before(batch_id).select("job_id"), "job_id", "left_anti")
        oldest = open_jobs.groupBy("job_id").agg(F.min("created_at").alias("created_at"))
        due = oldest.withColumn("expired_at", F.col("created_at") + ttl).where(F.col("expired_at") <= F.lit(now - delay))
        expired.write(due, batch_id)

    return take


def stream_effective_images(starts: DataFrame, cancels: DataFrame, settings: Settings, delay: str = "10 minutes") -> DataFrame:
    """Image starts (job_id, start_ts, ...) that no cancel of their job came before, on two streams.

    `cancels` are rows (job_id, ts). A start is given out once the watermark
    has passed it, as no earlier cancel can arrive then. A cancel is kept for
    the time to live, after which its job is gone; so the state of both sides
    is bounded.
    """
    ttl = F.expr(f"INTERVAL '{settings.job_ttl_hours}' HOUR")
    left = starts.withWatermark("start_ts", delay)
    right = cancels.select(F.col("job_id").alias("_job"), F.col("ts").alias("_cancel")).withWatermark("_cancel", delay)
    start, cancel = F.col("start_ts"), F.col("_cancel")
    met = (F.col("job_id") == F.col("_job")) & (cancel <= start) & (cancel >= start - ttl)
    return left.join(right, met, "left_outer").where(cancel.isNull()).drop("_job", "_cancel")
