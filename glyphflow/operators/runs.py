"""Whole job runs: what a job has done by its images, and by the cancel requests and crashes that met it.

A run is a pure function of its submission, its images' outcomes and the
messages about it, all in event time. So it does not matter in which order or
in which micro-batch these arrive, or which images were processed in vain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphflow.functions.text import estimated_completion
from glyphflow.operators.batch import ordered_results
from glyphflow.operators.jobs import cancel_events, crash_events, fold_job_events, job_outcome, job_status_view
from glyphflow.session import materialise
from glyphflow.settings import CANCELLED, QUEUED, RUNNING, Settings

CANCEL, CRASH = "cancel", "crash"
RESULT_FIELDS = ["filename", "status", "results", "summary", "meta", "error"]


def image_start(created_at: Column, idx: Column, settings: Settings) -> Column:
    """When the image at `idx` starts: images run one after the other, at the pace that completion is estimated by."""
    return estimated_completion(created_at, idx, settings.minutes_per_image)


def with_interrupts(headers: DataFrame, messages: DataFrame, settings: Settings) -> DataFrame:
    """Headers (job_id, created_at, total) with end_at, cancel_at, crash_at, crash_error and runs_to_end.

    `messages` are rows (job_id, kind, ts, error) of kind cancel or crash. The
    first cancel while the job is queued or running is granted. A cancelled job
    stops before its next image, so a crash counts up to then only; a cancel
    during the last image does not stop the run.
    """
    timed = headers.withColumn("end_at", image_start(F.col("created_at"), F.col("total"), settings))
    ts = F.col("ts")
    met = messages.join(timed.select("job_id", "created_at", "end_at"), "job_id").where((ts >= F.col("created_at")) & (ts < F.col("end_at")))
    first = met.groupBy("job_id").agg(
        F.min(F.when(F.col("kind") == CANCEL, ts)).alias("cancel_at"),
        F.min(F.when(F.col("kind") == CRASH, ts)).alias("crash_at"),
    )
    texts = met.where(F.col("kind") == CRASH).groupBy("job_id").agg(F.min(F.struct("ts", "error"))["error"].alias("crash_error"))
    found = timed.join(first, "job_id", "left").join(texts, "job_id", "left")
    # The first image that would start at or after the cancel.
    step = F.lit(60 * settings.minutes_per_image)
    passed = (F.unix_micros("cancel_at") - F.unix_micros("created_at")) / 1_000_000
    stop_at = image_start(F.col("created_at"), F.ceil(passed / step).cast("int"), settings)
    before_crash = F.col("crash_at").isNull() | (F.col("cancel_at") <= F.col("crash_at"))
    granted = found.withColumn("cancel_at", F.when(before_crash, F.col("cancel_at"))).withColumn("_stop_at", stop_at)
    crashed = F.col("_stop_at").isNull() | (F.col("crash_at") < F.col("_stop_at"))
    whole = F.col("crash_at").isNull() & (F.col("_stop_at").isNull() | (F.col("_stop_at") >= F.col("end_at")))
    return (
        granted.withColumn("crash_at", F.when(crashed, F.col("crash_at")))
        .withColumn("crash_error", F.when(F.col("crash_at").isNotNull(), F.col("crash_error")))
        .withColumn("runs_to_end", whole)
        .drop("_stop_at")
    )


def reached_images(items: DataFrame, runs: DataFrame, settings: Settings) -> DataFrame:
    """Image rows (job_id, idx, ...) that their run got to: started before the cancel, ended by the crash; with start_at and end_at."""
    cut = runs.select("job_id", "created_at", "cancel_at", "crash_at")
    created, idx = F.col("created_at"), F.col("idx")
    timed = items.join(cut, "job_id").withColumns({"start_at": image_start(created, idx, settings), "end_at": image_start(created, idx + 1, settings)})
    kept = (F.col("cancel_at").isNull() | (F.col("start_at") < F.col("cancel_at"))) & (F.col("crash_at").isNull() | (F.col("end_at") <= F.col("crash_at")))
    return timed.where(kept).drop("created_at", "cancel_at", "crash_at")


def run_events(runs: DataFrame, reached: DataFrame) -> DataFrame:
    """The event log of the runs: (job_id, seq, ts, kind, processed, error).

    An image that cannot be decoded writes no progress of its own. `seq` orders
    the events of a job by time, at one time in the order of writing.
    """
    nothing, no_text = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def seq(ts: Column, rank: int) -> Column:
        return F.unix_micros(ts) * 8 + rank

    def event(df: DataFrame, kind: Column, ts: Column, rank: int, processed: Column = nothing) -> DataFrame:
        return df.select("job_id", seq(ts, rank).alias("seq"), ts.alias("ts"), kind.alias("kind"), processed.alias("processed"), no_text.alias("error"))

    created = F.col("created_at")
    progress = reached.where(~F.col("decode_failed"))
    ended = job_outcome(reached).join(runs.where("runs_to_end").select("job_id", "end_at", "total"), "job_id")
    crashed = runs.where(F.col("crash_at").isNotNull()).select("job_id", seq(F.col("crash_at"), 5).alias("seq"), F.col("crash_at").alias("ts"), "crash_error")
    cancelled = runs.where(F.col("cancel_at").isNotNull()).withColumn("error_code", no_text)
    parts = [
        event(runs, F.lit(QUEUED), created, 0),
        event(runs, F.lit(RUNNING), created, 1),
        event(progress, F.lit("progress"), F.col("end_at"), 2, (F.col("idx") + 1).cast("bigint")),
        cancel_events(cancelled, seq(F.col("cancel_at"), 4), F.col("cancel_at")),
        crash_events(crashed, F.col("crash_error")),
        event(ended, F.col("status"), F.col("end_at"), 6, F.col("total").cast("bigint")),
    ]
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    return events


def run_view(ids: DataFrame, headers: DataFrame, results: DataFrame, messages: DataFrame, settings: Settings) -> DataFrame:
    """What a status request returns for each of `ids`, with the results of the images themselves.

    `results` are image outcomes as `process_job_images` gives them, read back
    from where they were written: they are looked at several times. Those of a
    run that stopped are shown as far as its last progress went.
    """
    runs = materialise(with_interrupts(headers, messages, settings), "job-runs")
    reached = reached_images(results, runs, settings)
    state = fold_job_events(run_events(runs, reached))
    shown = reached.join(state.select("job_id", "processed"), "job_id").where(F.col("idx") < F.col("processed"))
    return job_status_view(ids, state, ordered_results(shown.drop("processed"), RESULT_FIELDS, "job_id"), headers)


def cancel_answers(messages: DataFrame, headers: DataFrame, settings: Settings) -> DataFrame:
    """(job_id, ts, error_code, http_status) for each cancel request: granted, too late, or about no job."""
    runs = with_interrupts(headers, messages, settings)
    asked = messages.where(F.col("kind") == CANCEL).select("job_id", "ts").join(runs.select("job_id", "created_at", "cancel_at"), "job_id", "left")
    unknown = F.col("created_at").isNull() | (F.col("ts") < F.col("created_at"))
    code = F.when(unknown, F.lit("job_not_found")).when(~F.coalesce(F.col("ts") == F.col("cancel_at"), F.lit(False)), F.lit("cannot_cancel"))
    return asked.select("job_id", "ts", F.when(code.isNull(), F.lit(CANCELLED)).alias("status"), code.alias("error_code"),
                        F.when(code.isNull(), 200).when(code == "job_not_found", 404).otherwise(400).alias("http_status"))
