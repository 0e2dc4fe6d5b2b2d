"""Jobs as tables: headers, images and an event log; the current state is derived from the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from glyphflow.functions.text import estimated_completion, iso_z_format, status_url
from glyphflow.operators.batch import rollup_status
from glyphflow.operators.validate import gate_detail, gate_of_size
from glyphflow.plans.skew import HOT_ROWS, previous_value
from glyphflow.settings import (
    CANCELLED,
    COMPLETED,
    FAILED,
    JOB_STATES,
    LEGAL_TRANSITIONS,
    QUEUED,
    RUNNING,
    TERMINAL_STATES,
    Settings,
)

LIST_LIMIT = 100


# ---- creation -------------------------------------------------------------------------------


def job_headers(jobs: DataFrame, settings: Settings) -> DataFrame:
    """Headers of new jobs from rows (job_id, created_at, n_images); jobs above the size limit are left out."""
    return (
        jobs.where(gate_of_size(F.col("n_images"), settings).isNull())
        .withColumn("status", F.lit(QUEUED))
        .withColumn("status_url", status_url(F.col("job_id")))
        .withColumn(
            "estimated_completion",
            estimated_completion(F.col("created_at"), F.col("n_images"), settings.minutes_per_image),
        )
        .withColumn("processed", F.lit(0).cast("bigint"))
        .withColumnRenamed("n_images", "total")
    )


def create_jobs(requests: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, images, rejected) from job requests with job_id, created_at and images."""
    sized = requests.withColumn("n_images", F.size("images"))
    headers = job_headers(sized.drop("images"), settings)
    accepted = sized.where(gate_of_size(F.col("n_images"), settings).isNull())
    images = accepted.select("job_id", F.posexplode("images").alias("idx", "payload"))
    rejected = sized.select(
        "job_id",
        gate_of_size(F.col("n_images"), settings).alias("error_code"),
        gate_detail(F.col("n_images"), settings).alias("error_detail"),
        F.lit(400).alias("http_status"),
    ).where(F.col("error_code").isNotNull())
    return headers, images, rejected


# ---- state ----------------------------------------------------------------------------------


def fold_columns(terminal_wins: bool = False) -> list[Column]:
    """Aggregates that fold the events of a job into its state, all but the error text.

    They use min_by / max_by over numbers and times only: such buffers fit a
    hash aggregate, and events are combined before the shuffle, in batch and
    on streams alike. Each field takes its last write; with `terminal_wins`
    the first terminal state is final. `status_code` is the position in
    JOB_STATES, from 1 on.
    """
    kind, seq, ts = F.col("kind"), F.col("seq"), F.col("ts")
    code = F.array_position(F.array(*[F.lit(s) for s in JOB_STATES]), kind)

    def seq_if(test: Column) -> Column:
        return F.when(test, seq)

    finished = kind.isin(COMPLETED, FAILED)
    status = F.max_by(code, seq_if(code > 0))
    completed_at = F.max_by(ts, seq_if(finished))
    if terminal_wins:
        first_end = seq_if(kind.isin(TERMINAL_STATES))
        status = F.coalesce(F.min_by(code, first_end), status)
        completed_at = F.min_by(F.when(finished, ts), first_end)
    return [
        status.alias("status_code"),
        F.min_by(ts, seq_if(kind == QUEUED)).alias("created_at"),
        F.min_by(ts, seq_if(kind == RUNNING)).alias("started_at"),
        completed_at.alias("completed_at"),
        F.max_by("processed", seq_if(F.col("processed").isNotNull())).alias("processed"),
        F.max("ts").alias("last_event_at"),
        F.max("seq").alias("last_seq"),
    ]


def last_error() -> Column:
    """Aggregate: the error text written last."""
    return F.max_by("error", F.when(F.nullif(F.col("error"), F.lit("")).isNotNull(), F.col("seq"))).alias("error")


def status_of_code(code: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in JOB_STATES]), code.cast("int"))


def with_status(folded: DataFrame) -> DataFrame:
    """Replace status_code by the status name."""
    others = [c for c in folded.columns if c not in ("job_id", "status_code")]
    return folded.select("job_id", status_of_code(F.col("status_code")).alias("status"), *others)


def fold_job_events(events: DataFrame, *, terminal_wins: bool = False, with_error: bool = True) -> DataFrame:
    """Current state per job from events (job_id, seq, ts, kind, processed, error).

    Error texts are folded apart, over the few events that have one; leave
    them out with `with_error=False` where they are not needed.
    """
    state = with_status(events.groupBy("job_id").agg(*fold_columns(terminal_wins)))
    if not with_error:
        return state
    errors = events.where(F.col("error").isNotNull()).groupBy("job_id").agg(last_error())
    return state.join(errors, "job_id", "left")


def latest_version(versions: DataFrame, key: str = "job_id", seq: str = "version") -> DataFrame:
    """The newest document per key from an append-only table with one row per key and version.

    The newest versions are found on two narrow columns; documents are only
    filtered by them and never aggregated.
    """
    fields = [c for c in versions.columns if c not in (key, seq)]
    newest = versions.groupBy(key).agg(F.max(seq).alias(seq))
    return versions.join(newest, [key, seq], "left_semi").select(key, seq, *fields)


def status_transitions(events: DataFrame, *, min_rows: int = HOT_ROWS) -> DataFrame:
    """Status events with the status before them and whether the step is legal."""
    status_events = events.where(F.col("kind").isin(JOB_STATES))
    steps = previous_value(status_events, "job_id", "seq", "kind", "prev_status", min_rows=min_rows)
    legal = F.lit(False)
    for before, after in LEGAL_TRANSITIONS:
        legal = legal | ((F.coalesce("prev_status", F.lit("")) == before) & (F.col("kind") == after))
    return steps.withColumn("is_legal", legal)


def running_progress(job_images: DataFrame) -> DataFrame:
    """Progress after each image of accepted jobs: processed and total."""
    per_job = Window.partitionBy("job_id")
    return job_images.withColumn("processed", F.row_number().over(per_job.orderBy("idx"))).withColumn(
        "total", F.count(F.lit(1)).over(per_job)
    )


def progress_writes(items: DataFrame) -> DataFrame:
    """Progress as stored: one write per image that could be decoded, and one when the job ends.

    An image that cannot be decoded (`decode_failed`) writes nothing itself;
    the next write counts it. `step` is the image's idx, or the total for the last write.
    """
    steps = running_progress(items).withColumn("total", F.col("total").cast("bigint"))
    last = F.col("processed") == F.col("total")
    own = F.when(~F.col("decode_failed"), F.struct(F.col("idx").alias("step"), F.col("processed").alias("processed")))
    end = F.when(last, F.struct(F.col("processed").alias("step"), F.col("processed").alias("processed")))
    writes = F.explode(F.array_compact(F.array(own, end))).alias("write")
    return steps.select("job_id", "total", writes).select("job_id", "write.step", "write.processed", "total")


def job_outcome(items: DataFrame) -> DataFrame:
    """Final job state from its items: completed without errors, else failed; plus the request status."""
    counts = items.groupBy("job_id").agg(
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(F.col("status") == "error").alias("n_error"),
    )
    return counts.withColumn(
        "status", F.when(F.col("n_error") == 0, F.lit(COMPLETED)).otherwise(F.lit(FAILED))
    ).withColumn("request_status", rollup_status(F.col("n_success"), F.col("n_error")))


def crash_events(jobs: DataFrame, error: Column) -> DataFrame:
    """Event rows for jobs that ended by an unexpected exception."""
    return jobs.select(
        "job_id", "seq", "ts", F.lit(FAILED).alias("kind"), F.lit(None).cast("bigint").alias("processed"),
        error.alias("error"),
    )


# ---- requests about jobs --------------------------------------------------------------------


def lookup_job(state: DataFrame, job_id: str) -> DataFrame:
    """The state of one job; no row when it is unknown."""
    return state.where(F.col("job_id") == job_id)


def lookup_jobs(ids: DataFrame, state: DataFrame) -> DataFrame:
    """The state of many jobs; unknown ids keep their row, with nulls."""
    return ids.join(state, "job_id", "left")


def known_jobs(ids: DataFrame, state: DataFrame) -> DataFrame:
    return ids.join(state, "job_id", "left_semi")


def unknown_jobs(ids: DataFrame, state: DataFrame) -> DataFrame:
    return ids.join(state, "job_id", "left_anti")


def not_found_detail(job_id: Column) -> Column:
    return F.concat(F.lit("Job "), job_id, F.lit(" not found"))


def cancel_jobs(ids: DataFrame, state: DataFrame) -> DataFrame:
    """Outcome of cancel requests: cancelled (with the job's creation time), cannot_cancel or job_not_found."""
    status = F.col("status")
    found = lookup_jobs(ids, state.select("job_id", "status", "created_at"))
    code = F.when(status.isNull(), F.lit("job_not_found")).when(
        ~status.isin(QUEUED, RUNNING), F.lit("cannot_cancel")
    )
    detail = F.when(status.isNull(), not_found_detail(F.col("job_id"))).when(
        code == "cannot_cancel",
        F.concat(F.lit("Job with status '"), status, F.lit("' cannot be cancelled")),
    )
    http = F.when(code.isNull(), 200).when(code == "job_not_found", 404).otherwise(400)
    return found.select(
        "job_id",
        F.when(code.isNull(), F.lit(CANCELLED)).otherwise(status).alias("status"),
        F.when(code.isNull(), iso_z_format(F.col("created_at"))).alias("created_at"),
        code.alias("error_code"),
        detail.alias("error_detail"),
        http.alias("http_status"),
    )


def cancel_events(outcomes: DataFrame, seq: Column, ts: Column) -> DataFrame:
    """Event rows for the cancel requests that were granted."""
    return outcomes.where(F.col("error_code").isNull()).select(
        "job_id", seq.alias("seq"), ts.alias("ts"), F.lit(CANCELLED).alias("kind"),
        F.lit(None).cast("bigint").alias("processed"), F.lit(None).cast("string").alias("error"),
    )


def effective_images(job_images: DataFrame, events: DataFrame) -> DataFrame:
    """Images started before their job was cancelled; jobs without a cancel keep all.

    `job_images` are those of accepted jobs, so a job has at most the batch limit.
    """
    cancels = events.where(F.col("kind") == CANCELLED).groupBy("job_id").agg(F.min("ts").alias("cancel_ts"))
    return job_images.join(cancels, "job_id", "left").where(
        F.col("cancel_ts").isNull() | (F.col("start_ts") < F.col("cancel_ts"))
    )


def pending_images(job_images: DataFrame, results: DataFrame, state: DataFrame) -> DataFrame:
    """Images of running jobs that have no result yet."""
    running = state.where(F.col("status") == RUNNING).select("job_id")
    return job_images.join(running, "job_id", "left_semi").join(
        results.select("job_id", "idx"), ["job_id", "idx"], "left_anti"
    )


def job_status_view(ids: DataFrame, state: DataFrame, results: DataFrame, totals: DataFrame) -> DataFrame:
    """What a status request returns, one row per id.

    `results` has one row per job with an array; an empty one is shown as null.
    `totals` has the number of images of each job, as `total`.
    """
    found = lookup_jobs(ids, state).join(results, "job_id", "left").join(totals.select("job_id", "total"), "job_id", "left")
    status = F.col("status")
    shown = F.when(F.size("results") > 0, F.col("results"))
    return found.select(
        "job_id",
        status,
        *[iso_z_format(F.col(c)).alias(c) for c in ("created_at", "started_at", "completed_at")],
        "processed",
        "total",
        shown.alias("results"),
        "error",
        F.when(status.isNull(), F.lit("job_not_found")).alias("error_code"),
        F.when(status.isNull(), not_found_detail(F.col("job_id"))).alias("error_detail"),
        F.when(status.isNull(), 404).when(status == FAILED, 500).otherwise(200).alias("http_status"),
    )


def is_expired(since: Column, as_of: Column, settings: Settings) -> Column:
    """Strictly more than the time to live has passed; exactly that much is still alive."""
    return F.coalesce(as_of - since > F.expr(f"INTERVAL '{settings.job_ttl_hours}' HOUR"), F.lit(False))


def expiry_view(state: DataFrame, as_of: Column, settings: Settings, *, sliding: bool = False) -> DataFrame:
    """State with is_expired and http_status. Fixed counts from creation, sliding from the last event.

    `as_of` is given by the caller, so a re-run sees the same jobs.
    """
    since = F.col("last_event_at") if sliding else F.col("created_at")
    gone = is_expired(since, as_of, settings)
    return state.withColumn("is_expired", gone).withColumn("http_status", F.when(gone, 404).otherwise(200))


def alive_jobs(state: DataFrame, as_of: Column, settings: Settings, *, sliding: bool = False) -> DataFrame:
    return expiry_view(state, as_of, settings, sliding=sliding).where(~F.col("is_expired")).drop(
        "is_expired", "http_status"
    )


def list_jobs(
    state: DataFrame, status: str | None = None, limit: int = LIST_LIMIT, *, filter_first: bool = False
) -> DataFrame:
    """Jobs by descending id. The limit is taken before the status filter unless `filter_first`."""
    wanted = F.lit(True) if status is None else F.col("status") == status
    if filter_first:
        return state.where(wanted).orderBy(F.desc("job_id")).limit(limit)
    return state.orderBy(F.desc("job_id")).limit(limit).where(wanted)
