"""Whole job runs on a stream of submissions and messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphflow.operators.jobs import create_jobs
from glyphflow.operators.process import process_job_images
from glyphflow.operators.recognise import Recogniser
from glyphflow.operators.runs import CANCEL, image_start
from glyphflow.settings import Settings

SUBMIT = "submit"
MESSAGES = "job_id string, kind string, ts timestamp, error string"


def with_messages(submissions: DataFrame, messages: DataFrame) -> DataFrame:
    """One stream of submissions (job_id, created_at, images, lang, min_confidence) and messages (job_id, kind, ts, error)."""
    return submissions.withColumn("kind", F.lit(SUBMIT)).unionByName(messages, allowMissingColumns=True)


def run_jobs(spark: SparkSession, folder: str, factory: Callable[[], Recogniser], settings: Settings, **options) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that runs the jobs of each micro-batch and writes all they leave behind.

    A micro-batch replaces its own part of every table, so it can be repeated.
    Headers come last and the other tables are read through them
    (`read_runs`): a micro-batch is seen whole or not at all. Images that a
    known cancel stops are not processed; a cancel that arrives later cuts
    their results when they are read, so the answers are the same. A job id is
    that of one submission.
    """

    def write(rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    def take(batch: DataFrame, batch_id: int) -> None:
        write(batch.where(F.col("kind") != SUBMIT).select("job_id", "kind", "ts", "error"), "messages", batch_id)
        submitted = batch.where(F.col("kind") == SUBMIT).select("job_id", "created_at", "images", "lang", "min_confidence")
        headers, images, rejected = create_jobs(submitted, settings)
        asked = submitted.select("job_id", "created_at", "lang", "min_confidence")
        write(images.join(asked, "job_id"), "images", batch_id)
        # From here on the images are read as stored: the submissions are parsed once for them.
        stored = spark.read.parquet(f"{folder}/images").where(F.col("batch") == batch_id).drop("batch")
        cancels = spark.read.schema(f"{MESSAGES}, batch int").parquet(f"{folder}/messages").where((F.col("kind") == CANCEL) & (F.col("batch") <= batch_id))
        write(process_job_images(_before_cancel(stored, cancels, settings), factory, settings, **options), "results", batch_id)
        write(rejected, "rejected", batch_id)
        write(headers.drop("images"), "headers", batch_id)

    return take


def _before_cancel(images: DataFrame, cancels: DataFrame, settings: Settings) -> DataFrame:
    """Images that start before the first of their job's cancels."""
    jobs = images.groupBy("job_id").agg(F.min("created_at").alias("_created"))
    first = cancels.join(jobs, "job_id").where(F.col("ts") >= F.col("_created")).groupBy("job_id").agg(F.min("ts").alias("_cancel"))
    start = image_start(F.col("created_at"), F.col("idx"), settings)
    return images.join(first, "job_id", "left").where(F.col("_cancel").isNull() | (start < F.col("_cancel"))).drop("_cancel", "created_at")


def read_runs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(headers, results, messages, rejected) of the micro-batches that are complete."""
    headers = spark.read.parquet(f"{folder}/headers")
    results = spark.read.parquet(f"{folder}/results").join(headers.select("job_id", "batch"), ["job_id", "batch"], "left_semi").drop("batch")
    messages = spark.read.schema(MESSAGES).parquet(f"{folder}/messages")
    return headers.drop("batch"), results, messages, spark.read.parquet(f"{folder}/rejected").drop("batch")
