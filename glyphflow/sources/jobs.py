"""Job documents: reading a folder of them, and an append-only store with upserts and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphflow.operators.jobs import alive_jobs, latest_version, lookup_job, lookup_jobs
from glyphflow.schemas import JOB_DOCUMENT
from glyphflow.settings import Settings


def scan_job_documents(
    spark: SparkSession, path: str, *, one_per_file: bool = True, glob: str = "*.json"
) -> DataFrame:
    """All readable job documents; broken ones are skipped."""
    return (
        spark.read.schema(JOB_DOCUMENT)
        .option("multiLine", one_per_file)
        .option("mode", "DROPMALFORMED")
        .option("pathGlobFilter", glob)
        .json(path)
        .where(F.col("job_id").isNotNull())
    )


def append_versions(documents: DataFrame, path: str, version: int) -> None:
    """Upsert: append whole documents under a version number; the newest version of a job counts.

    Re-running the same version replaces it, so a repeated micro-batch changes nothing.
    """
    documents.withColumn("deleted", F.lit(False)).write.mode("overwrite").parquet(f"{path}/version={version}")


def append_deletes(ids: DataFrame, documents_schema, path: str, version: int) -> None:
    """Delete: append tombstones. Deleting an unknown job is fine."""
    columns = [
        F.col("job_id") if f.name == "job_id" else F.lit(None).cast(f.dataType).alias(f.name)
        for f in documents_schema.fields
    ]
    ids.select("job_id").distinct().select(*columns, F.lit(True).alias("deleted")).write.mode("overwrite").parquet(
        f"{path}/version={version}"
    )


def read_store(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Current documents: the newest version per job, without the deleted ones."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    current = latest_version(reader.parquet(path))
    return current.where(~F.col("deleted")).drop("deleted", "version")


def compact_store(spark: SparkSession, path: str, version: int, schema=None) -> None:
    """Write the current documents as a version of their own and empty the older ones, so that reading stays in proportion to them.

    `version` is above all others. The old versions are emptied from the
    oldest on: a deletion goes after what it deletes, so that a reader never
    sees a deleted document again, also if this is broken off and repeated.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    versions = reader.parquet(path)
    old = sorted(r["version"] for r in versions.select("version").distinct().collect() if r["version"] < version)
    append_versions(read_store(spark, path, schema), path, version)
    nothing = versions.drop("version").limit(0)
    for number in old:
        spark.createDataFrame([], nothing.schema).write.mode("overwrite").parquet(f"{path}/version={number}")


def write_by_day(state: DataFrame, path: str) -> None:
    """Job states in a folder for each day of creation; those without a creation in one of their own.

    One shuffle by day and a share of the ids, so that a busy day is not one task's.
    """
    dated = state.withColumn("day", F.to_date("created_at"))
    dated.repartition("day", F.pmod(F.xxhash64("job_id"), F.lit(16))).write.mode("overwrite").partitionBy("day").parquet(path)


def read_alive(spark: SparkSession, path: str, schema, as_of: Column, settings: Settings) -> DataFrame:
    """Jobs whose time to live, from creation, has not passed; only the folders of days that can hold such are read.

    A job without a creation time does not expire.
    """
    table = spark.read.schema(schema).parquet(path)
    first_day = F.to_date(as_of - F.expr(f"INTERVAL '{settings.job_ttl_hours}' HOUR"))
    return alive_jobs(table.where(F.col("day").isNull() | (F.col("day") >= first_day)), as_of, settings).drop("day")


def read_days_of(spark: SparkSession, path: str, schema, days: DataFrame) -> DataFrame:
    """Jobs created on the days of a table (day); other folders are not read. The days are few, and sent to all tasks."""
    return spark.read.schema(schema).parquet(path).join(F.broadcast(days.select("day").distinct()), "day", "left_semi").drop("day")


def write_lookup(state: DataFrame, table: str, path: str, buckets: int = 64) -> None:
    """Job states as a table made for lookups: bucketed and sorted by id, each file with a bloom filter on it."""
    writer = state.write.mode("overwrite").bucketBy(buckets, "job_id").sortBy("job_id")
    writer.option("parquet.bloom.filter.enabled#job_id", "true").option("path", path).saveAsTable(table)


def find_job(spark: SparkSession, table: str, job_id: str) -> DataFrame:
    """One job: one bucket is opened, and row groups whose filter does not know the id are skipped."""
    return lookup_job(spark.table(table), job_id)


def find_jobs(spark: SparkSession, table: str, ids: DataFrame) -> DataFrame:
    """Many jobs, unknown ids with nulls. Only the ids are shuffled, to the buckets; the table stays where it is."""
    return lookup_jobs(ids, spark.table(table))
