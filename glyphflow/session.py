"""Session helpers: defaults for tests and bench, and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "glyphflow") -> SparkSession:
    """A local session for tests and bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    tune(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> None:
    """Session settings the operators count on.

    All times are UTC and rendered at the boundary only. A shuffled join may
    use a hash map instead of a sort where every partition of the smaller side
    has been measured to fit. Arrow batches are small, because rows may carry images.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
    # A join side with a hot key is split while it runs, also where an aggregate above needs another shuffle then.
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    use_small_batches(spark)


# Rows per Arrow batch where rows carry images: a batch must fit a Python worker.
IMAGES_PER_BATCH = 64


def use_small_batches(spark: SparkSession, rows: int = IMAGES_PER_BATCH) -> None:
    """Lower the Arrow batch size of the session before image bytes are sent to Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


# What opening a small file counts in bytes when files are dealt to tasks: 512 of them to a task, not 32. Bytes still bound a task.
FILE_OPEN_BYTES = 256 * 1024
# Folders or files are listed by at most so many tasks, not by one each.
LISTING_TASKS = 96


def use_small_files(spark: SparkSession) -> None:
    """Fewer tasks for listing and reading many small files: starting a task costs more than what it does. Values that were set stay."""
    for name, default, value in (
        ("spark.sql.files.openCostInBytes", "4194304b", FILE_OPEN_BYTES),
        ("spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000", LISTING_TASKS),
    ):
        if spark.conf.get(name) == default:
            spark.conf.set(name, str(value))


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder the session names for checkpoints.

    A machine-local folder is used only when the setting is missing and the
    session itself is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = os.path.join(tempfile.gettempdir(), "glyphflow-work")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    For results that several later steps use: they are computed once, and a
    lost executor costs a re-read instead of the whole lineage.
    """
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
