"""Small frame helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.session import work_folder

# Rows per Arrow batch: texts can be long, and a batch is held whole by JVM and worker.
ROWS_PER_BATCH = 1_000


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Let Arrow batches of the session hold at most `rows` rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared work folder and read it back.

    Later steps then read files instead of the lineage, so that a lost executor
    costs one stage, and every reader sees the same rows.
    """
    spark = df.sparkSession
    path = work_folder(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sent_if_small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, which must be cheap to count, marked for broadcast if it has at most `rows` rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
