"""Start streams over the session's shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphflow.session import work_folder
from glyphflow.sources.jobs import append_versions

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with changelogs in the checkpoint, not on the heap; sessions are merged before the shuffle."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")


def start_files(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Write a stream as Parquet until the available input is used up."""
    return (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed rows of each micro-batch as a new version; read them back with `read_store`."""
    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: append_versions(batch, path, batch_id))
        .start()
    )


class BatchTable:
    """An append-only table of micro-batches: batch n replaces what an earlier try of batch n has written."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        # So that the folder can be read before the first batch.
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def before(self, batch_id: int) -> DataFrame:
        """Rows of the batches before this one."""
        return read_batches(self.spark, self.path, self.schema, F.col("batch") < batch_id)


def read_batches(spark: SparkSession, path: str, schema: str, only: Column | None = None) -> DataFrame:
    """Rows of a `BatchTable`."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    return (rows if only is None else rows.where(only)).drop("batch")


def run_batches(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand all available input to `take`, one micro-batch at a time."""
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()
    )


def run_to_files(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all available input and read its output back."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    folder = work_folder(spark, label)
    start_files(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
