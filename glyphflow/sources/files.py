"""Image files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphflow.operators.batch import accepted_items, with_item_names
from glyphflow.operators.validate import gate_of_size
from glyphflow.session import use_small_files
from glyphflow.settings import Settings


def scan_image_files(
    spark: SparkSession, path: str, glob: str | None = None, *, recursive: bool = False
) -> DataFrame:
    """Rows (path, modificationTime, length, content).

    Size tests on `length` are pushed into the scan, and `content` is not read unless it is selected.
    """
    use_small_files(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def file_name(path_column: str = "path"):
    return F.element_at(F.split(F.col(path_column), "/"), -1)


def scan_image_batch(files: DataFrame, settings: Settings, batch: str = "batch_id") -> DataFrame:
    """Files of accepted batches with idx in path order and a default for missing names.

    Takes scanned files with a batch column (usually the folder), but without
    content: numbering shuffles its rows. Contents are processed by path where
    they are read, see `files_to_process`, and joined as results.
    """
    named = files if "filename" in files.columns else files.withColumn("filename", file_name())
    return with_item_names(accepted_items(named, settings, ["path"], batch))


def files_to_process(files: DataFrame, settings: Settings, batch: str = "batch_id") -> DataFrame:
    """Files, with content, of the batches within the size limit.

    The oversize batches are found without reading contents and broadcast, so
    contents stay where they are read. The planner would guess the ids' size
    from that of all files, and shuffle the contents of many. There is at most
    one id for every `max_batch_size` + 1 files, whose list is in the driver.
    """
    keys = files.select(batch)
    sizes = keys.groupBy(batch).agg(F.count(F.lit(1)).alias("n"))
    oversize = sizes.where(gate_of_size(F.col("n"), settings).isNotNull()).select(batch)
    return files.join(F.broadcast(oversize), batch, "left_anti")
