"""Batches: items in order, one error per bad item, one status per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from glyphflow.functions.text import default_name
from glyphflow.operators.validate import gate_detail, gate_of_size
from glyphflow.settings import Settings


def rollup_status(n_success: Column, n_error: Column) -> Column:
    """success without errors, partial with some successes, else error."""
    return F.when(n_error == 0, F.lit("success")).when(n_success > 0, F.lit("partial")).otherwise(F.lit("error"))


def batch_status(items: DataFrame, settings: Settings, batch: str = "batch_id") -> DataFrame:
    """One row per batch from item rows with status; a batch above the limit is rejected as a whole.

    One combined aggregation, so a batch of any size costs one row per map task.
    """
    counts = items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(F.col("status") == "error").alias("n_error"),
    )
    code = gate_of_size(F.col("n_images"), settings)
    return counts.select(
        batch,
        "n_images",
        F.when(code.isNull(), F.col("n_success")).otherwise(0).alias("n_success"),
        F.when(code.isNull(), F.col("n_error")).otherwise(0).alias("n_error"),
        F.when(code.isNull(), rollup_status(F.col("n_success"), F.col("n_error")))
        .otherwise(F.lit("rejected"))
        .alias("status"),
        code.alias("error_code"),
        gate_detail(F.col("n_images"), settings).alias("error_detail"),
        F.when(code.isNull(), F.lit(200)).otherwise(400).alias("http_status"),
    )


def accepted_items(
    items: DataFrame, settings: Settings, order_by: list[str | Column], batch: str = "batch_id"
) -> DataFrame:
    """Items of the batches within the size limit, with `idx` (0-based position) and `n_images`.

    The rank filter lets Spark cut each batch to limit + 1 rows before the
    shuffle, so an oversize batch, which is rejected anyway, moves next to nothing.
    """
    limit = settings.max_batch_size
    ranked = items.withColumn("_rank", F.row_number().over(Window.partitionBy(batch).orderBy(*order_by)))
    return (
        ranked.where(F.col("_rank") <= limit + 1)
        .withColumn("n_images", F.count(F.lit(1)).over(Window.partitionBy(batch)))
        .where(F.col("n_images") <= limit)
        .withColumn("idx", F.col("_rank") - 1)
        .drop("_rank")
    )


def with_item_names(items: DataFrame, filename: str = "filename") -> DataFrame:
    """Fill missing file names with image_<idx>."""
    return items.withColumn(filename, default_name(F.col(filename), F.col("idx")))


def item_error(
    *,
    is_json: Column,
    decode_error: Column,
    content_length: Column,
    validation_message: Column,
    ocr_code: Column,
    ocr_message: Column,
    unexpected: Column,
    settings: Settings,
) -> Column:
    """Error text of one batch item, or null. The first failing step decides."""
    return (
        F.when(decode_error.isNotNull(), F.concat(F.lit("Image processing error: "), decode_error))
        .when(
            F.coalesce(content_length, F.lit(0)) == 0,
            F.when(is_json, F.lit("Image data is empty")).otherwise(F.lit("Image file is empty")),
        )
        .when(
            content_length > settings.size_limit,
            F.lit(f"Image exceeds maximum size of {settings.size_limit_text}"),
        )
        .when(validation_message.isNotNull(), F.concat(F.lit("Image processing error: "), validation_message))
        .when(ocr_code.isNotNull(), F.coalesce(ocr_message, F.lit("OCR failed")))
        .when(unexpected.isNotNull(), F.concat(F.lit("Unexpected error: "), unexpected))
    )


def union_outcomes(successes: DataFrame, errors: DataFrame) -> DataFrame:
    """Success and error rows in one table; columns one side lacks become null."""
    return successes.unionByName(errors, allowMissingColumns=True)


def ordered_results(items: DataFrame, fields: list[str], batch: str = "batch_id") -> DataFrame:
    """Per batch the items as an array in input order. Takes accepted items, so an array has at most the limit."""
    packed = F.array_sort(F.collect_list(F.struct("idx", *fields)))
    return items.groupBy(batch).agg(packed.alias("_items")).select(
        batch, F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("results")
    )
