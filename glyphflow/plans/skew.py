"""Windows and running totals that survive one key holding a large share of the rows.

Aggregations need no help: Spark combines them before the shuffle. Joins are
split by the adaptive planner (see `session.tune`). What it cannot split is a
window, because every row of a key is ordered in one task. The functions below
find keys with very many rows (one combined count over the key column) and cut
the order of those keys into pieces, as many as their rows ask for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from glyphflow.session import materialise

# A key with fewer rows than this fits one task; hot keys are cut into pieces of about this many.
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, key: str, min_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (key, n) of all keys with at least `min_rows` rows: at most one for every `min_rows` rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)


def pieces_of(rows: int, piece_rows: int) -> int:
    return max(2, math.ceil(rows / piece_rows))


def order_bucket(df: DataFrame, order: str, buckets: int, name: str, sample: DataFrame | None = None) -> DataFrame:
    """Add an int that grows with `order` and splits the rows of `sample` (default all) into about equal shares.

    The split points are literals, so a lost task recomputes the same buckets.
    """
    as_double = F.col(order).cast("double")
    probs = [i / buckets for i in range(1, buckets)]
    points = None
    if probs:
        source = df if sample is None else sample
        points = source.agg(F.percentile_approx(as_double, probs, max(10_000, 10 * buckets))).first()[0]
    if not points:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *sorted(set(points)), float("inf")]
    keyed = df.withColumn("_order_key", as_double)
    bucketed = Bucketizer(splits=splits, inputCol="_order_key", outputCol=name).transform(keyed)
    return bucketed.withColumn(name, F.col(name).cast("int")).drop("_order_key")


def with_segment(df: DataFrame, key: str, order: str, min_rows: int = HOT_ROWS) -> tuple[DataFrame, bool]:
    """Add `_segment`: 0 for ordinary keys, a piece of the order for hot ones. Also tells whether any key is hot.

    Keys must not be null.
    """
    hot = materialise(hot_keys(df, key, min_rows), "hot-keys")
    rows = hot.agg(F.sum("n").alias("n")).first()["n"]
    if not rows:
        return df.withColumn("_segment", F.lit(0)), False
    marked = df.join(hot.select(key, F.lit(True).alias("_hot")), key, "left").select(*df.columns, "_hot")
    bucketed = order_bucket(marked, order, pieces_of(rows, min_rows), "_bucket", marked.where("_hot"))
    return bucketed.withColumn("_segment", F.when(F.col("_hot"), F.col("_bucket")).otherwise(0)).drop("_bucket", "_hot"), True


def previous_value(
    df: DataFrame, key: str, order: str, value: str, name: str, *, min_rows: int = HOT_ROWS
) -> DataFrame:
    """`lag(value)` per key, with hot keys cut into segments along a unique numeric `order`."""
    segmented, any_hot = with_segment(df, key, order, min_rows)
    inner = Window.partitionBy(key, "_segment").orderBy(order)
    lagged = segmented.withColumn(name, F.lag(value).over(inner))
    if not any_hot:
        return lagged.drop("_segment")
    # One row per (key, segment). A segment starts from the last value before it.
    ends = segmented.groupBy(key, "_segment").agg(
        F.max_by(F.struct(value), order).alias("_last"), F.min(order).alias("_first")
    )
    carry = F.lag("_last").over(Window.partitionBy(key).orderBy("_segment"))
    carries = ends.select(key, "_segment", "_first", carry.alias("_carry")).where(F.col("_carry").isNotNull())
    # Joined on what the window has partitioned by already.
    return (
        lagged.join(carries, [key, "_segment"], "left")
        .withColumn(name, F.when(F.col(order) == F.col("_first"), F.col("_carry")[value]).otherwise(F.col(name)))
        .drop("_segment", "_first", "_carry")
    )


def position_in_group(
    df: DataFrame,
    key: str,
    order_by: Sequence[str | Column],
    split_on: str,
    name: str,
    *,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """0-based position per key. `split_on` is a number that never decreases along `order_by`."""
    segmented, any_hot = with_segment(df, key, split_on, min_rows)
    inner = Window.partitionBy(key, "_segment").orderBy(*order_by)
    numbered = segmented.withColumn(name, F.row_number().over(inner) - 1)
    if not any_hot:
        return numbered.drop("_segment")
    sizes = segmented.groupBy(key, "_segment").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_segment", F.sum("_n").over(before).alias("_offset")).where(F.col("_offset") > 0)
    return (
        numbered.join(offsets, [key, "_segment"], "left")
        .withColumn(name, F.col(name) + F.coalesce(F.col("_offset"), F.lit(0)))
        .drop("_segment", "_offset")
    )


def running_total(
    df: DataFrame, order: str, value: str, name: str, *, bucket_rows: int = HOT_ROWS
) -> DataFrame:
    """Running sum of `value` over the whole table along a unique numeric `order`.

    Each bucket of the order is summed on its own; only the bucket totals, one
    row per bucket, go through a single task. The input is used several times,
    so it is written out first.
    """
    written = materialise(df, "running-total")
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, pieces_of(written.count(), bucket_rows))
    bucketed = order_bucket(written, order, buckets, "_bucket")
    totals = bucketed.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.withColumn("_running", F.sum(value).over(inner))
        .join(offsets, "_bucket")
        .withColumn(name, F.col("_running") + F.col("_offset"))
        .drop("_bucket", "_running", "_offset")
    )
