"""From raw detections to results, summaries and responses.

Two forms of the same rules. The array form keeps one row per image and works
inside the row: no shuffle, usable on streams. The long form keeps one row per
detection, for detections stored as a table of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from glyphflow.functions.geometry import (
    axis_values,
    bbox_of_extent,
    extent,
    extent_of_axes,
    has_box,
    normalised_bbox,
    polygon_or_empty,
)
from glyphflow.functions.text import char_count, model_name, ms_from_seconds
from glyphflow.operators.validate import output_violations
from glyphflow.schemas import BBOX, DETECTION, ERROR_RESPONSE, META, OCR_RESPONSE, POLYGON, RAW_ITEM, SUMMARY
from glyphflow.settings import Settings

RESULT_TYPE = "text"
# Detections per row of a response; an image with more is published in several parts.
PART_ROWS = 1_000


# ---- array form -----------------------------------------------------------------------------


def flat_items(raw: Column) -> Column:
    """All usable items of all pages in order; a missing confidence counts as 1.0."""
    items = F.flatten(F.filter(F.coalesce(raw, F.array().cast("array<array<%s>>" % RAW_ITEM.simpleString())),
                               lambda page: page.isNotNull()))
    usable = F.filter(items, lambda item: item.isNotNull() & item["text"].isNotNull())
    return F.transform(
        usable,
        lambda item: F.struct(
            item["polygon"].alias("polygon"),
            item["text"].alias("text"),
            F.coalesce(item["confidence"], F.lit(1.0)).alias("confidence"),
        ),
    )


def flatten_detections(images: DataFrame, *keep: str) -> DataFrame:
    """One row per usable item: the kept columns, det_idx, text, confidence, polygon."""
    return images.select(*keep, F.posexplode(flat_items(F.col("raw"))).alias("det_idx", "item")).select(
        *keep, "det_idx", "item.text", "item.confidence", "item.polygon"
    )


def _detections(items: Column) -> Column:
    """Items turned into results, in steps so that no polygon is walked more often than needed."""
    with_axes = F.transform(
        items,
        lambda i: F.struct(
            i["text"].alias("text"),
            i["confidence"].alias("confidence"),
            i["polygon"].alias("polygon"),
            axis_values(i["polygon"], 0).alias("xs"),
            axis_values(i["polygon"], 1).alias("ys"),
        ),
    )
    with_extent = F.transform(
        with_axes,
        lambda i: F.struct(
            i["text"].alias("text"),
            i["confidence"].alias("confidence"),
            i["polygon"].alias("polygon"),
            extent_of_axes(i["xs"], i["ys"]).alias("extent"),
        ),
    )
    return F.transform(
        with_extent,
        lambda i: F.struct(
            i["text"].alias("text"),
            i["confidence"].alias("confidence"),
            bbox_of_extent(i["extent"]).alias("bbox"),
            normalised_bbox(i["extent"], F.col("width"), F.col("height")).alias("bbox_normalized"),
            F.lit(RESULT_TYPE).alias("type"),
            polygon_or_empty(i["polygon"], F.col("include_polygon")).alias("polygon"),
        ),
    )


def normalise_images(images: DataFrame, settings: Settings) -> DataFrame:
    """Add results, summary, meta, error_code and error_message to one row per image.

    Expects raw, width, height, lang, min_confidence and include_polygon;
    uses seconds, was_resized, error_code and error_message when present.
    """
    df = images
    for name, default in [
        ("seconds", F.lit(0.0)),
        ("was_resized", F.lit(False)),
        ("error_code", F.lit(None).cast("string")),
        ("error_message", F.lit(None).cast("string")),
    ]:
        if name not in df.columns:
            df = df.withColumn(name, default)

    df = df.withColumn("_items", flat_items(F.col("raw")))
    df = df.withColumn(
        "_kept", F.filter("_items", lambda item: item["confidence"] >= F.col("min_confidence"))
    )
    # A box cannot be put in shares of a zero size: the image as a whole has failed.
    zero_size = ((F.col("width") == 0) | (F.col("height") == 0)) & F.exists(
        "_kept", lambda item: has_box(item["polygon"])
    )
    failed = F.col("error_code").isNull() & F.coalesce(zero_size, F.lit(False))
    df = df.withColumn("_zero_size", failed)
    df = df.withColumn("error_code", F.when(F.col("_zero_size"), F.lit("ocr_failed")).otherwise(F.col("error_code")))
    df = df.withColumn(
        "error_message",
        F.when(F.col("_zero_size"), F.lit("float division by zero")).otherwise(F.col("error_message")),
    )
    ok = F.col("error_code").isNull()
    results = _detections(F.col("_kept"))
    df = df.withColumn("results", F.when(ok, results).otherwise(F.array()).cast(_results_type()))
    return (
        df.withColumn("summary", summary_of(F.col("results")))
        .withColumn("meta", meta_struct(settings, ok))
        .drop("_items", "_kept", "_zero_size")
    )


def _results_type() -> str:
    return f"array<{DETECTION.simpleString()}>"


def summary_of(results: Column) -> Column:
    n = F.size(results)
    total = F.aggregate(results, F.lit(0.0), lambda acc, r: acc + r["confidence"])
    return F.struct(
        n.cast("bigint").alias("total_lines"),
        F.aggregate(results, F.lit(0).cast("bigint"), lambda acc, r: acc + char_count(r["text"])).alias(
            "total_characters"
        ),
        F.when(n > 0, total / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0)).alias("avg_confidence"),
    ).cast(SUMMARY)


def meta_struct(settings: Settings, ok: Column) -> Column:
    """Meta of a row with lang, seconds, width, height and was_resized; error rows have zero sizes."""
    return F.struct(
        F.lit(settings.engine).alias("engine"),
        F.lit(settings.engine_version).alias("engine_version"),
        model_name(F.col("lang"), settings.model_prefix).alias("model"),
        F.col("lang").alias("lang"),
        F.when(ok, ms_from_seconds(F.coalesce(F.col("seconds"), F.lit(0.0)))).otherwise(0).alias(
            "inference_time_ms"
        ),
        F.when(ok, F.col("width")).otherwise(0).cast("int").alias("image_width"),
        F.when(ok, F.col("height")).otherwise(0).cast("int").alias("image_height"),
        F.when(ok, F.col("was_resized")).otherwise(False).alias("was_resized"),
    ).cast(META)


def attach_resized(df: DataFrame, was_resized: Column, *, literal_async: bool = False) -> DataFrame:
    """Set meta.was_resized. With `literal_async` it stays false, as job results have it."""
    value = F.lit(False) if literal_async else was_resized
    return df.withColumn("meta", F.col("meta").withField("was_resized", F.coalesce(value, F.lit(False))))


def error_results(df: DataFrame, code: Column, message: Column, settings: Settings) -> DataFrame:
    """Rows with lang turned into full error rows: no results, zero meta, zero summary."""
    never = F.lit(False)
    return (
        df.withColumn("seconds", F.lit(0.0))
        .withColumn("was_resized", never)
        .withColumn("width", F.lit(0))
        .withColumn("height", F.lit(0))
        .withColumn("error_code", code)
        .withColumn("error_message", message)
        .withColumn("results", F.array().cast(_results_type()))
        .withColumn("summary", summary_of(F.col("results")))
        .withColumn("meta", meta_struct(settings, never))
    )


def build_error(request_id: Column, code: Column, detail: Column) -> Column:
    """Error document of a failed request; null where there is no code."""
    document = F.struct(code.alias("error"), F.coalesce(detail, code).alias("detail"), request_id.cast("string").alias("request_id"))
    return F.when(code.isNotNull(), document.cast(ERROR_RESPONSE))


def build_response(request_id: Column, *, status: str = "success", settings: Settings = Settings()) -> Column:
    """Response struct from results, meta and summary, with a default for every missing part."""
    text = lambda r: F.coalesce(r["text"], F.lit(""))

    def box(value: Column) -> Column:
        zeros = F.array(F.lit(0.0), F.lit(0.0))
        return F.struct(
            F.coalesce(value["top_left"], zeros).alias("top_left"),
            F.coalesce(value["bottom_right"], zeros).alias("bottom_right"),
        ).cast(BBOX)

    results = F.transform(
        F.coalesce(F.col("results"), F.array().cast(_results_type())),
        lambda r: F.struct(
            text(r).alias("text"),
            F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"),
            box(r["bbox"]).alias("bbox"),
            box(r["bbox_normalized"]).alias("bbox_normalized"),
            F.coalesce(r["type"], F.lit(RESULT_TYPE)).alias("type"),
            F.coalesce(r["polygon"], F.array().cast(POLYGON)).alias("polygon"),
        ),
    )
    meta, summary = F.col("meta"), F.col("summary")
    return F.struct(
        request_id.cast("string").alias("request_id"),
        F.lit(status).alias("status"),
        F.struct(
            F.coalesce(meta["engine"], F.lit(settings.engine)).alias("engine"),
            F.coalesce(meta["engine_version"], F.lit(settings.engine_version)).alias("engine_version"),
            F.coalesce(meta["model"], F.lit("unknown")).alias("model"),
            F.coalesce(meta["lang"], F.lit("en")).alias("lang"),
            F.coalesce(meta["inference_time_ms"], F.lit(0)).alias("inference_time_ms"),
            meta["image_width"].alias("image_width"),
            meta["image_height"].alias("image_height"),
            F.coalesce(meta["was_resized"], F.lit(False)).alias("was_resized"),
        ).alias("meta"),
        results.alias("results"),
        F.struct(
            F.coalesce(summary["total_lines"], F.lit(0)).alias("total_lines"),
            F.coalesce(summary["total_characters"], F.lit(0)).alias("total_characters"),
            F.coalesce(summary["avg_confidence"], F.lit(0.0)).alias("avg_confidence"),
        ).alias("summary"),
    ).cast(OCR_RESPONSE)


# ---- long form ------------------------------------------------------------------------------


def kept_detections(
    detections: DataFrame, images: DataFrame, image_columns: list[str]
) -> DataFrame:
    """Detections at or above the threshold of their image, with the named image columns.

    Detections of an image that has very many are split over tasks by the adaptive planner.
    """
    wanted = list(dict.fromkeys(["image_id", "min_confidence", *image_columns]))
    joined = detections.join(images.select(*wanted), "image_id")
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0))
    return joined.withColumn("confidence", confidence).where(confidence >= F.col("min_confidence"))


def normalise_detections(
    detections: DataFrame, images: DataFrame, describe: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Kept detections with bbox, bbox_normalized, type, polygon and failed columns.

    `failed` marks boxes that cannot be put in shares because their image has a zero size.
    `describe` adds what detections do not bring, as polygons made of a few numbers, to the kept ones: a polygon
    is several times as wide as all the rest, and need not travel to its image then.
    """
    kept = kept_detections(detections, images, ["width", "height", "include_polygon"])
    if describe is not None:
        kept = describe(kept)
    polygon = F.col("polygon")
    return (
        kept.withColumn("_extent", extent(polygon))
        .withColumn("bbox", bbox_of_extent(F.col("_extent")))
        .withColumn("bbox_normalized", normalised_bbox(F.col("_extent"), F.col("width"), F.col("height")))
        .withColumn("type", F.lit(RESULT_TYPE))
        .withColumn("failed", has_box(polygon) & ((F.col("width") == 0) | (F.col("height") == 0)))
        .withColumn("polygon", polygon_or_empty(polygon, F.col("include_polygon")))
        .drop("_extent")
    )


def summary_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_lines"),
        F.sum(char_count(F.col("text"))).alias("total_characters"),
        F.avg("confidence").alias("avg_confidence"),
    ]


def image_summaries(kept: DataFrame) -> DataFrame:
    """One summary row per image that has kept detections (combined before the shuffle)."""
    return kept.groupBy("image_id").agg(*summary_aggregates())


def with_summary(images: DataFrame, kept: DataFrame) -> DataFrame:
    """Every image with its summary; an image without detections gets zeros."""
    return (
        images.join(image_summaries(kept), "image_id", "left")
        .withColumn("total_lines", F.coalesce("total_lines", F.lit(0)))
        .withColumn("total_characters", F.coalesce("total_characters", F.lit(0)))
        .withColumn("avg_confidence", F.coalesce("avg_confidence", F.lit(0.0)))
    )


def check_output(df: DataFrame) -> DataFrame:
    """Add `violations` to rows with results, summary and meta; non-empty means quarantine."""
    worst = F.array_max(F.transform("results", lambda r: r["confidence"]))
    least = F.array_min(F.transform("results", lambda r: r["confidence"]))
    out_of_range = F.when(least < 0, least).otherwise(worst)
    bad_box = F.exists(
        "results",
        lambda r: (F.size(r["bbox"]["top_left"]) != 2) | (F.size(r["bbox"]["bottom_right"]) != 2),
    )
    violations = output_violations(
        out_of_range,
        F.col("summary.avg_confidence"),
        [F.col("meta.image_width"), F.col("meta.image_height"), F.col("meta.inference_time_ms"),
         F.col("summary.total_lines"), F.col("summary.total_characters")],
        [],
    )
    return df.withColumn(
        "violations", F.concat(violations, F.array_compact(F.array(F.when(bad_box, F.lit("bbox_length")))))
    )


def response_parts(
    images: DataFrame, detections: DataFrame, settings: Settings, *, part_rows: int = PART_ROWS, **options
) -> DataFrame:
    """Responses of images whose detections are a table with det_idx: image_id, part, results, summary, meta.

    Results stay in order. One row holds at most `part_rows` of them, so an
    image of any size never has to fit one row; `part` counts along det_idx.
    """
    kept = normalise_detections(detections, images, **options)
    part = F.floor(F.col("det_idx") / part_rows).cast("int")
    item = F.struct("det_idx", F.struct(*DETECTION.fieldNames()).cast(DETECTION).alias("result"))
    parts = (
        kept.where(~F.col("failed"))
        .groupBy("image_id", part.alias("part"))
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select("image_id", "part", F.transform("_items", lambda x: x["result"]).alias("results"))
    )
    df = images
    for name, default in [("seconds", F.lit(0.0)), ("was_resized", F.lit(False))]:
        if name not in df.columns:
            df = df.withColumn(name, default)
    totals = kept.groupBy("image_id").agg(*summary_aggregates(), F.bool_or("failed").alias("_failed"))
    df = df.join(totals, "image_id", "left")
    ok = ~F.coalesce(F.col("_failed"), F.lit(False))
    zeros = {"total_lines": 0, "total_characters": 0, "avg_confidence": 0.0}
    summary = F.struct(*[F.coalesce(F.when(ok, F.col(n)), F.lit(z)).alias(n) for n, z in zeros.items()])
    heads = df.select(
        "image_id",
        F.when(~ok, F.lit("ocr_failed")).alias("error_code"),
        summary.cast(SUMMARY).alias("summary"),
        meta_struct(settings, ok).alias("meta"),
    )
    no_results = F.array().cast(_results_type())
    # A failed image matches no part, so it keeps one row without results.
    joined = heads.join(
        parts.withColumnRenamed("image_id", "_image_id"),
        (F.col("image_id") == F.col("_image_id")) & F.col("error_code").isNull(),
        "left",
    )
    return (
        joined.drop("_image_id")
        .withColumn("part", F.coalesce("part", F.lit(0)))
        .withColumn("results", F.coalesce(F.col("results"), no_results))
    )
