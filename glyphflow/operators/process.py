"""Whole requests: decode, validate, recognise, normalise, and the answer each endpoint gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from glyphflow.functions.geometry import plan_resize
from glyphflow.functions.payload import decode_base64, detect_format, probe_dimensions
from glyphflow.operators.batch import item_error, rollup_status, with_item_names
from glyphflow.operators.normalise import build_error, build_response, check_output, normalise_images
from glyphflow.operators.recognise import Recogniser, recognise
from glyphflow.operators.validate import (
    classify_errors,
    confidence_out_of_range,
    error_code_of_text,
    gate_detail,
    gate_of_size,
    resolve_lang,
    resolve_min_confidence,
    validation_error,
)
from glyphflow.schemas import BATCH_ITEM
from glyphflow.settings import COUNTED_ERRORS, Settings
from glyphflow.sources.files import files_to_process, scan_image_batch
from glyphflow.sources.sinks import answer_json, response_json

Dimensions = Callable[[Column], Column]


def run_images(
    df: DataFrame,
    factory: Callable[[], Recogniser],
    settings: Settings,
    *,
    dimensions: Dimensions | None = None,
    planned_size: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Run rows with content, decode_error, lang, min_confidence and include_polygon up to their normalised results.

    `tasks` deals the rows to so many tasks before the recogniser. Adds n_bytes, problem (the text of the first failed step before the
    recogniser), error_code and error_message of the recogniser, seconds,
    results, summary and meta. Sizes come from the image header, and an image
    whose header cannot be read is unreadable; or from `dimensions`, which
    gives struct<width, height> of the content. With `planned_size` the
    recogniser is taken to scale large images down as `plan_resize` says.
    Nothing is shuffled.
    """
    content = F.col("content")
    if dimensions is None:
        # Only what passes the size rule is looked into, some of it outside the JVM.
        looked_at = F.when(F.length(content) <= settings.size_limit, content)
        sized = df.withColumn("_format", detect_format(looked_at))
        sized = sized.withColumn("_size", probe_dimensions(looked_at, F.col("_format")))
        readable = ~F.col("_format").isin("png", "bmp", "jpeg") | F.col("_size.width").isNotNull()
    else:
        sized = df.withColumn("_format", F.lit(None).cast("string")).withColumn("_size", dimensions(content))
        readable = None
    checked = (
        sized.withColumn("n_bytes", F.length("content"))
        .withColumn("problem", F.coalesce(F.col("decode_error"), validation_error(content, settings, readable)["message"]))
        .withColumn("content", F.when(F.col("problem").isNull(), content))
        # An image that failed a rule has the zero sizes of an error result.
        .withColumn("width", F.when(F.col("problem").isNull(), F.col("_size.width")).otherwise(0).cast("int"))
        .withColumn("height", F.when(F.col("problem").isNull(), F.col("_size.height")).otherwise(0).cast("int"))
    )
    if planned_size:
        checked = checked.withColumn("_plan", plan_resize(F.col("width"), F.col("height"), settings.max_image_pixels))
        checked = (
            checked.withColumn("was_resized", F.col("_plan.was_resized"))
            .withColumn("width", F.col("_plan.width").cast("int"))
            .withColumn("height", F.col("_plan.height").cast("int"))
            .drop("_plan")
        )
    return normalise_images(recognise(checked.drop("_format", "_size"), factory, tasks=tasks), settings)


def with_content(df: DataFrame, is_json: Column, *, payload: str = "payload", content: str = "content") -> DataFrame:
    """The bytes a row brings: the decoded `payload` of JSON requests, `content` itself of uploaded files."""
    text = df.withColumn(payload, F.when(is_json, F.col(payload)))
    decoded = decode_base64(text, payload, content="_decoded")
    return decoded.withColumn(content, F.when(is_json, F.col("_decoded")).otherwise(F.col(content))).drop("_decoded")


def process_single_requests(
    df: DataFrame, factory: Callable[[], Recogniser], settings: Settings, **options
) -> DataFrame:
    """Answer requests with endpoint, payload or content, lang, min_confidence and include_polygon.

    Adds status, error_code, http_status, error_detail, results, summary and meta.
    """
    done = run_images(with_content(df, F.col("endpoint") == "/ocr/json"), factory, settings, **options)
    # A result that breaks the response's own rules is answered like an image that cannot be processed.
    # Sizes and boxes are in order by construction, so what can break them is a confidence.
    odd = F.exists("raw", lambda page: F.coalesce(F.exists(page, lambda i: confidence_out_of_range(i["confidence"])), F.lit(False)))
    broken = F.col("problem").isNull() & F.col("error_code").isNull() & F.coalesce(odd, F.lit(False))
    done = done.withColumn("problem", F.when(broken, F.lit("confidence_range")).otherwise(F.col("problem")))
    before = error_code_of_text(F.col("endpoint"), F.col("problem"))
    coded = done.withColumn("error_code", F.coalesce(before, F.col("error_code"))).withColumn(
        "error_message", F.coalesce(F.col("problem"), F.col("error_message"), F.lit("OCR processing failed"))
    )
    status = F.when(F.col("error_code").isNull(), F.lit("success")).otherwise(F.lit("error"))
    return classify_errors(coded, settings).withColumn("status", status).drop("problem", "decode_error", "error_message")


def answer_single_requests(
    df: DataFrame, factory: Callable[[], Recogniser], settings: Settings, **options
) -> DataFrame:
    """Whole requests to the two single endpoints, from parameters to the answer's text.

    Expects request_id, endpoint, payload or content, the headers x_lang and
    x_min_confidence, and body_lang and body_min_confidence for JSON requests.
    Adds lang and min_confidence as resolved, what `process_single_requests`
    adds, `answer` (the response or the error document as JSON) and `outcome`,
    by which the request is counted; null where it is not.
    """
    is_json = F.col("endpoint") == "/ocr/json"
    lang = F.when(is_json, resolve_lang(F.col("x_lang"), F.col("body_lang"), settings)).otherwise(
        resolve_lang(F.col("x_lang"), None, settings)
    )
    threshold = F.when(
        is_json, resolve_min_confidence(F.col("x_min_confidence"), F.col("body_min_confidence"), settings)
    ).otherwise(resolve_min_confidence(F.col("x_min_confidence"), None, settings))
    asked = df.withColumns({"lang": lang, "min_confidence": threshold, "include_polygon": F.lit(settings.include_polygon)})
    done = process_single_requests(asked, factory, settings, **options)
    code = F.col("error_code")
    error = build_error(F.col("request_id"), code, F.col("error_detail"))
    response = build_response(F.col("request_id"), settings=settings)
    outcome = F.when(code.isNull(), F.lit("success")).when(code.isin(COUNTED_ERRORS), F.lit("error"))
    return done.withColumn("answer", answer_json(response, error)).withColumn("outcome", outcome)


def process_batch_items(
    df: DataFrame, factory: Callable[[], Recogniser], settings: Settings, *, is_json: bool = True, **options
) -> DataFrame:
    """Outcome of the items of accepted batches: status, error, results, summary and meta per item."""
    source = with_content(df, F.lit(True)) if is_json else df.withColumn("decode_error", F.lit(None).cast("string"))
    done = check_output(run_images(source, factory, settings, **options))
    # A response that breaks its own ranges is an item that cannot be processed.
    broken = F.when(F.col("error_code").isNull() & (F.size("violations") > 0), F.col("violations")[0])
    error = item_error(
        is_json=F.lit(is_json),
        decode_error=F.col("decode_error"),
        content_length=F.col("n_bytes"),
        validation_message=F.when(F.col("decode_error").isNull(), F.coalesce("problem", broken)),
        ocr_code=F.col("error_code"),
        ocr_message=F.col("error_message"),
        unexpected=F.lit(None).cast("string"),
        settings=settings,
    )
    return (
        done.withColumn("error", error)
        .withColumn("status", F.when(F.col("error").isNull(), F.lit("success")).otherwise(F.lit("error")))
        .drop("problem", "decode_error", "error_code", "error_message", "violations")
    )


def answer_batches(
    items: DataFrame, factory: Callable[[], Recogniser], settings: Settings, *, is_json: bool = True, **options
) -> DataFrame:
    """The answer to every batch request: batch_id, n_images, status, http_status and `answer` as JSON.

    Expects batch_id, idx, filename, payload or content, lang, min_confidence
    and include_polygon. A batch above the limit is rejected as a whole with an
    error document; the others list their items in order, each with its
    response or its error. Oversize batches are found without reading contents;
    a document holds at most the batch limit of items.
    """
    sizes = items.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_images"))
    code = gate_of_size(F.col("n_images"), settings)
    oversize = sizes.where(code.isNotNull())
    accepted = with_item_names(items).join(oversize.select("batch_id"), "batch_id", "left_anti")
    done = process_batch_items(accepted, factory, settings, is_json=is_json, **options)
    return _batch_documents(done, oversize, settings)


def answer_file_batches(files: DataFrame, factory: Callable[[], Recogniser], settings: Settings, **options) -> DataFrame:
    """The answer to every batch of uploaded files, as `answer_batches` gives it.

    Expects scanned files (path, content) with batch_id, lang, min_confidence,
    include_polygon, and filename where a file was given another name than its
    own. Files are numbered by path without their contents; contents are
    processed where they are read, and only outcomes are joined.
    """
    sizes = files.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_images"))
    oversize = sizes.where(gate_of_size(F.col("n_images"), settings).isNotNull())
    named = [c for c in ("filename",) if c in files.columns]
    items = scan_image_batch(files.select("path", "batch_id", *named), settings).select("path", "idx", "filename")
    done = process_batch_items(files_to_process(files, settings).drop(*named), factory, settings, is_json=False, **options)
    return _batch_documents(done.drop("content", "raw").join(items, "path"), oversize, settings)


def _batch_documents(done: DataFrame, oversize: DataFrame, settings: Settings) -> DataFrame:
    """Response documents of processed batches and error documents of those above the limit."""
    code = gate_of_size(F.col("n_images"), settings)
    request_id = F.col("batch_id").cast("string")
    data = F.when(F.col("error").isNull(), build_response(request_id, settings=settings))
    item = F.struct("filename", "status", data.alias("data"), "error").cast(BATCH_ITEM)
    packed = done.select("batch_id", "idx", "status", item.alias("item")).groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "item"))).alias("items"),
        F.count(F.lit(1)).alias("n_images"),
        F.count_if(F.col("status") == "success").alias("n_success"),
    )
    status = rollup_status(F.col("n_success"), F.col("n_images") - F.col("n_success"))
    document = F.struct(
        request_id.alias("request_id"), F.col("status"), F.transform("items", lambda x: x["item"]).alias("results")
    )
    answered = packed.withColumn("status", status).select(
        "batch_id", "n_images", "status", F.lit(200).alias("http_status"), response_json(document).alias("answer")
    )
    error = build_error(request_id, code, gate_detail(F.col("n_images"), settings))
    rejected = oversize.select(
        "batch_id", "n_images", F.lit("rejected").alias("status"), F.lit(400).alias("http_status"), response_json(error).alias("answer")
    )
    return answered.unionByName(rejected)


def process_job_images(
    job_images: DataFrame, factory: Callable[[], Recogniser], settings: Settings, **options
) -> DataFrame:
    """Outcome per image of running jobs: job_id, idx, filename, status, error, results, summary, meta.

    Expects job_id, idx, payload, lang and min_confidence. Images do not
    depend on each other, so they run in parallel wherever their rows are.
    """
    source = decode_base64(job_images, "payload").withColumn("include_polygon", F.lit(settings.include_polygon))
    done = run_images(source, factory, settings, **options)
    failed_ocr = F.when(F.col("error_code").isNotNull(), F.coalesce("error_message", F.lit("OCR failed")))
    error = F.coalesce(F.concat(F.lit("Processing error: "), F.col("decode_error")), F.col("problem"), failed_ocr)
    return done.select(
        "job_id",
        "idx",
        F.concat(F.lit("image_"), F.col("idx").cast("string")).alias("filename"),
        F.when(error.isNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"),
        error.alias("error"),
        F.col("decode_error").isNotNull().alias("decode_failed"),
        "results",
        "summary",
        "meta",
        "seconds",
        "called",
        "lang",
        "error_code",
    )
