"""Every operator as a query over the driver tables; keys match `oracle.ORACLE`."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glyphflow.functions.geometry import plan_resize
from glyphflow.functions.payload import (
    colour_action,
    decode_base64,
    detect_format,
    dimension_reason,
    encode_base64,
    extension_of_mime,
    extension_of_path,
    header_dimensions,
    is_allowed_extension,
    png_colour_mode,
    probe_dimensions,
)
from glyphflow.functions.text import iso_z_format, iso_z_parse, job_id_of, model_name, ms_from_seconds
from glyphflow.operators import batch, jobs, metrics, normalise, process, runs, validate
from glyphflow.operators.recognise import inference_calls
from glyphflow.plans.tables import DOCUMENTS, EVENTS, LANGS, MODEL_TYPES, Tables, hex_number, pick, reversed_hex
from glyphflow.session import materialise, tune, work_folder
from glyphflow.settings import Settings
from glyphflow.sources import files, requests as request_source
from glyphflow.sources import jobs as job_source
from glyphflow.sources.sinks import answer_json, response_json, write_metrics_text, write_small_files
from glyphflow.streaming import jobs as stream_jobs, runs as stream_runs
from glyphflow.streaming.lifecycle import EXPIRED, stream_lifecycle
from glyphflow.streaming.metrics import stream_request_metrics
from glyphflow.streaming.normalise import stream_normalise
from glyphflow.streaming.once import stream_fixed_expiry, stream_submitted_once
from glyphflow.streaming.queue import DEPTHS, carried_depth, stream_queue_deltas
from glyphflow.streaming.run import read_batches, run_batches, run_to_files, upsert_batches, use_rocksdb

SETTINGS = Settings()
# Derived payloads are short; this limit lets some of them be too large.
SMALL_SETTINGS = Settings(max_image_bytes=10_000)
AS_OF = "2024-01-30 12:00:00"
# While the last jobs of the event table are being created.
ALIVE_AT = "2024-01-04 06:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tune(spark)
        return build(Tables(spark, folder))

    QUERIES[build.__name__] = run
    return build


def rounded(name: str, digits: int = 6) -> Column:
    """Rounded for comparison. Sums of decimals end just beside a tie in an order-dependent way; the shift clears it."""
    return F.round(F.col(name) + 1e-9, digits).alias(name.split(".")[-1])


# ---- results --------------------------------------------------------------------------------


@query
def r_image_summary(t: Tables) -> DataFrame:
    """One row per image with its line count, character count and mean confidence."""
    images = t.images().select("image_id", "min_confidence")
    found = t.detections().select("image_id", "text", "confidence", "line_no", "part_key")
    kept = normalise.kept_detections(found, images, [])
    out = normalise.with_summary(images, kept)
    return out.select("image_id", "total_lines", "total_characters", rounded("avg_confidence"))


@query
def r_bbox(t: Tables) -> DataFrame:
    """Kept detections with their box, the box in shares of the image, and the polygon size."""
    df = normalise.normalise_detections(t.lines(), t.images(), describe=lambda kept: t.with_polygons(t.with_texts(kept)))

    def axis(box: str, corner: str, i: int, name: str) -> Column:
        return F.col(box)[corner][i].alias(name)

    return df.select(
        "image_id", "line_no", "part_key", "supp_key", "text", "confidence", "type",
        axis("bbox", "top_left", 0, "x_min"), axis("bbox", "top_left", 1, "y_min"),
        axis("bbox", "bottom_right", 0, "x_max"), axis("bbox", "bottom_right", 1, "y_max"),
        axis("bbox_normalized", "top_left", 0, "nx_min"), axis("bbox_normalized", "top_left", 1, "ny_min"),
        axis("bbox_normalized", "bottom_right", 0, "nx_max"), axis("bbox_normalized", "bottom_right", 1, "ny_max"),
        F.size("polygon").alias("n_points"),
    )


@query
def r_flatten(t: Tables) -> DataFrame:
    """Nested pages of items as one row per usable detection."""
    df = normalise.flatten_detections(t.raw_images(), "image_id")
    return df.select("image_id", "det_idx", "text", "confidence", F.size("polygon").alias("n_points"))


def _normalised_columns(df: DataFrame) -> DataFrame:
    boxes = F.transform("results", lambda r: r["bbox"]["bottom_right"][0])
    shares = F.transform("results", lambda r: r["bbox_normalized"]["bottom_right"][1])
    polygons = F.size(F.filter("results", lambda r: F.size(r["polygon"]) > 0))
    return df.select(
        "image_id", "error_code", "error_message",
        F.col("summary.total_lines"), F.col("summary.total_characters"), rounded("summary.avg_confidence"),
        F.col("meta.model"), F.col("meta.image_width"),
        polygons.alias("n_polygons"),
        F.array_max(boxes).alias("x_max"),
        F.array_max(shares).alias("ny_max"),
    )


@query
def r_normalise(t: Tables) -> DataFrame:
    """Whole images normalised inside their row, failing ones included."""
    return _normalised_columns(normalise.normalise_images(t.raw_images(), SETTINGS))


@query
def r_response_json(t: Tables) -> DataFrame:
    """The response document of every image, or its error document, as JSON text."""
    df = normalise.normalise_images(t.raw_images(), SETTINGS)
    summary = F.col("summary").withField("avg_confidence", rounded("summary.avg_confidence"))
    request_id = F.concat(F.lit("req_"), F.col("image_id").cast("string"))
    response = normalise.build_response(request_id, settings=SETTINGS)
    error = normalise.build_error(request_id, F.col("error_code"), F.col("error_message"))
    return df.withColumn("summary", summary).select("image_id", answer_json(response, error).alias("response"))


@query
def r_response_parts(t: Tables) -> DataFrame:
    """Responses put together from a detection table, at most four results per part."""
    found = t.with_texts(t.lines(with_index=True))
    parts = normalise.response_parts(t.images(), found, SETTINGS, part_rows=4, describe=t.with_polygons)
    texts = F.transform("results", lambda r: r["text"])
    return parts.select(
        "image_id", "part", F.size("results").alias("n_results"),
        F.array_join(texts, "|").alias("texts"),
        F.col("summary.total_lines"), rounded("summary.avg_confidence"), F.col("meta.model"),
    )


@query
def r_error_rows(t: Tables) -> DataFrame:
    """Success rows and full error rows of all images in one table."""
    images = t.images()
    fine = images.where(F.col("status") == "success")
    found = t.detections().select("image_id", "text", "confidence", "line_no", "part_key")
    kept = normalise.kept_detections(found, fine, [])
    plan = plan_resize(F.col("width"), F.col("height"), SETTINGS.max_image_pixels)
    good = (
        normalise.with_summary(fine, kept)
        .withColumn("seconds", F.lit(0.0))
        .withColumn("was_resized", F.lit(False))
        .withColumn("_plan", plan)
    )
    good = good.withColumn("width", F.col("_plan.width")).withColumn("height", F.col("_plan.height"))
    good = good.withColumn("meta", normalise.meta_struct(SETTINGS, F.lit(True)))
    good = normalise.attach_resized(good, F.col("_plan.was_resized")).select(
        "image_id", "status", "meta", F.struct("total_lines", "total_characters", "avg_confidence").alias("summary")
    )
    bad = normalise.error_results(
        images.where(F.col("status") == "error"), F.lit("ocr_failed"),
        F.concat(F.lit("engine failed on "), F.col("image_id").cast("string")), SETTINGS,
    ).select("image_id", "status", "meta", "summary", "error_code", "error_message")
    return batch.union_outcomes(good, bad).select(
        "image_id", "status", "error_code", "error_message",
        F.col("meta.model"), F.col("meta.image_width"), F.col("meta.image_height"), F.col("meta.was_resized"),
        F.col("summary.total_lines"), rounded("summary.avg_confidence"),
    )


@query
def v_output_check(t: Tables) -> DataFrame:
    """Broken output constraints of derived values that partly leave their range."""
    confidence = F.round(F.abs("l_discount") * 12, 6)
    polygon = F.array(F.lit(0.0), F.lit(0.0))
    short = F.when(F.col("l_linenumber") == 7, F.array(F.lit(0.0))).otherwise(polygon)
    box = F.struct(polygon.alias("top_left"), short.alias("bottom_right"))
    broken = validate.output_violations(confidence, F.round(F.abs("l_tax") * 15, 6), [F.col("l_quantity") - 3], [box])
    return t.read("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(broken, ",").alias("violations"),
        F.size(broken).alias("n_violations"),
    )


# ---- batches --------------------------------------------------------------------------------


@query
def b_batch_status(t: Tables) -> DataFrame:
    """One status per batch; oversize batches are rejected."""
    return batch.batch_status(t.images(), SETTINGS)


@query
def b_batch_results(t: Tables) -> DataFrame:
    """Ordered results of the accepted batches."""
    items = batch.with_item_names(batch.accepted_items(t.images(), SETTINGS, ["image_id"]))
    packed = batch.ordered_results(items, ["filename", "status"])
    line = F.transform("results", lambda r: F.concat(r["filename"], F.lit("="), r["status"]))
    return packed.select("batch_id", F.size("results").alias("n_results"), F.array_join(line, ",").alias("results"))


def _with_bytes(payloads: DataFrame) -> DataFrame:
    """The bytes an endpoint works on: decoded text of JSON requests, the file itself otherwise."""
    brought = payloads.withColumn("_bytes", F.col("content"))
    return process.with_content(brought, F.col("endpoint") == "/ocr/json", content="_bytes")


@query
def b_item_errors(t: Tables) -> DataFrame:
    """Error text of every payload as a batch item."""
    is_json = F.col("endpoint") == "/ocr/json"
    df = _with_bytes(t.payloads())
    doc = F.col("payload_id")
    error = batch.item_error(
        is_json=is_json,
        decode_error=F.col("decode_error"),
        content_length=F.length("_bytes"),
        validation_message=validate.validation_error(F.col("_bytes"), SMALL_SETTINGS)["message"],
        ocr_code=F.when(doc % 17 == 0, F.lit("ocr_failed")),
        ocr_message=F.when(doc % 2 == 0, F.lit("engine stopped")),
        unexpected=F.when(doc % 19 == 0, F.lit("disk gone")),
        settings=SMALL_SETTINGS,
    )
    return df.select("payload_id", F.when(error.isNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"),
                     error.alias("error"))


# ---- validation -----------------------------------------------------------------------------


@query
def v_decode(t: Tables) -> DataFrame:
    """Base64 payloads decoded, and encoded again as data URIs."""
    df = decode_base64(t.payloads().select("payload_id", "payload"), "payload")
    content = F.col("content")
    return df.select(
        "payload_id",
        F.length(content).alias("n_bytes"),
        F.md5(content).alias("content_md5"),
        F.col("decode_error").alias("error"),
        F.md5(encode_base64(content, "image/png").cast("binary")).alias("uri_md5"),
    )


@query
def v_format(t: Tables) -> DataFrame:
    """Format by magic bytes, extension by MIME type, and the file-extension filter."""
    found = detect_format(F.col("content"))
    mime = F.concat(F.lit("image/"), found)
    suffix = pick([".jpg", ".JPEG", ".png", ".gif", ".tif", ".webp", "", ".txt"], F.col("payload_id"))
    path = F.concat(F.lit("in/doc_"), F.col("payload_id").cast("string"), suffix)
    return t.payloads().select(
        "payload_id",
        found.alias("format"),
        extension_of_mime(mime).alias("extension"),
        extension_of_path(path).alias("path_extension"),
        is_allowed_extension(path).alias("is_allowed"),
    )


@query
def v_chain(t: Tables) -> DataFrame:
    """Field checks, the first broken rule of each payload, and the endpoint's answer to it."""
    is_json = F.col("endpoint") == "/ocr/json"
    confidence = (F.col("payload_id") % 13) / 10
    field = F.when(is_json, validate.check_single_request(F.col("payload"), confidence)).otherwise(
        validate.check_confidence(confidence)
    )
    df = _with_bytes(t.payloads().withColumn("violation", field))
    found = detect_format(F.col("_bytes"))
    size = header_dimensions(F.col("_bytes"), found)
    readable = F.when(found.isin("png", "bmp"), size["width"].isNotNull())
    problem = validate.validation_error(F.col("_bytes"), SMALL_SETTINGS, readable)
    df = df.withColumn("error_message", F.coalesce(F.col("decode_error"), problem["message"]))
    df = df.withColumn("error_code", validate.error_code_of_text(F.col("endpoint"), F.col("error_message")))
    df = df.select(
        "payload_id", "endpoint", "violation", "error_code", "error_message", F.length("_bytes").alias("n_bytes")
    )
    return validate.classify_errors(df, SMALL_SETTINGS).select(
        "payload_id", "endpoint", "violation", "error_code", "http_status", "error_detail"
    )


@query
def v_params(t: Tables) -> DataFrame:
    """Parameters by precedence: header, body, setting."""
    event = F.col("event_id")
    x_lang = F.when(event % 3 == 0, F.lit("")).when(event % 3 == 1, pick(LANGS, event))
    body_lang = F.when(event % 4 == 0, F.lit("")).otherwise(F.lit("auto"))
    x_conf = F.when(event % 5 == 0, F.lit(0.0)).when(event % 5 == 1, (event % 10) / 10)
    body_conf = (event % 11) / 20
    is_json = event % 2 == 0
    return t.read("events").select(
        "event_id",
        F.when(is_json, validate.resolve_lang(x_lang, body_lang, SETTINGS))
        .otherwise(validate.resolve_lang(x_lang, None, SETTINGS))
        .alias("lang"),
        F.when(is_json, validate.resolve_min_confidence(x_conf, body_conf, SETTINGS))
        .otherwise(validate.resolve_min_confidence(x_conf, None, SETTINGS))
        .alias("min_confidence"),
    )


@query
def v_resize_plan(t: Tables) -> DataFrame:
    """Target size of images above the pixel limit, and the colour action."""
    modes = pick(["RGB", "RGBA", "L", "1", "P", "CMYK", "LA"], F.col("image_id"))
    # A fifth of the limit, so that some images exceed it at every scale.
    limit = SETTINGS.max_image_pixels // 5
    plan = plan_resize(F.col("width"), F.col("height"), limit)
    return t.images().withColumn("_plan", plan).select(
        "image_id", "width", "height", F.col("_plan.was_resized"),
        F.col("_plan.width").alias("new_width"), F.col("_plan.height").alias("new_height"),
        modes.alias("mode"), colour_action(modes).alias("action"),
    )


@query
def v_dimensions(t: Tables) -> DataFrame:
    """Sizes read back from PNG, BMP and JPEG headers put before each document's text."""
    doc = F.col("doc_id")
    width, height = 1 + doc % 3000, 1 + F.col("n_chars") % 2000
    png_kind = F.substring(F.lit("000203040602"), (doc % 6 * 2 + 1).cast("int"), F.lit(2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex_number(width, 8), hex_number(height, 8),
                   F.lit("08"), png_kind, F.lit("000000"))
    stored = F.when(doc % 8 == 1, 2**32 - height).otherwise(height)
    bmp = F.concat(F.lit("424D"), F.repeat(F.lit("00"), F.lit(16)), reversed_hex(width), reversed_hex(stored))
    jpeg = F.concat(F.lit("FFD8FFE00008000000000000FFFE0006"), hex_number(doc % 65536, 4), F.lit("C000FFC0001108"),
                    hex_number(height, 4), hex_number(width, 4), F.lit("03"))
    header = (
        F.when(doc % 4 == 0, png).when(doc % 4 == 1, bmp).when(doc % 4 == 2, jpeg)
        .when(doc % 8 == 3, F.lit("49492A00")).otherwise(F.lit("FFD8FFD9"))
    )
    df = t.read("documents").select("doc_id", F.concat(F.unhex(header), F.encode("text", "utf-8")).alias("content"))
    df = df.withColumn("format", detect_format(F.col("content")))
    df = df.withColumn("_size", probe_dimensions(F.col("content"), F.col("format")))
    mode = F.when(F.col("format") == "png", png_colour_mode(F.col("content")))
    return df.select(
        "doc_id", "format", F.col("_size.width"), F.col("_size.height"),
        dimension_reason(F.col("format"), F.col("_size")).alias("reason"),
        mode.alias("mode"), colour_action(mode).alias("action"),
    )


@query
def v_blank(t: Tables) -> DataFrame:
    """Blank images by their brightness histogram."""
    return validate.blank_images(t.pixel_histogram())


# ---- metrics --------------------------------------------------------------------------------


def _metered(t: Tables) -> DataFrame:
    return t.requests().where(metrics.is_metered(F.col("outcome")))


def _calls(t: Tables) -> DataFrame:
    return t.requests().where(F.col("status") == "success").select("model", "device", F.col("duration"))


@query
def m_counter(t: Tables) -> DataFrame:
    """Metered requests by endpoint, lang and status."""
    return metrics.count_requests(_metered(t))


@query
def m_duration_hist(t: Tables) -> DataFrame:
    """Request durations in cumulative buckets."""
    return metrics.request_durations(_metered(t))


@query
def m_batch_hist(t: Tables) -> DataFrame:
    """Batch sizes in cumulative buckets."""
    return metrics.batch_sizes(_metered(t))


@query
def m_inference_hist(t: Tables) -> DataFrame:
    """Durations of successful model calls in cumulative buckets."""
    return metrics.inference_times(_calls(t))


@query
def m_metered(t: Tables) -> DataFrame:
    """Requests by endpoint and outcome with whether they are counted, and their time in whole milliseconds."""
    return (
        t.requests()
        .withColumn("is_metered", metrics.is_metered(F.col("outcome")))
        .groupBy("endpoint", "outcome", "is_metered")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(ms_from_seconds(F.col("duration")).cast("bigint")).alias("ms"))
    )


def _gauge(t: Tables) -> DataFrame:
    ready = F.when(F.col("value") > 34, 1).otherwise(0)
    source = t.read("events").select(pick(MODEL_TYPES, F.col("user_id")).alias("model_type"), "event_id", ready.alias("ready"))
    return metrics.last_value(source, ["model_type"], "ready", "event_id")


@query
def m_gauge(t: Tables) -> DataFrame:
    """Readiness set last, per model type."""
    return _gauge(t)


@query
def m_queue_depth(t: Tables) -> DataFrame:
    """Pending jobs after each opening and closing of a job."""
    return metrics.queue_depth(t.job_events()).select("seq", "job_id", "delta", "depth")


@query
def m_queue_depth_literal(t: Tables) -> DataFrame:
    """The gauge as it drifts when normal ends are not counted and running cancels are counted twice."""
    return metrics.queue_depth(t.job_events(), literal=True).select("seq", "job_id", "delta", "depth")


@query
def m_exposition(t: Tables) -> DataFrame:
    """Exposition text of all families, one line per row."""
    return _exposition(t).select("line")


def _exposition(t: Tables) -> DataFrame:
    flagged = t.requests().withColumn("metered", metrics.is_metered(F.col("outcome")))
    flagged = flagged.withColumn("called", F.col("status") == "success")
    # One row per combination of labels, read by four families.
    rollup = materialise(metrics.request_rollup(flagged), "request-rollup")
    depth = metrics.queue_deltas(t.job_events()).agg(F.sum("delta").cast("double").alias("value"))
    return metrics.exposition({
        **metrics.families_of_rollup(rollup),
        "ocr_job_queue_depth": (depth, []),
        "model_ready": (_gauge(t), ["model_type"]),
    })


@query
def s_metrics_text(t: Tables) -> DataFrame:
    """The exposition as a written text: its files, in the order of their names, are one document."""
    folder = work_folder(t.spark, "metrics-text")
    write_metrics_text(_exposition(t), folder)
    written = t.spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value")
    ordered = F.array_sort(F.collect_list(F.struct("name", "value")))
    body = F.rtrim(F.array_join(F.transform(ordered, lambda x: x["value"]), ""), F.lit("\n"))
    lines = written.agg(F.split(body, "\n").alias("lines"))
    return lines.select(
        F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join(F.array_sort("lines"), "\n")).alias("lines_md5"),
        F.array_join(F.filter("lines", lambda x: F.startswith(x, F.lit("#"))), "\n").alias("heads"),
    )


# ---- jobs -----------------------------------------------------------------------------------


@query
def j_create(t: Tables) -> DataFrame:
    """Headers of the jobs made of each customer's orders."""
    sized = t.read("orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_images"), F.min(F.col("o_orderdate").cast("timestamp")).alias("created_at")
    )
    keyed = sized.withColumn("job_id", job_id_of(F.lit("customer"), F.col("o_custkey")))
    text = iso_z_format(F.col("created_at"))
    return jobs.job_headers(keyed, SETTINGS).select(
        "job_id", "status", text.alias("created_at"), "status_url",
        iso_z_format(F.col("estimated_completion")).alias("estimated_completion"),
        "processed", "total",
        (iso_z_parse(text) == F.col("created_at")).alias("parses_back"),
    )


def _state_columns(state: DataFrame) -> DataFrame:
    return state.select(
        "job_id", "status",
        *[iso_z_format(F.col(c)).alias(c) for c in ("created_at", "started_at", "completed_at", "last_event_at")],
        "processed", "error", "last_seq",
    )


@query
def j_fold(t: Tables) -> DataFrame:
    """State of every job after its events; each field takes its last write."""
    return _state_columns(jobs.fold_job_events(t.job_events()))


@query
def j_fold_terminal_wins(t: Tables) -> DataFrame:
    """The same with the first terminal state final."""
    return _state_columns(jobs.fold_job_events(t.job_events(), terminal_wins=True))


@query
def j_transitions(t: Tables) -> DataFrame:
    """Every status event with the status before it and whether the step is legal."""
    return jobs.status_transitions(t.job_events()).select("job_id", "seq", "kind", "prev_status", "is_legal")


def _accepted_job_items(t: Tables) -> DataFrame:
    return batch.accepted_items(t.job_items(), SETTINGS, ["image_id"], "job_id")


@query
def j_progress(t: Tables) -> DataFrame:
    """Progress after each image."""
    return jobs.running_progress(_accepted_job_items(t)).select("job_id", "idx", "image_id", "processed", "total")


@query
def j_progress_writes(t: Tables) -> DataFrame:
    """The progress a poller can see when images that cannot be decoded write none of their own."""
    items = _accepted_job_items(t).withColumn("decode_failed", F.col("image_id") % 6 == 0)
    return jobs.progress_writes(items).select("job_id", "step", "processed", "total")


@query
def j_outcome(t: Tables) -> DataFrame:
    """Final state of each job by the errors of its images."""
    return jobs.job_outcome(_accepted_job_items(t))


@query
def j_pending(t: Tables) -> DataFrame:
    """Images of running jobs without a result yet."""
    items = _accepted_job_items(t).select("job_id", "idx", "image_id")
    results = items.where(F.col("image_id") % 3 != 0)
    return jobs.pending_images(items, results, jobs.fold_job_events(t.job_events(), with_error=False))


def _cancel_ids(t: Tables) -> DataFrame:
    return t.read("customer").select(F.concat(F.lit("job_"), F.col("c_custkey").cast("string")).alias("job_id"))


@query
def j_cancel(t: Tables) -> DataFrame:
    """Outcome of a cancel request for every customer's job, unknown ones included."""
    return jobs.cancel_jobs(_cancel_ids(t), jobs.fold_job_events(t.job_events(), with_error=False))


@query
def j_known(t: Tables) -> DataFrame:
    """Requested ids split into known and unknown jobs."""
    state = jobs.fold_job_events(t.job_events(), with_error=False).select("job_id")
    ids = _cancel_ids(t)
    found = jobs.known_jobs(ids, state).withColumn("is_known", F.lit(True))
    return found.unionByName(jobs.unknown_jobs(ids, state).withColumn("is_known", F.lit(False)))


@query
def j_effective_images(t: Tables) -> DataFrame:
    """Images started before their job was cancelled."""
    items = _accepted_job_items(t).select("job_id", "idx", "image_id", "start_ts")
    return jobs.effective_images(items, t.job_events()).select(
        "job_id", "idx", "image_id", iso_z_format(F.col("cancel_ts")).alias("cancel_at")
    )


@query
def j_status_view(t: Tables) -> DataFrame:
    """The answer to a status request for every customer's job."""
    items = _accepted_job_items(t).where(F.col("image_id") % 3 != 0)
    items = items.withColumn("filename", F.concat(F.lit("image_"), F.col("idx").cast("string")))
    results = batch.ordered_results(items, ["filename", "status"], "job_id")
    totals = _accepted_job_items(t).groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))
    view = jobs.job_status_view(_cancel_ids(t), jobs.fold_job_events(t.job_events()), results, totals)
    names = F.transform("results", lambda r: F.concat(r["filename"], F.lit("="), r["status"]))
    return view.withColumn("results", F.array_join(names, ","))


@query
def j_ttl_fixed(t: Tables) -> DataFrame:
    """Jobs with whether their time to live, counted from creation, has passed."""
    state = jobs.fold_job_events(t.job_events(), with_error=False)
    view = jobs.expiry_view(state, F.lit(AS_OF).cast("timestamp"), SETTINGS)
    return view.select("job_id", iso_z_format(F.col("created_at")).alias("since"), "is_expired", "http_status")


@query
def j_ttl_sliding(t: Tables) -> DataFrame:
    """The same counted from the last event."""
    state = jobs.fold_job_events(t.job_events(), with_error=False)
    view = jobs.expiry_view(state, F.lit(AS_OF).cast("timestamp"), SETTINGS, sliding=True)
    return view.select("job_id", iso_z_format(F.col("last_event_at")).alias("since"), "is_expired", "http_status")


@query
def j_list(t: Tables) -> DataFrame:
    """The first hundred jobs by descending id, of which the failed ones are shown."""
    return jobs.list_jobs(jobs.fold_job_events(t.job_events(), with_error=False), "failed").select("job_id", "status")


@query
def j_list_filter_first(t: Tables) -> DataFrame:
    """The first hundred failed jobs by descending id."""
    return jobs.list_jobs(jobs.fold_job_events(t.job_events(), with_error=False), "failed", filter_first=True).select("job_id", "status")


def digest_recogniser() -> Callable[[bytes], list]:
    """A stand-in for a model: three lines that depend on every byte of the image."""

    def run(data: bytes) -> list:
        if len(data) % 17 == 0:
            raise ValueError(f"engine stopped at {len(data)}")
        box = [[0.0, 0.0], [64.0, 0.0], [64.0, 16.0], [0.0, 16.0]]
        digest = hashlib.md5(data).hexdigest()
        return [None, [[box, (digest, (len(data) * 7 % 101) / 100)], [box[:3], (str(len(data)), 0.5)], [box, "plain"], []]]

    return run


def _processed(t: Tables) -> DataFrame:
    doc = F.col("payload_id")
    images = t.payloads().select(
        F.concat(F.lit("job_"), F.floor(doc / 10).cast("string")).alias("job_id"),
        (doc % 10).cast("int").alias("idx"),
        "payload", "lang",
        ((doc % 5) / 10).alias("min_confidence"),
    )
    return process.process_job_images(images, digest_recogniser, SETTINGS)


def _answered(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(
        *columns,
        F.col("summary.total_lines"), F.col("summary.total_characters"), rounded("summary.avg_confidence"),
        F.array_join(F.transform("results", lambda r: r["text"]), ",").alias("texts"),
        F.col("meta.image_width"), F.col("meta.image_height"),
    )


@query
def r_single_requests(t: Tables) -> DataFrame:
    """The answer to every payload sent as a request of its own."""
    requests = t.payloads().withColumn("min_confidence", (F.col("payload_id") % 5) / 10)
    requests = requests.withColumn("include_polygon", F.col("payload_id") % 2 == 0)
    done = process.process_single_requests(requests, digest_recogniser, SETTINGS)
    return _answered(done, "payload_id", "status", "error_code", "http_status", "error_detail")


def _single_answers(t: Tables) -> DataFrame:
    doc = F.col("payload_id")
    requests = t.payloads().select(
        F.concat(F.lit("req_"), doc.cast("string")).alias("request_id"), "payload_id", "endpoint", "payload", "content",
        F.when(doc % 3 == 0, F.lit("")).when(doc % 3 == 1, F.lit("de")).alias("x_lang"), F.col("lang").alias("body_lang"),
        F.when(doc % 4 == 0, 0.0).when(doc % 4 == 1, 0.6).alias("x_min_confidence"), ((doc % 5) / 10).alias("body_min_confidence"),
    )
    return process.answer_single_requests(requests, digest_recogniser, SETTINGS)


@query
def r_single_answers(t: Tables) -> DataFrame:
    """The answer document of every payload sent as a request with headers and body values."""
    done = _single_answers(t)
    field = lambda path: F.get_json_object("answer", path)
    return done.select(
        "payload_id", "http_status", "outcome", "lang", "min_confidence", field("$.request_id").alias("request_id"),
        F.when(F.col("error_code").isNotNull(), F.col("answer")).alias("error_document"),
        field("$.status").alias("status"), field("$.summary.total_lines").cast("long").alias("total_lines"),
        field("$.meta.model").alias("model"), field("$.results[0].text").alias("first_text"),
    )


@query
def m_answered(t: Tables) -> DataFrame:
    """Requests counted by the outcome that answering them produced."""
    # Filtered after the count: the optimizer would repeat the error rules in a filter before it.
    counted = metrics.count_requests(_single_answers(t).withColumn("status", F.col("outcome")))
    return counted.where(metrics.is_metered(F.col("status")))


@query
def m_answered_observed(t: Tables) -> DataFrame:
    """The same counts, observed while the answers are written."""
    labels = {"endpoint": ["/ocr", "/ocr/json"], "lang": LANGS, "outcome": ["success", "error"]}
    answers, observation = metrics.observe_counts(_single_answers(t), labels, metrics.is_metered(F.col("outcome")))
    answers.select("payload_id", "http_status", "answer").write.parquet(work_folder(t.spark, "answers"))
    return metrics.observed_counts(t.spark, observation, labels).withColumnRenamed("outcome", "status")


@query
def b_batch_run(t: Tables) -> DataFrame:
    """Every payload as an item of a batch of ten: outcome per item."""
    doc = F.col("payload_id")
    items = t.payloads().select(
        F.floor(doc / 10).alias("batch_id"), (doc % 10).cast("int").alias("idx"), "payload", "content", "lang",
        ((doc % 5) / 10).alias("min_confidence"), F.lit(True).alias("include_polygon"),
    )
    done = process.process_batch_items(items, digest_recogniser, SETTINGS)
    return _answered(done, "batch_id", "idx", "status", "error")


@query
def b_documents(t: Tables) -> DataFrame:
    """The answer document of every batch of payloads; the first batches are above the limit."""
    doc = F.col("payload_id")
    items = t.payloads().select(
        F.when(doc < 60, F.floor(doc / 30)).otherwise(F.floor(doc / 10)).alias("batch_id"),
        F.when(doc < 60, doc % 30).otherwise(doc % 10).cast("int").alias("idx"),
        F.when(doc % 3 == 0, F.concat(F.lit("file_"), doc.cast("string"))).alias("filename"), "payload", "content", "lang",
        ((doc % 5) / 10).alias("min_confidence"), F.lit(True).alias("include_polygon"),
    )
    done = process.answer_batches(items, digest_recogniser, SETTINGS)
    field = lambda path: F.get_json_object("answer", path)
    parsed = F.from_json("answer", "results array<struct<filename:string,status:string,data:struct<request_id:string,summary:struct<total_lines:bigint>>,error:string>>")
    listed = F.transform(parsed["results"], lambda r: F.concat_ws("|", r["filename"], r["status"], r["data"]["request_id"], r["data"]["summary"]["total_lines"].cast("string"), r["error"]))
    return done.select(
        "batch_id", "n_images", "status", "http_status", field("$.request_id").alias("request_id"), field("$.error").alias("error"),
        field("$.detail").alias("detail"), F.array_join(listed, ";").alias("results"),
    )


@query
def j_run(t: Tables) -> DataFrame:
    """Every payload decoded, validated, recognised and normalised."""
    return _answered(_processed(t), "job_id", "idx", "filename", "status", "error")


@query
def j_run_inferences(t: Tables) -> DataFrame:
    """Model calls that succeeded, by model and device."""
    calls = inference_calls(_processed(t), SETTINGS)
    return calls.groupBy("model", "device").agg(F.count(F.lit(1)).alias("n"))


def _write_states_by_day(t: Tables) -> tuple[str, str]:
    """Job states by day of creation: the folder and the schema."""
    state = jobs.fold_job_events(t.job_events(), with_error=False)
    folder = work_folder(t.spark, "jobs-by-day")
    job_source.write_by_day(state, folder)
    return folder, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema) + ", day date"


@query
def j_alive(t: Tables) -> DataFrame:
    """Jobs that are alive, read from the folders of the days that can hold them."""
    folder, schema = _write_states_by_day(t)
    alive = job_source.read_alive(t.spark, folder, schema, F.lit(ALIVE_AT).cast("timestamp"), SETTINGS)
    return alive.select("job_id", "status", iso_z_format(F.col("created_at")).alias("created_at"))


@query
def j_days(t: Tables) -> DataFrame:
    """Jobs created on days that saw a failure with a text; the folders of other days are not read."""
    folder, schema = _write_states_by_day(t)
    days = t.job_events().where(F.col("error").isNotNull() & (F.col("seq") % 5 == 0)).select(F.to_date("ts").alias("day"))
    return job_source.read_days_of(t.spark, folder, schema, days).select("job_id", "status")


@query
def j_lookup(t: Tables) -> DataFrame:
    """The state of every customer's job, looked up in a bucketed table."""
    name = f"jobs_{uuid.uuid4().hex}"
    state = _state_columns(jobs.fold_job_events(t.job_events()))
    job_source.write_lookup(state, name, work_folder(t.spark, "job-lookup"), buckets=8)
    return job_source.find_jobs(t.spark, name, _cancel_ids(t)).select("job_id", "status", "processed", "error")


# ---- whole job runs ---------------------------------------------------------------------------


def _job_number(doc: Column) -> Column:
    """Ten payloads a job; the first two jobs are above the limit."""
    return F.when(doc < 60, F.floor(doc / 30)).otherwise(F.floor(doc / 10))


def _job_created(job_id: Column) -> Column:
    return F.timestamp_seconds(F.lit(1_704_067_200) + F.substring(job_id, F.lit(5), F.length(job_id)).cast("bigint") * 60)


def _job_requests(t: Tables) -> DataFrame:
    """Job requests as documents: request_id, images, min_confidence."""
    doc = F.col("payload_id")
    packed = t.payloads().groupBy(_job_number(doc).alias("n")).agg(F.array_sort(F.collect_list(F.struct("payload_id", "payload"))).alias("items"))
    return packed.select(
        F.concat(F.lit("job_"), F.col("n").cast("string")).alias("request_id"), F.transform("items", lambda i: i["payload"]).alias("images"),
        ((F.col("n") % 5) / 10).alias("min_confidence"),
    )


def _job_messages(t: Tables) -> DataFrame:
    """Cancel requests and crashes: some before, during and after the job, some about no job, some of both."""
    n = F.col("n")
    numbers = t.read("documents").select(_job_number(F.col("doc_id")).alias("n")).distinct()
    job = F.concat(F.lit("job_"), n.cast("string"))
    at = lambda seconds: F.timestamp_seconds(F.lit(1_704_067_200) + n * 60 + seconds)
    message = lambda job, kind, ts, error: F.struct(job.alias("job_id"), F.lit(kind).alias("kind"), ts.alias("ts"), error.alias("error"))
    no_text = F.lit(None).cast("string")
    return numbers.select(F.explode(F.array_compact(F.array(
        F.when(n % 3 == 0, message(job, runs.CANCEL, at(n * 97 % 1500), no_text)),
        F.when(n % 6 == 0, message(job, runs.CANCEL, at(n * 31 % 1500), no_text)),
        F.when(n % 11 == 5, message(job, runs.CANCEL, at(F.lit(-5)), no_text)),
        F.when(n % 4 == 0, message(job, runs.CRASH, at(n * 61 % 1300), F.concat(F.lit("lost worker "), n.cast("string")))),
        F.when(n % 50 == 0, message(F.concat(F.lit("gone_"), n.cast("string")), runs.CANCEL, at(F.lit(60)), no_text)),
    ))).alias("m")).select("m.*")


def _run_columns(t: Tables, headers: DataFrame, results: DataFrame, messages: DataFrame) -> DataFrame:
    ids = _job_requests(t).select(F.col("request_id").alias("job_id")).unionByName(_job_messages(t).select("job_id")).distinct()
    view = runs.run_view(ids, headers, results, messages, SETTINGS)
    line = lambda r: F.concat_ws(":", r["filename"], r["status"], r["summary"]["total_lines"].cast("string"), r["error"])
    return view.withColumn("results", F.array_join(F.transform("results", line), ";"))


@query
def j_job_run(t: Tables) -> DataFrame:
    """The status answer of every job with its real results: run to the end, cancelled, crashed, or unknown."""
    requests = _job_requests(t).select(F.col("request_id").alias("job_id"), _job_created(F.col("request_id")).alias("created_at"), "images",
                                       F.lit("auto").alias("lang"), "min_confidence")
    headers, images, _ = jobs.create_jobs(requests, SETTINGS)
    asked = images.join(requests.drop("images"), "job_id")
    results = materialise(process.process_job_images(asked, digest_recogniser, SETTINGS), "job-results")
    return _run_columns(t, headers, results, _job_messages(t))


@query
def x_job_run(t: Tables) -> DataFrame:
    """The same from job requests and messages that arrive as files on a stream, a few at a time."""
    folder = work_folder(t.spark, "job-runs")
    _job_requests(t).write.json(f"{folder}/in")
    _job_messages(t).write.parquet(f"{folder}/messages-in")
    submissions = request_source.stream_submissions(t.spark, f"{folder}/in", t.files_per_trigger).select(
        F.col("request_id").alias("job_id"), _job_created(F.col("request_id")).alias("created_at"), "images", "lang", "min_confidence")
    reader = t.spark.readStream.schema(stream_runs.MESSAGES).option("maxFilesPerTrigger", t.files_per_trigger)
    stream = stream_runs.with_messages(submissions, reader.parquet(f"{folder}/messages-in"))
    run_batches(stream, stream_runs.run_jobs(t.spark, folder, digest_recogniser, SETTINGS), f"{folder}/checkpoint").awaitTermination()
    headers, results, messages, _ = stream_runs.read_runs(t.spark, folder)
    return _run_columns(t, headers, results, messages)


@query
def j_cancel_run(t: Tables) -> DataFrame:
    """The answer to each cancel request, by where the job's run was when it came."""
    doc = F.col("doc_id")
    headers = t.read("documents").groupBy(F.concat(F.lit("job_"), _job_number(doc).cast("string")).alias("job_id")).agg(F.count(F.lit(1)).alias("n_images"))
    headers = jobs.job_headers(headers.withColumn("created_at", _job_created(F.col("job_id"))), SETTINGS)
    answers = runs.cancel_answers(_job_messages(t), headers, SETTINGS)
    return answers.withColumn("ts", iso_z_format(F.col("ts")))


@query
def j_run_observed(t: Tables) -> DataFrame:
    """Model calls by model and device, observed while the job images are processed and written."""
    labels = {"model": [f"{SETTINGS.model_prefix}{lang}" for lang in LANGS], "device": [SETTINGS.device]}
    named = _processed(t).withColumns({"model": model_name(F.col("lang"), SETTINGS.model_prefix), "device": F.lit(SETTINGS.device)})
    done, observation = metrics.observe_counts(named, labels, F.col("called"))
    done.select("job_id", "idx", "status", "results").write.parquet(work_folder(t.spark, "job-results"))
    return metrics.observed_counts(t.spark, observation, labels, "n")


# ---- sources and stores ---------------------------------------------------------------------


def _file_folder(n: Column) -> Column:
    """Folders of 15, 20, 21 and 22 files in turn."""
    at = n % 78
    return F.floor(n / 78) * 4 + F.when(at < 15, 0).when(at < 35, 1).when(at < 56, 2).otherwise(3)


def _write_files(t: Tables, body: Column, per_file: int, label: str) -> str:
    """A file of every `per_file` documents, in batch folders; `body` is made of their `lines`."""
    line = F.struct("doc_id", F.concat_ws(" ", "doc_id", F.md5("text")).alias("line"))
    bodies = t.read("documents").groupBy(F.floor(F.col("doc_id") / per_file).alias("n")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    name = F.concat(F.lit("f"), F.lpad(F.col("n").cast("string"), 9, "0")).alias("name")
    folder = work_folder(t.spark, label)
    written = bodies.select(F.concat(F.lit("b"), _file_folder(F.col("n")).cast("string")).alias("batch"), name, body.alias("body"))
    write_small_files(written, folder)
    return folder


def _path_part(group: int) -> Column:
    """The batch (1) or the name (2) of a file that `write_small_files` has written."""
    return F.regexp_extract("path", r"/batch=([^/]+)/(?:name=)?([^/.]+)[^=]*$", group)


def _joined_lines() -> Column:
    return F.array_join(F.transform("lines", lambda x: x["line"]), ",")


@query
def s_scan_files(t: Tables) -> DataFrame:
    """Documents written as files in batch folders, numbered and named by folder, and read with their contents."""
    folder = _write_files(t, _joined_lines(), 10, "image-files")
    found = files.scan_image_files(t.spark, folder, "*.txt", recursive=True).withColumn("batch_id", _path_part(1))
    given = F.when(F.substring(_path_part(2), 2, 9).cast("int") % 2 == 0, _path_part(2))
    items = files.scan_image_batch(found.select("path", "length", "batch_id", given.alias("filename")), SETTINGS)
    contents = files.files_to_process(found, SETTINGS).select("path", F.md5("content").alias("content_md5"))
    return items.join(contents, "path").select("batch_id", "idx", "filename", "length", "n_images", "content_md5")


def _as_bitmap(lines: Column) -> Column:
    """Text that reads as a bitmap's header, sized by the file's number, and the lines; every ninth has no signature."""
    n = F.col("n")
    number = lambda low, high: F.concat(F.chr(low), F.chr(high), F.chr(F.lit(0)), F.chr(F.lit(0)))
    header = F.concat(F.lit("BM" + "." * 16), number(n % 100 + 1, n * 7 % 120), number(n % 90 + 1, n * 11 % 110))
    return F.concat(F.when(n % 9 != 8, header).otherwise(F.lit("no image ")), lines)


def strict_recogniser() -> Callable[[bytes], list]:
    """As `digest_recogniser`; one confidence is out of range for some images."""
    inner = digest_recogniser()

    def run(data: bytes) -> list:
        pages = inner(data)
        if len(data) % 13 == 0:
            pages[1].append([pages[1][0][0], ("odd", 1.5)])
        return pages

    return run


def _bitmap_files(t: Tables) -> DataFrame:
    """The bitmaps as scanned files with contents, and what their requests ask for."""
    folder = _write_files(t, _as_bitmap(_joined_lines()), 5, "bitmap-files")
    found = files.scan_image_files(t.spark, folder, "*.txt", recursive=True)
    n = F.substring(_path_part(2), 2, 9).cast("int")
    return found.select(
        "path", "content", "length", _path_part(1).alias("batch_id"), F.when(n % 2 == 0, _path_part(2)).alias("filename"),
        F.lit("en").alias("lang"), ((n % 5) / 10).alias("min_confidence"), F.lit(True).alias("include_polygon"),
    )


@query
def b_file_documents(t: Tables) -> DataFrame:
    """The answer to batches of uploaded files: numbered by path, processed where they are read, large images scaled down."""
    done = process.answer_file_batches(_bitmap_files(t), strict_recogniser, SETTINGS, planned_size=True)
    meta = "meta:struct<image_width:bigint,image_height:bigint,was_resized:boolean>"
    parsed = F.from_json("answer", f"results array<struct<filename:string,status:string,data:struct<{meta},summary:struct<total_lines:bigint>>,error:string>>")
    size = lambda d: F.concat_ws("x", d["meta"]["image_width"], d["meta"]["image_height"], d["meta"]["was_resized"].cast("string"), d["summary"]["total_lines"])
    listed = F.transform(parsed["results"], lambda r: F.concat_ws("|", r["filename"], r["status"], F.when(r["data"].isNotNull(), size(r["data"])), r["error"]))
    return done.select("batch_id", "n_images", "status", "http_status", F.get_json_object("answer", "$.error").alias("error"), F.array_join(listed, ";").alias("results"))


@query
def s_batch_json(t: Tables) -> DataFrame:
    """Documents written as JSON batch requests and read back, one row per image."""
    doc = F.col("doc_id")
    requests = t.read("documents").select(
        doc.cast("string").alias("request_id"),
        F.when(doc % 23 == 0, F.array().cast("array<string>")).otherwise(F.split("text", "\n")).alias("images"),
        F.when(doc % 3 == 0, F.col("lang")).alias("lang"),
        F.when(doc % 2 == 0, (doc % 13) / 10).alias("min_confidence"),
    )
    folder = work_folder(t.spark, "batch-requests")
    requests.write.json(folder)
    read = request_source.scan_batch_requests(t.spark, folder)
    return request_source.explode_images(read).select(
        "request_id", "lang", "min_confidence", "violation", "n_images", "idx", F.length("payload").alias("n_chars"),
        F.md5("payload").alias("payload_md5"),
    )


@query
def s_single_json(t: Tables) -> DataFrame:
    """Documents written as JSON single requests and read back; every tenth line is broken."""
    doc = F.col("doc_id")
    text = F.when(doc % 7 == 0, F.lit(" \n\t")).otherwise(F.concat(F.lit("  "), F.col("text"), F.lit("\n")))
    body = F.to_json(F.struct(doc.cast("string").alias("request_id"), text.alias("image"),
                              ((doc % 13) / 10).alias("min_confidence")))
    folder = work_folder(t.spark, "single-requests")
    t.read("documents").select(F.when(doc % 10 == 0, F.lit('{"request_id": ')).otherwise(body)).write.text(folder)
    read = request_source.scan_single_requests(t.spark, folder)
    return read.select("request_id", "lang", "min_confidence", "include_polygon", "violation",
                       F.length("image").alias("n_chars"), F.md5("image").alias("image_md5"))


@query
def s_job_documents(t: Tables) -> DataFrame:
    """Job states written as documents, some of them broken, and read back."""
    state = _state_columns(jobs.fold_job_events(t.job_events()))
    progress = F.struct(F.col("processed"), F.lit(20).cast("bigint").alias("total")).alias("progress")
    body = F.to_json(F.struct("job_id", "status", "created_at", "started_at", "completed_at", "error", progress))
    folder = work_folder(t.spark, "job-documents")
    broken = F.col("last_seq") % 4 == 0
    state.select(F.when(broken, F.lit('{"job_id": "job_')).otherwise(body)).write.text(folder)
    read = job_source.scan_job_documents(t.spark, folder, one_per_file=False, glob="*.txt")
    return read.select("job_id", "status", "created_at", F.col("progress.processed"), F.col("progress.total"), "error")


@query
def s_job_store(t: Tables) -> DataFrame:
    """States stored, running jobs updated, every fifth user's job deleted, and the store read."""
    return job_source.read_store(t.spark, _job_store(t)).select("job_id", "status", "processed", "last_seq")


@query
def s_job_compact(t: Tables) -> DataFrame:
    """The same store, compacted before it is read."""
    folder = _job_store(t)
    job_source.compact_store(t.spark, folder, 3)
    return job_source.read_store(t.spark, folder).select("job_id", "status", "processed", "last_seq")


def _job_store(t: Tables) -> str:
    state = _state_columns(jobs.fold_job_events(t.job_events()))
    folder = work_folder(t.spark, "job-store")
    job_source.append_versions(state, folder, 0)
    current = job_source.read_store(t.spark, folder)
    updates = current.where(F.col("status") == "running").withColumn("status", F.lit("completed"))
    job_source.append_versions(updates.select(*state.columns), folder, 1)
    number = F.substring("job_id", F.lit(5), F.length("job_id")).cast("bigint")
    gone = current.where(number % 5 == 0).select("job_id")
    job_source.append_deletes(gone, state.schema, folder, 2)
    return folder


# ---- streams --------------------------------------------------------------------------------


@query
def x_job_state(t: Tables) -> DataFrame:
    """The event table replayed as a stream and folded into job states."""
    use_rocksdb(t.spark)
    folder = work_folder(t.spark, "job-state")
    stream = stream_jobs.stream_job_state(t.job_events(t.stream("events", EVENTS)))
    upsert_batches(stream, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return _state_columns(job_source.read_store(t.spark, f"{folder}/store"))


@query
def x_lifecycle(t: Tables) -> DataFrame:
    """Steps of every job that were taken and turned away on arrival, and the lives that ended before the watermark."""
    events = t.job_events(t.stream("events", EVENTS))
    out = run_to_files(stream_lifecycle(events, SETTINGS), "lifecycle")
    ended = F.col("kind") == EXPIRED
    return out.groupBy("job_id").agg(
        F.count_if(F.col("accepted") & ~ended).alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_rejected"), F.count_if(ended).alias("n_expired"),
        F.max_by("status", F.when(~ended, F.col("seq"))).alias("status"),
    )


@query
def x_effective_images(t: Tables) -> DataFrame:
    """Image starts that no cancel came before, from a stream of images and a stream of events."""
    starts = t.job_items(t.stream("orders", t.read("orders").schema)).select("job_id", "image_id", "start_ts")
    cancels = t.job_events(t.stream("events", EVENTS)).where(F.col("kind") == "cancelled").select("job_id", "ts")
    # Starts are whole minutes; the watermark is not, so that no start is just at it.
    out = run_to_files(stream_jobs.stream_effective_images(starts, cancels, SETTINGS, "630 seconds"), "effective-images")
    return out.select("job_id", "image_id")


@query
def x_queue_depth(t: Tables) -> DataFrame:
    """Pending jobs after each opening and closing, the total carried from micro-batch to micro-batch."""
    use_rocksdb(t.spark)
    folder = work_folder(t.spark, "queue-depth")
    deltas = stream_queue_deltas(t.job_events(t.stream("events", EVENTS)))
    run_batches(deltas, carried_depth(t.spark, folder), f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.schema(DEPTHS).parquet(f"{folder}/depths").select("seq", "job_id", "delta", "depth")


@query
def x_image_files(t: Tables) -> DataFrame:
    """Image files recognised and normalised as they arrive in a folder."""
    folder = _write_files(t, _as_bitmap(_joined_lines()), 5, "arriving-files")
    found = request_source.stream_image_files(t.spark, folder, t.files_per_trigger, "*.txt")
    n = F.substring(_path_part(2), 2, 9).cast("int")
    asked = found.select("content", n.alias("n"), F.lit("en").alias("lang"), ((n % 5) / 10).alias("min_confidence"), F.lit(True).alias("include_polygon"))
    done = process.process_batch_items(asked, strict_recogniser, SETTINGS, is_json=False, planned_size=True)
    fine = F.col("error").isNull()
    return run_to_files(done.select(
        "n", "status", "error", F.when(fine, F.col("meta.image_width")).alias("width"), F.when(fine, F.col("meta.image_height")).alias("height"),
        F.when(fine, F.col("summary.total_lines")).alias("total_lines"),
    ), "image-outcomes")


@query
def x_metrics(t: Tables) -> DataFrame:
    """Request metrics of all windows the watermark has closed."""
    requests = t.requests(t.stream("events", EVENTS))
    out = run_to_files(stream_request_metrics(requests), "request-metrics")
    return out.select(
        iso_z_format(F.col("window_start")).alias("window_start"), "endpoint", "lang", "status", "n_requests",
        rounded("duration_sum", 4), F.col("bucket_5").alias("within_5s"), F.col("bucket_7").alias("within_30s"),
    )


@query
def x_ttl_fixed(t: Tables) -> DataFrame:
    """Jobs whose time to live, counted from creation, ended before the watermark."""
    folder = work_folder(t.spark, "fixed-expiry")
    events = t.job_events(t.stream("events", EVENTS)).select("job_id", "ts", "kind")
    run_batches(events, stream_jobs.fixed_expiry(t.spark, folder, SETTINGS), f"{folder}/checkpoint").awaitTermination()
    return read_batches(t.spark, f"{folder}/expired", "job_id string")


@query
def x_ttl_sliding(t: Tables) -> DataFrame:
    """Quiet times longer than the time to live that ended before the watermark."""
    events = t.job_events(t.stream("events", EVENTS))
    out = run_to_files(stream_jobs.stream_sliding_expiry(events, SETTINGS), "sliding-expiry")
    return out.select("job_id", iso_z_format(F.col("last_event_at")).alias("last_event_at"))


@query
def x_normalise(t: Tables) -> DataFrame:
    """Images normalised as they arrive."""
    images = t.raw_images(t.stream("documents", DOCUMENTS))
    return run_to_files(_normalised_columns(stream_normalise(images, SETTINGS)), "normalise")


@query
def x_submit(t: Tables) -> DataFrame:
    """Each submitted job once."""
    events = t.job_events(t.stream("events", EVENTS)).where(F.col("kind") == "queued").select("job_id", "ts")
    folder = work_folder(t.spark, "submitted")
    run_batches(events, stream_jobs.submitted_once(t.spark, folder), f"{folder}/checkpoint").awaitTermination()
    return read_batches(t.spark, f"{folder}/submitted", "job_id string")


@query
def x_submit_state(t: Tables) -> DataFrame:
    """Each submitted job once, by keyed state."""
    events = t.job_events(t.stream("events", EVENTS)).where(F.col("kind") == "queued")
    return run_to_files(stream_submitted_once(events), "submitted-once").select("job_id")


@query
def x_ttl_state(t: Tables) -> DataFrame:
    """Jobs whose time to live from creation ended before the watermark, by timers."""
    out = run_to_files(stream_fixed_expiry(t.job_events(t.stream("events", EVENTS)), SETTINGS), "expired-jobs")
    return out.select("job_id")


@query
def x_create(t: Tables) -> DataFrame:
    """Job requests written as JSON, submitted on a stream, and turned into headers, images and rejections."""
    item = F.struct("image_id", "payload")
    packed = t.job_items().groupBy("job_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    folder = work_folder(t.spark, "submissions")
    body = packed.select(F.col("job_id").alias("request_id"), F.transform("items", lambda i: i["payload"]).alias("images"))
    body.write.json(f"{folder}/in")
    stream = request_source.stream_submissions(t.spark, f"{folder}/in", t.files_per_trigger)
    submitted = run_to_files(stream, "submitted-jobs")
    requests = submitted.select(F.col("request_id").alias("job_id"), F.lit(AS_OF).cast("timestamp").alias("created_at"), "images", "lang")
    headers, images, rejected = jobs.create_jobs(requests, SETTINGS)
    stored = images.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_stored"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "payload"))), lambda i: i["payload"]), ",")).alias("images_md5"),
    )
    answered = headers.join(stored, "job_id", "left").select(
        "job_id", "status", "status_url", iso_z_format(F.col("estimated_completion")).alias("estimated_completion"), "lang", "total", "n_stored", "images_md5",
        F.lit(202).alias("http_status"),
    )
    return answered.unionByName(rejected, allowMissingColumns=True)
