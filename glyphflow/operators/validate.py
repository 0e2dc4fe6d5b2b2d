"""Validation of requests and payloads, the error taxonomy, and parameter precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from glyphflow.functions.payload import detect_format, strip_text
from glyphflow.functions.text import first_set
from glyphflow.settings import ERROR_RULES, Settings

_NO_TEXT = "string"


def _null_text() -> Column:
    return F.lit(None).cast(_NO_TEXT)


def check_single_request(image: Column, min_confidence: Column) -> Column:
    """First broken field rule of a one-image request, or null."""
    return (
        F.when(image.isNull(), F.lit("image_missing"))
        .when(F.length(image) == 0, F.lit("image_too_short"))
        .when(F.length(strip_text(image)) == 0, F.lit("image_blank"))
        .otherwise(check_confidence(min_confidence))
    )


def check_batch_request(images: Column, min_confidence: Column) -> Column:
    """First broken field rule of a many-image request, or null."""
    return (
        F.when(images.isNull(), F.lit("images_missing"))
        .when(F.size(images) < 1, F.lit("images_empty"))
        .otherwise(check_confidence(min_confidence))
    )


def check_confidence(min_confidence: Column) -> Column:
    """A missing threshold takes its default and is fine."""
    return F.when(
        min_confidence.isNotNull() & ~min_confidence.between(0.0, 1.0), F.lit("min_confidence_range")
    ).otherwise(_null_text())


def is_empty(content: Column) -> Column:
    return F.coalesce(F.length(content), F.lit(0)) == 0


def is_too_large(size: Column, settings: Settings) -> Column:
    """Strictly above the limit. On a `binaryFile` scan pass its `length` column, the test is then pushed down."""
    return size > settings.size_limit


def validation_error(content: Column, settings: Settings, readable: Column | None = None) -> Column:
    """struct<code, message> of the first broken rule: empty, size, format, unreadable.

    One expression, because Spark may reorder separate filters. `readable`
    tells whether the image could be opened; null or missing means unknown
    and passes.
    """
    ok = F.lit(True) if readable is None else F.coalesce(readable, F.lit(True))
    code = (
        F.when(is_empty(content), F.lit("image_empty"))
        .when(is_too_large(F.length(content), settings), F.lit("file_too_large"))
        .when(detect_format(content).isNull(), F.lit("unsupported_format"))
        .when(~ok, F.lit("unreadable_image"))
    )
    size_text = F.concat(
        F.lit("file_too_large: size "), F.length(content).cast("string"), F.lit(f" exceeds {settings.size_limit}")
    )
    message = (
        F.when(code == "file_too_large", size_text)
        .when(code == "unreadable_image", F.lit("unreadable_image: cannot identify image file"))
        .otherwise(code)
    )
    return F.struct(code.alias("code"), message.alias("message"))


def error_code_of_text(endpoint: Column, message: Column) -> Column:
    """Error code an endpoint gives to an error text. The first matching part of the text decides."""
    single = (
        F.when(F.contains(message, F.lit("image_empty")), F.lit("image_empty"))
        .when(F.contains(message, F.lit("file_too_large")), F.lit("file_too_large"))
        .when(F.contains(message, F.lit("unsupported_format")), F.lit("unsupported_format"))
        .otherwise(F.lit("unreadable_image"))
    )
    as_json = (
        F.when(F.contains(message, F.lit("image_empty")), F.lit("image_empty"))
        .when(F.contains(message, F.lit("Invalid base64")), F.lit("invalid_base64"))
        # The JSON endpoint tests the size itself, before the validation chain.
        .when(F.startswith(message, F.lit("file_too_large")), F.lit("file_too_large"))
        .otherwise(F.lit("unreadable_image"))
    )
    return F.when(message.isNull(), _null_text()).when(endpoint == "/ocr/json", as_json).otherwise(single)


def error_rules() -> Column:
    """The rule table as a literal map from "endpoint code" to struct<http_status, template>."""
    pairs = []
    for endpoint, code, status, template in ERROR_RULES:
        pairs.append(F.lit(f"{endpoint} {code}"))
        pairs.append(F.struct(F.lit(status).alias("http_status"), F.lit(template).alias("template")))
    return F.create_map(*pairs)


def classify_errors(
    df: DataFrame, settings: Settings, *, message: str = "error_message", size: str = "n_bytes"
) -> DataFrame:
    """Add http_status and error_detail to rows with endpoint and error_code; success rows get 200 and null.

    The dozen rules are a literal, not a joined table: a join here would make
    the optimizer carry the long error expressions through its constraints.
    """
    rule = F.try_element_at(error_rules(), F.concat_ws(" ", "endpoint", "error_code"))
    ruled = df.withColumn("_rule", F.when(F.col("error_code").isNotNull(), rule))
    detail = F.col("_rule.template")
    for mark, value in [
        ("{limit_text}", F.lit(settings.size_limit_text)),
        ("{limit}", F.lit(str(settings.size_limit))),
        ("{size}", F.coalesce(F.col(size).cast("string"), F.lit("0"))),
        ("{message}", F.coalesce(F.col(message), F.lit(""))),
    ]:
        detail = F.replace(detail, F.lit(mark), value)
    return (
        ruled.withColumn("error_detail", detail)
        .withColumn("http_status", F.when(F.col("error_code").isNull(), 200).otherwise(F.col("_rule.http_status")))
        .drop("_rule")
    )


def resolve_lang(header: Column, body: Column | None, settings: Settings) -> Column:
    """Header, then body, then setting; an empty text counts as not given."""
    given = [header] if body is None else [header, body]
    return first_set(*given, F.lit(settings.model_lang))


def resolve_min_confidence(header: Column, body: Column | None, settings: Settings) -> Column:
    """Header unless null or 0.0; then the body value for JSON requests, the setting for file requests."""
    fallback = F.lit(settings.min_confidence) if body is None else body
    return F.coalesce(F.nullif(header, F.lit(0.0)), fallback)


def confidence_out_of_range(confidence: Column) -> Column:
    """Whether a confidence that reaches the threshold of any request breaks the response: above 1, or not a number."""
    return F.coalesce(confidence > 1.0, F.lit(False))


def output_violations(
    confidence: Column, avg_confidence: Column, sizes: list[Column], boxes: list[Column]
) -> Column:
    """Names of the broken output constraints; an empty array means the row may be published."""
    def outside(value: Column) -> Column:
        return value.isNotNull() & ~value.between(0.0, 1.0)

    tests = [
        F.when(outside(confidence), F.lit("confidence_range")),
        F.when(outside(avg_confidence), F.lit("avg_confidence_range")),
    ]
    tests += [F.when(size < 0, F.lit("negative_size")) for size in sizes]
    tests += [
        F.when((F.size(box["top_left"]) != 2) | (F.size(box["bottom_right"]) != 2), F.lit("bbox_length"))
        for box in boxes
    ]
    return F.array_compact(F.array(*tests))


def gate_of_size(n_images: Column, settings: Settings) -> Column:
    """`batch_too_large` above the limit, else null; a batch of exactly the limit passes."""
    return F.when(n_images > settings.max_batch_size, F.lit("batch_too_large")).otherwise(_null_text())


def gate_detail(n_images: Column, settings: Settings) -> Column:
    return F.when(
        n_images > settings.max_batch_size,
        F.concat(F.lit("Batch size "), n_images.cast("string"), F.lit(f" exceeds maximum {settings.max_batch_size}")),
    ).otherwise(_null_text())


def blank_images(histogram: DataFrame) -> DataFrame:
    """Per image, from rows (image_id, level, n): whether it is blank.

    Blank: the brightest level reaches 250 and more than 95 % of the pixels
    are at level 240 or above.
    """
    counts = histogram.groupBy("image_id").agg(
        F.max(F.when(F.col("n") > 0, F.col("level"))).alias("max_level"),
        F.sum(F.when(F.col("level") >= 240, F.col("n")).otherwise(0)).alias("bright_pixels"),
        F.sum("n").alias("pixels"),
    )
    share = F.try_divide(F.col("bright_pixels"), F.col("pixels"))
    return counts.withColumn(
        "is_blank", F.coalesce((F.col("max_level") >= 250) & (share > 0.95), F.lit(False))
    )
