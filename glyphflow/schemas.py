"""Explicit schemas; nothing is inferred from data."""

from pyspark.sql import types as T

POINT = T.ArrayType(T.DoubleType())
POLYGON = T.ArrayType(POINT)

BBOX = T.StructType([
    T.StructField("top_left", POINT),
    T.StructField("bottom_right", POINT),
])

DETECTION = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", BBOX),
    T.StructField("bbox_normalized", BBOX),
    T.StructField("type", T.StringType()),
    T.StructField("polygon", POLYGON),
])

# What a recogniser returns for one image: pages of items. A null item, or an
# item without text, is a detection that carries too little to be used.
RAW_ITEM = T.StructType([
    T.StructField("polygon", POLYGON),
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
])
RAW_PAGES = T.ArrayType(T.ArrayType(RAW_ITEM))

META = T.StructType([
    T.StructField("engine", T.StringType()),
    T.StructField("engine_version", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("inference_time_ms", T.IntegerType()),
    T.StructField("image_width", T.IntegerType()),
    T.StructField("image_height", T.IntegerType()),
    T.StructField("was_resized", T.BooleanType()),
])

SUMMARY = T.StructType([
    T.StructField("total_lines", T.LongType()),
    T.StructField("total_characters", T.LongType()),
    T.StructField("avg_confidence", T.DoubleType()),
])

OCR_RESPONSE = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("meta", META),
    T.StructField("results", T.ArrayType(DETECTION)),
    T.StructField("summary", SUMMARY),
])

ERROR_RESPONSE = T.StructType([
    T.StructField("error", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("request_id", T.StringType()),
])

BATCH_ITEM = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("data", OCR_RESPONSE),
    T.StructField("error", T.StringType()),
])

CORRUPT_COLUMN = "_corrupt_record"

SINGLE_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("min_confidence", T.DoubleType()),
    T.StructField("layout_analysis", T.BooleanType()),
    T.StructField("include_polygon", T.BooleanType()),
])

BATCH_REQUEST = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("lang", T.StringType()),
    T.StructField("min_confidence", T.DoubleType()),
])

JOB_REQUEST = T.StructType(BATCH_REQUEST.fields + [
    T.StructField("layout_analysis", T.BooleanType()),
])

PROGRESS = T.StructType([
    T.StructField("processed", T.LongType()),
    T.StructField("total", T.LongType()),
])

JOB_DOCUMENT = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("images", T.ArrayType(T.StringType())),
    T.StructField("lang", T.StringType()),
    T.StructField("min_confidence", T.DoubleType()),
    T.StructField("layout_analysis", T.BooleanType()),
    T.StructField("results", T.ArrayType(BATCH_ITEM)),
    T.StructField("progress", PROGRESS),
    T.StructField("started_at", T.StringType()),
    T.StructField("completed_at", T.StringType()),
    T.StructField("error", T.StringType()),
])

JOB_EVENT = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("kind", T.StringType()),
    T.StructField("processed", T.LongType()),
    T.StructField("error", T.StringType()),
])
