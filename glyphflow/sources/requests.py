"""JSON requests as rows, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from glyphflow.functions.payload import strip_text
from glyphflow.operators.validate import check_batch_request, check_single_request, gate_detail, gate_of_size
from glyphflow.schemas import BATCH_REQUEST, CORRUPT_COLUMN, JOB_REQUEST, SINGLE_REQUEST
from glyphflow.session import use_small_files
from glyphflow.settings import Settings

# Request defaults.
DEFAULTS = {"lang": "auto", "min_confidence": 0.0, "layout_analysis": False, "include_polygon": True}


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (
        spark.read.schema(_with_corrupt(schema))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
        .json(path)
    )


def with_defaults(df: DataFrame) -> DataFrame:
    for name, value in DEFAULTS.items():
        if name in df.columns:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return df


def scan_single_requests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, with `violation` (null when the request is fine); the image text is stripped."""
    df = with_defaults(_read(spark, path, SINGLE_REQUEST))
    broken = F.when(F.col(CORRUPT_COLUMN).isNotNull(), F.lit("not_json"))
    violation = F.coalesce(broken, check_single_request(F.col("image"), F.col("min_confidence")))
    return df.withColumn("violation", violation).withColumn("image", strip_text(F.col("image")))


def scan_batch_requests(spark: SparkSession, path: str, *, job: bool = False) -> DataFrame:
    """One row per document with its `images` array, `n_images` and `violation`."""
    df = with_defaults(_read(spark, path, JOB_REQUEST if job else BATCH_REQUEST))
    broken = F.when(F.col(CORRUPT_COLUMN).isNotNull(), F.lit("not_json"))
    violation = F.coalesce(broken, check_batch_request(F.col("images"), F.col("min_confidence")))
    n = F.when(F.col("images").isNull(), 0).otherwise(F.size("images"))
    return df.withColumn("violation", violation).withColumn("n_images", n)


def gate_requests(requests: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) many-image requests by their size; decided before any image is touched."""
    code = gate_of_size(F.col("n_images"), settings)
    rejected = requests.where(code.isNotNull()).select(
        "request_id", code.alias("error_code"), gate_detail(F.col("n_images"), settings).alias("error_detail"),
        F.lit(400).alias("http_status"),
    )
    return requests.where(code.isNull()), rejected


def explode_images(requests: DataFrame) -> DataFrame:
    """One row per image with its 0-based idx; a request without images keeps one row with nulls."""
    others = [c for c in requests.columns if c != "images"]
    return requests.select(*others, F.posexplode_outer("images").alias("idx", "payload"))


def stream_submissions(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Job requests as a stream: new JSON files are picked up, a bounded number per trigger."""
    return with_defaults(
        spark.readStream.schema(JOB_REQUEST).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def stream_image_files(spark: SparkSession, path: str, files_per_trigger: int = 100, glob: str = "*") -> DataFrame:
    """Image files as a stream, with their contents; folders below `path` are looked into."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    use_small_files(spark)
    reader = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
