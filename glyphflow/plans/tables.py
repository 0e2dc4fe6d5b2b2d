"""Domain tables derived from the driver tables.

The driver tables hold no images. Every table here is a projection of the
given tables by fixed rules, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from glyphflow.plans.skew import position_in_group
from glyphflow.schemas import POLYGON, RAW_PAGES

LANGS = ["en", "de", "fr", "es"]
MODEL_TYPES = ["det", "rec", "cls", "combined"]
# Leading bytes of the derived payloads, by doc_id % 8; the first three go on as headers.
PAYLOAD_SIGNATURES = [
    "FFD8FF", "89504E47", "424D", "49492A00", "4D4D002A", "524946460000000057454250", "524946460000000057415645", "",
]
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def pick(names: list[str], number: Column) -> Column:
    """names[number % len(names)]."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


def hex_number(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number), digits, "0")


def reversed_hex(number: Column) -> Column:
    text = hex_number(number, 8)
    return F.concat(*[F.substring(text, i, 2) for i in (7, 5, 3, 1)])


def corners(x0: Column, y0: Column, x1: Column, y1: Column, all_four: Column) -> Column:
    """Polygon of a box; only its first three points unless `all_four`."""
    points = [F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1)]
    return F.when(all_four, F.array(*points)).otherwise(F.array(*points[:3])).cast(POLYGON)


class Tables:
    def __init__(self, spark: SparkSession, folder: str, files_per_trigger: int = 1_000):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.files_per_trigger = files_per_trigger

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str, schema: T.StructType) -> DataFrame:
        """The files of a table as a stream; the pattern matches a file and a folder of files alike."""
        reader = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files_per_trigger)
        return reader.parquet(f"{self.folder}/{name}.parquet*")

    def images(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        return self.read("orders").select(
            key.alias("image_id"),
            cust.alias("batch_id"),
            F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("order_"), key.cast("string"))).alias("filename"),
            pick(LANGS, key).alias("lang"),
            (500 + key % 5000).cast("int").alias("width"),
            (400 + key % 4000).cast("int").alias("height"),
            ((key % 5) / 10).alias("min_confidence"),
            (key % 2 == 0).alias("include_polygon"),
            F.when((key % 11 == 0) | (cust % 13 == 0), F.lit("error")).otherwise(F.lit("success")).alias("status"),
        )

    def lines(self, *, with_index: bool = False) -> DataFrame:
        """Detections while their rows are narrow: neither their text nor their polygon, which are made of p_partkey, x0 and line_no."""
        lines = self.read("lineitem").select(
            F.col("l_orderkey").alias("image_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("p_partkey"),
            F.col("l_suppkey").alias("supp_key"),
            F.round(F.abs("l_discount") * 10, 6).alias("confidence"),
            F.col("l_quantity").alias("x0"),
        )
        if with_index:
            # line_no leads the order, part_key comes next, both are below 2^40.
            along = F.col("line_no").cast("bigint") * F.lit(2**40) + F.col("p_partkey")
            lines = position_in_group(
                lines.withColumn("_along", along), "image_id", ["line_no", "p_partkey", "supp_key"], "_along", "det_idx"
            ).drop("_along")
        return lines

    def with_texts(self, lines: DataFrame) -> DataFrame:
        return lines.join(self.read("part").select("p_partkey", F.col("p_name").alias("text")), "p_partkey")

    def with_polygons(self, lines: DataFrame) -> DataFrame:
        x0, y0 = F.col("x0"), F.lit(10.0) * F.col("line_no")
        polygons = lines.withColumn("polygon", corners(x0, y0, x0 + 50, y0 + 20, F.col("line_no") != 7))
        return polygons.withColumnRenamed("p_partkey", "part_key").drop("x0")

    def detections(self, *, with_index: bool = False) -> DataFrame:
        return self.with_polygons(self.with_texts(self.lines(with_index=with_index)))

    def raw_images(self, documents: DataFrame | None = None) -> DataFrame:
        """One image per document; its lines are the detections, an empty line is an unusable item."""
        source = self.read("documents") if documents is None else documents
        doc = F.col("doc_id")

        def item(line: Column, i: Column) -> Column:
            n = F.char_length(line)
            y0 = (i * 20).cast("double")
            polygon = corners(F.lit(10.0), y0, (n * 8 + 10).cast("double"), y0 + 16, n % 7 != 0)
            confidence = F.when(n % 5 != 0, ((n * 7 + i) % 101) / 100)
            filled = F.struct(polygon.alias("polygon"), line.alias("text"), confidence.alias("confidence"))
            return F.when(n > 0, filled)

        page = F.transform(F.split("text", "\n"), item)
        raw = F.array(F.lit(None).cast(RAW_PAGES.elementType), page, F.array().cast(RAW_PAGES.elementType))
        return source.select(
            doc.alias("image_id"),
            "lang",
            F.when(doc % 97 == 0, 0).otherwise(1000 + doc % 500).cast("int").alias("width"),
            (800 + doc % 300).cast("int").alias("height"),
            ((doc % 5) / 10).alias("min_confidence"),
            (doc % 2 == 0).alias("include_polygon"),
            raw.cast(RAW_PAGES).alias("raw"),
        )

    def payloads(self) -> DataFrame:
        """Documents as image contents: a header by doc_id % 8, then the text. Every other JPEG has a broken header."""
        doc = F.col("doc_id")
        width, height = 1 + doc % 3000, 1 + F.col("n_chars") % 2000
        jpeg = F.concat(F.lit("FFD8FFC0001108"), hex_number(height, 4), hex_number(width, 4), F.lit("03"))
        png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex_number(width, 8), hex_number(height, 8), F.lit("0802000000"))
        bmp = F.concat(F.lit("424D"), F.repeat(F.lit("00"), F.lit(16)), reversed_hex(width), reversed_hex(height))
        header = (
            F.when(doc % 16 == 8, F.lit("FFD8FFD9")).when(doc % 8 == 0, jpeg).when(doc % 8 == 1, png).when(doc % 8 == 2, bmp)
            .otherwise(pick(PAYLOAD_SIGNATURES, doc))
        )
        content = F.concat(F.unhex(header), F.encode("text", "utf-8"))
        encoded = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
        payload = (
            F.when(doc % 10 == 0, F.concat(F.lit("data:image/jpeg;base64,"), encoded))
            .when(doc % 10 == 1, F.substring(encoded, F.lit(1), F.length(encoded) - 1))
            .when(doc % 10 == 2, F.lit("  \t"))
            .when(doc % 10 == 3, F.concat(encoded, F.lit("é")))
            .otherwise(encoded)
        )
        return self.read("documents").select(
            doc.alias("payload_id"),
            content.alias("content"),
            payload.alias("payload"),
            F.when((F.floor(doc / 40) % 2) == 0, F.lit("/ocr")).otherwise(F.lit("/ocr/json")).alias("endpoint"),
            "lang",
        )

    def _events(self, source: DataFrame | None = None) -> DataFrame:
        df = self.read("events") if source is None else source
        return df.withColumn("ts", F.col("ts").cast("timestamp"))

    def requests(self, source: DataFrame | None = None) -> DataFrame:
        event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
        endpoint = (
            F.when(kind == "view", F.lit("/ocr"))
            .when(kind == "click", F.lit("/ocr/json"))
            .when(kind == "purchase", F.lit("/ocr/batch"))
            .when(kind == "signup", F.lit("/ocr/batch/json"))
            .otherwise(F.lit("/ocr/jobs"))
        )
        single = kind.isin("view", "click")
        is_job = kind == "error"
        lang = pick(LANGS, user)
        return self._events(source).select(
            event.alias("request_id"),
            "ts",
            endpoint.alias("endpoint"),
            lang.alias("lang"),
            F.when(event % 7 == 0, F.lit("error"))
            .when((event % 7 == 1) & ~single, F.lit("partial"))
            .otherwise(F.lit("success"))
            .alias("status"),
            F.when(~single & (event % 25 + 1 > 20), F.lit("batch_too_large"))
            .when(single & (event % 11 == 0), F.lit("precheck"))
            .when(single & (event % 13 == 0), F.lit("ocr_failed"))
            .when(is_job & (event % 17 == 0), F.lit("cancelled"))
            .when(is_job & (event % 19 == 0), F.lit("crashed"))
            .when(event % 7 == 0, F.lit("error"))
            .when((event % 7 == 1) & ~single, F.lit("partial"))
            .otherwise(F.lit("success"))
            .alias("outcome"),
            F.col("value").alias("duration"),
            F.when(~single, event % 25 + 1).cast("int").alias("batch_size"),
            F.when(is_job, F.lit("async")).when(~single, F.lit("sync")).alias("job_type"),
            F.concat(F.lit("model_"), lang).alias("model"),
            F.when(user % 5 == 0, F.lit("gpu")).otherwise(F.lit("cpu")).alias("device"),
        )

    def job_events(self, source: DataFrame | None = None) -> DataFrame:
        event, kind = F.col("event_id"), F.col("event_type")
        is_failure = (kind == "error") & (event % 2 == 1)
        return self._events(source).select(
            F.concat(F.lit("job_"), F.col("user_id").cast("string")).alias("job_id"),
            event.alias("seq"),
            "ts",
            F.when(kind == "signup", F.lit("queued"))
            .when(kind == "view", F.lit("running"))
            .when(kind == "click", F.lit("progress"))
            .when(kind == "purchase", F.lit("completed"))
            .when(is_failure, F.lit("failed"))
            .otherwise(F.lit("cancelled"))
            .alias("kind"),
            F.when(kind == "click", F.floor("value")).cast("bigint").alias("processed"),
            F.when(is_failure & (event % 3 == 0), F.concat(F.lit("stopped at "), event.cast("string"))).alias("error"),
        )

    def job_items(self, orders: DataFrame | None = None) -> DataFrame:
        """Submitted job images, not yet gated by size: job_id, image_id, payload, start_ts, status."""
        source = self.read("orders") if orders is None else orders
        key = F.col("o_orderkey")
        start = F.timestamp_seconds(F.lit(1_704_067_200) + (key % 43_200) * 60)
        name = F.concat(F.lit("img_"), key.cast("string"))
        return source.select(
            F.concat(F.lit("job_"), F.col("o_custkey").cast("string")).alias("job_id"),
            key.alias("image_id"),
            F.replace(F.base64(name.cast("binary")), F.lit("\r\n"), F.lit("")).alias("payload"),
            start.alias("start_ts"),
            F.when((key % 11 == 0) | (F.col("o_custkey") % 13 == 0), F.lit("error"))
            .otherwise(F.lit("success"))
            .alias("status"),
        )

    def pixel_histogram(self) -> DataFrame:
        key, part = F.col("l_orderkey"), F.col("l_partkey")
        return self.read("lineitem").select(
            key.alias("image_id"),
            F.when(key % 3 == 0, part % 16 + 240).otherwise(part % 256).cast("int").alias("level"),
            F.col("l_quantity").cast("bigint").alias("n"),
        )
