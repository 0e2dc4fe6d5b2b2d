from pyspark.sql import functions as F

from glyphflow.operators import validate as v
from glyphflow.settings import Settings

S = Settings()


def test_request_fields(spark):
    df = spark.createDataFrame(
        [("x", 0.0), ("x", 1.0), ("x", 1.01), ("x", -0.1), ("", 0.5), (" \n", 0.5), (" ", 0.5), (None, 0.5), ("x", None)],
        "image string, c double",
    )
    got = [r[0] for r in df.select(v.check_single_request(F.col("image"), F.col("c"))).collect()]
    assert got == [None, None, "min_confidence_range", "min_confidence_range", "image_too_short", "image_blank",
                   "image_blank", "image_missing", None]
    df = spark.createDataFrame([(["a"],), ([],), (None,)], "images array<string>")
    got = [r[0] for r in df.select(v.check_batch_request(F.col("images"), F.lit(0.1))).collect()]
    assert got == [None, "images_empty", "images_missing"]


def test_first_broken_rule_wins_and_limit_is_strict(spark):
    jpeg = F.unhex(F.lit("FFD8FF"))
    at_limit = F.concat(jpeg, F.repeat(F.lit("x"), F.lit(S.size_limit - 3)).cast("binary"))
    over = F.concat(at_limit, F.lit(b"y"))
    junk_over = F.repeat(F.lit("x"), F.lit(S.size_limit + 1)).cast("binary")
    row = spark.range(1).select(
        v.validation_error(at_limit, S)["code"],
        v.validation_error(over, S)["code"],
        v.validation_error(junk_over, S)["message"],
        v.validation_error(F.lit(b""), S)["code"],
        v.validation_error(F.lit(None).cast("binary"), S)["code"],
        v.validation_error(F.lit(b"\x00\x01\x02"), S, F.lit(False))["code"],
        v.validation_error(jpeg, S, F.lit(False))["code"],
        v.validation_error(jpeg, S, F.lit(None).cast("boolean"))["code"],
    ).first()
    assert tuple(row) == (
        None, "file_too_large", f"file_too_large: size {S.size_limit + 1} exceeds {S.size_limit}", "image_empty",
        "image_empty", "unsupported_format", "unreadable_image", None,
    )


def test_error_taxonomy_depends_on_endpoint(spark):
    texts = ["image_empty", "file_too_large: size 9 exceeds 8", "unsupported_format", "unreadable_image: broken",
             "Invalid base64 data: Incorrect padding", None]
    df = spark.createDataFrame(
        [(e, m, 9) for e in ("/ocr", "/ocr/json") for m in texts], "endpoint string, error_message string, n_bytes int"
    )
    df = df.withColumn("error_code", v.error_code_of_text(F.col("endpoint"), F.col("error_message")))
    got = [(r["error_code"], r["http_status"], r["error_detail"]) for r in v.classify_errors(df, S).collect()]
    assert got == [
        ("image_empty", 400, "Image file is empty"),
        ("file_too_large", 413, f"Image size 9 exceeds maximum {S.size_limit}"),
        ("unsupported_format", 415, "Unsupported image format. Allowed: JPEG, PNG, BMP, TIFF, WebP"),
        ("unreadable_image", 422, "Cannot process image: unreadable_image: broken"),
        ("unreadable_image", 422, "Cannot process image: Invalid base64 data: Incorrect padding"),
        (None, 200, None),
        ("image_empty", 400, "Image data is empty"),
        ("file_too_large", 413, "Image size exceeds maximum 20MB"),
        ("unreadable_image", 422, "Cannot process image: unsupported_format"),
        ("unreadable_image", 422, "Cannot process image: unreadable_image: broken"),
        ("invalid_base64", 400, "Invalid base64 encoded image data"),
        (None, 200, None),
    ]


def test_recogniser_errors_are_500(spark):
    df = spark.createDataFrame(
        [("/ocr", "ocr_failed", "boom", 1), ("/ocr/json", "internal_error", "x", 1)],
        "endpoint string, error_code string, error_message string, n_bytes int",
    )
    got = [(r["http_status"], r["error_detail"]) for r in v.classify_errors(df, S).collect()]
    assert got == [(500, "boom"), (500, "Internal server error during OCR processing")]


def test_parameter_precedence_skips_falsy_values(spark):
    null = F.lit(None)
    text, number = null.cast("string"), null.cast("double")
    s = Settings(model_lang="xx", min_confidence=0.4)
    row = spark.range(1).select(
        v.resolve_lang(F.lit("de"), F.lit("fr"), s),
        v.resolve_lang(F.lit(""), F.lit("fr"), s),
        v.resolve_lang(text, F.lit(""), s),
        v.resolve_lang(F.lit(""), None, s),
        v.resolve_min_confidence(F.lit(0.7), F.lit(0.1), s),
        v.resolve_min_confidence(F.lit(0.0), F.lit(0.1), s),
        v.resolve_min_confidence(number, F.lit(0.0), s),
        v.resolve_min_confidence(F.lit(0.0), None, s),
    ).first()
    assert tuple(row) == ("de", "fr", "xx", "xx", 0.7, 0.1, 0.0, 0.4)


def test_gate_lets_exactly_the_limit_pass(spark):
    df = spark.createDataFrame([(20,), (21,)], "n int")
    rows = df.select(v.gate_of_size(F.col("n"), S), v.gate_detail(F.col("n"), S)).collect()
    assert [tuple(r) for r in rows] == [(None, None), ("batch_too_large", "Batch size 21 exceeds maximum 20")]


def test_size_test_reaches_the_file_scan(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG" + b"x" * 10)
    (tmp_path / "b.png").write_bytes(b"\x89PNG" + b"x" * 100)
    from glyphflow.sources.files import scan_image_files

    scan = scan_image_files(spark, str(tmp_path))
    big = scan.where(v.is_too_large(F.col("length"), Settings(max_image_bytes=50))).select("path")
    plan = big._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(length,50)" in plan and "content" not in plan.split("ReadSchema")[1]
    assert big.count() == 1


def test_blank_images(spark):
    rows = [
        (1, 255, 96), (1, 100, 4), (2, 255, 95), (2, 100, 5), (3, 249, 100), (4, 250, 0), (4, 240, 100), (5, 255, 0), (6, 250, 1),
    ]
    df = spark.createDataFrame(rows, "image_id int, level int, n long")
    got = {r["image_id"]: r["is_blank"] for r in v.blank_images(df).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}


def test_output_violations(spark):
    box = lambda n: F.struct(F.array(*[F.lit(0.0)] * 2).alias("top_left"), F.array(*[F.lit(0.0)] * n).alias("bottom_right"))
    row = spark.range(1).select(
        v.output_violations(F.lit(1.0), F.lit(0.0), [F.lit(0)], [box(2)]),
        v.output_violations(F.lit(1.1), F.lit(-0.1), [F.lit(-1)], [box(1)]),
    ).first()
    assert row[0] == []
    assert row[1] == ["confidence_range", "avg_confidence_range", "negative_size", "bbox_length"]


def test_limit_text_follows_the_limit():
    assert (S.size_limit, S.size_limit_text) == (20 * 1024 * 1024, "20MB")
    small = Settings(max_image_bytes=10_000)
    assert (small.size_limit, small.size_limit_text) == (10_000, "10000 bytes")
