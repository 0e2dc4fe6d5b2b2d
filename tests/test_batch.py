from pyspark.sql import functions as F

from glyphflow.operators import batch as b
from glyphflow.settings import Settings

S = Settings()


def items(spark, sizes, errors=()):
    rows = [(name, i, "" if i % 2 else f"f{i}", "error" if (name, i) in errors else "success")
            for name, size in sizes.items() for i in range(size)]
    return spark.createDataFrame(rows, "batch_id string, n int, filename string, status string").repartition(3)


def test_rollup_and_gate(spark):
    errors = {("part", 1), ("bad", 0), ("bad", 1), ("big", 3)}
    df = items(spark, {"fine": 20, "part": 2, "bad": 2, "big": 21}, errors)
    got = {r["batch_id"]: (r["status"], r["n_success"], r["n_error"], r["http_status"], r["error_code"], r["error_detail"])
           for r in b.batch_status(df, S).collect()}
    assert got == {
        "fine": ("success", 20, 0, 200, None, None),
        "part": ("partial", 1, 1, 200, None, None),
        "bad": ("error", 0, 2, 200, None, None),
        "big": ("rejected", 0, 0, 400, "batch_too_large", "Batch size 21 exceeds maximum 20"),
    }


def test_accepted_items_keep_order_and_drop_only_oversize_batches(spark):
    df = items(spark, {"fine": 20, "one": 1, "big": 25, "huge": 900})
    out = b.accepted_items(df, S, ["n"])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    rows = b.ordered_results(b.with_item_names(out), ["filename", "status"]).collect()
    got = {r["batch_id"]: [x["filename"] for x in r["results"]] for r in rows}
    assert got == {"fine": [f"image_{i}" if i % 2 else f"f{i}" for i in range(20)], "one": ["f0"]}


def test_item_error_texts(spark):
    fields = "j boolean, d string, n int, v string, c string, m string, u string"
    cases = [
        ((True, "Invalid base64 data: x", None, None, None, None, None), "Image processing error: Invalid base64 data: x"),
        ((True, None, 0, "image_empty", None, None, None), "Image data is empty"),
        ((False, None, 0, "image_empty", None, None, None), "Image file is empty"),
        ((False, None, S.size_limit + 1, "file_too_large", None, None, None), "Image exceeds maximum size of 20MB"),
        ((False, None, S.size_limit, "unsupported_format", None, None, None), "Image processing error: unsupported_format"),
        ((False, None, 5, None, "ocr_failed", "boom", None), "boom"),
        ((False, None, 5, None, "ocr_failed", None, None), "OCR failed"),
        ((False, None, 5, None, None, None, "disk"), "Unexpected error: disk"),
        ((False, None, 5, None, None, None, None), None),
    ]
    df = spark.createDataFrame([c for c, _ in cases], fields)
    error = b.item_error(
        is_json=F.col("j"), decode_error=F.col("d"), content_length=F.col("n"), validation_message=F.col("v"),
        ocr_code=F.col("c"), ocr_message=F.col("m"), unexpected=F.col("u"), settings=S,
    )
    assert [r[0] for r in df.select(error).collect()] == [want for _, want in cases]


def test_union_fills_missing_columns(spark):
    good = spark.createDataFrame([(1, "x")], "id int, data string")
    bad = spark.createDataFrame([(2, "boom")], "id int, error string")
    assert sorted(map(tuple, b.union_outcomes(good, bad).collect())) == [(1, "x", None), (2, None, "boom")]
