import base64
import json
import os
import struct

from pyspark.sql import functions as F

from glyphflow.operators.process import (
    answer_single_requests,
    process_batch_items,
    process_job_images,
    process_single_requests,
    run_images,
)
from glyphflow.operators.recognise import inference_calls, recognise
from glyphflow.settings import Settings

BOX = [[0, 0], [8, 0], [8, 4], [0, 4]]


def factory():
    calls = []

    def engine(data):
        calls.append(data)
        if data.endswith(b"bad"):
            raise RuntimeError("no text")
        if data.endswith(b"none"):
            return None
        return [None, [], [[BOX, ("word", 0.75)], (BOX, "plain"), [BOX], None, "xy", [None, ("bare", 0.5)]]]

    return engine


def test_rows_are_isolated_and_shapes_are_normalised(spark):
    df = spark.createDataFrame(
        [(1, bytearray(b"ok")), (2, bytearray(b"bad")), (3, None), (4, bytearray(b"none"))], "id int, content binary"
    )
    got = {r["id"]: r for r in recognise(df, factory).collect()}
    items = got[1]["raw"][2]
    assert got[1]["raw"][:2] == [None, None]
    assert [(i["text"], i["confidence"]) if i else None for i in items] == [("word", 0.75), ("plain", 1.0), None, None, None, ("bare", 0.5)]
    assert items[0]["polygon"] == [[0.0, 0.0], [8.0, 0.0], [8.0, 4.0], [0.0, 4.0]] and items[5]["polygon"] is None
    assert (got[2]["error_code"], got[2]["error_message"], got[2]["raw"]) == ("ocr_failed", "no text", None)
    assert got[3]["raw"] is None and got[3]["error_code"] is None and got[3]["seconds"] is None
    assert [got[i]["called"] for i in (1, 2, 3, 4)] == [True, False, None, True]
    assert got[4]["raw"] == [] and got[4]["seconds"] >= 0


def test_model_is_built_once_per_task_and_only_when_needed(spark, tmp_path):
    log = str(tmp_path)

    def counting():
        open(os.path.join(log, f"{os.getpid()}-{len(os.listdir(log))}"), "w").close()
        return lambda data: []

    df = spark.range(0, 40, 1, 2).select("id", F.when(F.col("id") < 20, F.lit(b"x")).alias("content"))
    assert recognise(df, counting).count() == 40
    assert len(os.listdir(log)) == 1


def test_broken_factory_gives_error_rows(spark):
    def broken():
        raise OSError("no model file")

    df = spark.createDataFrame([(1, bytearray(b"a"))], "id int, content binary")
    assert recognise(df, broken).first()["error_message"] == "no model file"


def test_job_images_end_to_end(spark):
    s = Settings(max_image_bytes=50)
    encode = lambda b: base64.b64encode(b).decode()
    rows = [
        ("a", 0, encode(b"\xff\xd8\xffok"), "en", 0.6), ("a", 1, encode(b"\xff\xd8\xffbad"), "en", 0.0), ("a", 2, "Q", "en", 0.0),
        ("a", 3, "", "en", 0.0), ("a", 4, encode(b"xx"), "en", 0.0), ("a", 5, encode(b"\xff\xd8\xff" + b"x" * 50), "en", 0.0),
    ]
    df = spark.createDataFrame(rows, "job_id string, idx int, payload string, lang string, min_confidence double")
    size = lambda content: F.struct(F.lit(16).alias("width"), F.lit(8).alias("height"))
    out = process_job_images(df, factory, s, dimensions=size)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["idx"]: r for r in out.collect()}
    assert [got[i]["error"] for i in range(1, 6)] == [
        "no text",
        "Processing error: Invalid base64 data: Invalid base64-encoded string: number of data characters (1) cannot be 1 more than a multiple of 4",
        "image_empty", "unsupported_format", "file_too_large: size 53 exceeds 50",
    ]
    first = got[0]
    assert (first["filename"], first["status"], first["error"]) == ("image_0", "success", None)
    assert [(r["text"], r["confidence"]) for r in first["results"]] == [("word", 0.75), ("plain", 1.0)]
    assert first["results"][0]["bbox_normalized"]["bottom_right"] == [0.5, 0.5]
    assert inference_calls(out, s).count() == 1


REQUEST = "id int, endpoint string, payload string, content binary, lang string, min_confidence double, include_polygon boolean"


def picture(width, height, tail=b""):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", width, height) + tail


def test_single_requests_are_answered_like_their_endpoint(spark):
    s = Settings(max_image_bytes=60)
    text = lambda b: base64.b64encode(b).decode()
    rows = [
        (0, "/ocr", None, bytearray(picture(16, 8)), "en", 0.8, False),
        (1, "/ocr", None, bytearray(), "en", 0.0, True),
        (2, "/ocr", None, bytearray(b"xx"), "en", 0.0, True),
        (3, "/ocr", None, bytearray(b"\x89PNG"), "en", 0.0, True),
        (4, "/ocr/json", "data:image/png;base64," + text(picture(16, 8)), None, "en", 0.0, True),
        (5, "/ocr/json", "Q", None, "en", 0.0, True),
        (6, "/ocr/json", text(b"xx"), None, "en", 0.0, True),
        (7, "/ocr/json", text(picture(1, 1, b"x" * 60)), None, "en", 0.0, True),
        (8, "/ocr/json", text(picture(1, 1, b"bad")), None, "en", 0.0, True),
    ]
    out = process_single_requests(spark.createDataFrame(rows, REQUEST), factory, s)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert [(got[i]["error_code"], got[i]["http_status"]) for i in range(9)] == [
        (None, 200), ("image_empty", 400), ("unsupported_format", 415), ("unreadable_image", 422), (None, 200),
        ("invalid_base64", 400), ("unreadable_image", 422), ("file_too_large", 413), ("ocr_failed", 500),
    ]
    assert [r["text"] for r in got[0]["results"]] == ["plain"] and got[0]["results"][0]["polygon"] == []
    assert [r["text"] for r in got[4]["results"]] == ["word", "plain", "bare"]
    assert got[4]["results"][0]["bbox_normalized"]["bottom_right"] == [0.5, 0.5]
    assert got[8]["error_detail"] == "no text" and got[8]["results"] == []


def test_batch_items_never_fail_their_batch(spark):
    rows = [(0, "a", base64.b64encode(picture(8, 8)).decode()), (1, "a", "Q"), (2, "a", ""), (3, "a", base64.b64encode(b"xx").decode())]
    df = spark.createDataFrame(rows, "idx int, batch_id string, payload string").selectExpr(
        "*", "cast(null as binary) content", "'en' lang", "0.0D min_confidence", "true include_polygon"
    )
    got = {r["idx"]: (r["status"], r["error"]) for r in process_batch_items(df, factory, Settings()).collect()}
    assert got[0] == ("success", None) and got[2] == ("error", "Image data is empty")
    assert got[1][1].startswith("Image processing error: Invalid base64 data: ")
    assert got[3] == ("error", "Image processing error: unsupported_format")


def test_planned_size_replaces_the_size_of_large_images(spark):
    df = spark.createDataFrame([(1, bytearray(picture(8192, 4096)))], "id int, content binary").selectExpr(
        "*", "cast(null as string) decode_error", "'en' lang", "0.0D min_confidence", "true include_polygon"
    )
    meta = run_images(df, factory, Settings(), planned_size=True).first()["meta"]
    assert (meta["image_width"], meta["image_height"], meta["was_resized"]) == (5792, 2896, True)
    meta = run_images(df, factory, Settings()).first()["meta"]
    assert (meta["image_width"], meta["image_height"], meta["was_resized"]) == (8192, 4096, False)


def odd_factory():
    def engine(data):
        answers = {
            b"int": [[[BOX, (7, 0.5)]]], b"none": [[[BOX, (None, 0.5)]]], b"surrogate": [[[BOX, ("a\ud800b", 0.5)]]],
            b"ragged": [[[[[0, 0], [1]], ("r", 0.5)]]], b"number": 5, b"words": [[[BOX, ("w", "high")]]], b"good": [[[BOX, ("fine", 1.0)]]],
        }
        return answers[data]

    return engine


def test_odd_outputs_fail_alone_and_count_as_calls(spark):
    kinds = ["good", "int", "none", "surrogate", "ragged", "number", "words", "good"]
    df = spark.createDataFrame([(i, bytearray(k.encode())) for i, k in enumerate(kinds)], "id int, content binary").coalesce(1)
    got = {r["id"]: r for r in recognise(df, odd_factory).collect()}
    texts = {i: r["raw"][0][0]["text"] for i, r in got.items() if r["error_code"] is None}
    assert texts == {0: "fine", 1: "7", 3: "a?b", 4: "r", 7: "fine"}
    assert {i for i, r in got.items() if r["error_code"] == "ocr_failed"} == {2, 5, 6}
    assert all(r["called"] for r in got.values())
    calls = recognise(df.withColumn("lang", F.lit("en")), odd_factory)
    assert inference_calls(calls, Settings()).count() == len(kinds)


def test_rows_are_dealt_to_the_tasks_asked_for(spark):
    df = spark.range(40).coalesce(1).select("id", F.lit(b"good").alias("content"))
    out = recognise(df, odd_factory, tasks=5)
    assert out.rdd.getNumPartitions() == 5 and out.count() == 40


def test_whole_requests_are_answered_with_documents(spark):
    text = lambda b: base64.b64encode(b).decode()
    rows = [
        ("r0", "/ocr", None, bytearray(picture(16, 8)), "de", None, None, None),
        ("r1", "/ocr", None, bytearray(b"xx"), "", 0.9, None, None),
        ("r2", "/ocr/json", text(picture(16, 8)), None, "", 0.0, "fr", 0.8),
        ("r3", "/ocr/json", "Q", None, None, None, None, 0.0),
        ("r4", "/ocr", None, bytearray(), None, None, None, None),
        ("r5", "/ocr", None, bytearray(picture(16, 8, b"odd")), None, None, None, None),
        ("r6", "/ocr", None, bytearray(picture(16, 8, b"bad")), None, None, None, None),
    ]
    schema = "request_id string, endpoint string, payload string, content binary, x_lang string, x_min_confidence double, body_lang string, body_min_confidence double"

    def sometimes_odd():
        engine = factory()
        return lambda data: [[[BOX, ("too sure", 1.2)]]] if data.endswith(b"odd") else engine(data)

    out = answer_single_requests(spark.createDataFrame(rows, schema), sometimes_odd, Settings())
    got = {r["request_id"]: r for r in out.collect()}
    answers = {k: json.loads(r["answer"]) for k, r in got.items()}
    assert [got[f"r{i}"]["http_status"] for i in range(7)] == [200, 415, 200, 400, 400, 422, 500]
    assert [got[f"r{i}"]["outcome"] for i in range(7)] == ["success", "error", "success", "error", None, "error", None]
    assert (answers["r0"]["meta"]["lang"], answers["r2"]["meta"]["lang"]) == ("de", "fr")
    assert [r["text"] for r in answers["r2"]["results"]] == ["plain"]  # the body's threshold counts when the header is 0
    assert answers["r1"] == {"error": "unsupported_format", "detail": "Unsupported image format. Allowed: JPEG, PNG, BMP, TIFF, WebP", "request_id": "r1"}
    assert answers["r5"]["error"] == "unreadable_image" and answers["r5"]["detail"] == "Cannot process image: confidence_range"
    assert all(set(answers[k]) == {"error", "detail", "request_id"} for k in ("r1", "r3", "r4", "r5", "r6"))
