import json
import math
import random

from pyspark.sql import functions as F

from glyphflow.operators import normalise as n
from glyphflow.schemas import RAW_PAGES
from glyphflow.settings import Settings
from glyphflow.sources.sinks import response_json

S = Settings()
SQUARE = [[10.0, 20.0], [30.0, 20.0], [30.0, 40.0], [10.0, 40.0]]
IMAGE = f"image_id long, raw {RAW_PAGES.simpleString()}, width int, height int, lang string, min_confidence double, include_polygon boolean"


def item(text, confidence=None, polygon=SQUARE):
    return (polygon, text, confidence)


def images(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], IMAGE)


def image(raw, width=100, height=200, lang="en", threshold=0.0, polygons=True):
    return (raw, width, height, lang, threshold, polygons)


def by_hand(raw, width, height, threshold, polygons):
    """The rules once more, item by item."""
    results, chars, total = [], 0, 0.0
    for page in raw or []:
        for it in page or []:
            if it is None or it[1] is None:
                continue
            polygon, text, confidence = it
            confidence = 1.0 if confidence is None else confidence
            if confidence < threshold:
                continue
            if polygon and len(polygon) >= 4:
                xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
                box = [min(xs), min(ys), max(xs), max(ys)]
                share = [box[0] / width, box[1] / height, box[2] / width, box[3] / height]
                shown = polygon if polygons else []
            else:
                box, share, shown = [0.0] * 4, [0.0] * 4, []
            results.append((text, confidence, box, share, shown))
            chars += len(text)
            total += confidence
    return results, (len(results), chars, total / len(results) if results else 0.0)


def flat(result):
    box, share = result["bbox"], result["bbox_normalized"]
    return (
        result["text"], result["confidence"], [*box["top_left"], *box["bottom_right"]],
        [*share["top_left"], *share["bottom_right"]], result["polygon"],
    )


def test_flatten_skips_what_carries_too_little(spark):
    raw = [None, [], [None, item("a", 0.5), item(None, 0.9), item("b")], [item("c", 0.1)]]
    rows = n.flatten_detections(images(spark, image(raw), image(None), image([])), "image_id").collect()
    assert [(r["image_id"], r["det_idx"], r["text"], r["confidence"]) for r in rows] == [
        (0, 0, "a", 0.5), (0, 1, "b", 1.0), (0, 2, "c", 0.1),
    ]


def test_normalise_matches_the_rules_on_random_images(spark):
    rng = random.Random(3)

    def polygon():
        k = rng.choice([None, 0, 3, 4, 4, 4, 6])
        return None if k is None else [[rng.uniform(0, 99), rng.uniform(0, 99)] for _ in range(k)]

    rows = []
    for _ in range(60):
        raw = [
            rng.choice([None, [], [
                rng.choice([None, (polygon(), rng.choice(["x", "wörd", "", None]), rng.choice([None, 0.0, 0.3, 0.5, 1.0]))])
                for _ in range(rng.randint(0, 5))
            ]])
            for _ in range(rng.randint(0, 4))
        ]
        rows.append(image(raw, threshold=rng.choice([0.0, 0.3, 0.5, 1.0]), polygons=rng.random() < 0.5))
    got = {r["image_id"]: r for r in n.normalise_images(images(spark, *rows), S).collect()}
    for i, (raw, width, height, _, threshold, polygons) in enumerate(rows):
        results, summary = by_hand(raw, width, height, threshold, polygons)
        assert [flat(r) for r in got[i]["results"]] == results
        assert tuple(got[i]["summary"]) == summary
        assert got[i]["error_code"] is None and got[i]["meta"]["image_width"] == width


def test_threshold_is_inclusive_and_nan_is_kept(spark):
    raw = [[item("at", 0.5), item("below", 0.49), item("nan", math.nan), item("none")]]
    row = n.normalise_images(images(spark, image(raw, threshold=0.5)), S).first()
    assert [r["text"] for r in row["results"]] == ["at", "nan", "none"]


def test_no_detections_give_a_full_row(spark):
    for row in n.normalise_images(images(spark, image(None), image([]), image([None])), S).collect():
        assert row["results"] == [] and tuple(row["summary"]) == (0, 0, 0.0)
        assert row["meta"]["model"] == "ch_PP-OCRv4_en" and row["meta"]["engine_version"] == "3.5.0"


def test_zero_size_fails_the_image_only_when_a_box_needs_it(spark):
    raw = [[item("a", 0.9)]]
    rows = n.normalise_images(
        images(spark, image(raw, width=0), image([[item("a", 0.9, SQUARE[:3])]], width=0), image(raw, height=0, threshold=1.0)), S
    ).collect()
    assert rows[0]["error_code"] == "ocr_failed" and rows[0]["results"] == []
    assert tuple(rows[0]["summary"]) == (0, 0, 0.0) and rows[0]["meta"]["image_height"] == 0
    assert rows[1]["error_code"] is None and len(rows[1]["results"]) == 1
    assert rows[2]["error_code"] is None and rows[2]["results"] == []


def test_error_rows_and_resized_flag(spark):
    base = images(spark, image([[item("a")]]))
    bad = n.error_results(base, F.lit("ocr_failed"), F.lit("boom"), S).first()
    assert (bad["error_code"], bad["error_message"], bad["results"]) == ("ocr_failed", "boom", [])
    assert tuple(bad["meta"])[4:] == (0, 0, 0, False) and tuple(bad["summary"]) == (0, 0, 0.0)
    good = n.normalise_images(base, S)
    assert n.attach_resized(good, F.lit(True)).first()["meta"]["was_resized"] is True
    assert n.attach_resized(good, F.lit(True), literal_async=True).first()["meta"]["was_resized"] is False


def test_response_has_defaults_for_missing_parts(spark):
    df = n.normalise_images(images(spark, image([[item("a", 0.25, None)]])), S)
    response = n.build_response(F.lit("r1"))
    full = json.loads(df.select(response_json(response)).first()[0])
    assert full["request_id"] == "r1" and full["status"] == "success"
    assert full["results"] == [{
        "text": "a", "confidence": 0.25, "bbox": {"top_left": [0.0, 0.0], "bottom_right": [0.0, 0.0]},
        "bbox_normalized": {"top_left": [0.0, 0.0], "bottom_right": [0.0, 0.0]}, "type": "text", "polygon": [],
    }]
    bare = df.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in ("results", "meta", "summary")])
    empty = json.loads(bare.select(response_json(response)).first()[0])
    assert empty["results"] == [] and empty["meta"]["model"] == "unknown" and empty["meta"]["lang"] == "en"
    assert empty["meta"]["image_width"] is None and empty["summary"]["avg_confidence"] == 0.0


def test_quarantine(spark):
    df = n.normalise_images(images(spark, image([[item("a", 0.5)]]), image([[item("a", 1.5)]])), S)
    assert [r["violations"] for r in n.check_output(df).collect()] == [[], ["confidence_range", "avg_confidence_range"]]


def long_tables(spark, counts, threshold=0.3):
    """Images 0..k with so many detections each, image 1 of zero size."""
    pictures, found = [], []
    for i, count in enumerate(counts):
        pictures.append((i, "en", 0 if i == 1 else 100, 200, threshold, True))
        found += [(i, j, f"t{j}", (j % 10) / 10, SQUARE) for j in range(count)]
    return (
        spark.createDataFrame(pictures, "image_id long, lang string, width int, height int, min_confidence double, include_polygon boolean"),
        spark.createDataFrame(found, "image_id long, det_idx int, text string, confidence double, polygon array<array<double>>"),
    )


def test_parts_hold_all_results_in_order(spark):
    pictures, found = long_tables(spark, [0, 5, 57, 3])
    rows = n.response_parts(pictures, found, S, part_rows=10).collect()
    by_image = {}
    for r in sorted(rows, key=lambda r: (r["image_id"], r["part"])):
        by_image.setdefault(r["image_id"], []).append(r)
    assert [len(by_image[i]) for i in range(4)] == [1, 1, 6, 1]
    texts = [d["text"] for r in by_image[2] for d in r["results"]]
    assert texts == [f"t{j}" for j in range(57) if j % 10 >= 3]
    assert all(r["summary"]["total_lines"] == len(texts) for r in by_image[2])
    assert by_image[0][0]["results"] == [] and by_image[0][0]["error_code"] is None
    assert by_image[1][0]["error_code"] == "ocr_failed" and by_image[1][0]["summary"]["total_lines"] == 0


def test_long_form_agrees_with_array_form(spark):
    pictures, found = long_tables(spark, [4, 2, 30])
    packed = found.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("det_idx", "polygon", "text", "confidence"))).alias("items")
    )
    raw = packed.select(
        "image_id",
        F.array(F.transform("items", lambda x: F.struct(x["polygon"].alias("polygon"), x["text"].alias("text"),
                                                        x["confidence"].alias("confidence")))).cast(RAW_PAGES).alias("raw"),
    )
    arrays = n.normalise_images(pictures.where("image_id != 1").join(raw, "image_id"), S)
    want = {r["image_id"]: tuple(r["summary"]) for r in arrays.collect()}
    kept = n.kept_detections(found, pictures, [])
    got = n.with_summary(pictures.where("image_id != 1"), kept).collect()
    assert {r["image_id"]: (r["total_lines"], r["total_characters"]) for r in got} == {k: w[:2] for k, w in want.items()}
    assert all(abs(r["avg_confidence"] - want[r["image_id"]][2]) < 1e-12 for r in got)
