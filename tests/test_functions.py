import datetime as dt

from pyspark.sql import functions as F

from glyphflow.functions import geometry as g, text as t


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_char_count_is_code_points(spark):
    assert one(spark, t.char_count(F.lit("aé😀")))[0] == 3


def test_iso_times(spark):
    whole, part = F.lit(dt.datetime(2024, 1, 2, 3, 4, 5)), F.lit(dt.datetime(2024, 1, 2, 3, 4, 5, 60))
    assert tuple(one(spark, t.iso_z_format(whole), t.iso_z_format(part))) == (
        "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.000060Z",
    )
    row = one(spark, t.iso_z_parse(F.lit("2024-01-02T03:04:05.000060Z")) == part, t.iso_z_parse(F.lit("no time")))
    assert row[0] is True and row[1] is None


def test_names_ids_and_estimates(spark):
    created = F.lit(dt.datetime(2024, 1, 1))
    row = one(
        spark,
        t.model_name(F.lit("de"), "m_"),
        t.job_id_of(F.lit("a"), F.lit(1)) == t.job_id_of(F.lit("a"), F.lit(1)),
        F.length(t.random_job_id()),
        t.status_url(F.lit("job_1")),
        t.iso_z_format(t.estimated_completion(created, F.lit(3), 2)),
        t.ms_from_seconds(F.lit(1.9999)),
        t.default_name(F.lit(""), F.lit(4)),
        t.default_name(F.lit(None).cast("string"), F.lit(0)),
        t.default_name(F.lit("x.png"), F.lit(0)),
    )
    assert tuple(row) == ("m_de", True, 16, "/ocr/jobs/job_1", "2024-01-01T00:06:00Z", 1999, "image_4", "image_0", "x.png")


def test_resize_plan_is_strict_and_truncates(spark):
    limit = 4096 * 4096
    cases = [(4096, 4096), (4097, 4096), (10_000, 3_000), (0, 5), (70_000, 70_000)]
    df = spark.createDataFrame(cases, "w int, h int")
    plan = g.plan_resize(F.col("w"), F.col("h"), limit)
    got = [tuple(r[0]) for r in df.select(plan).collect()]
    want = []
    for w, h in cases:
        if w * h > limit:
            scale = (limit / (w * h)) ** 0.5
            want.append((True, int(w * scale), int(h * scale)))
        else:
            want.append((False, w, h))
    assert got == want
