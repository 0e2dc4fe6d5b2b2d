import datetime as dt

from pyspark.sql import functions as F

from glyphflow.operators import metrics as m
from glyphflow.schemas import JOB_EVENT
from glyphflow.settings import REQUEST_BOUNDS
from glyphflow.sources.sinks import write_metrics_text

T0 = dt.datetime(2024, 1, 1)
REQUEST = ("endpoint string, lang string, status string, duration double, batch_size int, job_type string, model string, "
           "device string, metered boolean, called boolean")


def requests(spark):
    rows = [
        ("/ocr", "en", "success", 0.1, None, None, "m", "cpu", True, True),
        ("/ocr", "en", "success", 0.11, None, None, "m", "cpu", True, True),
        ("/ocr", "en", "error", 500.0, None, None, "m", "gpu", True, False),
        ("/ocr/batch", "de", "partial", 3.0, 20, "sync", "m", "cpu", True, False),
        ("/ocr/batch", "de", "success", 3.0, 21, "sync", "m", "cpu", False, True),
        ("/ocr/jobs", "de", "success", 2.5, 50, "async", "m", "cpu", True, True),
        ("/ocr/jobs", "de", "success", 2.5, 51, None, "m", "cpu", True, True),
    ]
    return spark.createDataFrame(rows, REQUEST)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_bounds_are_inclusive_and_cumulative(spark):
    rows = as_set(m.request_durations(requests(spark)).where("endpoint = '/ocr'").select("sample", "le", "value"))
    counts = {le: v for sample, le, v in rows if sample == "bucket"}
    assert counts["0.1"] == 1 and counts["0.25"] == 2 and counts["120.0"] == 2 and counts["+Inf"] == 3
    assert len(counts) == len(REQUEST_BOUNDS) + 1
    assert ("count", None, 3.0) in rows and ("sum", None, 500.21) in rows


def test_batch_sizes_need_size_and_type(spark):
    rows = as_set(m.batch_sizes(requests(spark)).select("job_type", "sample", "le", "value"))
    assert ("async", "bucket", "50.0", 1.0) in rows and ("async", "count", None, 1.0) in rows
    assert ("sync", "bucket", "20.0", 1.0) in rows and ("sync", "bucket", "25.0", 2.0) in rows
    assert {r[0] for r in rows} == {"async", "sync"}


def test_one_pass_rollup_gives_the_same_families(spark):
    df = requests(spark)
    metered = df.where("metered")
    families = m.families_of_rollup(m.request_rollup(df))
    counts, labels = families["ocr_requests_total"]
    direct = m.count_requests(metered).select(*labels, F.col("value").cast("double").alias("value"))
    assert as_set(counts.select(*labels, "value")) == as_set(direct)
    for name, direct in [
        ("ocr_request_duration_seconds", m.request_durations(metered)),
        ("ocr_batch_size", m.batch_sizes(metered)),
        ("ocr_inference_time_seconds", m.inference_times(df.where("called"))),
    ]:
        assert as_set(families[name][0]) == as_set(direct)


def test_metered_outcomes(spark):
    names = ["success", "partial", "error", "precheck", "ocr_failed", "batch_too_large", "cancelled", "crashed", None]
    df = spark.createDataFrame([(n,) for n in names], "o string")
    assert [r[0] for r in df.select(m.is_metered(F.col("o"))).collect()] == [True] * 3 + [False] * 6


def test_gauge_keeps_the_last_value(spark):
    df = spark.createDataFrame([("det", 1, 0), ("det", 3, 1), ("det", 2, 0), ("rec", 1, 0)], "model_type string, at int, v int")
    assert as_set(m.last_value(df, ["model_type"], "v", "at")) == {("det", 1.0), ("rec", 0.0)}


def test_queue_depth_intended_and_literal(spark):
    steps = [
        ("a", "queued"), ("b", "queued"), ("a", "running"), ("a", "completed"), ("b", "running"), ("b", "cancelled"),
        ("b", "failed"), ("c", "cancelled"), ("c", "queued"), ("d", "queued"), ("d", "running"), ("d", "failed"), ("a", "queued"),
    ]
    rows = [(job, i, T0, kind, None, "boom" if kind == "failed" and job == "d" else None) for i, (job, kind) in enumerate(steps)]
    events = spark.createDataFrame(rows, JOB_EVENT).repartition(3)
    depth = lambda **o: [(r["seq"], r["delta"], r["depth"]) for r in m.queue_depth(events, **o).orderBy("seq").collect()]
    intended = [(0, 1, 1), (1, 1, 2), (3, -1, 1), (5, -1, 0), (8, 1, 1), (9, 1, 2), (11, -1, 1)]
    assert depth() == intended and depth(min_rows=2) == intended
    assert depth(literal=True) == [
        (0, 1, 1), (1, 1, 2), (5, -2, 0), (7, -1, -1), (8, 1, 0), (9, 1, 1), (11, -1, 0), (12, 1, 1),
    ]


def test_number_text(spark):
    cases = {3.0: "3.0", 0.0: "0.0", 0.25: "0.25", 999999.0: "999999.0", 1000000.0: "1e+06", 1234567.5: "1.2345675e+06",
             12345678.0: "1.2345678e+07", -5.5: "-5.5"}
    df = spark.createDataFrame([(k,) for k in cases], "v double")
    assert [r[0] for r in df.select(m.number_text(F.col("v"))).collect()] == list(cases.values())


def test_number_text_of_special_and_small_numbers(spark):
    cases = {float("nan"): "NaN", float("inf"): "+Inf", float("-inf"): "-Inf", 1e-7: "1e-07", 2.5e-5: "2.5e-05", 1.5e-12: "1.5e-12", 0.0001: "0.0001"}
    df = spark.createDataFrame([(k,) for k in cases], "v double")
    assert [r[0] for r in df.select(m.number_text(F.col("v"))).collect()] == list(cases.values())


def test_exposition_text(spark, tmp_path):
    counts = spark.createDataFrame([("/ocr", "e\"n\\\n", "success", 2.0)], "endpoint string, lang string, status string, value double")
    depth = spark.createDataFrame([(4.0,)], "value double")
    lines = m.exposition({
        "ocr_requests_total": (counts, ["endpoint", "lang", "status"]),
        "ocr_request_duration_seconds": (m.request_durations(requests(spark).where("endpoint = '/ocr/jobs'")), ["endpoint", "lang"]),
        "ocr_job_queue_depth": (depth, []),
    })
    write_metrics_text(lines, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    got = "".join(p.read_text() for p in parts).splitlines()
    series = 'endpoint="/ocr/jobs",lang="de"'
    bounds = ["0.1", "0.25", "0.5", "1.0", "2.5", "5.0", "10.0", "30.0", "60.0", "120.0", "+Inf"]
    assert got == [
        "# HELP ocr_requests_total Total number of OCR requests",
        "# TYPE ocr_requests_total counter",
        'ocr_requests_total{endpoint="/ocr",lang="e\\"n\\\\\\n",status="success"} 2.0',
        "# HELP ocr_request_duration_seconds OCR request duration in seconds",
        "# TYPE ocr_request_duration_seconds histogram",
        *[f'ocr_request_duration_seconds_bucket{{{series},le="{b}"}} {0.0 if i < 4 else 2.0}' for i, b in enumerate(bounds)],
        f"ocr_request_duration_seconds_count{{{series}}} 2.0",
        f"ocr_request_duration_seconds_sum{{{series}}} 5.0",
        "# HELP ocr_job_queue_depth Number of pending OCR jobs",
        "# TYPE ocr_job_queue_depth gauge",
        "ocr_job_queue_depth 4.0",
    ]
