"""Whole job runs: cancels, crashes, results, and any cut into micro-batches."""

import base64
import datetime as dt

from glyphflow.operators import runs
from glyphflow.settings import Settings
from glyphflow.streaming import runs as sr
from glyphflow.streaming.run import run_batches

S = Settings()
T0 = dt.datetime(2024, 1, 1)
SUBMISSION = "job_id string, created_at timestamp, images array<string>, lang string, min_confidence double"
ALL = SUBMISSION + ", kind string, ts timestamp, error string"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def png(i):
    return base64.b64encode(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x10\0\0\0\x10\x08\x02\0\0\0" + b"x" * i).decode()


def recogniser():
    return lambda data: [[[[[0.0, 0.0], [8.0, 0.0], [8.0, 8.0], [0.0, 8.0]], (f"n{len(data)}", 0.9)]]]


def submit(job, images):
    return (job, T0, images, "auto", 0.0, "submit", None, None)


def message(job, kind, seconds, error=None):
    return (job, None, None, None, None, kind, at(seconds), error)


# Images take two minutes each: three of them end at 120, 240 and 360 seconds.
GOOD = [png(1), png(2), png(3)]
ROWS = [
    submit("whole", GOOD), submit("bad", [png(1), "é", png(3)]), submit("large", [png(1)] * 21),
    submit("cancelled", GOOD), message("cancelled", "cancel", 130), message("cancelled", "cancel", 140),
    submit("at_a_start", GOOD), message("at_a_start", "cancel", 120),
    submit("at_once", GOOD), message("at_once", "cancel", 0),
    submit("last", GOOD), message("last", "cancel", 250),
    submit("late", GOOD), message("late", "cancel", 360), message("late", "crash", 360, "too late"),
    submit("crashed", GOOD), message("crashed", "crash", 240, "lost"), message("crashed", "cancel", 250),
    submit("both", GOOD), message("both", "cancel", 130), message("both", "crash", 150, "lost"),
    submit("stopped", GOOD), message("stopped", "cancel", 130), message("stopped", "crash", 250, "too late"),
    submit("silent", [png(1), "é", "é"]), message("silent", "cancel", 130),
    message("unknown", "cancel", 5), message("whole", "cancel", -1),
]
WANT = {
    "whole": ("completed", 3, [0, 1, 2], None, 200), "bad": ("failed", 3, [0, 1, 2], None, 500), "large": (None, None, None, None, 404),
    "cancelled": ("cancelled", 2, [0, 1], None, 200), "at_a_start": ("cancelled", 1, [0], None, 200), "at_once": ("cancelled", None, None, None, 200),
    "last": ("completed", 3, [0, 1, 2], None, 200), "late": ("completed", 3, [0, 1, 2], None, 200), "crashed": ("failed", 2, [0, 1], "lost", 500),
    "both": ("failed", 1, [0], "lost", 500), "stopped": ("cancelled", 2, [0, 1], None, 200), "silent": ("cancelled", 1, [0], None, 200),
    "unknown": (None, None, None, None, 404),
}


def run_in(spark, folder, batches):
    """The view after the rows have arrived in these micro-batches."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ALL).coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    stream = spark.readStream.schema(ALL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = run_batches(stream, sr.run_jobs(spark, f"{folder}/out", recogniser, S), f"{folder}/checkpoint")
    query.awaitTermination()
    return view(spark, f"{folder}/out")


def view(spark, folder):
    headers, results, messages, _ = sr.read_runs(spark, folder)
    ids = spark.createDataFrame([(k,) for k in WANT], "job_id string")
    return {r.job_id: r for r in runs.run_view(ids, headers, results, messages, S).collect()}


def check(found):
    assert found.keys() == WANT.keys()
    for job, (status, processed, shown, error, http) in WANT.items():
        r = found[job]
        names = None if r.results is None else [x.filename for x in r.results]
        assert (r.status, r.processed, names, r.error, r.http_status) == (status, processed, None if shown is None else [f"image_{i}" for i in shown], error, http), job
    assert [x.error is None for x in found["bad"].results] == [True, False, True]
    assert found["whole"].results[2].results[0].text == "n32"


def test_answers_do_not_depend_on_the_micro_batches(spark, tmp_path):
    check(run_in(spark, str(tmp_path / "one"), [ROWS]))
    twelve = [ROWS[i::12] for i in range(12)]
    check(run_in(spark, str(tmp_path / "backwards"), [rows for rows in reversed(twelve) if rows]))


def test_a_repeated_micro_batch_changes_nothing_and_a_broken_one_is_not_seen(spark, tmp_path):
    folder = str(tmp_path)
    check(run_in(spark, folder, [ROWS]))
    batch = spark.createDataFrame(ROWS, ALL)
    again = sr.run_jobs(spark, f"{folder}/out", recogniser, S)
    again(batch, 0)
    check(view(spark, f"{folder}/out"))

    # Results of batch 7 are written, its headers are not.
    spark.read.parquet(f"{folder}/out/results").where("batch = 0").drop("batch").write.parquet(f"{folder}/out/results/batch=7")
    check(view(spark, f"{folder}/out"))
    assert {r.job_id: r.error_code for r in sr.read_runs(spark, f"{folder}/out")[3].collect()} == {"large": "batch_too_large"}


def test_images_after_a_known_cancel_are_not_processed(spark, tmp_path):
    folder = str(tmp_path)
    run_in(spark, folder, [ROWS])
    done = {(r.job_id, r.idx) for r in spark.read.parquet(f"{folder}/out/results").collect()}
    assert {i for j, i in done if j == "cancelled"} == {0, 1} and not [i for j, i in done if j == "at_once"]


def test_cancel_answers(spark):
    headers = spark.createDataFrame([(j, T0, 3) for j in WANT if j not in ("unknown", "large")], "job_id string, created_at timestamp, total int")
    messages = spark.createDataFrame([(r[0], r[5], r[6], r[7]) for r in ROWS if r[5] != "submit"], sr.MESSAGES)
    found = {(r.job_id, (r.ts - T0).total_seconds()): r.error_code for r in runs.cancel_answers(messages, headers, S).collect()}
    assert found == {
        ("cancelled", 130): None, ("cancelled", 140): "cannot_cancel", ("at_a_start", 120): None, ("at_once", 0): None, ("last", 250): None,
        ("late", 360): "cannot_cancel", ("crashed", 250): "cannot_cancel", ("both", 130): None, ("stopped", 130): None, ("silent", 130): None,
        ("unknown", 5): "job_not_found", ("whole", -1): "job_not_found",
    }
