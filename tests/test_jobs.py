import datetime as dt
import random

from pyspark.sql import functions as F

from glyphflow.operators import batch, jobs as j
from glyphflow.schemas import JOB_EVENT
from glyphflow.settings import JOB_STATES, LEGAL_TRANSITIONS, Settings

S = Settings()
T0 = dt.datetime(2024, 1, 1)


def event(job, seq, kind, processed=None, error=None):
    return (job, seq, T0 + dt.timedelta(minutes=seq), kind, processed, error)


def table(spark, rows):
    return spark.createDataFrame(rows, JOB_EVENT).repartition(3)


def random_events(n=300, seed=2):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = rng.choice([*JOB_STATES, "progress"])
        processed = rng.choice([None, rng.randint(0, 20)]) if kind == "progress" else None
        rows.append(event(f"job_{rng.randint(0, 12)}", seq, kind, processed, rng.choice([None, "", f"e{seq}"])))
    return rows


def fold(rows):
    """One job document after another, as updates in order."""
    docs = {}
    for job, seq, ts, kind, processed, error in sorted(rows, key=lambda r: r[1]):
        doc = docs.setdefault(job, dict.fromkeys(["status", "created_at", "started_at", "completed_at", "processed", "error"]))
        if kind != "progress":
            doc["status"] = kind
        if kind == "queued" and doc["created_at"] is None:
            doc["created_at"] = ts
        if kind == "running" and doc["started_at"] is None:
            doc["started_at"] = ts
        if kind in ("completed", "failed"):
            doc["completed_at"] = ts
        if processed is not None:
            doc["processed"] = processed
        if error:
            doc["error"] = error
        doc["last_event_at"], doc["last_seq"] = ts, seq
    return docs


def test_fold_equals_updates_in_order(spark):
    rows = random_events()
    got = {r["job_id"]: r.asDict() for r in j.fold_job_events(table(spark, rows)).collect()}
    for r in got.values():
        r.pop("job_id")
    assert got == fold(rows)


def test_terminal_wins_option(spark):
    rows = [event("a", 1, "queued"), event("a", 2, "running"), event("a", 3, "cancelled"), event("a", 4, "completed"),
            event("b", 5, "queued"), event("b", 6, "completed"), event("b", 7, "failed")]
    last = {r["job_id"]: r["status"] for r in j.fold_job_events(table(spark, rows)).collect()}
    final = {r["job_id"]: (r["status"], r["completed_at"]) for r in j.fold_job_events(table(spark, rows), terminal_wins=True).collect()}
    assert last == {"a": "completed", "b": "failed"}
    assert final == {"a": ("cancelled", None), "b": ("completed", T0 + dt.timedelta(minutes=6))}


def test_transitions_with_and_without_hot_jobs(spark):
    rows = random_events(400, 9)
    want, last = set(), {}
    for job, seq, _, kind, _, _ in sorted(rows, key=lambda r: r[1]):
        if kind != "progress":
            before = last.get(job)
            want.add((job, seq, before, (before or "", kind) in LEGAL_TRANSITIONS))
            last[job] = kind
    for options in ({}, {"min_rows": 20}):
        out = j.status_transitions(table(spark, rows), **options).collect()
        assert {(r["job_id"], r["seq"], r["prev_status"], r["is_legal"]) for r in out} == want


def test_create_jobs(spark):
    rows = [("a", T0, ["x", "y"]), ("b", T0, ["z"] * 20), ("c", T0, ["z"] * 21)]
    requests = spark.createDataFrame(rows, "job_id string, created_at timestamp, images array<string>")
    headers, images, rejected = j.create_jobs(requests, S)
    got = {r["job_id"]: (r["status"], r["processed"], r["total"], r["status_url"], r["estimated_completion"]) for r in headers.collect()}
    assert got == {
        "a": ("queued", 0, 2, "/ocr/jobs/a", T0 + dt.timedelta(minutes=4)),
        "b": ("queued", 0, 20, "/ocr/jobs/b", T0 + dt.timedelta(minutes=40)),
    }
    assert {(r["job_id"], r["idx"]) for r in images.collect()} == {("a", 0), ("a", 1)} | {("b", i) for i in range(20)}
    assert [tuple(r) for r in rejected.collect()] == [("c", "batch_too_large", "Batch size 21 exceeds maximum 20", 400)]


def test_cancel_and_lookup(spark):
    state = spark.createDataFrame([(f"job_{s}", s, T0) for s in JOB_STATES], "job_id string, status string, created_at timestamp")
    ids = spark.createDataFrame([(f"job_{s}",) for s in [*JOB_STATES, "nobody"]], "job_id string")
    got = {r["job_id"]: tuple(r)[1:] for r in j.cancel_jobs(ids, state).collect()}
    assert got["job_queued"] == got["job_running"] == ("cancelled", "2024-01-01T00:00:00Z", None, None, 200)
    assert got["job_failed"] == ("failed", None, "cannot_cancel", "Job with status 'failed' cannot be cancelled", 400)
    assert got["job_cancelled"][1:] == (None, "cannot_cancel", "Job with status 'cancelled' cannot be cancelled", 400)
    assert got["job_nobody"] == (None, None, "job_not_found", "Job job_nobody not found", 404)
    events = j.cancel_events(j.cancel_jobs(ids, state), F.lit(9).cast("bigint"), F.lit(T0))
    assert {(r["job_id"], r["kind"]) for r in events.collect()} == {("job_queued", "cancelled"), ("job_running", "cancelled")}
    assert j.lookup_job(state, "job_failed").count() == 1 and j.lookup_job(state, "x").count() == 0
    assert j.known_jobs(ids, state).count() == 5 and j.unknown_jobs(ids, state).collect()[0][0] == "job_nobody"


def test_crash_events_fold_to_failed(spark):
    jobs = spark.createDataFrame([("a", 5, T0)], "job_id string, seq long, ts timestamp")
    log = table(spark, [event("a", 1, "running")]).unionByName(j.crash_events(jobs, F.lit("boom")))
    row = j.fold_job_events(log).first()
    assert (row["status"], row["error"], row["completed_at"]) == ("failed", "boom", T0)


def test_images_before_cancel_and_pending(spark):
    m = lambda k: T0 + dt.timedelta(minutes=k)
    images = spark.createDataFrame([("a", 0, m(1)), ("a", 1, m(2)), ("a", 2, m(3)), ("b", 0, m(9))], "job_id string, idx int, start_ts timestamp")
    log = table(spark, [event("a", 2, "cancelled"), event("a", 7, "cancelled"), event("b", 1, "running")])
    assert {(r["job_id"], r["idx"]) for r in j.effective_images(images, log).collect()} == {("a", 0), ("b", 0)}
    state = spark.createDataFrame([("a", "running"), ("b", "queued")], "job_id string, status string")
    done = spark.createDataFrame([("a", 0)], "job_id string, idx int")
    assert {(r["job_id"], r["idx"]) for r in j.pending_images(images, done, state).collect()} == {("a", 1), ("a", 2)}


def test_progress_and_outcome(spark):
    items = spark.createDataFrame(
        [("a", 0, "success"), ("a", 1, "error"), ("b", 0, "success"), ("c", 0, "error")], "job_id string, idx int, status string"
    )
    got = {(r["job_id"], r["idx"]): (r["processed"], r["total"]) for r in j.running_progress(items).collect()}
    assert got == {("a", 0): (1, 2), ("a", 1): (2, 2), ("b", 0): (1, 1), ("c", 0): (1, 1)}
    got = {r["job_id"]: (r["status"], r["request_status"]) for r in j.job_outcome(items).collect()}
    assert got == {"a": ("failed", "partial"), "b": ("completed", "success"), "c": ("failed", "error")}


def test_progress_writes_skip_images_that_cannot_be_decoded(spark):
    items = spark.createDataFrame(
        [("a", 0, False), ("a", 1, True), ("a", 2, False), ("b", 0, True)], "job_id string, idx int, decode_failed boolean"
    )
    got = sorted(tuple(r) for r in j.progress_writes(items).collect())
    assert got == [("a", 0, 1, 3), ("a", 2, 3, 3), ("a", 3, 3, 3), ("b", 1, 1, 1)]


def test_status_view(spark):
    log = table(spark, [event("a", 1, "queued"), event("b", 2, "queued"), event("b", 3, "failed", None, "boom")])
    items = spark.createDataFrame([("b", 0, "image_0", "error")], "job_id string, idx int, filename string, status string")
    empty = spark.createDataFrame([("a", [])], "job_id string, results array<struct<filename:string,status:string>>")
    results = batch.ordered_results(items, ["filename", "status"], "job_id").unionByName(empty)
    ids = spark.createDataFrame([("a",), ("b",), ("z",)], "job_id string")
    totals = spark.createDataFrame([("a", 3), ("b", 1)], "job_id string, total long")
    got = {r["job_id"]: r for r in j.job_status_view(ids, j.fold_job_events(log), results, totals).collect()}
    assert (got["a"]["total"], got["z"]["total"]) == (3, None)
    assert (got["a"]["http_status"], got["a"]["results"], got["a"]["created_at"]) == (200, None, "2024-01-01T00:01:00Z")
    assert (got["b"]["http_status"], got["b"]["error"], len(got["b"]["results"])) == (500, "boom", 1)
    assert (got["z"]["http_status"], got["z"]["error_code"]) == (404, "job_not_found")


def test_expiry_is_strict(spark):
    day = dt.timedelta(hours=24)
    rows = [("exact", T0, T0), ("late", T0 - dt.timedelta(seconds=1), T0), ("none", None, T0 - 2 * day)]
    state = spark.createDataFrame(rows, "job_id string, created_at timestamp, last_event_at timestamp")
    as_of = F.lit(T0 + day)
    fixed = {r["job_id"]: (r["is_expired"], r["http_status"]) for r in j.expiry_view(state, as_of, S).collect()}
    assert fixed == {"exact": (False, 200), "late": (True, 404), "none": (False, 200)}
    assert {r[0] for r in j.alive_jobs(state, as_of, S, sliding=True).collect()} == {"exact", "late"}


def test_list_takes_its_limit_before_the_filter(spark):
    state = spark.createDataFrame([(f"job_{i}", "failed" if i % 2 else "queued") for i in range(8)], "job_id string, status string")
    ids = lambda df: [r["job_id"] for r in df.collect()]
    assert ids(j.list_jobs(state, "failed", 3)) == ["job_7", "job_5"]
    assert ids(j.list_jobs(state, "failed", 3, filter_first=True)) == ["job_7", "job_5", "job_3"]
    assert ids(j.list_jobs(state, None, 2)) == ["job_7", "job_6"]
    assert "TakeOrderedAndProject" in j.list_jobs(state, None, 2)._jdf.queryExecution().executedPlan().toString()


def test_newest_version_wins(spark):
    rows = [("a", 0, "x"), ("a", 2, None), ("b", 1, "y")]
    df = spark.createDataFrame(rows, "job_id string, version int, v string")
    assert {(r["job_id"], r["version"], r["v"]) for r in j.latest_version(df).collect()} == {("a", 2, None), ("b", 1, "y")}
