import datetime as dt
import random
import shutil
import time

import pytest

from glyphflow.operators.jobs import fold_job_events
from glyphflow.operators.metrics import queue_depth
from glyphflow.operators.normalise import normalise_images
from glyphflow.schemas import JOB_EVENT, RAW_PAGES
from glyphflow.settings import JOB_STATES, Settings
from glyphflow.sources.jobs import read_store
from glyphflow.streaming import jobs as sj, lifecycle as sl, once as so, queue as sq
from glyphflow.streaming.metrics import stream_request_metrics
from glyphflow.streaming.normalise import stream_normalise
from glyphflow.plans import queries as queries_module
from glyphflow.plans.queries import QUERIES
from glyphflow.session import tune
from glyphflow.streaming.run import read_batches, run_batches, run_to_files, start_files, upsert_batches, use_rocksdb

S = Settings()
T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def arriving(spark, folder, schema, batches):
    """A stream that reads one file per micro-batch, in the given order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_state_over_micro_batches_equals_batch_fold(spark, tmp_path):
    rng = random.Random(4)
    rows = [
        (f"job_{rng.randint(0, 9)}", i, T0 + dt.timedelta(minutes=i), rng.choice([*JOB_STATES, "progress"]),
         rng.choice([None, i]), rng.choice([None, f"e{i}"]))
        for i in range(200)
    ]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    use_rocksdb(spark)
    stream = arriving(spark, str(tmp_path / "in"), JOB_EVENT, [shuffled[i::4] for i in range(4)])
    store = str(tmp_path / "store")
    query = upsert_batches(sj.stream_job_state(stream), store, str(tmp_path / "cp"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    want = fold_job_events(spark.createDataFrame(rows, JOB_EVENT))
    got = read_store(spark, store).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_state_survives_a_restart(spark, tmp_path):
    use_rocksdb(spark)
    source, store, cp = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp")
    first = arriving(spark, source, JOB_EVENT, [[("a", 1, T0, "queued", None, None)]])
    upsert_batches(sj.stream_job_state(first), store, cp).awaitTermination()
    spark.createDataFrame([("a", 2, hours(1), "running", None, None)], JOB_EVENT).write.parquet(f"{source}/later")
    again = spark.readStream.schema(JOB_EVENT).parquet(f"{source}/*")
    upsert_batches(sj.stream_job_state(again), store, cp).awaitTermination()
    row = read_store(spark, store).first()
    assert (row["status"], row["created_at"], row["started_at"]) == ("running", T0, hours(1))


def test_fixed_expiry_counts_from_the_first_creation(spark, tmp_path):
    use_rocksdb(spark)
    event = lambda job, at, kind="queued": (job, int(at), hours(at), kind, None, None)
    batches = [
        [event("a", 2), event("b", 3), event("c", 30, "running")],
        [event("a", 1), event("b", 20, "running")],
        [event("a", 10), event("d", 26)],
        [event("e", 26.5)],
    ]
    stream = arriving(spark, str(tmp_path / "in"), JOB_EVENT, batches)
    out = str(tmp_path / "out")

    def reported():
        take = sj.fixed_expiry(spark, out, S, dt.timedelta(hours=24))
        run_batches(stream, take, str(tmp_path / "cp")).awaitTermination()
        found = read_batches(spark, f"{out}/expired", "job_id string, created_at timestamp, expired_at timestamp")
        return sorted((r["job_id"], r["created_at"], r["expired_at"]) for r in found.collect())

    assert reported() == []  # the clock stands at 2.5 h
    late = [event("z", 51.5), event("b", 51)]  # b is created again long after
    spark.createDataFrame(late, JOB_EVENT).write.parquet(str(tmp_path / "in" / "zzz"))
    want = [("a", hours(1), hours(25)), ("b", hours(3), hours(27))]
    assert reported() == want
    assert reported() == want  # the same checkpoint again adds nothing


def test_sliding_expiry_restarts_at_each_event(spark, tmp_path):
    use_rocksdb(spark)
    event = lambda job, at: (job, int(at), hours(at), "progress", None, None)
    batches = [[event("a", 0), event("b", 0)], [event("a", 20)], [event("x", 30)], [event("x", 44.5)]]
    stream = arriving(spark, str(tmp_path / "in"), JOB_EVENT, batches)
    out = run_to_files(sj.stream_sliding_expiry(stream, S), "test-sliding")
    assert {r["job_id"]: (r["last_event_at"], r["expired_at"]) for r in out.collect()} == {
        "b": (T0, hours(24)), "a": (hours(20), hours(44)),
    }


def test_metrics_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    use_rocksdb(spark)
    schema = "ts timestamp, endpoint string, lang string, status string, duration double"
    minute = lambda m: T0 + dt.timedelta(minutes=m)
    row = lambda m, d=1.0: (minute(m), "/ocr", "en", "success", d)
    batches = [[row(1), row(4, 0.1)], [row(2), row(30)], [row(29)], [row(1)], [row(60)]]
    stream = arriving(spark, str(tmp_path / "in"), schema, batches)
    out = run_to_files(stream_request_metrics(stream), "test-metrics")
    got = {r["window_start"]: (r["n_requests"], r["bucket_0"], r["bucket_3"]) for r in out.collect()}
    # The second row at minute 1 comes after its window was closed by the watermark (minute 20) and is not counted.
    assert got == {minute(0): (3, 1, 3), minute(25): (1, 0, 1), minute(30): (1, 0, 1)}


def test_submitted_once(spark, tmp_path):
    use_rocksdb(spark)
    batches = [[("a", T0), ("a", T0), ("b", T0)], [("a", hours(1)), ("c", hours(1))]]
    stream = arriving(spark, str(tmp_path / "in"), "job_id string, ts timestamp", batches)
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        run_batches(stream, sj.submitted_once(spark, out), str(tmp_path / "cp")).awaitTermination()
        rows = read_batches(spark, f"{out}/submitted", "job_id string, ts timestamp").collect()
        assert sorted(map(tuple, rows)) == [("a", T0), ("b", T0), ("c", hours(1))]


@pytest.mark.parametrize("name", [n for n in QUERIES if n.startswith("x_")])
def test_answers_do_not_depend_on_micro_batches(spark, tmp_path, name):
    """The tables cut by time into a dozen files, one for each trigger, give the answers of one batch."""
    source = "/root/testdata/sf0.001"
    cut = {"events": "ts", "documents": "doc_id"}
    for table, order in cut.items():
        rows = spark.read.parquet(f"{source}/{table}.parquet").orderBy(order).collect()
        schema = spark.read.parquet(f"{source}/{table}.parquet").schema
        for i in range(12):
            part = rows[i * len(rows) // 12:(i + 1) * len(rows) // 12]
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{table}.parquet")
            time.sleep(0.01)
    shutil.copy(f"{source}/orders.parquet", tmp_path)
    build = queries_module.__dict__[name]
    tune(spark)
    many = build(queries_module.Tables(spark, str(tmp_path), files_per_trigger=1))
    one = QUERIES[name](spark, source)
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))


def test_normalise_on_a_stream_equals_batch(spark, tmp_path):
    schema = f"image_id int, raw {RAW_PAGES.simpleString()}, width int, height int, lang string, min_confidence double, include_polygon boolean"
    square = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]]
    rows = [(i, [[(square, f"t{i}", i / 10)], None], 8, 8, "en", 0.3, True) for i in range(6)]
    stream = arriving(spark, str(tmp_path / "in"), schema, [rows[:3], rows[3:]])
    got = run_to_files(stream_normalise(stream, S).select("image_id", "results", "summary"), "test-normalise")
    want = normalise_images(spark.createDataFrame(rows, schema), S).select("image_id", "results", "summary")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "Exchange" not in normalise_images(spark.createDataFrame(rows, schema), S)._jdf.queryExecution().executedPlan().toString()


def lifecycle_rows(out):
    return sorted((r.job_id, -1 if r.seq is None else r.seq, r.kind, r.status, r.accepted) for r in out)


def lifecycle_run(spark, folder, batches):
    use_rocksdb(spark)
    stream = sl.stream_lifecycle(arriving(spark, f"{folder}/in", JOB_EVENT, batches), S)
    query = start_files(stream, f"{folder}/out", f"{folder}/cp")
    query.awaitTermination()
    rows = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    return lifecycle_rows(spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()), rows


def event(job, i, when, kind):
    return (job, i, when, kind, None, None)


LIVES = [
    event("a", 1, hours(0), "queued"), event("a", 2, hours(1), "running"), event("b", 3, hours(1), "running"), event("b", 4, hours(2), "queued"),
    event("a", 5, hours(3), "queued"), event("a", 6, hours(4), "completed"), event("a", 7, hours(5), "cancelled"), event("b", 8, hours(26), "cancelled"),
    event("a", 9, hours(26), "running"), event("a", 10, hours(27), "queued"), event("c", 11, hours(100), "progress"), event("c", 12, hours(100), "failed"),
]
STEPS = [
    ("a", 1, "queued", "queued", True), ("a", 2, "running", "running", True), ("a", 5, "queued", "running", False), ("a", 6, "completed", "completed", True),
    ("a", 7, "cancelled", "completed", False), ("a", -1, "expired", "expired", True), ("a", 9, "running", "", False), ("a", 10, "queued", "queued", True),
    ("a", -1, "expired", "expired", True), ("b", 3, "running", "", False), ("b", 4, "queued", "queued", True), ("b", 8, "cancelled", "cancelled", True),
    ("b", -1, "expired", "expired", True), ("c", 12, "failed", "", False),
]


def test_lifecycle_turns_illegal_steps_away_and_ends(spark, tmp_path):
    one, state = lifecycle_run(spark, str(tmp_path / "one"), [LIVES])
    assert one == sorted(STEPS)
    # Once the watermark has passed, nothing is left of the jobs.
    assert state[-1]["numRowsTotal"] == 0
    many, state = lifecycle_run(spark, str(tmp_path / "many"), [[e] for e in LIVES])
    assert many == sorted(STEPS) and state[-1]["numRowsTotal"] == 0 and max(s["numRowsTotal"] for s in state) > 0


def test_exactly_the_time_to_live_is_alive(spark, tmp_path):
    rows, _ = lifecycle_run(spark, str(tmp_path), [[event("a", 1, hours(0), "queued"), event("a", 2, hours(24), "running")]])
    assert rows == [("a", 1, "queued", "queued", True), ("a", 2, "running", "running", True)]


def test_cancels_and_starts_join_on_two_streams(spark, tmp_path):
    start = "job_id string, start_ts timestamp"
    cancel = "job_id string, ts timestamp"
    starts = arriving(spark, str(tmp_path / "starts"), start, [
        [("a", hours(1)), ("b", hours(1)), ("a", hours(3))], [("a", hours(5)), ("b", hours(30)), ("c", hours(4))], [("end", hours(90))], [("end", hours(91))]])
    cancels = arriving(spark, str(tmp_path / "cancels"), cancel, [
        [("a", hours(2)), ("a", hours(2.5))], [("b", hours(3)), ("c", hours(4))], [("end", hours(90))], [("end", hours(91))]])
    use_rocksdb(spark)
    query = start_files(sj.stream_effective_images(starts, cancels, S), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    out = {(r.job_id, r.start_ts) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # The cancel of "b" at 3 is forgotten after 24 hours; what is after the watermark is still open.
    assert out == {("a", hours(1)), ("b", hours(1)), ("b", hours(30))}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_queue_depth_is_carried_over_any_cut(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"job_{rng.randint(0, 30)}", i, T0 + dt.timedelta(minutes=i), rng.choice([*JOB_STATES, "progress"]), None, None) for i in range(300)]
    want = sorted(tuple(r) for r in queue_depth(spark.createDataFrame(rows, JOB_EVENT)).select("seq", "job_id", "delta", "depth").collect())
    use_rocksdb(spark)
    for name, size in (("one", 300), ("many", 60)):
        batches = [rng.sample(rows[a:a + size], size) for a in range(0, 300, size)]
        folder = str(tmp_path / name)
        take = sq.carried_depth(spark, f"{folder}/out")
        query = run_batches(sq.stream_queue_deltas(arriving(spark, f"{folder}/in", JOB_EVENT, batches)), take, f"{folder}/cp")
        query.awaitTermination()
        read = lambda: sorted(tuple(r) for r in spark.read.schema(sq.DEPTHS).parquet(f"{folder}/out/depths").select("seq", "job_id", "delta", "depth").collect())  # noqa: E731, B023
        assert read() == want
    # The last micro-batch once more.
    last = spark.read.schema(sq.DELTAS).parquet(f"{folder}/out/deltas/batch=4").collect()
    take(spark.createDataFrame(last, sq.DELTAS), 4)
    assert read() == want


def test_once_by_state_reads_no_history_and_equals_the_stored_answer(spark, tmp_path):
    use_rocksdb(spark)
    rows = [(f"job_{i % 7}", T0 + dt.timedelta(hours=2 * i), "queued") for i in range(40)]
    batches = [rows[a:a + 8] for a in range(0, 40, 8)]
    schema = "job_id string, ts timestamp, kind string"
    stream = arriving(spark, str(tmp_path / "in"), schema, batches)
    start_files(so.stream_submitted_once(stream), str(tmp_path / "once"), str(tmp_path / "cp1")).awaitTermination()
    assert sorted((r.job_id, r.ts) for r in spark.read.parquet(str(tmp_path / "once")).collect()) == [(f"job_{i}", hours(2 * i)) for i in range(7)]
    query = start_files(so.stream_fixed_expiry(stream, S), str(tmp_path / "ended"), str(tmp_path / "cp2"))
    query.awaitTermination()
    ended = sorted((r.job_id, r.created_at, r.expired_at) for r in spark.read.parquet(str(tmp_path / "ended")).collect())
    assert ended == [(f"job_{i}", hours(2 * i), hours(2 * i + 24)) for i in range(7)]
    # One job's state each, whatever has come before; nothing but the new file is read.
    sizes = {p["numInputRows"] for p in query.recentProgress}
    assert sizes <= {8, 0} and query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 7


def test_a_job_ends_exactly_at_its_time_to_live(spark, tmp_path):
    use_rocksdb(spark)
    rows = [("a", T0, "queued"), ("b", hours(1), "queued"), ("z", hours(24) + dt.timedelta(minutes=10), "queued")]
    stream = arriving(spark, str(tmp_path / "in"), "job_id string, ts timestamp, kind string", [rows])
    start_files(so.stream_fixed_expiry(stream, S), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a"]
