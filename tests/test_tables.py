"""Tables that are read in part: by day, by id; counts observed while a run happens; the exposition as files."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from glyphflow.operators import jobs, metrics
from glyphflow.settings import Settings
from glyphflow.sources import jobs as store, sinks

S = Settings()
T0 = dt.datetime(2024, 1, 1)
STATE = "job_id string, status string, created_at timestamp"
BY_DAY = STATE + ", day date"


def now():
    return F.lit("2024-01-10 06:00:00").cast("timestamp")


def states(spark):
    rows = [(f"job_{i}", "running", T0 + dt.timedelta(hours=6 * i)) for i in range(40)] + [("none", "running", None)]
    return spark.createDataFrame(rows, STATE)


def spoil(path, days):
    """Make the folders of some days unreadable."""
    for day in days:
        for name in os.listdir(f"{path}/day={day}"):
            if name.endswith(".parquet"):
                with open(f"{path}/day={day}/{name}", "wb") as file:
                    file.write(b"not a table")


def test_alive_jobs_are_read_from_their_days_only(spark, tmp_path):
    path = str(tmp_path / "days")
    store.write_by_day(states(spark), path)
    spoil(path, [f"2024-01-0{d}" for d in range(1, 9)])
    alive = {r.job_id for r in store.read_alive(spark, path, BY_DAY, now(), S).collect()}
    want = jobs.alive_jobs(states(spark), now(), S)
    assert alive == {r.job_id for r in want.collect()} and len(alive) == 8 and "none" in alive
    with pytest.raises(Exception, match="(?i)parquet"):
        spark.read.schema(BY_DAY).parquet(path).collect()


def test_days_of_a_table_prune_while_the_query_runs(spark, tmp_path):
    path = str(tmp_path / "days")
    store.write_by_day(states(spark), path)
    spoil(path, ["2024-01-02", "2024-01-04"])
    days = spark.createDataFrame([(dt.date(2024, 1, 3), 1), (dt.date(2024, 1, 5), 1), (dt.date(2024, 1, 2), 0)], "day date, on int").where("on = 1")
    found = store.read_days_of(spark, path, BY_DAY, days)
    assert {r.created_at.day for r in found.collect()} == {3, 5} and found.count() == 8
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_lookups_open_one_bucket_and_do_not_move_the_table(spark, tmp_path):
    store.write_lookup(states(spark).coalesce(1), "lookup_test", str(tmp_path / "t"), buckets=8)
    assert store.find_job(spark, "lookup_test", "job_x").count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = store.find_jobs(spark, "lookup_test", spark.createDataFrame([("job_1",), ("job_x",)], "job_id string"))
        assert {(r.job_id, r.status) for r in many.collect()} == {("job_1", "running"), ("job_x", None)}
        plan = many._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        # Files of other buckets are not opened.
        for name in os.listdir(tmp_path / "t"):
            if name.endswith(".parquet") and not spark.read.parquet(str(tmp_path / "t" / name)).where("job_id = 'job_7'").count():
                (tmp_path / "t" / name).write_bytes(b"not a table")
        spark.catalog.refreshTable("lookup_test")
        assert [r.status for r in store.find_job(spark, "lookup_test", "job_7").collect()] == ["running"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE lookup_test")


def test_counts_observed_in_a_run_equal_a_count(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v string, n int").repartition(5)
    labels = {"k": ["a", "b", "c"], "v": ["x", "y"]}
    seen, observation = metrics.observe_counts(df, labels, F.col("v").isNotNull() & (F.col("n") % 2 == 0))
    seen.select("n").write.parquet(str(tmp_path / "out"))
    found = {(r.k, r.v, r.value) for r in metrics.observed_counts(spark, observation, labels).collect()}
    want = df.where("v IS NOT NULL AND n % 2 = 0").groupBy("k", "v").count()
    assert found == {tuple(r) for r in want.collect()} and len(found) == 4
    seen, observation = metrics.observe_counts(df, {"k": ["a"]})
    seen.write.parquet(str(tmp_path / "more"))
    with pytest.raises(ValueError, match="rows have labels other than"):
        metrics.observed_counts(spark, observation, {"k": ["a"]})


def test_exposition_files_in_name_order_are_the_text(spark, tmp_path):
    rows = [(f, s, p, f"{f} {s} {p}") for f in range(5) for s in "abcdefgh" for p in (-2, 0, 7)]
    random.Random(3).shuffle(rows)
    sinks.write_metrics_text(spark.createDataFrame(rows, "family int, series string, pos int, line string").repartition(6), str(tmp_path / "text"))
    names = sorted(n for n in os.listdir(tmp_path / "text") if n.startswith("part-"))
    lines = [line for n in names for line in (tmp_path / "text" / n).read_text().splitlines()]
    assert lines == [r[3] for r in sorted(rows)]


def test_a_compacted_store_reads_the_same_and_less(spark, tmp_path):
    path = str(tmp_path / "store")
    documents = lambda names, status: spark.createDataFrame([(n, status) for n in names], "job_id string, status string")
    store.append_versions(documents("abcd", "queued"), path, 0)
    store.append_versions(documents("ab", "running"), path, 1)
    store.append_deletes(documents("bc", ""), documents("", "").schema, path, 2)
    before = sorted(map(tuple, store.read_store(spark, path).collect()))
    for version in (3, 4):
        store.compact_store(spark, path, version)
        assert sorted(map(tuple, store.read_store(spark, path).collect())) == before == [("a", "running"), ("d", "queued")]
        assert spark.read.parquet(path).count() == 2
    store.append_versions(documents("b", "queued"), path, 5)
    assert sorted(map(tuple, store.read_store(spark, path).collect())) == [("a", "running"), ("b", "queued"), ("d", "queued")]
