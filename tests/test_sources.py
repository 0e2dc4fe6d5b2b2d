import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from glyphflow.functions.payload import detect_format, probe_dimensions
from glyphflow.operators import batch, normalise as n
from glyphflow.operators.recognise import recognise
from glyphflow.schemas import RAW_PAGES
from glyphflow.session import LISTING_TASKS, materialise, work_folder
from glyphflow.settings import Settings
from glyphflow.sources import files, jobs, requests, sinks

S = Settings()


def test_image_files_in_batches(spark, tmp_path):
    for batch, names in {"b1": ["c.png", "a.png", "b.png"], "b2": [f"{i:02}.png" for i in range(21)]}.items():
        (tmp_path / batch).mkdir()
        for name in names:
            (tmp_path / batch / name).write_bytes(b"\x89PNG" + name.encode())
    scan = files.scan_image_files(spark, str(tmp_path / "*"), "*.png")
    assert scan.count() == 24 and bytes(scan.where("path LIKE '%b1/a.png'").first()["content"]) == b"\x89PNGa.png"
    folder = F.element_at(F.split("path", "/"), -2)
    rows = files.scan_image_batch(scan.withColumn("batch_id", folder), S).collect()
    assert sorted((r["batch_id"], r["idx"], r["filename"]) for r in rows) == [("b1", 0, "a.png"), ("b1", 1, "b.png"), ("b1", 2, "c.png")]
    unnamed = scan.withColumn("batch_id", folder).where("batch_id = 'b1'").withColumn("filename", F.lit(""))
    assert sorted(r["filename"] for r in files.scan_image_batch(unnamed, S).collect()) == ["image_0", "image_1", "image_2"]


def test_single_requests(spark, tmp_path):
    docs = [
        {"request_id": "1", "image": "  QUJD \n", "lang": "de", "min_confidence": 0.5, "include_polygon": False},
        {"request_id": "2", "image": " "}, {"request_id": "3", "image": "x", "min_confidence": 2.0}, {"request_id": "4"},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, docs)) + "\n{broken\n")
    rows = {r["request_id"]: r for r in requests.scan_single_requests(spark, str(tmp_path)).collect()}
    assert (rows["1"]["image"], rows["1"]["lang"], rows["1"]["include_polygon"], rows["1"]["violation"]) == ("QUJD", "de", False, None)
    assert (rows["2"]["lang"], rows["2"]["min_confidence"], rows["2"]["violation"]) == ("auto", 0.0, "image_blank")
    assert [rows[k]["violation"] for k in ("3", "4", None)] == ["min_confidence_range", "image_missing", "not_json"]


def test_batch_requests(spark, tmp_path):
    docs = [{"request_id": "1", "images": ["a", "b"]}, {"request_id": "2", "images": []}, {"request_id": "3", "images": ["x"] * 21}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, docs)))
    read = requests.scan_batch_requests(spark, str(tmp_path), job=True)
    assert {r["request_id"]: (r["n_images"], r["violation"]) for r in read.collect()} == {
        "1": (2, None), "2": (0, "images_empty"), "3": (21, None),
    }
    accepted, rejected = requests.gate_requests(read, S)
    assert {r["request_id"] for r in accepted.collect()} == {"1", "2"}
    assert [tuple(r) for r in rejected.collect()] == [("3", "batch_too_large", "Batch size 21 exceeds maximum 20", 400)]
    rows = requests.explode_images(read).collect()
    assert [(r["idx"], r["payload"]) for r in rows if r["request_id"] == "1"] == [(0, "a"), (1, "b")]
    assert [(r["idx"], r["payload"]) for r in rows if r["request_id"] == "2"] == [(None, None)]


def test_job_documents_skip_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"job_id": "a", "status": "queued", "progress": {"processed": 0, "total": 2}}, indent=2))
    (tmp_path / "b.json").write_text('{"job_id": "b", ')
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.txt").write_text('{"job_id": "d"}')
    rows = jobs.scan_job_documents(spark, str(tmp_path)).collect()
    assert [(r["job_id"], r["status"], r["progress"]["total"], r["results"]) for r in rows] == [("a", "queued", 2, None)]


def test_store_upsert_delete_and_compact(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = lambda *rows: spark.createDataFrame(list(rows), "job_id string, status string, error string")
    ids = lambda *names: spark.createDataFrame([(x,) for x in names], "job_id string")
    state = lambda p=path: {r["job_id"]: (r["status"], r["error"]) for r in jobs.read_store(spark, p).collect()}
    jobs.append_versions(docs(("a", "queued", None), ("b", "queued", None), ("c", "queued", "old")), path, 0)
    for _ in range(2):  # a repeated write of one version changes nothing
        jobs.append_versions(docs(("a", "running", None), ("c", "failed", None)), path, 1)
    assert state() == {"a": ("running", None), "b": ("queued", None), "c": ("failed", None)}
    jobs.append_deletes(ids("b", "nobody", "b"), docs(("x", "y", "z")).schema, path, 2)
    assert state() == {"a": ("running", None), "c": ("failed", None)}
    jobs.append_versions(docs(("b", "queued", None)), path, 10)
    assert state()["b"] == ("queued", None)
    plan = jobs.read_store(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan  # documents are filtered, not aggregated


def test_response_documents_keep_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], f"id int, raw {RAW_PAGES.simpleString()}")
    for name, value in [("width", None), ("height", None)]:
        df = df.withColumn(name, F.lit(value).cast("int"))
    df = df.withColumn("lang", F.lit("en")).withColumn("min_confidence", F.lit(0.0)).withColumn("include_polygon", F.lit(True))
    out = n.normalise_images(df, S).select(n.build_response(F.lit("r")).alias("r")).select("r.*")
    sinks.write_responses(out, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    meta = json.loads(text)["meta"]
    assert "image_width" in meta and meta["image_width"] is None


def test_payload_stream_of_job_requests(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i in range(3):
        body = {"request_id": f"r{i}", "images": [base64.b64encode(b"x").decode()] * (i + 1)}
        (source / f"{i}.json").write_text(json.dumps(body))
    stream = requests.explode_images(requests.stream_submissions(spark, str(source), files_per_trigger=1))
    query = (stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    got = sorted((r["request_id"], r["idx"], r["lang"]) for r in spark.read.parquet(str(out)).collect())
    assert got == sorted((f"r{i}", k, "auto") for i in range(3) for k in range(i + 1))


def test_image_file_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.png").write_bytes(b"\x89PNG")
    stream = requests.stream_image_files(spark, str(source)).select("path", "length")
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["length"] == 4


def test_work_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = work_folder(spark, "x"), work_folder(spark, "x")
    assert first != second and (base is None or first.startswith(base.rstrip("/") + "/"))
    assert materialise(spark.range(3), "y").count() == 3


def test_files_end_to_end(spark, tmp_path):
    def model():
        return lambda data: [[([[0, 0], [5, 0], [5, 5], [0, 5]], (data[24:].decode(), 0.9))]]

    header = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 10, 20)
    for folder, count in {"small": 3, "big": 21}.items():
        (tmp_path / folder).mkdir()
        for i in range(count):
            (tmp_path / folder / f"{i:02}.png").write_bytes(header + f"text {i}".encode())
    scan = files.scan_image_files(spark, str(tmp_path / "*"))
    scan = scan.withColumn("batch_id", F.element_at(F.split("path", "/"), -2))
    images = files.files_to_process(scan, S)
    assert images.count() == 3
    images = images.withColumn("size", probe_dimensions(F.col("content"), detect_format(F.col("content"))))
    images = images.select(
        "path", "content", "size.width", "size.height", F.lit("en").alias("lang"), F.lit(0.5).alias("min_confidence"),
        F.lit(True).alias("include_polygon"),
    )
    outcomes = n.normalise_images(recognise(images, model), S)
    items = files.scan_image_batch(scan.select("path", "batch_id"), S).join(outcomes, "path")
    items = items.withColumn("status", F.when(F.col("error_code").isNull(), "success").otherwise("error"))
    row = batch.batch_status(items, S).first()
    assert (row["batch_id"], row["status"], row["n_images"]) == ("small", "success", 3)
    results = batch.ordered_results(items, ["filename", "summary", "results"]).first()["results"]
    assert [(r["filename"], r["results"][0]["text"]) for r in results] == [(f"{i:02}.png", f"text {i}") for i in range(3)]
    assert results[0]["results"][0]["bbox_normalized"]["bottom_right"] == [0.5, 0.25]


def test_contents_stay_where_they_are_read_however_many_files(spark, tmp_path):
    for folder, count in {"small": 3, "limit": 20, "big": 21, "bigger": 50}.items():
        (tmp_path / folder).mkdir()
        for i in range(count):
            (tmp_path / folder / f"{i:02}.png").write_bytes(f"{folder} {i}".encode())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100b")  # below the size of the files, as of many with the default
    try:
        scan = files.scan_image_files(spark, str(tmp_path / "*")).withColumn("batch_id", F.element_at(F.split("path", "/"), -2))
        images = files.files_to_process(scan, S)
        assert sorted(bytes(r["content"]).decode() for r in images.collect()) == sorted(f"{b} {i}" for b, n in (("small", 3), ("limit", 20)) for i in range(n))
        plan = images._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # The final and the initial plan: contents are beside a broadcast from the start.
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def small_files(spark):
    rows = [(f"b{i // 3}", f"f{i:03}", f"text {i} é" if i else "") for i in range(7)]
    return spark.createDataFrame(rows, "batch string, name string, body string"), {(b, n): (t + "\n").encode() for b, n, t in rows}


@pytest.mark.parametrize("local", [None, False])
def test_small_files_are_found_again(spark, tmp_path, local):
    table, want = small_files(spark)
    sinks.write_small_files(table, f"file://{tmp_path}/in put", local=local)
    parts = [F.regexp_extract("path", r"/batch=([^/]+)/(?:name=)?([^/.]+)[^=]*$", i).alias("bn"[i - 1]) for i in (1, 2)]
    found = files.scan_image_files(spark, f"file://{tmp_path}/in put", "*.txt", recursive=True).select("content", *parts)
    assert {(r["b"], r["n"]): bytes(r["content"]) for r in found.collect()} == want


def test_small_files_take_one_folder_a_batch_and_can_be_written_again(spark, tmp_path):
    table, want = small_files(spark)
    for _ in range(2):
        sinks.write_small_files(table, str(tmp_path / "in"), local=True)
    made = sorted(str(p.relative_to(tmp_path / "in")) for p in (tmp_path / "in").rglob("*") if p.is_file())
    assert made == sorted(f"batch={b}/{n}.txt" for b, n in want)


def test_a_folder_of_a_cluster_is_not_opened_by_tasks(spark):
    assert sinks.is_local(spark, "file:///x/y") and sinks.is_local(spark, "/x/y")
    assert not sinks.is_local(spark, "hdfs://store/x") and not sinks.is_local(spark, "viewfs://store/x")


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(4_000):
        (tmp_path / f"{i}.png").write_bytes(b"\x89PNG")
    found = files.scan_image_files(spark, str(tmp_path))
    assert found.count() == 4_000 and found.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"b{i}").mkdir()
        (tmp_path / f"b{i}" / "a.png").write_bytes(b"\x89PNG")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        assert files.scan_image_files(spark, str(tmp_path), recursive=True).count() == 150
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= LISTING_TASKS
