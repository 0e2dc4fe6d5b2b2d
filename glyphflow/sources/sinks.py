"""JSON documents, exposition text and single small files as output."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Nulls are part of a response, so they are written.
JSON_OPTIONS = {"ignoreNullFields": "false"}


def response_json(response: Column) -> Column:
    return F.to_json(response, JSON_OPTIONS)


def answer_json(response: Column, error: Column) -> Column:
    """The error document where there is one, else the response, as JSON text."""
    return F.when(error.isNotNull(), response_json(error)).otherwise(response_json(response))


def write_responses(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per line."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_metrics_text(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Exposition lines in print order. Their number is that of the label sets, not of the requests."""
    lines.orderBy("family", "series", "pos").select("line").write.mode(mode).text(path)


def is_local(spark: SparkSession, path: str) -> bool:
    """Whether `path` is in a file system that tasks can open themselves."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path) or re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", default)
    return scheme is not None and scheme[1] == "file"


def write_small_files(files: DataFrame, path: str, *, local: bool | None = None) -> None:
    """A text file for every row (batch, name, body), in a folder for each batch; the file ends in a line feed.

    In a mounted folder the tasks write `batch=<batch>/<name>.txt`: there Spark's writer would start a process or two
    for each file and folder, to set its mode. Elsewhere it writes `batch=<batch>/name=<name>/part-....txt`, each
    batch in one task. Both sort alike. A file appears whole, and a task that runs again writes the same ones.
    """
    spark = files.sparkSession
    rows = files.select("batch", "name", "body")
    if not (is_local(spark, path) if local is None else local):
        rows.repartition("batch").write.partitionBy("batch", "name").text(path)
        return
    folder = re.sub(r"^file:(//[^/]*)?", "", path)
    os.makedirs(folder, exist_ok=True)  # also for a table without rows

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, attempt = set(), TaskContext.get().taskAttemptId()
        for rows in batches:
            for batch, name, body in zip(*(column.to_pylist() for column in rows.columns)):
                at = os.path.join(folder, f"batch={batch}")
                if at not in made:
                    os.makedirs(at, exist_ok=True)
                    made.add(at)
                draft = os.path.join(at, f".{name}.{attempt}")
                with open(draft, "wb") as out:
                    out.write(body.encode() + b"\n")
                os.replace(draft, os.path.join(at, f"{name}.txt"))
        yield from ()

    rows.mapInArrow(write, rows.schema).write.format("noop").mode("overwrite").save()
