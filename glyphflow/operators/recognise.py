"""Run a user's recogniser over images in parallel.

The model is the user's: `factory` builds it, once per task, and the result is
called with the bytes of one image. It returns pages of items, each item a
pair of a polygon and either a (text, confidence) pair or a plain text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from glyphflow.functions.text import model_name
from glyphflow.schemas import RAW_PAGES
from glyphflow.session import use_small_batches
from glyphflow.settings import Settings

Recogniser = Callable[[bytes], Any]

OUTCOME = T.StructType([
    T.StructField("raw", RAW_PAGES),
    T.StructField("seconds", T.DoubleType()),
    T.StructField("called", T.BooleanType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("error_message", T.StringType()),
])


def _item(item: Any) -> dict | None:
    if not isinstance(item, (list, tuple)) or len(item) < 2:
        return None
    polygon, info = item[0], item[1]
    if isinstance(info, tuple):
        text, confidence = info[0], float(info[1])
    else:
        text, confidence = str(info), 1.0
    if text is None:
        raise TypeError("a text is None")
    text = str(text).encode("utf-8", "replace").decode()  # lone surrogates have no UTF-8 form
    points = None if polygon is None else [[float(v) for v in point] for point in polygon]
    return {"polygon": points, "text": text, "confidence": confidence}


def _pages(raw: Any) -> list:
    return [None if not page else [_item(item) for item in page] for page in raw or []]


def recognise(
    df: DataFrame,
    factory: Callable[[], Recogniser],
    *,
    content: str = "content",
    keep: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add raw, seconds, called, error_code and error_message; `content` itself is dropped.

    A row without content is passed through with nulls. A recogniser that
    raises, or whose output is not of the expected form, gives an `ocr_failed`
    row and does not touch its neighbours. `called` tells whether the model
    answered, whatever its answer was like, and `seconds` is the time of the
    call alone. Only `keep` and the content cross to Python, in small Arrow
    batches whose kept columns are handed back as they are. Nothing is shuffled
    unless `tasks` is given: then rows are dealt evenly to so many tasks first,
    for tables in few files before an expensive model.
    """
    use_small_batches(df.sparkSession)
    names = keep if keep is not None else [c for c in df.columns if c != content]
    source = df.select(*names, content)
    if tasks is not None:
        source = source.repartition(tasks)
    schema = T.StructType([source.schema[n] for n in names] + OUTCOME.fields)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in OUTCOME.fields]
    raw_type = fields[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        for batch in batches:
            rows = []
            for value in batch.column(content):
                if not value.is_valid:
                    rows.append((None, None, None, None, None))
                    continue
                called = False
                started = time.perf_counter()
                seconds = None
                try:
                    if engine is None:
                        engine = factory()
                        started = time.perf_counter()
                    answer = engine(value.as_py())
                    seconds, called = time.perf_counter() - started, True
                    pages = _pages(answer)
                    pa.array([pages], type=raw_type)  # what Arrow cannot hold fails here, for this row alone
                    rows.append((pages, seconds, True, None, None))
                except Exception as problem:  # one bad image must not fail the others
                    seconds = time.perf_counter() - started if seconds is None else seconds
                    text = str(problem).encode("utf-8", "replace").decode()
                    rows.append((None, seconds, called, "ocr_failed", text))
            made = [pa.array([row[i] for row in rows], type=kind) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + made, names=names + [name for name, _ in fields]
            )

    return source.mapInArrow(run, schema)


def inference_calls(df: DataFrame, settings: Settings) -> DataFrame:
    """Metric rows (model, device, duration) of the calls the model answered, also those whose answer was unusable."""
    return df.where("called").select(
        model_name(F.col("lang"), settings.model_prefix).alias("model"),
        F.lit(settings.device).alias("device"),
        F.col("seconds").alias("duration"),
    )
