from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """Documents from texts, numbered from 0, or from (key, text) pairs."""

    def build(texts: list) -> DataFrame:
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in pairs], DOCS)

    return build
