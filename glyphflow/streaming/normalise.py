"""Normalisation of arriving images."""

from __future__ import annotations

from pyspark.sql import DataFrame

from glyphflow.operators.normalise import normalise_images
from glyphflow.settings import Settings


def stream_normalise(images: DataFrame, settings: Settings) -> DataFrame:
    """Results, summary and meta per arriving image; works inside the row, so there is no state and no shuffle."""
    return normalise_images(images, settings)
