"""Column functions for names, ids, times and counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

JOB_PREFIX = "job_"
JOB_ID_DIGITS = 12
STATUS_PATH = "/ocr/jobs/"


def char_count(text: Column) -> Column:
    """Number of code points."""
    return F.char_length(text).cast("bigint")


def model_name(lang: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), lang)


def job_id_of(*natural_key: Column) -> Column:
    """A job id that a re-run task computes again: twelve hex digits of a hash of the natural key."""
    text = F.concat_ws("|", *[k.cast("string") for k in natural_key])
    return F.concat(F.lit(JOB_PREFIX), F.substring(F.sha2(text, 256), 1, JOB_ID_DIGITS))


def random_job_id() -> Column:
    """A random job id; write the result before using it twice."""
    return F.concat(F.lit(JOB_PREFIX), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, JOB_ID_DIGITS))


def status_url(job_id: Column) -> Column:
    return F.concat(F.lit(STATUS_PATH), job_id)


def estimated_completion(created_at: Column, n_images: Column, minutes_per_image: int) -> Column:
    minutes = (n_images * minutes_per_image).cast("int")
    return created_at + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def iso_z_format(ts: Column) -> Column:
    """ISO text with a trailing Z; a zero fraction is left out."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    with_fraction = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(F.date_trunc("second", ts) == ts, whole).otherwise(with_fraction)


def iso_z_parse(text: Column) -> Column:
    """Timestamp of an ISO text with Z or an offset; null when it is not one."""
    return F.try_to_timestamp(text)


def ms_from_seconds(seconds: Column) -> Column:
    """Whole milliseconds, cut off."""
    return (seconds * 1000).cast("int")


def default_name(filename: Column, idx: Column) -> Column:
    """The file name, or image_<position> when it is missing or empty."""
    return F.coalesce(F.nullif(filename, F.lit("")), F.concat(F.lit("image_"), idx.cast("string")))


def first_set(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])
