"""Counters, cumulative histograms, gauges, queue depth, and the exposition text."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from glyphflow.operators.jobs import status_transitions
from glyphflow.plans.skew import HOT_ROWS, running_total
from glyphflow.settings import (
    BATCH_SIZE_BOUNDS,
    CANCELLED,
    FAILED,
    INFERENCE_BOUNDS,
    METRIC_FAMILIES,
    QUEUED,
    REQUEST_BOUNDS,
    RUNNING,
    TERMINAL_STATES,
)

# Outcomes that are counted. Rejected pre-checks, failed model calls,
# oversize batches, cancelled and crashed jobs are not.
METERED_OUTCOMES = ["success", "partial", "error"]


def is_metered(outcome: Column) -> Column:
    return F.coalesce(outcome.isin(METERED_OUTCOMES), F.lit(False))


def count_requests(requests: DataFrame) -> DataFrame:
    """Requests by endpoint, lang and status."""
    return requests.groupBy("endpoint", "lang", "status").agg(F.count(F.lit(1)).alias("value"))


def bound_text(bound: float) -> str:
    return repr(float(bound))


def observations(value: Column, bounds: list[float], prefix: str) -> list[Column]:
    """Aggregates of one histogram: a cumulative count per bound, the count and the sum of non-null values."""
    given = value.isNotNull()
    return [
        *[F.count_if(value <= bound).alias(f"{prefix}_le_{i}") for i, bound in enumerate(bounds)],
        F.count_if(given).alias(f"{prefix}_count"),
        F.sum(value.cast("double")).alias(f"{prefix}_sum"),
    ]


def merged(bounds: list[float], prefix: str) -> list[Column]:
    """Aggregates that add up the columns `observations` made for finer labels."""
    names = [f"{prefix}_le_{i}" for i in range(len(bounds))] + [f"{prefix}_count", f"{prefix}_sum"]
    return [F.sum(n).alias(n) for n in names]


def long_form(wide: DataFrame, labels: list[str], bounds: list[float], prefix: str) -> DataFrame:
    """Rows (labels, sample, le, value) of one histogram.

    The sum is rounded to six digits because the order of additions differs between runs.
    """
    def sample(name: str, le: str | None, number: Column) -> Column:
        return F.struct(
            F.lit(name).alias("sample"), F.lit(le).cast("string").alias("le"), number.cast("double").alias("value")
        )

    rows = [sample("bucket", bound_text(b), F.col(f"{prefix}_le_{i}")) for i, b in enumerate(bounds)]
    rows += [
        sample("bucket", "+Inf", F.col(f"{prefix}_count")),
        sample("count", None, F.col(f"{prefix}_count")),
        sample("sum", None, F.round(F.col(f"{prefix}_sum"), 6)),
    ]
    used = wide.where(F.col(f"{prefix}_count") > 0)
    return used.select(*labels, F.explode(F.array(*rows)).alias("_row")).select(*labels, "_row.*")


def histogram(df: DataFrame, labels: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Long form of a cumulative histogram, by one combined aggregation for all buckets."""
    wide = df.groupBy(*labels).agg(*observations(F.col(value), bounds, "value"))
    return long_form(wide, labels, bounds, "value")


def request_durations(requests: DataFrame) -> DataFrame:
    return histogram(requests, ["endpoint", "lang"], "duration", REQUEST_BOUNDS)


def batch_sizes(requests: DataFrame) -> DataFrame:
    """Only requests that give both a batch size and a job type."""
    given = requests.where(F.col("batch_size").isNotNull() & F.col("job_type").isNotNull())
    return histogram(given, ["job_type"], "batch_size", BATCH_SIZE_BOUNDS)


def inference_times(calls: DataFrame) -> DataFrame:
    """From successful model calls (model, device, duration)."""
    return histogram(calls, ["model", "device"], "duration", INFERENCE_BOUNDS)


def request_rollup(requests: DataFrame) -> DataFrame:
    """All request metrics by all labels in one pass over the requests.

    Takes requests with `metered` and `called` flags. The result has one row
    per combination of labels, whatever the number of requests; the families
    of `families_of_rollup` are sums over it.
    """
    metered, called = F.col("metered"), F.col("called")
    duration = F.when(metered, F.col("duration"))
    size = F.when(metered & F.col("job_type").isNotNull(), F.col("batch_size"))
    return requests.groupBy("endpoint", "lang", "status", "job_type", "model", "device").agg(
        F.count_if(metered).alias("requests"),
        *observations(duration, REQUEST_BOUNDS, "duration"),
        *observations(size, BATCH_SIZE_BOUNDS, "size"),
        *observations(F.when(called, F.col("duration")), INFERENCE_BOUNDS, "inference"),
    )


def families_of_rollup(rollup: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """Samples and labels of the four request families, as `exposition` takes them."""
    def family(labels: list[str], bounds: list[float], prefix: str) -> tuple[DataFrame, list[str]]:
        return long_form(rollup.groupBy(*labels).agg(*merged(bounds, prefix)), labels, bounds, prefix), labels

    labels = ["endpoint", "lang", "status"]
    counts = rollup.groupBy(*labels).agg(F.sum("requests").cast("double").alias("value")).where(F.col("value") > 0)
    return {
        "ocr_requests_total": (counts, labels),
        "ocr_request_duration_seconds": family(["endpoint", "lang"], REQUEST_BOUNDS, "duration"),
        "ocr_batch_size": family(["job_type"], BATCH_SIZE_BOUNDS, "size"),
        "ocr_inference_time_seconds": family(["model", "device"], INFERENCE_BOUNDS, "inference"),
    }


def last_value(df: DataFrame, labels: list[str], value: str, order: str) -> DataFrame:
    """Gauge: the value set last, per label."""
    return df.groupBy(*labels).agg(F.max_by(value, order).cast("double").alias("value"))


def queue_deltas(events: DataFrame, *, literal: bool = False, min_rows: int = HOT_ROWS) -> DataFrame:
    """Rows (seq, ts, job_id, delta) that change the number of pending jobs.

    Intended: +1 when a job is first queued, -1 at its first terminal event
    after that. Literal: +1 at every queueing, -1 at a cancel and once more if
    the job was running then, -1 at a crash, nothing at a normal end.
    """
    if literal:
        steps = status_transitions(events, min_rows=min_rows)
        delta = (
            F.when(F.col("kind") == QUEUED, 1)
            .when((F.col("kind") == CANCELLED) & (F.col("prev_status") == RUNNING), -2)
            .when(F.col("kind") == CANCELLED, -1)
            .when((F.col("kind") == FAILED) & F.col("error").isNotNull(), -1)
            .otherwise(0)
        )
        return steps.select("seq", "ts", "job_id", delta.alias("delta")).where(F.col("delta") != 0)
    opened = (
        events.where(F.col("kind") == QUEUED)
        .groupBy("job_id")
        .agg(F.min("seq").alias("open_seq"), F.min_by("ts", "seq").alias("open_ts"))
    )
    ends = events.where(F.col("kind").isin(TERMINAL_STATES)).select("job_id", "seq", "ts")
    closed = (
        ends.join(opened.select("job_id", "open_seq"), "job_id")
        .where(F.col("seq") > F.col("open_seq"))
        .groupBy("job_id")
        .agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"))
    )
    plus = opened.select(F.col("open_seq").alias("seq"), F.col("open_ts").alias("ts"), "job_id", F.lit(1).alias("delta"))
    return plus.unionByName(closed.select("seq", "ts", "job_id", F.lit(-1).alias("delta")))


def queue_depth(events: DataFrame, *, literal: bool = False, min_rows: int = HOT_ROWS) -> DataFrame:
    """Depth after each change, in event order."""
    deltas = queue_deltas(events, literal=literal, min_rows=min_rows)
    return running_total(deltas, "seq", "delta", "depth", bucket_rows=min_rows)


# ---- observed while a run happens -------------------------------------------------------------


def observe_counts(df: DataFrame, labels: dict[str, list], when: Column | None = None) -> tuple[DataFrame, Observation]:
    """`df` as it is, and an observation that counts its rows by label while they pass, without a pass of its own.

    `labels` names the values of each label column that are counted; a
    combination is one aggregate of the run. Read it with `observed_counts`
    after the first action on the frame. The counts are those of that run: a
    stage that it has to compute again after a loss can count again.
    """
    counted = F.lit(True) if when is None else when
    observation = Observation()
    aggregates = []
    for i, values in enumerate(product(*labels.values())):
        hit = counted
        for name, value in zip(labels, values, strict=True):
            hit = hit & (F.col(name) == value)
        aggregates.append(F.count_if(hit).alias(f"n{i}"))
    return df.observe(observation, *aggregates, F.count_if(counted).alias("all")), observation


def observed_counts(spark: SparkSession, observation: Observation, labels: dict[str, list], value: str = "value") -> DataFrame:
    """Rows (labels, value) of the combinations that occurred; an error if there were values without a label."""
    found = observation.get
    rows = [(*values, found[f"n{i}"]) for i, values in enumerate(product(*labels.values())) if found[f"n{i}"]]
    if sum(r[-1] for r in rows) != found["all"]:
        raise ValueError(f"{found['all'] - sum(r[-1] for r in rows)} rows have labels other than {labels}")
    return spark.createDataFrame(rows, ", ".join(f"{name} string" for name in labels) + f", {value} long")


# ---- exposition -----------------------------------------------------------------------------


def number_text(value: Column) -> Column:
    """Number as exposition text: at least one decimal, exponent form from seven digits before the point on
    and below 0.0001; NaN, +Inf and -Inf by name."""
    plain = F.regexp_replace(F.round(value, 6).cast("decimal(32,6)").cast("string"), "0+$", "")
    plain = F.when(F.endswith(plain, F.lit(".")), F.concat(plain, F.lit("0"))).otherwise(plain)
    dot = F.instr(plain, ".") - 1
    digits = F.replace(plain, F.lit("."), F.lit(""))
    mantissa = F.rtrim(
        F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), F.length(digits))), F.lit("0.")
    )
    exponent = F.concat(mantissa, F.lit("e+0"), (dot - 1).cast("string"))
    # Six decimals do not show a small number: its shortest form, with an exponent.
    small = F.replace(F.replace(F.lower(value.cast("string")), F.lit(".0e"), F.lit("e")), F.lit("e-"), F.lit("e-0"))
    small = F.regexp_replace(small, "e-0([0-9]{2})", "e-$1")
    return (
        F.when(F.isnan(value), "NaN")
        .when(value == float("inf"), "+Inf")
        .when(value == float("-inf"), "-Inf")
        .when((F.abs(value) < 1e-4) & (value != 0), small)
        .when((value > 0) & (dot > 6), exponent)
        .otherwise(plain)
    )


def escape_label(value: Column) -> Column:
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit('"'), F.lit('\\"'))


def label_text(labels: list[str], le: Column | None = None) -> Column:
    """{a="x",b="y"} with names in alphabetical order; empty without labels. A null `le` is left out."""
    names = sorted([*labels, "le"] if le is not None else labels)
    parts = []
    for name in names:
        value = le if name == "le" and le is not None else F.col(name)
        pair = F.concat(F.lit(f'{name}="'), escape_label(value), F.lit('"'))
        parts.append(F.when(value.isNotNull(), pair) if name == "le" else pair)
    if not parts:
        return F.lit("")
    joined = F.concat_ws(",", *parts)
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("{"), joined, F.lit("}")))


def exposition(families: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows (family, series, pos, line) of all given families; `families` maps a name to (samples, label columns).

    Histogram samples have sample, le and value; the others only value.
    Sort by family, series and pos to print.
    """
    given = [(n, *family) for n, family in enumerate(METRIC_FAMILIES) if family[0] in families]
    heads = []
    parts = []
    for number, name, kind, text in given:
        heads += [(number, "", -2, f"# HELP {name} {text}"), (number, "", -1, f"# TYPE {name} {kind}")]
        df, labels = families[name]
        series = label_text(labels)
        if kind == "histogram":
            suffix = F.concat(F.lit(name + "_"), F.col("sample"))
            tags = label_text(labels, F.col("le"))
            pos = (
                F.when(F.col("sample") == "count", 1_000_001)
                .when(F.col("sample") == "sum", 1_000_002)
                .when(F.col("le") == "+Inf", 1_000_000)
                .otherwise((F.col("le").try_cast("double") * 100).cast("int"))
            )
        else:
            suffix, tags, pos = F.lit(name), series, F.lit(0)
        line = F.concat(suffix, tags, F.lit(" "), number_text(F.col("value")))
        parts.append(
            df.select(F.lit(number).alias("family"), series.alias("series"), pos.alias("pos"), line.alias("line"))
        )
    spark = parts[0].sparkSession
    out = spark.createDataFrame(heads, "family int, series string, pos int, line string")
    for part in parts:
        out = out.unionByName(part)
    return out
