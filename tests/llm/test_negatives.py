"""Hard negatives against all pairs."""

from __future__ import annotations

import dataclasses
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import negatives
from glyphflow.llm.oracle import ORACLE
from glyphflow.llm.queries import QUERIES
from tests.compare import connect, differences

SCHEMA = "vec_id long, embedding array<float>, label int"
SMALL = negatives.Rules(bucket_rows=16, sample_rows=8, block_bytes=1 << 10)


def brute(rows: list[tuple], every: int, rules: negatives.Rules) -> set[tuple]:
    """All pairs, by the definition; components are exact in floats."""
    use = {r for r in ((k, tuple(v), lab) for k, v, lab in rows if v is not None and lab is not None and k is not None) if all(x is not None and math.isfinite(x) for x in r[1])}
    ints = [(k, [math.floor(rules.scale * float(np.float32(x))) for x in v], lab) for k, v, lab in use]
    out = set()
    for a, v, lab in ints:
        if a % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=False))  # noqa: E731, B023
        others = sorted((-score(w), k, other == lab) for k, w, other in ints if k != a)
        for ps, p, _ in [x for x in others if x[2]][:rules.n_positives]:
            good = [x for x in others if not x[2] and rules.low_percent * -ps <= 100 * -x[0] <= 100 * -ps][:rules.n_negatives]
            out |= {(a, p, i + 1, n, -ps, -ns) for i, (ns, n, _) in enumerate(good)}
    return out


def mined(spark, rows: list[tuple], every: int = 3, rules: negatives.Rules = SMALL) -> set[tuple]:
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = [tuple(r) for r in negatives.mine(df, F.col("vec_id") % every == 0, rules=rules).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for k in range(240):
        length = rng.choice([0.1, 0.5, 1, 1, 4])
        noise = rng.choice([0, 0, 0.05, 0.5])
        rows.append((k, [length * x + rng.gauss(0, noise) for x in rng.choice(base)], rng.randint(0, 3)))
    want = brute(rows, 3, SMALL)
    assert want and mined(spark, rows) == want


def test_hot_copies_ties_and_odd_rows(spark):
    hot = [0.5, -0.25, 1.0]
    rows = [(k, hot, k % 2) for k in range(120)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0], 1), (202, [float("nan"), 1.0, 1.0], 1), (203, [float("inf"), 1.0, 1.0], 1), (204, hot, None), (205, [], 0),
             (207, [0.0, 0.0, 0.0], 0), (210, [0.0, 0.0, 0.0], 1), (213, [0.5, -0.25], 1), (216, [-0.5, 0.25, -1.0], 0), (219, [-0.5, 0.25, -1.0], 5)]
    rows += rows[:7]
    assert mined(spark, rows) == brute(rows, 3, SMALL)


def test_few_rows_of_a_label(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 1), (2, [0.8, 0.0], 2), (3, [0.75, 0.1], 2), (4, [0.2, 0.0], 2), (6, [3.0, 3.0], 7)]
    assert mined(spark, rows) == brute(rows, 3, SMALL) != set()


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, []) == set()
    rows = [(k, [1.0, k / 10], k % 2) for k in range(12)]
    df = spark.createDataFrame([(k, v, lab, "x", 1, 2.0) for k, v, lab in rows], "id long, e array<double>, y int, key string, vec int, label double")
    found = {tuple(r) for r in negatives.mine(df, F.col("id") % 3 == 0, key="id", vector="e", label="y", rules=dataclasses.replace(SMALL, n_positives=2)).collect()}
    assert found == brute(rows, 3, dataclasses.replace(SMALL, n_positives=2))


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.1"
    name = "op12_hard_negatives"
    assert differences(QUERIES[name](spark, folder), connect(folder), ORACLE[name]) == []
