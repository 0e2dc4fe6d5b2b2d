"""Quality classifier: features and updates against plain versions, held-out accuracy, odd input."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphflow.llm import classifier as C
from glyphflow.llm.queries import QUERIES
from tests.llm import brute

FOLDER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int"
RULES = C.Rules(bits=14, shards=3)


def shape(word: str) -> str:
    out = []
    for c in word:
        sign = "a" if not c.isascii() or c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        if not out or out[-1] != sign:
            out.append(sign)
    return "".join(out)


def plain_shares(text: str | None) -> list[float]:
    """Shares of the distinct n-grams of all views, sorted."""
    w = brute.words(text, lower=True)
    last: dict[str, int] = {}
    back = []
    for i, x in enumerate(w):
        back.append(0 if x not in last else int(math.log2(i - last[x])) + 1)
        last[x] = i
    out = []
    for view, orders in zip((w, [shape(x) for x in brute.words(text)], back), C.ORDERS, strict=True):
        for n in orders:
            grams = Counter(tuple(view[i:i + n]) for i in range(len(view) - n + 1))
            out += [math.sqrt(c / grams.total()) for c in grams.values()]
    return sorted(out)


def test_features_are_the_distinct_n_grams_of_each_view():
    rng = random.Random(3)
    parts = ["ab", "Cd", "x%%", "é", "7", "b2", "|", "the", "the"]
    texts = [None, "", " \n", "one"] + [" ".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(200)]
    f = C.features(pa.array(texts), 40)
    assert len(f.edge) == len(texts) + 1
    for i, text in enumerate(texts):
        got = np.sort(f.value[f.edge[i]:f.edge[i + 1]])
        assert got == pytest.approx(plain_shares(text), abs=1e-6), text


def test_updates_equal_the_plain_rule():
    rng = random.Random(5)
    rules = C.Rules(bits=4)
    texts = [sorted(rng.sample(range(16), rng.randint(0, 6))) for _ in range(60)]
    values = [[rng.random() for _ in t] for t in texts]
    labels = [rng.randint(0, 1) for _ in texts]
    edge = np.cumsum([0, *map(len, texts)])
    state = C.State(np.zeros(17), np.zeros(17))
    C.learn(state, C.Features(edge, np.array([b for t in texts for b in t], int), np.array([v for t in values for v in t])), np.array(labels), rules)
    z, n = [0.0] * 17, [0.0] * 17
    weight = lambda j: 0.0 if abs(z[j]) <= rules.l1 else -(z[j] - math.copysign(rules.l1, z[j])) / ((rules.beta + math.sqrt(n[j])) / rules.alpha + rules.l2)
    for buckets, xs, y in zip(texts, values, labels, strict=True):
        pairs = [*zip(buckets, xs, strict=True), (16, 1.0)]
        w = {j: weight(j) for j, _ in pairs}
        p = 1 / (1 + math.exp(-sum(w[j] * x for j, x in pairs)))
        for j, x in pairs:
            g = (p - y) * x
            z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / rules.alpha * w[j]
            n[j] += g * g
    assert state.z == pytest.approx(z) and state.n == pytest.approx(n)


def test_learns_from_labels_only_and_repeats(spark, docs_of):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choices(["sun", "moon", "star", "sky"], k=20))
    bad = lambda: " ".join(x + "%%%" for x in rng.choices(["sun", "moon", "star", "sky"], k=20))
    texts = [good() if i % 3 else bad() for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(0, 1), (1, None), (None, 1), (2, 7)], LABELS)
    docs = docs_of([*texts, None, "", " "])
    model = C.train(docs, labels, rules=RULES)
    assert np.array_equal(model, C.train(docs.repartition(7), labels.repartition(5), rules=RULES))
    rows = {r.doc_id: r for r in C.score(docs, model, rules=RULES).collect()}
    assert all(rows[i].predicted == int(i % 3 > 0) for i in range(200, 300))
    assert rows[300].score == rows[301].score == rows[302].score and 0 < rows[300].score < 1


def test_no_labels_empty_tables_and_clashing_columns(spark, docs_of):
    docs = docs_of(["some text", None])
    none = spark.createDataFrame([], LABELS)
    model = C.train(docs, none, rules=RULES)
    assert {r.score for r in C.score(docs, model, rules=RULES).collect()} == {0.5}
    assert C.score(docs_of([]), C.train(docs_of([]), none, rules=RULES), rules=RULES).count() == 0
    odd = spark.createDataFrame([("a", "x y", 1, 2, 3.0), ("a", "x y", 1, 2, 3.0)], "key string, body string, h int, shard int, score double")
    labels = spark.createDataFrame([("a", 1, 5)], "key string, label int, h int")
    model = C.train(odd, labels, key="key", text="body", label="label", rules=RULES)
    rows = C.score(odd, model, key="key", text="body", rules=RULES).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].score > 0.5


def test_long_texts_are_read_whole():
    f = C.features(pa.array(["a " * 400_000 + "end%%%", "end%%%"]), 20)
    assert np.isin(f.bucket[f.edge[1]:f.edge[2]], f.bucket[:f.edge[1]]).sum() >= 2


def test_held_out_accuracy_of_the_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op11_quality_classifier"](spark, FOLDER).collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in rows.items())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if rows[r.doc_id].held_out]
    good = [rows[k].score for k, q in labels if q == 1]
    bad = [rows[k].score for k, q in labels if q == 0]
    above = np.mean([[g > b for b in bad] for g in good])
    assert above > 0.99 and np.mean([rows[k].predicted == q for k, q in labels]) > 0.98
