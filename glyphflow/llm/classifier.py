"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text is seen in three ways: its words in lower case, their shapes (runs of
letters, capitals and digits become one sign each, other characters stay), and
how far back each word stood before. The n-grams of each are hashed to
buckets, and a score is a sparse dot product over them.

Training is iterative parameter mixing: the sample is dealt to shards by a
hash of the key, each shard goes through its rows in a fixed order from the
same state, and the states are averaged bucket by bucket for the next pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import words as W
from glyphflow.llm.frames import small_batches
from glyphflow.session import work_folder


@dataclass(frozen=True)
class Rules:
    """Training sample, size of the model, and the rates of the updates.

    At most `train_rows` labelled rows are learnt from, those with the smallest
    key hashes.
    """

    train_rows: int = 20_000
    bits: int = 20
    shards: int = 8
    passes: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05
    threshold: float = 0.7


# n-grams taken of each view: lower-case words, shapes, distances.
ORDERS = ((1, 2), (1, 2, 3), (1, 2))
# Parts in which the states of all shards are averaged.
PARTS = 64

_SIGN = np.arange(256, dtype=np.uint8)
_SIGN[ord("a"):ord("z") + 1] = ord("a")
_SIGN[ord("A"):ord("Z") + 1] = ord("A")
_SIGN[ord("0"):ord("9") + 1] = ord("0")
_SIGN[0x80:] = ord("a")


# --- features ---------------------------------------------------------------------------------------------------------


@dataclass
class Features:
    """Buckets and values of some texts; `edge` is each text's first feature, and the total at the end."""

    edge: np.ndarray
    bucket: np.ndarray
    value: np.ndarray


def shapes(words: W.Words, raw: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    sign = _SIGN[raw]
    keep = np.ones(len(sign), bool)
    keep[1:] = sign[1:] != sign[:-1]
    keep[words.start] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    return W.span_hashes(sign[keep], place[words.start], place[words.end])


def distances(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How far back the same word stood in its text, in powers of two; 0 if nowhere."""
    key = W.mix(hashes ^ W.mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    back = np.zeros(len(key), np.int64)
    back[order[same + 1]] = order[same + 1] - order[same]
    return W.mix((np.frexp(back)[1] + 1).astype(np.uint64))


def features(column: pa.Array, bits: int) -> Features:
    """Buckets of each text with the square root of their share of a view's n-grams; a text without words has none."""
    words, raw = W.cut(column, lower=True)
    hashes = W.word_hashes(words)
    views = hashes, shapes(words, raw), distances(hashes, words.row)
    keys, rows, weights = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for view, (tokens, orders) in enumerate(zip(views, ORDERS, strict=True)):
        for n in orders:
            at = np.flatnonzero(W.whole_windows(words, n))
            if len(at):
                salted = W.mix(W.window_hashes(tokens, n)[at] + np.uint64(101 * view + n))
                row = words.row[at]
                keys.append(salted >> np.uint64(64 - bits))
                rows.append(row)
                weights.append(1.0 / np.bincount(row, minlength=words.rows)[row])
    key, row, weight = np.concatenate(keys), np.concatenate(rows), np.concatenate(weights)
    # One feature for each text and bucket, by text.
    both = (row.astype(np.uint64) << np.uint64(bits)) | key
    order = np.argsort(both, kind="stable")
    both, weight = both[order], weight[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    value = np.sqrt(np.add.reduceat(weight, first)) if len(first) else np.zeros(0)
    both = both[first]
    edge = np.searchsorted((both >> np.uint64(bits)).astype(np.int64), np.arange(words.rows + 1))
    return Features(edge, (both & np.uint64((1 << bits) - 1)).astype(np.int32), value.astype(np.float32))


# --- model ------------------------------------------------------------------------------------------------------------


@dataclass
class State:
    """What the updates keep for each bucket, and in the last place for the bias: gradients less the weight's pull, and squared gradients."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def zero(cls, bits: int) -> State:
        return cls(np.zeros((1 << bits) + 1, np.float32), np.zeros((1 << bits) + 1, np.float32))


def weights(z: np.ndarray, n: np.ndarray, rules: Rules) -> np.ndarray:
    """The weights that a state stands for."""
    pull = z - np.sign(z) * rules.l1
    return np.where(np.abs(z) > rules.l1, -pull / ((rules.beta + np.sqrt(n)) / rules.alpha + rules.l2), 0.0)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def learn(state: State, f: Features, labels: np.ndarray, rules: Rules) -> None:
    """One update for each text, in order."""
    bias = len(state.z) - 1
    for i, y in enumerate(labels.tolist()):
        a, b = f.edge[i], f.edge[i + 1]
        at = np.append(f.bucket[a:b], bias)
        x = np.append(f.value[a:b], np.float32(1))
        z, n = state.z[at], state.n[at]
        w = weights(z, n, rules)
        g = (logistic(w @ x) - y) * x
        more = n + g * g
        state.z[at] = z + g - (np.sqrt(more) - np.sqrt(n)) / rules.alpha * w
        state.n[at] = more


def scores(f: Features, w: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    products = np.concatenate(([0.0], np.cumsum(w[f.bucket].astype(np.float64) * f.value)))
    return logistic(products[f.edge[1:]] - products[f.edge[:-1]] + float(w[-1]))


# --- operator ---------------------------------------------------------------------------------------------------------


def sample(labels: DataFrame, key: str, label: str, rules: Rules) -> DataFrame:
    """The labelled keys to learn from, with their hash and label; a key with both labels has none."""
    y = F.col(label).cast("int")
    agreed = labels.where(F.col(key).isNotNull() & y.isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.min(y).alias("label"), F.max(y).alias("other"))
    ranked = agreed.where(F.col("label") == F.col("other")).select("key", "label", F.xxhash64(F.lit("quality"), "key").alias("h"))
    return ranked.orderBy("h", "key").limit(rules.train_rows)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rules: Rules | None = None) -> np.ndarray:
    """Weights by bucket, the bias behind them, learnt from the texts of labelled keys.

    Rows with a null key, or a label other than 0 and 1, teach nothing, nor
    does a key with both labels; a key that several rows of `docs` have teaches
    with each. Without labelled rows all weights are 0. A pass is one job over
    the sample; shards stream their rows, and what the driver holds is the model.
    """
    rules = rules or Rules()
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = texts.join(F.broadcast(sample(labels, key, label, rules)), "key").select(
        F.pmod("h", F.lit(rules.shards)).cast("int").alias("shard"), "h", "key", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            f = features(part.column(4), rules.bits)
            edge = pa.array(f.edge.astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (f.bucket, f.value)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *lists], names)

    names = ["shard", "h", "key", "label", "bucket", "value"]
    kind = chosen.schema["key"].dataType.simpleString()
    counted = chosen.mapInArrow(count, f"shard int, h long, key {kind}, label int, bucket array<int>, value array<float>")
    path = work_folder(spark, "llm-quality-features")
    counted.repartition(rules.shards, "shard").write.partitionBy("shard").parquet(path)
    ready = spark.read.schema(counted.schema).parquet(path)
    state = State.zero(rules.bits)
    for _ in range(rules.passes):
        state = _pass(ready, state, rules)
    return weights(state.z, state.n, rules).astype(np.float32)


def _pass(ready: DataFrame, state: State, rules: Rules) -> State:
    """Each shard goes on from `state`; the mean of what they come to."""
    spark = ready.sparkSession
    sent = spark.sparkContext.broadcast((state.z, state.n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = -1, None
        for batch in batches:
            of = batch.column(0).to_numpy()
            for rows in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if not len(rows):
                    continue
                if of[rows[0]] != shard:
                    if own is not None:
                        yield parts(shard, own)
                    shard, own = int(of[rows[0]]), State(*(x.copy() for x in sent.value))
                some = batch.slice(int(rows[0]), len(rows))
                edge = some.column(2).offsets.to_numpy()
                f = Features(edge - edge[0], some.column(2).flatten().to_numpy(), some.column(3).flatten().to_numpy())
                learn(own, f, some.column(1).to_numpy(), rules)
        if own is not None:
            yield parts(shard, own)

    def parts(shard: int, own: State) -> pa.RecordBatch:
        pieces = [[x.tobytes() for x in np.array_split(v, PARTS)] for v in (own.z, own.n)]
        return pa.RecordBatch.from_pydict(
            {"part": pa.array(range(PARTS), pa.int32()), "shard": pa.array([shard] * PARTS, pa.int32()), "z": pa.array(pieces[0]), "n": pa.array(pieces[1])})

    # One task for each shard, without another shuffle: its files are read one after the other, then sorted.
    shards = [ready.where(F.col("shard") == k).coalesce(1).sortWithinPartitions("h", "key") for k in range(rules.shards)]
    dealt = reduce(DataFrame.union, shards).select("shard", "label", "bucket", "value")
    states = dealt.mapInArrow(run, "part int, shard int, z binary, n binary")
    # Without this a union of single partitions is one partition, and all shards one task.
    apart = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(apart, None)
    spark.conf.set(apart, "false")
    try:
        table = _means(states)
    finally:
        spark.conf.unset(apart) if before is None else spark.conf.set(apart, before)
    sent.unpersist()
    if not table.num_rows:
        return state
    return State(*(np.frombuffer(b"".join(table.column(c).to_pylist()), np.float32) for c in ("z", "n")))


def _means(states: DataFrame) -> pa.Table:
    """The mean state of all shards by part, in order."""

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        means = [np.mean([np.frombuffer(x, np.float32) for x in table.column(c).to_pylist()], axis=0, dtype=np.float64).astype(np.float32) for c in ("z", "n")]
        return pa.table({"part": table.column("part")[:1], "z": [means[0].tobytes()], "n": [means[1].tobytes()]})

    return states.groupBy("part").applyInArrow(mean, "part int, z binary, n binary").toArrow().sort_by("part")


def score(docs: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """Key, `score` (probability of label 1) and `predicted` (1 from the threshold on), one row for each input row.

    A null or empty text, or one without words, has the score of the bias
    alone. Nothing but the text counts: equal texts score alike whatever their
    key, a text of any length is read whole, other columns of `docs` do not matter.
    """
    rules = rules or Rules()
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    bits = (len(model) - 1).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            p = scores(features(part.column(1), bits), sent.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= rules.threshold).astype(np.int32))], ["key", "score", "predicted"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
