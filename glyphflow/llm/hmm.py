"""Language-model scores: add-0.1 unigrams, and a hidden Markov model over word classes.

Texts are cut into tokens once and stored in packed batches. Counts of all
tokens travel once: each batch sends its distinct tokens, parts of the hash
space add them up and answer with the totals, so no vocabulary is ever held
whole. A word's class is the top bits of its hash, for all words alike; the
model has an emission table by state and class, and a word's share of its class
is its smoothed count. Expected counts of the Baum-Welch steps are added up by
partition; training reads documents in stretches of fixed length, all of them.
Scoring is exact over a whole text: each stretch becomes a matrix of scaled
forward steps, and the matrices of a text are multiplied in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm import words as W
from glyphflow.llm.frames import partitions, small_batches, stored

# Bytes of text in a packed batch, and rows of an Arrow batch, as packed batches are large.
BATCH_BYTES = 1 << 20
ROWS = 8
# Stretches multiplied at once, so that their matrices stay in the cache.
BLOCK = 512
# The token at the end of every text.
END = np.uint64(0xE4D0_0000_0000_0001)


@dataclass(frozen=True)
class Rules:
    """Latent states, bits of a word class, Baum-Welch steps, tokens of a stretch, and the seed of the first guess."""

    states: int = 6
    class_bits: int = 12
    steps: int = 6
    stretch: int = 64
    seed: int = 1
    smoothing: float = 0.1


@dataclass
class Model:
    """First state of a text, first state of a later stretch, state after state, and class by state."""

    first: np.ndarray
    inner: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # class x state

    def flat(self) -> np.ndarray:
        return np.concatenate([self.first, self.inner, self.move.ravel(), self.emit.ravel()])


def _unflat(x: np.ndarray, rules: Rules) -> Model:
    k = rules.states
    return Model(x[:k], x[k:2 * k], x[2 * k:2 * k + k * k].reshape(k, k), x[2 * k + k * k:].reshape(-1, k))


def normalised(counts: np.ndarray, rules: Rules) -> Model:
    """Probabilities from expected counts; a little is added everywhere."""
    m = _unflat(counts + 1e-3, rules)
    return Model(m.first / m.first.sum(), m.inner / m.inner.sum(), m.move / m.move.sum(1, keepdims=True), m.emit / m.emit.sum(0))


def first_guess(class_tokens: np.ndarray, rules: Rules) -> Model:
    """States that like to stay, with emissions scattered around the corpus."""
    rng = np.random.default_rng(rules.seed)
    k = rules.states
    emit = (class_tokens[:, None] + 1) * rng.gamma(2.0, 0.5, (len(class_tokens), k))
    move = np.full((k, k), 0.1 / max(1, k - 1)) + (0.9 - 0.1 / max(1, k - 1)) * np.eye(k)
    return Model(np.full(k, 1 / k), np.full(k, 1 / k), move / move.sum(1, keepdims=True), emit / emit.sum(0))


# --- packed batches ---------------------------------------------------------------------------------------------------


def _packed(docs: DataFrame) -> DataFrame:
    """Batches of documents: keys, held-out marks, tokens of each, distinct tokens, training counts, and each token's place among these."""
    key = docs.schema["key"]
    schema = T.StructType([
        T.StructField("batch", T.StringType()), T.StructField("keys", T.ArrayType(key.dataType)), T.StructField("held", T.ArrayType(T.BooleanType())),
        T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType()),
        T.StructField("at", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, part in enumerate(W.slices(batches, "text", BATCH_BYTES)):
            words, _ = W.cut(part.column(2), lower=True)
            n = words.per_row() + 1
            tokens = np.empty(int(n.sum()), np.uint64)
            ends = np.cumsum(n) - 1
            inside = np.ones(len(tokens), bool)
            inside[ends] = False
            tokens[inside], tokens[ends] = W.word_hashes(words), END
            held = part.column(1).to_numpy(zero_copy_only=False)
            distinct, at = np.unique(tokens, return_inverse=True)
            counts = np.bincount(at, np.repeat(~held, n), len(distinct)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "batch": [f"{task}-{number}"], "keys": _list(part.column(0)), "held": _list(part.column(1)),
                "n": _list(pa.array(n.astype(np.int32))), "words": [distinct.tobytes()], "counts": [counts.tobytes()], "at": [at.astype(np.int32).tobytes()],
            }, pa.schema([("batch", pa.string()), ("keys", pa.list_(part.column(0).type)), ("held", pa.list_(pa.bool_())), ("n", pa.list_(pa.int32())), ("words", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())]))

    return docs.select("key", "held", "text").mapInArrow(run, schema)


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


@dataclass
class Batch:
    """A packed batch as arrays; `doc` has a document's first token, and the total at the end."""

    keys: pa.Array
    held: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    at: np.ndarray


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[str, Batch]]:
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        n = columns["n"][i].values.to_numpy()
        read = lambda name, kind: np.frombuffer(columns[name][i].as_buffer(), kind)  # noqa: E731, B023
        yield columns["batch"][i].as_py(), Batch(
            columns["keys"][i].values, columns["held"][i].values.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(n))), read("words", np.uint64), read("at", np.int32),
        )


# --- counts -----------------------------------------------------------------------------------------------------------


def _totals(batches: DataFrame, rules: Rules) -> DataFrame:
    """Answers to all batches: total training counts of their distinct tokens, by part; and rows without batch with class sums."""
    parts = partitions(batches.sparkSession)
    asked = "part int, batch string, words binary, counts binary"

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for i in range(row.num_rows):
                words = np.frombuffer(row.column(1)[i].as_buffer(), np.uint64)
                counts = np.frombuffer(row.column(2)[i].as_buffer(), np.int32)
                part = ((words >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
                edge = np.searchsorted(part, np.arange(parts + 1))
                full = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(full, pa.int32()), "batch": [row.column(0)[i].as_py()] * len(full),
                    "words": [words[edge[p]:edge[p + 1]].tobytes() for p in full], "counts": [counts[edge[p]:edge[p + 1]].tobytes() for p in full],
                }, pa.schema([("part", pa.int32()), ("batch", pa.string()), ("words", pa.binary()), ("counts", pa.binary())]))

    answer = "batch string, part int, totals binary, class int, tokens long, types long"
    kinds = pa.schema([("batch", pa.string()), ("part", pa.int32()), ("totals", pa.binary()), ("class", pa.int32()), ("tokens", pa.int64()), ("types", pa.int64())])

    def add(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(v, np.uint64) for v in table.column("words").to_pylist()]
        counts = [np.frombuffer(v, np.int32) for v in table.column("counts").to_pylist()]
        words, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts), len(words)).astype(np.int64)
        edge = np.cumsum([len(x) for x in lists])[:-1]
        known = total > 0
        kind = (words >> np.uint64(64 - rules.class_bits)).astype(np.int64)
        tokens, types = (np.bincount(kind, w, 1 << rules.class_bits).astype(np.int64) for w in (total, known))
        some = np.flatnonzero(types)
        part = table.column("part")[0].as_py()
        replies = [total[x].tobytes() for x in np.split(at, edge)]
        none = [None] * len(some)
        return pa.table({
            "batch": table.column("batch").to_pylist() + none, "part": [part] * len(lists) + none, "totals": replies + none,
            "class": pa.array([None] * len(lists) + some.tolist(), pa.int32()), "tokens": pa.array([None] * len(lists) + tokens[some].tolist(), pa.int64()),
            "types": pa.array([None] * len(lists) + types[some].tolist(), pa.int64()),
        }, schema=kinds)

    return batches.select("batch", "words", "counts").mapInArrow(ask, asked).groupBy("part").applyInArrow(add, answer)


# --- the model --------------------------------------------------------------------------------------------------------


def stretches(doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First token, length, document and rank in it of every stretch, longest first."""
    n = np.diff(doc)
    pieces = -(-n // size)
    owner = np.repeat(np.arange(len(n)), pieces)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = doc[owner] + rank * size
    length = np.minimum(size, doc[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order], owner[order], rank[order]


def expected(classes: np.ndarray, doc: np.ndarray, model: Model, size: int) -> np.ndarray:
    """Expected counts of one Baum-Welch step over some documents, laid out as a flat model, and the log likelihood behind."""
    k = len(model.first)
    start, length, _, rank = stretches(doc, size)
    counts = Model(np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit))
    if not len(start):
        return np.append(counts.flat(), 0.0)
    most = int(length[0])
    active = [int(np.searchsorted(-length, -t, "left")) for t in range(most)]  # stretches longer than t
    alpha, scale, emits = [], [], []
    for t in range(most):
        m = active[t]
        b = model.emit[classes[start[:m] + t]]
        a = (np.where((rank == 0)[:, None], model.first, model.inner) if t == 0 else alpha[-1][:m] @ model.move) * b
        s = a.sum(1)
        alpha.append(a / s[:, None])
        scale.append(s)
        emits.append(b)
    logs = sum(float(np.log(s).sum()) for s in scale)
    gammas, where = [], []
    beta = np.ones((active[-1], k))
    for t in range(most - 1, -1, -1):
        m = active[t]
        if t < most - 1:
            later = active[t + 1]
            weighted = emits[t + 1] * beta / scale[t + 1][:, None]
            counts.move += model.move * (alpha[t][:later].T @ weighted)
            beta = np.concatenate((weighted @ model.move.T, np.ones((m - later, k))))
        gammas.append(alpha[t] * beta)
        where.append(classes[start[:m] + t])
    begin = gammas[-1]
    counts.first += begin[rank == 0].sum(0)
    counts.inner += begin[rank > 0].sum(0)
    gamma, kind = np.concatenate(gammas), np.concatenate(where)
    for s in range(k):
        counts.emit[:, s] = np.bincount(kind, gamma[:, s], len(counts.emit))
    return np.append(counts.flat(), logs)


def _matrices(classes: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch as a matrix from the state before it (of a first one: its first state) to the state at its end, and the log of what it is scaled by."""
    k = len(model.first)
    into = np.where(first[:, None, None], np.eye(k), model.move)
    matrix = into * model.emit[classes[start]][:, None, :]
    logs = np.zeros(len(start))
    for t in range(1, int(length[0])):
        m = int(np.searchsorted(-length, -t, "left"))
        step = (matrix[:m].reshape(-1, k) @ model.move).reshape(m, k, k)
        step *= model.emit[classes[start[:m] + t]][:, None, :]
        if t % 4 == 0:
            s = step.max((1, 2))
            step /= s[:, None, None]
            logs[:m] += np.log(s)
        matrix[:m] = step
    return matrix, logs


def log_likelihoods(classes: np.ndarray, doc: np.ndarray, model: Model, size: int) -> np.ndarray:
    """Natural log probability of the whole class sequence of each document."""
    k = len(model.first)
    start, length, owner, rank = stretches(doc, size)
    total = np.zeros(len(doc) - 1)
    if not len(start):
        return total
    matrix, logs = np.empty((len(start), k, k)), np.zeros(len(start))
    for low in range(0, len(start), BLOCK):
        own = slice(low, low + BLOCK)
        matrix[own], logs[own] = _matrices(classes, start[own], length[own], rank[own] == 0, model)
    place = np.lexsort((owner, rank))
    edge = np.searchsorted(rank[place], np.arange(int(rank.max()) + 2))
    state = np.tile(model.first, (len(total), 1))
    for r in range(len(edge) - 1):
        own = place[edge[r]:edge[r + 1]]
        docs = owner[own]
        after = np.einsum("ij,ijk->ik", state[docs], matrix[own])
        s = after.sum(1)
        state[docs] = after / s[:, None]
        total[docs] += np.log(s) + logs[own]
    return total


def _learn(batches: DataFrame, class_tokens: np.ndarray, rules: Rules) -> Model:
    """Baum-Welch over all training documents."""
    model = first_guess(class_tokens, rules)
    some = batches.select("batch", "keys", "held", "n", "words", "at")
    for _ in range(rules.steps):
        def run(rows: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(model.flat()) + 1)
            for row in rows:
                for _, b in _unpack(row):
                    kind = (b.words >> np.uint64(64 - rules.class_bits)).astype(np.int64)[b.at]
                    n = np.diff(b.doc)
                    keep = ~b.held
                    total += expected(kind[np.repeat(keep, n)], np.concatenate(([0], np.cumsum(n[keep]))), model, rules.stretch)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["cell", "value"])

        sums = some.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        counts = np.zeros(len(model.flat()) + 1)
        counts[sums["cell"].to_numpy()] = sums["value"].to_numpy()
        model = normalised(counts[:-1], rules)
    return model


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """Key, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score`, one row for each input row.

    Tokens are words with A-Z lower-cased, and an end. Rows whose key's text has
    a crc32 divisible by 10 are held out, all others train; a null key counts as
    an empty text, which is held out. Scores are log10 probabilities. A null or
    empty text is its end alone; a text is scored whole; repeated rows train and
    score each by itself; without training rows every token is unknown. Other
    columns do not matter. What reaches the driver is the model and the class
    sums, whose sizes are fixed by `rules`.
    """
    rules = rules or Rules()
    small_batches(docs.sparkSession, ROWS)
    crc = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")))
    named = docs.select(F.col(key).alias("key"), (crc % 10 == 0).alias("held"), F.col(text).alias("text"))
    batches = stored(_packed(named), "lm-batches")
    answers = stored(_totals(batches, rules), "lm-totals")
    size = 1 << rules.class_bits
    sums = answers.where("class is not null").groupBy("class").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).toPandas()
    class_tokens, class_types = np.zeros(size), np.zeros(size)
    class_tokens[sums["class"].to_numpy(np.int64)], class_types[sums["class"].to_numpy(np.int64)] = sums["tokens"].to_numpy(), sums["types"].to_numpy()
    n, v, extra = float(class_tokens.sum()), float(class_types.sum()), rules.smoothing
    model = _learn(batches, class_tokens, rules)
    share = np.log(class_tokens + extra * (class_types + 1))
    replies = answers.where("batch is not null").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "totals"))).alias("r"))
    joined = batches.join(replies.select("batch", F.col("r.totals").alias("totals")), "batch").select("batch", "keys", "held", "n", "words", "at", "totals")
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for i, (_, b) in enumerate(_unpack(row)):
                totals = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in row.column(6)[i].values])
                kind = (b.words >> np.uint64(64 - rules.class_bits)).astype(np.int64)
                base = np.log10((totals + extra) / (n + extra * (v + 1)))
                in_class = np.log(totals + extra) - share[kind]
                first = b.doc[:-1]
                add = lambda x: np.add.reduceat(x[b.at], first)  # noqa: E731, B023
                whole = (log_likelihoods(kind[b.at], b.doc, model, rules.stretch) + add(in_class)) / np.log(10)
                docs_in = len(first)
                yield pa.RecordBatch.from_arrays([
                    b.keys, pa.array(b.held), pa.array(np.diff(b.doc).astype(np.int64)), pa.array(add((totals > 0).astype(np.int64))),
                    pa.array(np.full(docs_in, int(n), np.int64)), pa.array(add(base)), pa.array(whole),
                ], [f.name for f in schema])

    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)
