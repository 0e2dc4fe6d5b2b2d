"""Hard negatives by coordinate pruning over length buckets.

Rows are dealt by the length of their vector and searched in buckets of
similar length. A bucket holds, for each coordinate, its rows sorted by their
unit vector's value there. An anchor looks for rows with at least some score:
over the bucket's greatest length this bounds the angle between the two, and
the angle bounds the value of every coordinate. For the anchor's largest
(focus) coordinates the feasible values are a stretch of the sorted list; the
sets of these stretches are intersected, and what is left is scored exactly.
The score an anchor needs starts at what a bounded sample of rows gives it
and rises with every bucket.

Rows with the same vector and label are one entry with its smallest keys: as
many as an answer can name, and one more for an anchor among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphflow.llm.frames import small_batches, stored


@dataclass(frozen=True)
class Rules:
    """What to find, and the sizes that only decide speed and memory.

    `scale` makes integers of the components. A negative scores from
    `low_percent` hundredths of its positive's score up to that score.
    """

    n_positives: int = 5
    n_negatives: int = 5
    low_percent: int = 80
    scale: int = 256
    focus: int = 4
    bucket_rows: int = 8_192
    sample_rows: int = 16_384
    block_bytes: int = 32 << 20


# Largest integer component: products of up to 8,192 of them are exact in doubles.
LARGEST = 1 << 20
# Slack of the feasible values, far above rounding and far below one step of a component.
SLACK = 1e-9
# Scores held at once while a bucket is searched.
SCORES = 1 << 19


# --- kernel: some anchors against buckets of rows ---------------------------------------------------------------------


@dataclass
class Anchors:
    """Anchors with the scores they look for: from `low` to `high` in each slot; `floor` is the least that can still enter."""

    key: np.ndarray
    label: np.ndarray
    vec: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray

    def __len__(self) -> int:
        return len(self.key)

    def part(self, a: int, b: int) -> Anchors:
        return Anchors(self.key[a:b], self.label[a:b], self.vec[a:b], self.low[a:b], self.high[a:b], self.floor[a:b])


class Bucket:
    """Rows of similar length: vectors, lengths, and the sorted list of each coordinate."""

    def __init__(self, vec: np.ndarray, label: np.ndarray, keys: list[np.ndarray]):
        self.vec, self.label = vec, label
        self.n_keys = np.array([len(k) for k in keys], np.int64)
        self.first_key = np.cumsum(self.n_keys) - self.n_keys
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        length = np.sqrt((vec * vec).sum(1))
        self.longest, self.shortest = (length.max(), length.min()) if len(vec) else (0.0, 0.0)
        self.unit = vec / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0).astype(np.int32)
        self.sorted = np.take_along_axis(self.unit, self.order, 0)

    def angle_floor(self, need: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Least cosine of a row that reaches the score `need` with anchors of these lengths; above 1 if no row does."""
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(need > 0, need / (length * self.longest), need / (length * self.shortest))
        # Without lengths there is no angle: every score is 0.
        still = (length == 0) | (self.longest == 0) | ((need <= 0) & (self.shortest == 0)) | np.isneginf(need)
        return np.where(still, np.where(need > 0, 2.0, -1.0), least)

    def stretches(self, unit: np.ndarray, least: np.ndarray, focus: int) -> tuple[np.ndarray, ...]:
        """Focus coordinates of each anchor, the feasible values there, and where these begin and end in the sorted lists."""
        coordinate = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :focus]
        value = np.take_along_axis(unit, coordinate, 1)
        wide = np.arccos(np.clip(least - SLACK, -1, 1))[:, None]
        turn = np.arccos(np.clip(value, -1, 1))
        high = np.where(turn <= wide, 1.0, np.cos(turn - wide)) + SLACK
        low = np.where(turn + wide >= np.pi, -1.0, np.cos(np.minimum(turn + wide, np.pi))) - SLACK
        begin, end = np.zeros(coordinate.shape, np.int64), np.zeros(coordinate.shape, np.int64)
        for c in np.unique(coordinate):
            on = coordinate == c
            begin[on] = np.searchsorted(self.sorted[:, c], low[on], "left")
            end[on] = np.searchsorted(self.sorted[:, c], high[on], "right")
        return coordinate, low, high, begin, end


def scored(anchors: Anchors, bucket: Bucket, focus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of every pair that reaches the least floor of its anchor."""
    need = anchors.floor.min(1)
    length = np.sqrt((anchors.vec * anchors.vec).sum(1))
    least = bucket.angle_floor(need, length)
    unit = anchors.vec / np.where(length > 0, length, 1)[:, None]
    coordinate, low, high, begin, end = bucket.stretches(unit, least, focus)
    sizes = end - begin
    smallest = sizes.min(1) if sizes.shape[1] else np.full(len(anchors), len(bucket.vec))
    smallest[least <= -1] = len(bucket.vec)
    smallest[least > 1 + SLACK] = 0
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    # Where the lists leave most of a bucket, all of it is scored by one product of matrices.
    dense = np.flatnonzero(4 * smallest > len(bucket.vec))
    if len(dense):
        scores = anchors.vec[dense] @ bucket.vec.T
        at, row = np.nonzero(scores >= need[dense][:, None])
        out.append((dense[at], row, scores[at, row]))
    for i in np.flatnonzero((smallest > 0) & (4 * smallest <= len(bucket.vec))):
        slots = np.argsort(sizes[i])
        rows = bucket.order[begin[i, slots[0]]:end[i, slots[0]], coordinate[i, slots[0]]]
        for s in slots[1:]:
            here = bucket.unit[rows, coordinate[i, s]]
            rows = rows[(here >= low[i, s]) & (here <= high[i, s])]
        scores = bucket.vec[rows] @ anchors.vec[i]
        reach = scores >= need[i]
        out.append((np.full(int(reach.sum()), i), rows[reach].astype(np.int64), scores[reach]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(anchors: Anchors, buckets: Iterator[Bucket], same: bool, most: int, focus: int) -> tuple[np.ndarray, ...]:
    """Anchor, slot, key and score of the best `most` rows in each slot of each anchor; raises the floors on the way.

    Rows have the anchor's label if `same`, another one otherwise; a row with the anchor's key is not among them.
    """
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    slots = anchors.low.shape[1]
    for bucket in buckets:
        step = max(1, SCORES // max(1, len(bucket.vec)))
        for a in range(0, len(anchors), step):
            part = anchors.part(a, a + step)
            at, row, score = scored(part, bucket, focus)
            fits = (bucket.label[row] == part.label[at]) == same
            at, row, score = at[fits], row[fits], score[fits]
            for slot in range(slots):
                on = (score >= part.floor[at, slot]) & (score <= part.high[at, slot])
                if not on.any():
                    continue
                n = bucket.n_keys[row[on]]
                entry = np.repeat(np.flatnonzero(on), n)
                key = bucket.keys[np.repeat(bucket.first_key[row[on]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                other = key != part.key[at[entry]]
                entry, key = entry[other], key[other]
                held = _best(*(np.concatenate(x) for x in zip(held, ((at[entry] + a) * slots + slot, key, score[entry]), strict=True)), most)
            _raise_floors(anchors, held, most, a * slots, (a + step) * slots)
    return held[0] // slots, held[0] % slots, held[1], held[2]


def _best(item: np.ndarray, key: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The first `most` of each item by score, then key; a key counts once."""
    order = np.lexsort((key, -score, item))
    item, key, score = item[order], key[order], score[order]
    again = np.append(False, (item[1:] == item[:-1]) & (key[1:] == key[:-1]) & (score[1:] == score[:-1])) if len(item) else np.zeros(0, bool)
    item, key, score = item[~again], key[~again], score[~again]
    rank = np.arange(len(item)) - np.searchsorted(item, item, "left")
    keep = rank < most
    return item[keep], key[keep], score[keep]


def _raise_floors(anchors: Anchors, held: tuple[np.ndarray, ...], most: int, begin: int, end: int) -> None:
    item, _, score = held
    a, b = np.searchsorted(item, [begin, end])
    item, score = item[a:b], score[a:b]
    full = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item, "left") == most - 1)
    slots = anchors.low.shape[1]
    where = item[full] // slots, item[full] % slots
    anchors.floor[where] = np.maximum(anchors.floor[where], score[full])


# --- rows of Spark as arrays ------------------------------------------------------------------------------------------


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; shorter ones are followed by zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)] = lists.flatten().to_numpy()
    return out


def _bucket(batches: list[pa.RecordBatch], width: int) -> Bucket:
    table = pa.Table.from_batches(batches)
    keys = table.column("keys").combine_chunks()
    edge = keys.offsets.to_numpy() - keys.offsets[0].as_py()
    return Bucket(matrix(table.column("vec"), width), table.column("label").to_numpy(), np.split(keys.flatten().to_numpy(), edge[1:-1]))


def _buckets(batches: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[Bucket]:
    """Buckets of `rows` rows, in the order of the rows."""
    waiting: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            piece = batch.slice(0, rows - n)
            waiting.append(piece)
            n += piece.num_rows
            batch = batch.slice(piece.num_rows)
            if n == rows:
                yield _bucket(waiting, width)
                waiting, n = [], 0
    if n:
        yield _bucket(waiting, width)


def _anchors(table: pa.Table | pa.RecordBatch, width: int, rules: Rules) -> Anchors:
    """Anchors from columns key, label, vec, and targets and floors where known."""
    key, label = table.column("key").to_numpy(), table.column("label").to_numpy()
    vec = matrix(table.column("vec"), width)
    low = np.full((len(key), 1), -np.inf)
    high = np.full((len(key), 1), np.inf)
    if "targets" in table.schema.names:
        targets = table.column("targets").to_pylist()
        slots = max(map(len, targets), default=1)
        # An unused slot asks for nothing.
        low, high = np.full((len(key), slots), np.inf), np.full((len(key), slots), -np.inf)
        for i, scores in enumerate(targets):
            high[i, :len(scores)] = scores
            low[i, :len(scores)] = [-(-rules.low_percent * s // 100) for s in scores]
    floor = low.copy()
    if "floors" in table.schema.names:
        for i, known in enumerate(table.column("floors").to_pylist()):
            # Unused slots of the batch that the floors come from.
            floor[i] = (known + [np.inf] * floor.shape[1])[:floor.shape[1]]
    return Anchors(key, label, vec, low, high, floor)


# --- operator ---------------------------------------------------------------------------------------------------------


def usable(rows: DataFrame, key: str, vector: str, label: str, rules: Rules) -> DataFrame:
    """Key, label and integer vector of the rows that take part."""
    v = F.col(vector)
    whole = lambda x: F.floor(F.lit(float(rules.scale)) * x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    on = F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & F.forall(v, finite)
    bounded = F.transform(v, lambda x: F.greatest(F.least(whole(x), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    return rows.where(on).select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), bounded.alias("vec"))


def entries(rows: DataFrame, rules: Rules) -> DataFrame:
    """One entry for each vector and label, with its smallest keys, dealt and sorted by length."""
    most = max(rules.n_positives, rules.n_negatives) + 1
    place = F.dense_rank().over(Window.partitionBy("vec", "label").orderBy("key"))
    firsts = rows.withColumn("place", place).where(F.col("place") <= most)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    merged = firsts.groupBy("vec", "label").agg(F.array_sort(F.collect_set("key")).alias("keys")).withColumn("length", length)
    return merged.repartitionByRange(F.desc("length"), F.xxhash64("vec", "label")).sortWithinPartitions(F.desc("length"))


def mine(
    rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", rules: Rules | None = None,
) -> DataFrame:
    """Rows (anchor, positive, rank, negative, positive_score, negative_score) for the rows on which `anchor` holds.

    Components become floor(scale * x), at most 2^20 in size; the score is the
    inner product, shorter vectors followed by zeros. An anchor's positives are
    its first `n_positives` other rows of the same label, the negatives of each
    the first `n_negatives` rows of other labels that score from `low_percent`
    hundredths of the positive's score up to it; all of them, if fewer. Higher
    scores come first, then smaller keys. Key and label are integers.

    Rows with a null key, label or vector, or a null or non-finite component
    take no part. Equal rows count once; rows that only share the key are rows
    of their own, but not positives or negatives of each other. An anchor
    without positives, or a positive without negatives, has no row; an empty
    table gives none. Other columns of `rows` do not matter.

    The index is one shuffle by vector and one by length. Anchors meet it in
    blocks of `block_bytes`, one of which is with the driver and the tasks at a
    time; the sample that gives the first floors has `sample_rows` entries,
    those with the smallest hashes.
    """
    rules = rules or Rules()
    spark = rows.sparkSession
    small_batches(spark)
    index = stored(entries(usable(rows, key, vector, label, rules), rules), "negatives-index")
    version = F.row_number().over(Window.partitionBy("key").orderBy("label", "vec")).alias("version")
    anchors = stored(usable(rows.where(anchor), key, vector, label, rules).distinct().select("*", version), "negatives-anchors")
    width = index.agg(F.max(F.size("vec"))).first()[0] or 0
    sample = index.orderBy(F.xxhash64("vec", "label")).limit(rules.sample_rows).toArrow()

    positives = _found(index, anchors, sample, width, True, rules).select(
        "anchor", "version", F.col("key").alias("positive"), F.col("score").alias("positive_score"))
    targets = positives.groupBy(F.col("anchor").alias("key"), "version").agg(F.array_sort(F.collect_set("positive_score")).alias("targets"))
    asking = stored(anchors.join(targets, ["key", "version"]), "negatives-targets")
    negatives = _found(index, asking, sample, width, False, rules).select(
        "anchor", "version", F.col("target").alias("positive_score"), "rank", F.col("key").alias("negative"), F.col("score").alias("negative_score"))
    return positives.join(negatives, ["anchor", "version", "positive_score"]).select(
        "anchor", "positive", "rank", "negative", "positive_score", "negative_score")


def _found(index: DataFrame, anchors: DataFrame, sample: pa.Table, width: int, same: bool, rules: Rules) -> DataFrame:
    """Rows (anchor, version, target, rank, key, score): the best of each slot of each anchor; the target is null if there is one slot for all."""
    spark = index.sparkSession
    most = rules.n_positives if same else rules.n_negatives
    sent = spark.sparkContext.broadcast(sample)
    fields = [f for f in anchors.schema if f.name != "floors"]

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_bucket(sent.value.slice(i, rules.bucket_rows).to_batches(), width) for i in range(0, sent.value.num_rows, rules.bucket_rows)]
        for batch in batches:
            if batch.num_rows:
                some = _anchors(batch, width, rules)
                search(some, iter(known), same, most, rules.focus)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(some.floor.tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "floors"])

    wide = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", floors array<double>"
    ready = stored(anchors.mapInArrow(floors, wide), "negatives-floors")
    blocks = max(1, -(-ready.count() * 8 * max(1, width) // rules.block_bytes))
    found = [_search_block(index, ready.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i), width, same, most, rules) for i in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search_block(index: DataFrame, block: DataFrame, width: int, same: bool, most: int, rules: Rules) -> DataFrame:
    """The best of each slot over the whole index for one block of anchors, written."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(block.toArrow())
    schema = pa.schema([("anchor", pa.int64()), ("version", pa.int32()), ("target", pa.int64()), ("key", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        if not table.num_rows:
            return
        anchors = _anchors(table, width, rules)
        at, slot, key, score = search(anchors, _buckets(batches, width, rules.bucket_rows), same, most, rules.focus)
        versions = table.column("version").to_numpy()[at]
        target = pa.nulls(len(at), pa.int64()) if same else pa.array(anchors.high[at, slot].astype(np.int64))
        columns = [pa.array(anchors.key[at]), pa.array(versions.astype(np.int32)), target, pa.array(key), pa.array(score.astype(np.int64))]
        whole = pa.RecordBatch.from_arrays(columns, schema=schema)
        for a in range(0, whole.num_rows, 1 << 16):
            yield whole.slice(a, 1 << 16)

    by_task = index.select("label", "keys", "vec").mapInArrow(run, "anchor long, version int, target long, key long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "version", "target").orderBy(F.desc("score"), "key"))
    best = stored(by_task.withColumn("rank", rank).where(F.col("rank") <= most), "negatives-found")
    sent.unpersist()
    return best
