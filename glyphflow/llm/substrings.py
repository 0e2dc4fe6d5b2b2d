"""Substring dedup: passages that an earlier document has are taken out.

Word windows are the suffixes of the documents, cut at the window's depth. They
are split by variable-length prefixes into groups of many small subtrees: the
prefix of a window reaches from its first word to the end of its anchor, the
n-gram in it with the smallest hash, which equal windows have at the same
place. A subtree is the sorted list of its suffixes' path hashes; its deep
internal nodes, those at window depth with several documents below, are the
repeats. Runs of repeated windows are the maximal repeats.

Before suffixes move, anchors do: a window can only repeat if its anchor does,
and there is about one anchor for five windows. Tasks send packed arrays, one
for each part of the key space, and settle beforehand what repeats within the
task, so that a frequent passage costs each task one entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm import words as W
from glyphflow.llm.frames import partitions, small_batches, stored

# Entries a task holds before it sends them.
HELD = 1_000_000


@dataclass(frozen=True)
class Rules:
    """Words of a window, and of the anchor in it."""

    window: int = 13
    anchor: int = 5


@dataclass
class Slice:
    """Words of some rows, their hashes, and the windows that one row holds: first word and anchor's first word."""

    words: W.Words
    hashes: np.ndarray
    grams: np.ndarray
    start: np.ndarray
    anchor: np.ndarray


def cut(column: pa.Array, rules: Rules) -> Slice:
    """Windows and anchors of a text column."""
    words, _ = W.cut(column, lower=False)
    hashes = W.word_hashes(words)
    start = np.flatnonzero(W.whole_windows(words, rules.window))
    grams = W.window_hashes(hashes, rules.anchor)
    anchor = start.copy()
    least = grams[start]
    for k in range(1, rules.window - rules.anchor + 1):
        here = grams[start + k]
        less = here < least
        least[less] = here[less]
        anchor[less] = start[less] + k
    return Slice(words, hashes, grams, start, anchor)


def _hash_at(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words that begin at the given words."""
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(W.odd_constants(size, 5_000 + size)):
            total += hashes[at + k] * factor
    return W.mix(total)


_PACKED = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("settled", T.BooleanType()), T.StructField("several", T.BinaryType()),
    T.StructField("hash", T.BinaryType()), T.StructField("doc", T.BinaryType()), T.StructField("place", T.BinaryType()),
])
_FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType()))])


class Sender:
    """Collects entries (route, hash, document, place) and packs them by part.

    `settle` looks at the sorted entries of a task and tells which are settled
    as found, which are sent, and which of these stand for several documents.
    """

    def __init__(self, parts: int, settle: Callable):
        self.parts, self.settle = parts, settle
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = self.turn = 0

    def add(self, route: np.ndarray, hashes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(hashes):
            self.held.append((route, hashes, doc, place.astype(np.int32)))
            self.size += len(hashes)
        if self.size >= HELD:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        route, hashes, doc, place = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.uint64),) * 4
        self.held, self.size = [], 0
        order = np.lexsort((doc, hashes))
        route, hashes, doc, place = route[order], hashes[order], doc[order], place[order]
        settled, sent, several = self.settle(hashes, doc)
        rows = []
        part = (route % np.uint64(self.parts)).astype(np.int32)
        own = np.flatnonzero(sent)
        own = own[np.argsort(part[own], kind="stable")]
        for at in np.split(own, np.flatnonzero(np.diff(part[own])) + 1):
            if len(at):
                rows.append((int(part[at[0]]), False, several[at].tobytes(), hashes[at].tobytes(), doc[at].tobytes(), place[at].tobytes()))
        known = np.flatnonzero(settled)
        if len(known):  # needs no certain part: the parts take turns
            self.turn += 1
            rows.append(((int(hashes[0] >> np.uint64(40)) + self.turn) % self.parts, True, b"", b"", doc[known].tobytes(), place[known].tobytes()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.name for f in _PACKED])


def _runs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry of each run of equal hashes, and the run of each entry."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _settle_anchors(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An anchor of two documents is found in all of them; one entry tells other tasks."""
    if not len(hashes):
        return (np.zeros(0, bool),) * 3
    first, run = _runs(hashes)
    last = np.append(first[1:], len(hashes)) - 1
    several = (doc[first] != doc[last])[run]
    sent = ~several
    sent[first] = True
    return several, sent, several


def _settle_windows(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A window is found in every document but the first; the first one's entries go on."""
    if not len(hashes):
        return (np.zeros(0, bool),) * 3
    first, run = _runs(hashes)
    later = doc != doc[first][run]
    return later, ~later, later


def _gather(packed: DataFrame, pick: Callable) -> DataFrame:
    """Found places by document, one row each, from the packed entries of all tasks."""
    parts = partitions(packed.sparkSession)

    def group(table: pa.Table) -> pa.Table:
        own = table.filter(pc.invert(table.column("settled")))
        known = table.filter(table.column("settled"))
        hashes, several = _numbers(own, "hash", np.uint64), _numbers(own, "several", bool)
        doc, place = _numbers(own, "doc", np.int64), _numbers(own, "place", np.int32)
        order = np.lexsort((doc, hashes))
        picked = order[pick(hashes[order], doc[order], several[order])]
        doc = np.concatenate((doc[picked], _numbers(known, "doc", np.int64)))
        place = np.concatenate((place[picked], _numbers(known, "place", np.int32)))
        # Packed again, now by document.
        part = (W.mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        pieces = [x for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x)]
        return pa.table([
            pa.array([part[x[0]] for x in pieces], pa.int32()), pa.array([doc[x].tobytes() for x in pieces], pa.binary()),
            pa.array([place[x].tobytes() for x in pieces], pa.binary()),
        ], ["part", "doc", "place"])

    def by_doc(table: pa.Table) -> pa.Table:
        doc, place = _numbers(table, "doc", np.int64), _numbers(table, "place", np.int32)
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(place))
        return pa.table([pa.array(doc[first]), lists], ["doc", "places"])

    found = packed.groupBy("part").applyInArrow(group, "part int, doc binary, place binary")
    return found.groupBy("part").applyInArrow(by_doc, _FOUND)


def _numbers(table: pa.Table, column: str, kind: type) -> np.ndarray:
    """The packed arrays of a column behind each other."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _pick_anchors(hashes: np.ndarray, doc: np.ndarray, several: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, bool)
    first, run = _runs(hashes)
    last = np.append(first[1:], len(hashes)) - 1
    shared = (doc[first] != doc[last]) | np.logical_or.reduceat(several, first)
    return shared[run]


def _pick_windows(hashes: np.ndarray, doc: np.ndarray, several: np.ndarray) -> np.ndarray:
    return _settle_windows(hashes, doc)[0]


def _with_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without the rows that no anchor was found in."""
    for batch in batches:
        yield batch.filter(batch.column(2).is_valid()) if batch.num_columns > 2 else batch


def _send(frame: DataFrame, settle: Callable, entries: Callable) -> DataFrame:
    """Packed entries of all tasks; `entries` gives route, hash, document and place for a slice."""
    parts = partitions(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(parts, settle)
        for part in W.slices(_with_places(batches), "text"):
            yield from sender.add(*entries(part))
        yield sender.flush()

    return frame.mapInArrow(run, _PACKED)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """Key, `n_words`, `n_removed` and `kept` (words left, one space between), one row for each input row.

    A word goes when a window over it also starts in a row with a smaller key;
    all windows are judged on the input. The key must be an integer. A null or
    empty text has no words, one shorter than a window loses nothing; rows with
    one key are one document; a row with a null key neither loses words nor
    takes them from others; other columns do not matter.
    """
    return _finish(docs, key, text, rules or Rules(), digest=False)


def digest_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """As `remove_repeats`, with `kept_sha256` in place of `kept`."""
    return _finish(docs, key, text, rules or Rules(), digest=True)


def _finish(docs: DataFrame, key: str, text: str, rules: Rules, digest: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))

    def anchors(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        s = cut(part.column(1), rules)
        at = np.unique(s.anchor)
        row = s.words.row[at]
        return s.grams[at], s.grams[at], part.column(0).to_numpy(zero_copy_only=False)[row], at - s.words.first_of_row()[row]

    named = docs.where(F.col("doc").isNotNull())
    suspect = stored(_gather(_send(named, _settle_anchors, anchors), _pick_anchors), "anchors")

    def suffixes(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        s = cut(part.column(1), rules)
        first = s.words.first_of_row()
        places = part.column(2)
        shared = np.zeros(len(s.hashes), bool)
        counts = np.diff(places.offsets.to_numpy())
        shared[places.flatten().to_numpy() + np.repeat(first[:-1], counts)] = True
        mine = shared[s.anchor]
        start, anchor = s.start[mine], s.anchor[mine]
        route = np.zeros(len(start), np.uint64)
        for before in range(rules.window - rules.anchor + 1):
            on = np.flatnonzero(anchor - start == before)
            route[on] = _hash_at(s.hashes, start[on], before + rules.anchor)
        row = s.words.row[start]
        return route, _hash_at(s.hashes, start, rules.window), part.column(0).to_numpy(zero_copy_only=False)[row], start - first[row]

    # An outer join like the last one below, so that both read one shuffle of the texts.
    both = docs.join(suspect, "doc", "left").select("doc", "text", "places")
    removed = _gather(_send(both, _settle_windows, suffixes), _pick_windows)
    out = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
    ])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            words, raw = W.cut(part.column(1), lower=False)
            first = words.first_of_row()
            places = part.column(2)
            if places.null_count:
                places = places.fill_null([])
            counts = np.diff(places.offsets.to_numpy())
            begin = places.flatten().to_numpy() + np.repeat(first[:-1], counts)
            change = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + rules.window, -1)
            gone = np.cumsum(change)[:-1] > 0
            kept = _joined(words, raw, ~gone)
            n_removed = np.bincount(words.row, gone, minlength=words.rows).astype(np.int64)
            texts = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [bytes(k).decode() for k in kept]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.per_row().astype(np.int64)), pa.array(n_removed), pa.array(texts, pa.string())], [f.name for f in out])

    left = docs.join(removed, "doc", "left").select("doc", "text", "places").mapInArrow(finish, out)
    return left.select(F.col("doc").alias(key), "n_words", "n_removed", F.col("kept").alias("kept_sha256" if digest else "kept"))


def _joined(words: W.Words, raw: np.ndarray, keep: np.ndarray) -> list[memoryview]:
    """Kept words of each row with one space between."""
    start, end, row = words.start[keep], words.end[keep], words.row[keep]
    if not len(start):
        return [memoryview(b"")] * words.rows
    size = end - start + 1
    first = np.concatenate(([0], np.cumsum(size)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], size)
    at = within + np.repeat(start, size)
    out = raw[np.minimum(at, len(raw) - 1)]
    out[first[1:] - 1] = 0x20
    view = memoryview(out)
    edge = np.searchsorted(row, np.arange(words.rows + 1))
    return [view[first[a]:max(first[a], first[b] - 1)] for a, b in zip(edge[:-1], edge[1:], strict=True)]
