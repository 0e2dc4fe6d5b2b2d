"""Periodic runs of words: stretches that repeat with a period, at least four times and six words long.

A sparse dynamic program over diagonals: the cell (word, lag) says that the
word equals the one `lag` words earlier, and a diagonal is a row of cells of
one lag. Going through the words in order, each earlier occurrence of a word
increments the match length of its lag; a lag that the next word does not
continue has ended, and is a run at once if it is long enough.

Not every earlier occurrence is a cell, or a text of one word would have a
quadratic number of them. Lags are taken by powers of two: for lags from L to
2L - 1 a word's context is the 3L words from it on, and its only cell is the
nearest earlier occurrence of that context, if its lag is one of these. This
loses nothing and adds nothing:

- In a run of smallest period q, with q from L to 2L - 1, the context of every
  word after the first period, up to 3L words before the end, occurs q words
  earlier. It cannot occur nearer: the context is longer than q, and a rotation
  of the period that equals another one would make a smaller period. A run of
  at least 4q words has such a word, its cells are consecutive, and they end
  where the run ends, on both sides.
- If consecutive cells of a lag make a stretch of at least 4 lags, no smaller
  period fits it, or the first cell's context would have occurred nearer.

A context that occurs once cannot be part of a longer one that occurs twice,
so contexts of 6L words are only looked up where those of 3L words repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm import words as W
from glyphflow.llm.frames import small_batches

# A run has at least so many words and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
# Words of context for each word of the smallest lag of a level.
CONTEXT = LEAST_PERIODS - 1

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_LEFT, _RIGHT = W.odd_constants(2, 77_000)


def cells(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and lag of each cell of the diagonals, in the order of the words; `row` is the text of each word."""
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, none
    end = np.searchsorted(row, row, "right")
    where, lags = [none], [none]
    lag, size = 1, CONTEXT
    context = W.window_hashes(hashes, size)
    at = np.arange(len(context))
    while True:
        at = at[at + size <= end[at]]
        if not len(at):
            break
        key = W.mix(context[at] ^ W.mix(row[at].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        later, earlier = at[order[1:][same]], at[order[:-1][same]]
        back = later - earlier
        on = (back >= lag) & (back < 2 * lag)
        where.append(later[on])
        lags.append(back[on])
        repeated = np.zeros(len(row), bool)
        repeated[later] = repeated[earlier] = True
        at = np.flatnonzero(repeated)
        at = at[at + 2 * size <= end[at]]
        at = at[repeated[at + size]]
        wider = np.zeros(len(row), np.uint64)
        with np.errstate(over="ignore"):
            wider[at] = W.mix(context[at] * _LEFT + context[at + size] * _RIGHT)
        context, lag, size = wider, 2 * lag, 2 * size
    word, back = np.concatenate(where), np.concatenate(lags)
    order = np.lexsort((back, word))
    return word[order], back[order]


def runs(word: np.ndarray, lag: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Start, length and period of the runs, from the cells in the order of the words."""
    active: dict[int, int] = {}
    matched: dict[int, int] = {}
    now = -2
    for at, back in zip(word.tolist(), lag.tolist(), strict=True):
        if at != now:
            # Lags that the word before did not continue have ended.
            if len(active) != len(matched) or active.keys() != matched.keys():
                yield from _ended(active, matched, now)
            if at != now + 1:
                yield from _ended(matched, {}, now + 1)
                matched = {}
            active, matched, now = matched, {}, at
        matched[back] = active.get(back, 0) + 1
    yield from _ended(active, matched, now)
    yield from _ended(matched, {}, now + 1)


def _ended(active: dict[int, int], matched: dict[int, int], now: int) -> Iterator[tuple[int, int, int]]:
    """Runs of the lags whose last cell is the word before `now`."""
    for back, cells_ in active.items():
        if back not in matched:
            length = cells_ - 1 + (CONTEXT << (back.bit_length() - 1)) + back
            if length >= max(LEAST_WORDS, LEAST_PERIODS * back):
                yield now - cells_ - back, length, back


def find(words: W.Words) -> np.ndarray:
    """All runs of some texts as rows of text, start, length and period, by text, start and period; starts count from the text's first word."""
    found = np.array(list(runs(*cells(W.word_hashes(words), words.row))), np.int64).reshape(-1, 3)
    row = words.row[found[:, 0]] if len(found) else np.zeros(0, np.int64)
    start = found[:, 0] - words.first_of_row()[row]
    order = np.lexsort((found[:, 2], start, row))
    return np.column_stack((row, start, found[:, 1:]))[order]


def _collapsed(words: W.Words, raw: np.ndarray, found: np.ndarray) -> pa.Array:
    """The words of each text that no run contains after its first period, one space between."""
    change = np.zeros(len(words.start) + 1, np.int64)
    first = words.first_of_row()[found[:, 0]] + found[:, 1]
    np.add.at(change, first + found[:, 3], 1)
    np.add.at(change, first + found[:, 2], -1)
    keep = np.cumsum(change)[:-1] == 0
    start, end, row = words.start[keep], words.end[keep], words.row[keep]
    spaced = np.append(False, row[1:] == row[:-1]).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    size = end - start + spaced
    edge = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(edge[-1]) - np.repeat(edge[:-1] + spaced - start, size)
    out = raw[at] if len(at) else np.zeros(0, np.uint8)
    out[edge[:-1][spaced == 1]] = 0x20
    offsets = edge[np.searchsorted(row, np.arange(words.rows + 1))]
    return pa.LargeStringArray.from_buffers(words.rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `n_words`, `runs` (by start, then period) and `collapsed` (the text with one period left of each run), one row for each input row.

    A run is a stretch of words with smallest period q that is at least 6 words
    and 4q words long and cannot grow on either side. A null or empty text has
    no words, no runs and an empty `collapsed`; in any other, words are joined
    by one space. Equal rows are judged alike, a text of any length is read
    whole, and other columns of `docs` do not matter.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("key", docs.schema["key"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("collapsed", T.StringType()),
    ])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            words, raw = W.cut(part.column(1), lower=False)
            found = find(words)
            edge = np.searchsorted(found[:, 0], np.arange(words.rows + 1)).astype(np.int32)
            columns = [pa.array(found[:, k].copy()) for k in (1, 2, 3)]
            lists = pa.ListArray.from_arrays(pa.array(edge), pa.StructArray.from_arrays(columns, RUN.names))
            collapsed = _collapsed(words, raw, found).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.per_row().astype(np.int64)), lists, collapsed], schema.names)

    return docs.mapInArrow(judge, schema).withColumnRenamed("key", key)
