"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths mark every word that lies in a
repeated n-gram of its text; the rules limit the share of characters marked,
the characters in repeated lines, and a few plain counts. Each row is judged
by itself in the scan: no shuffle, no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphflow.llm import words as W
from glyphflow.llm.frames import small_batches

# Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits; a share counts characters in words, in hundredths."""

    min_words: int = 10
    max_repeat_words: int = 20
    ngrams: tuple[int, ...] = (5, 7, 10)
    max_ngram_chars: tuple[int, ...] = (25, 22, 20)
    max_line_chars: int = 30
    max_symbols_per_100_words: int = 50


_NEWLINE = 0x0A
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def measures(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    """The counts and verdicts of each row of a text column."""
    words, raw = W.cut(column, lower=False)
    rows = words.rows
    hashes = W.word_hashes(words)
    points = W.code_points(raw)
    chars = points[words.end] - points[words.start]
    per_row = lambda at, weights=None: np.bincount(at, weights, minlength=rows).astype(np.int64)
    n_words = per_row(words.row)
    word_chars = per_row(words.row, chars)
    at = np.flatnonzero(_SYMBOL[raw])
    n_symbols = per_row(np.searchsorted(words.offsets, at, "right") - 1)
    line_row, line_chars, repeated = _lines(words, raw, chars)
    out = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
        "n_dup_lines": per_row(line_row[repeated]), "dup_line_chars": per_row(line_row[repeated], line_chars[repeated]),
    }
    for size in rules.ngrams:
        marked = _repeated_words(words, hashes, size)
        out[f"dup_chars_{size}"] = per_row(words.row[marked], chars[marked])
        if size == rules.ngrams[0]:
            out["n_repeat_words"] = per_row(words.row[marked])
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_words * n_words)
    failed = out["base_failed"] | (100 * out["dup_line_chars"] > rules.max_line_chars * word_chars)
    failed |= 100 * n_symbols > rules.max_symbols_per_100_words * n_words
    for size, limit in zip(rules.ngrams, rules.max_ngram_chars, strict=True):
        failed |= 100 * out[f"dup_chars_{size}"] > limit * word_chars
    out["kept"] = ~failed
    return out


def _lines(words: W.Words, raw: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and word characters of each line that has a word, and whether an earlier line of the row equals it."""
    breaks = np.flatnonzero(raw == _NEWLINE)
    starts = np.unique(np.concatenate((words.offsets[:-1], breaks + 1)))
    line_of_word = np.searchsorted(starts, words.start, "right") - 1
    full, first_word = np.unique(line_of_word, return_index=True)
    if not len(full):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    row = words.row[first_word]
    begin = starts[full]
    # A line ends at its newline, at the row's end otherwise.
    limit = words.offsets[row + 1]
    at = np.searchsorted(breaks, begin)
    end = np.minimum(np.append(breaks, len(raw))[at], limit)
    line_chars = np.add.reduceat(chars, first_word)
    key = _keyed(W.span_hashes(raw, begin, end), row)
    repeated = np.ones(len(key), bool)
    repeated[np.unique(key, return_index=True)[1]] = False
    return row, line_chars, repeated


def _keyed(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    return W.mix(hashes ^ W.mix(row.astype(np.uint64)))


def _repeated_words(words: W.Words, hashes: np.ndarray, size: int) -> np.ndarray:
    """Mask of the words inside a window of `size` words that its row holds more than once."""
    marked = np.zeros(len(hashes) + 1, np.int64)
    whole = np.flatnonzero(W.whole_windows(words, size))
    if len(whole):
        key = _keyed(W.window_hashes(hashes, size)[whole], words.row[whole])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(marked, whole[twice], 1)
        np.add.at(marked, whole[twice] + size, -1)
    return np.cumsum(marked)[:-1] > 0


def _columns(rules: Rules) -> list[str]:
    return ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in rules.ngrams)]


def measure_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """Counts and verdict of each row: the key and the measures, one row for each input row.

    A null or empty text has no words and fails. Equal rows are judged alike,
    a text of any length is read whole, and other columns of `docs` do not matter.
    """
    rules = rules or Rules()
    small_batches(docs.sparkSession)
    names = _columns(rules)
    schema = T.StructType([docs.schema[key], *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, text):
            found = measures(part.column(1), rules)
            columns = [part.column(0), *(pa.array(found[n]) for n in [*names, "base_failed", "kept"])]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return docs.select(key, text).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of `docs` whose text passes all rules, all columns unchanged."""
    rules = rules or Rules()
    small_batches(docs.sparkSession)
    names = [f"{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, at):
            yield part.filter(pa.array(measures(part.column(int(at)), rules)["kept"]))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
