from __future__ import annotations

import numpy as np
import pyarrow as pa

from glyphflow.llm import words as W
from tests.llm import brute

TEXTS = ["", None, "One two\tthree\x0bfour", " lead and trail ", "é x y", "a" * 5000, "x", "\n\n", "日本 語"]


def test_cut_finds_the_words_of_each_row():
    words, raw = W.cut(pa.array(TEXTS), lower=True)
    found = [[] for _ in TEXTS]
    for a, b, r in zip(words.start, words.end, words.row, strict=True):
        found[r].append(bytes(words.buffer[a:b]).decode())
    assert found == [brute.words(t, lower=True) for t in TEXTS]


def test_words_do_not_join_across_rows():
    words, _ = W.cut(pa.array(["ab", "cd", "ab"]), lower=False)
    hashes = W.word_hashes(words)
    assert len(hashes) == 3 and hashes[0] == hashes[2] != hashes[1]
    assert not W.whole_windows(words, 2).any()


def test_hashes_depend_on_content_only():
    words, _ = W.cut(pa.array(["ab ba abab", "x ab ba abab"]), lower=False)
    hashes = W.word_hashes(words)
    assert len(set(hashes[:3].tolist())) == 3
    assert (W.window_hashes(hashes, 3)[0] == W.window_hashes(hashes, 3)[4])


def test_slices_join_and_cut_batches():
    rows = ["a" * n for n in (1, 0, 500, 3, 2000, 1)]
    batches = [pa.record_batch([pa.array([i]), pa.array([t])], ["k", "text"]) for i, t in enumerate(rows)]
    out = list(W.slices(iter(batches), "text", 600))
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(6))
    assert len(out) < 6
    whole = pa.record_batch([pa.array(range(6)), pa.array(rows)], ["k", "text"])
    assert [k for b in W.slices(iter([whole]), "text", 600) for k in b.column(0).to_pylist()] == list(range(6))


def test_code_points():
    buffer = np.frombuffer("aé日🙂".encode(), np.uint8)
    assert W.code_points(buffer)[-1] == 4
