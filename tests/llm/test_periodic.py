"""Periodic runs against the definition, period by period."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

from glyphflow.llm import periodic
from glyphflow.llm.queries import QUERIES
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


def random_text(rng: random.Random) -> str:
    """Words of a small vocabulary with repeated stretches, some of them broken by one word."""
    out: list[str] = []
    for _ in range(rng.randint(0, 6)):
        letters = "abcdef"[:rng.randint(1, 6)]
        piece = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        stretch = (piece * 9)[:rng.randint(1, 9 * len(piece))]
        if rng.random() < 0.3:
            stretch[rng.randrange(len(stretch))] = "x"
        out += stretch
    return rng.choice([" ", "  ", "\n"]).join(out)


def test_runs_equal_the_definition(docs_of):
    rng = random.Random(8)
    texts = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "é é é é é é é"]
    texts += [random_text(rng) for _ in range(1_500)]
    rows = {r.doc_id: r for r in periodic.find_runs(docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        w = brute.words(text)
        assert [tuple(r) for r in rows[i].runs] == brute.periodic_runs(w), text
        assert (rows[i].n_words, rows[i].collapsed) == (len(w), brute.collapsed(w))


def test_long_periods(docs_of):
    rng = random.Random(9)
    for period in (1, 2, 3, 63, 64, 65, 500):
        piece = [f"w{period}x{rng.random()}" for _ in range(period)]
        w = ["head", *(piece * 7)[:4 * period + 5 + period // 2], "tail"]
        found = periodic.find_runs(docs_of([" ".join(w)])).first()
        assert [tuple(r) for r in found.runs] == [(1, len(w) - 2, period)]


def test_frequent_words_and_long_texts_stay_linear(docs_of):
    texts = ["a " * 300_000, "a b " * 150_000, "a a b " * 100_000, " ".join(random.Random(1).choices("ab", k=200_000))]
    docs = docs_of(texts).cache()
    docs.count()
    started = time.time()
    rows = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.find_runs(docs).collect()}
    assert time.time() - started < 60
    assert [rows[i] for i in range(3)] == [[(0, 300_000, 1)], [(0, 300_000, 2)], [(0, 300_000, 3)]]
    assert len(rows[3]) > 1_000


def test_empty_tables_repeated_rows_and_clashing_columns(spark, docs_of):
    assert periodic.find_runs(docs_of([])).count() == 0
    df = spark.createDataFrame(
        [(1, "x x x x x x", "own", 3, 4), (1, "x x x x x x", "own", 3, 4), (None, None, None, None, None)], "id long, body string, key string, runs int, text int")
    rows = periodic.find_runs(df, key="id", text="body").collect()
    assert sorted((r.id or 0, r.n_words, len(r.runs), r.collapsed) for r in rows) == [(0, 0, 0, ""), (1, 6, 1, "x"), (1, 6, 1, "x")]


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    rows = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, FOLDER).collect()}
    assert rows.keys() == texts.keys() and any(r.n_runs for r in rows.values())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key, text in texts.items():
        w = brute.words(text)
        h, n = zlib.crc32(str(key).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute.periodic_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = rows[key]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in found)) and r.collapsed_sha256 == sha(brute.collapsed(w))
