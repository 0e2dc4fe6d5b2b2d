"""Benchmark items in documents: against every pair of windows, and cases of slots, capitals and repetition."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest

from glyphflow.llm import decontaminate as D
from tests.llm import brute

RULES = D.Rules(window=4, min_literals=2, min_run=6, min_share=0.6, min_item_words=3, max_shift=3)


def found(doc, item, rules=None):
    rules = rules or D.Rules()
    return [tuple(map(int, r[2:])) for r in D.passages(pa.array([doc]), D.build([1], [item], rules), rules)]


def sentence(rng: random.Random, n: int) -> list[str]:
    words = ["a", "b", "c", "d", "e", "Tom", "Ana", "Bob", "3", "5", "7", "3.", "km", "hours", "b.", "X", "12kg"]
    return [rng.choice(words) for _ in range(n)]


def test_equals_every_pair_of_windows():
    rng = random.Random(11)
    units, hits = set(D.UNITS.split()), 0
    for _ in range(1_500):
        item = sentence(rng, rng.randint(1, 14)) * rng.choice([1, 1, 1, 2])
        doc = sentence(rng, rng.randint(0, 4)) + list(item) + sentence(rng, rng.randint(0, 4))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(doc) + 1)
            doc[at:at + rng.randint(0, 1)] = sentence(rng, rng.randint(0, 2))
        doc, item = rng.choice([" ", "\n"]).join(doc), " ".join(item)
        want = brute.leak(doc, item, units, RULES.window, RULES.min_literals, RULES.min_run, RULES.min_share, RULES.min_item_words, RULES.max_shift, RULES.max_partings)
        hits += want is not None
        assert found(doc, item, RULES) == ([] if want is None else [want]), (doc, item)
    assert 500 < hits < 1_450


@pytest.mark.parametrize(("item", "doc", "leaks"), [
    # Units stand for one unit throughout; another unit everywhere is a re-parameterised item.
    ("he ran about 60 km in the morning and then also rode for 60 km home", "he ran about 60 miles in the morning and then also rode for 60 km home", False),
    ("he ran about 60 km in the morning and then also rode for 60 km home", "he ran about 75 miles in the morning and then also rode for 75 miles home", True),
    # One number may part once, as two quantities can be equal.
    ("she bought 2 apples and also 2 pears at the market on that day before noon", "she bought 3 apples and also 5 pears at the market on that day before noon", True),
    ("take 2 of these and 2 of those and then 2 of mine and also 2 of yours now", "take 3 of these and 4 of those and then 5 of mine and also 6 of yours now", False),
    # Capitals beyond ASCII, units of other languages.
    ("so when Tom gives three red apples to Anna and then Anna gives back two to Tom what is left", "so when Óscar gives three red apples to Élodie and then Élodie gives back two to Óscar what is left", True),
    ("so when Tom gives three red apples to Anna and then Anna gives back two to Tom what is left", "so when Óscar gives three red apples to Élodie and then Zoë gives back two to Óscar what is left", False),
    ("der Zug braucht dafür etwa 3 Stunden und fährt dann nach 5 Stunden wieder zurück", "der Zug braucht dafür etwa 4 Tage und fährt dann nach 6 Tage wieder zurück", True),
])
def test_slots_are_consistent(item, doc, leaks):
    assert bool(found(doc, item)) is leaks


def test_a_verbatim_run_counts_whatever_is_around():
    run = "one two six ten red blue green pink gray gold lime teal navy plum"
    assert found(f"Tom met Ana and Bob met Tom {run}", f"x Eva met Eva and Eva met Eva {run}")


def test_repetitive_texts_are_linear():
    item = "word " * 60
    for text in ("word " * 20_000, "word other " * 10_000, "a b c d e f g h " * 2_500):
        index = D.build([1, 2], [item, text[:400]], D.Rules())
        started = time.time()
        assert D.passages(pa.array([text, None, ""]), index, D.Rules())
        assert time.time() - started < 5


def test_clashing_names_ties_repeated_rows_and_long_texts(spark):
    item = "Tom has 3 apples and buys 4 more at the old market near the river today"
    copy = "Eva has 5 apples and buys 9 more at the old market near the river today"
    filler = "nothing in these words is of any use to anyone who reads them at all "
    docs = spark.createDataFrame([(1, copy, "x", 0), (1, copy, "x", 0), (2, filler * 20_000 + copy, "x", 0), (3, None, None, None), (4, filler, "", 1)],
                                 "id long, text string, doc string, item int")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 1), (9, "", 1)], "id long, text string, doc int")
    rows = D.leaks(docs, bench, doc_key="id", item_key="id").collect()
    assert sorted((r.id, r.item_id, r.matched_words, r.changed_slots) for r in rows) == [(1, 7, 16, 3)] * 4 + [(2, 7, 15, 2)] * 2
    kept = D.without_leaks(docs, bench, item_key="id")
    assert kept.columns == docs.columns and sorted(r.id for r in kept.collect()) == [3, 4]
    assert D.leaks(docs.limit(0), bench, doc_key="id", item_key="id").count() == 0
    assert D.leaks(docs, bench.limit(0), doc_key="id", item_key="id").count() == 0
