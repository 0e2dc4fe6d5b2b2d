"""Operators over the whole corpus: n-gram join, substring dedup, language model, line dedup."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import hmm, lines, ngram_join, substrings
from glyphflow.llm.components import components
from tests.llm import brute

ODD = [None, "", "  \n ", "one", "one", "One", "two words", "two words", "x " * 400]


def edited(rng: random.Random, base: list[str], edits: int) -> str:
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed: int, sizes=(12, 40, 90, 200)) -> list[str | None]:
    """Odd texts, copies, near copies of several originals, and texts that share a passage only."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts: list[str | None] = list(ODD)
    for size in sizes:
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += [" ".join(base)] * 3 + [edited(rng, base, rng.randint(0, 4)) for _ in range(25)]
        texts += [" ".join(base[:-k]) for k in range(1, 5)]
    for _ in range(40):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60)))
        texts.append(f"{own} {passage} {own[::-1]}")
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 50), (2, 99)])
def test_components_equal_brute_force(docs_of, size, percent):
    texts = corpus(size)
    rows = {r.doc_id: r for r in ngram_join.link(docs_of(texts), rules=ngram_join.Rules(size=size, percent=percent, sketch_bits=8)).collect()}
    expected = brute.components(dict(enumerate(texts)), size, percent)
    assert {k: r.component_id for k, r in rows.items()} == expected
    assert all(r.n_shingles == len(brute.shingle_set(texts[k], size)) for k, r in rows.items())


def test_joins_without_broadcast_give_the_same(docs_of):
    docs = docs_of(corpus(9))
    few = ngram_join.link(docs, rules=ngram_join.Rules(max_sent_rows=0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, ngram_join.link(docs).collect()))


def test_join_of_odd_tables(spark, docs_of):
    assert ngram_join.link(docs_of([])).count() == 0
    rows = ngram_join.link(docs_of([(5, "same words here"), (None, "same words here"), (2, "same words here"), (2, "same words here"), (9, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows) == [(False, 2, 2), (False, 2, 2), (False, 5, 2), (False, 9, 9), (True, 0, None)]
    kept = ngram_join.keep_one(docs_of([(5, "same words here"), (2, "same words here"), (None, "x"), (9, None)]))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 9]
    clash = spark.createDataFrame([(1, "a b c", 7, 8)], "doc_id long, text string, key long, component_id long")
    assert ngram_join.link(clash).first().component_id == 1
    assert ngram_join.keep_one(clash).columns == clash.columns


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in rows} == {**{i: 0 for i in range(61)}, **{500 + i: 500 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rules", [substrings.Rules(), substrings.Rules(window=4, anchor=2)])
def test_repeats_equal_brute_force(docs_of, rules):
    texts = corpus(11) + ["a b a b a b a b a b a b a b a b a b", "z a b a b a b a b a b a b a b a b"]
    rows = {r.doc_id: r for r in substrings.remove_repeats(docs_of(texts), rules=rules).collect()}
    assert {k: (r.n_words, r.n_removed, r.kept) for k, r in rows.items()} == brute.without_repeats(dict(enumerate(texts)), rules.window)


def test_repeats_with_small_sendings(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", 50)
    texts = corpus(12)
    rows = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs_of(texts).repartition(5)).collect()}
    assert rows == brute.without_repeats(dict(enumerate(texts)), 13)


def test_repeats_of_odd_tables(spark, docs_of):
    assert substrings.remove_repeats(docs_of([])).count() == 0
    passage = " ".join(f"w{i}" for i in range(20))
    rows = substrings.remove_repeats(docs_of([(None, passage), (3, passage), (3, passage), (4, "x " + passage + " y")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.kept) for r in rows) == [
        (False, 3, 0, passage), (False, 3, 0, passage), (False, 4, 20, "x y"), (True, 0, 0, passage),
    ]
    clash = spark.createDataFrame([(1, passage, 1, 1), (2, passage, 1, 1)], "doc_id int, text string, doc long, places long")
    assert sorted(r.n_removed for r in substrings.digest_repeats(clash).collect()) == [0, 20]


def plain_forward(model: hmm.Model, classes: np.ndarray) -> float:
    state = model.first * model.emit[classes[0]]
    total = math.log(state.sum())
    state = state / state.sum()
    for c in classes[1:]:
        state = (state @ model.move) * model.emit[c]
        total += math.log(state.sum())
        state = state / state.sum()
    return total


def random_model(rng: np.random.Generator, states: int, classes: int) -> hmm.Model:
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states).T)


@pytest.mark.parametrize("stretch", [1, 3, 8, 1000])
def test_stretched_likelihood_is_exact(stretch):
    rng = np.random.default_rng(0)
    model = random_model(rng, 3, 16)
    n = np.array([1, 7, 64, 65, 400, 3])
    doc = np.concatenate(([0], np.cumsum(n)))
    classes = rng.integers(0, 16, n.sum())
    expected = [plain_forward(model, classes[a:b]) for a, b in zip(doc, doc[1:], strict=False)]
    assert np.allclose(hmm.log_likelihoods(classes, doc, model, stretch), expected, rtol=1e-12)


def test_expected_counts_equal_enumeration():
    rng = np.random.default_rng(3)
    model, classes = random_model(rng, 2, 3), np.array([0, 2, 1, 1])
    counts = np.zeros(len(model.flat()))
    total = 0.0
    for path in np.ndindex(2, 2, 2, 2):
        p = model.first[path[0]] * model.emit[classes[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[classes[t], path[t]]
        own = hmm.Model(np.zeros(2), np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)))
        own.first[path[0]] += 1
        for t in range(4):
            own.emit[classes[t], path[t]] += 1
            if t:
                own.move[path[t - 1], path[t]] += 1
        counts += p * own.flat()
        total += p
    got = hmm.expected(classes, np.array([0, 4]), model, 10)
    assert np.allclose(got[:-1], counts / total) and math.isclose(got[-1], math.log(total))


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    model, rules = random_model(rng, 3, 16), hmm.Rules(states=3, class_bits=4)
    doc = np.arange(0, 601, 60)
    classes = np.concatenate([rng.integers(0, 8, 300), rng.integers(8, 16, 300)])
    logs = []
    for _ in range(5):
        got = hmm.expected(classes, doc, model, 1000)
        logs.append(got[-1])
        model = hmm.normalised(got[:-1], rules)
    assert all(b >= a - 0.1 for a, b in zip(logs, logs[1:], strict=False)) and logs[-1] > logs[0] + 10


def test_scores_equal_brute_force(docs_of):
    texts = corpus(21) + ["unseen"]
    rows = {r.doc_id: r for r in hmm.score(docs_of(texts), rules=hmm.Rules(states=2, class_bits=5, steps=2)).collect()}
    tokens = {i: [*brute.words(t, lower=True), None] for i, t in enumerate(texts)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens.items():
        r = rows[i]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_states_help_on_held_out_texts(docs_of):
    """Two kinds of text that never mix: a model with states beats the unigrams on documents it has not seen."""
    rng = random.Random(8)
    texts = [" ".join(f"{'ab'[i % 2]}{rng.randrange(50)}" for _ in range(80)) for i in range(200)]
    rows = hmm.score(docs_of(texts), rules=hmm.Rules(states=2, class_bits=8, steps=12)).where("held_out").collect()
    assert len(rows) > 5 and sum(r.score for r in rows) > sum(r.base_score for r in rows) + 50


def test_scores_of_odd_tables(docs_of):
    assert hmm.score(docs_of([])).count() == 0
    rows = hmm.score(docs_of([(None, "a b"), (1, None), (1, None)])).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 3] and all(math.isfinite(r.score) for r in rows)


def test_recurring_lines(docs_of):
    own = [f"document number {w} has its own words in this line" for w in "alpha beta gamma delta".split()]
    docs = docs_of([f"{o}\nLogged in at 10:{i} from host {i} today\nkeep" for i, o in enumerate(own)] + [None, "", "short line\nshort line"])
    rows = {r.doc_id: r for r in lines.drop_recurring(docs).collect()}
    assert rows[0].text == f"{own[0]}\nLogged in at 10:0 from host 0 today\nkeep" and rows[0].n_dropped == 0
    for i in (1, 2, 3):
        assert rows[i].text == own[i] and (rows[i].n_lines, rows[i].n_dropped) == (3, 2)
    assert rows[4].text is None and rows[4].n_lines == 0 and rows[5].text == "" and rows[6].text == "short line\nshort line"
    assert rows[5].n_dropped == rows[6].n_dropped == 0


def test_lines_alike_in_most_places_share_a_template(docs_of):
    base = "the server has stopped and will start again after a short while thanks".split()
    texts = [" ".join(base[:-1] + [w]) for w in ("friend", "reader", "visitor", "guest")] + ["the server has gone away for good and nobody at all knows why or when"]
    rows = {r.doc_id: r.text for r in lines.drop_recurring(docs_of(texts)).collect()}
    assert rows == {0: texts[0], 1: "", 2: "", 3: "", 4: texts[4]}


def test_every_template_of_a_leaf_is_found(docs_of):
    # One leaf (ten tokens, the same three in front): a hot template, three more of two texts each, and two lines of their own.
    hot = "the user was shown page {} of the long list"
    rare = ["the user was never told why {} left our team", "the user was sent home after {} rang very late", "the user was happy again when {} came back in"]
    alone = ["the user was left out of every single other plan", "the user was one more name on some old sheet"]
    names = "anna bert cleo dora emil finn gerd hugo".split()
    texts = [hot.format(n) for n in names] + [r.format(n) for r in rare for n in ("ida", "jan")] + alone
    assert {len(t.split()) for t in texts} == {10}
    rows = {r.doc_id: r.text for r in lines.drop_recurring(docs_of(texts)).collect()}
    first = {0, *range(8, 14, 2), 14, 15}
    assert rows == {i: t if i in first else "" for i, t in enumerate(texts)}


def test_two_texts_are_enough_and_short_lines_recur_as_they_are(docs_of):
    long = "this line of many words stands in two texts"
    texts = [f"{long}\nPage 1\n\nown words of one", f"Page 2\n{long}\n\nown words of two", "Page  1\n \nown words of three", "Page 3\n\n \n"]
    rows = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_recurring(docs_of(texts)).collect()}
    assert rows == {0: (texts[0], 0), 1: ("Page 2\n\nown words of two", 1), 2: (" \nown words of three", 1), 3: (texts[3], 0)}


def test_lines_stay_when_few_documents_have_them(docs_of):
    line = "a line that is long enough to count here"
    docs = docs_of([(1, line), (1, line), (2, f"{line}\n{line}"), (None, "x")])
    assert sorted((r.doc_id or 0, r.n_dropped) for r in lines.drop_recurring(docs).collect()) == [(0, 0), (1, 0), (1, 0), (2, 2)]
    assert all(r.n_dropped == 0 for r in lines.drop_recurring(docs, rules=lines.Rules(min_docs=3)).collect())
    # Copies of a whole document are one; the line stays with the smallest key, and with its copies.
    whole = [(2, line + "\nb"), (3, line + "\nc"), (1, line), (None, line), (4, line)]
    assert sorted((r.doc_id or 0, r.text) for r in lines.drop_recurring(docs_of(whole)).collect()) == [(0, line), (1, line), (2, "b"), (3, "c"), (4, line)]
    assert all(r.n_dropped == 0 for r in lines.drop_recurring(docs_of([(i, line) for i in range(9)])).collect())


def test_lines_without_broadcast_and_with_clashing_columns(spark, docs_of):
    docs = docs_of([f"{t}\nthe same long line in every text 5" for t in corpus(31) if t])
    one = sorted(map(tuple, lines.drop_recurring(docs).collect()))
    assert one == sorted(map(tuple, lines.drop_recurring(docs, rules=lines.Rules(max_sent_rows=0)).collect()))
    clash = spark.createDataFrame([(1, "t", 3, "v")], "doc_id long, text string, n_lines int, version string")
    assert lines.drop_recurring(clash).columns == ["doc_id", "text", "version", "n_lines", "n_dropped"]
    assert lines.drop_recurring(docs_of([])).count() == 0


def test_line_dedup_runs_in_the_jvm(docs_of):
    plan = lines.drop_recurring(docs_of(["a b c d e"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_masked_words(spark):
    texts = ["  two  spaces ", "tab\there 5", "id=4 and x9y end", "none", "", "7"]
    rows = spark.createDataFrame([(t,) for t in texts], "line string").select(lines.masked(F.col("line")).alias("m")).collect()
    assert [r.m for r in rows] == ["two spaces", "tab here <*>", "<*> and <*> end", "none", "", "<*>"]
