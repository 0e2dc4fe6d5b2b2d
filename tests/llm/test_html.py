"""Pages that are deep, wide, broken or wrapped, and random trees against a slow scorer."""

from __future__ import annotations

import itertools
import random
import time

import pytest

from glyphflow.llm import html
from tests.llm import brute

PROSE = "Some words, and more of them, that go on and on until the line is long enough, at last, to count as prose."


def tree(rng: random.Random, depth: int) -> list:
    """A random element whose mark-up no browser would repair."""
    if depth == 0 or rng.random() < 0.4:
        items = [rng.choice(["a, b ", PROSE, "word ", "  "]) if rng.random() < 0.7 else [rng.choice(["a", "b", "span", "label"]), rng.choice(["", "", "sidebar"]), [rng.choice(["link text ", "x, y "])]]
                 for _ in range(rng.randint(0, 3))]
        # Texts side by side are one text on the page.
        items = [x for kind, run in itertools.groupby(items, type) for x in (["".join(run)] if kind is str else run)]
        return [rng.choice(["p", "p", "p", "div", "h2", "li", "button", "blockquote"]), rng.choice(["", "", "", "content", "comments"]), items]
    tag = rng.choice(["div", "div", "div", "section", "article", "main", "nav", "header", "form", "footer", "ul"])
    if tag == "form" and depth < 3:
        tag = "div"
    return [tag, rng.choice(["", "", "", "content", "sidebar", "comments"]), [tree(rng, depth - 1) for _ in range(rng.randint(1, 4))]]


def test_random_trees_equal_the_slow_scorer():
    rng = random.Random(6)
    full = 0
    for _ in range(600):
        page = ["body", "", [tree(rng, 4) for _ in range(rng.randint(1, 4))]]
        text = html.main_text(brute.page_html(page))
        full += bool(text)
        assert text == brute.page_text(page), brute.page_html(page)
    assert full > 300


@pytest.mark.parametrize(("page", "count"), [
    ("<div>x" * 10_000, 10_000), ("<article><header>" + "<div>" * 10_000 + "<h1>t</h1>text", 2), ("<b>" * 50_000 + "x</i>" * 50_000, 1),
    ("<i><div>" + "<b>" * 20_000 + "x</i>" * 20_000, 1), ("<b>" * 20_000 + "<div>y</div>" * 20_000, 20_000), ("<div>" * 200 + "<p>abc, def</p>" * 20_000, 20_000),
    ("<article>" + "<header>" * 5_000 + "<h1>x", 1), ("<ul>" + "<div>" * 20_000 + "<li>x</li>" * 20_000, 20_000), ("<p>" + PROSE * 20_000, 1),
])
def test_deep_and_wide_pages_are_linear(page, count):
    started = time.time()
    assert html.main_text(page).count("\n") == count - 1
    assert time.time() - started < 5


def test_missing_end_of_the_head():
    for start in ("<html><head><title>x</title><body>", "<head><meta charset=utf-8>", "<head><title>x</title><div>"):
        assert html.main_text(f"{start}<p>{PROSE}</p>") == PROSE
    assert html.main_text(f"<head><title>x</title>{PROSE}") == PROSE


def test_a_form_around_the_page_stays_and_others_go():
    article = f"<div><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></div>"
    controls = "<input name=q><label>Your name, please</label><button>Send</button><select><option>one</select>"
    assert html.main_text(f"<body><form action=x>{article}{controls}</form></body>") == f"Title\n{PROSE}\n{PROSE}"
    assert html.main_text(f"<body>{article}<form>Write to us, now{controls}</form></body>") == f"Title\n{PROSE}\n{PROSE}"


def test_one_odd_page_does_not_stop_the_others(spark):
    pages = [(1, "<div>x" * 5_000, "own", 1), (2, None, "own", 1), (3, f"<p>{PROSE}", "own", 1), (3, f"<p>{PROSE}", "own", 1)]
    df = spark.createDataFrame(pages, "page_id long, html string, text string, n_chars int")
    rows = html.extract(df).collect()
    assert sorted((r.page_id, r.text.count("x"), len(r.text)) for r in rows)[1:] == [(2, 0, 0), (3, 0, len(PROSE)), (3, 0, len(PROSE))]
    assert max(r.text.count("x") for r in rows) == 5_000
