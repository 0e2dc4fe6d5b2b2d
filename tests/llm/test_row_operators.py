"""Operators that judge each row by itself: quality, personal data, BPE, HTML, decontamination."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from glyphflow.llm import bpe, decontaminate, html, pii, quality
from tests.llm import brute

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " \n\t ", "one", "Tie tie\nTie tie\nTie tie", "x " * 3000, "é" * 4000, "### *** $$$ a b"]


def test_quality_counts_equal_brute_force(docs_of):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice("a b c dd e\n #x f g h").strip(" ") or "\n" for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = {r.doc_id: r for r in quality.measure_quality(docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r = rows[i]
        n, chars, symbols, lines, repeats = brute.quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), t
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert not (r.base_failed and r.kept)


def test_quality_keeps_clean_and_drops_repeats(docs_of):
    clean = "Each of these words stands for itself and none of the phrases comes back in what follows here today."
    junk = "buy now " * 30
    kept = quality.keep_good(docs_of([clean, junk, None, "a%%% b*** c$$$ d&&& e### f%%% g*** h$$$ i&&& j### k%%%"]))
    assert [r.text for r in kept.collect()] == [clean]
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_of_an_empty_table(docs_of):
    assert quality.measure_quality(docs_of([])).count() == 0
    assert quality.keep_good(docs_of([])).count() == 0


def test_clashing_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "some text", 5, True)], "doc_id long, text string, n_words long, kept boolean")
    assert quality.measure_quality(df).first().n_words == 2
    assert quality.keep_good(df).columns == df.columns


def test_patterns_equal_plain_matching():
    rng = random.Random(2)
    parts = ["a", "@", ".", "1", "255", "256", "+", "-", " ", "(", ")", "b.c", "x@y.z", "@@", "4111111111111111", "007", "%", "\n", "é", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(text) == brute.personal(text), text


def test_patterns_are_linear_on_long_runs():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@" * 300_000, "+1 " * 100_000):
        pii.base_spans(text)


def test_field_adds_what_the_patterns_drop(docs_of):
    filler = "ordinary words without anything else " * 3
    rows = [f"{filler} call +1 (555) 234-{1000 + i} or write user.{i}@mail.example.com soon" for i in range(60)]
    # The digits of both numbers run together, so that the patterns drop both; the shape of the phone is known.
    rows.append("reach +1 (555) 234-9999 4111111111111111 today and user.7@mail.example.com")
    docs = docs_of(rows)
    found = {r.doc_id: r for r in pii.find(docs, pii.train(docs)).collect()}
    last = found[60]
    assert (last.n_phone, last.n_card, last.n_email) == (0, 0, 1)
    assert "phone:6:23" in last.spans.split(",") and last.n_added == 1
    for i in range(60):
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute.personal(rows[i]))
        assert found[i].spans == base and found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_field_leaves_clean_texts_alone(docs_of):
    texts = [None, "", "Version 2.0 of 1999 was released in 12 parts.", "no digits here", "password=b7db7aa4a5fcc78305 and 7 more"] + ["mail a.b@c.example.org now"] * 30
    docs = docs_of(texts)
    rows = {r.doc_id: r for r in pii.find(docs, pii.train(docs)).collect()}
    assert all(rows[i].spans == "" for i in range(5))
    assert rows[9].n_email == 1


def test_labels_reach_every_repeat():
    number, filler = "4111111111111111", "ordinary words without anything else"
    # The "9" before a number runs together with it: the patterns see one occurrence only.
    far = f"{filler} 9 {number} x " * 30 + f"card {number} of " + f"{filler} 9 {number} x " * 30
    g = pii.graph([far], [pii.base_spans(far)])
    repeats = [i for i in range(len(g.doc)) if far[g.start[i]:g.end[i]] == number]
    assert len(repeats) == 61 and np.flatnonzero(g.label[repeats] >= 0).tolist() == [30]
    # Nothing but repeats tells anything.
    edge = np.zeros((len(pii.EDGES), pii.LABELS, pii.LABELS))
    edge[1] = 3 * np.eye(pii.LABELS)
    p = pii.marginals(g, pii.Field(np.zeros((pii.FEATURES, pii.LABELS)), edge))[repeats, 2]
    assert p[30] > 0.999 and p.min() > 0.8


def test_field_without_any_candidate(docs_of):
    docs = docs_of(["plain text", None])
    assert [r.spans for r in pii.find(docs, pii.train(docs)).collect()] == ["", ""]
    assert pii.find(docs_of([]), pii.train(docs_of([]))).count() == 0


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_transducer_equals_the_library(reference):
    rng = random.Random(5)
    own = bpe.codec(PATH, PATTERN)
    parts = ["a", "e", "t", "the", " ", "  ", "\n", "é", "日", "🙂", "́", "1", "999", "!!", "***", "'s", "ing", "tion", "\t", " ", "<|endoftext|>"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = own.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert "".join(own.decode_stream([[i] for i in ids])) == text


def test_transducer_with_forgotten_states(reference):
    own = bpe.Codec(PATH, PATTERN, bpe.Memory(states=40, pieces=5, missed=300))
    rng = random.Random(6)
    for _ in range(600):
        text = "".join(rng.choice("abcdeinoprst  '.é") for _ in range(rng.randint(0, 80)))
        assert own.encode(text) == reference.encode_ordinary(text)


def test_encode_and_decode_frames(docs_of, reference):
    texts = [None, "", "Hello  world\n", "é🙂 " * 50, "ab" * 20_000]
    tokens = bpe.encode(docs_of(texts), PATH, PATTERN)
    rows = {r.doc_id: r for r in tokens.collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == reference.encode_ordinary(t or "") and bytes(rows[i].decoded).decode() == (t or "")
    assert {r.doc_id: r.text for r in bpe.decode(tokens, PATH, PATTERN, chunk=3).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.encode(docs_of([]), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_encoded_rows_are_decoded_as_streams(docs_of, chunk):
    texts = [None, "", "né 日本 🙂🙃 ́", "🙂é" * 3000]
    rows = {r.doc_id: r for r in bpe.encode(docs_of(texts), PATH, PATTERN, chunk=chunk).collect()}
    assert [bytes(rows[i].decoded).decode() for i in range(4)] == [t or "" for t in texts]


def test_encode_decodes_by_the_stream(monkeypatch):
    """The frame's own function, without workers: `decoded` is what the stream gives."""
    seen = []
    monkeypatch.setattr(bpe.Codec, "decode_stream", lambda self, chunks: seen.append(list(chunks)) or iter(["streamed"]))

    class Docs:
        schema = {"doc_id": bpe.T.StructField("doc_id", bpe.T.LongType())}
        sparkSession = None

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return list(run(iter([pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some text here"]})])))

    monkeypatch.setattr(bpe, "small_batches", lambda spark: None)
    (batch,) = bpe.encode(Docs(), PATH, PATTERN, chunk=2)
    assert batch.column(2).to_pylist() == [b"streamed"] and max(map(len, seen[0])) == 2


def test_utf8_machine_holds_back_cut_characters():
    data = "aé日🙂b".encode()
    for step in (1, 2, 3):
        state = bpe.Utf8()
        assert "".join(state.feed(data[i:i + step]) for i in range(0, len(data), step)) + state.close() == "aé日🙂b"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><p>Slogan, with, commas.</p></header><nav><ul><li><a href="/a">a</a></ul></nav><!-- ad --><div class="ad">Buy, buy, buy</div>
<div id="cookie-notice"><p>We use cookies, yes, really, all, the time, everywhere.</p></div>
<div class="wrap"><div class="post-content"><h1>Title &amp; more</h1><p>First, para <a href=x>link</a> with&nbsp;text,
 and more.<p>Second <b>bold<p>Third</b> x<ul><li>one<li>two</ul><form><p>Sign up, now, please</form></div>
<div class="sidebar"><p>Related, things, to, read, elsewhere.</p></div>
<section id="comments"><p>Nice, great, text, yes, a comment that is quite long and has, many, commas, really, lots of them.</p></section></div>
<footer>&copy; all</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE) == "Title & more\nFirst, para link with text, and more.\nSecond bold\nThird x\none\ntwo"


@pytest.mark.parametrize("page", ["", "<", "<p", "<p class='x", "<!-- ", "<script>", "a < b", "</p></p>", "<div>" * 3000, "<b>" * 500 + "x", "&amp", "&#x41;&bogus;"])
def test_broken_pages_do_not_fail(page):
    html.main_text(page)


def test_short_article_is_kept_whole():
    assert html.main_text("<body><nav>m</nav><article><h1>UND</h1><p><b>UND.<br><p>UND.</p></article><footer>f</footer>") == "UND\nUND.\nUND."


@pytest.mark.parametrize("around", ["article", "main", 'div class="post-content"'])
def test_long_articles_keep_what_stands_beside_their_body(around):
    prose = ["One, two, three, " + f"{k} words of a paragraph " * 13 for k in range(20)]
    inner = "<h1>Title</h1><div class=lead><p>Short lead.</div><div><p>" + "<p>".join(prose) + "</div><ul><li>point</ul><table><tr><td>cell</table><blockquote>said</blockquote><pre>code</pre>"
    page = f"<body><nav><a href=x>menu</a></nav><{around}>{inner}<div class=share>Share it</div></{around.split()[0]}><div>Beside it, all the same</div>"
    expected = ["Title", "Short lead.", *(p.strip() for p in prose), "point", "cell", "said", "code"]
    assert html.main_text(page).split("\n") == expected
    # An element full of links is not the article.
    linked = page.replace("Short lead.", "<a href=x>" + "a link " * 1000 + "</a>")
    assert html.main_text(linked).split("\n")[-20:] == expected[2:22]


def test_articles_side_by_side_are_kept():
    prose = "<p>" + "Some, words, of, an article that is long enough to be seen. " * 8 + "</p>"
    assert html.main_text(f"<body><div><article>{prose * 3}</article><article>{prose * 2}</article></div>").count("\n") == 4


def test_extract_frame(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, PAGE), (3, None, PAGE)], "page_id long, url string, html string")
    rows = html.extract(pages, keys=("page_id", "url")).collect()
    assert sorted((r.page_id, len(r.text)) for r in rows) == [(1, 0), (2, 0), (3, len(html.main_text(PAGE)))] + [(3, len(html.main_text(PAGE)))]
    assert html.extract(pages.limit(0)).count() == 0


QUESTION = "Tom has 3 apples and Anna gives Tom 5 more apples today so how many apples does Tom have in the end"
PASSAGE = "the quick movement of every single part was written down before anyone could see what the machine had done to it"


def bench_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_leaks_verbatim_changed_and_clean(spark, docs_of):
    filler = "some other words that belong to nobody and mean nothing at all here "
    docs = docs_of([
        filler + PASSAGE + " " + filler,
        filler + PASSAGE.upper().replace(" ", "*** "),
        filler + QUESTION.replace("3", "7").replace("5", "12").replace("Tom", "Bob").replace("Anna", "Eve") + ".",
        filler + QUESTION.replace("gives Tom", "gives Bob"),
        filler * 5, None, "", " ".join(PASSAGE.split()[:9]),
    ])
    bench = bench_of(spark, [PASSAGE, QUESTION, None, "", "too short"])
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(found) == {(0, 0), (1, 0), (2, 1)}
    assert found[2, 1].n_slots >= 4 and found[2, 1].changed_slots >= 4 and found[0, 0].changed_slots == 0
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()) == [3, 4, 5, 6, 7]


def test_leaks_in_blocks_equal_leaks_at_once(spark, docs_of):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40))) for _ in range(40)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) + " " + (items[i % 40] if i % 3 else "") for i in range(80)]
    bench, docs = bench_of(spark, items), docs_of(texts)
    one = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    many = sorted(map(tuple, decontaminate.leaks(docs, bench, rules=decontaminate.Rules(block_words=20)).collect()))
    assert one == many and {(r[0], r[1]) for r in one} >= {(i, i % 40) for i in range(80) if i % 3 and len(items[i % 40].split()) >= 5}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.leaks(docs_of([]), bench).count() == 0


def test_verbatim_items_with_few_literals_are_found(spark, docs_of):
    items = ["Tom has 3 kg, Ana has 5 kg, Bob has 7 kg.", "What is 12 times 7?", "Is 91 prime?"]
    docs = docs_of([*(f"before it and {i} after it" for i in items), items[0].replace("5", "6"), "What is 13 times 7?", "Is 97 prime?"])
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench_of(spark, items)).collect()}
    assert set(found) == {(0, 0), (1, 1), (2, 2)}
    assert all(r.matched_words == r.item_words and r.changed_slots == 0 for r in found.values())
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, bench_of(spark, items)).collect()) == [3, 4, 5]


def test_changed_items_are_found_by_all_their_words(spark, docs_of):
    problem = "Tom has 3 apples and buys 4 more. Tom eats 2 of them. How many apples does Tom have left now?"
    equal = "There are 2 apples and there are 2 pears on the table so how many fruits are there in all"
    long = PASSAGE + " Tom told us while Tom sat there"
    edited = PASSAGE.split()
    docs = docs_of([
        "Before it. " + problem.replace("Tom", "Eva"),
        equal.replace("2 apples", "3 apples").replace("2 pears", "5 pears"),
        long.replace("while Tom", "while Bob"),
        " ".join([*edited[:9], "very", *edited[9:18], "surely", "not", *edited[18:]]),
        problem.replace("Tom eats", "Eva eats").replace("does Tom", "does Bob"),
        problem.replace("Tom eats", "She eats"),
    ])
    found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench_of(spark, [problem, equal, long, PASSAGE])).collect()}
    assert {(0, 0), (1, 1), (2, 2), (3, 3)} <= set(found) and found[5, 0].matched_words == 20 and not any(d == 4 for d, _ in found)
    assert (found[0, 0].matched_words, found[0, 0].item_words, found[0, 0].changed_slots) == (21, 21, 3)
    assert found[1, 1].changed_slots == 2 and found[2, 2].changed_slots == 1


def test_template_codes():
    t = decontaminate.template(pa.array(["He walked 5 km with Maria. Then 12kg fell"]))
    slots = [s != 0 for s in t.slot]
    assert slots == [False, False, True, True, False, True, False, True, False]
