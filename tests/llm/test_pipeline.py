from __future__ import annotations

import os
import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from glyphflow.llm import bpe
from glyphflow.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_corpus_operators import edited

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, docs_of, tmp_path):
    rng = random.Random(2)
    vocabulary = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "lmnrst"]
    fresh = lambda n: [rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n)]
    clean = [" ".join(fresh(80)) for _ in range(10)]
    base = fresh(120)
    copies = [" ".join(base)] * 2 + [edited(rng, base, 1)]
    item = " ".join(fresh(25))
    leak = " ".join(fresh(40)) + "\n" + item
    footer = "this very line stands under each and every page 7"
    texts = [f"{t}\n{footer}" for t in clean] + copies + [leak, "spam spam " * 30, None, ""]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of(texts)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append({r.doc_id for r in docs.collect()})
    n = len(clean)
    good = set(range(n))
    assert seen[0] == seen[1] == good | {n, n + 1, n + 2, n + 3}
    # One of the copies; the edited one has lost its only line to the first and stays, empty.
    assert seen[2] == good | {n, n + 2, n + 3}
    assert seen[3] == seen[4] == good | {n, n + 2}
    tokens = {r.doc_id: r for r in docs.collect()}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    assert tokens[0].ids == encoding.encode_ordinary(texts[0])
    for i in range(1, n):  # the footer recurs: only the first document keeps it
        assert tokens[i].ids == encoding.encode_ordinary(clean[i])


def test_pipeline_over_a_table(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    assert 0 < len(rows) < len(texts) and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        n, _, _, _, repeats = brute.quality(texts[r.doc_id])
        assert n >= 10 and 100 * repeats <= 20 * n


def test_there_is_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "glyphflow")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as file:
                    assert "glyphflow.llm" not in file.read(), name
