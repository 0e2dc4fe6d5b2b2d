"""N-gram Jaccard join: which documents share nearly all their word n-grams.

Skipping works on two levels. In the index, a token's list is cut into blocks
by set size, holds each entry's position in its set, and whatever cannot reach
the overlap by size or position is skipped. Among answers, equal sets are one;
every block first links its entries to one leader, and what the leader's
answers settle is not computed again: two sets of one component need no
comparison, and the overlap of two sets is bounded by their overlaps with
their common leader. Only pairs left open are compared, exactly.

Sets are ordered by how often a token's cell of a fixed-size count sketch
occurs, rarest first: frequent passages come last, and lists stay short.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm import words as W
from glyphflow.llm.components import components
from glyphflow.llm.frames import sent_if_small, small_batches, stored

# Rows of an Arrow batch: two sets of a pair travel in one row.
PAIRS_PER_BATCH = 256
# Cells of the sketch in a row, and tasks whose sketches are added up at once.
CHUNK_CELLS = 1 << 14
TEAM_TASKS = 256


@dataclass(frozen=True)
class Rules:
    """Words of an n-gram; linked from `percent` hundredths of Jaccard similarity on."""

    size: int = 5
    percent: int = 80
    # Cells of the count sketch, which only orders tokens.
    sketch_bits: int = 20
    # Documents to compare up to this number (about 20 bytes each) are sent to all tasks, more are joined by shuffle.
    max_sent_rows: int = 500_000

    def needed(self, n: Column, m: Column) -> Column:
        """Least overlap of linked sets of n and m."""
        return F.ceil(self.percent * (n + m) / F.lit(100 + self.percent)).cast("long")

    def prefix(self, n: int) -> int:
        """Tokens of a set of n of which linked sets share one."""
        return n - -(-self.percent * n // 100) + 1


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row, with repeats, and where each row's begin; shorter texts are one n-gram."""
    words, _ = W.cut(column, lower=True)
    hashes = W.word_hashes(words)
    counts, first = words.per_row(), words.first_of_row()
    whole = np.flatnonzero(W.whole_windows(words, size))
    values, rows = W.window_hashes(hashes, size)[whole], words.row[whole]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            values = np.concatenate((values, W.window_hashes(hashes, n)[first[short]]))
            rows = np.concatenate((rows, short))
    order = np.argsort(rows, kind="stable")
    return values[order], np.searchsorted(rows[order], np.arange(words.rows + 1))


def _sketch(docs: DataFrame, rules: Rules) -> np.ndarray:
    """Occurrences of the tokens of each cell, over all documents."""
    cells = 1 << rules.sketch_bits
    chunk = min(cells, CHUNK_CELLS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for part in W.slices(batches, "text"):
            values, _ = shingles(part.column(0), rules.size)
            counts += np.bincount((values & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        team = TaskContext.get().partitionId() // TEAM_TASKS
        for n, at in enumerate(range(0, cells, chunk)):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([team], pa.int32()), pa.array([counts[at:at + chunk].tobytes()])], ["chunk", "team", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(chunk, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.int64)
        return pa.table([table.column("chunk")[:1], table.column("team")[:1], pa.array([total.tobytes()], pa.binary())], ["chunk", "team", "counts"])

    schema = "chunk int, team int, counts binary"
    sums = docs.select("text").mapInArrow(count, schema)
    # Tasks are added up in teams first, then the teams.
    for keys in (["chunk", "team"], ["chunk"]):
        sums = sums.groupBy(*keys).applyInArrow(add, schema)
    sketch = np.zeros(cells, np.int64)
    for row in sums.collect():  # one row for each chunk of cells
        sketch[row["chunk"] * chunk:(row["chunk"] + 1) * chunk] = np.frombuffer(row["counts"], np.int64)
    return sketch


def _profiles(docs: DataFrame, sketch: np.ndarray, rules: Rules) -> DataFrame:
    """Key, set size, two hashes of the set, and its rarest tokens in order, for each row."""
    mask = np.uint64(len(sketch) - 1)
    key = docs.schema["key"]
    schema = T.StructType([key, *(T.StructField(n, T.LongType()) for n in ("n", "set_a", "set_b")), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            values, begin = shingles(part.column(1), rules.size)
            rows = part.num_rows
            n, a, b = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            prefixes = []
            for i in range(rows):
                own = np.unique(values[begin[i]:begin[i + 1]])
                n[i] = len(own)
                if len(own):
                    a[i], b[i] = W.mix(own).sum(), W.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum()
                    order = np.lexsort((own, sketch[(own & mask).astype(np.int64)]))
                    own = own[order[:rules.prefix(len(own))]]
                prefixes.append(own)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists], [f.name for f in schema])

    return docs.select("key", "text").mapInArrow(run, schema)


def _promising(pairs: DataFrame, profiles: DataFrame, rules: Rules) -> DataFrame:
    """The pairs (a, b of sizes n, m) whose overlap can be large enough by what their front tokens share.

    Fronts are cut from one order of all tokens, so behind the front of the set
    whose front ends first nothing is known, and up to there everything.
    """
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "wanted")
    fronts = profiles.select("key", "set_a", "prefix").join(sent_if_small(wanted, rules.max_sent_rows), "key", "left_semi").dropDuplicates(["key", "set_a"])
    both = pairs.join(fronts.select(F.col("key").alias("a"), F.col("prefix").alias("left")), "a")
    both = both.join(fronts.select(F.col("key").alias("b"), F.col("prefix").alias("right")), "b")
    most = F.size(F.array_intersect("left", "right")) + F.greatest(F.col("n") - F.size("left"), F.col("m") - F.size("right"))
    return both.where(most >= rules.needed(F.col("n"), F.col("m"))).drop("left", "right").dropDuplicates(["a", "b"])


def _overlaps(docs: DataFrame, pairs: DataFrame, rules: Rules) -> DataFrame:
    """a, b and the exact size of their sets' intersection; `pairs` is stored."""
    wanted = stored(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "wanted")
    own = docs.join(sent_if_small(wanted, rules.max_sent_rows), "key", "left_semi")
    schema = T.StructType([docs.schema["key"], T.StructField("tokens", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "text"):
            values, begin = shingles(part.column(1), rules.size)
            tokens = [np.unique(values[begin[i]:begin[i + 1]]).tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.binary())], ["key", "tokens"])

    found = own.select("key", "text").mapInArrow(sets, schema)
    both = pairs.join(found.withColumnsRenamed({"key": "a", "tokens": "left"}), "a").join(found.withColumnsRenamed({"key": "b", "tokens": "right"}), "b")
    kind = docs.schema["key"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("shared", T.LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                at = np.searchsorted(left, right)
                shared.append(int((left[np.minimum(at, len(left) - 1)] == right).sum()) if len(left) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64())], ["a", "b", "shared"])

    return both.select("a", "b", "left", "right").mapInArrow(compare, out)


def _within(rules: Rules, n: str, pos: str, m: str, place: str) -> Column:
    """Whether two sets can be linked when the named positions hold their first common token."""
    rest = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(place))
    return rest >= rules.needed(F.col(n), F.col(m))


def _linked(rules: Rules, n: str, m: str) -> Column:
    return (100 + rules.percent) * F.col("shared") >= rules.percent * (F.col(n) + F.col(m))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """Key, `n_shingles`, `component_id` and `n_class`, one row for each input row.

    `component_id` is the smallest key reachable by links, the row's own
    included; `n_class` counts the rows with the same set. Words are runs of
    other than ASCII white space with A-Z lower-cased; a null or empty text has
    no shingles, is linked with nothing and is its own component. Rows with one
    key are one document; a null key stays by itself. No pair of linked texts is
    missed, whatever the size of a group; other columns do not matter.
    """
    rules = rules or Rules()
    small_batches(docs.sparkSession, PAIRS_PER_BATCH)
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    profiles = stored(_profiles(docs, _sketch(docs, rules), rules), "profiles")
    full = profiles.where((F.col("n") > 0) & F.col("key").isNotNull())
    classes = stored(full.groupBy("set_a", "set_b", "n").agg(F.min("key").alias("rep"), F.count("*").alias("n_class")), "classes")
    one = full.join(classes, ["set_a", "set_b", "n"]).where(F.col("key") == F.col("rep")).dropDuplicates(["rep", "set_a", "set_b"])
    index = _index(one, rules)
    first = _leaders(docs, full, index, rules)
    joined = stored(components(first.where("linked")), "components")
    more = _open_pairs(docs, full, index, first, joined, rules)
    again = stored(components(more), "components-again")
    # A class hangs under its component of the first round, and that under one of the second.
    roots = joined.join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = again.join(joined, "node", "left_anti").select("node", "root")
    roots = stored(roots.union(alone), "roots")
    tops = stored(classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n", "n_class", F.coalesce("root", "rep").alias("root")), "tops")
    out = profiles.drop("prefix").join(tops, ["set_a", "set_b", "n"], "left")
    return out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull() | F.col("root").isNull(), F.col("key")).otherwise(F.col("root")).alias("component_id"),
        F.coalesce("n_class", F.lit(1)).alias("n_class"),
    )


def _index(one: DataFrame, rules: Rules) -> DataFrame:
    """Entries of all tokens that more than one set has in front: token, block, set, its size, and the token's position."""
    step = math.log(100 / rules.percent) * (1 + 1e-9)
    block = F.floor(F.log(F.col("n").cast("double")) / step).alias("block")
    entries = one.select(F.posexplode("prefix").alias("pos", "token"), "rep", "n", block).withColumn("pos", F.col("pos").cast("long"))
    # Two sets alone in a list are worth a look only if their sizes are near.
    counts = entries.groupBy("token").agg(F.count("*").alias("c"), F.min("block").alias("low"), F.max("block").alias("high"))
    shared = counts.where("c > 2 or (c = 2 and high - low <= 1)").select("token")
    entries = entries.join(shared, "token")
    return stored(entries.select("token", "block", "rep", "n", "pos"), "index")


def _leaders(docs: DataFrame, profiles: DataFrame, index: DataFrame, rules: Rules) -> DataFrame:
    """Overlaps of sets with the leaders of their blocks, the sets with the fewest rarer tokens: a, b, shared, linked."""
    turn = F.shiftleft("pos", 40) + F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))
    leads = index.groupBy("token", "block").agg(*(F.min_by(c, turn).alias(n) for c, n in (("rep", "lead"), ("n", "m"), ("pos", "place"))))
    leads = stored(leads, "leaders")
    pairs = index.join(leads, ["token", "block"]).where(F.col("rep") != F.col("lead")).where(_within(rules, "n", "pos", "m", "place"))
    pairs = pairs.select(F.col("rep").alias("a"), F.col("lead").alias("b"), "n", "m").dropDuplicates(["a", "b"])
    pairs = stored(_promising(pairs, profiles, rules), "leader-pairs")
    found = _overlaps(docs, pairs.select("a", "b"), rules).join(pairs, ["a", "b"])
    return stored(found.select("a", "b", "shared", _linked(rules, "n", "m").alias("linked")), "leader-overlaps")


def _open_pairs(docs: DataFrame, profiles: DataFrame, index: DataFrame, first: DataFrame, joined: DataFrame, rules: Rules) -> DataFrame:
    """Links between sets that the leaders' answers leave in different components: a, b, as components."""
    turn = F.shiftleft("pos", 40) + F.xxhash64("rep").bitwiseAND(F.lit((1 << 40) - 1))
    comps = sent_if_small(joined, rules.max_sent_rows).withColumnsRenamed({"node": "rep", "root": "comp"})
    entries = index.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    entries = stored(entries, "entries")
    leads = stored(entries.groupBy("token", "block").agg(F.min_by("rep", turn).alias("lead"), F.min_by("comp", turn).alias("lead_comp")), "block-leaders")
    with_lead = entries.join(leads, ["token", "block"])
    # The larger set of a pair is found in its own block, the smaller one is taken there and to the next block.
    larger = with_lead.select("token", "block", F.col("rep").alias("y"), F.col("n").alias("m"), F.col("pos").alias("place"), F.col("comp").alias("y_comp"), "lead_comp")
    front = F.col("n") - F.col("pos") >= rules.needed(F.col("n"), F.col("n"))
    smaller = entries.where(front).select("token", F.explode(F.array("block", F.col("block") + 1)).alias("block"), F.col("rep").alias("x"), "n", "pos", F.col("comp").alias("x_comp"))
    smaller = smaller.join(leads.select("token", "block", F.col("lead_comp").alias("there")), ["token", "block"])
    once = (F.col("x_comp") != F.col("y_comp")) & ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("x") < F.col("y")))) & _within(rules, "n", "pos", "m", "place")
    outside = larger.where(F.col("y_comp") != F.col("lead_comp")).drop("lead_comp")
    inside = larger.where(F.col("y_comp") == F.col("lead_comp")).drop("lead_comp")
    pairs = smaller.join(outside, ["token", "block"]).where(once).union(smaller.where(F.col("x_comp") != F.col("there")).join(inside, ["token", "block"]).where(once))
    pairs = pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), "n", "m", "x_comp", "y_comp").dropDuplicates(["a", "b"])
    pairs = stored(_promising(_bounded(pairs, first, rules), profiles, rules), "open-pairs")
    found = _overlaps(docs, pairs.select("a", "b"), rules).join(pairs, ["a", "b"]).where(_linked(rules, "n", "m"))
    return found.select(F.col("x_comp").alias("a"), F.col("y_comp").alias("b")).distinct()


def _bounded(pairs: DataFrame, first: DataFrame, rules: Rules) -> DataFrame:
    """Pairs without those that were compared before, or that a common leader's overlaps rule out."""
    known = first.select("a", "b").union(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = pairs.join(known, ["a", "b"], "left_anti")
    # The smallest known leader of each set; the bound holds for any leader both have.
    by_lead = first.groupBy("a").agg(F.min(F.struct("b", "shared")).alias("lead"))
    left = by_lead.select("a", F.col("lead.b").alias("a_lead"), F.col("lead.shared").alias("a_shared"))
    right = by_lead.select(F.col("a").alias("b"), F.col("lead.b").alias("b_lead"), F.col("lead.shared").alias("b_shared"))
    pairs = pairs.join(left, "a", "left").join(right, "b", "left")
    most = F.least("a_shared", "b_shared") + F.least(F.col("n") - F.col("a_shared"), F.col("m") - F.col("b_shared"))
    ruled_out = (F.col("a_lead") == F.col("b_lead")) & (most < rules.needed(F.col("n"), F.col("m")))
    return pairs.where(~F.coalesce(ruled_out, F.lit(False))).select("a", "b", "n", "m", "x_comp", "y_comp")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of `docs` whose key is the smallest of its component; all columns unchanged.

    Rows with one key stay or go together, rows with a null key stay.
    """
    rules = rules or Rules()
    gone = link(docs, key, text, rules).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct()
    gone = stored(gone, "near-copies")
    names = [str(i) for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    left = plain.join(sent_if_small(gone, rules.max_sent_rows), F.col(names[docs.columns.index(key)]) == F.col("gone"), "left_anti")
    return left.toDF(*docs.columns)
