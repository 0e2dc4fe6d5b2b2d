"""Personal data by exact patterns and a skip-chain conditional random field.

The patterns find what is certain. The field decides about other words with a
digit or an "@": its nodes are such words of one document, its edges join
neighbours, repeats of a word and words of the same shape. Repeats are linked to
the first occurrence that a pattern labels, not to each other in a chain, so
that a label reaches every place of a document in one step. Words that a pattern
covers are held at their label; loopy message passing carries their labels
along the edges. Weights are fitted once, on a bounded sample of
documents with the patterns' labels, and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm import words as W
from glyphflow.llm.frames import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # the last label is "nothing"
NOTHING = len(KINDS)
EDGES = ("neighbour", "repeat", "shape")
# Documents the field is fitted on at most.
TRAIN_DOCS = 4_000
ROUNDS = 8
# A span is added if one of its words has this marginal probability, and all of them the lower one.
SURE = 0.95
LIKELY = 0.8

Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+$")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?[0-9@][^\x20\x09-\x0D]*+")
_TRIGGER = re.compile(r"[0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; a match must hold an "@", so the search goes from one "@" to the next."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            free = found.end()
            yield start, free
            at = text.find("@", free)
        else:
            # The run before a later "@" cannot reach over this one.
            free = at + 1
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by start, then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _TRIGGER.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


@dataclass
class Graph:
    """Nodes of many documents: document, span, features and label; edges with their kind."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    label: np.ndarray  # -1 where no pattern decides
    left: np.ndarray
    right: np.ndarray
    kind: np.ndarray


FEATURES = 30


def _features(word: str, before: str) -> list[int]:
    """Numbers of the features that hold for a word."""
    digits = sum("0" <= c <= "9" for c in word)
    letters = sum(c.isalpha() for c in word)
    only = "".join(c for c in word if "0" <= c <= "9")
    parts = word.split(".")
    out = [0, 1 + min(digits, 19) // 2]  # 1 to 10
    out.append(11 + min(word.count("."), 4))  # 11 to 15
    out += [16] * ("@" in word) + [17] * (letters > 0) + [18] * (letters > digits) + [19] * word.startswith("+") + [20] * word.startswith("(")
    out += [21] * ("-" in word) + [22] * (12 <= digits <= 19 and luhn(only)) + [23] * (len(parts) == 4 and all(p.isdigit() and len(p) < 4 for p in parts))
    out += [24] * bool(re.search(r"@[^@.]+\.[^@.]", word)) + [25] * (before[:1] == "+") + [26] * (before[:1] == "(") + [27] * bool(_TRIGGER.search(before))
    out += [28] * ("=" in word or "/" in word) + [29] * (letters == 0 and digits == len(word))
    return out


def _shape(word: str) -> str:
    return re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "9", word))


def _links(nodes: list[tuple[int, str, str, int]], label: list[int]) -> Iterator[tuple[int, int, int]]:
    """Edges between a document's nodes (number, word, shape, near node before) of one word or shape.

    A word leads to the first node of its form with each label, or else of its
    shape; where no pattern labels either, to the first node of all.
    """
    first: dict[tuple[int, str], int] = {}
    sure: dict[tuple[int, str], dict[int, int]] = {}
    near = {node: before for node, _, _, before in nodes}
    for node, *names, _ in nodes:
        for name in enumerate(names, 1):
            first.setdefault(name, node)
            if label[node] >= 0:
                sure.setdefault(name, {}).setdefault(label[node], node)
    for node, word, shape, _ in nodes:
        repeats, alike = sure.get((1, word), {}), sure.get((2, shape), {})
        if repeats.get(label[node]) == node:
            # Labelled nodes carry nothing to each other, but the weights are fitted on them.
            forms, shapes = [to for to in repeats.values() if to < node], [to for to in alike.values() if to < node]
        elif repeats:
            forms, shapes = list(repeats.values()), []
        else:
            forms, shapes = [first[1, word]], list(alike.values())
            if not alike and forms == [node]:
                shapes = [first[2, shape]]
        yield from ((to, node, 1) for to in forms if to != node)
        yield from ((to, node, 2) for to in shapes if to not in (node, near[node]) and near[to] != node)


def graph(texts: list[str], spans: list[list[Span]]) -> Graph:
    """The field's graph over the candidate words of some documents."""
    doc, start, end, features, label, edges = [], [], [], [], [], []
    for d, (text, found) in enumerate(zip(texts, spans, strict=True)):
        if not text or not _TRIGGER.search(text):
            continue
        nodes: list[tuple[int, str, str, int]] = []
        by_start = sorted(found)
        reach, k = [], 0
        previous_end = previous = -1
        for m in _CANDIDATE.finditer(text):
            a, b = m.span()
            word = m.group().rstrip(".,;:!?\"')]}").lstrip("\"'[{") or m.group()
            a += m.group().index(word)
            b = a + len(word)
            while k < len(by_start) and by_start[k][0] < b:
                reach.append(by_start[k])
                k += 1
            reach = [s for s in reach if s[2] > a]
            own = max(reach, key=lambda s: (min(b, s[2]) - max(a, s[0]), -s[1]), default=None)
            node = len(doc)
            near = previous >= 0 and a - previous_end <= 3
            before = text[start[previous]:end[previous]] if near else ""
            doc.append(d)
            start.append(a)
            end.append(b)
            features.append(_features(word, before))
            label.append(own[1] if own else -1)
            if near:
                edges.append((previous, node, 0))
            nodes.append((node, word, _shape(word), previous if near else -1))
            previous, previous_end = node, m.end()
        edges += _links(nodes, label)
    x = np.zeros((len(doc), FEATURES), np.float64)
    for i, on in enumerate(features):
        x[i, on] = 1
    e = np.array(edges, np.int64).reshape(-1, 3)
    as_int = lambda v: np.array(v, np.int64)
    return Graph(as_int(doc), as_int(start), as_int(end), x, as_int(label), e[:, 0], e[:, 1], e[:, 2])


@dataclass
class Field:
    """Weights of the field: label by feature, and a label table for each kind of edge."""

    node: np.ndarray
    edge: np.ndarray


def fit(g: Graph, steps: int = 300) -> Field:
    """Weights from labelled nodes: multinomial regression for nodes, smoothed association for edges.

    A node that no pattern labels counts as "nothing". Without nodes all weights
    say "nothing".
    """
    node = np.zeros((FEATURES, LABELS))
    edge = np.zeros((len(EDGES), LABELS, LABELS))
    if not len(g.doc):
        node[0, NOTHING] = 10
        return Field(node, edge)
    y = np.where(g.label < 0, NOTHING, g.label)
    target = np.eye(LABELS)[y]
    for _ in range(steps):
        p = _softmax(g.features @ node)
        node -= 2.0 * (g.features.T @ (p - target) / len(y) + 1e-4 * node)
    share = (target.sum(0) + 1) / (len(y) + LABELS)
    for kind in range(len(EDGES)):
        on = g.kind == kind
        both = np.ones((LABELS, LABELS)) * 0.1 + np.eye(LABELS)
        np.add.at(both, (y[g.left[on]], y[g.right[on]]), 1)
        both = both + both.T if kind else both
        edge[kind] = np.clip(np.log(both / both.sum() / np.outer(share, share)), -3, 3)
    return Field(node, edge)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def marginals(g: Graph, field: Field, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of each node by damped loopy sum-product; labelled nodes are held."""
    score = g.features @ field.node
    held = g.label >= 0
    score[held] = -30
    score[held, g.label[held]] = 0
    if not len(g.left):
        return _softmax(score)
    # Each edge once in each direction.
    source, target = np.concatenate((g.left, g.right)), np.concatenate((g.right, g.left))
    table = np.concatenate((field.edge[g.kind], field.edge[g.kind].transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(g.left)) + len(g.left), np.arange(len(g.left))))
    message = np.zeros((len(source), LABELS))
    # However many repeats lead to a held node, it hears none of them.
    free = ~held[target, None]
    for _ in range(rounds):
        belief = score.copy()
        np.add.at(belief, target, message)
        out = (belief[source] - message[back])[:, :, None] + table
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        message = np.where(free, 0.5 * message + 0.5 * new, 0)
    np.add.at(score, target, message)
    return _softmax(score)


def all_spans(texts: list[str], field: Field, sure: float = SURE) -> tuple[list[list[Span]], list[list[Span]]]:
    """Spans by the patterns, and these with the field's own, of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    # Without a certain span there is no label to carry, and the weights alone never suffice.
    g = graph(texts, base)
    full = [list(b) for b in base]
    if len(g.doc):
        p = marginals(g, field)
        best = p[:, :NOTHING].argmax(1)
        own = p[np.arange(len(p)), best]
        groups: list[list[int]] = []
        for i in np.flatnonzero((g.label < 0) & (own >= LIKELY)):
            last = groups[-1][-1] if groups else -1
            # Neighbouring words of one kind are one span: "+1 (555) 123-4567".
            if last >= 0 and g.doc[last] == g.doc[i] and best[last] == best[i] and g.start[i] - g.end[last] <= 2:
                groups[-1].append(i)
            else:
                groups.append([i])
        for group in groups:
            if own[group].max() >= sure:
                full[g.doc[group[0]]].append((int(g.start[group[0]]), int(best[group[0]]), int(g.end[group[-1]])))
        for spans in full:
            spans.sort()
    return base, full


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = TRAIN_DOCS) -> Field:
    """Fit the field on `sample` documents at most, those with the smallest key hashes."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(key).alias("0")).distinct().orderBy(F.xxhash64("0"), "0").limit(sample)
    rows = docs.select(F.col(key).alias("0"), F.col(text).alias("1")).join(F.broadcast(picked), "0", "left_semi")
    schema = "doc long, start long, end long, features binary, label long, edges binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, "1"):
            texts = [t or "" for t in part.column(1).to_pylist()]
            g = graph(texts, [base_spans(t) for t in texts])
            edges = np.stack((g.left, g.right, g.kind), 1)
            yield pa.RecordBatch.from_pydict({
                "doc": pa.array([len(g.doc)]), "start": pa.array([0]), "end": pa.array([0]),
                "features": pa.array([g.features.astype(np.int8).tobytes()], pa.binary()), "label": pa.array([0]),
                "edges": pa.array([np.concatenate((g.label, edges.ravel())).tobytes()], pa.binary()),
            })

    features, labels, edges, base = [], [], [], 0
    for row in rows.mapInArrow(run, schema).collect():  # bounded by `sample`
        numbers = np.frombuffer(row["edges"], np.int64)
        features.append(np.frombuffer(row["features"], np.int8).reshape(-1, FEATURES).astype(np.float64))
        labels.append(numbers[:row["doc"]])
        edge = numbers[row["doc"]:].reshape(-1, 3).copy()
        edge[:, :2] += base
        edges.append(edge)
        base += row["doc"]
    x = np.concatenate([np.zeros((0, FEATURES)), *features])
    y = np.concatenate([np.zeros(0, np.int64), *labels])
    e = np.concatenate([np.zeros((0, 3), np.int64), *edges])
    # A fixed order, whatever order the tasks ended in.
    zero = np.zeros(len(y), np.int64)
    return fit(Graph(zero, zero, zero, x, y, e[:, 0], e[:, 1], e[:, 2]))


def find(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text", sure: float = SURE) -> DataFrame:
    """Key, counts by kind, `base_sha256`, `spans` (all, as kind:start:end in code points) and `n_added`.

    One row for each input row. A null or empty text has no spans; a text is
    read whole; equal texts get equal spans; other columns do not matter;
    nothing is shuffled. Counts and `base_sha256` are of the patterns only.
    """
    small_batches(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    schema = T.StructType([
        docs.schema[key], *(T.StructField(n, T.LongType()) for n in counts), T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, text):
            texts = [t or "" for t in part.column(1).to_pylist()]
            base, full = all_spans(texts, field, sure)
            columns = [part.column(0)]
            for k in range(len(KINDS)):
                columns.append(pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()))
            columns.append(pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base]))
            columns.append(pa.array([_listed(f) for f in full], pa.string()))
            columns.append(pa.array([len(f) - len(b) for b, f in zip(base, full, strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return docs.select(key, text).mapInArrow(run, schema)
