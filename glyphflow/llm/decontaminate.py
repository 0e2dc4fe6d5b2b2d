"""Benchmark items inside documents, also with other numbers, names or units.

Words become a template: numbers, names and units turn into typed
placeholders, everything else is lower-cased and stripped of punctuation.
Windows of the template are looked up among those of the benchmark, and so are
windows of the words themselves, so that verbatim copies are found however few
literal words an item has. A capitalised word that opens a sentence is read
both as a literal and as a name. What follows one diagonal of a document and an
item, or neighbouring diagonals when words were put in or left out, is one
passage. A passage counts when it is long enough and its slots are consistent:
each name, unit and number of the item stands for one of the document
throughout. Two quantities can be equal by chance, so one number may part once;
and a run of enough unchanged literal words counts whatever is around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphflow.llm import words as W
from glyphflow.llm.frames import small_batches

# Fixed value: words that measure when they follow a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g mg kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year "
    "years cent cents dollar dollars euro euros percent degree degrees kmh mph "
    "gramm kilogramm sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "mètre mètres gramme grammes kilogramme kilogrammes heure heures seconde secondes jour jours semaine semaines mois an ans année années degré degrés "
    "metro metros kilómetro kilómetros gramo gramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años grado grados"
)


@dataclass(frozen=True)
class Rules:
    """Window size in words, its least literal words, and when a passage counts.

    Windows with fewer literal words, and items of fewer than `min_item_words`, match verbatim only.
    """

    window: int = 8
    min_literals: int = 4
    min_run: int = 13
    min_share: float = 0.6
    min_item_words: int = 5
    # Equal numbers of an item may be two quantities that are equal by chance: so often they can become two values.
    max_partings: int = 1
    # Words put in or left out between two diagonals of one passage at most.
    max_shift: int = 8
    # Words of benchmark items that a task holds at once; a larger benchmark takes more passes.
    block_words: int = 2_000_000


_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_PUNCTUATION = ~(_LETTER | _DIGIT)
_UPPER = np.zeros(256, bool)
_UPPER[ord("A"):ord("Z") + 1] = True
# Capitals of two bytes, by both of them.
_WIDE_UPPER = np.zeros((256, 256), bool)
for _c in filter(str.isupper, map(chr, range(0x80, 0x800))):
    _WIDE_UPPER[tuple(_c.encode())] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
_NUMBER, _NAME, _UNIT = W.odd_constants(3, 77)


def _unit_hashes() -> np.ndarray:
    words, _ = W.cut(pa.array([UNITS]), lower=True)
    return np.sort(W.word_hashes(words))


_UNIT_HASHES = _unit_hashes()


@dataclass
class Template:
    """Words of a slice as template: codes of each word, its slot value (0 for a literal), its own hash, and its row.

    `named` is `code` with the capitalised words that open sentences as names; `opens` marks these.
    """

    words: W.Words
    code: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    named: np.ndarray
    opens: np.ndarray


def template(column: pa.Array) -> Template:
    """Template of every row of a text column; nulls have no words."""
    words, raw = W.cut(column, lower=True)
    start, end = words.start.copy(), words.end.copy()
    # Trim punctuation on both sides; a word of nothing else stays whole.
    at = np.concatenate(([0], np.cumsum(~_PUNCTUATION[words.buffer])))
    solid = at[end] > at[start]
    place = np.flatnonzero(~_PUNCTUATION[words.buffer])
    start[solid] = place[at[words.start[solid]]]
    end[solid] = place[at[words.end[solid]] - 1] + 1
    value = W.span_hashes(words.buffer, start, end)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
    letters = np.concatenate(([0], np.cumsum(_LETTER[raw])))
    n_letters = letters[end] - letters[start]
    n = len(start)
    if not n:
        return Template(words, value, value, value, value, np.zeros(0, bool))
    number = _DIGIT[raw[start]] & (n_letters <= 3)
    first = np.ones(n, bool)
    first[1:] = words.row[1:] != words.row[:-1]
    before = np.zeros(n, bool)
    before[1:] = number[:-1] & ~first[1:]
    unit = before & (np.searchsorted(_UNIT_HASHES, value) < len(_UNIT_HASHES))
    unit[unit] = _UNIT_HASHES[np.searchsorted(_UNIT_HASHES, value[unit])] == value[unit]
    # A name has a capital and then small letters; where it opens a sentence, it can be a literal as well.
    opens = first.copy()
    opens[1:] |= _STOP[raw[words.end[:-1] - 1]] | (raw[np.maximum(words.start[1:] - 1, 0)] == 0x0A)
    byte = lambda k: raw[np.minimum(start + k, len(raw) - 1)]
    wide = _WIDE_UPPER[raw[start], byte(1)]
    second, third = np.where(wide, byte(2), byte(1)), np.where(wide, byte(3), byte(2))
    longer = end - start > 1 + wide
    name = (_UPPER[raw[start]] | wide) & longer & ~_UPPER[second] & ~_WIDE_UPPER[second, third] & _LETTER[second]
    name, opens = name & ~opens, name & opens & ~number & ~unit
    code, slot = value.copy(), np.zeros(n, np.uint64)
    for on, mark in ((name, _NAME), (unit, _UNIT), (number, _NUMBER)):
        code[on] = mark
        slot[on] = value[on]
    named = code.copy()
    named[opens] = _NAME
    return Template(words, code, slot, value, named, opens)


@dataclass
class Kind:
    """Windows of one reading: each item word's hash as a window's first word (0: none), and the windows by hash, then by the one before."""

    sequence: np.ndarray
    hashes: np.ndarray
    before: np.ndarray
    word: np.ndarray


@dataclass
class Index:
    """Windows of a block of items in three readings; and the items' words behind each other."""

    window: int
    kinds: list[Kind]
    keys: list
    item: np.ndarray
    begin: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    name: np.ndarray
    unit: np.ndarray


def _windows(t: Template, size: int, rules: Rules) -> list[np.ndarray]:
    """For each word the hash of the window it starts, 0 if it starts none: as they are, as template, and with openings as names.

    The templates are those with enough literals.
    """
    n = len(t.value)
    whole = W.whole_windows(t.words, size)

    def laid(hashes: np.ndarray, on: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[:len(on)][on] = hashes[on] | np.uint64(1)
        return out

    out = [laid(W.window_hashes(t.value, size), whole)]
    if size >= rules.min_item_words:
        held = lambda on: (total := np.concatenate(([0], np.cumsum(on))))[size:size + len(whole)] - total[:len(whole)]
        literals, opens = held(t.slot == 0), held(t.opens)
        least = min(rules.min_literals, size)
        out.append(laid(W.window_hashes(t.code, size), whole & (literals >= least)))
        out.append(laid(W.window_hashes(t.named, size), whole & (opens > 0) & (literals - opens >= least)))
    return out


def _before(hashes: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The window one word earlier in the same row, 0 if there is none."""
    same = (at > 0) & (row[at - 1] == row[at])
    return np.where(same, hashes[at - 1], np.uint64(0))


def build(keys: list, texts: list[str | None], rules: Rules) -> list[Index]:
    """The indexes of some items: one for the usual window, one for each length of shorter items."""
    t = template(pa.array(texts, pa.string()))
    begin = t.words.first_of_row()
    lengths = np.minimum(np.diff(begin), rules.window)
    out = []
    for size in sorted({int(n) for n in lengths if n}):
        kinds = []
        for hashes in _windows(t, size, rules):
            at = np.flatnonzero((hashes > 0) & (lengths[t.words.row] == size))
            before = _before(hashes, at, t.words.row)
            order = np.lexsort((before, hashes[at]))
            kinds.append(Kind(hashes, hashes[at][order], before[order], at[order]))
        out.append(Index(size, kinds, keys, t.words.row, begin, t.slot, t.value, t.named == _NAME, t.code == _UNIT))
    return out


def _runs(index: Index, kind: Kind, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of the document, of the item, and number of windows of every longest row of equal windows.

    Only where a row starts are pairs made: an equal window whose one before
    is equal too lies inside of another row. A repetitive text thus costs as
    many pairs as it has diagonals.
    """
    at = np.flatnonzero(hashes)
    low = np.searchsorted(kind.hashes, hashes[at], "left")
    high = np.searchsorted(kind.hashes, hashes[at], "right")
    hit = np.flatnonzero(high > low)
    at, low, high = at[hit], low[hit], high[hit]
    before = _before(hashes, at, row)
    inner_low, inner_high = low.copy(), low.copy()
    cases, case = np.unique(np.stack((low.astype(np.uint64), high.astype(np.uint64), before)), axis=1, return_inverse=True)
    for k, (a, b, h) in enumerate(cases.T.tolist()):
        if h:
            found = np.searchsorted(kind.before[a:b], [np.uint64(h)], "left")[0], np.searchsorted(kind.before[a:b], [np.uint64(h)], "right")[0]
            inner_low[case == k], inner_high[case == k] = a + found[0], a + found[1]
    words, entries = [], []
    for a, b in ((low, np.where(inner_high > inner_low, inner_low, high)), (np.where(inner_high > inner_low, inner_high, high), high)):
        n = b - a
        words.append(np.repeat(at, n))
        entries.append(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n))
    word, own = np.concatenate(words), kind.word[np.concatenate(entries)]
    count = np.ones(len(word), np.int64)
    active = np.arange(len(word))
    step = 0
    while len(active):
        step += 1
        w, g = word[active] + step, own[active] + step
        fits = (w < len(row)) & (g < len(index.item))
        active, w, g = active[fits], w[fits], g[fits]
        on = (hashes[w] == kind.sequence[g]) & (hashes[w] > 0) & (row[w] == row[word[active]]) & (index.item[g] == index.item[own[active]])
        active = active[on]
        count[active] += 1
    return word, own, count


def passages(column: pa.Array, indexes: list[Index], rules: Rules) -> list[tuple[int, object, int, int, int, int]]:
    """Row, item key, matched words, item words, slots and changed slots of every passage that counts; one for each row and item."""
    t = template(column)
    begin = t.words.first_of_row()
    found: dict[tuple[int, int], tuple] = {}
    for index in indexes:
        rows = [_runs(index, kind, hashes, t.words.row) for kind, hashes in zip(index.kinds, _windows(t, index.window, rules), strict=False)]
        word, own, count = (np.concatenate(x) for x in zip(*rows, strict=True))
        if not len(word):
            continue
        row, item = t.words.row[word], index.item[own]
        place = own - index.begin[item]
        diagonal = word - begin[row] - place
        # Diagonals of one row and item that lie close are judged as one.
        order = np.lexsort((place, diagonal, item, row))
        row, item, place, diagonal, word, count = row[order], item[order], place[order], diagonal[order], word[order], count[order]
        near = (row[1:] == row[:-1]) & (item[1:] == item[:-1]) & (diagonal[1:] - diagonal[:-1] <= rules.max_shift)
        cuts = np.concatenate(([0], np.flatnonzero(~near) + 1, [len(row)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            r, i = int(row[a]), int(item[a])
            judged = _judge(index, t, i, *_aligned(place[a:b], word[a:b], count[a:b] + index.window - 1), rules)
            if judged and judged[0] > found.get((r, i), (0,))[0]:
                found[r, i] = judged
    return [(r, indexes[0].keys[i], *judged) for (r, i), judged in sorted(found.items())]


def _aligned(place: np.ndarray, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the item and words of the document that rows of `size` words on neighbouring diagonals pair, both ascending."""
    shift = word - place
    order = np.argsort(shift, kind="stable")
    place, size, shift = place[order], size[order], shift[order]
    first = np.flatnonzero(np.append(True, shift[1:] != shift[:-1]))
    edge = np.append(first, len(shift))
    # Words of each diagonal: rows of different readings can overlap.
    covered = [np.unique(np.concatenate([np.arange(p, p + n) for p, n in zip(place[a:b].tolist(), size[a:b].tolist(), strict=True)])) if b - a > 1 else np.arange(place[a], place[a] + size[a])
               for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    # Once every place that any diagonal reaches is taken, no other one adds anything.
    reach = int(max(c[-1] for c in covered) - min(c[0] for c in covered)) + 1
    # The longest diagonal first; another one adds what lies before and after the pairs taken, in the same order on both sides.
    places, words = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for k in np.lexsort((shift[first], [-len(c) for c in covered])):
        p = covered[k]
        w = p + shift[first[k]]
        at, by = np.searchsorted(places, p), np.searchsorted(words, w)
        fits = (at == by) & ~np.isin(p, places) & ~np.isin(w, words)
        places, words = np.sort(np.concatenate((places, p[fits]))), np.sort(np.concatenate((words, w[fits])))
        if len(places) >= reach:
            break
    return places, words


def _longest(joined: np.ndarray) -> int:
    """Number of items in the longest row of items, given whether each is joined to the one before."""
    cuts = np.concatenate(([0], np.flatnonzero(~joined) + 1, [len(joined) + 1]))
    return int(np.diff(cuts).max())


def _judge(index: Index, t: Template, item: int, covered: np.ndarray, own: np.ndarray, rules: Rules) -> tuple[int, int, int, int] | None:
    """Matched words, item words, slots and changed slots of paired words, if they count."""
    if not len(covered):
        return None
    words = int(index.begin[item + 1] - index.begin[item])
    dp, dw = np.diff(covered), np.diff(own)
    # A run goes on where words were put in or left out between two diagonals.
    run = _longest((dp == 1) & (dw == 1) | (dp != dw) & (np.maximum(dp, dw) <= rules.max_shift + 1))
    if run < min(rules.min_run, words) and len(covered) < rules.min_share * words:
        return None
    at = index.begin[item] + covered
    theirs, ours = index.value[at], t.value[own]
    changed = theirs != ours
    slots = (index.slot[at] != 0) | changed
    # Names: placeholders on both sides in the reading that takes openings as names, and not both the same opening word.
    names = index.name[at] & (t.named[own] == _NAME)
    units = index.unit[at] & (t.code[own] == _UNIT)
    numbers = (index.slot[at] != 0) & (t.code[own] == _NUMBER)
    if _partings(theirs[names], ours[names]) or _partings(theirs[units], ours[units]) or _partings(theirs[numbers], ours[numbers]) > rules.max_partings:
        # One value of the item would stand for two of the document. A changed opening word may be no name: then it is no match.
        opening = changed & ((index.slot[at] == 0) | (t.slot[own] == 0))
        if opening.any():
            return _judge(index, t, item, covered[~opening], own[~opening], rules)
        # Only what is there verbatim counts.
        literal = (index.slot[at] == 0) & ~changed
        same = ~changed[1:] & ~changed[:-1] & (dp == 1) & (dw == 1)
        starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
        if np.add.reduceat(literal.astype(np.int64), starts).max() < rules.min_run:
            return None
    return len(covered), words, int(slots.sum()), int(changed.sum())


def _partings(theirs: np.ndarray, ours: np.ndarray) -> int:
    """How many values of the document there are beyond one for each value of the item."""
    pairs = set(zip(theirs.tolist(), ours.tolist(), strict=True))
    return len(pairs) - len({a for a, _ in pairs})


def index_blocks(bench: DataFrame, key: str, text: str, rules: Rules) -> Iterator[list[Index]]:
    """Indexes of the benchmark, a bounded block of items at a time."""
    total = bench.select(F.sum(F.length(text)).alias("n")).first()["n"] or 0
    blocks = 1 + int(total) // (rules.block_words * 6)
    dealt = bench.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    for block in range(blocks):
        rows = dealt.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).orderBy("key", "text").collect()
        yield build([r["key"] for r in rows], [r["text"] for r in rows], rules)


def leaks(
    docs: DataFrame, bench: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text",
    rules: Rules | None = None,
) -> DataFrame:
    """One row for each document row and item it holds: both keys, `matched_words`, `item_words`, `n_slots`, `changed_slots`.

    Documents without a leak have no row. Null or empty texts match
    nothing, items below `min_item_words` match verbatim only; repeated rows are judged each by itself, the
    longest passage of an item counts; other columns do not matter. The
    benchmark's windows are sent to the tasks in blocks of bounded size, and
    nothing is shuffled.
    """
    rules = rules or Rules()
    small_batches(docs.sparkSession)
    schema = T.StructType([
        T.StructField("doc", docs.schema[doc_key].dataType), T.StructField("item", bench.schema[item_key].dataType),
        *(T.StructField(n, T.LongType()) for n in ("matched_words", "item_words", "n_slots", "changed_slots")),
    ])
    out = None
    for indexes in index_blocks(bench, item_key, item_text, rules):
        one = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("text")).mapInArrow(_finder(indexes, rules, bench.select(item_key).schema[0].dataType), schema)
        out = one if out is None else out.unionByName(one)
    return out.withColumnsRenamed({"doc": doc_key, "item": item_key if item_key != doc_key else f"item_{item_key}"})


def _finder(indexes: list[Index], rules: Rules, item_type: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not indexes:
            return
        for part in W.slices(batches, "text"):
            rows = passages(part.column(1), indexes, rules)
            if rows:
                columns = list(zip(*rows, strict=True))
                docs = part.column(0).take(pa.array(columns[0], pa.int64()))
                items = pa.array(columns[1])
                yield pa.RecordBatch.from_arrays(
                    [docs, items, *(pa.array(c, pa.int64()) for c in columns[2:])],
                    ["doc", "item", "matched_words", "item_words", "n_slots", "changed_slots"],
                )

    return run


def without_leaks(docs: DataFrame, bench: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, all columns unchanged."""
    rules = rules or Rules()
    small_batches(docs.sparkSession)
    names = [str(i) for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    out = docs.toDF(*names)
    for indexes in index_blocks(bench, item_key, item_text, rules):
        if indexes:
            out = out.mapInArrow(_keeper(indexes, rules, at), out.schema)
    return out.toDF(*docs.columns)


def _keeper(indexes: list[Index], rules: Rules, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, str(at)):
            clean = np.ones(part.num_rows, bool)
            clean[[r for r, *_ in passages(part.column(at), indexes, rules)]] = False
            yield part.filter(pa.array(clean))

    return run
