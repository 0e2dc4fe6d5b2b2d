"""Conversations as marked-up text with a loss mask, and back.

Rows are dealt by conversation and sorted by turn; a task then renders and
reads conversations turn by turn, so that one of any length needs little
memory. Control strings in a text are broken by a backslash after their first
character and backslashes are doubled, which undoes without loss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphflow.llm.frames import small_batches
from glyphflow.llm.template import compile_template

# The markers of the template below.
BEGIN, ROLE_OPEN, ROLE_CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, ROLE_OPEN, ROLE_CLOSE, END)
TEMPLATE = (
    "{% for m in messages %}<s>[INST]{{ m.role|escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "</s>{% if not loop.last %}{{ '\\n' }}{% endif %}{% endfor %}"
)
# Characters of output in a row: longer conversations come in several rows.
PART_CHARS = 1 << 20


def escaper(controls: tuple[str, ...]) -> Callable[[str], str]:
    """Breaks every control string in a text, and what could become one with the characters after the text."""
    breaks = re.compile("|".join(
        re.escape(c[0]) + "(?=" + "|".join([re.escape(c[1:]), *(re.escape(c[1:k]) + r"\Z" for k in range(1, len(c)))]) + ")" for c in controls
    ))

    def escape(text: str) -> str:
        if "\\" in text:
            text = text.replace("\\", "\\\\")
        return breaks.sub(lambda m: m[0] + "\\", text)

    return escape


def unescape(text: str) -> str:
    """The text before `escape`."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    for batch in batches:
        keys, roles, texts = (batch.column(i).to_pylist() for i in range(3))
        for key, role, text in zip(keys, roles, texts, strict=True):
            yield key, {"role": role or "", "text": text or ""}


def _conversations(turns: Iterator[tuple[object, dict]]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Key and messages of each conversation, from sorted rows, one message at a time."""
    ahead = next(turns, None)
    while ahead is not None:
        key = ahead[0]

        def messages() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                message = ahead[1]
                ahead = next(turns, None)
                yield message

        yield key, messages()


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, part_chars: int = PART_CHARS,
) -> DataFrame:
    """The conversation key, `part`, `formatted` and `loss` (spans in code points of the part, end exclusive).

    One row for each conversation, more only when it is longer than
    `part_chars`: parts are then joined in order. Rows are ordered by turn, then
    role and text; repeated rows are turns of their own. A null role or text is
    empty, a null key is a conversation of its own, other columns do not matter.
    """
    small_batches(turns.sparkSession)
    key = turns.schema[conv]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([key, T.StructField("part", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escaper(controls), "trim": str.strip})
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], key_kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], kind)], names,
            )

        first = next(batches, None)
        if first is None:
            return
        key_kind = first.column(0).type
        everything = (b for group in ((first,), batches) for b in group)
        for name, messages in _conversations(_turns(everything)):
            part, texts, loss, at = 0, [], [], 0
            for piece, learn in render(messages):
                if at and at + len(piece) > part_chars:
                    rows.append((name, part, "".join(texts), loss))
                    yield flush()
                    rows, size = [], 0
                    part, texts, loss, at = part + 1, [], [], 0
                if learn:
                    if loss and loss[-1]["end"] == at and loss[-1]["end"] > loss[-1]["start"]:
                        loss[-1]["end"] = at + len(piece)
                    else:
                        loss.append({"start": at, "end": at + len(piece)})
                texts.append(piece)
                at += len(piece)
            rows.append((name, part, "".join(texts), loss))
            size += at
            if size > part_chars:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    dealt = turns.select(conv, role, text, turn).toDF("0", "1", "2", "3").repartition("0").sortWithinPartitions("0", "3", "1", "2")
    return dealt.select("0", "1", "2").mapInArrow(run, schema)


class Reader:
    """Reads the output of the template back, in pieces of any size."""

    def __init__(self) -> None:
        self.text = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """The turns that became complete."""
        self.text += piece
        out, at = [], 0
        while True:
            end = self.text.find(END, at)
            if end < 0:
                break
            opened = self.text.index(BEGIN + ROLE_OPEN, at)
            close = self.text.index(ROLE_CLOSE, opened)
            out.append((unescape(self.text[opened + len(BEGIN + ROLE_OPEN):close]), unescape(self.text[close + len(ROLE_CLOSE):end])))
            at = end + len(END)
        self.text = self.text[at:]
        return out


def digest_conversations(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Turns, loss text and their digests, read back from the output of `format_conversations`.

    Parts of a conversation must follow each other as that function leaves them.
    """
    key = formatted.schema[conv]
    counts = ["n_turns", "loss_chars", "formatted_chars"]
    schema = T.StructType([
        key, T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            keys, parts, texts, masks = (batch.column(i).to_pylist() for i in range(4))
            for name, part, text, mask in zip(keys, parts, texts, masks, strict=True):
                if part == 0:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(name)
                state.add(text, mask)
            if done:
                yield _batch(done, batch.column(0).type)
            last_kind = batch.column(0).type
        if state is not None:
            yield _batch([state.row()], last_kind)

    def _batch(rows: list[tuple], key_kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [key_kind, *(pa.int64() if n in counts else pa.string() for n in names[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return formatted.select(conv, "part", "formatted", "loss").mapInArrow(run, schema)


class _Digest:
    """Running counts and digests of one conversation."""

    def __init__(self, name: object):
        self.name, self.reader = name, Reader()
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, mask: list[dict]) -> None:
        for role, said in self.reader.feed(text):
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode())
        for span in mask:
            learnt = unescape(text[span["start"]:span["end"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.name, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars
