"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The transducer reads a piece byte by byte. The encoding of every prefix ends
in exactly one token, the one that may follow the encoding of what precedes
it, so each prefix points back to a shorter one and the pointers form a tree.
A later token can only begin at a prefix whose open bytes still start some
token of the vocabulary; what lies above the lowest common ancestor of those
prefixes is final and is emitted. A state is what remains: the last emitted
token and the open prefixes. States and transitions are built when first
needed; those met first, hence most often, are remembered, up to a bound; beyond it short rests
of pieces run through the transducer without determinising it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glyphflow.llm import words as W
from glyphflow.llm.frames import small_batches

# Bytes left of a piece from which it is finished without remembering states.
MAX_FINISH = 24


@dataclass(frozen=True)
class Memory:
    """What a worker remembers at most: states, twice as many pieces as told, and the steps outside the
    remembered states before they are learnt anew. A bound on memory, not on inputs; the default takes about 400 MB."""

    states: int = 300_000
    pieces: int = 600_000
    missed: int = 2_000_000


# For workers that also run other operators.
SMALL = Memory(states=60_000, pieces=100_000)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class State:
    """What is still open after some input: its bytes and, for each prefix that encodes on from the
    last emitted token, the prefix length, its last token and the place of the prefix before that token.
    The last emitted token and the open bytes determine all of it, so they name the state."""

    __slots__ = ("number", "open", "ends", "lasts", "parents", "tail")

    def __init__(self, number: int, open_bytes: bytes, ends: Sequence[int], lasts: Sequence[int], parents: Sequence[int]):
        self.number = number << 8
        self.open = open_bytes
        self.ends = ends
        self.lasts = lasts
        self.parents = parents
        self.tail: list[int] | None = None


class Transducer:
    """Encodes byte pieces by merge ranks; equal to merging the lowest rank first."""

    def __init__(self, ranks: dict[bytes, int], memory: Memory):
        self.ranks = ranks
        self.memory = memory
        self.tokens = {rank: token for token, rank in ranks.items()}
        # Proper prefixes of tokens: bytes from which a longer token may still come.
        self.growing = {token[:n] for token in ranks for n in range(1, len(token))}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.count = self.missed = 0
        # (state, byte) -> next state, or next state and the tokens that became final.
        self.moves: dict[int, State | tuple[State, tuple[int, ...]]] = {}
        self.start = self._state(b"", (0,), (-1,), (-1,))

    def _state(self, open_bytes: bytes, ends: tuple, lasts: tuple, parents: tuple) -> State:
        key = (lasts[0], open_bytes)
        state = self.states.get(key)
        if state is None:
            state = State(self.count, open_bytes, ends, lasts, parents)
            self.count += 1
            if len(self.states) < self.memory.states:
                self.states[key] = state
        return state

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.made_of:
            parts = [bytes((b,)) for b in self.tokens[token]]
            while len(parts) > 2:
                ranked = [self.ranks.get(a + b, token) for a, b in zip(parts, parts[1:])]
                at = ranked.index(min(ranked))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.made_of[token] = tuple(self.ranks[p] for p in parts) if len(parts) == 2 else None
        return self.made_of[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives these two tokens.

        Undoes the merges of both sides from the last to the first. A merge
        across the border would have come first if its rank is below that of
        every merge undone so far.
        """
        tokens, ranks = self.tokens, self.ranks
        below = len(tokens) + 1
        while True:
            if ranks.get(tokens[left] + tokens[right], below) < below:
                return False
            inner, outer = self.halves(left), self.halves(right)
            if inner is None and outer is None:
                return True
            # The later of the two merges is undone; on a tie the right one came later.
            if outer is None or (inner is not None and left > right):
                below, left = left, inner[1]
            else:
                below, right = right + 1, outer[0]

    def _step(self, state: State, byte: int) -> State | tuple[State, tuple[int, ...]]:
        """The state after one more byte, with the tokens that became final if there are any."""
        text = state.open + bytes((byte,))
        ends, lasts, parents, ranks = state.ends, state.lasts, state.parents, self.ranks
        for parent, end in enumerate(ends):  # longest token first
            token = ranks.get(text[end:])
            if token is not None and (lasts[parent] < 0 or self.may_follow(lasts[parent], token)):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        ends, lasts, parents = (*ends, len(text)), (*lasts, token), (*parents, parent)
        if text in self.growing:
            return self._state(text, ends, lasts, parents)
        # A later token begins at the last prefix or at one whose open bytes can grow:
        # climb until the ways to all of these meet.
        meet = len(ends) - 1
        for place in range(len(ends) - 2, 0, -1):
            if text[ends[place]:] in self.growing:
                while place != meet:
                    if place > meet:
                        place = parents[place]
                    else:
                        meet = parents[meet]
                if not meet:
                    break
        if not meet:
            return self._state(text, ends, lasts, parents)
        out = []
        at = meet
        while at:
            out.append(lasts[at])
            at = parents[at]
        base, place = ends[meet], {meet: 0}
        for i in range(meet + 1, len(ends)):
            if parents[i] in place:
                place[i] = len(place)
        fresh = self._state(text[base:], tuple(ends[i] - base for i in place), tuple(lasts[i] for i in place), (-1, *(place[parents[i]] for i in list(place)[1:])))
        return fresh, tuple(reversed(out))

    def _finish(self, state: State, rest: bytes) -> list[int]:
        """The tokens of the open input and a short rest, without building states for them."""
        text = state.open + rest
        ends, lasts, parents = list(state.ends), list(state.lasts), list(state.parents)
        ranks = self.ranks
        for stop in range(len(state.open) + 1, len(text) + 1):
            for parent, end in enumerate(ends):
                token = ranks.get(text[end:stop])
                if token is not None and (lasts[parent] < 0 or self.may_follow(lasts[parent], token)):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            ends.append(stop)
            lasts.append(token)
            parents.append(parent)
        return self._tail(State(0, text, ends, lasts, parents))

    @staticmethod
    def _tail(state: State) -> list[int]:
        """The tokens of the whole open input, for the end of a piece."""
        out = []
        at = len(state.ends) - 1
        while at:
            out.append(state.lasts[at])
            at = state.parents[at]
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """Token ids of one piece."""
        if self.missed > self.memory.missed:
            self.forget()
        state, out, moves, most = self.start, [], self.moves, self.memory.states
        for at, byte in enumerate(data):
            move = moves.get(state.number | byte)
            if move is None:
                if len(self.states) >= most:
                    self.missed += 1
                    if len(data) - at <= MAX_FINISH:
                        return out + self._finish(state, data[at:])
                move = self._step(state, byte)
                if len(self.states) < most:
                    moves[state.number | byte] = move
            if move.__class__ is tuple:
                state, final = move
                out += final
            else:
                state = move
        if state.tail is None:
            state.tail = self._tail(state)
        return out + state.tail


class Codec:
    """Texts to ids and back, with a bounded memory of pieces."""

    def __init__(self, path: str, pattern: str, memory: Memory = SMALL):
        self.memory = memory
        self.transducer = Transducer(read_ranks(path), memory)
        self.find = regex.compile(pattern).findall
        # Pieces met lately, and those before them: when the first are many they become the second.
        self.pieces: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.bytes_of = [self.transducer.tokens.get(i, b"") for i in range(max(self.transducer.tokens) + 1)]

    def encode(self, text: str) -> list[int]:
        pieces = self.find(text)
        found = list(map(self.pieces.get, pieces))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self.pieces.get(pieces[i]) or self._learn(pieces[i])
        return list(chain.from_iterable(found))

    def _learn(self, piece: str) -> list[int]:
        ids = self.older.get(piece) or self.transducer.piece(piece.encode())
        if len(piece) <= 64:  # long pieces hardly come twice, and would fill the memory
            if len(self.pieces) >= self.memory.pieces:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, chunks: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of each chunk of ids; a character cut by a chunk's end comes with the next chunk."""
        state = Utf8()
        for ids in chunks:
            yield state.feed(self.decode_bytes(ids))
        rest = state.close()
        if rest:
            yield rest

    def decode(self, ids: list[int], chunk: int) -> str:
        """Text of a list of ids, decoded as a stream of chunks of `chunk` ids."""
        return "".join(self.decode_stream(ids[i:i + chunk] for i in range(0, len(ids), chunk)))


class Utf8:
    """Incremental UTF-8: holds back the bytes of a character that is not complete yet."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def open_bytes(data: bytes) -> int:
        """Bytes at the end that begin a character without ending it: three states, one per byte still to come."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 2 if byte & 0xE0 == 0xC0 else 3 if byte & 0xF0 == 0xE0 else 4 if byte & 0xF8 == 0xF0 else 1
            return back if need > back else 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self.open_bytes(data)
        self.held = data[len(data) - n:]
        return data[:len(data) - n].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec(path: str, pattern: str, memory: Memory = SMALL) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern, memory)


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", memory: Memory = SMALL, chunk: int = 4096) -> DataFrame:
    """Key, `ids` array<int> and `decoded` binary, one row for each input row.

    Every match of `pattern` is encoded by itself, special tokens are ordinary
    text. A null or empty text has no ids and decodes to no bytes. `decoded` is
    the decoded ids, a stream of chunks of `chunk` ids, not a copy of the text. Rows are independent: equal rows
    give equal rows, other columns of `docs` do not matter, nothing is shuffled.
    `ranks` must be readable on every executor; `memory` trades worker memory for time.
    """
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern, memory)
        for part in W.slices(batches, text):
            rows = [own.encode(t) if t else [] for t in part.column(1).to_pylist()]
            back = pa.array([own.decode(r, chunk) for r in rows], pa.string()).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(rows), back], [f.name for f in schema])

    return docs.select(key, text).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids", chunk: int = 4096) -> DataFrame:
    """Key and `text`, decoded in chunks of `chunk` ids; null ids give an empty text."""
    small_batches(tokens.sparkSession)
    schema = T.StructType([tokens.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            texts = [own.decode(r or [], chunk) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [f.name for f in schema])

    return tokens.select(key, ids).mapInArrow(run, schema)
