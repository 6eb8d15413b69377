"""Byte-level BPE by dynamic programming over prefixes (operator 8)."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import give_back, take_turn

#: Code points with Unicode's White_Space (fixed values), as a class of a pattern.
SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Cuts a text where white space begins or, before one word, a single space does. Every match of the
#: public pattern lies within one such chunk and is found in the chunk alone as it is in the text.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Pairs of tokens remembered by one worker; bytes of chunks and ids remembered, the objects' own size included;
#: longer chunks aren't remembered.
PAIRS, REMEMBERED, OBJECTS, LONGEST = 300_000, 96 << 20, 220, 256
#: Steps from state to state remembered by one worker, those within tokens included.
STEPS = 400_000


class Prefixes:
    """The encoding of a growing byte string, as the last token of every prefix.

    A prefix has exactly one valid encoding, and cutting its last token leaves the valid encoding of a
    shorter prefix. So the last token of each prefix is the one that ends there and forms a valid pair
    with the last token of the prefix it leaves."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Exact: last tokens of earlier prefixes don't change."""
        at = len(self.data)
        self.data += more
        self.bpe.extend(self.data, self.last, at, len(self.data))

    def replace(self, lo: int, hi: int, more: bytes) -> int:
        """Put `more` in place of bytes lo..hi. Prefixes up to lo stay; those behind are worked out
        until as many in a row as the longest token has bytes are what they were, as no later one can
        differ then. Returns how many were worked out."""
        old, moved = self.last, len(more) - (hi - lo)
        self.data = self.data[:lo] + more + self.data[hi:]
        self.last = old[:lo]
        agree, i, state = 0, lo, None
        while i < len(self.data) and agree < self.bpe.longest:
            state = self.bpe.extend(self.data, self.last, i, i + 1, state)
            agree = agree + 1 if i >= lo + len(more) and self.last[i] == old[i - moved] else 0
            i += 1
        self.last += old[i - moved :] if i < len(self.data) else []
        return i - lo

    def ids(self) -> list[int]:
        out, i, last, sizes = [], len(self.data), self.last, self.bpe.sizes
        while i:
            t = last[i - 1]
            out.append(t)
            i -= sizes[t]
        return out[::-1]


class Bpe:
    """Encoder and decoder for the ranks in a file of base64 tokens and ids."""

    def __init__(self, path: str, pattern: str, room: int | None = None):
        self.room = REMEMBERED if room is None else room  # bytes of chunks and ids remembered
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was remembered before; what is met again moves on
        self.used = 0
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)]
        # States: beginnings of tokens, the empty one first. The state behind a text is the longest that it ends with,
        # and has all tokens that it ends with (size, id), longest first. Steps that a state lacks are those of its longest
        # shorter state; they are remembered as they come.
        states = {w: k for k, w in enumerate(sorted({t[:n] for t in self.ranks for n in range(len(t) + 1)}, key=len))}
        self.steps = {states[w[:-1]] << 8 | w[-1]: k for w, k in states.items() if w}
        self.shorter, self.ending = [0], [()]
        for w, k in states.items():
            if w:
                self.shorter.append(self.step(self.shorter[states[w[:-1]]] << 8 | w[-1]) if len(w) > 1 else 0)
                own, t = self.ending[self.shorter[k]], self.ranks.get(w)
                self.ending.append(own if t is None else ((len(w), t), *own))
        self.table = np.array(self.sizes, np.int64)

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; None for single bytes."""
        if token not in self.halves:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            while len(parts) > 2:
                ranks = [self.ranks.get(a + b, token) for a, b in zip(parts, parts[1:])]
                k = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[k] >= token:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens that stand side by side gives just these tokens:
        undo the later of the merges that made them, again and again; at no time may what touches at
        the seam merge earlier than what was undone last."""
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self._fits(a, b)
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
        return got

    def _fits(self, a: int, b: int) -> bool:
        # A merge left of the seam comes before an equal one on the right, so that it wins ties.
        limit, x, y = 1 << 40, a, b
        while True:
            merged = self.ranks.get(self.tokens[x] + self.tokens[y])
            if merged is not None and merged < limit:
                return False
            left, right = self.split(x), self.split(y)
            if left is None and right is None:
                return True
            if right is None or (left is not None and x > y):
                limit, x = x, left[1]
            else:
                limit, y = y + 1, right[0]

    def step(self, key: int) -> int:
        """The state behind a state and a byte, given as state << 8 | byte."""
        got = self.steps.get(key)
        if got is None:
            got = self.step(self.shorter[key >> 8] << 8 | key & 255) if key >> 8 else 0
            if len(self.steps) < STEPS:
                self.steps[key] = got
        return got

    def extend(self, data: bytes, last: list[int], lo: int, hi: int, state: int | None = None) -> int:
        """Append to `last` the last tokens of the prefixes of `data` that end at lo+1..hi. Takes the state behind
        the first lo bytes, if known, and returns the one behind the first hi."""
        step, ending, pairs, fits = self.steps.get, self.ending, self.pairs.get, self.fits
        if state is None:
            state = 0
            for c in data[max(0, lo - self.longest) : lo]:
                state = self.step(state << 8 | c)
        for i in range(lo, hi):
            key = state << 8 | data[i]
            state = step(key)
            if state is None:
                state = self.step(key)
            for n, t in ending[state]:
                if n > i:
                    last.append(t)
                    break
                a = last[i - n]
                good = pairs((a, t))
                if good or (good is None and fits(a, t)):
                    last.append(t)
                    break
            else:
                raise ValueError("no token ends here")
        return state

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self, data).ids()

    def _chunk(self, chunk: str) -> bytes:
        packed = self.older.get(chunk)
        if packed is None:
            ids = [i for p in self.pattern.findall(chunk) for i in self.piece(p.encode("utf-8", "replace"))]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= LONGEST:
            if self.used > self.room // 2:
                self.older, self.chunks, self.used = self.chunks, {}, 0
            self.chunks[chunk] = packed
            self.used += len(chunk) + len(packed) + OBJECTS
        return packed

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; null counts as empty."""
        get = self.chunks.get
        return b"".join([get(c) or self._chunk(c) for c in CHUNK.findall(text or "")])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_loaded: dict[tuple[str, str, int | None], Bpe] = {}


def load(path: str, pattern: str, room: int | None = None) -> Bpe:
    """One encoder for each worker, until another operator works there."""
    take_turn("bpe", _loaded.clear)
    key = path, pattern, room
    if key not in _loaded:
        _loaded.clear()  # one at a time
        _loaded[key] = Bpe(*key)
    return _loaded[key]


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", ids: bool = True, room: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, token_ids]) for every row of `docs`: the ids of
    its whole text by the ranks in the file at `path`, which every executor must have, each match of
    `pattern` separately; then decodes them. Digests are of ids as little-endian unsigned 32-bit
    integers and of the decoded bytes. Null text counts as empty: no ids. Null doc_ids and repeated rows
    are returned as given; an empty table gives no rows; other columns are ignored. No shuffle. A worker
    remembers about `room` bytes of words, by default REMEMBERED; with fewer it works longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern, room)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                packed = [bpe.packed(t) for t in part.column(1).to_pylist()]
                arrays = [np.frombuffer(p, "<u4") for p in packed]
                out = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(a) for a in arrays], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(a)).hexdigest() for a in arrays], pa.string()),
                }
                if ids:
                    out["token_ids"] = pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)
        give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The text of a column of token ids; null stays null, bytes that aren't UTF-8 become U+FFFD."""

    def run(column: pd.Series) -> pd.Series:
        bpe = load(path, pattern)
        return column.map(lambda a: None if a is None else bpe.decode(np.asarray(a)).decode("utf-8", "replace"))

    return F.pandas_udf(run, "string")(ids)
