"""Harmonic packing of token sequences (operator 1).

A document's tokens are cut into full sequences and a rest of ``r`` tokens.  Rests are
partitioned by length into reciprocal-capacity classes: class k holds the lengths in
``(C / (k + 1), C / k]``, and a bin of class k takes exactly k of them, whatever they
weigh.  Classes beyond ``DENSE`` are one last class of small rests.  What k rests leave
of their bin (less than ``C / (k + 1)``) is filled by the small class, which is cut freely
at the bins' ends; if too much room waits, the next rest is used as filler too, of
whatever class it is.

Every worker classes and fills its own bins, without a shuffle, and holds only the
bins that are not full yet: one for each class, and at most ``WAITING`` with room.  At the
end of its rows it lays the pieces of these last bins one after another into full
sequences, and the last rest of less than a sequence into sequences of powers of two
tokens, which are not padded.  So nothing is padded at all; the price is at most
``log2(C)`` short sequences a worker.

Ids are those of ``tokenizers`` for the vocabulary file that is named, its special strings
included.  ``tiktoken`` computes them from the same file at less than half the time
(tests compare with ``tokenizers``); a text on which its pattern matcher gives up (a million
spaces) goes through ``tokenizers`` itself.

Defined results: a null text is an empty one and has the end token alone; a text of any
length is cut into full sequences and a rest; repeated rows are packed each; ids of any
type pass through; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import storage

CAPACITY = 1024
END = 0
#: The classes with bins of their own; shorter rests are the small class.
DENSE = 7
#: Bins that may wait for filler before every rest is filler.
WAITING = 32


def harmonic_class(length: int, capacity: int = CAPACITY) -> int:
    """k with ``capacity / (k + 1) < length <= capacity / k``."""
    return capacity // length


@lru_cache(maxsize=2)
def _exact(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def _byte_of_letter() -> dict[str, int]:
    """The bytes behind the letters of a byte-level vocabulary: printable Latin-1 stands for itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _fast(vocabulary: str):
    """The same ids by ``tiktoken``: in a byte-level vocabulary the ids are the order of the merges."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        held = json.load(f)
    letters = _byte_of_letter()
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): n for token, n in held["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(text: str | None, vocabulary: str) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of a document, the end token last."""
    ids: object = []
    if text:
        try:
            ids = _fast(vocabulary).encode_to_numpy(text, allowed_special="all")
        except ValueError:
            ids = _exact(vocabulary).encode(text, add_special_tokens=False).ids
    return np.append(np.asarray(ids, dtype="<u4"), np.asarray([END], dtype="<u4"))


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int


@dataclass
class Bin:
    """A sequence that is not full yet."""

    pieces: list[Piece] = field(default_factory=list)
    used: int = 0


class Packer:
    """One worker's bins; ``add`` and ``finish`` give the sequences that are done, as lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, dense: int = DENSE, waiting: int = WAITING):
        self.capacity, self.dense, self.waiting = capacity, dense, waiting
        self.of_class: dict[int, Bin] = {}
        self.gaps: deque[Bin] = deque()

    def add(self, doc: object, ids: np.ndarray) -> Iterator[list[Piece]]:
        n, cap = len(ids), self.capacity
        whole = n - n % cap
        for at in range(0, whole, cap):
            yield [Piece(doc, at, ids[at : at + cap], n)]
        if whole == n:
            return
        rest = Piece(doc, whole, ids[whole:].copy(), n)
        k = harmonic_class(n - whole, cap)
        if k > self.dense or len(self.gaps) >= self.waiting:
            yield from self._fill(rest)
            return
        b = self.of_class.setdefault(k, Bin())
        b.pieces.append(rest)
        b.used += len(rest.ids)
        if len(b.pieces) == k:
            del self.of_class[k]
            if b.used == cap:
                yield b.pieces
            else:
                self.gaps.append(b)

    def _fill(self, piece: Piece) -> Iterator[list[Piece]]:
        """Cut a piece over the bins with room."""
        at = 0
        while at < len(piece.ids):
            if not self.gaps:
                self.gaps.append(Bin())
            b = self.gaps[0]
            part = piece.ids[at : at + self.capacity - b.used]
            b.pieces.append(Piece(piece.doc, piece.start + at, part, piece.doc_tokens))
            b.used += len(part)
            at += len(part)
            if b.used == self.capacity:
                yield self.gaps.popleft().pieces

    def finish(self) -> Iterator[list[Piece]]:
        """What is open: full sequences, then powers of two."""
        left = [p for b in [*self.of_class.values(), *self.gaps] for p in b.pieces]
        self.of_class, self.gaps = {}, deque()
        total = sum(len(p.ids) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << j for j in reversed(range(self.capacity.bit_length())) if total % self.capacity >> j & 1]
        queue = deque(left)
        for size in sizes:
            out = []
            while size:
                p = queue.popleft()
                if len(p.ids) > size:
                    queue.appendleft(Piece(p.doc, p.start + size, p.ids[size:], p.doc_tokens))
                    p = Piece(p.doc, p.start, p.ids[:size], p.doc_tokens)
                out.append(p)
                size -= len(p.ids)
            yield out


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: a row for each piece; no shuffle.

    ``sequence_id`` is the worker's partition number and, in the low 33 bits, the number of its sequence.
    """
    source = docs.select(docs["doc_id"], docs[text].alias("__text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id"] + [x.split(" ")[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, made, kind = Packer(capacity), TaskContext.get().partitionId() << 33, None

        def rows(done: Iterator[list[Piece]]) -> Iterator[tuple]:
            nonlocal made
            for pieces in done:
                at = 0
                for p in pieces:
                    yield p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, made, at
                    at += len(p.ids)
                made += 1

        def table(got: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*got, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:]], names)

        for b in batches:
            kind = b.column(0).type
            got: list[tuple] = []
            for doc, t in zip(b.column(0), b.column(1), strict=True):
                got += rows(packer.add(doc.as_py(), token_ids(t.as_py(), vocabulary)))
            yield table(got)
        if kind is not None:
            yield table(list(rows(packer.finish())))

    return storage.text_batches(source).mapInArrow(storage.lean(run), f"doc_id {key}, {PIECES}")
