"""Benchmark decontamination with a generalised suffix automaton (operator 10).

Items and documents are lower-cased (A-Z) and cut into words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  One automaton holds every item of a block;
training words are streamed through it and the longest matching length is kept at
each word.  A match of at least ``window`` words (or a whole shorter item) is a hit.
Before the automaton, a vectorised filter keeps only chains of words whose every
neighbouring pair occurs in an item, which no match can leave.

The benchmark is cut into blocks of at most ``block_words`` words; a block is broadcast as
its word hashes (eight bytes a word) and its automaton built where it is used.  One pass
over the documents takes all blocks: a task gathers about ``BUFFER`` bytes of texts, then
streams them through one block after another, and keeps at most ``HELD`` automata.

Defined results: null and empty texts have no words and no hits; an item without
words is ignored; equal items under several ids all count, rows with an equal id
count once, an item without an id counts for hits but is not listed; repeated
documents are each judged, ids of any type; a text of any length is streamed through whole; an
empty benchmark hits nothing, no documents give no rows; other columns pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from . import textkernel as tk

WINDOW = 10
BLOCK_WORDS = 100_000
#: Bytes of texts that a task streams through a block at a time; automata that a worker keeps.
BUFFER, HELD = 16_000_000, 8


def normal_words(text: str | None) -> np.ndarray:
    """Word hashes of one text."""
    got = [c.hashes for c in tk.chunks(pa.array([text], pa.string()), lower=True, accept=tk.NORMAL)]
    return np.concatenate(got) if got else np.zeros(0, dtype=np.uint64)


@dataclass
class Automaton:
    """A suffix automaton of several word sequences.

    ``items`` has, for each state whose shortest strings of at least ``window`` words are windows, the items with them.
    """

    window: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: dict[int, set[int]] = field(default_factory=dict)
    whole: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    ids: list[str | None] = field(default_factory=list)
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    shortest: int = WINDOW

    @staticmethod
    def of(items: list[tuple[str | None, np.ndarray]], window: int = WINDOW) -> Automaton:
        a = Automaton(window)
        items = [(k, w) for k, w in items if len(w)]
        if not items:
            return a
        a.vocabulary = np.unique(np.concatenate([w for _, w in items]))
        seen: list[np.ndarray] = []
        long: list[tuple[int, np.ndarray]] = []
        size = len(a.vocabulary)
        for n, (key, words) in enumerate(items):
            ids = np.searchsorted(a.vocabulary, words)
            seen.append(ids[:-1] * size + ids[1:])
            a.ids.append(key)
            last = 0
            for w in ids.tolist():
                last = a._add(last, w)
            if len(ids) < window:
                a.whole.setdefault(last, []).append((len(ids), n))
            else:
                long.append((n, ids))
        a.pairs = np.unique(np.concatenate(seen))
        a.shortest = min(window, *(len(w) for _, w in items))
        for n, ids in long:
            state = 0
            for i, w in enumerate(ids.tolist()):
                state = a.step[state][w]
                if i + 1 >= window:
                    a.items.setdefault(a._window(state), set()).add(n)
        return a

    def _window(self, state: int) -> int:
        """The state of the last ``window`` words of a state's strings."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, at: int, w: int) -> int:
        """The state reached from ``at`` by ``w``, cut down to the strings that really follow ``at``."""
        to = self.step[at][w]
        if self.length[to] == self.length[at] + 1:
            return to
        part = self._state(self.length[at] + 1)
        self.step[part] = dict(self.step[to])
        self.link[part] = self.link[to]
        self.link[to] = part
        while at >= 0 and self.step[at].get(w) == to:
            self.step[at][w] = part
            at = self.link[at]
        return part

    def _add(self, last: int, w: int) -> int:
        if w in self.step[last]:
            return self._split(last, w)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and w not in self.step[at]:
            self.step[at][w] = new
            at = self.link[at]
        self.link[new] = 0 if at < 0 else self._split(at, w)
        return new

    def chains(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, and starts and ends of the chains that can hold a match."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.vocabulary) or not len(hashes):
            return none, none, none
        low = np.zeros(1 << 18, dtype=bool)
        low[(self.vocabulary & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(low[(hashes & np.uint64((1 << 18) - 1)).astype(np.int64)])
        pos = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        ok = self.vocabulary[pos] == hashes[at]
        ids = np.full(len(hashes), -1, dtype=np.int64)
        ids[at[ok]] = pos[ok]
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & (doc[:-1] == doc[1:]))
        key = ids[both] * len(self.vocabulary) + ids[both + 1]
        joined = np.zeros(len(ids) + 1, dtype=bool)
        if len(self.pairs):
            p = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[both[self.pairs[p] == key] + 1] = True
        known = ids >= 0
        starts = np.flatnonzero(known & ~joined[:-1])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        long = ends - starts >= self.shortest
        return ids, starts[long], ends[long]

    def matches(self, ids: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """``(start, end, items)`` of each hit in a chain of word ids."""
        state, n = 0, 0
        for i, w in enumerate(ids):
            while state and w not in self.step[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.step[state]:
                state, n = self.step[state][w], n + 1
            else:
                n = 0
            found: set[int] = set()
            at, most = state, 0
            while at > 0 and self.whole:
                for size, item in self.whole.get(at, ()):
                    if size <= n:
                        found.add(item)
                        most = max(most, size)
                at = self.link[at]
            if n >= self.window:
                found |= self.items[self._window(state)]
                most = n
            if found:
                yield i + 1 - most, i + 1, found


Block = list[tuple[str | None, np.ndarray]]


def blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """Items as word hashes, of at most ``block_words`` words each (one longer item is cut into overlapping parts)."""
    part: Block = []
    size = 0
    for row in items.select(F.col("item_id").cast("string").alias("k"), "text").toLocalIterator():
        words = normal_words(row["text"])
        for at in range(0, max(1, len(words)), block_words):
            piece = words[at : at + block_words + window - 1] if at + window <= len(words) or at == 0 else words[:0]
            if part and size + len(piece) > block_words:
                yield part
                part, size = [], 0
            if len(piece):
                part.append((row["k"], piece))
                size += len(piece)
    if part:
        yield part


@dataclass(frozen=True)
class Held:
    """One block as it is broadcast; workers keep automata by ``name`` from task to task."""

    name: str
    block: Broadcast = field(compare=False)


@lru_cache(maxsize=HELD)
def _machine(held: Held, window: int) -> Automaton:
    return Automaton.of(held.block.value, window)


@dataclass
class Words:
    """The words of some rows of a batch: hashes, their rows in a group of batches, and their numbers in the row."""

    hashes: np.ndarray
    row: np.ndarray
    first: np.ndarray


def _words(column: pa.Array, base: int, counts: list[int]) -> Iterator[Words]:
    for c in tk.chunks(column, lower=True, accept=tk.NORMAL):
        counts += c.n_words.tolist()
        yield Words(c.hashes, np.repeat(c.rows + base, c.n_words), np.repeat(c.word_bounds[:-1], c.n_words))


def _scan(words: Words, machine: Automaton, ranges: list[list[int]], found: list[set[str]]) -> None:
    ids, starts, ends = machine.chains(words.hashes, words.row)
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        row, first = int(words.row[s]), int(words.first[s])
        items: set[int] = set()
        for a, b, got in machine.matches(ids[s:e].tolist()):
            ranges[row] += [s - first + a, s - first + b]
            items |= got
        found[row] |= {machine.ids[n] for n in items if machine.ids[n] is not None}


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches of about ``size`` bytes together."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _merge(flat: list[int]) -> list[int]:
    """Sorted, disjoint ``start, end, start, end, ...``."""
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


STATE = "__n_words long, __ranges array<long>, __items array<string>"


def mark(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` plus ``__n_words``, ``__ranges`` (hit words, as sorted disjoint start, end) and ``__items`` (ids, sorted as strings)."""
    added = [x.split(" ")[0] for x in STATE.split(", ")]
    keep = [f for f in docs.schema.fields if f.name not in added]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [STATE])
    at = [f.name for f in keep].index(text)
    held = [Held(uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(b)) for b in blocks(items, window, block_words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, BUFFER):
            counts: list[int] = []
            words = [w for b in group for w in _words(b.column(at), len(counts), counts)]
            ranges: list[list[int]] = [[] for _ in counts]
            found: list[set[str]] = [set() for _ in counts]
            for h in held:
                for w in words:
                    _scan(w, _machine(h, window), ranges, found)
            done = 0
            for b in group:
                own = slice(done, done + b.num_rows)
                done += b.num_rows
                new = [pa.array(counts[own], pa.int64()), pa.array([_merge(x) for x in ranges[own]], pa.list_(pa.int64())), pa.array([sorted(x) for x in found[own]], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(list(b.columns) + new, b.schema.names + added)

    return storage.text_batches(docs).select(*[docs[f.name] for f in keep]).mapInArrow(storage.lean(run), schema)


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: word and hit counts, and the items with an occurring window."""
    marked = mark(docs.select("doc_id", "text"), items, window=window, block_words=block_words)
    ends = "aggregate(__ranges, struct(0L as n, -1L as sign), (a, x) -> struct(a.n + a.sign * x as n, -a.sign as sign), a -> a.n)"
    out = marked.select("doc_id", "__n_words", F.expr(ends).alias("n_hit"), "__items")
    return out.select(
        "doc_id", F.col("__n_words").alias("n_words"), "n_hit", F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, window: int = WINDOW, text: str = "text") -> DataFrame:
    """``docs`` without the hit spans; a document with more than ``max_coverage`` of its words hit goes.

    A span reaches from its first to its last hit word; what stands around it stays as it is.
    """
    marked = mark(docs, items, text=text, window=window)
    at, added = marked.columns.index(text), len(STATE.split(", "))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields[:-added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, ranges = b.column(b.num_columns - added), b.column(b.num_columns - added + 1)
            hit = np.array([bool(x) for x in ranges.to_pylist()], dtype=bool)
            texts = b.column(at).to_pylist() if hit.any() else None
            keep = np.ones(b.num_rows, dtype=bool)
            for row in np.flatnonzero(hit).tolist():
                spans = ranges[row].as_py()
                raw = texts[row].encode()
                c = next(tk.chunks(pa.array([texts[row]], pa.string()), lower=True, accept=tk.NORMAL))
                keep[row] = sum(spans[1::2]) - sum(spans[::2]) <= max_coverage * n_words[row].as_py()
                out, last = [], 0
                for a, e in zip(spans[::2], spans[1::2], strict=True):
                    out.append(raw[last : int(c.starts[a])])
                    last = int(c.ends[e - 1])
                texts[row] = b"".join([*out, raw[last:]]).decode()
            cols = list(b.columns[:-added])
            if texts is not None:
                cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-added]).filter(pa.array(keep))

    return marked.mapInArrow(storage.lean(run), schema)
