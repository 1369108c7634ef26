"""Vectorised word and n-gram hashing over Arrow string columns.

Everything works on the UTF-8 bytes of a chunk of documents at once.  A word's
hash is a difference of prefix sums of ``T[byte] * P**i`` (wrapping 64-bit
arithmetic), shifted back by ``P**-start`` and mixed, so equal words have equal
hashes wherever they stand and no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor, shift) over a uint64 array."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; kept and grown per worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        a[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(a)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _class(accept) -> np.ndarray:
    return np.array([bool(accept(b)) for b in range(256)])


#: Bytes of a white-space word, and of a normalised (lower-cased) word.
WORD = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
NORMAL = _class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``[start, end)`` from prefix sums of ``value * base**i``."""
    return mix((prefix[ends] - prefix[starts]) * powers(inverse(base), int(starts.max(initial=0)) + 1)[starts])


def prefix_sum(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


@dataclass
class Chunk:
    """Whole documents of one chunk: bytes, document bounds, and their words."""

    rows: np.ndarray  # row numbers in the batch
    data: np.ndarray  # uint8
    bounds: np.ndarray  # n + 1 byte offsets
    prefix: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    word_bounds: np.ndarray  # n + 1 word offsets

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_bounds)

    @property
    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.n_words)


def words_of(data: np.ndarray, bounds: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words; a word never crosses a document bound."""
    inside = accept[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    cut = bounds[:-1][bounds[:-1] < len(data)]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    last = bounds[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


def chunks(column: pa.Array, *, lower: bool = False, accept: np.ndarray = WORD, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of about ``size`` bytes of whole rows (a longer row is alone).

    A null counts as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        to = min(to, len(column))
        data = raw[offsets[at] : offsets[to]]
        if lower:
            data = LOWER[data]
        bounds = offsets[at : to + 1] - offsets[at]
        starts, ends = words_of(data, bounds, accept)
        prefix = prefix_sum(_BYTE[data], _P)
        yield Chunk(np.arange(at, to), data, bounds, prefix, starts, ends, span_hash(prefix, starts, ends, _P), np.searchsorted(starts, bounds))
        at = to


def ngrams(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which an n-word window of one document starts, and the windows' hashes."""
    m = len(c.hashes)
    if m < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.arange(m - n + 1)
    doc = c.doc_of_word
    at = at[doc[at] == doc[at + n - 1]]
    if n <= 6:
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            h = h * _U(_Q) + c.hashes[at + j]
        return at, mix(h + _U(n))
    return at, span_hash(prefix_sum(c.hashes, _Q), at, at + n, _Q)


def covered(n_words: int, at: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n_words`` words lie in a window of ``n`` words that starts at one of ``at``."""
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + n, n_words), -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k), dtype=bool)
    eq = k[1:] == k[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    out = np.zeros(len(k), dtype=bool)
    out[order] = same
    return out


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over ``[bounds[i], bounds[i + 1])``."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
