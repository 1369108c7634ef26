"""Quality rules by repetition coverage (operator 7).

Words are ``[^\\x20\\x09-\\x0D]+``.  For several n-gram lengths the rolling hashes
of all windows of a document are compared, and the characters of words inside
duplicated windows are measured against all word characters; the same for
duplicated lines.  Each length has its own limit.

Defined results: a null or empty text has no words, fails the base rule and is
not kept; repeated rows are judged one by one; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import storage
from . import textkernel as tk

_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_START = np.array([(b & 0xC0) != 0x80 for b in range(256)])


@dataclass(frozen=True)
class QualityRules:
    """Limits on the share of word characters inside duplicated n-grams (by n), lines, and on symbols a word."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    ngram_limits: tuple[tuple[int, float], ...] = ((4, 0.40), (6, 0.35), (9, 0.30))
    line_limit: float = 0.40
    symbol_limit: float = 0.60


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_line_chars long, dup_ngram_chars array<long>, kept boolean"


def _windows(c: tk.Chunk, n: int) -> np.ndarray:
    """Which words lie in an n-word window that is found twice or more in their document."""
    at, h = tk.ngrams(c, n)
    doc = c.doc_of_word[at].astype(np.uint64)
    again = tk.repeated(h ^ tk.mix(doc + np.uint64(1)))
    return tk.covered(len(c.hashes), at[again], n)


def _lines(c: tk.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word that equal an earlier line, and the word characters in them."""
    newline = np.flatnonzero(c.data == 10)
    starts = np.unique(np.concatenate([c.bounds[:-1], newline + 1]))
    starts = starts[starts < len(c.data)]
    doc = np.searchsorted(c.bounds, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(c.data)), c.bounds[doc + 1])
    ends = ends - ((ends > starts) & (c.data[np.maximum(ends - 1, 0)] == 10))
    first = np.searchsorted(c.starts, starts)
    has = np.searchsorted(c.starts, ends) > first
    starts, ends, doc = starts[has], ends[has], doc[has]
    h = tk.span_hash(c.prefix, starts, ends, tk._P) ^ tk.mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    later = np.zeros(len(h), dtype=bool)
    later[order[1:]] = h[order[1:]] == h[order[:-1]]
    return _per(doc[later], np.ones(int(later.sum()), dtype=np.int64), len(c.rows)), _lines_chars(c, starts[later], ends[later], doc[later])


def _lines_chars(c: tk.Chunk, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    chars = np.zeros(len(c.starts) + 1, dtype=np.int64)
    np.cumsum(_word_chars(c), out=chars[1:])
    return _per(doc, chars[np.searchsorted(c.starts, ends)] - chars[np.searchsorted(c.starts, starts)], len(c.rows))


def _per(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, doc, values)
    return out


def _word_chars(c: tk.Chunk) -> np.ndarray:
    points = np.zeros(len(c.data) + 1, dtype=np.int64)
    np.cumsum(_START[c.data], out=points[1:])
    return points[c.ends] - points[c.starts]


def measure(column: pa.Array, rules: QualityRules) -> pa.RecordBatch:
    """The measures and the verdict of each text of a column."""
    parts: dict[str, list[np.ndarray]] = {}
    for c in tk.chunks(column):
        chars = _word_chars(c)
        total = tk.sums(chars, c.word_bounds)
        lines, line_chars = _lines(c)
        grams = [tk.sums(np.where(_windows(c, n), chars, 0), c.word_bounds) for n, _ in rules.ngram_limits]
        words = c.n_words
        got = {
            "n_words": words,
            "word_chars": total,
            "n_symbols": tk.sums(_SYMBOL[c.data], c.bounds),
            "n_dup_lines": lines,
            "n_repeat_words": tk.sums(_windows(c, 3), c.word_bounds),
            "dup_line_chars": line_chars,
            "grams": np.stack(grams, axis=1) if grams else np.zeros((len(words), 0), dtype=np.int64),
        }
        failed = (words < rules.min_words) | (got["n_repeat_words"] > rules.max_repeat_share * words)
        kept = ~failed & (line_chars <= rules.line_limit * total) & (got["n_symbols"] <= rules.symbol_limit * words)
        for j, (_, limit) in enumerate(rules.ngram_limits):
            kept &= got["grams"][:, j] <= limit * total
        for k, v in (got | {"base_failed": failed, "kept": kept}).items():
            parts.setdefault(k, []).append(v)
    n = len(rules.ngram_limits)
    if not parts:
        cols = {k: np.zeros(0, dtype=np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")}
        cols |= {"grams": np.zeros((0, n), dtype=np.int64), "base_failed": np.zeros(0, dtype=bool), "kept": np.zeros(0, dtype=bool)}
    else:
        cols = {k: np.concatenate(v) for k, v in parts.items()}
    grams = cols.pop("grams")
    offsets = pa.array(np.arange(len(grams) + 1, dtype=np.int32) * n)
    cols = {k: pa.array(v) for k, v in cols.items()} | {"dup_ngram_chars": pa.ListArray.from_arrays(offsets, pa.array(grams.reshape(-1)))}
    names = [x.split(" ")[0] for x in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([cols[k] for k in names], names)


def measures(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: every column of ``docs``) plus the measures; row by row, no shuffle."""
    keep = docs.columns if keep is None else keep
    new = [x.split(" ")[0] for x in COLUMNS.split(", ")]
    source = docs.select(docs[text].alias("__text"), *[docs[k] for k in keep if k not in new])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure(b.column(0), rules)
            yield pa.RecordBatch.from_arrays(list(b.columns[1:]) + list(got.columns), b.schema.names[1:] + got.schema.names)

    return storage.text_batches(source).mapInArrow(storage.lean(run), ", ".join(x for x in (fields, COLUMNS) if x))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``; a clashing column keeps its own values."""
    renamed = docs.select(docs["text"].alias("__t"), *[docs[k].alias(f"c{j}") for j, k in enumerate(docs.columns)])
    got = measures(renamed, rules, text="__t", keep=[f"c{j}" for j in range(len(docs.columns))])
    return got.where("kept").select(*[got[f"c{j}"].alias(k) for j, k in enumerate(docs.columns)])
