"""Incremental substring deduplication with a log-structured fingerprint index (operator 6).

A window is ``WINDOW`` consecutive words.  Its fingerprint is the least hash of the
``PART``-word parts in it, so equal windows have equal fingerprints and neighbouring
windows mostly share one: the index holds about a fifth of what all window hashes
would need.  Each batch becomes a sorted immutable run of ``(fp, doc_id)``.  A new
batch is merge-joined with the runs; exact copies of an earlier text are settled by
text hashes beforehand and stay out of the index; only windows whose fingerprint is in another
document too are then verified by 96-bit hashes of their whole word sequences, taken
from the texts, on both sides.  When ``fan_out`` runs of a level have come together
they are compacted into one sorted run of the next level.

Batches must come in ascending order of doc_id: history then has the smaller ids.

Defined results: null and empty texts have no words; a document without an id is
never cut and never counts as an earlier one; rows with an equal id don't cut each
other; what the windows of a document cover is judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from . import textkernel as tk

WINDOW = 13
PART = 5
_R = 0xC2B2AE3D27D4EB4F


def fingerprints(c: tk.Chunk, window: int = WINDOW, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window starts, and the windows' fingerprints."""
    m = len(c.hashes)
    if m < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = np.zeros(m - part + 1, dtype=np.uint64)
    for j in range(part):
        h = h * np.uint64(tk._Q) + c.hashes[j : m - part + 1 + j]
    h = tk.mix(h)
    span, width = window - part + 1, 1
    low = h
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    doc = c.doc_of_word
    at = np.arange(m - window + 1)
    at = at[doc[at] == doc[at + window - 1]]
    return at, low[at]


def window_hashes(c: tk.Chunk, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 more bits of the windows that start at ``at``."""
    one = tk.span_hash(tk.prefix_sum(c.hashes, tk._Q), at, at + window, tk._Q)
    two = tk.span_hash(tk.prefix_sum(c.hashes, _R), at, at + window, _R)
    return one, (two >> np.uint64(33)).astype(np.int32)


def postings(docs: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """(fp, doc_id): the fingerprints of each document's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for c in tk.chunks(b.column(1)):
                at, fp = fingerprints(c, window, part)
                doc = c.doc_of_word[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(fp[new].view(np.int64)), pa.array(ids[c.rows[doc[new]]].astype(np.int64))], ["fp", "doc_id"])

    known = storage.text_batches(docs).where(F.col("doc_id").isNotNull())
    return known.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "fp long, doc_id long")


def _windows(docs: DataFrame, window: int, part: int) -> DataFrame:
    """Verified windows of ``docs`` (doc_id, text, fps: the fingerprints to look at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            of = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            fps = b.column(2)
            flat = fps.values.to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = fps.offsets.to_numpy()
            for c in tk.chunks(b.column(1)):
                at, fp = fingerprints(c, window, part)
                doc = c.doc_of_word[at]
                # Wanted pairs of document and fingerprint, as one mixed key each.
                lo, hi = offsets[c.rows[0]], offsets[c.rows[-1] + 1]
                owner = np.repeat(np.arange(len(c.rows)), np.diff(offsets[c.rows[0] : c.rows[-1] + 2]))
                wanted = np.sort(flat[lo:hi] ^ tk.mix(owner.astype(np.uint64) + np.uint64(1)))
                key = fp ^ tk.mix(doc.astype(np.uint64) + np.uint64(1))
                if len(wanted):
                    near = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    ok = wanted[near] == key
                else:
                    ok = np.zeros(len(key), dtype=bool)
                at, doc = at[ok], doc[ok]
                one, two = window_hashes(c, at, window)
                place = (of[c.rows[doc]] << 32) | (at - c.word_bounds[doc])
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two), pa.array(ids[c.rows[doc]]), pa.array(place)], ["h1", "h2", "doc_id", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text", "fps", _text_key("text").alias("of")).mapInArrow(run, "h1 long, h2 int, doc_id long, place long")


def _text_key(text: str):
    """31 bits that tell apart texts under one id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 31) - 1))


def _texts(docs: DataFrame) -> DataFrame:
    """(t1, t2, doc_id): 128-bit text hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.where("doc_id is not null").select(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(3), text).alias("t2"), F.col("doc_id").cast("long").alias("doc_id"))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t1"))


@dataclass
class FingerprintIndex:
    """Runs by level; ``history`` holds the documents behind them, for verification."""

    spark: SparkSession
    window: int = WINDOW
    part: int = PART
    fan_out: int = 4
    runs: list[tuple[int, str]] = field(default_factory=list)
    texts: DataFrame | None = None
    history: DataFrame | None = None

    def _write(self, rows: DataFrame, level: int) -> str:
        path = storage.new_path(self.spark, f"run{level}")
        rows.repartition("fp").sortWithinPartitions("fp").write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("fp long, doc_id long").parquet(path)

    def _copies(self, batch: DataFrame, low: int) -> DataFrame:
        """(doc_id, t1) of the batch's documents whose text an earlier document has."""
        every = _texts(batch) if self.texts is None else self.texts.unionByName(_texts(batch))
        self.texts = storage.materialise(every, "texts")
        first = self.texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
        first = storage.materialise(first.drop("last"), "first")
        return storage.materialise(self.texts.join(first, ["t1", "t2"]).where((F.col("doc_id") > F.col("rep")) & (F.col("doc_id") >= F.lit(low))).select("doc_id", "t1").distinct(), "copies")

    def ingest(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add a batch; (doc_id, of, starts), the windows of its documents that an earlier document has
        too, and (doc_id, t1), its documents that are copies of an earlier text as a whole."""
        low = batch.agg(F.min("doc_id")).first()[0]
        low = 0 if low is None else int(low)
        copies = self._copies(batch, low)
        # Spark broadcasts the copies' ids while they are small and sorts and merges beyond that.
        own = _hashed(batch).join(copies, ["doc_id", "t1"], "left_anti").select("doc_id", "text")
        old = [self._read(p) for _, p in self.runs]
        path = self._write(postings(own, self.window, self.part), 0)
        self.runs.append((0, path))
        storage.release(self.spark)
        new = self._read(path)
        touched = new.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        shared, every = touched.where("lo < hi").select("fp"), new
        if old:
            before = old[0]
            for run in old[1:]:
                before = before.unionByName(run)
            met = storage.materialise(before.join(new.select("fp").hint("merge"), "fp", "left_semi"), "met")
            shared, every = shared.union(met.select("fp")).distinct(), new.unionByName(met)
        wanted = storage.materialise(every.join(shared.hint("merge"), "fp", "left_semi").groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "wanted")
        storage.release(self.spark)
        docs = own if self.history is None else self.history.unionByName(own)
        windows = storage.new_path(self.spark, "windows")
        seen = storage.materialise(_windows(docs.join(wanted, "doc_id"), self.window, self.part), "windows", windows)
        storage.release(self.spark)
        firsts = seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        # A table of its own, so that both sides of the join are plain shuffles and Spark can split a hot window.
        firsts = storage.materialise(firsts.drop("last"), "firsts")
        storage.release(self.spark)
        later = seen.where(F.col("doc_id") >= F.lit(low)).join(firsts, ["h1", "h2"]).where("doc_id > first")
        cut = later.groupBy("doc_id", F.shiftright("place", 32).alias("of")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("starts"))
        out = storage.materialise(cut, "cuts")
        storage.drop(self.spark, windows)
        storage.release(self.spark)
        self.history = docs
        self.compact()
        return out, copies

    def compact(self) -> None:
        """Merge the runs of each level that has ``fan_out`` of them into one sorted run of the next."""
        level = 0
        while level <= max((n for n, _ in self.runs), default=-1):
            same = [p for n, p in self.runs if n == level]
            if len(same) >= self.fan_out:
                rows = self._read(same[0])
                for p in same[1:]:
                    rows = rows.unionByName(self._read(p))
                merged = self._write(rows, level + 1)
                self.runs = [(n, p) for n, p in self.runs if n != level] + [(level + 1, merged)]
                for p in same:
                    storage.drop(self.spark, p)
                storage.release(self.spark)
            level += 1


def batches(docs: DataFrame, n: int) -> list[DataFrame]:
    """``docs`` in ``n`` ranges of doc_id, ascending."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None or n < 2:
        return [docs]
    cuts = [low + (high - low + 1) * i // n for i in range(1, n)]
    known = F.coalesce(F.col("doc_id"), F.lit(low))
    return [docs.where((known >= a if a is not None else F.lit(True)) & (known < b if b is not None else F.lit(True))) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]


def _with_cuts(docs: DataFrame, n_batches: int, window: int) -> DataFrame:
    """``docs`` ingested in batches, plus ``__starts`` (windows to remove; all of them for a copy)."""
    index = FingerprintIndex(docs.sparkSession, window)
    cuts, copies = None, None
    for b in batches(docs, n_batches):
        cut, copy = index.ingest(b.select("doc_id", "text"))
        cuts = cut if cuts is None else cuts.unionByName(cut)
        copies = copy if copies is None else copies.unionByName(copy)
    whole = copies.select("doc_id", F.col("t1").bitwiseAND(F.lit((1 << 31) - 1)).alias("of"), F.array(F.lit(-1)).alias("starts"))
    gone = cuts.unionByName(whole).withColumnsRenamed({"doc_id": "__id", "of": "__of", "starts": "__starts"})
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (_text_key("text") == F.col("__of")), "left")


def _kept(text: str | None, starts: list[int] | None, window: int) -> tuple[int, list[bytes]]:
    words = (text or "").encode().split()
    if not starts:
        return len(words), words
    if starts[0] < 0:
        return len(words), words if len(words) < window else []
    gone = tk.covered(len(words), np.asarray(starts, dtype=np.int64), window)
    return len(words), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def report(docs: DataFrame, n_batches: int = 2, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    rows = _with_cuts(docs.select("doc_id", "text"), n_batches, window).select("doc_id", "text", "__starts")
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            got = []
            for text, starts in zip(b.column(1), b.column(2), strict=True):
                n, kept = _kept(text.as_py(), starts.as_py(), window)
                got.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            cols = list(zip(*got, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, f"doc_id {key}, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, n_batches: int = 2, window: int = WINDOW) -> DataFrame:
    """``docs`` without the covered words (a cut text's other words are joined by one space)."""
    names = docs.columns
    rows = _with_cuts(docs, n_batches, window).select(*names, "__starts")
    at = names.index("text")
    schema = storage.fields_of(docs)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            texts = [t if not s else b" ".join(_kept(t, s, window)[1]).decode() for t, s in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            cols = list(b.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, schema)
