"""MinHash near-deduplication by improved consistent weighted sampling (operator 4).

Shingles are five normalised words (fewer, if the text has fewer).  A shingle weighs its
count in the text times its inverse document frequency, ``1 + ln((1 + N) / (1 + df))``,
df being the rows that have it and N all rows, copies included, so that neither depends
on how rows are laid out.  A frequency of a few rows says little about how common a
shingle is, so each is drawn towards the mean ``m`` of the document's shared shingles, the
more the fewer rows it rests on: ``m + (idf - m) * (df - 1) / (df - 1 + PRIOR)``.  A
shingle of one row alone weighs ``m``.  (Without that, the edits of a copy in a large group
would weigh several times what the group shares: with 2000 near copies among 50,000 rows
an edit would weigh 2.6 times a common shingle, and copies with a plain similarity of 0.9
would fall below 0.8.  The README has the figures against plain TF-IDF.)  The steps:

1. Document frequencies.  Each task sorts the distinct shingle hashes of a chunk of
   documents and sends every bucket one packed blob of them; a bucket counts its
   hashes and returns, packed by chunk, those in two or more rows.
2. All other shingles can match nothing, so they enter a document's vector as one
   private element of their summed weight, which leaves every weighted Jaccard
   similarity and every sampling probability as it is.  A document with less than
   ``THRESHOLD`` of its weight in shared shingles can have no partner and needs no sample.
3. Improved consistent weighted sampling (Ioffe): ``BANDS * ROWS`` samples, banded.
4. Candidates: each bucket's members with its least member and with their neighbours
   in the order of the remaining samples, verified by exact weighted Jaccard similarity.
   This joins most of a bucket for a few pairs a member.
5. The rest: in buckets whose members are not yet in one component, every pair of two
   components is verified too; small buckets as pairs, others as cells of two bounded
   blocks, whose similarities are a matrix product.  So every similar pair that shares
   a bucket ends in one class.
6. Classes are the connected components of the verified links together with exact copies.

Copies of one text are one representative (the least id) from step 4 on.  Those that stand in
one batch of rows go through step 1 once, with their number.

Defined results: a null text is an empty one; texts without words are alike only if
equal; rows that share an id share a class; a row without an id has no class and is
kept; a class is named by its least id; ids are integers (others must be cast); a text of any
length is one set of shingles, held by one task; an empty table gives no classes; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from . import textkernel as tk

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4
#: Rows beyond the first that must share a shingle for its frequency to count half; steps on which ``m`` lies, so that weights recur.
PRIOR, GRID = 3, 0.5
#: Bytes of texts whose shingles one bucket counts.
BUCKET_BYTES = 4_000_000
SEED = 20_240_607
#: Members up to which the rest of a bucket goes as pairs; members and bytes of hashes of a block of a larger one.
FEW, BLOCK, BLOCK_BYTES = 32, 1024, 16_000_000
_LOW = np.uint64((1 << 48) - 1)


def shingles(c: tk.Chunk, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document (in the chunk) and hash of every shingle; a text of fewer than n words has one."""
    at, h = tk.ngrams(c, n)
    doc = c.doc_of_word[at]
    short = np.flatnonzero((c.n_words > 0) & (c.n_words < n))
    if len(short):
        lo, hi = c.word_bounds[short], c.word_bounds[short + 1]
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, tk.span_hash(tk.prefix_sum(c.hashes, tk._Q), lo, hi, tk._Q)])
    return doc, h


def _counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) in the order of the hashes, and how often each occurs."""
    order = np.argsort(h, kind="stable")
    d, k = doc[order], h[order]
    # Stable: equal hashes keep the documents' order if ``doc`` ascends; short texts stand last but have their own hashes.
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return d[first], k[first], np.diff(np.append(first, len(k)))


def _distinct(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Of equal texts in a batch the row with the least id, and how many rows it stands for."""
    ids = b.column(0).to_numpy(zero_copy_only=False)
    text = b.column(1).fill_null("").dictionary_encode().indices.to_numpy()
    order = np.lexsort((ids, text))
    first = np.flatnonzero(np.append(True, text[order][1:] != text[order][:-1])[: len(order)])
    times = np.diff(np.append(first, len(order)))
    place = np.argsort(order[first])
    return b.take(pa.array(order[first][place])), times[place]


def _blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, docs, sizes, index, low, high, tf, many): packed shingle hashes of a chunk of documents.

    One row of each chunk has its document ids and numbers of shingles; the others point into it.  ``many`` has the rows
    that an entry's text stands for, if one stands for more than itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            b, many = _distinct(b)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for c in tk.chunks(b.column(1), lower=True, accept=tk.NORMAL):
                doc, h = shingles(c)
                total = np.bincount(doc, minlength=len(c.rows)).astype(np.uint32)
                d, k, tf = _counted(doc, h)
                bucket = ((k * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
                rows_of = many[c.rows].astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                wide = np.uint32 if len(c.rows) > 65535 else np.uint16
                rows = [(chunk % buckets, chunk, ids[c.rows].tobytes(), total.tobytes(), b"", b"", b"", b"", b"")]
                for x in np.flatnonzero(np.diff(edges)).tolist():
                    part = order[edges[x] : edges[x + 1]]
                    low = k[part] & _LOW
                    counts = b"" if (tf[part] == 1).all() else tf[part].astype(np.uint32).tobytes()
                    rows.append((x, chunk, b"", b"", d[part].astype(wide).tobytes(), (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), (low >> np.uint64(32)).astype(np.uint16).tobytes(), counts, rows_of[d[part]].tobytes() if (rows_of > 1).any() else b""))
                chunk += 1
                cols = list(zip(*rows, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())] + [pa.array(x, pa.binary()) for x in cols[2:]], ["bucket", "chunk", "docs", "sizes", "index", "low", "high", "tf", "many"])

    known = storage.text_batches(docs).where(F.col("doc_id").isNotNull())
    return known.select(F.col("doc_id").cast("long"), "text").mapInArrow(storage.lean(run), "bucket long, chunk long, docs binary, sizes binary, index binary, low binary, high binary, tf binary, many binary")


def _unpack(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per entry of some blobs the hash and the rows it stands for, and where each blob begins; the rest stays packed."""
    low, many, size = [], [], []
    for _, _, _, _, lo, hi, _, times in parts:
        low.append(np.frombuffer(lo, dtype=np.uint32).astype(np.uint64) | np.frombuffer(hi, dtype=np.uint16).astype(np.uint64) << np.uint64(32))
        many.append(np.frombuffer(times, dtype=np.uint32) if times else np.ones(len(low[-1]), dtype=np.uint32))
        size.append(len(low[-1]))
    return np.concatenate(low), np.concatenate(many), np.append(0, np.cumsum(size))


def _index(packed: bytes, entries: int) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint16 if len(packed) == 2 * entries else np.uint32)


def _shared(blobs: DataFrame) -> DataFrame:
    """(chunk, bucket, docs, sizes, index, low, high, df, tf): packed entries of shingles that two or more rows have."""
    names = ["chunk", "bucket", "docs", "sizes", "index", "low", "high", "df", "tf"]

    def count(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
        low, many, edges = _unpack(parts)
        order = np.argsort(low, kind="stable")
        k = low[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, dtype=np.int64)
        times = np.diff(np.append(first, len(k)))
        df = np.empty(len(k), dtype=np.int64)
        if len(k):
            df[order] = np.repeat(np.add.reduceat(many[order].astype(np.int64), first), times)
        rows = []
        for n, (chunk, docs, sizes, index, lo, hi, counts, _) in enumerate(parts):
            if docs:
                rows.append((chunk, bucket, docs, sizes, b"", b"", b"", b"", b""))
                continue
            own = slice(edges[n], edges[n + 1])
            keep = df[own] > 1
            if keep.any():
                kept = [np.frombuffer(x, dtype=t)[keep].tobytes() for x, t in ((lo, np.uint32), (hi, np.uint16))]
                rows.append((chunk, bucket, b"", b"", _index(index, len(keep))[keep].tobytes(), *kept, np.minimum(df[own][keep], 2**32 - 1).astype(np.uint32).tobytes(), np.frombuffer(counts, dtype=np.uint32)[keep].tobytes() if counts else b""))
        cols = list(zip(*rows, strict=True)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())] + [pa.array(x, pa.binary()) for x in cols[2:]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts = -1, []
        for b in batches:
            for row in zip(*(b.column(j).to_pylist() for j in range(9)), strict=True):
                if row[0] != bucket and parts:
                    yield count(bucket, parts)
                    parts = []
                bucket = row[0]
                parts.append(row[1:])
        if parts:
            yield count(bucket, parts)

    return blobs.mapInArrow(storage.lean(run), "chunk long, bucket long, docs binary, sizes binary, index binary, low binary, high binary, df binary, tf binary")


def _entries(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """Ids, sizes, hashes, document frequencies and counts of a chunk's entries, by document."""
    head = next(r for r in rows if r["docs"])
    docs, sizes = np.frombuffer(head["docs"], dtype=np.int64), np.frombuffer(head["sizes"], dtype=np.uint32)
    at, h, df, tf = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)], [np.zeros(0)], [np.zeros(0)]
    for r in rows:
        if r["docs"]:
            continue
        df.append(np.frombuffer(r["df"], dtype=np.uint32).astype(np.float64))
        at.append(_index(r["index"], len(df[-1])).astype(np.int64))
        high = np.frombuffer(r["high"], dtype=np.uint16).astype(np.uint64) << np.uint64(32)
        # 48 bits tell a bucket's shingles apart, with the bucket's number all of them.
        h.append(tk.mix((np.frombuffer(r["low"], dtype=np.uint32).astype(np.uint64) | high) + tk.mix(np.array([r["bucket"]], dtype=np.uint64) + np.uint64(1))))
        tf.append(np.frombuffer(r["tf"], dtype=np.uint32).astype(np.float64) if r["tf"] else np.ones(len(df[-1])))
    at, h, df, tf = (np.concatenate(x) for x in (at, h, df, tf))
    order = np.argsort(at, kind="stable")
    at = at[order]
    return docs[at], sizes[at], h[order], df[order], tf[order], at


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return 1 + np.log((1 + n_docs) / (1 + np.minimum(df, n_docs)))


def weights(tf: np.ndarray, df: np.ndarray, n_docs: int) -> tuple[np.ndarray, float]:
    """Weights of a document's shared shingles, and what one that no other row has weighs."""
    plain = idf(df, n_docs)
    mean = max(GRID, round(float((tf * plain).sum() / max(tf.sum(), 1)) / GRID) * GRID)
    return tf * (mean + (plain - mean) * (df - 1) / (df - 1 + PRIOR)), mean


def _uniform(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1) from mixed 64-bit values."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def samples(h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """``n`` improved consistent weighted samples of a weighted set: 64-bit digests of (element, level)."""
    out = np.empty(n, dtype=np.uint64)
    logs = np.log(w)
    # Five mixed values for each element and sample give the two Gamma(2, 1) variables and the offset.
    for at in range(0, n, max(1, 200_000 // max(1, len(h)))):
        to = min(n, at + max(1, 200_000 // max(1, len(h))))
        seeds = tk.mix(np.arange(at, to, dtype=np.uint64) + np.uint64(SEED))[:, None]
        base = tk.mix(h[None, :] ^ seeds)
        u = [_uniform(tk.mix(base + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))) for j in range(5)]
        r = -np.log(u[0] * u[1])
        c = -np.log(u[2] * u[3])
        t = np.floor(logs[None, :] / r + u[4])
        score = np.log(c) - r * (t - u[4] + 1)
        best = score.argmin(axis=1)
        rows = np.arange(to - at)
        out[at:to] = tk.mix(h[best] ^ tk.mix(t[rows, best].astype(np.int64).view(np.uint64) + np.uint64(77)))
    return out


def _vectors(shared: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, total, hashes, weights, keys, order) of documents with enough shared weight."""
    fields = "doc_id long, total double, hashes binary, weights binary, keys array<long>, order array<long>"

    def vector(doc: int, size: int, h: np.ndarray, df: np.ndarray, tf: np.ndarray) -> tuple | None:
        w, one = weights(tf, df, n_docs)
        alone = (size - tf.sum()) * one
        total = float(w.sum() + alone)
        if w.sum() < THRESHOLD * total * (1 - 1e-9):
            return None
        order = np.argsort(h)
        h, w = h[order], w[order]
        private = tk.mix(np.array([doc], dtype=np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
        got = samples(np.append(h, private), np.append(w, alone), BANDS * ROWS) if alone > 0 else samples(h, w, BANDS * ROWS)
        bands = tk.span_hash(tk.prefix_sum(got, tk._Q), np.arange(BANDS) * ROWS, np.arange(1, BANDS + 1) * ROWS, tk._Q)
        bands = tk.mix(bands + np.arange(BANDS, dtype=np.uint64))
        return doc, total, h.tobytes(), w.astype(np.float32).tobytes(), bands.view(np.int64).tolist(), np.roll(got, -1)[::ROWS].view(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for b in batches:
            for chunk in b.column(1):  # one chunk at a time
                ids, sizes, h, df, tf, at = _entries(chunk.as_py())
                edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
                stops = np.append(edges[1:], len(at)) if len(at) else edges
                made = [vector(int(ids[a]), int(sizes[a]), h[a:z], df[a:z], tf[a:z]) for a, z in zip(edges.tolist(), stops.tolist(), strict=True)]
                rows = [v for v in made if v is not None]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], [x.split(" ")[0] for x in fields.split(", ")])

    by_chunk = shared.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "docs", "sizes", "index", "low", "high", "df", "tf")).alias("rows"))
    return by_chunk.mapInArrow(storage.lean(run), fields)


def _bands(vectors: DataFrame) -> DataFrame:
    """(key, next, doc_id, size): each document in its buckets, with one further sample and the bytes of its hashes."""
    rows = vectors.select("doc_id", F.posexplode("keys").alias("band", "key"), "order", F.octet_length("hashes").alias("size"))
    return storage.materialise(rows.select("key", F.col("order")[(F.col("band") + 1) % BANDS].alias("next"), "doc_id", "size"), "bands")


def _candidates(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: members of a bucket with its least member, and neighbours in sample order."""
    buckets = rows.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # A table of its own, so that both sides of the join are plain shuffles and Spark can split a hot bucket.
    members = rows.join(storage.materialise(buckets.drop("n"), "buckets"), "key")
    star = members.where("doc_id > a").select("a", F.col("doc_id").alias("b"))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            key, doc = (b.column(j).to_numpy(zero_copy_only=False) for j in (0, 2))
            if last is not None:
                key, doc = np.append(last[0], key), np.append(last[1], doc)
            same = (key[1:] == key[:-1]) & (doc[1:] != doc[:-1])
            if len(key):
                last = (key[-1], doc[-1])
            one, two = doc[:-1][same], doc[1:][same]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])

    near = rows.drop("size").repartitionByRange("key", "next", "doc_id").sortWithinPartitions("key", "next", "doc_id").mapInArrow(storage.lean(neighbours), "a long, b long")
    return star.union(near).distinct()


def _verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs whose exact weighted Jaccard similarity reaches the threshold."""
    side = vectors.select("doc_id", "total", "hashes", "weights")
    both = pairs.join(side.toDF("a", "ta", "ha", "wa"), "a").join(side.toDF("b", "tb", "hb", "wb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keep, value = [], []
                for ta, ha, wa, tb, hb, wb in zip(*(part.column(j).to_pylist() for j in range(2, 8)), strict=True):
                    h1, h2 = np.frombuffer(ha, dtype=np.uint64), np.frombuffer(hb, dtype=np.uint64)
                    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
                    common = float(np.minimum(np.frombuffer(wa, dtype=np.float32)[i], np.frombuffer(wb, dtype=np.float32)[j]).sum(dtype=np.float64))
                    value.append(common / max(ta + tb - common, 1e-9))
                    keep.append(value[-1] >= THRESHOLD - 1e-6)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(value, pa.float64())], ["a", "b", "similarity"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "ha", "wa", "tb", "hb", "wb").mapInArrow(storage.lean(run), "a long, b long, similarity double")


def _overlaps(hashes: list[bytes], weights: list[bytes]) -> np.ndarray:
    """For each two documents the sum over their common shingles of the lesser weight."""
    n = len(hashes)
    h, w = np.frombuffer(b"".join(hashes), dtype=np.uint64), np.frombuffer(b"".join(weights), dtype=np.float32).astype(np.float64)
    row = np.repeat(np.arange(n), [len(x) // 8 for x in hashes])
    order = np.lexsort((w, h))
    h, w, row = h[order], w[order], row[order]
    out = np.zeros((n, n))
    if not len(h):
        return out
    new_h = np.append(True, h[1:] != h[:-1])
    new = new_h | np.append(True, w[1:] != w[:-1])
    # A column is a shingle and one of its weights; it counts what that weight has over the next lesser one,
    # and a document stands in the columns up to its own weight.
    col, first = np.cumsum(new) - 1, np.flatnonzero(new)
    step = np.where(new_h[first], w[first], w[first] - np.append(0, w[first][:-1]))
    lowest = col[np.flatnonzero(new_h)][np.cumsum(new_h) - 1]
    times = col - lowest + 1
    row = np.repeat(row, times)
    col = np.repeat(lowest, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    # Columns of one document add nothing.
    used = np.bincount(col, minlength=len(step)) > 1
    row, col, step = row[used[col]], (np.cumsum(used) - 1)[col[used[col]]], step[used]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for at in range(0, len(step), 2048):
        a, z = np.searchsorted(col, [at, at + 2048])
        m = np.zeros((n, min(2048, len(step) - at)))
        m[row[a:z], col[a:z] - at] = 1
        out += (m * step[at : at + 2048]) @ m.T
    return out


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric table of links."""
    left, found = near.any(axis=1), []
    while left.any():
        queue = [int(left.argmax())]
        left[queue[0]] = False
        while queue:
            i = queue.pop()
            more = np.flatnonzero(near[i] & left).tolist()
            left[more] = False
            found += [(i, j) for j in more]
            queue += more
    return found


def _cells(members: DataFrame, parts: DataFrame, buckets: DataFrame) -> DataFrame:
    """(cell, doc_id, label): members of large buckets, so dealt that each two of different labels meet in a cell.

    A label with a full block of members has blocks of its own, which do not meet each other; all other
    members of the bucket share blocks.
    """
    full = (F.col("n") >= BLOCK) | (F.col("bytes") >= BLOCK_BYTES)
    held = parts.where(full).select("key", "label", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("own"))
    held = storage.materialise(held.join(buckets.select("key"), "key", "left_semi"), "held")
    others = parts.where(~full).groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    others = others.select("key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).alias("shared"))
    block = lambda label, at: F.struct(label.alias("label"), at.cast("long").alias("at"))
    of_label = held.groupBy("key").agg(F.flatten(F.collect_list(F.transform(F.sequence(F.lit(0).cast("long"), F.col("own") - 1), lambda x: block(F.col("label"), x)))).alias("blocks"))
    none = F.lit(None).cast("long")
    shared = F.when(F.col("shared") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("shared") - 1), lambda x: block(none, x)))
    met = buckets.select("key").join(others, "key", "left").join(of_label, "key", "left")
    met = storage.materialise(met.select("key", "shared", F.concat(*[F.coalesce(x, F.array().cast("array<struct<label:bigint,at:bigint>>")) for x in (shared, F.col("blocks"))]).alias("blocks")), "blocks")
    placed = members.join(met, "key").join(held, ["key", "label"], "left")
    mine = block(F.when(F.col("own").isNotNull(), F.col("label")), F.pmod(F.xxhash64("doc_id"), F.coalesce("own", "shared")))
    placed = placed.withColumn("mine", mine)
    partner = F.filter("blocks", lambda x: ~x.eqNullSafe(F.col("mine")) & (x["label"].isNull() | ~x["label"].eqNullSafe(F.col("mine.label"))))
    placed = placed.select("key", "doc_id", "label", "mine", F.explode(F.when(F.size("blocks") == 1, F.col("blocks")).otherwise(partner)).alias("other"))
    name = [F.concat_ws(":", F.coalesce(F.col(x)["label"].cast("string"), F.lit("")), F.col(x)["at"]) for x in ("mine", "other")]
    return placed.select(F.concat_ws("/", F.col("key"), F.least(*name), F.greatest(*name)).alias("cell"), "doc_id", "label")


def _rest(bands: DataFrame, pairs: DataFrame, labels: DataFrame, vectors: DataFrame) -> DataFrame:
    """Verified links (a, b, similarity) that join all similar members of a bucket which ``labels`` keeps apart."""
    named = bands.join(labels, "doc_id", "left").select("key", "doc_id", "size", F.coalesce("class_id", "doc_id").alias("label"))
    named = storage.materialise(named, "named")
    parts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    # The one pair of a bucket of two has been verified.
    buckets = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1 and n > 2")
    buckets = storage.materialise(buckets, "buckets")
    few = named.join(buckets.where(F.col("n") <= FEW).select("key"), "key").select("key", "doc_id", "label")
    both = few.toDF("key", "a", "la").join(few.toDF("key", "b", "lb"), "key").where("a < b and la <> lb").select("a", "b").distinct()
    found = storage.materialise(_verified(both.join(pairs, ["a", "b"], "left_anti"), vectors), "verified")
    large = storage.materialise(buckets.where(F.col("n") > FEW).select("key"), "large")
    if not large.head(1):
        return found
    members = named.join(large, "key").select("key", "doc_id", "label")
    cells = storage.materialise(_cells(members, parts.join(large, "key", "left_semi"), large), "cells")

    def linked(rows: list[tuple]) -> pa.RecordBatch:
        docs, labels, totals, hashes, weights = zip(*rows, strict=True)
        doc, label, total = np.array(docs), np.array(labels), np.array(totals)
        common = _overlaps(hashes, weights)
        value = common / np.maximum(total[:, None] + total[None, :] - common, 1e-9)
        links = _forest((value >= THRESHOLD - 1e-6) & (label[:, None] != label[None, :]))
        i, j = np.array(links, dtype=np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j])), pa.array(value[i, j])], ["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for b in batches:
            for row in zip(*(b.column(j).to_pylist() for j in range(6)), strict=True):
                if row[0] != cell and rows:
                    yield linked(rows)
                    rows = []
                cell = row[0]
                rows.append(row[1:])
        if rows:
            yield linked(rows)

    full = cells.join(vectors.select("doc_id", "total", "hashes", "weights"), "doc_id").select("cell", "doc_id", "label", "total", "hashes", "weights")
    got = full.repartition("cell").sortWithinPartitions("cell").mapInArrow(storage.lean(run), "a long, b long, similarity double")
    return found.union(storage.materialise(got.dropDuplicates(["a", "b"]), "verified"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, class_id): the least id that is reached over ``edges`` (a, b), by label propagation with
    pointer jumping; one shared table a round, so no lineage grows."""
    spark = edges.sparkSession
    both = storage.materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = storage.materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("class_id")), "labels")
    while True:
        of = labels.withColumnsRenamed({"doc_id": "b", "class_id": "l"})
        seen = both.join(of, "b").groupBy("a").agg(F.min("l").alias("m"))
        met = labels.join(seen.withColumnRenamed("a", "doc_id"), "doc_id", "left").select("doc_id", F.least("class_id", "m").alias("l"), F.col("class_id").alias("was"))
        jump = labels.select(F.col("doc_id").alias("l"), F.col("class_id").alias("up"))
        moved = storage.materialise(met.join(jump, "l", "left").select("doc_id", F.least("l", "up").alias("class_id"), "was"), "labels")
        if not moved.where("class_id < was").head(1):
            return moved.drop("was")
        labels = moved.drop("was")
        storage.release(spark)


def representatives(docs: DataFrame) -> DataFrame:
    """(doc_id, rep): the least id with an equal text, for the documents that are not that one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(3), text).alias("h2"))
    groups = hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep < most")
    groups = storage.materialise(groups.drop("most"), "groups")
    return hashed.join(groups, ["h1", "h2"]).where("doc_id > rep").groupBy("doc_id").agg(F.min("rep").alias("rep"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, links) of every id: the class, and the number of verified links of its text."""
    return storage.alone(docs.sparkSession, "classes", lambda: _classes(docs))


def _classes(docs: DataFrame) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    copies = storage.materialise(representatives(docs), "copies")
    n_docs, size = docs.agg(F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blobs = _blobs(docs, max(1, -(-size // BUCKET_BYTES))).repartition("bucket").sortWithinPartitions("bucket")
    packed = storage.new_path(spark, "shared")
    shared = storage.materialise(_shared(blobs), "shared", packed)
    storage.release(spark)
    vectors = storage.materialise(_vectors(shared, max(1, n_docs)).join(copies.select("doc_id"), "doc_id", "left_anti"), "vectors")
    storage.drop(spark, packed)
    storage.release(spark)
    bands = _bands(vectors)
    pairs = storage.materialise(_candidates(bands), "candidates")
    # First each document with the least of its partners; then what that did not already join.
    best = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = storage.materialise(_verified(best, vectors), "verified")
    root = first.select(F.col("b").alias("doc"), F.col("a").alias("root"))
    rest = (
        pairs.join(best, ["a", "b"], "left_anti")
        .join(root.toDF("a", "ra"), "a", "left")
        .join(root.toDF("b", "rb"), "b", "left")
        .where("coalesce(ra, a) <> coalesce(rb, b)")
        .select("a", "b")
    )
    second = storage.materialise(_verified(rest, vectors), "verified")
    storage.release(spark)
    links = first.union(second)
    joined = components(links)
    more = _rest(bands, pairs, joined, vectors)
    storage.release(spark)
    if more.head(1):
        links = links.union(more)
        joined = components(links)
    degree = links.select("a").union(links.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("links")).withColumnRenamed("a", "rep")
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    out = ids.join(copies, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(joined.withColumnRenamed("doc_id", "rep"), "rep", "left").join(degree, "rep", "left")
    return out.select("doc_id", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class (the least id; of rows with one id, one)."""
    found = classes(docs)
    keep = found.where("doc_id = class_id").select(F.col("doc_id").alias("__keep"))
    first = docs.where("doc_id is not null").join(keep, F.col("doc_id").cast("long") == F.col("__keep"), "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(docs.where("doc_id is null"))


