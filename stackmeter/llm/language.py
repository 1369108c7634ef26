"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text's features are the byte n-grams of its words (2 to 5 bytes, the blank before and after a word included), hashed
into buckets.  Each bucket has an embedding; the mean of a text's embeddings goes through a linear layer and a softmax.
Embeddings and layer are trained together by stochastic gradient descent in numpy, on pieces of labelled texts and on
made-up noise, which has a class of its own.  Once trained, a bucket's share in each class's logit is one row of
``table``, so a prediction is a mean of rows.  Scores are calibrated on other labelled documents as they stand: a scale
for each class of text length, the labels' frequencies as prior, and a limit below which a prediction is not accepted: the least
score above which ``precision`` of the predictions are right, and ``least`` at least.

Learning sees ``text`` and ``lang`` of documents whose crc32(doc_id) mod 4 is not 2 and nothing else.  Bounds, so that
the driver's part does not grow: about ``Settings.docs`` documents a label, ``pieces`` pieces of at most 300 characters
of each, and the logits of about ``calibration`` documents.  Counts of labels cover all documents.  The model has
2**bits rows of one number a label; labels are taken to be a closed set.

Defined results.  A null text and one without a letter (``\\p{L}``) are ``und``, score 0, not accepted; a null id is not
held out and never learned from.  Whole texts are used, a long one a megabyte at a time.  Repeated rows count each time
they occur; ties of two labels go to the smaller one.  A table without labelled documents, the empty one included, gives
a model without labels, which predicts ``und``.  Columns of other names are neither read nor kept, but for ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

UNKNOWN = "und"
#: Lengths of the pieces that are learned from, in characters.
LENGTHS = (12, 40, 120, 300)
SIZES = (2, 3, 4, 5)
#: Upper bounds of the classes of text length, in n-grams.
SPANS = (40, 160, 640, 2560)
#: Scales that calibration tries.
SCALES = np.geomspace(0.25, 16, 37)
#: Bytes of text at a time.
STEP = 1 << 20


@dataclass(frozen=True)
class Settings:
    docs: int = 600
    pieces: int = 4
    calibration: int = 3000
    noise: float = 0.15
    bits: int = 15
    dim: int = 12
    epochs: int = 5
    batch: int = 64
    rate: float = 6.0
    precision: float = 0.99
    least: float = 0.5


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    table: np.ndarray  # buckets x (labels and noise): what a bucket adds to each logit
    bias: np.ndarray
    prior: np.ndarray  # log of the labels' shares and of the noise's
    scale: np.ndarray  # by class of length
    limit: float


_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b if _LETTER[b] else 32 for b in range(256)], dtype=np.uint8)
_CODE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def normal(data: np.ndarray) -> np.ndarray:
    """Letters in lower case (A-Z and the accented letters of two bytes from C3 80 to C3 9E), all else blank."""
    out = _LOWER[data]
    accented = np.flatnonzero(data[:-1] == 0xC3) + 1
    accented = accented[(data[accented] >= 0x80) & (data[accented] <= 0x9E) & (data[accented] != 0x97)]
    out[accented] += 32
    return out


def grams(text: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the bucket of the n-gram at each place of a normalised text, and whether it lies in one word."""
    blank = text == 32
    code = _CODE[text]
    h, inner, some = code, np.zeros(len(text), dtype=bool), ~blank
    for n in range(2, SIZES[-1] + 1):
        m = len(text) - n + 1
        if m <= 0:
            return
        if n > 2:
            inner = inner[:m] | blank[n - 2 : n - 2 + m]
        h = h[:m] * np.uint32(0x01000193) + code[n - 1 :]
        some = some[:m] | ~blank[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        yield (mixed >> np.uint32(32 - bits)).astype(np.int32), some & ~inner[:m]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One array of all texts with blanks between, and where each begins (at the blank before it)."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return normal(data), np.concatenate([[0], np.cumsum(sizes)])


def sums(texts: list[bytes], table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the table's rows over each text's n-grams, and their number."""
    data, bounds = joined(texts)
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=np.int64)
    for start in range(0, int(bounds[-1]), STEP):
        end = min(start + STEP, int(bounds[-1]))
        part = data[start : end + SIZES[-1] - 1]
        first, last = np.searchsorted(bounds, start, "right") - 1, np.searchsorted(bounds, end, "left")
        cuts = np.maximum(bounds[first:last], start) - start
        for bucket, fits in grams(part, bits):
            bucket, fits = bucket[: end - start], fits[: end - start]
            at = cuts[cuts < len(bucket)]  # at the very end of all, a longer n-gram may not begin any more
            if len(at):
                total[first : first + len(at)] += np.add.reduceat(table[bucket] * fits[:, None], at, axis=0, dtype=np.float64)
                count[first : first + len(at)] += np.add.reduceat(fits, at, dtype=np.int64)
    return total, count


def noise(n: int, seed: int) -> list[bytes]:
    """Text of no language: letters drawn evenly from the Latin alphabet, or from a random block of other letters."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        low, span = (97, 26) if rng.random() < 0.5 else (int(rng.integers(0x370, 0x9FF0)), 60)
        size = int(rng.choice(LENGTHS))
        points = low + rng.integers(0, span, size)
        points[rng.random(size) < 1 / 7] = 32
        out.append("".join(map(chr, points)).encode("utf-8"))
    return out


def train(texts: list[bytes], labels: np.ndarray, n_classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``table``, bias) by stochastic gradient descent on cross entropy.

    Embeddings start at nought, so that an n-gram which was never seen adds nothing.
    """
    rng = np.random.default_rng(0)
    found = []
    for t in texts:
        data, _ = joined([t])
        bucket = np.concatenate([b[f] for b, f in grams(data, s.bits)] or [np.zeros(0, dtype=np.int32)])
        found.append(np.unique(bucket, return_counts=True))
    use = np.array([i for i, (b, _) in enumerate(found) if len(b)], dtype=np.int64)
    embedding, layer, bias = np.zeros((1 << s.bits, s.dim)), rng.normal(0, 1, (s.dim, n_classes)), np.zeros(n_classes)
    steps, done = s.epochs * max(1, -(-len(use) // s.batch)), 0
    for _ in range(s.epochs):
        order = rng.permutation(use)
        for at in range(0, len(order), s.batch):
            own = order[at : at + s.batch]
            rate = s.rate * (1 - done / steps)
            done += 1
            bucket = np.concatenate([found[i][0] for i in own])
            weight = np.concatenate([found[i][1] / found[i][1].sum() for i in own])
            cuts = np.cumsum([0, *[len(found[i][0]) for i in own[:-1]]])
            mean = np.add.reduceat(embedding[bucket] * weight[:, None], cuts, axis=0)
            p = softmax(mean @ layer + bias)
            p[np.arange(len(own)), labels[own]] -= 1
            back = (p @ layer.T).repeat(np.diff([*cuts, len(bucket)]), axis=0) * weight[:, None]
            layer -= 0.02 * rate / len(own) * (mean.T @ p)
            bias -= 0.02 * rate / len(own) * p.sum(axis=0)
            for d in range(s.dim):
                embedding[:, d] -= rate * np.bincount(bucket, back[:, d], 1 << s.bits)
    return (embedding @ layer).astype(np.float32), bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scored(model: Model, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Calibrated chances of the labels and of noise."""
    z = total / np.maximum(count, 1)[:, None] + model.bias
    return softmax(z * model.scale[np.searchsorted(SPANS, count, "right")][:, None] + model.prior)


def calibrated(model: Model, total: np.ndarray, count: np.ndarray, truth: np.ndarray, s: Settings) -> Model:
    """The scale of each class of length by least cross entropy; the limit as the least one above which ``precision`` of the predictions are right."""
    scale = model.scale.copy()
    spans = np.searchsorted(SPANS, count, "right")
    z = total / np.maximum(count, 1)[:, None] + model.bias
    for k in range(len(scale)):
        own = spans == k
        if own.sum() >= 20:
            chance = [softmax(z[own] * x + model.prior)[np.arange(own.sum()), truth[own]] for x in SCALES]
            scale[k] = SCALES[int(np.argmin([-np.log(np.maximum(c, 1e-12)).mean() for c in chance]))]
    model = Model(model.labels, model.table, model.bias, model.prior, scale, 0.0)
    p = scored(model, total, count)[:, : len(model.labels)]
    best, score = p.argmax(axis=1), p.max(axis=1)
    order = np.argsort(-score, kind="stable")
    right = np.cumsum((best == truth)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= s.precision)
    limit = max(s.least, float(score[order[good[-1]]])) if len(good) else 1.0
    return Model(model.labels, model.table, model.bias, model.prior, scale, limit)


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned_from(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) that may be learned from."""
    rows = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of a table's labelled documents."""
    s, spark = settings, docs.sparkSession
    known = learned_from(docs)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = tuple(sorted(counts))
    if not labels:
        return Model((), np.zeros((1 << s.bits, 1), dtype=np.float32), np.zeros(1), np.zeros(1), np.ones(len(SPANS) + 1), 1.0)
    all_docs = sum(counts.values())
    # At most half of a label's documents are learned from, so that some are left to calibrate with.
    rates = [(x, min(0.5, s.docs / counts[x]), min(1.0, s.calibration / all_docs)) for x in labels]
    drawn = known.join(F.broadcast(spark.createDataFrame(rates, "lang string, taken double, checked double")), "lang")
    chance = _chance(F.col("doc_id"), F.lit("learn"))

    def piece(k: int) -> Column:
        size = F.element_at(F.array(*map(F.lit, LENGTHS)), (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(len(LENGTHS))) + 1).cast("int"))
        room = F.greatest(F.length("text") - size + 1, F.lit(1))
        return F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(-1 - k)), room) + 1).cast("int"), size)

    rows = drawn.where(chance < F.col("taken")).select("lang", F.array(*map(piece, range(s.pieces))).alias("pieces")).collect()
    rows = sorted((r["lang"], *r["pieces"]) for r in rows)
    texts = [p.encode("utf-8") for r in rows for p in r[1:]]
    truth = [labels.index(r[0]) for r in rows for _ in r[1:]]
    extra = noise(int(s.noise * len(texts)) + 1, 1)
    table, bias = train([*texts, *extra], np.array([*truth, *[len(labels)] * len(extra)]), len(labels) + 1, s)
    share = np.array([*[counts[x] * (1 - s.noise) / all_docs for x in labels], s.noise])
    model = Model(labels, table, bias, np.log(share), np.ones(len(SPANS) + 1), 0.0)

    held = drawn.where((chance >= F.col("taken")) & (_chance(F.col("doc_id"), F.lit("calibrate")) < F.col("checked"))).select("lang", "text")
    width = table.shape[1]

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, count = sums([x.encode("utf-8") for x in b["text"].to_pylist()], table, s.bits)
            yield pa.RecordBatch.from_arrays([b["lang"].cast(pa.string()), pa.array(count), pa.array(list(total), pa.list_(pa.float64()))], ["lang", "count", "total"])

    seen = sorted((r["lang"], r["count"], tuple(r["total"])) for r in storage.text_batches(held).mapInArrow(logits, "lang string, count long, total array<double>").collect())
    other, n_other = sums(noise(int(s.noise * len(seen)) + 1, 2), table, s.bits)
    total = np.concatenate([np.array([r[2] for r in seen]).reshape(-1, width), other])
    count = np.concatenate([np.array([r[1] for r in seen], dtype=np.int64), n_other])
    return calibrated(model, total, count, np.array([*[labels.index(r[0]) for r in seen], *[len(labels)] * len(other)]), s)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score, accepted: one row for each of ``docs``."""
    if clash := {"lang_pred", "score", "accepted", "__text"} & set(keep):
        raise ValueError(f"these columns are results: {sorted(clash)}")
    labels, bits = model.labels, int(model.table.shape[0]).bit_length() - 1
    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    # Every kept column, and the text last; the rest of a row never goes to Python.
    rows = storage.text_batches(docs.select(*keep, (lettered if labels else F.lit(None).cast("string")).alias("__text")))
    fields = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "lang_pred string", "score double", "accepted boolean"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(b.num_columns - 1)
            at = np.flatnonzero(np.asarray(text.is_valid()))
            lang, score = np.full(b.num_rows, UNKNOWN, dtype=object), np.zeros(b.num_rows)
            if len(at):
                p = scored(model, *sums([x.encode("utf-8") for x in text.take(pa.array(at)).to_pylist()], model.table, bits))[:, : len(labels)]
                lang[at], score[at] = np.array(labels, dtype=object)[p.argmax(axis=1)], p.max(axis=1)
            out = [*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array((score >= model.limit) & (lang != UNKNOWN))]
            yield pa.RecordBatch.from_arrays(out, [*b.schema.names[:-1], "lang_pred", "score", "accepted"])

    return rows.mapInArrow(run, ", ".join(fields))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted), the model learned from ``docs`` itself."""
    found = predict(docs, fit(docs, settings))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
