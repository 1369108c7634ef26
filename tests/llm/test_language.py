import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmeter.llm import language

from .fixtures import awkward, frame, plain

SF = "/root/testdata/sf0.01"


def plain_sums(texts, table, bits):
    """The same by a loop over words."""
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), dtype=int)
    for i, t in enumerate(texts):
        data = bytes(language.normal(np.frombuffer(b" " + t + b" ", dtype=np.uint8)))
        for word in data.split():
            padded = np.frombuffer(b" " + word + b" ", dtype=np.uint8)
            for bucket, fits in language.grams(padded, bits):
                assert fits.all()
                total[i] += table[bucket].sum(axis=0)
                count[i] += len(bucket)
    return total, count


def test_sums_by_words(monkeypatch):
    monkeypatch.setattr(language, "STEP", 50)  # texts are cut many times
    table = np.random.default_rng(0).normal(size=(256, 3)).astype(np.float32)
    texts = [r[1].encode() for r in awkward() if r[1] is not None and len(r[1]) < 10_000]
    total, count = language.sums(texts, table, 8)
    want, n = plain_sums(texts, table, 8)
    assert (count == n).all() and np.allclose(total, want, atol=1e-2)


@pytest.fixture(scope="module")
def model(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, language.fit(docs)


def test_held_out_accuracy(model):
    docs, m = model
    rows = language.predict(docs, m, ("doc_id", "lang")).where(language.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98
    assert np.mean([r["accepted"] for r in rows]) > 0.98
    right = np.array([r["lang"] == r["lang_pred"] for r in rows], dtype=float)
    assert abs(np.mean([r["score"] for r in rows]) - right.mean()) < 0.02


def test_short_and_foreign(spark, model):
    docs, m = model
    words = docs.where(language.held_out(F.col("doc_id"))).select("lang", F.explode(F.split(F.substring("text", 1, 3000), r"\s+")).alias("w")).where("w rlike '^[a-zà-ÿ]{6,}$'")
    rows = language.predict(words.select("lang", F.col("w").alias("text")), m, ("lang",)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9  # single words
    strange = plain(spark, [(1, "你好世界 这是一个测试"), (2, "xkcdq zzvqj wqpxz kjhgf qqwrt"), (3, "Съешь же ещё этих мягких")])
    assert not any(r["accepted"] for r in language.predict(strange, m).collect())


def test_defined_cases(spark, model):
    rows = {r["doc_id"]: r for r in language.predict(plain(spark, [(1, None), (2, ""), (3, "12 ## 34"), (4, "the and of"), (None, "the and of")]), model[1]).collect()}
    for i in (1, 2, 3):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["accepted"]) == ("und", 0.0, False)
    assert rows[4]["lang_pred"] == rows[None]["lang_pred"] == "en" and 0 <= rows[4]["score"] <= 1


def test_layout_and_leakage(spark, model):
    """The model is the same on any layout, and neither held-out labels nor sources, nor ids beyond the split, change it."""
    docs, m = model
    other = docs.repartition(11).withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    again = language.fit(other)
    assert again.labels == m.labels and (again.table == m.table).all() and again.limit == m.limit and (again.scale == m.scale).all()


def test_awkward_and_empty_tables(spark):
    small = language.Settings(docs=20, calibration=20, epochs=1)
    df = language.identify(frame(spark), small)
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score", "accepted"] and df.count() == len(awkward())
    none = language.identify(plain(spark, []), small)
    assert none.count() == 0
    unlabelled = plain(spark, [(1, "some text")]).withColumn("lang", F.lit(None).cast("string"))
    assert [r["lang_pred"] for r in language.identify(unlabelled, small).collect()] == ["und"]
    with pytest.raises(ValueError):
        language.predict(frame(spark).withColumn("score", F.lit(1)), language.fit(frame(spark), small), ("doc_id", "score"))
