import corpus_pipeline
from stackmeter.llm import storage

from .fixtures import plain, prose


def test_stages_on_planted_documents(spark, tmp_path):
    clean = {i: prose(200, 700 + i, 100_000) for i in range(12)}
    item, line = prose(25, 1, 100_000), "this line stands in several documents"
    docs = dict(clean)
    docs |= {20: clean[0], 21: " ".join(clean[1].split(" ")[:-4]), 22: "spam spam spam " * 40, 23: prose(120, 5, 100_000) + " " + item + " " + prose(50, 6, 100_000), 24: clean[2] + "\n" + line, 25: prose(150, 9, 100_000) + "\n" + line, 26: None, 27: item * 3}
    plain(spark, list(docs.items())).drop("start", "size").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = got.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = storage.materialise(stage(spark, got, str(tmp_path)), name)
        assert got.columns == columns
    kept = {r.doc_id: r.text for r in got.collect()}
    assert set(clean) | {23, 24, 25} == set(kept) and kept[24] == line
    assert item not in kept[23] and line not in kept[25] and all(kept[i] == t for i, t in clean.items())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept)
