"""The two jobs: growing input, reruns, broken runs, awkward rows, command line settings, and their SQL."""

import json
import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import common, registry, scan_catalogue, tag_register
from stackmeter.plans import outputs

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
PAGES = "page_id long, url string, html string, extra string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(str(folder))


def register(spark, out):
    return sorted((tuple(r) for r in tag_register.result(spark, str(out)).drop("extra").collect()), key=str)


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    result = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    got = df.select(*columns).collect()
    assert got and sorted(map(tuple, got), key=str) == sorted(result.fetchall(), key=str)


@needs_tables
def test_register_takes_only_what_is_new(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("extra", F.lit("x"))
    n = pages.count()
    inbox, out, check = (str(tmp_path / x) for x in ("pages", "out", "check"))
    pages.where("page_id % 2 = 0").repartition(2).write.parquet(inbox)
    first = tag_register.run(spark, inbox, out, check)
    assert first["pages_read"] == pages.where("page_id % 2 = 0").count() and first["batches"] == 1
    again = tag_register.run(spark, inbox, out, check)
    assert again == {"batches": 0, "pages_read": 0, "buckets_written": 0}
    pages.where("page_id % 2 = 1").repartition(3).write.mode("append").parquet(inbox)
    second = tag_register.run(spark, inbox, out, check, tag_register.Settings(files_per_batch=1))
    assert second["pages_read"] == n - first["pages_read"] and second["batches"] == 3
    whole = str(tmp_path / "whole")
    tag_register.run(spark, f"{SF}/pages.parquet", whole, str(tmp_path / "check2"))
    assert register(spark, out) == register(spark, whole) and len(register(spark, out)) == n


def test_register_untouched_buckets_stay(spark, tmp_path):
    inbox, out, check = (str(tmp_path / x) for x in ("pages", "out", "check"))
    add(spark, inbox, [(i, f"http://s{i}.org/a", "<p>1</p>", None) for i in range(12)])
    tag_register.run(spark, inbox, out, check)
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(f"{out}/register") for f in fs if f.endswith(".parquet")}
    before = files()
    add(spark, inbox, [(99, "http://s3.org/a", "<p>2</p>", None)])
    assert tag_register.run(spark, inbox, out, check)["buckets_written"] == 1
    assert len(before) > 2 and len(before - files()) == 1
    rows = {r["record"]: r for r in tag_register.result(spark, out).collect()}
    assert rows["3"]["stale"] and not rows["99"]["stale"] and rows["3"]["site_records"] == 2 and len(rows) == 13


def test_register_updates_and_repeated_batches(spark, tmp_path):
    """A record that comes again replaces its row; a batch that runs again (its commit lost) changes nothing."""
    inbox, out, check = (str(tmp_path / x) for x in ("pages", "out", "check"))
    add(spark, inbox, [(1, "http://www.a.org/x?q=1", "<html lang=\"en\"><title>one</title><p>a<p>b", None), (2, "http://b.org/", "<a href='1'>", None)])
    tag_register.run(spark, inbox, out, check)
    add(spark, inbox, [(1, "http://a.org/x.html", "<title> two </title>", None), (3, "http://m.a.org/x/", None, None)])
    tag_register.run(spark, inbox, out, check)
    rows = {r["record"]: r for r in tag_register.result(spark, out).collect()}
    assert (rows["1"]["title"], rows["1"]["language"], rows["1"]["n_paragraphs"], rows["1"]["stale"]) == ("two", None, 0, True)
    assert {r["address"] for k, r in rows.items() if k != "2"} == {"a.org/x"} and (rows["3"]["title"], rows["3"]["n_bytes"], rows["3"]["stale"]) == (None, 0, False)
    want = register(spark, out)
    for f in ("1", ".1.crc"):
        os.remove(f"{check}/commits/{f}")
    assert tag_register.run(spark, inbox, out, check)["pages_read"] == 2
    assert register(spark, out) == want


def test_register_awkward_rows(spark, tmp_path):
    inbox, out, check = (str(tmp_path / x) for x in ("pages", "out", "check"))
    hot = [(1000 + i, "https://hot.org/p", "<p>x</p>", None) for i in range(300)]
    rows = [(None, None, None, None), (None, None, None, None), (None, "no url", "<p>", None), (5, None, "x" * 300_000 + "<p>", None), (6, "http://c.org", "", None), (6, "http://c.org", "", None), *hot]
    add(spark, inbox, rows)
    tag_register.run(spark, inbox, out, check)
    got = {r["record"]: r for r in tag_register.result(spark, out).collect()}
    assert len(got) == 300 + 4
    assert got["5"]["site"] is None and got["5"]["address"] is None and got["5"]["n_paragraphs"] == 1 and not got["5"]["stale"]
    assert got["5"]["site_records"] == 3 and got["6"]["site_records"] == 1
    assert sum(not r["stale"] for r in got.values() if r["site"] == "hot.org") == 1
    with pytest.raises(ValueError, match="buckets"):
        tag_register.run(spark, inbox, out, check, tag_register.Settings(buckets=3))


def test_register_of_nothing(spark, tmp_path):
    inbox, out = str(tmp_path / "pages"), str(tmp_path / "out")
    spark.createDataFrame([], PAGES).write.parquet(inbox)
    for _ in range(2):
        assert tag_register.run(spark, inbox, out, str(tmp_path / "check"))["pages_read"] == 0
    assert tag_register.result(spark, out).count() == 0


@pytest.fixture(scope="module")
def scan(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    root = tmp_path_factory.mktemp("scan")
    for t in ("nation", "customer"):
        shutil.copy(f"{SF}/{t}.parquet", root / f"{t}.parquet")
    out = str(root / "out")
    return root, out, scan_catalogue.run(spark, str(root), out)


def objects(spark, out, run=None):
    df = scan_catalogue.result(spark, out)
    return sorted((tuple(r) for r in (df if run is None else df.where(F.col("run") == run)).collect()), key=str)


def test_scan_rerun_and_other_settings(spark, scan):
    root, out, first = scan
    want = objects(spark, out)
    again = scan_catalogue.run(spark, str(root), out)
    assert not first["reused"] and again["reused"] and again["run"] == first["run"] and objects(spark, out) == want
    other = scan_catalogue.run(spark, str(root), out, scan_catalogue.Settings(lateral_base_px=0.5, lateral_per_radius=0.0))
    assert other["run"] != first["run"] and other["objects_written"] > first["objects_written"]
    assert objects(spark, out, first["run"]) == want and len(objects(spark, out)) == len(want) + other["objects_written"]


def test_scan_that_broke_off_is_written_again(spark, scan):
    root, out, first = scan
    want = objects(spark, out, first["run"])
    shutil.rmtree(f"{out}/runs/run={first['run']}")
    assert first["run"] not in {r[0] for r in objects(spark, out)} if os.listdir(f"{out}/runs") else True
    again = scan_catalogue.run(spark, str(root), out)
    assert not again["reused"] and again["run"] == first["run"] and objects(spark, out, first["run"]) == want


def test_scan_reload(spark, scan):
    root, out, first = scan
    tiles, found = outputs.reloaded(spark, out, first["run"])
    assert tiles.count() == first["tiles_read"] and found.count() == len(objects(spark, out, first["run"])) and tiles.first()["offset_source"] == "saved"
    with pytest.raises(ValueError, match="no finished run"):
        outputs.reloaded(spark, out, "r0")
    cut = str(root / "cut")
    shutil.copytree(out, cut)
    part = sorted(os.listdir(f"{cut}/catalogue/run={first['run']}"))[0]
    shutil.rmtree(f"{cut}/catalogue/run={first['run']}/{part}")
    with pytest.raises(ValueError, match="not the one"):
        outputs.reloaded(spark, cut, first["run"])


def test_settings_files(tmp_path):
    here = os.path.dirname(registry.__file__)
    assert common.settings_of(tag_register.Settings, f"{here}/tag_register.json") == common.settings_of(tag_register.Settings, None)
    assert common.settings_of(scan_catalogue.Settings, f"{here}/scan_catalogue.json") == scan_catalogue.Settings()
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"bucket": 1}))
    with pytest.raises(ValueError, match="bucket"):
        common.settings_of(tag_register.Settings, str(bad))


def test_jobs_need_no_text_operators():
    here = os.path.dirname(registry.__file__)
    for f in os.listdir(here):
        if f.endswith(".py"):
            text = open(os.path.join(here, f), encoding="utf-8").read()
            assert "llm" not in text and "corpus_pipeline" not in text
