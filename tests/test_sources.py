import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmeter.functions.tags import double_of_bits, tag_attribute, tag_count, tag_text
from stackmeter.sources import frames, group, tiff

from . import scan


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("scan")
    scan.write(root)
    (root / "output").mkdir()
    return root


def test_tiff_round_trip():
    a = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (tiff.decode(tiff.encode(a)) == a).all() and tiff.frame_note(tiff.encode(a)) is None
    assert tiff.frame_note(tiff.encode(a, "<?xml ?><a>1</a>")) == "<?xml ?><a>1</a>"
    rgb = struct.pack("<2sHI", b"II", 42, 8 + 12) + bytes([0, 3, 6, 9, 9, 9, 1, 1, 1, 30, 30, 33])
    tags = [(256, 4, 1, 2), (257, 4, 1, 2), (258, 3, 1, 8), (273, 4, 1, 8), (277, 3, 1, 3), (279, 4, 1, 12)]
    rgb += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    assert tiff.decode(rgb).tolist() == [[3, 9], [1, 31]]
    with pytest.raises(ValueError):
        tiff.decode(b"PK not an image")


def test_known_bit_patterns(spark):
    known = {4596373779694328218: 0.2, 4626322717216342016: 20.0, None: None, 0: 0.0, 0x7FF0 << 48: None}
    known |= {struct.unpack("<q", struct.pack("<d", v))[0]: v for v in (-1.5, 1 / 3, 5e-324, 1.7e308, -2.2e-308)}
    rows = spark.createDataFrame([(b, v) for b, v in known.items()], "b long, v double").select(double_of_bits(F.col("b")).alias("got"), "v").collect()
    assert [r.got for r in rows] == [r.v for r in rows]
    assert round(spark.range(1).select(double_of_bits(F.lit(4660518447848644499))).first()[0], 4) == 3774.4179


def test_group_tables(spark, folder):
    m = group.read_group(spark, str(folder)).first()
    assert (round(m.px_um, 5), m.z_um, m.na, m.px_source, m.objective) == (3.77442, 10.0, 0.2, "calibration", "Plan 4x")
    assert m.table_gap_pct == 0.022 and m.warning is None
    assert sorted((r.tile, r.tr, r.tc) for r in group.read_group(spark, str(folder), "layout").collect()) == [("4x_00009", 0, 0), ("4x_00010", 0, 1)]
    scores = group.read_group(spark, str(folder), "scores").collect()
    assert len(scores) == 6 and {r.score for r in scores if r.z == 2} == {85.0}
    assert [tuple(r)[1:] for r in group.read_group(spark, str(folder), "edge_points").collect()] == [(0, 1, 2, 3)]


def test_metadata_without_calibration(spark):
    rows = [("none", None, None), ("lens", group.LENS, b"<Magnification>1000</Magnification><LensName>x: 10x 0.45</LensName>"), ("odd", group.LENS, b"<Magnification>300</Magnification>")]
    rows += [("grid", group.JOINT, b"<Enabled>True</Enabled><Row>2</Row><Column>two</Column>"), ("junk", group.STACK, b"<Pitch>x</Pitch>")]
    members = spark.createDataFrame(rows, "group string, member string, body binary")
    got = {r.group: r for r in group.metadata(group.properties(members), 1920).collect()}
    assert len(got) == 5 and got["none"].px_um is None and got["none"].z_um is None and got["junk"].z_um is None
    assert got["lens"].px_um == pytest.approx(1.5094 / 2) and got["lens"].px_source == "lens-table" and got["lens"].na == 0.45 and got["lens"].objective == "x"
    assert got["odd"].warning and got["lens"].warning is None
    why = {r.group: r.warning for r in group.layout_warnings(members).collect()}
    assert why["none"] == "not a tiled acquisition" and why["grid"] == "the grid's shape is missing"
    assert group.layout(members).count() == group.scores(members).count() == group.edge_points(members).count() == 0


def test_tags(spark):
    text = '<a x="1">no</a><p class="c" id="7">one\n two </p><p/><pre>p</pre><p>three</p>'
    row = spark.createDataFrame([(text,), (None,)], "t string").select(tag_text(F.col("t"), "p").alias("p"), tag_text(F.col("t"), "q").alias("q"), tag_attribute(F.col("t"), "p", "id").alias("id"), tag_count(F.col("t"), "p").alias("n")).collect()
    assert tuple(row[0]) == ("one\n two", None, "7", 3) and tuple(row[1]) == (None,) * 4


def test_nearest_group_file(spark, tmp_path):
    for name in ("a", "b", "c/d"):
        (tmp_path / name).mkdir(parents=True)
    for name in ("z.gci", "a/m.gci", "a/k.gci", "c/d/e.txt"):
        (tmp_path / name).write_bytes(b"PK")  # Spark leaves empty files out
    folders = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in ("a", "b", "c/d")], "folder string")
    got = {r.folder.rsplit("/", 1)[1]: r.path.removeprefix(f"file:{tmp_path}/") for r in group.nearest(spark, str(tmp_path), folders).collect()}
    assert got == {"a": "a/k.gci", "b": "z.gci"}


def test_frames(spark, folder):
    listed = frames.listed(spark, str(folder))
    assert listed.count() == 6
    found = frames.stacks(listed, str(folder))
    assert sorted((r.stack, r.n) for r in found.collect()) == [("4x_00009", 3), ("4x_00010", 3)]
    assert frames.default_stack(found).first().stack == "4x_00009"
    rows = frames.load(spark, str(folder)).collect()
    assert {(r.tile, r.z, r.z_label): r.px[0] for r in rows} == {(t, z, z + 1): 10.0 * n + z for n, t in enumerate(("4x_00009", "4x_00010")) for z in range(3)}
    assert frames.common_depth(frames.load(spark, str(folder))).first().depth == 3
    stage = {(r.tile, r.z_label): (r.stage_x, r.stage_y, r.stage_z) for r in frames.stage_locations(spark, str(folder)).collect()}
    assert stage["4x_00010", 3] == (1000, 5, 2) and stage["4x_00009", 2] == (None, None, None)


def test_frames_of_different_shapes_are_refused(spark, tmp_path):
    scan.write(tmp_path)
    (tmp_path / "4x_00009" / "4x_00009_Z004_CH1.tif").write_bytes(tiff.encode(np.zeros((3, 3), dtype=np.uint8)))
    with pytest.raises(Exception, match="different shapes"):
        frames.load(spark, str(tmp_path)).collect()
