"""The feature matrix against plain loops over pixels, planted discs, and the awkward cases."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmeter.kernels import appearance, image
from stackmeter.operators import frames as ops
from stackmeter.params import Acquisition, Dome
from stackmeter.plans import features, outputs


def plain_dilate(mask, r):
    e = image.ellipse(r)
    out = np.zeros(mask.shape, dtype=bool)
    for y, x in zip(*np.nonzero(mask), strict=True):
        for dy, dx in zip(*np.nonzero(e), strict=True):
            a, b = y + dy - r, x + dx - r
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1]:
                out[a, b] = True
    return out


def test_morphology_equals_the_plain_rule():
    rng = np.random.default_rng(0)
    for r in (1, 2, 5, 9):
        mask = rng.random((23, 31)) < 0.08
        assert (image.dilate(mask, r) == plain_dilate(mask, r)).all()
        assert (image.erode(~mask, r) == ~plain_dilate(mask, r)).all()


def plain_cooccurrence(g, d):
    out = []
    for k in range(4):
        dy, dx = round(d * math.sin(k * math.pi / 4)), round(d * math.cos(k * math.pi / 4))
        pairs = []
        for y, x in itertools.product(range(g.shape[0]), range(g.shape[1])):
            if 0 <= y + dy < g.shape[0] and 0 <= x + dx < g.shape[1] and g[y, x] > 0 and g[y + dy, x + dx] > 0:
                pairs += [(g[y, x], g[y + dy, x + dx]), (g[y + dy, x + dx], g[y, x])]
        if not pairs:
            return None
        p = {}
        for q in pairs:
            p[q] = p.get(q, 0) + 1 / len(pairs)
        i, j = np.array(pairs, dtype=float).T
        sd = i.std()
        out.append([sum(v * (a - b) ** 2 for (a, b), v in p.items()), sum(v * abs(a - b) for (a, b), v in p.items()), sum(v / (1 + (a - b) ** 2) for (a, b), v in p.items()), math.sqrt(sum(v * v for v in p.values())), ((i - i.mean()) * (j - j.mean())).mean() / sd**2 if sd > 1e-9 else 1.0])
    return np.mean(out, axis=0)


@pytest.mark.parametrize("d", [1, 2, 4])
def test_cooccurrence_equals_the_plain_rule(d):
    rng = np.random.default_rng(d)
    for _ in range(5):
        g = rng.integers(0, 16, (11, 13)) * (rng.random((11, 13)) < 0.8)
        assert np.allclose(appearance.cooccurrence(g, d), plain_cooccurrence(g, d))
    assert appearance.cooccurrence(np.zeros((9, 9), dtype=int), d) is None
    assert np.allclose(appearance.cooccurrence(np.full((9, 9), 3), d), [0, 0, 1, 1, 1])


def disc(r=14.0, size=96, dark=100.0, light=200.0, core=None, at=(48.0, 47.0)):
    yy, xx = np.mgrid[:size, :size]
    away = np.hypot(xx - at[0], yy - at[1])
    a = np.where(away <= r, dark, light) + 0.2 * xx
    return a if core is None else np.where(away <= core, light, a)


def test_known_densities_of_a_ring():
    """An empty cyst: a dark shell around a core as light as the background."""
    values, missing = appearance.measured(disc(core=9.0), 48.0, 47.0, 14.0, np.full(48, 14.0), [])
    assert missing == [] and set(values) == {*appearance.QUALITY, *appearance.INTENSITY, *appearance.TEXTURE}
    assert abs(values["background_dn"] - (200 + 0.2 * 48)) < 1 and values["background_clipped_frac"] == 0
    # Outlines are cut to whole cells, so the shell holds a sliver of background.
    assert abs(values["rim_od_median"] - math.log(209.6 / 109.6)) < 0.05 and abs(values["core_od_median"]) < 0.05
    assert values["rim_minus_core_od"] > 0.4 and values["core_fill_fraction"] < 0.35 and values["outline_empty"] == 0
    assert sum(values[f"core_lbp_{b:02d}"] for b in range(10)) == pytest.approx(1)
    blank, _ = appearance.measured(disc(dark=200.0), 48.0, 47.0, 14.0, np.full(48, 14.0), [])
    assert blank["outline_empty"] == 1


def test_statistics():
    v = np.random.default_rng(1).normal(0.5, 0.4, 500)
    got = dict(zip(appearance.STATISTICS, appearance.statistics(v), strict=True))
    z = (v - v.mean()) / v.std()
    assert got["skew"] == pytest.approx((z**3).mean()) and got["kurtosis"] == pytest.approx((z**4).mean() - 3) and got["iqr"] == pytest.approx(np.subtract(*np.percentile(v, [75, 25])))
    assert appearance.statistics(np.zeros(9))[8] == 0 and math.isnan(appearance.statistics(np.zeros(9))[6])


def test_regions_that_cannot_be_measured():
    a, profile = disc(), np.full(48, 14.0)
    none = ({"appearance_measurable": 0.0}, ["intensity", "texture"])
    assert appearance.measured(a, 20.0, 47.0, 14.0, profile, []) == none  # the ring leaves the frame
    assert appearance.measured(a, 48.0, 47.0, 5.9, profile, []) == none  # too small
    assert appearance.measured(a, 48.0, 47.0, 14.0, profile, [(0.0, 0.0, 60.0)]) == none  # nothing left of the halo
    whole, _ = appearance.measured(a, 48.0, 47.0, 14.0, profile, [])
    less, _ = appearance.measured(a, 48.0, 47.0, 14.0, profile, [(28.0, 0.0, 8.0)])
    assert less["halo_lost_to_neighbours_px"] > 20 and less["halo_px"] + less["halo_lost_to_neighbours_px"] == whole["halo_px"]
    small, missing = appearance.measured(disc(r=7.0), 48.0, 47.0, 7.0, np.full(48, 7.0), [])
    assert missing == ["texture"] and "core_grad_mean" not in small and "core_od_mean" in small


def test_outline_of_another_shape_moves_the_regions():
    """A lobed outline has other regions than the circle of its radius: pixels are those of r(theta)."""
    t = np.arange(48) * 2 * np.pi / 48
    lobed = appearance.regions(disc(), 48.0, 47.0, 14.0, 14 + 4 * np.cos(2 * t), [])
    round_ = appearance.regions(disc(), 48.0, 47.0, 14.0, np.full(48, 14.0), [])
    assert lobed["body"][:, -30:].sum() > round_["body"][:, -30:].sum()
    inside = np.hypot(lobed["xx"], lobed["yy"])[lobed["body"]]
    assert inside.max() > 17 and not (lobed["body"] & ~image.dilate(round_["body"], 5)).any()


@pytest.fixture(scope="module")
def scan(spark):
    """Two tiles, four objects: a measurable one, one at the edge, one without a frame, one with a broken outline."""
    rows = [(t, z, 96, 96, (disc() + t).reshape(-1).tolist()) for t in (0, 1) for z in (0, 1)]
    stack = spark.createDataFrame(rows, ops.FRAME)
    tiles = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 96.0, 96.0), (1, 0, 1, 60.0, 0.0, 96.0, 96.0), (2, 0, 2, 120.0, 0.0, 96.0, 96.0)], "tile int, tr int, tc int, x0 double, y0 double, w double, h double")
    good, bad = [14.0] * 48, [14.0] * 47 + [float("nan")]
    objects = [(0, 0, 48.0, 47.0, 1.4, good), (1, 0, 15.0, 47.0, 0.0, good), (2, 0, 48.0, 47.0, 0.0, good), (1, 1, 48.0, 47.0, 9.0, bad)]
    schema = "stack int, oid long, x double, y double, z double, profile array<double>"
    found = spark.createDataFrame(objects, schema).withColumns({"r": F.lit(14.0), "sharp": F.lit(0.5), "circ": F.lit(0.9), "area": F.lit(615.0), "n_slices": F.lit(3).cast("long"), "z_first": F.lit(0), "z_last": F.lit(1), "source": F.lit("edf")})
    flags = {c: F.lit(False) for c in "clipped clipped_everywhere single_view_in_overlap radius_disagreement same_tile_twice guarantee_void".split()}
    flags |= {"n_views": F.lit(1).cast("long"), "views": F.lit("0"), "coverage_k": F.lit(1).cast("long"), "lateral_spread_px": F.lit(0.0), "axial_spread_slices": F.lit(0.0), "radius_ratio": F.lit(1.0)}
    cat = found.select((F.col("stack") * 2 + F.col("oid")).alias("uid"), F.col("stack").alias("tile"), F.col("oid").alias("obj"), (F.col("x") + F.col("stack") * 60).alias("x"), "y", "z", "r", "sharp").withColumns(flags)
    return stack, tiles, found, cat


def test_matrix(spark, scan):
    stack, tiles, found, cat = scan
    dome = Dome(100.0, 50.0, 60.0, 400.0, 20.0, 2.65)
    out = features.matrix(cat, features.record(found, Acquisition(), None), stack, tiles, Acquisition(), dome)
    assert out.columns == features.columns(3) and len(out.columns) == 141
    rows = {r.uid: r for r in out.collect()}
    assert len(rows) == 4
    a, edge, lost, broken = rows[0], rows[2], rows[4], rows[3]
    want, _ = appearance.measured(disc(), 48.0, 47.0, 14.0, np.full(48, 14.0), [(27.0, 0.0, 14.0)])
    assert a.missing_blocks is None and all(a[k] == pytest.approx(float(v)) for k, v in want.items())
    assert a.circularity == pytest.approx(4 * math.pi * a.outline_area_px2 / a.outline_perimeter_px**2) and a.circularity != 0.9 and a.solidity == pytest.approx(1) and a.shape_suspect == 0
    assert edge.missing_blocks == lost.missing_blocks == "intensity;texture" and edge.appearance_measurable == lost.appearance_measurable == 0 and edge.core_od_mean is None and edge.solidity is not None
    assert broken.missing_blocks.startswith("morphology") and broken.solidity is None and broken.circularity == 0.9
    assert a.dome_distance_px == pytest.approx(400 - math.sqrt(52**2 + 3**2 + ((1.4 - 60) * 2.65) ** 2) - 14) and a.x_mosaic_px == a.x_px == 48 and rows[2].x_px == 15 and rows[2].x_mosaic_px == 75
    assert a.mean_distance_3nn_px is not None and a.nn_distance_px == pytest.approx(math.hypot(27, 1.4 * 10 / 3.7744))
    assert a.radial_profile_um[0] == pytest.approx(14 * 3.7744) and a.diameter_um == pytest.approx(28 * 3.7744) and list(a.z_extent_slices) == [0, 1]


def test_matrix_without_scale_or_droplet(scan):
    stack, tiles, found, cat = scan
    bare = Acquisition(px_um=None, z_um=None, na=None)
    out = features.matrix(cat, features.record(found, bare), stack, tiles, bare, None, 30.0)
    r = {x.uid: x for x in out.collect()}[0]
    assert r.height_above_glass_slices == pytest.approx(28.6) and r.dome_distance_px is None and r.nearest_border_px is None and r.dome_surface_slice is None
    assert all(r[c] is None for c in features.RECORD if c.endswith("_um")) and r.radius_z_slices == 14 and r.core_od_mean is not None


def test_matrix_of_one_and_of_none(scan):
    stack, tiles, found, cat = scan
    one = features.matrix(cat.where("uid = 0"), features.record(found), stack, tiles)
    assert one.columns == features.columns(1) and one.first().nn_distance_px is None
    assert features.matrix(cat.where("false"), features.record(found), stack, tiles).count() == 0


def test_what_is_not_asked_for_is_not_measured(scan):
    stack, tiles, found, cat = scan
    broken = stack.withColumn("px", F.raise_error(F.lit("pixels were read")).cast("array<double>"))
    names = ["uid", "nn_distance_px", "radius_cv", "circularity"]
    args = (features.record(found), stack, tiles)
    got = features.matrix(cat, features.record(found), broken, tiles, only=names)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(map(tuple, features.matrix(cat, *args).select(*names).collect()))
    hull = features.matrix(cat, features.record(found), broken, tiles, only=["uid", "solidity"])
    assert sorted(map(tuple, hull.collect())) == sorted(map(tuple, features.matrix(cat, *args).select("uid", "solidity").collect()))


def test_payload(spark, scan):
    import json

    stack, tiles, found, cat = scan
    matrix = features.matrix(cat, features.record(found), stack, tiles)
    meta = spark.range(1).select(F.lit("scan").alias("dataset"), outputs.build_stamp(F.to_timestamp(F.lit("2024-05-06 07:08:59"))).alias("built_utc"))
    lines = [(r.part, json.loads(r.line)) for r in outputs.payload_lines(matrix, tiles, meta).collect()]
    assert [p for p, _ in lines] == [1, 2, 2, 2, 3, 3, 3, 3] and lines[0][1] == {"dataset": "scan", "built_utc": "2024-05-06 07:08 UTC"}
    objects = [x for p, x in lines if p == 3]
    assert [x["uid"] for x in objects] == [0, 2, 3, 4] and not set(objects[0]) & set(outputs.REDUNDANT) and objects[0]["radial_profile_px"] == [14.0] * 48
    assert objects[0]["core_od_mean"] == round(objects[0]["core_od_mean"], 4) and "core_od_mean" not in objects[1]


def test_rounded_record(spark, scan):
    row = features.rounded_record(features.record(scan[2].withColumn("x", F.lit(1.00005)))).first()
    assert row.x_px in (1.0, 1.0001) and row.x_um == round(1.00005 * 3.7744, 4) and row.radial_profile_um[0] == round(14 * 3.7744, 3)
