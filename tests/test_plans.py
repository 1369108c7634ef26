import numpy as np
import pytest

from stackmeter.operators import frames as ops
from stackmeter.operators import matching as ops_matching
from stackmeter.params import Acquisition, Params
from stackmeter.plans import field, mosaic

from . import scan

ACQ, PAR = Acquisition(), Params(max_diameter_px=60)


def truth_segmenter(placed):
    """Labels of planted discs, so that the plan is tested apart from the detector."""

    def labels(a):
        yy, xx = np.mgrid[: a.shape[0], : a.shape[1]]
        out = np.zeros(a.shape, dtype=int)
        for n, (x, y, _, r) in enumerate(placed):
            out[np.hypot(xx - x, yy - y) <= r] = n + 1
        return out

    return labels


@pytest.fixture(scope="module")
def field_frames(spark):
    placed = scan.objects(5)
    rows = [(0, z, scan.HEIGHT, scan.WIDTH, scan.frame(placed, z, seed=z).reshape(-1).tolist()) for z in range(scan.DEPTH)]
    return placed, spark.createDataFrame(rows, ops.FRAME).cache()


@pytest.mark.parametrize("mode", ["edf", "both"])
def test_field_finds_planted_objects(spark, field_frames, mode):
    placed, stack = field_frames
    plane = field.registration.substrate_plane(field.profile(stack)).first().plane
    assert abs(plane - 17) <= 1
    options = field.FieldOptions(mode=mode, edf_sigma=2.0, z_step=2)
    got = field.measure(stack, ACQ, PAR, options, truth_segmenter(placed)).collect()
    assert sorted(r.oid for r in got) == list(range(len(got)))
    for x, y, z, r in placed:
        near = [g for g in got if np.hypot(g.x - x, g.y - y) < 3 and abs(g.z - z) <= 2]
        assert near and abs(near[0].r - r) < 2, (x, y, z)


def test_empty_field_has_no_objects(spark):
    rows = [(0, z, 40, 40, np.full(1600, 100.0).tolist()) for z in range(6)]
    stack = spark.createDataFrame(rows, ops.FRAME)
    assert field.measure(stack, ACQ, PAR, field.FieldOptions(mode="edf"), lambda a: np.zeros(a.shape, dtype=int)).count() == 0


def test_failing_detector_falls_back(spark, field_frames):
    def broken(a):
        raise RuntimeError("no device")

    one = field_frames[1].where("z = 8")
    assert ops.segmented(one, broken).count() == ops.segmented(one).count()


def test_mosaic_merges_repeated_sightings(spark):
    wide, step = 220, 92
    placed = scan.objects(9, 11, wide)
    whole = [scan.frame(placed, z, wide, seed=z) for z in range(scan.DEPTH)]
    rows = [(t, z, scan.HEIGHT, scan.WIDTH, whole[z][:, t * step : t * step + scan.WIDTH].reshape(-1).tolist()) for t in (0, 1) for z in range(scan.DEPTH)]
    stack = spark.createDataFrame(rows, ops.FRAME).cache()
    tiles = spark.createDataFrame([(t, 0, t, t * step + 3.0 * t, 0.0, float(scan.WIDTH), float(scan.HEIGHT)) for t in (0, 1)], "tile int, tr int, tc int, x0 double, y0 double, w double, h double")

    def labels(a):
        best = None
        for t in (0, 1):
            own = [(x - t * step, y, z, r) for x, y, z, r in placed if r < x - t * step < scan.WIDTH - r]
            out = truth_segmenter(own)(a)
            inside = [abs(a[int(y), int(round(x - r))] - a.mean()) for x, y, _, r in own]
            score = float(np.mean(inside)) if inside else 0.0
            best = (score, out) if best is None or score > best[0] else best
        return best[1]

    out = mosaic.run(stack, tiles, ACQ, PAR, field.FieldOptions(mode="edf", edf_sigma=2.0), labels)
    moved = {r.tile: r.x0 for r in out["tiles"].collect()}
    assert abs(moved[1] - moved[0] - step) <= 3.1
    cat = out["catalogue"].collect()
    views = out["views"].collect()
    assert sorted(r.uid for r in cat) == list(range(len(cat)))
    assert sum(r.n_views for r in cat) == len(views) and sum(v.elected for v in views) == len(cat)
    found = [any(np.hypot(c.x - x, c.y - y) < 8 for c in cat) for x, y, _, _ in placed]
    assert sum(found) >= len(placed) - 2
    feats = out["features"].collect()
    assert {f.uid for f in feats} == {c.uid for c in cat} and set(out["features"].columns) >= {"core_glcm_energy_d4", "nn_gap_px", "solidity"}
    assert all(f.appearance_measurable == (f.core_od_mean is not None) for f in feats) and any(f.appearance_measurable for f in feats)
    assert all(len(f.radial_profile_px) == PAR.n_theta and f.circularity is not None and f.height_above_glass_slices is not None for f in feats)
    assert out["dome"] is None and all(f.dome_distance_px is None for f in feats)  # nothing here is a droplet


def test_tracks_of_two_planes_give_two_rows(spark):
    """Two objects at one place, sharp at slices 4 and 12: one track, two focal planes, each on its own outline."""
    yy, xx = np.mgrid[:64, :64]

    def ring(z):
        a = np.full((64, 64), 180.0)
        for z0, r in ((4, 9.0), (12, 10.0)):
            blur = 1.0 + 0.8 * abs(z - z0)
            a -= 110 / blur * np.exp(-((np.hypot(xx - 32, yy - 32) - r) ** 2) / (2 * (1.2 * blur) ** 2))
        return a

    stack = spark.createDataFrame([(0, z, 64, 64, ring(z).reshape(-1).tolist()) for z in range(20)], ops.FRAME)

    def labels(a):
        upper = a[32, 32 + 9] < a[32, 32 + 10]
        return (np.hypot(xx - 32, yy - 32) <= (9 if upper else 10)).astype(int)

    planes = spark.createDataFrame([(0, 19)], "stack int, plane int")
    got = field.tracked_objects(stack, planes, field.FieldOptions(z_step=2), PAR, ACQ, labels).collect()
    assert len(got) == 2 and {r.n_slices for r in got} == {10} and {(r.z_first, r.z_last) for r in got} == {(0, 18)}
    near, far = sorted(got, key=lambda r: r.z)
    assert abs(near.z - 4) <= 1.5 and abs(far.z - 12) <= 1.5 and near.r < far.r and len(near.profile) == PAR.n_theta


def textured_cap(z, cx, cy, shape, radius=70.0, centre=9.0, seed=0):
    """Fine texture inside the droplet's ring of a slice, smooth outside."""
    rng = np.random.default_rng(seed + z)
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    r = np.sqrt(max(0.0, radius**2 - ((z - centre) * 10 / 3.7744) ** 2)) if abs(z - centre) * 10 / 3.7744 < radius else 0.0
    return 150 + np.where(np.hypot(xx - cx, yy - cy) <= r, rng.normal(0, 25, shape), 0.0)


def test_droplet_of_a_mosaic(spark):
    wide = (176, 260)
    canvas = [textured_cap(z, 130.0, 88.0, wide) for z in range(30)]
    rows = [(t, z, 176, 160, canvas[z][:, t * 100 : t * 100 + 160].reshape(-1).tolist()) for t in (0, 1) for z in range(0, 30)]
    stack = spark.createDataFrame(rows, ops.FRAME)
    tiles = spark.createDataFrame([(t, 0, t, t * 100 + 5.0, 7.0, 160.0, 176.0) for t in (0, 1)], "tile int, tr int, tc int, x0 double, y0 double, w double, h double")
    dome, rings = mosaic.droplet(stack, tiles, 28.0, ACQ, PAR, sigma=3.0)
    assert rings.where("used").count() >= 4
    assert abs(dome.cx - 135) < 4 and abs(dome.cy - 95) < 4 and abs(dome.radius - 70) < 10 and dome.glass == 28.0
    flat = spark.createDataFrame([(t, z, 40, 40, np.full(1600, 90.0).tolist()) for t in (0, 1) for z in range(30)], ops.FRAME)
    assert mosaic.droplet(flat, tiles, 28.0, ACQ, PAR, sigma=3.0)[0] is None
    assert mosaic.droplet(stack.where("z < 9"), tiles, 12.0, ACQ, PAR, sigma=3.0) == (None, None)


def test_droplet_of_a_field_that_holds_too_little_is_dropped(spark):
    domes = spark.createDataFrame([(0, 50.0, 50.0, 10.0, 60.0), (1, 50.0, 50.0, 10.0, 60.0)], "stack int, cx double, cy double, cz double, radius double")
    rows = [(0, i, 50.0 + i, 50.0, 10.0, 5.0) for i in range(10)] + [(1, i, 50.0 + 30 * i, 50.0, 10.0, 5.0) for i in range(10)] + [(2, 0, 1.0, 1.0, 1.0, 5.0)]
    objects = spark.createDataFrame(rows, "stack int, oid int, x double, y double, z double, r double")
    got = {(r.stack, r.oid): r for r in field.with_droplets(objects, domes, ACQ).collect()}
    assert len(got) == 21 and got[0, 3].dome_distance_px == pytest.approx(60 - 3 - 5) and got[0, 3].dome_surface_slice == pytest.approx(10 - np.sqrt(3600 - 9) / (10 / 3.7744))
    assert all(got[k].dome_distance_px is None and got[k].dome_surface_slice is None for k in got if k[0] > 0)


def test_flat_field_takes_the_pattern_out(spark):
    light = 1 + 0.3 * np.linspace(-1, 1, 64)[None, :] * np.ones((48, 1))
    rows = [(t, z, 48, 64, (120 * light + (t + z) % 3).reshape(-1).tolist()) for t in range(3) for z in range(5)]
    out = mosaic.flat_fielded(spark.createDataFrame(rows, ops.FRAME), sigma=6.0).collect()
    spans = [np.ptp(np.asarray(r.px).reshape(48, 64)[:, 8:-8]) for r in out]
    assert len(out) == 15 and max(spans) < 0.25 * np.ptp(120 * light[:, 8:-8])


def test_outline_that_reaches_the_edge_is_clipped(spark):
    rows = [(10.0, 7.0, [7.0] * 48), (10.0, 7.0, [7.0] * 47 + [8.5]), (10.0, 8.5, None)]
    got = [r.clipped for r in ops_matching.with_clipped(spark.createDataFrame(rows, "edge double, r double, profile array<double>")).collect()]
    assert got == [False, True, True]
