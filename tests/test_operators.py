import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackmeter.functions import scalars
from stackmeter.kernels import image
from stackmeter.operators import catalogue, curves, frames, matching, mesh, registration
from stackmeter.params import Acquisition, Dome, Params
from stackmeter.plans import mosaic, outputs


def test_assignment_is_largest_then_cheapest(spark):
    edges = [(0, 1, 1, 1, 0.1), (0, 1, 1, 2, 0.2), (0, 1, 2, 1, 0.3), (0, 1, 3, 3, 0.5), (0, 1, 3, 4, 0.1), (0, 1, 4, 3, 0.1), (0, 1, 4, 4, 0.9), (0, 2, 5, 5, 0.7)]
    got = matching.assigned(spark.createDataFrame(edges, "ta int, tb int, sa long, sb long, cost double")).collect()
    assert sorted((r.ta, r.tb, r.sa, r.sb) for r in got) == [(0, 1, 1, 2), (0, 1, 2, 1), (0, 1, 3, 4), (0, 1, 4, 3), (0, 2, 5, 5)]


def test_many_seams_are_solved_together_and_long_ones_over_batches(spark, monkeypatch):
    from pyspark.sql import GroupedData

    def one_group_a_seam(*_):
        raise AssertionError("a Python group for each seam")

    monkeypatch.setattr(GroupedData, "applyInPandas", one_group_a_seam)
    rng = np.random.default_rng(2)
    edges = [(s, s + 1, int(a), int(b), float(rng.uniform())) for s in range(40) for a in range(6) for b in range(6) if rng.uniform() < (0.4 if s else 1.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r)[:4] for r in matching.assigned(spark.createDataFrame(edges, "ta int, tb int, sa long, sb long, cost double")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for s in range(40):
        cost = np.full((6, 6), np.inf)
        for e in edges:
            if e[0] == s:
                cost[e[2], e[3]] = e[4]
        want |= {(s, s + 1, a, b) for a, b in matching.min_cost_matching(cost)}
    assert got == want


def test_wide_objects_meet_over_two_cells_of_twelve(spark):
    tiles = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 960.0, 720.0), (1, 0, 1, 672.0, 0.0, 960.0, 720.0)], "tile int, tr int, tc int, x0 double, y0 double, w double, h double")
    # Gate 4 + 0.15 * 78 = 15.7 px; x lies in the cells 66 and 68 of 12 px.
    rows = [(0, 1, 803.5, 300.0, 20.0, 78.0), (1, 1, 818.5, 300.0, 20.0, 78.0)]
    seen = spark.createDataFrame([(*r, 0.9, 100.0, False) for r in rows], "tile int, obj long, x double, y double, z double, r double, sharp double, edge double, clipped boolean")
    got = catalogue.matched(catalogue.with_sid(seen), tiles).collect()
    assert [(r.sa, r.sb) for r in got] == [(1, 10_000_000_001)]


def test_suppression_equals_the_sequential_rule(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), 1, float(rng.uniform(0, 60)), float(rng.uniform(0, 60)), float(rng.integers(0, 6)), float(rng.uniform(4, 20)), float(rng.integers(0, 9)) / 10) for i in range(150)]
    s = spark.createDataFrame(rows, "sid long, tile int, x double, y double, z double, r double, sharp double")
    got = {r.sid for r in matching.greedy_suppression(s, matching.suppression_conflicts(s, 2.65, 3.26, 20.0)).collect()}
    kept = []
    for row in sorted(rows, key=lambda r: (-r[6], r[0])):
        if not any(np.hypot(row[2] - k[2], row[3] - k[3]) < 0.5 * max(row[5], k[5]) and abs(row[4] - k[4]) * 2.65 < max(3.26 * 2.65, 0.6 * max(row[5], k[5])) for k in kept):
            kept.append(row)
    assert got == {k[0] for k in kept} and len(kept) < len(rows)


def test_suppression_by_blocks_writes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(i % 2), float(rng.uniform(0, 400)), float(rng.uniform(0, 90)), float(rng.integers(0, 6)), float(rng.uniform(4, 20)), float(rng.integers(0, 9)) / 10) for i in range(700)]
    s = spark.createDataFrame(rows, "sid long, tile int, x double, y double, z double, r double, sharp double")
    want = {r.sid for r in matching.greedy_suppression(s, matching.suppression_conflicts(s, 2.65, 3.26, 20.0)).collect()}
    monkeypatch.setattr(matching, "BLOCK_POINTS", 10)
    monkeypatch.setattr(matching, "near_pairs", None)
    assert {r.sid for r in matching.suppressed(s, 2.65, 3.26).collect()} == want and len(want) < len(rows)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "sa long, sb long")
    nodes = spark.createDataFrame([(i,) for i in [*range(21), 50, 51, 99]], "sid long")
    got = {r.sid: r.comp for r in matching.components(edges, nodes).collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50, 99: 99}


def test_neighbours_with_far_and_few_points(spark):
    pts = [(i, float(x), 0.0, 0.0, 5.0) for i, x in enumerate([0, 10, 30, 5000, 90000])]
    got = {r.obj: r for r in matching.knn(spark.createDataFrame(pts, "obj long, x double, y double, z double, r double"), 3, 1.0, 50.0).collect()}
    assert got[0].nn_distance_px == 10 and got[0].nn_gap_px == 0 and got[0].n_within_5r == 1
    assert got[4].mean_distance_knn_px == pytest.approx((85000 + 89970 + 89990) / 3)
    assert matching.knn(spark.createDataFrame(pts[:1], "obj long, x double, y double, z double, r double")).count() == 0


def _plane(spark, n, width, seed):
    rng = np.random.default_rng(seed)
    pts = [(int(i), float(rng.integers(0, width)) / 2, float(rng.integers(0, width)) / 2, float(rng.integers(0, 60)) / 2, float(rng.integers(4, 20))) for i in range(n)]
    return pts, spark.createDataFrame(pts, "sid long, x double, y double, z double, r double")


def test_neighbours_of_a_crowd_equal_all_pairs_and_no_pair_is_written(spark, monkeypatch):
    pts, df = _plane(spark, 1500, 300, 3)
    monkeypatch.setattr(matching, "BLOCK_POINTS", 100)
    rows = []
    held = matching.materialise
    monkeypatch.setattr(matching, "materialise", lambda d, *a: (rows.append((m := held(d, *a)).count()), m)[1])
    got = {r.sid: r for r in matching.knn(df, 5, 2.65, 20.0, "sid").collect()}
    p = np.array([x[1:4] for x in pts]) * [1, 1, 2.65]
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i, x in enumerate(pts):
        near = np.lexsort((np.arange(len(pts)), d[i]))[:5]
        assert got[i].nn_distance_px == pytest.approx(d[i, near[0]]) and got[i].mean_distance_knn_px == pytest.approx(d[i, near].mean())
        assert got[i].nn_gap_px == pytest.approx(d[i, near[0]] - x[4] - pts[near[0]][4]) and got[i].n_within_5r == (np.sqrt(((p - p[i]) ** 2).sum(axis=1)) < 5 * x[4]).sum() - 1
    assert sum(rows) <= 3 * len(pts)


def test_neighbours_cost_candidates_in_proportion(monkeypatch):
    """Ten times the points on one area: what is tested for each point grows less than the pairs do."""
    from stackmeter.kernels import points as kp

    tested = []
    held = kp.distances
    monkeypatch.setattr(kp, "distances", lambda a, b: (tested.append(len(a)), held(a, b))[1])
    for n in (2000, 20000):
        p = np.random.default_rng(n).uniform(0, 300, (n, 2))
        tested.append(0)
        kp.counts_within(p, p, np.full(n, 90.0))
    cut = len(tested) - 1 - tested[::-1].index(0)
    small, large = sum(tested[:cut]), sum(tested[cut:])
    assert large < 40 * small  # all pairs: 100 times


def test_halo_counts_equal_all_pairs(spark, monkeypatch):
    pts, df = _plane(spark, 900, 700, 4)
    monkeypatch.setattr(matching, "BLOCK_POINTS", 60)
    monkeypatch.setattr(matching, "near_pairs", None)  # no pairs are made
    got = {r.sid: r.n_halo for r in matching.halo_neighbours(df, 101.0).collect()}
    p = np.array([x[1:3] for x in pts])
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    want = {i: int(((d[i] > 0) & (d[i] < 3 * x[4] + 40)).sum()) for i, x in enumerate(pts)}
    assert got == {i: n for i, n in want.items() if n}


def test_numbers_are_gapless_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = {r.v: r.uid for r in catalogue.numbered(df.repartition(7), ["v"]).collect()}
    assert got == {i: i for i in range(1000)}


def test_links_close_after_a_gap(spark):
    rows = [(1, 10, 0, 5.0, 5.0, 4.0), (1, 11, 1, 5.5, 5.0, 4.0), (1, 12, 2, 60.0, 60.0, 4.0), (1, 13, 3, 60.0, 60.0, 4.0), (1, 14, 4, 60.0, 60.0, 4.0), (1, 15, 5, 5.0, 5.0, 4.0), (1, 16, 6, 5.0, 5.0, 4.0)]
    links = matching.linked_tracks(spark.createDataFrame(rows, "tile int, sid long, z int, x double, y double, r double"))
    held = {}
    for r in links.collect():
        held.setdefault(r.tid, []).append(r.sid)
    assert sorted(map(sorted, held.values())) == [[10, 11], [12, 13, 14], [15, 16]]


def test_links_hold_over_two_slices(spark):
    # Slices 1 and 2 are processed and have others; one more between the two closes the track.
    rows = lambda tile, last: [(tile, 100 * tile + z, z, 5.0 if z in (0, last) else 60.0, 5.0, 4.0) for z in range(last + 1)] + [(tile, 100 * tile + 50, last + 1, 5.0, 5.0, 4.0)]
    links = matching.linked_tracks(spark.createDataFrame(rows(1, 3) + rows(2, 4), "tile int, sid long, z int, x double, y double, r double"))
    held = {}
    for r in links.collect():
        held.setdefault((r.tile, r.tid), []).append(r.sid)
    assert sorted(map(sorted, held.values())) == [[100, 103, 150], [101, 102], [201, 202, 203], [204, 250]]


def test_links_of_each_tile_are_made_in_a_task_of_its_own(spark):
    rows = [(tile, 100 * tile + z, z, 5.0, 5.0, 4.0) for tile in range(12) for z in range(3)]
    links = matching.linked_tracks(spark.createDataFrame(rows, "tile int, sid long, z int, x double, y double, r double"))
    placed = links.select("tile", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(placed) == len({r.task for r in placed}) == 12


def test_recall_formula(spark):
    rows = [(2, 1)] * 312 + [(2, 2)] * 471 + [(1, 1)] * 9
    got = catalogue.recall(spark.createDataFrame(rows, "coverage_k long, n_views long")).first()
    assert (got.once, got.twice) == (312, 471) and got.implied_recall == pytest.approx(0.7512, abs=1e-4)
    assert catalogue.recall(spark.createDataFrame(rows[-3:], "coverage_k long, n_views long")).first().implied_recall is None


def test_registration_recovers_offsets(spark):
    truth = {(r, c): (c * 700.0 + r * 3, r * 500.0 - c * 2) for r in range(3) for c in range(4)}
    name = {k: i for i, k in enumerate(truth)}
    tiles = spark.createDataFrame([(name[k], k[0], k[1]) for k in truth], "tile int, tr int, tc int")
    edges = [(name[a], name[b], truth[b][0] - truth[a][0], truth[b][1] - truth[a][1], 0.7) for a, b in itertools.permutations(truth, 2) if (b[0] - a[0], b[1] - a[1]) in ((0, 1), (1, 0))]
    offsets, report = registration.solved_offsets(spark.createDataFrame(edges, "ta int, tb int, dx double, dy double, confidence double"), tiles)
    assert len(edges) == 17 and report["reliable"] == 1 and report["residual_max"] < 1e-6
    low = min(x for x, _ in truth.values()), min(y for _, y in truth.values())
    for r in offsets.collect():
        k = next(k for k, v in name.items() if v == r.tile)
        assert (r.x, r.y) == pytest.approx((truth[k][0] - low[0], truth[k][1] - low[1]), abs=1e-6)


def dense_offsets(edges, start):
    """Offsets by a dense solve of the same equations, every tile of its component held at its mean place."""
    names = list(start)
    a = np.zeros((len(edges), len(names)))
    for n, (s, t, _, _, w) in enumerate(edges):
        a[n, names.index(s)], a[n, names.index(t)] = -w, w
    out = []
    for k in (0, 1):
        base = np.array([start[t][k] for t in names])
        b = np.array([e[2 + k] * e[4] for e in edges]) - a @ base
        out.append(base + np.linalg.lstsq(a, b, rcond=None)[0])  # the least move
    return {t: (out[0][i] - out[0].min(), out[1][i] - out[1].min()) for i, t in enumerate(names)}


def test_registration_equals_a_dense_solve(spark):
    rng = np.random.default_rng(1)
    start = {t: tuple(rng.uniform(0, 900, 2)) for t in range(14)}
    start[99] = (2000.0, 50.0)  # no pair names it: it stays
    edges = []
    for _ in range(40):
        s, t = (int(v) for v in rng.choice(10, 2, replace=False))
        edges.append((s, t, *(np.subtract(start[t], start[s]) + rng.normal(0, 3, 2)), float(rng.uniform(0.06, 1))))
    edges += [(10, 11, 500.0, 3.0, 0.5), (11, 12, 500.0, 3.0, 0.1), (12, 13, 400.0, -3.0, 0.9), (10, 12, 1010.0, 5.0, 0.8)]  # another component
    edges = [(s, t, float(dx), float(dy), w) for s, t, dx, dy, w in edges]
    weak = [(0, 13, 9e9, 9e9, 0.04)]  # below the least confidence
    tiles = spark.createDataFrame([(t, *map(float, at)) for t, at in start.items()], "tile int, x0 double, y0 double")
    offsets, report = registration.solved_offsets(spark.createDataFrame(edges + weak, "ta int, tb int, dx double, dy double, confidence double"), tiles)
    want = dense_offsets(edges, start)
    got = {r.tile: (r.x, r.y) for r in offsets.collect()}
    assert got.keys() == want.keys() and report["used"] == len(edges)
    # A component's mean is kept weighted alike by both only up to a shift of its own.
    for group in (range(10), range(10, 14), [99]):
        group = list(group)
        shift = np.subtract(got[group[0]], want[group[0]])
        assert all(np.allclose(np.subtract(got[t], want[t]), shift, atol=1e-5) for t in group)


def test_registration_of_nothing(spark):
    tiles = spark.createDataFrame([(1, 3.0, 4.0), (2, 5.0, 4.0)], "tile int, x0 double, y0 double")
    offsets, report = registration.solved_offsets(spark.createDataFrame([], "ta int, tb int, dx double, dy double, confidence double"), tiles)
    assert report["reliable"] == 0 and {r.tile: (r.x, r.y) for r in offsets.collect()} == {1: (0.0, 0.0), 2: (2.0, 0.0)}


def test_registration_of_a_million_pairs(spark):
    n, m = 60_000, 1_000_000
    place = lambda t, k: F.pmod(F.xxhash64(F.col(t), F.lit(k)), F.lit(90_000)) / 7.0
    edges = spark.range(m).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).alias("ta"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n)).alias("tb")).where("ta <> tb")
    edges = edges.select("ta", "tb", *[(place("tb", k) - place("ta", k)).alias(f"d{a}") for k, a in enumerate("xy")], F.lit(0.5).alias("confidence"))
    tiles = spark.range(n).withColumnRenamed("id", "tile")
    offsets, report = registration.solved_offsets(edges, tiles, tolerance=1e-6)
    assert report["used"] > 0.99 * m and report["residual_max"] < 1e-3
    off = offsets.select((F.col("x") - place("tile", 0)).alias("e")).agg(F.max("e") - F.min("e")).first()[0]
    assert off < 1e-2


def test_placed_and_mirrored_strips(spark):
    rng = np.random.default_rng(2)
    world = image.blur(rng.normal(0, 1, (120, 200)), 1.0)
    at = {0: (0, 0), 1: (0, 70), 2: (55, 0), 3: (55, 70)}
    cut = lambda y, x: world[y : y + 65, x : x + 100]
    rows = [(t, z, 65, 100, (cut(*p) * (1 + t) + 9).reshape(-1).tolist()) for t, p in at.items() for z in range(2)]
    stack = spark.createDataFrame(rows, frames.FRAME)
    schema = "tile int, tr int, tc int, x0 double, y0 double, w double, h double"
    tiles = spark.createDataFrame([(t, y // 55, x // 70, float(x), float(y), 100.0, 65.0) for t, (y, x) in at.items()], schema)
    got = mosaic.placement(stack, tiles).collect()
    assert {(r.ta, r.tb, r.axis) for r in got} == {(0, 1, "x"), (2, 3, "x"), (0, 2, "y"), (1, 3, "y")} and all(r.agrees and r.z == 1 for r in got)
    swapped = spark.createDataFrame([(t, 1 - y // 55, 1 - x // 70, float(70 - x), float(55 - y), 100.0, 65.0) for t, (y, x) in at.items()], schema)
    assert all(r.ratio < 1 / 3 for r in mosaic.placement(stack, swapped).collect())
    a, b = world[:20, :30], world[5:25, 4:34]
    assert image.phase_peak(a, a) == pytest.approx(1, abs=0.02) and image.phase_peak(a, b) > 2 * image.phase_peak(a, world[60:80, 90:120])


def test_cap_bootstrap(spark):
    rng = np.random.default_rng(0)
    noise = rng.normal(0, 3, 24)
    rows = [(z, float(np.sqrt(1226**2 - (z * 10.6 - 1100) ** 2) + noise[z])) for z in range(24)]
    rings = spark.createDataFrame(rows, "z int, radius double")
    got = curves.cap_bootstrap(rings, 100.0).first()
    again = curves.cap_bootstrap(rings.repartition(5), 100.0).first()
    assert got == again and got.draws == 40 and got.n == 24 and 0 < got.radius_sd < 20 and 0 < got.spread_pct < 5
    assert curves.cap_bootstrap(rings, 100.0, seed=1).first() != got and curves.cap_bootstrap(rings.where("z < 3"), 100.0).count() == 0
    # The same draws by hand.
    import hashlib

    cz = []
    for d in range(1, 41):
        pick = [int(hashlib.md5(f"0:{d}:{s}".encode()).hexdigest()[:8], 16) % 24 for s in range(1, 25)]
        z, r = np.array([rows[i] for i in pick]).T
        slope, _ = np.polyfit(z * 10.6, r**2 + (z * 10.6) ** 2, 1)
        cz.append(slope / 2)
    assert got.cz_sd == pytest.approx(np.std(cz), rel=1e-6)


def test_seed_axis_rules(spark):
    rows = [(s, z, y, x, 10.0 if (abs(x - 8) < w and abs(y - 5) < w) else (x * 7 + y * 3) % 5 / 10) for s, w in ((0, 6), (1, 3)) for z in range(9) for y in range(16) for x in range(20)]
    rows = [(s, z, y, x, -v if z >= 6 else v) for s, z, y, x, v in rows]  # below the sixth slice the picture is another
    t = spark.createDataFrame(rows, "stack int, z int, y int, x int, v double")
    canvases = spark.createDataFrame([(0, 80, 64), (1, 80, 64), (2, 10, 20)], "stack int, width int, height int")
    got = {r.stack: r for r in registration.seed_axis(t, canvases).collect()}
    assert got[0].cx == pytest.approx(32.0) and got[0].n == 6 * 11 * 11 and got[0].cy == pytest.approx(20.0)
    assert (got[1].cx, got[1].cy, got[1].n) == (40.0, 32.0, 0) and (got[2].cx, got[2].cy) == (5.0, 10.0)
    blocks = registration.block_means(spark.createDataFrame([(0, 0, y, x, float(y)) for y in range(9) for x in range(8)], "stack int, z int, y int, x int, v double"))
    assert sorted((r.y, r.x, r.v) for r in blocks.collect()) == [(0, 0, 1.5), (0, 1, 1.5), (1, 0, 5.5), (1, 1, 5.5)]


def test_cap_identity():
    d = Dome()
    height = d.radius - (d.cz - d.glass) * d.anisotropy
    assert d.contact_radius**2 == pytest.approx(height * (2 * d.radius - height))


def test_absent_scales_stay_absent(spark):
    depth = [scalars.scales(a)["dof_slices"] for a in (Acquisition(px_um=None), Acquisition())]
    assert spark.range(1).select(*depth).first() == (3.0, pytest.approx(3.2622))
    df = spark.createDataFrame([(None, 10.0, 0.2, 5.0, 3.5)], "px_um double, z_um double, na double, r double, z double")
    row = scalars.assembled(scalars.with_scales(df)).first()
    assert row.diameter_um is None and row.volume_um3 is None and row.anisotropy == 1.0 and row.best_slice == 4


def test_composite_of_equal_tiles_is_flat(spark):
    rows = [(x + o, y, 77.0, o) for o in (0, 6) for y in range(8) for x in range(8)]
    p = spark.createDataFrame(rows, "cx int, cy int, v double, o int").withColumn("weight", scalars.feather_weight(F.col("cx") - F.col("o"), F.col("cy"), F.lit(8), F.lit(8), F.lit(2.0)))
    got = frames.composite(p).collect()
    assert {r.v for r in got} == {77} and sum(r.n == 2 for r in got) == 16


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, None, "a"), (2, None, None, "b")], "uid long, diameter_px double, diameter_um double, views string")
    assert outputs.object_table(df, False).columns == ["uid", "diameter_px", "views"]
    assert outputs.without_empty_columns(df).columns == ["uid", "diameter_px", "views"]
    outputs.write_csv(df, f"{tmp_path}/t")
    assert sorted(map(tuple, outputs.read_csv(spark, f"{tmp_path}/t", df).collect())) == sorted(map(tuple, df.collect()))
    assert outputs.params_key(Params()) == outputs.params_key(Params()) != outputs.params_key(Params(min_track=3))
    done = spark.createDataFrame([(1, "k"), (2, "old")], "stack int, params_key string")
    assert [r.stack for r in outputs.pending(spark.createDataFrame([(1,), (2,), (3,)], "stack int").orderBy("stack"), done, "k").orderBy("stack").collect()] == [2, 3]
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 0, 1.0, 0.0, 2.0)], "place long, vid int, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (1, 0, 0, 1, 2)], "place long, fid int, a int, b int, c int")
    lines = [r.line for r in outputs.ply_lines(v, f, 3).orderBy("part", "place", "n").collect()]
    assert lines[2:] == ["3 0 1 2", "3 3 4 5"] and lines[0].startswith("0.0000 0.0000 0.0000 ") and outputs.ply_header(2, 2).startswith("ply\n")
    assert outputs.as_json(df).first().json == '{"uid":1,"diameter_px":2.5,"views":"a"}'


def test_results_listing(spark, tmp_path):
    import json

    from stackmeter.operators import reports

    for run, units, dome in (("a", {"px_um": 3.7, "z_um": 10.0}, {"radius_px": 5.0}), ("b", {"px_um": None, "z_um": None}, None)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "organoids.json").write_text(json.dumps({"units": units, "dome": dome, "organoids": [{"id": 1}, {"id": 2}]}, indent=1))
    got = sorted(map(tuple, reports.results_listing(spark, str(tmp_path)).collect()))
    assert got == [("a", 2, True, True), ("b", 2, False, False)]


def test_missing_saved_offset_stops(spark):
    from stackmeter.operators import reports

    tiles = spark.createDataFrame([(1,), (2,)], "tile int")
    saved = spark.createDataFrame([(1, 0.5, 0.0)], "tile int, x0 double, y0 double")
    with pytest.raises(Exception, match="no saved offset for tile 2"):
        reports.with_saved_offsets(tiles, saved).collect()


def test_focal_planes_count_a_plateau_by_its_middle(spark):
    rows = [(1, z, v) for z, v in enumerate([0.0, 1.0, 0.0, 0.0, 5.0, 5.0, 0.0, 2.0, 2.0])] + [(2, z, v) for z, v in enumerate([0.0, 3.0, 0.0])]
    got = curves.focal_planes(spark.createDataFrame(rows, "oid long, z int, v double")).select("oid", "rank", "z", "prominence", "refined")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 4, 1.0, 4.5), (1, 1, 1, 0.2, 1.0), (2, 0, 1, 1.0, 1.0)]  # the last slices are no top


def test_meshes_of_one_file_are_made_by_many_tasks(spark):
    objects = spark.createDataFrame([(i,) for i in range(40)], "oid long").coalesce(1)
    faces = mesh.spheroid_faces(objects, 4, 2).withColumn("task", F.spark_partition_id())
    rows = faces.collect()
    assert len({r.task for r in rows}) > 1 and len(rows) == 40 * 16
    assert sorted((r.fid, r.a, r.b, r.c) for r in rows if r.oid == 7)[:4] == [(0, 0, 1, 4), (1, 1, 5, 4), (2, 1, 2, 5), (3, 2, 6, 5)]
    caps = objects.select("oid", *[F.lit(9.0).alias(c) for c in ("cx", "cy", "cz", "radius", "contact", "anisotropy")])
    assert mesh.cap_vertices(caps).select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_first_planes_and_means_of_rows(spark):
    slices = spark.createDataFrame([(s, z) for s, held in ((0, (9, 4, 2, 4)), (1, (7,))) for z in held], "stack int, z int")
    assert sorted((r.stack, r.z) for r in registration.first_planes(slices, 2).collect()) == [(0, 2), (0, 4), (1, 7)]
    pixels = [(0, 0, y, x, float(x * x + 3 * y)) for y in range(9) for x in range(8)]
    halves = [(0, 0, y, b, sum(v for *_, yy, x, v in pixels if yy == y and x // 4 == b) / 4) for y in range(9) for b in range(2)]
    kind = "stack int, z int, y int, x int, v double"
    got, want = (sorted(map(tuple, registration.block_means(spark.createDataFrame(rows, kind), *size).collect())) for rows, size in ((halves, (4, 1)), (pixels, (4,))))
    assert got == want and len(want) == 4
