"""Queries that need whole frames: canvases and objects laid out from the embedding vectors, one frame a vector.

Frame v has row y from vector (v + y) % n; its object's outline is vector v around a radius of 5 to 10 pixels, and the
frame is darker inside a disc.  Tiles stand 28 pixels apart, so that they overlap and neighbours reach into halos.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import catalogue as cat
from .operators import curves, frames, matching, mesh, registration
from .plans import features, field, mosaic, outputs
from .plans.views import table, view
from .queries import ACQ, DOME, PAR, _r, _with, query, rounded
from .storage import materialise

SIDE, PITCH, ROW = 64, 28, 25


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("px"))


def _canvas_rows(e: DataFrame, of: DataFrame) -> DataFrame:
    """(stack, y, px, ...): the rows of the frames ``of`` (vec_id, ...), laid out from the vectors ``e`` (vec_id, px)."""
    n = e.agg(F.count(F.lit(1)).alias("n"))  # one row
    more = [c for c in of.columns if c != "vec_id"]
    wanted = of.select(F.col("vec_id").alias("stack"), *more).join(F.broadcast(n)).select("stack", "n", *more, F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("y"))
    return wanted.withColumn("vec_id", (F.col("stack") + F.col("y")) % F.col("n")).join(e, "vec_id").select(F.col("stack").cast("int").alias("stack"), "y", "px", *more)


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    """The object of each frame, in its tile's coordinates."""
    v, emb = F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double"))
    outline = table(spark, sf, "embeddings").select("vec_id", F.transform(emb, lambda x: 5.0 + (v % 6) + 4.0 * x).alias("profile"))
    nexts = F.concat(F.slice("profile", 2, SIDE - 1), F.slice("profile", 1, 1))
    area = 0.5 * math.sin(2 * math.pi / SIDE) * F.aggregate(F.zip_with("profile", nexts, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return outline.select(
        v.cast("int").alias("stack"), v.alias("oid"), (31.5 + ((v * 7) % 11 - 5) / 2).alias("x"), (31.5 + ((v * 13) % 11 - 5) / 2).alias("y"), (((v * 31) % 1190) / 10).alias("z"), "profile", area.alias("area"), F.sqrt(area / math.pi).alias("r"),
        (((v * 37) % 100) / 100).alias("sharp"), (0.5 + (v % 50) / 100).alias("circ"), (1 + v % 9).alias("n_slices"), F.lit(0).alias("z_first"), F.lit(118).alias("z_last"), F.when(v % 2 == 0, "edf").otherwise("slices").alias("source"),
    )


def _tiles(objects: DataFrame) -> DataFrame:
    row, column = F.floor(F.col("stack") / ROW).cast("int"), F.col("stack") % ROW
    return objects.select(F.col("stack").alias("tile"), row.alias("tr"), column.alias("tc"), (column * float(PITCH)).alias("x0"), (row * float(PITCH)).alias("y0"), F.lit(float(SIDE)).alias("w"), F.lit(float(SIDE)).alias("h"))


def _frames(spark: SparkSession, sf: str, objects: DataFrame) -> DataFrame:
    """One frame a stack, at its object's slice."""
    e = _vectors(spark, sf).withColumn("px", F.transform("px", lambda v: 200.0 + 200.0 * v))
    places = objects.select(F.col("oid").alias("vec_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), scalars.half_even(F.col("z")).cast("int").alias("z"))
    dark = F.expr("if(abs(y - cy) <= 8.0, transform(px, (v, x) -> if((x - cx) * (x - cx) + (y - cy) * (y - cy) <= 64.0, v * 0.55, v)), px)")
    rows = _canvas_rows(e, places).select("stack", "z", "y", dark.alias("px"))
    cells = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "px"))), lambda c: c["px"]))
    return rows.groupBy("stack", "z").agg(cells.alias("px")).select("stack", "z", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), "px")


def _matrix(spark: SparkSession, sf: str, only: list[str] | None = None) -> DataFrame:
    objects = _objects(spark, sf)
    tiles = _tiles(objects)
    seen = matching.with_clipped(cat.with_sid(mosaic.sightings(objects, tiles)), PAR)
    merged = cat.catalogue(cat.with_components(seen, _no_pairs(seen)), tiles, PAR)
    return features.matrix(merged, features.record(objects, ACQ, None, PAR), _frames(spark, sf, objects), tiles, ACQ, DOME, n_theta=SIDE, only=only)


def _no_pairs(seen: DataFrame) -> DataFrame:
    return seen.select(F.col("sid").alias("sa"), F.col("sid").alias("sb")).where("sa <> sb")


@query()
def features_all(spark, sf):
    """All columns of the matrix; pixels, hulls and arrays are checked by the tests."""
    return _matrix(spark, sf)


_TABULAR = [c for c in features.columns() if c not in ("radial_profile_px", "radial_profile_um", "z_extent_slices", "solidity", "convexity", "shape_suspect") and not c.startswith(("core_", "rim_", "body_", "background_", "halo_", "outline_empty", "appearance_", "missing_"))]
_STEP = 2 * math.pi / SIDE
_OBJECTS = f"""o AS (SELECT vec_id AS v, CAST(vec_id AS INT) AS tile, list_transform(embedding, lambda e: 5e0 + vec_id % 6 + 4e0*CAST(e AS DOUBLE)) AS p, 31.5e0 + ((vec_id*7) % 11 - 5)/2e0 AS lx, 31.5e0 + ((vec_id*13) % 11 - 5)/2e0 AS ly, ((vec_id*31) % 1190)/10e0 AS z,
  CAST(floor(vec_id/25e0) AS INT) AS tr, CAST(vec_id % 25 AS INT) AS tc FROM embeddings),
 k AS (SELECT v, unnest(range(0, 64)) AS k, unnest(p) AS r, p FROM o), q AS (SELECT v, k, r, p[(k + 1) % 64 + 1] AS r2 FROM k),
 m AS (SELECT v, {0.5 * math.sin(_STEP)!r}e0*sum(r*r2) AS area, avg(r) AS rm, stddev_pop(r) AS rs, min(r)/max(r) AS rr, max(r) AS top, sum(sqrt(power(r2*cos((k+1)*{_STEP!r}e0) - r*cos(k*{_STEP!r}e0), 2) + power(r2*sin((k+1)*{_STEP!r}e0) - r*sin(k*{_STEP!r}e0), 2))) AS per FROM q GROUP BY v),
 h AS (SELECT v, f, sqrt(power(sum(r*cos({_STEP!r}e0*((f*k) % 64))), 2) + power(sum(r*sin({_STEP!r}e0*((f*k) % 64))), 2)) AS a FROM k, (SELECT unnest(range(0, 33)) AS f) GROUP BY v, f),
 w AS (SELECT v, {', '.join(f"max(a) FILTER (f = {i})/max(a) FILTER (f = 0) AS harmonic_{i}" for i in range(1, 7))}, sum(a) FILTER (f >= 7)/max(a) FILTER (f = 0) AS harmonic_high FROM h GROUP BY v),
 c AS (SELECT o.*, m.*, sqrt(area/{math.pi!r}e0) AS r, tc*28e0 + lx AS x, tr*28e0 + ly AS y, tc*28e0 AS x0, tr*28e0 AS y0, least(lx, 64e0 - lx, ly, 64e0 - ly) AS edge FROM o JOIN m USING (v)),
 u AS (SELECT *, row_number() OVER (ORDER BY y, x, tile, v) - 1 AS uid FROM c), cov AS (SELECT u.v, count(*) AS coverage_k FROM u JOIN c t ON u.x BETWEEN t.x0 AND t.x0 + 64 AND u.y BETWEEN t.y0 AND t.y0 + 64 GROUP BY u.v),
 d AS (SELECT a.v, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z*{10 / 3.7744!r}e0 - b.z*{10 / 3.7744!r}e0)*(a.z*{10 / 3.7744!r}e0 - b.z*{10 / 3.7744!r}e0)) AS d, a.r, b.r AS r2, row_number() OVER (PARTITION BY a.v ORDER BY sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z*{10 / 3.7744!r}e0 - b.z*{10 / 3.7744!r}e0)*(a.z*{10 / 3.7744!r}e0 - b.z*{10 / 3.7744!r}e0)), b.uid) AS n FROM u a JOIN u b ON a.v <> b.v),
 nn AS (SELECT v, min(d) AS nn_distance_px, max(d - r - r2) FILTER (n = 1) AS nn_gap_px, CAST(count(*) FILTER (d < 5*r) AS DOUBLE) AS n_within_5r, avg(d) FILTER (n <= 5) AS mean_distance_5nn_px FROM d GROUP BY v),
 sp AS (SELECT v, sqrt((x-{DOME.cx}e0)*(x-{DOME.cx}e0) + (y-{DOME.cy}e0)*(y-{DOME.cy}e0)) AS radial, {DOME.radius}e0 - sqrt((x-{DOME.cx}e0)*(x-{DOME.cx}e0) + (y-{DOME.cy}e0)*(y-{DOME.cy}e0) + power((z-{DOME.cz}e0)*{DOME.anisotropy}e0, 2)) - r AS clear FROM u),
 sq AS (SELECT *, CASE WHEN {DOME.contact_radius!r}e0 - radial < 0 THEN abs(({DOME.glass}e0 - z)*{DOME.anisotropy}e0) - r ELSE {DOME.contact_radius!r}e0 - radial - r END AS border FROM sp JOIN u USING (v))"""
_NUMBERS = {
    "x_mosaic_px": "x", "y_mosaic_px": "y", "lateral_spread_px": "0e0", "axial_spread_slices": "0e0", "radius_ratio": "1e0", "x_px": "lx", "y_px": "ly", "z_slice": "z", "radius_px": "r", "diameter_px": "2*r", "radius_z_slices": "r/2.6494277236116998e0",
    "area_px2": "area", "volume_voxels": "4.1887902047863905e0*r*r*r/2.6494277236116998e0", "circularity": "12.566370614359172e0*area/(per*per)", "focus_sharpness": "((v*37) % 100)/100e0", "dome_distance_px": "clear", "dome_surface_slice": "CAST(NULL AS DOUBLE)",
    "x_um": "lx*3.7744e0", "y_um": "ly*3.7744e0", "z_um": "z*10e0", "radius_um": "r*3.7744e0", "diameter_um": "2*r*3.7744e0", "radius_z_um": "r/2.6494277236116998e0*10e0", "area_um2": "area*3.7744e0*3.7744e0", "volume_um3": "4.1887902047863905e0*r*r*3.7744e0*3.7744e0*r/2.6494277236116998e0*10e0", "dome_distance_um": "CAST(NULL AS DOUBLE)",
    "outline_area_px2": "area", "outline_perimeter_px": "per", "radius_mean_px": "rm", "radius_std_px": "rs", "radius_cv": "rs/rm", "radius_min_over_max": "rr", **{c: c for c in features.MORPHOLOGY if c.startswith("harmonic")},
    "height_above_glass_slices": f"{DOME.glass}e0 - z", "dome_radial_px": "radial", "dome_azimuth_deg": f"(degrees(atan2(y - {DOME.cy}e0, x - {DOME.cx}e0)) + 360e0) % 360e0", "dome_radial_frac": f"radial/{DOME.contact_radius!r}e0", "contact_edge_distance_px": "border",
    "nearest_border_is_cap": "CASE WHEN clear <= border THEN 1e0 ELSE 0e0 END", "nearest_border_px": "least(clear, border)", **{c: c for c in features.neighbourhood()},
}
_WHOLE = {
    "uid": "uid", "tile": "tile", "tile_row": "tr", "tile_col": "tc", "n_views": "CAST(1 AS BIGINT)", "views": "CAST(tile AS VARCHAR)", "coverage_k": "CAST(coverage_k AS BIGINT)", "clipped": "edge < top + 2", "clipped_everywhere": "edge < top + 2", "single_view_in_overlap": "coverage_k > 1",
    "radius_disagreement": "false", "same_tile_twice": "false", "guarantee_void": "r > 18e0", "oid": "v", "best_slice": "CAST(round_even(z, 0) AS INT)", "n_slices": "1 + v % 9", "source": "CASE WHEN v % 2 = 0 THEN 'edf' ELSE 'slices' END",
}


@query(f"WITH {_OBJECTS} SELECT {', '.join(_r(_NUMBERS[c], c, 3) if c in _NUMBERS else f'{_WHOLE[c]} AS {c}' for c in _TABULAR)} FROM sq JOIN w USING (v) JOIN cov USING (v) JOIN nn USING (v)")
def feature_table(spark, sf):
    """The matrix's columns that need no pixels, hulls or arrays."""
    return rounded(_matrix(spark, sf, _TABULAR), 3)


@query()
def placed_or_mirrored(spark, sf):
    """Whether neighbouring windows cut from one wide canvas, a column a vector, lie on each other as laid out."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("px"))
    # Window t holds the columns 44 t to 44 t + 63; the last, shorter one is left out by its width.
    own = F.floor(F.col("vec_id") / 44).cast("int")
    at = e.select(F.explode(F.array(own, own - 1)).alias("stack"), "vec_id", "px").withColumn("x", (F.col("vec_id") - F.col("stack") * 44).cast("int")).where("stack >= 0 and x < 64")
    columns = at.groupBy("stack").agg(F.array_sort(F.collect_list(F.struct("x", "px"))).alias("c")).where(F.size("c") == SIDE)
    whole = columns.select("stack", F.lit(0).alias("z"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.expr(f"transform(sequence(0, {SIDE * SIDE - 1}), i -> c[i % {SIDE}].px[i div {SIDE}])").alias("px"))
    tiles = columns.select(F.col("stack").alias("tile"), F.lit(0).alias("tr"), F.col("stack").alias("tc"), (F.col("stack") * 44.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(float(SIDE)).alias("w"), F.lit(float(SIDE)).alias("h"))
    return rounded(mosaic.placement(whole, tiles))


_CANVAS = "px AS (SELECT a.vec_id AS s, y, x, CAST(b.embedding[x + 1] AS DOUBLE) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS y FROM embeddings) a JOIN embeddings b ON b.vec_id = (a.vec_id + a.y) % (SELECT count(*) FROM embeddings), (SELECT unnest(range(0, 64)) AS x))"


@query(f"""WITH {_CANVAS}, b AS (SELECT CAST(floor(s/50e0) AS INT) AS stack, s % 50 AS z, y//4 AS y, x//4 AS x, avg(v) AS v FROM px WHERE s % 50 < 6 GROUP BY ALL),
 st AS (SELECT stack, z, median(v) AS m, stddev_pop(v) AS d FROM b GROUP BY ALL), p AS (SELECT stack, z, sum(x) AS sx, sum(y) AS sy, count(*) AS n FROM b JOIN st USING (stack, z) WHERE round(v - m - 0.2e0*d, 12) > 0 GROUP BY ALL HAVING count(*) >= 100),
 f AS (SELECT stack, 4*sum(sx)/sum(n) AS cx, 4*sum(sy)/sum(n) AS cy, sum(n) AS n FROM p GROUP BY stack)
 SELECT stack, {_r('coalesce(cx, 32e0)', 'cx')}, {_r('coalesce(cy, 32e0)', 'cy')}, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT stack FROM b) LEFT JOIN f USING (stack)""")  # fmt: skip
def seed_axis(spark, sf):
    stack, z = F.floor(F.col("vec_id") / 50).cast("int").alias("stack"), (F.col("vec_id") % 50).alias("z")
    e = _vectors(spark, sf)
    upper = e.select("vec_id", stack, z).join(registration.first_planes(e.select(stack, z)), ["stack", "z"], "left_semi")
    # A vector's means over four of its pixels travel to the frames instead of the pixels.
    means = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(SIDE // 4 - 1)), lambda i: (F.get("px", 4 * i) + F.get("px", 4 * i + 1) + F.get("px", 4 * i + 2) + F.get("px", 4 * i + 3)) / 4).alias("px"))
    rows = _canvas_rows(means, upper.select("vec_id")).withColumnRenamed("stack", "vec_id").select(stack, z, "y", "px").repartition("stack", "z")
    small = materialise(registration.block_means(rows.select("stack", "z", "y", F.posexplode("px").alias("x", "v")), 4, 1), "texture")
    return rounded(registration.seed_axis(small, small.select("stack", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height")).distinct(), 0.2))


_DIGEST = "CAST('0x' || substr(md5('0:' || draw || ':' || slot), 1, 8) AS BIGINT)"


@query(_with(("v_rings",), f"""SELECT n, count(*) AS draws, {_r('stddev_pop(cz)', 'cz_sd')}, {_r('stddev_pop(radius)', 'radius_sd')}, {_r('median(contact)', 'contact_median')}, {_r('stddev_pop(contact)', 'contact_sd')}, {_r('100*stddev_pop(contact)/median(contact)', 'spread_pct')}
 FROM (SELECT *, sqrt(greatest(radius*radius - power(1060e0 - cz, 2), 0e0)) AS contact FROM (SELECT n, s/2 AS cz, sqrt(c + s*s/4) AS radius FROM fit WHERE c + s*s/4 > 0)) GROUP BY n""",
  "ring AS (SELECT z*10.6e0 AS zz, radius*radius + z*10.6e0*z*10.6e0 AS q, row_number() OVER (ORDER BY z, radius) AS i FROM v_rings), tot AS (SELECT count(*) AS n FROM v_rings)",
  f"slots AS (SELECT n, draw, slot, {_DIGEST} % n + 1 AS i FROM tot, (SELECT unnest(range(1, 41)) AS draw), LATERAL (SELECT unnest(range(1, n + 1)) AS slot))", "fit AS (SELECT n, draw, regr_slope(q, zz) AS s, regr_intercept(q, zz) AS c FROM slots JOIN ring USING (i) GROUP BY ALL)"))
def cap_bootstrap(spark, sf):
    return rounded(curves.cap_bootstrap(view(spark, sf, "v_rings"), 100.0))


_EDGES = "e AS (SELECT p.ta, p.tb, b.x0 - a.x0 + (p.ta % 3 - 1)*0.05e0 AS dx, b.y0 - a.y0 + (p.tb % 4)*0.03e0 AS dy FROM v_pairs p JOIN v_tiles a ON p.ta = a.tile JOIN v_tiles b ON p.tb = b.tile), l AS (SELECT tb AS tile, ta AS other, dx, dy FROM e UNION ALL SELECT ta, tb, -dx, -dy FROM e)"


@query(_with(("v_pairs",), f"SELECT tile, {_r('x - min(x) OVER ()', 'x', 3)}, {_r('y - min(y) OVER ()', 'y', 3)} FROM it WHERE step = 400", _EDGES,
  "it AS (SELECT 0 AS step, tile, x0 AS x, y0 AS y FROM v_tiles UNION ALL SELECT a.step + 1, a.tile, a.x + 0.5e0*avg(b.x + l.dx - a.x), a.y + 0.5e0*avg(b.y + l.dy - a.y) FROM it a JOIN l USING (tile) JOIN it b ON b.tile = l.other WHERE a.step < 400 GROUP BY a.step, a.tile, a.x, a.y)"))
def register_solve(spark, sf):
    """Offsets that fit pair offsets which contradict each other a little; the SQL takes 400 damped steps towards them."""
    t = view(spark, sf, "v_tiles")
    a, b = t.select(F.col("tile").alias("ta"), F.col("x0").alias("ax"), F.col("y0").alias("ay")), t.select(F.col("tile").alias("tb"), F.col("x0").alias("bx"), F.col("y0").alias("by"))
    edges = matching.neighbour_pairs(t).join(a, "ta").join(b, "tb").select("ta", "tb", (F.col("bx") - F.col("ax") + (F.col("ta") % 3 - 1) * 0.05).alias("dx"), (F.col("by") - F.col("ay") + (F.col("tb") % 4) * 0.03).alias("dy"), F.lit(0.8).alias("confidence"))
    return rounded(registration.solved_offsets(edges, t, PAR)[0], 3)


_TRIES = "t AS (SELECT unnest([0, 1, 2, 3]) AS j)"
_CROWD = """c AS (SELECT c_custkey AS k, i, j, ((c_custkey*31 + i*17 + j*29 + i*j*7) % 97)/100e0 + power(2e0, 3*i + j)*1e-7 AS cost FROM customer, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([1, 2, 3]) AS j) WHERE (c_custkey*7 + i*3 + j*5) % 4 < 3),
 a AS (SELECT k, j AS a FROM c WHERE i = 1 UNION ALL SELECT DISTINCT k, 0 FROM c), b AS (SELECT k, j AS b FROM c WHERE i = 2 UNION ALL SELECT DISTINCT k, 0 FROM c), d AS (SELECT k, j AS d FROM c WHERE i = 3 UNION ALL SELECT DISTINCT k, 0 FROM c),
 m AS (SELECT k, a, b, d FROM a JOIN b USING (k) JOIN d USING (k) WHERE (a = 0 OR (a <> b AND a <> d)) AND (b = 0 OR b <> d)),
 s AS (SELECT m.*, (a > 0)::INT + (b > 0)::INT + (d > 0)::INT AS n, coalesce(x.cost, 0) + coalesce(y.cost, 0) + coalesce(z.cost, 0) AS total FROM m LEFT JOIN c x ON x.k = m.k AND x.i = 1 AND x.j = a LEFT JOIN c y ON y.k = m.k AND y.i = 2 AND y.j = b LEFT JOIN c z ON z.k = m.k AND z.i = 3 AND z.j = d),
 w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, total) = 1)"""


@query(f"""WITH {_CROWD} SELECT CAST(c.k AS INT) AS ta, CAST(c.k AS INT) + 1 AS tb, c.k*10 + i AS sa, c.k*10 + j AS sb, {_r('cost', 'cost', 6)} FROM w JOIN c ON c.k = w.k AND c.j = CASE c.i WHEN 1 THEN a WHEN 2 THEN b ELSE d END""")
def assignment_conflicts(spark, sf):
    """Three sightings against three in every seam, most pairs within the gate; the SQL enumerates all matchings."""
    side = F.explode(F.array(*map(F.lit, (1, 2, 3))))
    k = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), side.alias("i")).select("k", "i", side.alias("j")).where((F.col("k") * 7 + F.col("i") * 3 + F.col("j") * 5) % 4 < 3)
    cost = ((F.col("k") * 31 + F.col("i") * 17 + F.col("j") * 29 + F.col("i") * F.col("j") * 7) % 97) / 100 + F.pow(F.lit(2.0), 3 * F.col("i") + F.col("j")) * 1e-7
    edges = k.select(F.col("k").cast("int").alias("ta"), (F.col("k") + 1).cast("int").alias("tb"), (F.col("k") * 10 + F.col("i")).alias("sa"), (F.col("k") * 10 + F.col("j")).alias("sb"), cost.alias("cost"))
    return rounded(matching.assigned(edges), 6)


_ACQS = "acq AS (SELECT s_suppkey AS acq, CASE WHEN s_nationkey % 4 <> 0 THEN 3e0 + (s_suppkey % 13)/10e0 END AS px_um, CASE WHEN s_nationkey % 3 <> 0 THEN 5e0 + s_suppkey % 7 END AS z_um, CASE WHEN s_suppkey % 5 <> 0 THEN 0.1e0 + (s_suppkey % 4)/10e0 END AS na FROM supplier), sc AS (SELECT *, px_um IS NOT NULL AND z_um IS NOT NULL AS calibrated, 0.55e0/(na*na) + px_um/na AS dof_um FROM acq)"


@query(f"WITH {_ACQS} SELECT acq, calibrated, {_r('CASE WHEN calibrated THEN z_um/px_um ELSE 1e0 END', 'anisotropy', 6)}, CASE WHEN calibrated THEN 'calibration' ELSE 'assumed' END AS scale_source, {_r('dof_um', 'dof_um', 6)}, {_r('coalesce(dof_um/z_um, 3e0)', 'dof_slices', 6)} FROM sc")
def depth_of_field(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    a = table(spark, sf, "supplier").select(k.alias("acq"), F.when(n % 4 != 0, 3.0 + (k % 13) / 10).alias("px_um"), F.when(n % 3 != 0, 5.0 + k % 7).alias("z_um"), F.when(k % 5 != 0, 0.1 + (k % 4) / 10).alias("na"))
    return rounded(scalars.with_scales(a).select("acq", "calibrated", "anisotropy", "scale_source", "dof_um", "dof_slices"), 6)


@query(_with(("v_curves",), "SELECT DISTINCT oid, CAST(round_even(i*(depth - 1)/6e0, 0) AS INT) AS z FROM (SELECT oid, max(z) + 1 AS depth FROM v_curves GROUP BY oid), (SELECT unnest(range(0, 7)) AS i)"))
def sampled_slices(spark, sf):
    depth = view(spark, sf, "v_curves").groupBy("oid").agg((F.max("z") + 1).alias("depth"))
    return frames.sampled(depth, "depth").select("oid", "z")


@query(_with(("v_objects",), f"SELECT obj, r AS radius FROM (SELECT obj, r, 0.5e0 + (obj % 50)/100e0 AS circ, 6 + obj % 5 AS points FROM v_objects) WHERE r BETWEEN 4e0 AND 80e0 AND circ >= 0.55e0 AND points >= 8"))
def size_shape_gate(spark, sf):
    o = view(spark, sf, "v_objects").select("obj", F.col("r").alias("radius"), (0.5 + (F.col("obj") % 50) / 100).alias("circ"), F.sequence(F.lit(1), (6 + F.col("obj") % 5).cast("int")).alias("xs"))
    return field.gated(o, PAR).select("obj", "radius")


@query(_with(("v_curves",), "SELECT c.oid AS stack, z FROM v_curves c JOIN (SELECT oid, greatest(3, least(max(z) + 1, oid % 30 - 3 + 1)) AS lim FROM v_curves GROUP BY oid) USING (oid) WHERE z < lim"))
def analysed_range(spark, sf):
    stack = view(spark, sf, "v_curves").select(F.col("oid").alias("stack"), "z")
    planes = stack.select("stack").distinct().withColumn("plane", F.col("stack") % 30)
    return field.analysed(stack, planes, PAR).select("stack", "z")


@query(_with(("v_tiles",), """SELECT vec_id AS oid, round_even(5e0 + vec_id % 6 + 4e0*CAST(embedding[1] AS DOUBLE), 1) + 0e0 AS first_radius, len(embedding) AS n_radii, round_even(((vec_id*31) % 1190)/10e0/3e0, 4) AS third_of_z FROM embeddings"""))
def payload_trim(spark, sf):
    o = _objects(spark, sf).select("oid", F.col("profile").alias("radial_profile_px"), F.col("profile").alias("radial_profile_um"), (F.col("z") / 3).alias("third_of_z"))
    small = outputs.trimmed(o)
    return small.select("oid", (F.element_at("radial_profile_px", 1) + 0.0).alias("first_radius"), F.size("radial_profile_px").cast("long").alias("n_radii"), "third_of_z")


@query("SELECT n_nationkey AS id, 'data:text/plain;base64,' || base64(encode(n_name)) AS uri FROM nation")
def data_uris(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), outputs.data_uri(F.encode("n_name", "UTF-8"), "text/plain").alias("uri"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M UTC') AS built_utc FROM events")
def build_stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", outputs.build_stamp(F.col("ts")).alias("built_utc"))


@query(f"WITH {_ACQS} SELECT acq, 4.2e0 AS px_um, z_um, {_r('CASE WHEN z_um IS NOT NULL THEN z_um/4.2e0 ELSE 1e0 END', 'anisotropy', 6)}, {_r('0.55e0/(na*na) + 4.2e0/na', 'dof_um', 6)}, 'user' AS px_source FROM acq")
def calibration_override(spark, sf):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    a = table(spark, sf, "supplier").select(k.alias("acq"), F.when(n % 4 != 0, 3.0 + (k % 13) / 10).alias("px_um"), F.when(n % 3 != 0, 5.0 + k % 7).alias("z_um"), F.when(k % 5 != 0, 0.1 + (k % 4) / 10).alias("na"))
    return rounded(scalars.with_scales(scalars.with_calibration(a, px_um=4.2)).select("acq", "px_um", "z_um", "anisotropy", "dof_um", "px_source"), 6)


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'slices' ELSE 'edf' END AS source, count(*) AS n FROM customer WHERE c_nationkey IN (2, 3, 5, 7, 11, 13) GROUP BY 1")
def subset_counts(spark, sf):
    """Objects of some fields, counted by detector."""
    o = table(spark, sf, "customer").select(F.col("c_nationkey").alias("tile"), F.when(F.col("c_custkey") % 3 == 0, "slices").otherwise("edf").alias("source"))
    return cat.source_counts(cat.subset(o, tiles=[2, 3, 5, 7, 11, 13]))


_CAPS = "cap AS (SELECT s_suppkey AS dome, (s_suppkey*7) % 1000 + 0e0 AS cx, (s_suppkey*13) % 800 + 0e0 AS cy, 150e0 AS cz, 1000e0 + s_suppkey % 500 AS radius, 125e0 + s_suppkey % 20 AS glass FROM supplier), cc AS (SELECT *, sqrt(radius*radius - power((cz - glass)*2.65e0, 2)) AS contact FROM cap)"


@query(f"""WITH {_CAPS} SELECT dome, ring, k, {_r(f'cx + contact/8*ring*cos(k*{2 * math.pi / 24!r}e0)', 'x', 3)}, {_r(f'cy + contact/8*ring*sin(k*{2 * math.pi / 24!r}e0)', 'y', 3)}, {_r('cz - sqrt(greatest(radius*radius - power(contact/8*ring, 2), 0e0))/2.65e0', 'z', 3)}
 FROM cc, (SELECT CAST(unnest(range(0, 9)) AS INT) AS ring), (SELECT CAST(unnest(range(0, 24)) AS INT) AS k)""")  # fmt: skip
def dome_mesh(spark, sf):
    k = F.col("s_suppkey")
    caps = table(spark, sf, "supplier").select(k.alias("dome"), ((k * 7) % 1000).cast("double").alias("cx"), ((k * 13) % 800).cast("double").alias("cy"), F.lit(150.0).alias("cz"), (1000.0 + k % 500).alias("radius"), (125.0 + k % 20).alias("glass"))
    down = (F.col("cz") - F.col("glass")) * 2.65
    caps = caps.withColumn("contact", F.sqrt(F.col("radius") * F.col("radius") - down * down)).withColumn("anisotropy", F.lit(2.65)).drop("glass")
    return rounded(mesh.cap_vertices(caps), 3)
