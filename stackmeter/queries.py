"""Queries over the relational stand-ins: one for each operator or small family, with DuckDB oracles.

Floats are rounded on both sides; ``PI`` and the dome's numbers are written out, so that
both engines compute the same expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import catalogue as cat
from .functions import scalars
from .operators import curves, frames, matching, mesh, registration, reports
from .params import Acquisition, Dome, Params
from .plans.views import duck_ctes, table, view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
ACQ, DOME, PAR = Acquisition(), Dome(), Params()
#: A glass plane inside the 50 slices of the pixel view.
DEPTH = 50


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _ORACLES[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _with(views: tuple[str, ...], body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([duck_ctes(*views), *more]) + "\n" + body


def rounded(df: DataFrame, digits: int = 4, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to ``digits`` places, a negative zero made positive."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def _r(expression: str, name: str, digits: int = 4) -> str:
    return f"round({expression}, {digits}) + 0e0 AS {name}"


# Tiles and points.


@query(_with(("v_pairs",), "SELECT ta, tb, axis FROM v_pairs"))
def tile_grid_pairs(spark, sf):
    return matching.neighbour_pairs(view(spark, sf, "v_tiles"))


@query(_with(("v_pairs",), """SELECT axis, max(size) - median(step) AS overlap_px FROM (SELECT p.axis, CASE WHEN p.axis='x' THEN b.x0-a.x0 ELSE b.y0-a.y0 END AS step,
  CASE WHEN p.axis='x' THEN a.w ELSE a.h END AS size FROM v_pairs p JOIN v_tiles a ON p.ta=a.tile JOIN v_tiles b ON p.tb=b.tile) GROUP BY axis"""))  # fmt: skip
def tile_overlap(spark, sf):
    return matching.overlap(view(spark, sf, "v_tiles"))


@query(_with(("v_objects", "v_tiles"), f"""SELECT o.obj, t.tile, {_r('least(o.gx-t.x0, t.x0+t.w-o.gx, o.gy-t.y0, t.y0+t.h-o.gy)', 'edge_distance')}
  FROM v_objects o JOIN v_tiles t ON o.gx BETWEEN t.x0 AND t.x0+t.w AND o.gy BETWEEN t.y0 AND t.y0+t.h"""))  # fmt: skip
def point_in_tile(spark, sf):
    met = matching.covering(view(spark, sf, "v_objects"), view(spark, sf, "v_tiles"), "gx", "gy")
    return rounded(met.select("obj", "tile", scalars.edge_distance(F.col("gx"), F.col("gy")).alias("edge_distance")))


@query(_with(("v_objects", "v_tiles"), """SELECT coverage_k, count(*) AS n FROM (SELECT o.obj, count(t.tile) AS coverage_k FROM v_objects o
  LEFT JOIN v_tiles t ON o.gx BETWEEN t.x0 AND t.x0+t.w AND o.gy BETWEEN t.y0 AND t.y0+t.h GROUP BY o.obj) GROUP BY 1"""))  # fmt: skip
def coverage_histogram(spark, sf):
    objects = view(spark, sf, "v_objects")
    seen = matching.coverage(objects, view(spark, sf, "v_tiles"), "obj", "gx", "gy")
    return objects.select("obj").join(seen, "obj", "left").select(F.coalesce("coverage_k", F.lit(0)).cast("long").alias("coverage_k")).groupBy("coverage_k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_name AS name, CASE WHEN d = '' THEN 0 ELSE CAST(d AS INT) END AS tile_index FROM (SELECT n_name, regexp_replace(list_extract(string_split('scan_' || n_name || '_' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0'), '_'), -1), '[^0-9]', '', 'g') AS d FROM nation)")
def tile_index(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_name").alias("name"), scalars.tile_index(F.concat(F.lit("scan_"), F.col("n_name"), F.lit("_"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0"))).alias("tile_index"))


@query(_with(("v_tiles",), "SELECT tile, x0 - min(x0) OVER () AS x0, y0 - min(y0) OVER () AS y0 FROM v_tiles"))
def offsets_rebased(spark, sf):
    return registration.rebased(view(spark, sf, "v_tiles"))


@query(_with(("v_tiles",), f"SELECT tile, {_r('tc*w*0.7e0', 'x0')}, {_r('tr*h*0.7e0', 'y0')} FROM v_tiles"))
def nominal_layout(spark, sf):
    return rounded(registration.nominal_offsets(view(spark, sf, "v_tiles")))


@query(_with(("v_tiles",), f"""SELECT tile, {_r('abs(sx - CASE WHEN kx < 0 THEN hx ELSE lx END)/3774.4e0', 'x0')}, {_r('abs(sy - CASE WHEN ky < 0 THEN hy ELSE ly END)/3774.4e0', 'y0')}
  FROM s, (SELECT regr_slope(sx,tc) AS kx, min(sx) AS lx, max(sx) AS hx, regr_slope(sy,tr) AS ky, min(sy) AS ly, max(sy) AS hy FROM s)""",
  "s AS (SELECT tile, tr, tc, 9000000e0 - x0*3774.4e0 AS sx, 1000000e0 + y0*3774.4e0 AS sy FROM v_tiles)"))
def stage_layout(spark, sf):
    t = view(spark, sf, "v_tiles").select("tile", "tr", "tc", (9000000.0 - F.col("x0") * 3774.4).alias("stage_x"), (1000000.0 + F.col("y0") * 3774.4).alias("stage_y"))
    return rounded(registration.stage_offsets(t, 3774.4))


# Scales and objects.

_ACQ = "(VALUES ('full', 3.7744e0, 10e0, 0.2e0), ('no_z', 3.7744e0, NULL, 0.2e0), ('no_na', 3.7744e0, 10e0, NULL), ('none', NULL, NULL, NULL))"


def acquisitions(spark: SparkSession) -> DataFrame:
    rows = [("full", 3.7744, 10.0, 0.2), ("no_z", 3.7744, None, 0.2), ("no_na", 3.7744, 10.0, None), ("none", None, None, None)]
    return spark.createDataFrame(rows, "acq string, px_um double, z_um double, na double")


_SCALED = f"""a AS (SELECT *, px_um IS NOT NULL AND z_um IS NOT NULL AS calibrated, CASE WHEN px_um IS NOT NULL AND z_um IS NOT NULL THEN z_um/px_um ELSE 1e0 END AS anisotropy,
  0.55e0/(na*na) + px_um/na AS dof_um FROM {_ACQ} t(acq, px_um, z_um, na))"""


@query(_with(("v_objects",), f"""SELECT acq, obj, {_r('2*r','diameter_px')}, {_r('r/anisotropy','rz_slices')}, {_r('4.1887902047863905e0*r*r*(r/anisotropy)','volume_px3',3)},
  CAST(round_even(gz, 0) AS INT) AS best_slice, {_r('2*r*px','diameter_um')}, {_r('gz*zz','z_position_um')}, {_r('4.1887902047863905e0*r*r*(r/anisotropy)*px*px*zz','volume_um3',1)}
  FROM v_objects, (SELECT *, CASE WHEN calibrated THEN px_um END AS px, CASE WHEN calibrated THEN z_um END AS zz FROM a)""", _SCALED))  # fmt: skip
def calibrated_columns(spark, sf):
    a = F.broadcast(scalars.with_scales(acquisitions(spark)))  # four rows
    o = scalars.assembled(view(spark, sf, "v_objects").withColumn("z", F.col("gz")).join(a))
    out = o.select("acq", "obj", "diameter_px", "rz_slices", "volume_px3", "best_slice", "diameter_um", "z_position_um", "volume_um3")
    return rounded(rounded(rounded(out, 4, ("volume_px3", "volume_um3")), 3, tuple(c for c in out.columns if c != "volume_px3")), 1, tuple(c for c in out.columns if c != "volume_um3"))


_CX, _CY, _CZ, _RAD, _GLASS, _AN = "1824e0", "1368e0", "150e0", "1900e0", "125e0", "2.65e0"
_CONTACT = f"{DOME.contact_radius!r}e0"
_SPATIAL = f"""sp AS (SELECT obj, gx, gy, gz, r, sqrt((gx-{_CX})*(gx-{_CX}) + (gy-{_CY})*(gy-{_CY})) AS radial,
  {_RAD} - sqrt((gx-{_CX})*(gx-{_CX}) + (gy-{_CY})*(gy-{_CY}) + ((gz-{_CZ})*{_AN})*((gz-{_CZ})*{_AN})) - r AS clear, abs(({_GLASS}-gz)*{_AN}) AS depth FROM v_objects),
  sq AS (SELECT *, CASE WHEN {_CONTACT}-radial < 0 THEN depth - r ELSE {_CONTACT}-radial-r END AS edge FROM sp)"""


def _objects_xyz(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_objects").select("obj", F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z"), "r")


@query(_with(("v_objects",), f"""SELECT obj, {_r('radial','dome_radial_px',3)}, CASE WHEN round(az,3) = 360 THEN 0e0 ELSE round(az,3) END AS dome_azimuth_deg, {_r(f'radial/{_CONTACT}','dome_radial_frac')},
  {_r(f'{_GLASS}-gz','height_above_glass_slices')}, {_r('clear','dome_distance_px',3)}, {_r('edge','contact_edge_distance_px',3)},
  CASE WHEN round(clear,6) <= round(edge,6) THEN 1e0 ELSE 0e0 END AS nearest_border_is_cap, {_r('least(clear,edge)','nearest_border_px',3)}
  FROM (SELECT *, (degrees(atan2(gy-{_CY}, gx-{_CX})) + 360e0) % 360e0 AS az FROM sq)""", _SPATIAL))  # fmt: skip
def spatial_features(spark, sf):
    out = scalars.with_spatial_features(_objects_xyz(spark, sf), DOME).drop("x", "y", "z", "r")
    out = rounded(rounded(out, 4, tuple(c for c in out.columns if c not in ("dome_radial_frac", "height_above_glass_slices"))), 3, ("dome_radial_frac", "height_above_glass_slices"))
    return out.withColumn("dome_azimuth_deg", F.when(F.col("dome_azimuth_deg") == 360, 0.0).otherwise(F.col("dome_azimuth_deg")))


@query(_with(("v_objects",), f"""SELECT obj, {_r(f'{_CZ} - sqrt(CASE WHEN q > 0 THEN q END)/{_AN}','surface_slice')} FROM
  (SELECT obj, {_RAD}*{_RAD} - ((gx-{_CX})*(gx-{_CX}) + (gy-{_CY})*(gy-{_CY})) AS q FROM v_objects)"""))  # fmt: skip
def dome_surface(spark, sf):
    return rounded(_objects_xyz(spark, sf).select("obj", scalars.dome_surface(DOME, F.col("x"), F.col("y")).alias("surface_slice")))


@query(_with(("v_objects",), f"SELECT avg(CASE WHEN clear > -0.25e0*r THEN 1e0 ELSE 0e0 END) AS enclosed, avg(CASE WHEN clear > -0.25e0*r THEN 1e0 ELSE 0e0 END) >= 0.9e0 AS reliable FROM sp", _SPATIAL.split(",\n  sq AS")[0]))
def dome_reliability(spark, sf):
    return cat.enclosed(_objects_xyz(spark, sf), DOME)


@query(_with(("v_rings",), f"SELECT z, {_r('0.5235987755982988e0*(z+1)*(3*radius*radius + (z+1)*(z+1))','volume',1)} FROM v_rings"))
def cap_volumes(spark, sf):
    return rounded(view(spark, sf, "v_rings").select("z", scalars.cap_volume(F.col("radius"), F.col("z") + 1).alias("volume")), 1)


@query(_with(("v_objects",), f"SELECT obj, {_r('greatest(3e0,0.2e0*r)','rim_px')}, {_r('greatest(2e0,0.05e0*r)','guard_px')}, {_r('0.5e0*r','halo_inner_px')}, {_r('1.2e0*r','halo_outer_px')} FROM v_objects"))
def region_widths(spark, sf):
    return rounded(scalars.with_region_widths(view(spark, sf, "v_objects")).select("obj", "rim_px", "guard_px", "halo_inner_px", "halo_outer_px"))


@query(_with(("v_objects",), f"""SELECT obj, zz AS z, {_r('sqrt(1-((zz-gz)/rz)*((zz-gz)/rz))','scale')} FROM (SELECT obj, gz, r/2.65e0 AS rz, unnest(range(CAST(floor(gz-r/2.65e0) AS INT), CAST(ceil(gz+r/2.65e0) AS INT)+1)) AS zz FROM v_objects) WHERE abs(zz-gz) < rz"""))
def cross_sections(spark, sf):
    o = _objects_xyz(spark, sf).withColumn("rz", F.col("r") / 2.65).withColumn("slice", F.explode(F.sequence(F.floor(F.col("z") - F.col("rz")), F.ceil(F.col("z") + F.col("rz")))))
    return rounded(o.select("obj", F.col("slice").alias("z"), scalars.cross_section_scale(F.col("slice") - F.col("z"), F.col("rz")).alias("scale")).where("scale is not null"))


@query(_with(("v_objects",), "SELECT z, sum(n) OVER (ORDER BY z)::BIGINT AS shown FROM (SELECT CAST(round_even(gz,0) AS INT) AS z, count(*) AS n FROM v_objects GROUP BY 1)"))
def progressive_reveal(spark, sf):
    per = _objects_xyz(spark, sf).groupBy(scalars.half_even(F.col("z")).cast("int").alias("z")).agg(F.count(F.lit(1)).alias("n"))  # one row a slice
    return per.select("z", F.sum("n").over(Window.orderBy("z")).alias("shown"))


# Filters.


@query(_with(("v_sightings",), "SELECT tile, obj FROM v_sightings WHERE sharp >= 0.25e0 AND edge >= r + 2e0"))
def focus_gate(spark, sf):
    s = matching.with_clipped(view(spark, sf, "v_sightings"))
    return s.where((F.col("sharp") >= PAR.min_sharpness) & ~F.col("clipped")).select("tile", "obj")


# Matching and the catalogue.

_SEAM = """c AS (SELECT s.tile*10000000000 + s.obj AS sid, s.*, s.edge < s.r + 2e0 AS clipped FROM v_sightings s),
 cand AS (SELECT p.ta, p.tb, 'a' AS side, c.* FROM c JOIN v_pairs p ON c.tile=p.ta JOIN v_tiles t ON t.tile=p.tb WHERE c.x BETWEEN t.x0 AND t.x0+t.w AND c.y BETWEEN t.y0 AND t.y0+t.h
  UNION ALL SELECT p.ta, p.tb, 'b' AS side, c.* FROM c JOIN v_pairs p ON c.tile=p.tb JOIN v_tiles t ON t.tile=p.ta WHERE c.x BETWEEN t.x0 AND t.x0+t.w AND c.y BETWEEN t.y0 AND t.y0+t.h),
 gate AS (SELECT l.ta, l.tb, l.sid AS sa, r.sid AS sb, sqrt((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)) AS lateral_px, abs(l.z-r.z) AS axial_slices,
   sqrt((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y))/(4e0+0.15e0*greatest(l.r,r.r)) + 0.5e0*ln(greatest(l.r,r.r)/least(l.r,r.r)) AS cost
   FROM cand l JOIN cand r ON l.ta=r.ta AND l.tb=r.tb AND l.side='a' AND r.side='b'
   WHERE sqrt((l.x-r.x)*(l.x-r.x)+(l.y-r.y)*(l.y-r.y)) <= 4e0+0.15e0*greatest(l.r,r.r) AND abs(l.z-r.z) <= 3.2622e0 AND (l.clipped OR r.clipped OR greatest(l.r,r.r)/least(l.r,r.r) <= 2e0))"""
_SV = ("v_sightings", "v_pairs")


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    return matching.with_clipped(cat.with_sid(view(spark, sf, "v_sightings")), PAR)


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return cat.matched(_sightings(spark, sf), view(spark, sf, "v_tiles"), PAR, ACQ)


@query(_with(_SV, "SELECT ta, tb, side, sid FROM cand", _SEAM))
def seam_candidates(spark, sf):
    t = view(spark, sf, "v_tiles")
    return matching.seam_candidates(_sightings(spark, sf), t, matching.neighbour_pairs(t)).select("ta", "tb", "side", "sid")


@query(_with(_SV, f"SELECT ta, tb, sa, sb, {_r('lateral_px','lateral_px')}, {_r('axial_slices','axial_slices')}, {_r('cost','cost')} FROM gate", _SEAM))
def gated_matches(spark, sf):
    t = view(spark, sf, "v_tiles")
    s = _sightings(spark, sf)
    c = matching.seam_candidates(s, t, matching.neighbour_pairs(t))
    return rounded(matching.gated_pairs(c, cat.reach(s, PAR), PAR, ACQ))


@query(_with(_SV, f"SELECT ta, tb, sa, sb, {_r('cost','cost')} FROM gate", _SEAM))
def assigned_matches(spark, sf):
    return rounded(_matched(spark, sf).select("ta", "tb", "sa", "sb", "cost"))


_SEAMS = """seams AS (SELECT p.ta, p.tb, coalesce(m.pairs,0) AS shared, CASE WHEN coalesce(n.n,0)=0 THEN 1e0 ELSE 2e0*coalesce(m.pairs,0)/n.n END AS match_rate, coalesce(m.residual,0e0) AS residual
  FROM v_pairs p LEFT JOIN (SELECT ta,tb,count(*) AS n FROM cand GROUP BY ALL) n USING (ta,tb) LEFT JOIN (SELECT ta,tb,count(*) AS pairs, median(lateral_px) AS residual FROM gate GROUP BY ALL) m USING (ta,tb))"""


@query(_with(_SV, f"SELECT ta, tb, CAST(shared AS BIGINT) AS shared, {_r('match_rate','match_rate')}, {_r('residual','residual')}, shared >= 6 AS informative, match_rate < 0.5e0 AS asymmetric FROM seams", _SEAM, _SEAMS))
def seam_report(spark, sf):
    return rounded(cat.seam_report(_sightings(spark, sf), view(spark, sf, "v_tiles"), _matched(spark, sf), PAR))


@query(_with(_SV, f"SELECT count(*) AS n_seams, {_r('coalesce(max(residual) FILTER (shared >= 6),0e0)','worst_residual')}, coalesce(max(residual) FILTER (shared >= 6) <= 4e0, true) AS reliable, {_r('min(match_rate)','weakest_rate')} FROM seams", _SEAM, _SEAMS))
def merge_reliability(spark, sf):
    return rounded(cat.merge_summary(cat.seam_report(_sightings(spark, sf), view(spark, sf, "v_tiles"), _matched(spark, sf), PAR), PAR))


@query(_with(_SV, f"""SELECT {_r('median(lateral_px)','lateral_px_median')}, {_r('quantile_cont(lateral_px,0.9)','lateral_px_p90')}, {_r('max(lateral_px)','lateral_px_max')}, {_r('median(axial_slices)','axial_slices_median')}, {_r('quantile_cont(axial_slices,0.9)','axial_slices_p90')}, {_r('max(axial_slices)','axial_slices_max')} FROM gate""", _SEAM))
def match_agreement(spark, sf):
    return rounded(cat.agreement(_matched(spark, sf)))


_COMP = """e AS (SELECT sa AS a, sb AS b FROM gate UNION SELECT sb, sa FROM gate), reach(sid, other) AS (SELECT sid, sid FROM c UNION SELECT r.sid, e.b FROM reach r JOIN e ON r.other = e.a),
 comps AS (SELECT sid, min(other) AS comp FROM reach GROUP BY sid), g AS (SELECT c.*, k.comp FROM c JOIN comps k USING (sid)),
 el AS (SELECT *, row_number() OVER (PARTITION BY comp ORDER BY clipped, edge DESC, sharp DESC, tile, obj) AS rn FROM g)"""


@query(_with(_SV, "SELECT sid, comp FROM comps", _SEAM, _COMP))
def components(spark, sf):
    s = _sightings(spark, sf)
    return matching.components(_matched(spark, sf), s.select("sid"))


_CAT = """m AS (SELECT comp, count(*) AS n_views, count(DISTINCT tile) AS n_tiles, avg(x) AS mx, avg(y) AS my, max(z)-min(z) AS axial, max(r)/min(r) AS ratio, max(r) AS rmax, bool_and(clipped) AS allc, string_agg(CAST(tile AS VARCHAR), ';' ORDER BY tile) AS views FROM g GROUP BY comp),
 sp2 AS (SELECT g.comp, max(sqrt((g.x-m.mx)*(g.x-m.mx)+(g.y-m.my)*(g.y-m.my))) AS lateral_s FROM g JOIN m USING (comp) GROUP BY g.comp),
 cov AS (SELECT m.comp, count(t.tile) AS k FROM m LEFT JOIN v_tiles t ON m.mx BETWEEN t.x0 AND t.x0+t.w AND m.my BETWEEN t.y0 AND t.y0+t.h GROUP BY m.comp),
 half AS (SELECT min(o)/2 AS half FROM (SELECT max(size) - median(step) AS o FROM (SELECT p.axis, CASE WHEN p.axis='x' THEN b.x0-a.x0 ELSE b.y0-a.y0 END AS step, CASE WHEN p.axis='x' THEN a.w ELSE a.h END AS size FROM v_pairs p JOIN v_tiles a ON p.ta=a.tile JOIN v_tiles b ON p.tb=b.tile) GROUP BY axis)),
 objs AS (SELECT row_number() OVER (ORDER BY el.y, el.x, el.tile, el.obj) - 1 AS uid, el.*, m.n_views, m.n_tiles, m.views, cov.k AS coverage_k, sp2.lateral_s, m.axial, m.ratio, m.allc, m.rmax, half.half FROM el JOIN m USING (comp) JOIN sp2 USING (comp) JOIN cov USING (comp), half WHERE el.rn = 1)"""


@query(_with(_SV, f"""SELECT uid, tile, obj, {_r('x','x')}, {_r('y','y')}, {_r('z','z')}, {_r('r','r')}, {_r('sharp','sharp')}, clipped, n_views, views, CAST(coverage_k AS BIGINT) AS coverage_k, {_r('lateral_s','lateral_spread_px')}, {_r('axial','axial_spread_slices')}, {_r('ratio','radius_ratio')},
  allc AS clipped_everywhere, (n_views = 1 AND coverage_k > 1) AS single_view_in_overlap, ratio > 1.25e0 AS radius_disagreement, n_tiles < n_views AS same_tile_twice, rmax > half AS guarantee_void FROM objs""", _SEAM, _COMP, _CAT))  # fmt: skip
def catalogue(spark, sf):
    return rounded(_catalogue(spark, sf))


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return cat.catalogue(cat.with_components(_sightings(spark, sf), _matched(spark, sf)), view(spark, sf, "v_tiles"), PAR)


@query(_with(_SV, f"SELECT tile, obj, comp, {_r('x','x',2)}, {_r('y','y',2)}, CASE WHEN rn = 1 THEN 1 ELSE 0 END AS elected FROM el", _SEAM, _COMP))
def views_long(spark, sf):
    long = cat.views_long(cat.with_components(_sightings(spark, sf), _matched(spark, sf)))
    return rounded(long.select("tile", "obj", "comp", "x", "y", "elected"), 2)


@query(_with(_SV, f"SELECT once, twice, {_r('CASE WHEN twice >= 10 THEN 2e0/(once::DOUBLE/twice + 2) END','implied_recall')} FROM (SELECT count(*) FILTER (n_views=1) AS once, count(*) FILTER (n_views>=2) AS twice FROM objs WHERE coverage_k >= 2)", _SEAM, _COMP, _CAT))
def recall_bound(spark, sf):
    return rounded(cat.recall(_catalogue(spark, sf)))


@query(_with(_SV, f"""SELECT count(*) AS n, {_r('median(2*r)','diameter_median')}, {_r('quantile_cont(2*r,0.25)','diameter_q1')}, {_r('quantile_cont(2*r,0.75)','diameter_q3')}, {_r('max(2*r)','diameter_max')}, {_r('min(z)','z_min')}, {_r('max(z)','z_max')}, {_r('sum(4.1887902047863905e0*r*r*r)','volume_px3',1)} FROM objs""", _SEAM, _COMP, _CAT))
def run_summary(spark, sf):
    out = cat.run_summary(_catalogue(spark, sf))
    return rounded(rounded(out, 4, ("volume_px3",)), 1, tuple(c for c in out.columns if c != "volume_px3"))


_KNN = """d AS (SELECT a.obj, b.obj AS o2, a.r, b.r AS r2, sqrt((a.gx-b.gx)*(a.gx-b.gx)+(a.gy-b.gy)*(a.gy-b.gy)+(a.gz*2.65e0-b.gz*2.65e0)*(a.gz*2.65e0-b.gz*2.65e0)) AS d FROM v_objects a JOIN v_objects b ON a.obj<>b.obj),
 k AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY d, o2) AS n FROM d)"""


@query(_with(("v_objects",), f"SELECT obj, {_r('min(d)','nn_distance_px')}, {_r('max(d-r-r2) FILTER (n=1)','nn_gap_px')}, CAST(count(*) FILTER (d < 5*greatest(r,1e-6)) AS DOUBLE) AS n_within_5r, {_r('avg(d) FILTER (n<=5)','mean_distance_knn_px')} FROM k GROUP BY obj", _KNN))
def knn_neighbourhood(spark, sf):
    return rounded(matching.knn(_objects_xyz(spark, sf), 5))


@query(_with(("v_objects",), "SELECT a.obj AS sid, count(*) AS n_halo FROM v_objects a JOIN v_objects b ON a.obj<>b.obj AND (a.gx-b.gx)*(a.gx-b.gx)+(a.gy-b.gy)*(a.gy-b.gy) > 0 AND sqrt((a.gx-b.gx)*(a.gx-b.gx)+(a.gy-b.gy)*(a.gy-b.gy)) < 3*a.r+40 GROUP BY 1"))
def halo_neighbours(spark, sf):
    return matching.halo_neighbours(_objects_xyz(spark, sf).withColumnRenamed("obj", "sid"), cell=101.0)


def _crowded(spark: SparkSession, sf: str) -> DataFrame:
    """Sightings drawn together, so that suppression has work to do."""
    s = cat.with_sid(view(spark, sf, "v_sightings"))
    return s.select("sid", "tile", (F.col("x") / 20.0).alias("x"), (F.col("y") / 20.0).alias("y"), (F.col("z") / 4.0).alias("z"), "r", "sharp")


# Tile by tile in order of sharpness: a sighting stays if none that has stayed stands before it within reach.
_GREEDY = """cr AS (SELECT tile*10000000000 + obj AS sid, tile, x/20e0 AS x, y/20e0 AS y, z/4e0 AS z, r, sharp FROM v_sightings), ra AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY sharp DESC, sid) AS n FROM cr),
 cf AS (SELECT b.sid, list(a.sid) AS others FROM ra a JOIN ra b ON a.tile = b.tile AND a.n < b.n AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) < 0.5e0*greatest(a.r, b.r) AND abs(a.z-b.z)*2.65e0 < greatest(8.639e0, 0.6e0*greatest(a.r, b.r)) GROUP BY b.sid),
 rc AS (SELECT ra.tile, n, ra.sid, coalesce(others, CAST([] AS BIGINT[])) AS others FROM ra LEFT JOIN cf USING (sid)),
 it AS (SELECT DISTINCT tile, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM ra UNION ALL SELECT it.tile, rc.n, CASE WHEN list_has_any(kept, others) THEN kept ELSE list_append(kept, rc.sid) END FROM it JOIN rc ON rc.tile = it.tile AND rc.n = it.n + 1)"""


@query(_with(("v_sightings",), "SELECT unnest(kept) AS sid, tile FROM it QUALIFY row_number() OVER (PARTITION BY tile ORDER BY n DESC) = 1", _GREEDY))
def nms_dedup(spark, sf):
    s = _crowded(spark, sf)
    return matching.suppressed(s, 2.65, 3.26).select("sid", "tile")


@query()
def z_links(spark, sf):
    s = cat.with_sid(view(spark, sf, "v_sightings"))
    d = s.select("tile", "sid", F.floor(F.col("z") / 10).cast("int").alias("z"), (F.col("x") % 60).alias("x"), (F.col("y") % 60).alias("y"), "r")
    links = matching.linked_tracks(d, PAR)
    return rounded(matching.track_summary(links, d, 12, PAR))


@query(_with(("v_curves",), """SELECT tid, zq AS z, arg_min(z, row(abs(z-zq), z)) AS z_near, round(arg_min(v, row(abs(z-zq), z)), 4) + 0e0 AS r_near FROM (SELECT c.oid AS tid, c.z, c.v, q.zq FROM v_curves c, (SELECT unnest([3.4e0, 14.5e0, 27e0]) AS zq) q) GROUP BY tid, zq"""))
def nearest_detection(spark, sf):
    c = view(spark, sf, "v_curves").select(F.col("oid").alias("tid"), "z", F.col("v").alias("r"))
    wanted = c.select("tid").distinct().select("tid", F.explode(F.array(F.lit(3.4), F.lit(14.5), F.lit(27.0))).alias("z"))
    return rounded(matching.nearest_detection(wanted, c), 4, ("z",))


@query("""WITH d AS (SELECT o_custkey AS tid, o_orderkey AS z FROM orders) SELECT tid, min(z) AS z_first, max(z) AS z_last, count(*) AS n FROM d GROUP BY tid HAVING count(*) >= 2 AND min(z) < 10000 - 3""")
def track_filters(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("tid"), F.col("o_orderkey").alias("z"))
    t = d.groupBy("tid").agg(F.min("z").alias("z_first"), F.max("z").alias("z_last"), F.count(F.lit(1)).alias("n"))
    return t.where((F.col("n") >= PAR.min_track) & (F.col("z_first") < 10000 - PAR.substrate_margin))


# Pixels.

_REFL = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
_NB = ("off AS (SELECT a.dy, b.dx FROM (SELECT unnest([-1,0,1]) AS dy) a, (SELECT unnest([-1,0,1]) AS dx) b), tgt AS (SELECT p.stack, p.z, p.y, p.x, p.v, o.dy, o.dx, "
       + _REFL.format("(p.y+o.dy)") + " AS qy, " + _REFL.format("(p.x+o.dx)") + " AS qx FROM v_pixels p, off o), nb AS (SELECT t.stack, t.z, t.y, t.x, t.v, t.dy, t.dx, q.v AS w FROM tgt t JOIN v_pixels q ON q.stack=t.stack AND q.z=t.z AND q.y=t.qy AND q.x=t.qx)")
_SHARP = _NB + """, sh AS (SELECT stack, z, y, x, any_value(v) AS v, power(sum(w*dx*(2-abs(dy))),2) + power(sum(w*dy*(2-abs(dx))),2) AS s,
  abs(sum(CASE WHEN dy<>0 AND dx<>0 THEN 2*w WHEN dy=0 AND dx=0 THEN -8*w ELSE 0e0 END)) AS lap FROM nb GROUP BY stack, z, y, x)"""


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames.frames_of(view(spark, sf, "v_pixels"))


@query(_with(("v_pixels",), f"SELECT stack, z, {_r('avg(s)','tenengrad',3)}, {_r('avg(lap)','laplacian',3)} FROM sh GROUP BY 1, 2", _SHARP))
def focus_profile(spark, sf):
    return rounded(frames.focus_measures(_frames(spark, sf)), 3)


@query(_with(("v_pixels",), f"SELECT stack, z, y, x, {_r('s','value',2)} FROM sh", _SHARP))
def tenengrad_8x8(spark, sf):
    from .kernels import image

    return rounded(frames.exploded(frames.mapped(_frames(spark, sf), image.tenengrad)), 2)


@query(_with(("v_pixels",), f"SELECT stack, z, y, x, {_r('lap','value',3)} FROM sh", _SHARP))
def abs_laplacian_8x8(spark, sf):
    from .kernels import image

    return rounded(frames.exploded(frames.mapped(_frames(spark, sf), image.abs_laplacian)), 3)


_EDF = "SELECT stack, y, x, {0}, arg_max(z, row(round(s,6), -z)) AS best_z FROM sh {1} GROUP BY stack, y, x"


def _edf(stacked: DataFrame) -> DataFrame:
    cells = stacked.select("stack", "width", F.posexplode(F.arrays_zip("edf", "best_z")).alias("at", "c"))
    return cells.select("stack", F.expr("at div width").cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), F.col("c.edf").alias("edf"), F.col("c.best_z").alias("best_z"))


@query(_with(("v_pixels",), _EDF.format(_r("arg_max(v, row(round(s,6), -z))", "edf"), ""), _SHARP))
def edf_argmax(spark, sf):
    return rounded(_edf(frames.focus_stacked(_frames(spark, sf))))


@query(_with(("v_pixels",), _EDF.format(_r("arg_max(v, row(round(s,6), -z))", "edf"), "WHERE z % 3 = 0"), _SHARP))
def tile_projection(spark, sf):
    return rounded(_edf(frames.focus_stacked(_frames(spark, sf), z_step=3)))


@query(_with(("v_pixels",), f"SELECT y, x, {_r('least(greatest(m/avg(m) OVER (), 0.2e0), 5e0)','gain',6)} FROM (SELECT y, x, median(v+100e0) AS m FROM v_pixels GROUP BY 1, 2)"))
def flat_field_median(spark, sf):
    return rounded(frames.flat_field(view(spark, sf, "v_pixels").withColumn("v", F.col("v") + 100.0)), 6)


_TP = """tp AS (SELECT z, (stack % 5)*6 + x AS cx, y AS cy, v+128e0 AS v, greatest(least(1e0,(x+0.5e0)/2e0,(8-x-0.5e0)/2e0)*least(1e0,(y+0.5e0)/2e0,(8-y-0.5e0)/2e0), 1e-3) AS weight FROM v_pixels)"""


def _tile_pixels(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "v_pixels")
    w = scalars.feather_weight(F.col("x"), F.col("y"), F.lit(8), F.lit(8), F.lit(2.0))
    return p.select("z", ((F.col("stack") % 5) * 6 + F.col("x")).alias("cx"), F.col("y").alias("cy"), (F.col("v") + 128.0).alias("v"), w.alias("weight"))


@query(_with(("v_pixels",), "SELECT z, cx, cy, CAST(floor(least(greatest(round(sum(weight*v)/sum(weight),6),0e0),255e0)) AS INT) AS v, count(*) AS n FROM tp GROUP BY 1, 2, 3", _TP))
def feather_composite(spark, sf):
    return frames.composite(_tile_pixels(spark, sf), ["z"])


@query(_with(("v_pixels",), f"SELECT z, cx, cy, {_r('max(v)','v')} FROM tp GROUP BY 1, 2, 3", _TP))
def max_composite(spark, sf):
    return rounded(frames.max_composite(_tile_pixels(spark, sf), ["z"]))


_PROFILE = "pr AS (SELECT stack, z, avg(v*v) AS v FROM v_pixels GROUP BY 1, 2)"


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_pixels").groupBy("stack", "z").agg(F.avg(F.col("v") * F.col("v")).alias("v"))


@query(_with(("v_pixels",), f"SELECT stack, arg_max(z, row(v, -z)) AS plane, {_r('max(v)','peak')} FROM pr JOIN (SELECT stack, max(z)+1 AS depth FROM pr GROUP BY 1) USING (stack) WHERE z >= floor(depth*0.5e0) GROUP BY stack", _PROFILE))
def substrate_plane(spark, sf):
    return rounded(registration.substrate_plane(_profile(spark, sf)))


_VOTE = """vo AS (SELECT stack, arg_max(z, row(v, -z)) AS plane, max(v)/any_value(mid) AS contrast FROM pr JOIN (SELECT stack, max(z)+1 AS depth, median(v) AS mid FROM pr GROUP BY 1) USING (stack) WHERE z >= floor(depth*0.6e0) GROUP BY stack)"""


@query(_with(("v_pixels",), f"SELECT stack, plane, {_r('contrast','contrast')}, contrast >= 1.5e0 AS voted FROM vo", _PROFILE, _VOTE))
def glass_votes(spark, sf):
    return rounded(registration.glass_votes(_profile(spark, sf), PAR))


@query(_with(("v_pixels",), "SELECT coalesce(median(plane) FILTER (contrast >= 1.5e0), 49e0) AS slice, count(*) FILTER (contrast >= 1.5e0) AS n_votes, count(*) FILTER (NOT contrast >= 1.5e0) AS n_rejected, max(plane) FILTER (contrast >= 1.5e0) - min(plane) FILTER (contrast >= 1.5e0) AS spread FROM vo", _PROFILE, _VOTE))
def glass_consensus(spark, sf):
    return registration.glass_consensus(registration.glass_votes(_profile(spark, sf), PAR), DEPTH)


@query("""WITH s AS (SELECT CAST(l_suppkey % 15 AS INT) AS tile, CAST(l_linenumber AS INT) AS z, avg(l_quantity) AS score FROM lineitem GROUP BY 1, 2), f AS (SELECT tile FROM s GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT z) FROM s))
  SELECT arg_max(z, row(m, -z)) AS plane FROM (SELECT z, round(avg(score),9) AS m FROM s WHERE tile IN (SELECT tile FROM f) GROUP BY 1)""")  # fmt: skip
def metadata_plane(spark, sf):
    s = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 15).cast("int").alias("tile"), F.col("l_linenumber").cast("int").alias("z")).agg(F.avg("l_quantity").alias("score"))
    return registration.metadata_plane(s)


_OD = """od AS (SELECT stack, z, y, x, -ln(least(greatest((v+120e0)/130e0, 0.00392156862745098e0), 4e0)) AS od, y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AS core FROM v_pixels)"""


def _od(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "v_pixels")
    od = scalars.optical_density(F.col("v") + 120.0, F.lit(130.0))
    return p.select("stack", "z", "y", "x", od.alias("od"), (F.col("y").between(2, 5) & F.col("x").between(2, 5)).alias("core"))


@query(_with(("v_pixels",), f"""SELECT stack, z, {_r('avg(od)','mean')}, {_r('stddev_pop(od)','std')}, {_r('quantile_cont(od,0.1)','p10')}, {_r('median(od)','median')}, {_r('quantile_cont(od,0.9)','p90')}, {_r('quantile_cont(od,0.75)-quantile_cont(od,0.25)','iqr')},
  {_r('any_value(m3)/power(any_value(m2),1.5e0)','skew',3)}, {_r('any_value(m4)/power(any_value(m2),2)-3','kurtosis',3)}, {_r('any_value(ent)','entropy')} FROM (SELECT stack, z, od FROM od) o
  JOIN (SELECT stack, z, avg(power(od-mu,2)) AS m2, avg(power(od-mu,3)) AS m3, avg(power(od-mu,4)) AS m4 FROM od JOIN (SELECT stack, z, avg(od) AS mu FROM od GROUP BY 1, 2) USING (stack, z) GROUP BY 1, 2) USING (stack, z)
  JOIN (SELECT stack, z, -sum(p*log2(p)) AS ent FROM (SELECT stack, z, bin, count(*)/sum(count(*)) OVER (PARTITION BY stack, z) AS p FROM (SELECT stack, z, least(floor((od+0.3e0)/2.3e0*32), 31) AS bin FROM od WHERE od BETWEEN -0.3e0 AND 2e0) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (stack, z) GROUP BY stack, z""", _OD))  # fmt: skip
def od_stats(spark, sf):
    out = curves.region_stats(_od(spark, sf))
    three = ("skew", "kurtosis")
    return rounded(rounded(out, 4, three), 3, tuple(c for c in out.columns if c not in three))


@query(_with(("v_pixels",), f"""SELECT stack, z, {_r('rm-cm','rim_minus_core_od')}, {_r('CASE WHEN abs(rm)>1e-6 THEN cm/rm END','core_over_rim_od',3)}, {_r('(rm-cm)/(sqrt(0.5e0*(cv+rv))+1e-9)','core_rim_separation')}, {_r('fill','core_fill_fraction')}, CASE WHEN body < 0.06e0 THEN 1e0 ELSE 0e0 END AS outline_empty FROM cr
  JOIN (SELECT stack, z, avg(CASE WHEN od > 0.5e0*rm THEN 1e0 ELSE 0e0 END) AS fill FROM od JOIN cr USING (stack, z) WHERE core GROUP BY 1, 2) USING (stack, z)""",
  _OD, "cr AS (SELECT stack, z, avg(od) FILTER (core) AS cm, avg(od) FILTER (NOT core) AS rm, var_pop(od) FILTER (core) AS cv, var_pop(od) FILTER (NOT core) AS rv, avg(od) AS body FROM od GROUP BY 1, 2)"))
def core_rim_contrast(spark, sf):
    out = curves.core_rim_contrast(_od(spark, sf))
    return rounded(rounded(out, 4, ("core_over_rim_od",)), 3, tuple(c for c in out.columns if c != "core_over_rim_od"))


_GL = """gl AS (SELECT stack, z, y, x, CAST(floor(round(least(greatest((od+0.3e0)/2.3e0,0e0),1e0)*15,9)) AS INT) AS g FROM od),
 gp AS (SELECT a.stack, a.z, d.ang, a.g AS i, b.g AS j FROM gl a JOIN (VALUES (0,0,1),(1,1,1),(2,1,0),(3,1,-1)) d(ang,dy,dx) ON true JOIN gl b ON a.stack=b.stack AND a.z=b.z AND b.y=a.y+d.dy AND b.x=a.x+d.dx WHERE a.g>0 AND b.g>0),
 gs AS (SELECT * FROM gp UNION ALL SELECT stack, z, ang, j, i FROM gp), gc AS (SELECT stack, z, ang, i, j, count(*)/sum(count(*)) OVER (PARTITION BY stack, z, ang) AS p FROM gs GROUP BY 1,2,3,4,5),
 ga AS (SELECT stack, z, ang, sum(p*(i-j)*(i-j)) AS c, sum(p*abs(i-j)) AS d, sum(p/(1+(i-j)*(i-j))) AS h, sqrt(sum(p*p)) AS e, sum(p*i) AS mi, sum(p*i*i) AS mii, sum(p*i*j) AS mij FROM gc GROUP BY 1,2,3)"""


@query(_with(("v_pixels",), f"SELECT stack, z, {_r('avg(c)','contrast',7)}, {_r('avg(d)','dissimilarity',7)}, {_r('avg(h)','homogeneity',7)}, {_r('avg(e)','energy',7)}, {_r('avg(CASE WHEN mii-mi*mi < 1e-12 THEN 1e0 ELSE (mij-mi*mi)/(mii-mi*mi) END)','correlation',7)} FROM ga GROUP BY 1, 2 HAVING count(*) = 4", _OD, _GL))
def glcm_core(spark, sf):
    share = F.least(F.greatest((F.col("od") + 0.3) / 2.3, F.lit(0.0)), F.lit(1.0))
    g = _od(spark, sf).withColumn("g", F.floor(F.round(share * 15, 9)).cast("int"))
    return rounded(curves.glcm(g, 1), 7)


@query(_with(("v_pixels",), f"SELECT stack, z, {_r('avg(m) FILTER (core)','core_grad_mean')}, {_r('quantile_cont(m,0.9) FILTER (core)','core_grad_p90')}, {_r('avg(m) FILTER (NOT core)','rim_grad_mean')}, {_r('avg(m) FILTER (NOT core)/greatest(avg(m) FILTER (core),1e-9)','rim_over_core_grad')} FROM (SELECT *, sqrt(gx*gx+gy*gy) AS m FROM gr) GROUP BY 1, 2",
  _OD, """gr AS (SELECT stack, z, core, CASE WHEN x=0 THEN lead(od) OVER r - od WHEN x=7 THEN od - lag(od) OVER r ELSE (lead(od) OVER r - lag(od) OVER r)/2 END AS gx, CASE WHEN y=0 THEN lead(od) OVER c - od WHEN y=7 THEN od - lag(od) OVER c ELSE (lead(od) OVER c - lag(od) OVER c)/2 END AS gy
  FROM od WINDOW r AS (PARTITION BY stack, z, y ORDER BY x), c AS (PARTITION BY stack, z, x ORDER BY y))"""))  # fmt: skip
def gradient_stats(spark, sf):
    return rounded(curves.gradient_stats(_od(spark, sf)))


def _glcm_at(distance: int) -> tuple[str, str]:
    """Offsets of the four angles at a distance, as SQL values, and the co-occurrence tables over them."""
    at = [(int(round(distance * math.sin(a * math.pi / 4))), int(round(distance * math.cos(a * math.pi / 4)))) for a in range(4)]
    values = ",".join(f"({n},{dy},{dx})" for n, (dy, dx) in enumerate(at))
    return _GL.replace("(0,0,1),(1,1,1),(2,1,0),(3,1,-1)", values), values


_GLCM_OUT = f"SELECT stack, z, {_r('avg(c)','contrast',7)}, {_r('avg(d)','dissimilarity',7)}, {_r('avg(h)','homogeneity',7)}, {_r('avg(e)','energy',7)}, {_r('avg(CASE WHEN mii-mi*mi < 1e-12 THEN 1e0 ELSE (mij-mi*mi)/(mii-mi*mi) END)','correlation',7)} FROM ga GROUP BY 1, 2 HAVING count(*) = 4"


def _grey(spark: SparkSession, sf: str) -> DataFrame:
    share = F.least(F.greatest((F.col("od") + 0.3) / 2.3, F.lit(0.0)), F.lit(1.0))
    return _od(spark, sf).withColumn("g", F.floor(F.round(share * 15, 9)).cast("int"))


@query(_with(("v_pixels",), _GLCM_OUT, _OD, _glcm_at(2)[0]))
def glcm_core_d2(spark, sf):
    return rounded(curves.glcm(_grey(spark, sf), 2), 7)


@query(_with(("v_pixels",), _GLCM_OUT, _OD, _glcm_at(4)[0]))
def glcm_core_d4(spark, sf):
    return rounded(curves.glcm(_grey(spark, sf), 4), 7)


def _patterns() -> str:
    """CTEs of uniform local binary patterns: eight points two pixels away, bilinear, nothing outside the frame."""
    at = [(round(-2 * math.sin(2 * math.pi * k / 8), 5), round(2 * math.cos(2 * math.pi * k / 8), 5)) for k in range(8)]
    points = " UNION ALL ".join(f"SELECT {k} AS k, CAST({math.floor(dy)} AS INT) AS oy, CAST({math.floor(dx)} AS INT) AS ox, {dy - math.floor(dy)!r}e0 AS fy, {dx - math.floor(dx)!r}e0 AS fx" for k, (dy, dx) in enumerate(at))
    corner = lambda j, i: f"coalesce(c{j}{i}.v, 0e0)"
    joins = " ".join(f"LEFT JOIN v_pixels c{j}{i} ON c{j}{i}.stack = p.stack AND c{j}{i}.z = p.z AND c{j}{i}.y = p.y + oy + {j} AND c{j}{i}.x = p.x + ox + {i}" for j in (0, 1) for i in (0, 1))
    value = f"(1-fy)*((1-fx)*{corner(0, 0)} + fx*{corner(0, 1)}) + fy*((1-fx)*{corner(1, 0)} + fx*{corner(1, 1)})"
    return f"""pk AS ({points}), bt AS (SELECT p.stack, p.z, p.y, p.x, k, CASE WHEN {value} >= p.v THEN 1 ELSE 0 END AS b FROM v_pixels p, pk {joins}),
 cd AS (SELECT stack, z, y, x, CASE WHEN sum(CASE WHEN b <> b2 THEN 1 ELSE 0 END) <= 2 THEN sum(b) ELSE 9 END AS bin FROM (SELECT bt.*, coalesce(lag(b) OVER w, last_value(b) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS b2 FROM bt WINDOW w AS (PARTITION BY stack, z, y, x ORDER BY k)) GROUP BY ALL)"""


@query(_with(("v_pixels",), f"SELECT f.stack, f.z, CAST(g.bin AS INT) AS bin, {_r('coalesce(n, 0)/64e0', 'share')} FROM (SELECT DISTINCT stack, z FROM v_pixels) f, (SELECT unnest(range(0, 10)) AS bin) g LEFT JOIN (SELECT stack, z, bin, count(*) AS n FROM cd GROUP BY ALL) c ON c.stack = f.stack AND c.z = f.z AND c.bin = g.bin", _patterns()))
def lbp_core(spark, sf):
    return rounded(curves.lbp_histogram(_frames(spark, sf)))


def _plane_rounds(rounds: int = 3) -> str:
    """CTEs of a plane's trimmed least squares: moments of what is kept, Cramer's rule, robust deviations of all points."""
    out = ["k0 AS (SELECT *, true AS keep FROM v_pixels)"]
    for i in range(rounds):
        out += [
            f"m{i} AS (SELECT stack, z, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy, sum(v) AS sv, sum(x*v) AS sxv, sum(y*v) AS syv FROM k{i} WHERE keep GROUP BY ALL)",
            f"d{i} AS (SELECT *, n*(sxx*syy - sxy*sxy) - sx*(sx*syy - sxy*sy) + sy*(sx*sxy - sxx*sy) AS det FROM m{i})",
            f"c{i} AS (SELECT stack, z, (sv*(sxx*syy - sxy*sxy) - sx*(sxv*syy - sxy*syv) + sy*(sxv*sxy - sxx*syv))/det AS a, (n*(sxv*syy - sxy*syv) - sv*(sx*syy - sxy*sy) + sy*(sx*syv - sxv*sy))/det AS b, (n*(sxx*syv - sxv*sxy) - sx*(sx*syv - sxv*sy) + sv*(sx*sxy - sxx*sy))/det AS c FROM d{i})",
            f"e{i} AS (SELECT k.stack, k.z, k.y, k.x, k.v, v - a - b*x - c*y AS e FROM k{i} k JOIN c{i} USING (stack, z))",
            f"f{i} AS (SELECT stack, z, median(e) AS mid FROM e{i} GROUP BY ALL)",
            f"g{i} AS (SELECT stack, z, median(abs(e - mid)) AS mad FROM e{i} JOIN f{i} USING (stack, z) GROUP BY ALL)",
            f"k{i + 1} AS (SELECT stack, z, y, x, v, abs(e) < 2.5e0*(1.4826e0*mad + 1e-6) AS keep FROM e{i} JOIN g{i} USING (stack, z))",
        ]
    return ", ".join(out)


@query(_with(("v_pixels",), f"SELECT stack, z, {_r('a', 'level')}, {_r('b', 'slope_x')}, {_r('c', 'slope_y')}, CAST(count(*) FILTER (keep) AS INT) AS kept, {_r('avg(CASE WHEN v >= 254.5e0 THEN 1e0 ELSE 0e0 END)', 'clipped')} FROM k3 JOIN c2 USING (stack, z) GROUP BY stack, z, a, b, c", _plane_rounds()))
def plane_background(spark, sf):
    return rounded(curves.plane_background(view(spark, sf, "v_pixels")))


_HOT = "hot AS (SELECT p.stack, p.z, p.y, p.x FROM v_pixels p JOIN (SELECT stack, z, median(v) AS m, stddev_pop(v) AS s FROM v_pixels GROUP BY 1, 2) USING (stack, z) WHERE v > m + 0.8e0*s)"


def _hot(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "v_pixels")
    stats = p.groupBy("stack", "z").agg(F.median("v").alias("m"), F.stddev_pop("v").alias("s"))
    return p.join(stats, ["stack", "z"]).where(F.col("v") > F.col("m") + 0.8 * F.col("s")).select("stack", "z", "y", "x")


@query(_with(("v_pixels",), "SELECT stack, z, y, unnest([min(x), max(x)]) AS x FROM hot GROUP BY 1, 2, 3 UNION SELECT stack, z, unnest([min(y), max(y)]) AS y, x FROM hot GROUP BY stack, z, x", _HOT))
def outer_crossings(spark, sf):
    return curves.first_last_crossings(_hot(spark, sf))


@query(_with(("v_pixels",), "SELECT stack, z, y, max(r) AS r FROM (SELECT stack, z, y, g, count(*) AS n, max(x) AS r FROM (SELECT *, x - row_number() OVER (PARTITION BY stack, z, y ORDER BY x) AS g FROM hot) GROUP BY 1, 2, 3, 4) WHERE n >= 2 GROUP BY 1, 2, 3", _HOT))
def rim_runs(spark, sf):
    return curves.outer_runs(_hot(spark, sf), 2)


# Curves, outlines and fits.


@query(_with(("v_curves",), f"""SELECT oid, z, {_r('v','v')}, {_r('z + coalesce(CASE WHEN abs(b-2*v+a) < 1e-12 THEN 0e0 ELSE least(greatest(0.5e0*(b-a)/CASE WHEN abs(b-2*v+a) >= 1e-12 THEN b-2*v+a END,-1e0),1e0) END, 0e0)','refined')}
  FROM (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY v DESC, z) AS rn FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM v_curves WINDOW w AS (PARTITION BY oid ORDER BY z))) WHERE rn = 1"""))  # fmt: skip
def subslice_refine(spark, sf):
    return rounded(curves.subslice_peak(view(spark, sf, "v_curves")))


@query(_with(("v_curves",), f"SELECT oid, {_r('CASE WHEN max(v) > 1e-12 THEN (max(v)-median(v))/max(v) END','ratio')} FROM v_curves GROUP BY oid"))
def sharpness_ratio(spark, sf):
    return rounded(curves.sharpness_ratio(view(spark, sf, "v_curves")))


@query(_with(("v_curves",), "SELECT oid, count(*) FILTER (v >= 0.5e0*m) AS n FROM (SELECT *, max(v) OVER (PARTITION BY oid) AS m FROM v_curves) GROUP BY oid"))
def in_focus_count(spark, sf):
    return curves.in_focus_count(view(spark, sf, "v_curves"))


@query(_with(("v_curves",), f"""SELECT oid, z, {_r('v','v')}, {_r('prom','prominence')} FROM (SELECT p.oid, p.z, p.v, p.rg, p.v - greatest(
   (SELECT min(q.v) FROM cu q WHERE q.oid=p.oid AND q.i<=p.i AND q.i > coalesce((SELECT max(h.i) FROM cu h WHERE h.oid=p.oid AND h.i<p.i AND h.v>p.v),0)),
   (SELECT min(q.v) FROM cu q WHERE q.oid=p.oid AND q.i>=p.i AND q.i < coalesce((SELECT min(h.i) FROM cu h WHERE h.oid=p.oid AND h.i>p.i AND h.v>p.v),1000))) AS prom
  FROM (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a, max(v) OVER (PARTITION BY oid) - min(v) OVER (PARTITION BY oid) AS rg FROM cu WINDOW w AS (PARTITION BY oid ORDER BY i)) p WHERE p.v > p.b AND p.v > p.a) WHERE prom >= greatest(1e-9, 0.15e0*rg)""",
  "cu AS (SELECT *, row_number() OVER (PARTITION BY oid ORDER BY z) AS i FROM v_curves)"))
def focal_peaks(spark, sf):
    return rounded(curves.focal_peaks(view(spark, sf, "v_curves")))


# Inner maxima; of two nearer than three slices the higher stays, taken in order of height; then prominence is judged.
_PLANES = """pt AS (SELECT oid, z, v, row_number() OVER w AS i, lag(v) OVER w AS b, lead(v) OVER w AS a FROM v_curves WINDOW w AS (PARTITION BY oid ORDER BY z)), mx AS (SELECT oid, max(v) AS top, max(v) - min(v) AS span FROM v_curves GROUP BY oid HAVING count(*) >= 3 AND max(v) > 1e-12),
 pk AS (SELECT pt.*, row_number() OVER (PARTITION BY oid ORDER BY v DESC, i DESC) AS n FROM pt JOIN mx USING (oid) WHERE v > b AND v > a),
 it AS (SELECT DISTINCT oid, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS kept FROM pk UNION ALL SELECT it.oid, pk.n, CASE WHEN len(list_filter(kept, lambda k: abs(k - pk.i) < 3)) > 0 THEN kept ELSE list_append(kept, pk.i) END FROM it JOIN pk ON pk.oid = it.oid AND pk.n = it.n + 1),
 st AS (SELECT oid, unnest(kept) AS i FROM it QUALIFY row_number() OVER (PARTITION BY oid ORDER BY n DESC) = 1),
 hi AS (SELECT k.oid, k.i, coalesce(max(q.i) FILTER (q.i < k.i), 0) AS lo, coalesce(min(q.i) FILTER (q.i > k.i), 1000000) AS up FROM pk k LEFT JOIN pt q ON q.oid = k.oid AND q.v > k.v GROUP BY ALL),
 pr AS (SELECT k.oid, k.i, k.v - greatest(min(q.v) FILTER (q.i <= k.i), min(q.v) FILTER (q.i >= k.i)) AS h FROM pk k JOIN hi USING (oid, i) JOIN pt q ON q.oid = k.oid AND q.i > lo AND q.i < up GROUP BY k.oid, k.i, k.v),
 fp AS (SELECT pk.oid, z, h/top AS share, z + CASE WHEN abs(b - 2*v + a) >= 1e-12 THEN least(greatest(0.5e0*(b - a)/(b - 2*v + a), -1e0), 1e0) ELSE 0e0 END AS refined FROM st JOIN pk USING (oid, i) JOIN pr ON pr.oid = pk.oid AND pr.i = pk.i JOIN mx ON mx.oid = pk.oid WHERE h >= greatest(1e-9, 0.15e0*span))"""


@query(_with(("v_curves",), f"SELECT oid, CAST(row_number() OVER (PARTITION BY oid ORDER BY share DESC, z) - 1 AS INT) AS rank, z, {_r('share', 'prominence')}, {_r('refined', 'refined')} FROM fp", _PLANES))
def focal_planes_full(spark, sf):
    return rounded(curves.focal_planes(view(spark, sf, "v_curves")))


_STEP = repr(2 * math.pi / 64)


@query(_with(("v_outlines",), f"""SELECT oid, {_r('a','outline_area_px2',3)}, {_r('p','outline_perimeter_px',3)}, {_r('m','radius_mean_px')}, {_r('s','radius_std_px')}, {_r('mm','radius_min_over_max')}, {_r('12.566370614359172e0*a/greatest(p*p,1e-9)','circularity')}, {_r('s/m','radius_cv')} FROM
  (SELECT oid, 0.5e0*sin({_STEP}e0)*sum(r*r2) AS a, sum(sqrt(power(r2*cos((k+1)*{_STEP}e0)-r*cos(k*{_STEP}e0),2)+power(r2*sin((k+1)*{_STEP}e0)-r*sin(k*{_STEP}e0),2))) AS p, avg(r) AS m, stddev_pop(r) AS s, min(r)/greatest(max(r),1e-9) AS mm
   FROM (SELECT *, coalesce(lead(r) OVER w, first_value(r) OVER w) AS r2 FROM v_outlines WINDOW w AS (PARTITION BY oid ORDER BY k)) GROUP BY oid)"""))  # fmt: skip
def outline_morphology(spark, sf):
    out = curves.outline_morphology(view(spark, sf, "v_outlines"))
    three = ("outline_area_px2", "outline_perimeter_px")
    return rounded(rounded(out, 4, three), 3, tuple(c for c in out.columns if c not in three))


@query(_with(("v_outlines",), "SELECT oid, " + ", ".join(_r(f"max(a) FILTER (h={k})/greatest(max(a) FILTER (h=0),1e-9)", f"harmonic_{k}", 6) for k in range(1, 7)) + f""", {_r('sum(a) FILTER (h>=7)/greatest(max(a) FILTER (h=0),1e-9)','harmonic_high',6)} FROM
  (SELECT oid, h, sqrt(power(sum(r*cos(((h*k) % 64)*{_STEP}e0)),2)+power(sum(r*sin(((h*k) % 64)*{_STEP}e0)),2))/64 AS a FROM v_outlines, (SELECT unnest(range(0,33)) AS h) GROUP BY oid, h) GROUP BY oid"""))  # fmt: skip
def harmonics(spark, sf):
    return rounded(curves.harmonics(view(spark, sf, "v_outlines")), 6)


# An ordered pair of corners is an edge of the hull if no corner lies to its right.
_HULL = f"""pt AS (SELECT oid, k, r, r*cos(k*{_STEP}e0) AS x, r*sin(k*{_STEP}e0) AS y FROM v_outlines), nx AS (SELECT a.*, b.r AS r2, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b ON a.oid = b.oid AND b.k = (a.k + 1) % 64),
 own AS (SELECT oid, {0.5 * math.sin(2 * math.pi / 64)!r}e0*sum(r*r2) AS area, sum(sqrt((x2-x)*(x2-x) + (y2-y)*(y2-y))) AS per, stddev_pop(r)/avg(r) AS cv FROM nx GROUP BY oid),
 ed AS (SELECT a.oid, a.x, a.y, b.x AS x2, b.y AS y2 FROM pt a JOIN pt b ON a.oid = b.oid AND a.k <> b.k JOIN pt c ON c.oid = a.oid GROUP BY ALL HAVING min((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x)) >= -1e-9),
 hu AS (SELECT oid, abs(sum(x*y2 - x2*y))/2 AS area, sum(sqrt((x2-x)*(x2-x) + (y2-y)*(y2-y))) AS length FROM ed GROUP BY oid)"""


@query(_with(("v_outlines",), f"SELECT oid, {_r('own.area/hu.area', 'solidity')}, {_r('length/per', 'convexity')}, CASE WHEN own.area/hu.area < 0.93e0 OR cv > 0.22e0 THEN 1e0 ELSE 0e0 END AS shape_suspect FROM own JOIN hu USING (oid)", _HULL))
def hull_shape(spark, sf):
    return rounded(curves.hull_shape(view(spark, sf, "v_outlines")))


_RAY = """ry AS (SELECT CAST(oid AS INT) AS z, k AS azimuth, CASE WHEN (oid*7+k*13) % 40 = 0 THEN r*2 ELSE r END AS r FROM v_outlines),
 rm AS (SELECT z, median(r) AS med FROM ry GROUP BY z), rd AS (SELECT ry.*, abs(r-med) AS dev FROM ry JOIN rm USING (z)), ra AS (SELECT z, median(dev) AS mad FROM rd GROUP BY z)"""


def _rays(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "v_outlines").select(F.col("oid").cast("int").alias("z"), F.col("k").alias("azimuth"), F.when((F.col("oid") * 7 + F.col("k") * 13) % 40 == 0, F.col("r") * 2).otherwise(F.col("r")).alias("r"))


@query(_with(("v_outlines",), f"SELECT z, azimuth, {_r('r','r')} FROM (SELECT rd.*, count(*) OVER (PARTITION BY z) AS n FROM rd JOIN ra USING (z) WHERE dev <= 4*greatest(1.4826e0*mad, 3e0)) WHERE n >= 30", _RAY))
def ray_mad_filter(spark, sf):
    return rounded(curves.ray_mad_filter(_rays(spark, sf)))


def _circle_rounds(rounds: int = 10, delta: float = 12.0) -> str:
    """CTEs of a reweighted circle: about the weighted mean the centre solves a two by two system, the radius is what is left."""
    out = [f"q0 AS (SELECT z, r*cos(azimuth*{_STEP}e0) AS x, r*sin(azimuth*{_STEP}e0) AS y, 1e0 AS w FROM ry)"]
    for i in range(rounds):
        out += [
            f"s{i} AS (SELECT z, sum(w) AS sw, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my FROM q{i} GROUP BY z)",
            f"t{i} AS (SELECT z, any_value(mx) AS mx, any_value(my) AS my, sum(w*dx*dx)/any_value(sw) AS a, sum(w*dx*dy)/any_value(sw) AS b, sum(w*dy*dy)/any_value(sw) AS c, sum(w*dx*(dx*dx+dy*dy))/any_value(sw) AS g, sum(w*dy*(dx*dx+dy*dy))/any_value(sw) AS h, sum(w*(dx*dx+dy*dy))/any_value(sw) AS k FROM (SELECT q.z, w, sw, mx, my, x - mx AS dx, y - my AS dy FROM q{i} q JOIN s{i} USING (z)) GROUP BY z)",
            f"u{i} AS (SELECT z, mx + ox AS cx, my + oy AS cy, sqrt(k + ox*ox + oy*oy) AS radius FROM (SELECT *, (g*c - h*b)/(2*(a*c - b*b)) AS ox, (h*a - g*b)/(2*(a*c - b*b)) AS oy FROM t{i}))",
            f"q{i + 1} AS (SELECT z, x, y, e, power({delta}e0/greatest(e, {delta}e0), 2) AS w FROM (SELECT q.z, x, y, abs(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy)) - radius) AS e FROM q{i} q JOIN u{i} USING (z)))",
        ]
    return ", ".join(out)


@query(_with(("v_outlines",), f"SELECT CAST(z AS BIGINT) AS z, {_r('cx', 'cx')}, {_r('cy', 'cy')}, {_r('radius', 'radius')}, {_r('median(e)', 'residual')}, median(e) <= 30e0 AS used FROM q10 JOIN u9 USING (z) GROUP BY z, cx, cy, radius", _RAY, _circle_rounds()))
def huber_circles(spark, sf):
    return rounded(curves.huber_circles(_rays(spark, sf)))


@query(_with(("v_rings",), f"""SELECT {_r('cz','cz')}, {_r('R','sphere_radius')}, {_r('sqrt(avg(power(sqrt(greatest(0e0,R*R-power(z*10.6e0-cz,2)))-radius,2)))','rms')}, count(*) AS n FROM v_rings,
  (SELECT regr_slope(radius*radius+z*10.6e0*z*10.6e0, z*10.6e0)/2 AS cz, sqrt(regr_intercept(radius*radius+z*10.6e0*z*10.6e0, z*10.6e0)+power(regr_slope(radius*radius+z*10.6e0*z*10.6e0, z*10.6e0)/2,2)) AS R FROM v_rings HAVING count(*) >= 4) GROUP BY cz, R"""))  # fmt: skip
def cap_fit(spark, sf):
    return rounded(curves.cap_fit(view(spark, sf, "v_rings")))


@query(_with(("v_rings",), f"SELECT z, {_r('median(radius) OVER ()','median_radius')}, {_r('stddev_pop(radius) OVER ()','scatter')} FROM v_rings"))
def ring_scatter(spark, sf):
    r = view(spark, sf, "v_rings")
    return rounded(r.select("z").join(F.broadcast(r.agg(F.median("radius").alias("median_radius"), F.stddev_pop("radius").alias("scatter")))))


_SHIFT = """vt AS (SELECT p.ta, p.tb, q.n AS z, (p.ta*7+p.tb*3+q.n*5) % 11 - 5e0 AS dy, (p.ta*5+p.tb*11+q.n*3) % 13 - 6e0 AS dx, ((p.ta*3+p.tb*7+q.n) % 10)/10e0 AS quality FROM v_pairs p, (SELECT unnest(range(0,9)) AS n) q),
 md AS (SELECT ta, tb, median(dy) AS my, median(dx) AS mx, median(quality) AS q, count(*) AS n FROM vt WHERE quality >= 0.15e0 GROUP BY 1, 2)"""


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "v_pairs").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(8))))
    a, b, n = F.col("ta"), F.col("tb"), F.col("n")
    return p.select("ta", "tb", F.col("n").alias("z"), ((a * 7 + b * 3 + n * 5) % 11 - 5.0).alias("dy"), ((a * 5 + b * 11 + n * 3) % 13 - 6.0).alias("dx"), (((a * 3 + b * 7 + n) % 10) / F.lit(10.0)).alias("quality"))


@query(_with(("v_pairs",), f"SELECT ta, tb, {_r('any_value(my)','dy')}, {_r('any_value(mx)','dx')}, {_r('median(sqrt(power(dy-my,2)+power(dx-mx,2)))','scatter')}, {_r('any_value(q)/(1+median(sqrt(power(dy-my,2)+power(dx-mx,2))))','confidence')}, any_value(n) AS n_planes FROM vt JOIN md USING (ta, tb) WHERE quality >= 0.15e0 GROUP BY ta, tb", _SHIFT))
def shift_votes(spark, sf):
    return rounded(registration.combined_shifts(_votes(spark, sf), PAR))


# Meshes, sorts, sets.


@query(_with(("v_outlines",), f"SELECT oid, CAST(j*64+k AS INT) AS vid, {_r(f'r*sin(j*{math.pi/8!r}e0)*cos(k*{_STEP}e0)','x')}, {_r(f'r*sin(j*{math.pi/8!r}e0)*sin(k*{_STEP}e0)','y')}, {_r(f'r*cos(j*{math.pi/8!r}e0)','z')} FROM v_outlines, (SELECT unnest(range(0,9)) AS j)"))
def mesh_vertices(spark, sf):
    return rounded(mesh.spheroid_vertices(view(spark, sf, "v_outlines")))


@query(_with(("v_objects",), "SELECT obj AS oid, CAST(2*cell+t AS INT) AS fid, CAST(CASE t WHEN 0 THEN j*64+k ELSE j*64+(k+1)%64 END AS INT) AS a, CAST(CASE t WHEN 0 THEN j*64+(k+1)%64 ELSE (j+1)*64+(k+1)%64 END AS INT) AS b, CAST((j+1)*64+k AS INT) AS c FROM (SELECT obj, cell, cell//64 AS j, cell%64 AS k, t FROM v_objects, (SELECT unnest(range(0,512)) AS cell), (SELECT unnest([0,1]) AS t))"))
def mesh_faces(spark, sf):
    return mesh.spheroid_faces(view(spark, sf, "v_objects").select(F.col("obj").alias("oid"))).select("oid", "fid", *[F.col(c).cast("int").alias(c) for c in "abc"])


@query(_with(("v_outlines",), "SELECT oid, n, (row_number() OVER (ORDER BY oid) - 1)*n AS base FROM (SELECT oid, count(*)*9 AS n FROM v_outlines GROUP BY oid)"))
def mesh_vertex_base(spark, sf):
    sizes = view(spark, sf, "v_outlines").groupBy("oid").agg((F.count(F.lit(1)) * 9).alias("n"))
    return mesh.with_vertex_base(sizes).select("oid", "n", "base")


@query(_with(("v_objects",), "SELECT obj, r FROM v_objects ORDER BY r DESC, obj LIMIT 4"))
def top_largest(spark, sf):
    return view(spark, sf, "v_objects").select("obj", "r").orderBy(F.desc("r"), "obj").limit(4)


@query(_with(("v_outlines",), "SELECT oid, " + ", ".join(f"round(max(r) FILTER (k={k}),3) AS r_{k:02d}" for k in range(64)) + " FROM v_outlines GROUP BY oid"))
def outline_columns(spark, sf):
    held = view(spark, sf, "v_outlines").groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("k", "r"))).alias("c"))
    return held.select("oid", *[F.round(F.col("c")[k]["r"], 3).alias(f"r_{k:02d}") for k in range(64)])


@query("""WITH a AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS l FROM nation WHERE n_nationkey < 20), b AS (SELECT n_name AS key, CAST(CASE WHEN n_nationkey % 4 = 0 THEN 9 ELSE n_regionkey END AS VARCHAR) AS r FROM nation WHERE n_nationkey >= 5)
  SELECT key, l AS "left", r AS "right" FROM a FULL JOIN b USING (key) WHERE l IS DISTINCT FROM r""")  # fmt: skip
def params_diff(spark, sf):
    n = table(spark, sf, "nation")
    a = n.where("n_nationkey < 20").select("n_name", F.col("n_regionkey").cast("string"))
    b = n.where("n_nationkey >= 5").select("n_name", F.when(F.col("n_nationkey") % 4 == 0, 9).otherwise(F.col("n_regionkey")).cast("string"))
    return cat.params_diff(a, b)


@query(_with(_SV, f"""SELECT uid, tile, obj, {_r('x','x_mosaic_px')}, {_r('y','y_mosaic_px')}, {_r('2*r','diameter_px')}, {_r('clear','dome_distance_px',3)}, {_r('kd','nn_distance_px',3)} FROM
  (SELECT o.*, {_RAD} - sqrt((x-{_CX})*(x-{_CX}) + (y-{_CY})*(y-{_CY}) + ((z-{_CZ})*{_AN})*((z-{_CZ})*{_AN})) - r AS clear, (SELECT min(sqrt(power(o.x-p.x,2)+power(o.y-p.y,2)+power(o.z*2.65e0-p.z*2.65e0,2))) FROM objs p WHERE p.uid<>o.uid) AS kd FROM objs o)""", _SEAM, _COMP, _CAT))  # fmt: skip
def features_wide(spark, sf):
    """The catalogue with its spatial and neighbourhood blocks: the wide projection."""
    o = _catalogue(spark, sf)
    wide = scalars.with_spatial_features(o, DOME).join(matching.knn(o, 5, key="uid"), "uid", "left")
    out = wide.select("uid", "tile", "obj", F.col("x").alias("x_mosaic_px"), F.col("y").alias("y_mosaic_px"), (2 * F.col("r")).alias("diameter_px"), "dome_distance_px", "nn_distance_px")
    three = ("dome_distance_px", "nn_distance_px")
    return rounded(rounded(out, 4, three), 3, tuple(c for c in out.columns if c not in three))


# Selections and checks.


@query(_with(("v_objects",), f"""SELECT obj, {_r('b','nearest_border_px',3)} FROM (SELECT obj, least(clear, edge) AS b, row_number() OVER (ORDER BY least(clear, edge), obj) AS n, count(*) OVER () AS total FROM sq) WHERE n <= 3 OR n IN (total//2 + 1, total//2 + 2)""", _SPATIAL))
def near_border_picks(spark, sf):
    o = scalars.with_spatial_features(_objects_xyz(spark, sf), DOME).select("obj", "nearest_border_px")
    return rounded(reports.near_border_picks(o), 3)


@query(_with(("v_sightings",), "SELECT tile, obj, sharp FROM v_sightings ORDER BY CASE WHEN 2*r > 30 AND sharp > 0.5e0 THEN 1 ELSE 0 END DESC, sharp DESC, tile, obj LIMIT 1"))
def showcase_object(spark, sf):
    return reports.showcase(view(spark, sf, "v_sightings"))


@query(_with(("v_objects",), f"""SELECT obj, {_r(f'{_CX} + dx/far*ring','ex',3)}, {_r(f'{_CY} + dy/far*ring','ey',3)} FROM (SELECT obj, gx-{_CX} AS dx, gy-{_CY} AS dy, greatest(sqrt((gx-{_CX})*(gx-{_CX}) + (gy-{_CY})*(gy-{_CY})), 1e-6) AS far,
  sqrt(greatest({_RAD}*{_RAD} - ((gz-{_CZ})*{_AN})*((gz-{_CZ})*{_AN}), 0e0)) AS ring FROM v_objects)"""))  # fmt: skip
def border_ends(spark, sf):
    return rounded(reports.border_ends(_objects_xyz(spark, sf), DOME), 3)


@query(_with(_SV, f"SELECT arg_min(ta, row(match_rate, ta, tb)) AS ta, arg_min(tb, row(match_rate, ta, tb)) AS tb, {_r('min(match_rate)','match_rate')}, {_r('max(residual) FILTER (shared >= 6)','worst_residual')} FROM seams", _SEAM, _SEAMS))
def weakest_seam(spark, sf):
    return rounded(reports.weakest_seam(cat.seam_report(_sightings(spark, sf), view(spark, sf, "v_tiles"), _matched(spark, sf), PAR)))


@query(_with(_SV, "SELECT count(*) AS n, count(DISTINCT uid) AS n_distinct, count(*) = count(DISTINCT uid) AS is_unique FROM objs", _SEAM, _COMP, _CAT))
def unique_uids(spark, sf):
    return reports.unique_ids(_catalogue(spark, sf))


@query(_with(("v_sightings", "v_tiles"), f"SELECT s.tile, s.obj, {_r('s.x - t.x0','x_px')}, {_r('s.y - t.y0','y_px')} FROM v_sightings s JOIN v_tiles t USING (tile)"))
def local_coordinates(spark, sf):
    t = view(spark, sf, "v_tiles").select("tile", "x0", "y0")
    return rounded(view(spark, sf, "v_sightings").join(t, "tile").select("tile", "obj", (F.col("x") - F.col("x0")).alias("x_px"), (F.col("y") - F.col("y0")).alias("y_px")))


@query(_with(("v_tiles",), f"SELECT {_r('regr_slope(x0, 9e6 - x0*3774.4e0)*1e4','scale_x',3)}, {_r('regr_intercept(x0, 9e6 - x0*3774.4e0)','origin_x',2)}, {_r('regr_slope(y0, 1e6 + y0*3774.4e0)*1e4','scale_y',3)}, {_r('regr_intercept(y0, 1e6 + y0*3774.4e0)','origin_y',2)} FROM v_tiles"))
def stage_affine(spark, sf):
    t = view(spark, sf, "v_tiles").select("x0", "y0", (9e6 - F.col("x0") * 3774.4).alias("stage_x"), (1e6 + F.col("y0") * 3774.4).alias("stage_y"))
    f = reports.stage_affine(t)
    return f.select(*[(F.round(F.col(f"scale_{a}") * 1e4, 3) + 0.0).alias(f"scale_{a}") for a in "xy"], *[(F.round(F.col(f"origin_{a}"), 2) + 0.0).alias(f"origin_{a}") for a in "xy"])


@query(_with(("v_pixels",), "SELECT stack, z, arg_max(r, row(round(m,9), -r)) AS r FROM (SELECT stack, z, x AS r, median(v*v) AS m FROM v_pixels GROUP BY 1, 2, 3) GROUP BY stack, z"))
def texture_ridge(spark, sf):
    p = view(spark, sf, "v_pixels").select("stack", "z", F.col("x").alias("r"), (F.col("v") * F.col("v")).alias("t"))
    return reports.texture_ridge(p, ["stack"])


@query(_with(("v_pixels",), f"SELECT z, cx, {_r('avg(abs(b-a))','step')} FROM (SELECT z, cx, cy, (lag(v,1) OVER w + lag(v,2) OVER w)/2 AS b, (v + lead(v,1) OVER w)/2 AS a FROM (SELECT z, cx, cy, max(v) AS v FROM tp GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY z, cy ORDER BY cx)) WHERE cx % 6 = 0 AND b IS NOT NULL AND a IS NOT NULL GROUP BY z, cx", _TP))
def seam_steps(spark, sf):
    return rounded(reports.column_steps(frames.max_composite(_tile_pixels(spark, sf), ["z"]), F.col("cx") % 6 == 0, ["z"]))


_TPT = _TP.replace("tp AS (SELECT", "tq AS (SELECT stack AS tile,")


@query(_with(("v_pixels",), f"SELECT a.z, count(*) AS n, {_r('avg(abs(a.v-b.v))','gap')} FROM tq a JOIN tq b ON a.z=b.z AND a.cx=b.cx AND a.cy=b.cy AND a.tile+1=b.tile GROUP BY 1", _TPT))
def overlap_disagreement(spark, sf):
    p = view(spark, sf, "v_pixels").select("z", F.col("stack").alias("tile"), ((F.col("stack") % 5) * 6 + F.col("x")).alias("cx"), F.col("y").alias("cy"), (F.col("v") + 128.0).alias("v"))
    return rounded(reports.overlap_disagreement(p, ["z"]))


@query(_with(("v_tiles",), "SELECT tile, x0 + 1e0 AS x0, y0 AS y0 FROM v_tiles"))
def saved_offsets(spark, sf):
    t = view(spark, sf, "v_tiles")
    return reports.with_saved_offsets(t, t.select("tile", (F.col("x0") + 1.0).alias("x0"), "y0"))


@query("SELECT l_orderkey AS oid, string_agg(CAST(l_linenumber AS VARCHAR), ';' ORDER BY l_linenumber) AS views FROM lineitem GROUP BY 1")
def view_names(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("oid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda t: t.cast("string")), ";").alias("views"))


@query(_with(("v_outlines",), f"SELECT oid, {_r('12.566370614359172e0*sum(r)/power(sum(r)/8,2)','circularity')}, {_r('sqrt(sum(r)/3.141592653589793e0)','radius')} FROM v_outlines GROUP BY oid"))
def detection_shape(spark, sf):
    s = view(spark, sf, "v_outlines").groupBy("oid").agg(F.sum("r").alias("area"))
    return rounded(s.select("oid", scalars.circularity(F.col("area"), F.col("area") / 8).alias("circularity"), F.sqrt(F.col("area") / scalars.PI).alias("radius")))


from . import scan_queries  # noqa: E402, F401  adds its queries
