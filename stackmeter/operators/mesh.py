"""Meshes as tables of vertices and faces, made by expression."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spheroid_vertices(outlines: DataFrame, n_theta: int = 64, n_phi: int = 8) -> DataFrame:
    """(oid, vid, x, y, z): the outline r(k) turned over ``n_phi + 1`` latitudes."""
    j = F.explode(F.sequence(F.lit(0), F.lit(n_phi))).alias("j")
    phi, theta = F.col("j") * (math.pi / n_phi), F.col("k") * (2 * math.pi / n_theta)
    return outlines.select("oid", "k", "r", j).select(
        "oid", (F.col("j") * n_theta + F.col("k")).cast("int").alias("vid"), (F.col("r") * F.sin(phi) * F.cos(theta)).alias("x"), (F.col("r") * F.sin(phi) * F.sin(theta)).alias("y"), (F.col("r") * F.cos(phi)).alias("z")
    )


def spheroid_faces(objects: DataFrame, n_theta: int = 64, n_phi: int = 8) -> DataFrame:
    """(oid, fid, a, b, c): two triangles for each cell of the grid."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(n_phi * n_theta - 1))).alias("cell")
    cells = objects.sparkSession.range(1).select(cell).select("cell", F.explode(F.array(F.lit(0), F.lit(1))).alias("t"))
    j, k = F.expr(f"cell div {n_theta}").cast("int"), F.col("cell") % n_theta
    a, b = j * n_theta + k, j * n_theta + (k + 1) % n_theta
    corners = F.when(F.col("t") == 0, F.struct(a.alias("a"), b.alias("b"), (a + n_theta).alias("c"))).otherwise(F.struct(b.alias("a"), (b + n_theta).alias("b"), (a + n_theta).alias("c")))
    faces = cells.select((F.col("cell") * 2 + F.col("t")).cast("int").alias("fid"), corners.alias("f")).select("fid", "f.a", "f.b", "f.c")  # one grid's, the same for all
    return _dealt(objects.select("oid")).crossJoin(F.broadcast(faces))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over all tasks before each becomes many: a small file is read by one task, whatever is made of it."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cap_vertices(caps: DataFrame, n_ring: int = 8, n_theta: int = 24) -> DataFrame:
    """``caps`` (any keys, cx, cy, cz, radius, contact, anisotropy) as (keys, ring, k, x, y, z): rings from each apex to its contact circle."""
    shape = ("cx", "cy", "cz", "radius", "contact", "anisotropy")
    keys = [c for c in caps.columns if c not in shape]
    grid = _dealt(caps).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_ring))).alias("ring")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n_theta - 1))).alias("k"))
    rho, theta = F.col("contact") / n_ring * F.col("ring"), F.col("k") * (2 * math.pi / n_theta)
    z = F.col("cz") - F.sqrt(F.greatest(F.col("radius") * F.col("radius") - rho * rho, F.lit(0.0))) / F.col("anisotropy")
    return grid.select(*keys, "ring", "k", (F.col("cx") + rho * F.cos(theta)).alias("x"), (F.col("cy") + rho * F.sin(theta)).alias("y"), z.alias("z"))


def with_vertex_base(sizes: DataFrame) -> DataFrame:
    """(oid, n, base): where each object's vertices start when all are written one after another."""
    from .catalogue import numbered  # order without one big sort in one task

    w = numbered(sizes, ["oid"], "place")
    return w.withColumn("base", F.col("place") * F.col("n"))
