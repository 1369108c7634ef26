"""Small selections and checks over finished tables: showcases, borders, seams of composites, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import Dome


def near_border_picks(objects: DataFrame, near: int = 3, middle: int = 2) -> DataFrame:
    """The objects nearest to a border and the ones around the middle rank."""
    known = objects.where(F.col("nearest_border_px").isNotNull())
    n = known.count()
    # Ranks up to the middle: two sorted limits, no window over everything.
    first = known.orderBy("nearest_border_px", "obj").limit(near)
    half = known.orderBy("nearest_border_px", "obj").offset(n // 2).limit(middle)
    return first.union(half).distinct()


def showcase(objects: DataFrame, min_diameter: float = 30.0, min_sharpness: float = 0.5) -> DataFrame:
    """The sharpest object of good size, of all objects if there is none."""
    good = ((2 * F.col("r") > min_diameter) & (F.col("sharp") > min_sharpness)).cast("int")
    best = F.struct(good.alias("g"), F.col("sharp"), (-F.col("tile")).alias("t"), (-F.col("obj")).alias("o"))
    return objects.agg(F.max_by(F.struct("tile", "obj", "sharp"), best).alias("v")).select("v.*")


def border_ends(objects: DataFrame, d: Dome = Dome()) -> DataFrame:
    """(obj, ex, ey): the droplet's ring at each object's own depth, in the object's direction."""
    dx, dy = F.col("x") - d.cx, F.col("y") - d.cy
    far = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-6))
    dz = (F.col("z") - d.cz) * d.anisotropy
    ring = F.sqrt(F.greatest(F.lit(d.radius**2) - dz * dz, F.lit(0.0)))
    return objects.select("obj", (d.cx + dx / far * ring).alias("ex"), (d.cy + dy / far * ring).alias("ey"))


def weakest_seam(seams: DataFrame) -> DataFrame:
    """The seam with the lowest match rate and the worst informative residual."""
    return seams.agg(
        F.min_by(F.struct("ta", "tb"), F.struct("match_rate", "ta", "tb")).alias("weak"), F.min("match_rate").alias("match_rate"), F.max(F.when(F.col("informative"), F.col("residual"))).alias("worst_residual")
    ).select("weak.ta", "weak.tb", "match_rate", "worst_residual")


def unique_ids(objects: DataFrame, key: str = "uid") -> DataFrame:
    """(n, distinct, unique): whether a number names one object."""
    return objects.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("n_distinct")).withColumn("is_unique", F.col("n") == F.col("n_distinct"))


def stage_affine(stage: DataFrame) -> DataFrame:
    """Least-squares scale and origin of stage against pixels, by axis."""
    fit = lambda a: [F.regr_slope(f"{a}0", f"stage_{a}").alias(f"scale_{a}"), F.regr_intercept(f"{a}0", f"stage_{a}").alias(f"origin_{a}")]
    return stage.agg(*fit("x"), *fit("y"))


def texture_ridge(polar: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(z, r): the radius at which the median texture over azimuths is highest, the inner one of equals (F27), for each ``by``."""
    by = by or []
    mid = polar.groupBy(*by, "z", "r").agg(F.median("t").alias("m"))
    return mid.groupBy(*by, "z").agg(F.max_by("r", F.struct(F.round("m", 9), -F.col("r"))).alias("r"))


def column_steps(canvas: DataFrame, at: Column, by: list[str] | None = None) -> DataFrame:
    """(cx, step): mean jump between the two columns before and the two from each ``at`` column on (F28), for each ``by``."""
    by = by or []
    w = Window.partitionBy(*by, "cy").orderBy("cx")
    pairs = canvas.withColumn("before", (F.lag("v", 1).over(w) + F.lag("v", 2).over(w)) / 2).withColumn("after", (F.col("v") + F.lead("v", 1).over(w)) / 2)
    return pairs.where(at & F.col("before").isNotNull() & F.col("after").isNotNull()).groupBy(*by, "cx").agg(F.avg(F.abs(F.col("before") - F.col("after"))).alias("step"))


def overlap_disagreement(tile_pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n, gap): mean difference of two tiles at the canvas cells that both see (F28), for each ``by``."""
    by = by or []
    a, b = tile_pixels.alias("a"), tile_pixels.alias("b")
    met = a.join(b, [F.col("a.cx") == F.col("b.cx"), F.col("a.cy") == F.col("b.cy"), F.col("a.tile") + 1 == F.col("b.tile"), *[F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]])
    return met.groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("a.v") - F.col("b.v"))).alias("gap"))


def with_saved_offsets(tiles: DataFrame, saved: DataFrame) -> DataFrame:
    """Tiles with the offsets of a finished run; a tile without one stops the query."""
    both = tiles.join(saved.select("tile", F.col("x0").alias("sx"), F.col("y0").alias("sy")), "tile", "left")
    missing = F.raise_error(F.concat(F.lit("no saved offset for tile "), F.col("tile").cast("string")))
    return both.withColumn("sx", F.when(F.col("sx").isNull(), missing.cast("double")).otherwise(F.col("sx"))).select("tile", F.col("sx").alias("x0"), F.col("sy").alias("y0"))


def results_listing(spark, root: str) -> DataFrame:
    """(run, n, calibrated, has_dome) of every ``organoids.json`` below ``root``."""
    rows = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "organoids.json").schema(
        "units struct<px_um:double,z_um:double>, dome struct<radius_px:double>, organoids array<struct<id:long>>"
    ).json(root).withColumn("path", F.input_file_name())
    return rows.select(
        F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("run"), F.size("organoids").alias("n"), (F.col("units.px_um").isNotNull() & F.col("units.z_um").isNotNull()).alias("calibrated"), F.col("dome").isNotNull().alias("has_dome")
    )
