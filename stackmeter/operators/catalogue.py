"""From sightings to one catalogue: seams, components, election of one view, flags, numbering, reports.

One view of an object is elected, never an average; what the overlap cannot show
stays null or flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..params import Acquisition, Dome, Params
from ..storage import materialise
from . import matching


def reach(sightings: DataFrame, p: Params = Params()) -> float:
    """The widest lateral gate of any sighting, the cell size of ``gated_pairs``."""
    widest = sightings.where(~F.isnan("r")).agg(F.max("r")).first()[0] or 0.0
    return p.lateral_base_px + p.lateral_per_radius * widest


def numbered(df: DataFrame, order: list[str | Column], name: str = "uid", start: int = 0) -> DataFrame:
    """``df`` plus a gapless number in a global order, without one task that sees all rows.

    Rows are sorted by range and written; each partition's rows are moved on by the
    partitions before it (one row for each partition).
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held = materialise(placed, "numbered")
    before = held.groupBy("__part").count().select("__part", (F.sum("count").over(Window.orderBy("__part")) - F.col("count") + F.lit(start)).alias("__before"))
    return held.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__row")).cast("long")).drop("__part", "__row", "__before")


def with_sid(sightings: DataFrame) -> DataFrame:
    """``sid``: the identity of a sighting, from its tile and its number there."""
    return sightings.withColumn("sid", F.col("tile").cast("long") * 10_000_000_000 + F.col("obj"))


def matched(sightings: DataFrame, tiles: DataFrame, p: Params = Params(), a: Acquisition = Acquisition()) -> DataFrame:
    """One-to-one pairs over all seams (E2, E4 - E6); ``sightings`` has sid and clipped."""
    pairs = matching.neighbour_pairs(tiles)
    candidates = matching.seam_candidates(sightings, tiles, pairs)
    return matching.assigned(matching.gated_pairs(candidates, reach(sightings, p), p, a))


def seam_report(sightings: DataFrame, tiles: DataFrame, pairs: DataFrame, p: Params = Params()) -> DataFrame:
    """(ta, tb, shared, match_rate, residual, informative, asymmetric) of each seam."""
    seams = matching.neighbour_pairs(tiles).select("ta", "tb")
    candidates = matching.seam_candidates(sightings, tiles, seams)
    seen = candidates.groupBy("ta", "tb").agg(F.count(F.lit(1)).alias("n"))
    met = pairs.groupBy("ta", "tb").agg(F.count(F.lit(1)).alias("pairs"), F.median("lateral_px").alias("residual"))
    out = seams.join(seen, ["ta", "tb"], "left").join(met, ["ta", "tb"], "left").fillna(0, ["n", "pairs"])
    rate = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(2 * F.col("pairs") / F.col("n"))
    return out.select("ta", "tb", F.col("pairs").alias("shared"), rate.alias("match_rate"), F.coalesce("residual", F.lit(0.0)).alias("residual"), (F.col("pairs") >= p.informative_seam).alias("informative"), (rate < p.seam_match_rate).alias("asymmetric"))


def merge_summary(seams: DataFrame, p: Params = Params()) -> DataFrame:
    """(n_seams, worst_residual, reliable, weakest_rate): reliable if no informative seam is off, or none informs."""
    worst = F.max(F.when(F.col("informative"), F.col("residual")))
    return seams.agg(F.count(F.lit(1)).alias("n_seams"), F.coalesce(worst, F.lit(0.0)).alias("worst_residual"), F.coalesce(worst <= p.merge_tolerance_px, F.lit(True)).alias("reliable"), F.min("match_rate").alias("weakest_rate"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Median, ninth decile and maximum of lateral and axial gaps; zeros without pairs."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return pairs.agg(*[zero(v).alias(f"{c}_{n}") for c in ("lateral_px", "axial_slices") for v, n in ((F.median(c), "median"), (F.percentile(F.col(c), F.lit(0.9)), "p90"), (F.max(c), "max"))])


def with_components(sightings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sightings plus ``comp``, as a table: elections, spreads and views all read it."""
    return materialise(sightings.join(matching.components(pairs, sightings.select("sid")), "sid"), "grouped")


def catalogue(grouped: DataFrame, tiles: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each component: the elected view, spreads and flags, numbered by (y, x).

    Elected is the view that is not clipped, farthest from its tile's edge, sharpest, and
    first by tile and number.
    """
    best = F.struct(F.col("clipped").cast("int").alias("c"), (-F.col("edge")).alias("e"), (-F.col("sharp")).alias("s"), F.col("tile").alias("t"), F.col("obj").alias("o"))
    means = grouped.groupBy("comp").agg(
        F.min_by(F.struct("tile", "obj", "x", "y", "z", "r", "sharp", "clipped"), best).alias("v"), F.count(F.lit(1)).alias("n_views"), F.countDistinct("tile").alias("n_tiles"),
        F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.max("z") - F.min("z")).alias("axial_spread_slices"), (F.max("r") / F.min("r")).alias("radius_ratio"), F.max("r").alias("rmax"),
        F.min(F.col("clipped").cast("int")).alias("all_clipped"), F.array_join(F.transform(F.array_sort(F.collect_list("tile")), lambda t: t.cast("string")), ";").alias("views"),
    )
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    spread = grouped.select("comp", "x", "y").join(means.select("comp", "mx", "my"), "comp").groupBy("comp").agg(F.max(F.sqrt(dx * dx + dy * dy)).alias("lateral_spread_px"))
    cover = matching.coverage(means.select("comp", F.col("mx").alias("x"), F.col("my").alias("y")), tiles, "comp")
    narrow = matching.overlap(tiles).agg((F.min("overlap_px") / 2).alias("half"))
    out = means.join(spread, "comp").join(cover, "comp", "left").join(F.broadcast(narrow))
    out = out.select(
        "v.tile", "v.obj", "v.x", "v.y", "v.z", "v.r", "v.sharp", "v.clipped", "n_views", "views", F.coalesce("coverage_k", F.lit(0)).alias("coverage_k"),
        "lateral_spread_px", "axial_spread_slices", "radius_ratio", (F.col("all_clipped") == 1).alias("clipped_everywhere"),
        ((F.col("n_views") == 1) & (F.coalesce("coverage_k", F.lit(0)) > 1)).alias("single_view_in_overlap"),
        (F.col("radius_ratio") > p.radius_disagreement).alias("radius_disagreement"), (F.col("n_tiles") < F.col("n_views")).alias("same_tile_twice"), (F.col("rmax") > F.col("half")).alias("guarantee_void"),
    )
    return numbered(out, ["y", "x", "tile", "obj"])


def views_long(grouped: DataFrame) -> DataFrame:
    """One row for each sighting, ``elected`` 0 or 1."""
    w = Window.partitionBy("comp").orderBy("clipped", F.desc("edge"), F.desc("sharp"), "tile", "obj")
    return grouped.withColumn("elected", (F.row_number().over(w) == 1).cast("int"))


def enclosed(objects: DataFrame, dome: Dome, by: tuple[str, ...] = (), least: float = 0.9) -> DataFrame:
    """(enclosed, reliable): the share of objects that a droplet holds, a quarter of their radius let out, and whether it is enough."""
    r = F.col("r")
    inside = scalars.dome_distance(dome, F.col("x"), F.col("y"), F.col("z")) - r > -0.25 * r
    share = F.avg(inside.cast("double"))
    return objects.groupBy(*by).agg(share.alias("enclosed"), (share >= least).alias("reliable"))


def recall(objects: DataFrame) -> DataFrame:
    """(once, twice, implied_recall) where two tiles look: null under ten objects seen twice."""
    seen = objects.where("coverage_k >= 2").agg(F.sum((F.col("n_views") == 1).cast("long")).alias("once"), F.sum((F.col("n_views") >= 2).cast("long")).alias("twice"))
    return seen.select(F.coalesce("once", F.lit(0)).alias("once"), F.coalesce("twice", F.lit(0)).alias("twice"), F.when(F.col("twice") >= 10, F.lit(2.0) / (F.col("once") / F.col("twice") + 2)).alias("implied_recall"))


def subset(objects: DataFrame, tiles: list[int] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Objects of some fields and detectors; None stands for all of them."""
    out = objects if tiles is None else objects.where(F.col("tile").isin(tiles))
    return out if sources is None else out.where(F.col("source").isin(sources))


def source_counts(objects: DataFrame) -> DataFrame:
    """(source, n): how many objects each detector gave."""
    return objects.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def run_summary(objects: DataFrame) -> DataFrame:
    """Counts, quartiles of the diameter, depth range and volume of a run."""
    d = 2 * F.col("r")
    return objects.agg(
        F.count(F.lit(1)).alias("n"), F.median(d).alias("diameter_median"), F.percentile(d, F.lit(0.25)).alias("diameter_q1"), F.percentile(d, F.lit(0.75)).alias("diameter_q3"),
        F.max(d).alias("diameter_max"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.sum(F.lit(4 / 3 * 3.141592653589793) * F.col("r") * F.col("r") * F.col("r")).alias("volume_px3"),
    )


def merged_sources(edf: DataFrame, slices: DataFrame) -> DataFrame:
    """Union of two detectors' objects, the projection's before the slices' at equal sharpness."""
    return edf.withColumn("source", F.lit("edf")).withColumn("prio", F.lit(0)).unionByName(slices.withColumn("source", F.lit("slices")).withColumn("prio", F.lit(1)))


def params_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, left, right) of settings that differ or are missing on a side."""
    both = a.toDF("key", "left").join(b.toDF("key", "right"), "key", "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))
