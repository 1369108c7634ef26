"""From frames to measured objects, for any number of stacks at once.

Stages are DataFrames keyed by stack: focus profile and glass plane, depth projection,
segmentation of the projection and of every n-th slice, focus curves of the outlines,
their focal planes, suppression of repeats, the focus gate and the droplet fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import curves as kc
from ..kernels import image
from ..functions import scalars
from ..operators import catalogue, curves, frames, matching, registration
from ..params import Acquisition, Params
from ..storage import materialise


@dataclass(frozen=True)
class FieldOptions:
    """``mode`` is edf, slices or both; a glass plane found elsewhere replaces the stack's own."""

    mode: str = "both"
    edf_sigma: float = 6.0
    z_step: int = 4
    band_px: int = 4
    min_area: int = 30
    substrate: float | None = None


def profile(stack: DataFrame) -> DataFrame:
    """(stack, z, v): mean sharpness of each slice."""
    return frames.focus_measures(stack).select("stack", "z", F.col("tenengrad").alias("v"))


def analysed(stack: DataFrame, planes: DataFrame, p: Params = Params()) -> DataFrame:
    """Frames above the glass: z < max(3, min(depth, plane - margin + 1))."""
    depth = stack.groupBy("stack").agg((F.max("z") + 1).alias("depth"))
    limit = planes.join(depth, "stack").select("stack", F.greatest(F.lit(3), F.least("depth", F.col("plane") - p.substrate_margin + 1)).alias("limit"))
    return stack.join(limit, "stack").where(F.col("z") < F.col("limit")).drop("limit")


def gated(found: DataFrame, p: Params = Params()) -> DataFrame:
    """Detections of plausible size and shape."""
    return found.where(F.col("radius").between(p.min_diameter_px / 2, p.max_diameter_px / 2) & (F.col("circ") >= p.min_circularity) & (F.size("xs") >= 8))


#: What both detectors give for an object.
OBJECT = ["stack", "sid", "x", "y", "z", "r", "sharp", "circ", "area", "n_slices", "z_first", "z_last", "profile"]


def with_profile(df: DataFrame, n_theta: int) -> DataFrame:
    """``profile``: the outline's radius at ``n_theta`` angles around (cx, cy), in place of its contour."""

    @F.pandas_udf("array<double>")
    def radii(xs: pd.Series, ys: pd.Series, cx: pd.Series, cy: pd.Series) -> pd.Series:
        return pd.Series([kc.resample(np.asarray(x), np.asarray(y), n_theta, a, b) for x, y, a, b in zip(xs, ys, cx, cy, strict=True)])

    return df.withColumn("profile", radii("xs", "ys", "cx", "cy")).drop("xs", "ys")


def projected_objects(stack: DataFrame, o: FieldOptions, p: Params, a: Acquisition, segmenter=None) -> DataFrame:
    """``OBJECT`` from the depth projection: one row for each focal plane of an outline.

    Sharpness is the plane's prominence; ``n_slices`` are those at least half as sharp as the sharpest (F26).
    """
    projection = frames.focus_stacked(stack, o.edf_sigma).select("stack", F.lit(0).alias("z"), "height", "width", F.col("edf").alias("px"))
    found = gated(frames.segmented(projection, segmenter, o.min_area), p).withColumn("oid", F.col("stack").cast("long") * 1_000_000 + F.col("label"))
    found = materialise(found, "outlines")
    curve = materialise(frames.band_curve(stack, found.select("stack", "oid", "xs", "ys"), o.band_px), "curves")
    planes = curves.focal_planes(curve, F.greatest(F.lit(2.0), scalars.scales(a)["dof_slices"]))
    swept = curve.groupBy("oid").agg(F.min("z").alias("z_first"), F.max("z").alias("z_last")).join(curves.in_focus_count(curve), "oid").withColumnRenamed("n", "n_slices")
    out = planes.join(swept, "oid").join(with_profile(found.select("oid", "stack", "cx", "cy", "area", "radius", "circ", "xs", "ys"), p.n_theta), "oid")
    out = out.withColumns({"sid": F.col("oid") * 100 + F.col("rank"), "x": F.col("cx"), "y": F.col("cy"), "z": F.col("refined"), "r": F.col("radius"), "sharp": F.col("prominence")})
    return out.select(*OBJECT)


def tracked_objects(stack: DataFrame, planes: DataFrame, o: FieldOptions, p: Params, a: Acquisition, segmenter=None) -> DataFrame:
    """The same from every ``z_step``-th slice, linked in depth.

    The sharpest of a track's own outlines is swept through the slices around it (three depths of field, six at least,
    either way); each focal plane found is one row, measured on the track's outline nearest to that plane.
    """
    found = gated(frames.segmented(stack.where(F.col("z") % o.z_step == 0), segmenter, o.min_area), p)
    found = found.withColumn("sid", (F.col("stack").cast("long") * 10_000 + F.col("z")) * 100_000 + F.col("label"))
    found = materialise(found, "slices")
    tracks = matching.linked_tracks(found.select(F.col("stack").alias("tile"), "sid", "z", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("radius").alias("r")), p)
    tracks = materialise(tracks, "tracks")
    spans = tracks.groupBy("tile", "tid").agg(F.min("z").alias("z_first"), F.max("z").alias("z_last"), F.count(F.lit(1)).alias("n_slices"))
    spans = spans.join(planes.select(F.col("stack").alias("tile"), "plane"), "tile").where(F.col("z_first") < F.col("plane") - p.substrate_margin).drop("plane")
    own = materialise(tracks.join(spans, ["tile", "tid"]).select("tid", "sid", "z_first", "z_last", "n_slices").join(found, "sid"), "own")
    at_home = frames.band_curve(stack, own.select("stack", F.col("sid").alias("oid"), "xs", "ys", F.col("z").alias("lo"), F.col("z").alias("hi")), o.band_px)
    sharpest = own.join(at_home.select(F.col("oid").alias("sid"), "v"), "sid").groupBy("stack", "tid").agg(F.max_by(F.struct("sid", "z", "xs", "ys"), F.struct("v", -F.col("z"))).alias("d"))
    # A window is numbered by its outline; the curve knows nothing else of the track.
    half = F.greatest(F.lit(6), scalars.half_even(3 * scalars.scales(a)["dof_slices"]).cast("int"))
    swept = materialise(sharpest.select("stack", "tid", F.col("d.sid").alias("oid"), "d.xs", "d.ys", F.greatest(F.lit(0), F.col("d.z") - half).alias("lo"), (F.col("d.z") + half).alias("hi")), "swept")
    curve = frames.band_curve(stack, swept.drop("tid"), o.band_px)
    tops = curves.focal_planes(curve, F.greatest(F.lit(2.0), scalars.scales(a)["dof_slices"]))
    tops = tops.join(swept.select("stack", "tid", "oid"), "oid").select("stack", "tid", "oid", "rank", "refined", "prominence")
    nearest = F.min_by(F.struct("cx", "cy", "radius", "circ", "area", "n_slices", "z_first", "z_last", "xs", "ys"), F.struct(F.abs(F.col("z") - scalars.half_even(F.col("refined"))), "z", "sid"))
    out = tops.join(own, ["stack", "tid"]).groupBy("stack", "oid", "rank", "refined", "prominence").agg(nearest.alias("d")).select("stack", "oid", "rank", "refined", "prominence", "d.*")
    out = with_profile(out, p.n_theta).withColumns({"sid": F.col("oid") * 100 + 50 + F.col("rank"), "x": F.col("cx"), "y": F.col("cy"), "z": F.col("refined"), "r": F.col("radius"), "sharp": F.col("prominence")})
    return out.select(*OBJECT)


def measure(stack: DataFrame, a: Acquisition = Acquisition(), p: Params = Params(), o: FieldOptions = FieldOptions(), segmenter=None) -> DataFrame:
    """Measured objects of each stack, ``oid`` and ``source`` beside the columns of ``OBJECT``; an empty field has none."""
    planes = registration.substrate_plane(profile(stack))
    if o.substrate is not None:
        planes = planes.select("stack", F.lit(o.substrate).alias("plane"), "peak")
    planes = materialise(planes, "planes")
    use = analysed(stack, planes, p)
    edf = projected_objects(use, o, p, a, segmenter) if o.mode in ("edf", "both") else None
    slices = tracked_objects(use, planes, o, p, a, segmenter) if o.mode in ("slices", "both") else None
    if edf is not None and slices is not None:
        both = catalogue.merged_sources(edf, slices)
    else:
        both = (edf if edf is not None else slices).withColumn("source", F.lit(o.mode)).withColumn("prio", F.lit(0))
    both = materialise(both.withColumn("tile", F.col("stack")), "objects")
    kept = matching.greedy_suppression(both, matching.suppression_conflicts(both, scalars.scales(a)["anisotropy"], scalars.scales(a)["dof_slices"], p.max_diameter_px))
    kept = kept.where(F.col("sharp") >= p.min_sharpness)
    return catalogue.numbered(kept.drop("tile", "prio"), ["stack", "z", "x", "sid"], "oid")


def interface_points(stack: DataFrame, sigma: float = 28.0, k: float = 0.8, step: int = 6) -> DataFrame:
    """(stack, x, y, z): outermost crossings of each slice's texture, away from the borders."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for s, z, px, h, w in zip(pdf["stack"], pdf["z"], pdf["px"], pdf["height"], pdf["width"], strict=True):
                t = np.log1p(image.blur(image.tenengrad(np.asarray(px).reshape(h, w)), sigma))
                hot = t > np.median(t) + k * t.std()
                for y in range(0, h, step):
                    xs = np.flatnonzero(hot[y])
                    out += [(s, float(x), float(y), float(z)) for x in ({xs[0], xs[-1]} if len(xs) else ()) if 4 < x < w - 6]
                for x in range(0, w, step):
                    ys = np.flatnonzero(hot[:, x])
                    out += [(s, float(x), float(y), float(z)) for y in ({ys[0], ys[-1]} if len(ys) else ()) if 4 < y < h - 6]
            yield pd.DataFrame(out, columns=["stack", "x", "y", "z"]).astype({"stack": "int32"})

    return stack.mapInPandas(run, "stack int, x double, y double, z double")


def fitted_domes(points: DataFrame, planes: DataFrame, a: Acquisition = Acquisition()) -> DataFrame:
    """One spherical cap for each stack with enough points."""
    schema = "stack int, cx double, cy double, cz double, radius double, residual double, contact double, apex double, radius_sd double"

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        got = kc.cap(rows.sort_values(["z", "y", "x"])[["x", "y", "z"]].to_numpy(), float(rows["plane"].iloc[0]), float(rows["anisotropy"].iloc[0]))
        names = [c.split(" ")[0] for c in schema.split(", ")]
        return pd.DataFrame([(rows["stack"].iloc[0], *got.values())] if got else [], columns=names)

    return points.join(planes.select("stack", F.col("plane").cast("double").alias("plane"), scalars.scales(a)["anisotropy"].alias("anisotropy")), "stack").groupBy("stack").applyInPandas(fit, schema)


def with_droplets(objects: DataFrame, domes: DataFrame, a: Acquisition = Acquisition(), least: float = 0.9) -> DataFrame:
    """Objects plus dome_distance_px and dome_surface_slice by their own stack's cap.

    Null for a stack without a cap, and for one whose cap holds less than ``least`` of its objects.
    """
    own = scalars.scales(a)["anisotropy"]
    at = objects.join(domes.select("stack", F.col("cx").alias("__cx"), F.col("cy").alias("__cy"), F.col("cz").alias("__cz"), F.col("radius").alias("__radius")), "stack", "left")
    dx, dy, dz = F.col("x") - F.col("__cx"), F.col("y") - F.col("__cy"), (F.col("z") - F.col("__cz")) * own
    over = F.col("__radius") * F.col("__radius") - dx * dx - dy * dy
    at = at.withColumns({"__gap": F.col("__radius") - F.sqrt(dx * dx + dy * dy + dz * dz) - F.col("r"), "__over": F.when(over > 0, F.col("__cz") - F.sqrt(F.greatest(over, F.lit(0.0))) / own)})
    good = at.groupBy("stack").agg(F.avg((F.col("__gap") > -0.25 * F.col("r")).cast("double")).alias("__share")).where(F.col("__share") >= least)
    out = at.join(good, "stack", "left")
    kept = F.col("__share").isNotNull()
    return out.select(*objects.columns, F.when(kept, F.col("__gap")).alias("dome_distance_px"), F.when(kept, F.col("__over")).alias("dome_surface_slice"))


def droplets(stack: DataFrame, planes: DataFrame, a: Acquisition = Acquisition(), p: Params = Params(), sigma: float = 28.0) -> DataFrame:
    """One cap for each stack, fitted to the interface that its own slices above the glass show."""
    return fitted_domes(interface_points(analysed(stack, planes, p), sigma), planes, a)
