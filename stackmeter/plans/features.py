"""The feature matrix: every column that the catalogue, the measured record, the outline, the pixels, the droplet and the neighbours give an object.

One row for each object of a catalogue; a value that could not be measured is null, and the blocks it belongs to are
named.  Outline, droplet and neighbour blocks are DataFrame expressions by ``uid``.  Pixels go to numpy once: objects
travel to the frame that their elected view stands on, and a frame's objects are measured on it together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..kernels import appearance
from ..operators import curves, matching
from ..params import Acquisition, Dome, Params

# The columns of the matrix by block, as results are exchanged under these names.
RECORD = (
    "oid x_px y_px z_slice best_slice radius_px diameter_px radius_z_slices area_px2 volume_voxels circularity focus_sharpness n_slices z_extent_slices source "
    "radial_profile_px dome_distance_px dome_surface_slice x_um y_um z_um radius_um diameter_um radius_z_um area_um2 volume_um3 dome_distance_um radial_profile_um"
).split()
IDENTITY = (
    "uid tile tile_row tile_col x_mosaic_px y_mosaic_px n_views views coverage_k lateral_spread_px axial_spread_slices radius_ratio clipped clipped_everywhere "
    "single_view_in_overlap radius_disagreement same_tile_twice guarantee_void"
).split()
MORPHOLOGY = [
    *"outline_area_px2 outline_perimeter_px radius_mean_px radius_std_px radius_cv radius_min_over_max".split(),
    *[f"harmonic_{k}" for k in range(1, 7)], "harmonic_high", "solidity", "convexity", "shape_suspect",
]
HULL = MORPHOLOGY[-3:]
SPATIAL = "height_above_glass_slices dome_radial_px dome_azimuth_deg dome_radial_frac contact_edge_distance_px nearest_border_is_cap nearest_border_px".split()
NEIGHBOURS = 5


def neighbourhood(k: int = NEIGHBOURS) -> list[str]:
    return ["nn_distance_px", "nn_gap_px", "n_within_5r", f"mean_distance_{k}nn_px"]


def columns(k: int = NEIGHBOURS) -> list[str]:
    """All columns of the matrix, identity first."""
    return [*IDENTITY, *RECORD, *MORPHOLOGY, *appearance.INTENSITY, *appearance.TEXTURE, *appearance.QUALITY, "missing_blocks", *SPATIAL, *neighbourhood(k)]


def record(objects: DataFrame, a: Acquisition = Acquisition(), dome: Dome | None = None, p: Params = Params()) -> DataFrame:
    """``stack`` and the columns of ``RECORD`` (B1, C10, C11, C14, C23): measures in pixels and slices, in micrometres only if calibrated, the droplet only if there is one.

    ``objects`` has stack, oid, x, y, z, r, sharp, circ, area, n_slices, z_first, z_last, source, profile, in mosaic or
    tile coordinates; the droplet's are the same.
    """
    own = scalars.scales(a)
    px, um = F.when(own["calibrated"], F.lit(a.px_um).cast("double")), F.when(own["calibrated"], F.lit(a.z_um).cast("double"))
    r, depth = F.col("r"), F.col("r") * p.axial_ratio / own["anisotropy"]
    none = F.lit(None).cast("double")
    gap = none if dome is None else scalars.dome_distance(dome, F.col("x"), F.col("y"), F.col("z")) - r
    surface = none if dome is None else scalars.dome_surface(dome, F.col("x"), F.col("y"))
    values: dict[str, Column] = {
        "oid": F.col("oid"), "x_px": F.col("x"), "y_px": F.col("y"), "z_slice": F.col("z"), "best_slice": scalars.half_even(F.col("z")).cast("int"), "radius_px": r, "diameter_px": 2 * r,
        "radius_z_slices": depth, "area_px2": F.col("area"), "volume_voxels": F.lit(4 / 3 * scalars.PI) * r * r * depth, "circularity": F.col("circ"), "focus_sharpness": F.col("sharp"),
        "n_slices": F.col("n_slices"), "z_extent_slices": F.array("z_first", "z_last"), "source": F.col("source"), "radial_profile_px": F.col("profile"), "dome_distance_px": gap, "dome_surface_slice": surface,
        "x_um": F.col("x") * px, "y_um": F.col("y") * px, "z_um": F.col("z") * um, "radius_um": r * px, "diameter_um": 2 * r * px, "radius_z_um": depth * um, "area_um2": F.col("area") * px * px,
        "volume_um3": F.lit(4 / 3 * scalars.PI) * r * r * px * px * depth * um, "dome_distance_um": gap * px, "radial_profile_um": F.when(px.isNotNull(), F.transform("profile", lambda v: v * px)),
    }
    return objects.select("stack", *[values[c].alias(c) for c in RECORD])


def rounded_record(df: DataFrame) -> DataFrame:
    """Records as they are written: numbers to four places, outlines to three, half-even."""
    kinds = dict(df.dtypes)
    return df.select(*[F.bround(c, 4).alias(c) if kinds[c] == "double" else F.transform(c, lambda v: F.bround(v, 3)).alias(c) if kinds[c] == "array<double>" else F.col(c) for c in df.columns])


def morphology(outlines: DataFrame, n: int, hulls: bool = True) -> DataFrame:
    """``uid`` and the columns of ``MORPHOLOGY`` and circularity of outlines (uid, profile) of ``n`` radii (I12 - I14, D14); no row for an outline that has none.

    Without ``hulls`` the columns of ``HULL`` are left out.
    """
    usable = F.size("profile") == n
    fine = outlines.where(usable & (n >= 8) & F.forall("profile", lambda v: v.isNotNull() & ~F.isnan(v)) & (F.aggregate("profile", F.lit(0.0), lambda s, v: s + v) > 0))
    points = fine.select(F.col("uid").alias("oid"), F.posexplode("profile").alias("k", "r"))
    found = curves.outline_morphology(points, n).join(curves.harmonics(points, n), "oid")
    if hulls:
        found = found.join(curves.hull_shape(points, n), "oid", "left")
    return found.select(F.col("oid").alias("uid"), "circularity", *[c for c in MORPHOLOGY if hulls or c not in HULL])


def halo_discs(elected: DataFrame, widest: float) -> DataFrame:
    """(uid, near): the other objects within 3 r + 40 px of one, depth ignored, relative to it (E8).  ``widest`` is the largest radius."""
    dx, dy = F.col("b_x") - F.col("a_x"), F.col("b_y") - F.col("a_y")
    apart = F.sqrt(dx * dx + dy * dy)
    close = matching.near_pairs(elected.select("uid", "x", "y", "r"), (apart > 0) & (apart < 3 * F.col("a_r") + 40), 3 * widest + 40, "uid")
    return close.groupBy(F.col("a_uid").alias("uid")).agg(F.array_sort(F.collect_list(F.struct(dx.alias("dx"), dy.alias("dy"), F.col("b_r").alias("r")))).alias("near"))


def pixels(elected: DataFrame, frames: DataFrame, tiles: DataFrame) -> DataFrame:
    """``uid``, ``blocks`` (those that are missing) and the columns of ``QUALITY``, ``INTENSITY`` and ``TEXTURE``.

    ``elected`` has uid, tile, x, y, z, r, profile; an object above or below the stack is measured on the last frame
    there is.  An object whose frame is absent has no row.
    """
    widest = elected.agg(F.max("r")).first()[0] or 0.0
    depth = frames.groupBy("stack").agg(F.min("z").alias("first"), F.max("z").alias("last"))
    placed = elected.join(tiles.select("tile", "x0", "y0"), "tile").join(halo_discs(elected, widest), "uid", "left").join(depth, F.col("tile") == F.col("stack"))
    z = F.least(F.greatest(scalars.half_even(F.col("z")).cast("int"), F.col("first")), F.col("last"))
    local = placed.select("stack", z.alias("z"), F.struct("uid", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "r", "profile", "near").alias("item"))
    grouped = local.groupBy("stack", "z").agg(F.collect_list("item").alias("items"))  # what one frame shows
    names = [*appearance.QUALITY, *appearance.INTENSITY, *appearance.TEXTURE]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for px, h, w, items in zip(pdf["px"], pdf["height"], pdf["width"], pdf["items"], strict=True):
                frame = np.asarray(px, dtype=np.float64).reshape(h, w)
                for i in items:
                    near = [(n["dx"], n["dy"], n["r"]) for n in (i["near"] if i["near"] is not None else ())]
                    values, missing = appearance.measured(frame, i["x"], i["y"], i["r"], np.asarray(i["profile"], dtype=np.float64), near)
                    out.append((i["uid"], missing, *[float(v) if (v := values.get(n)) is not None and v == v else None for n in names]))
            yield pd.DataFrame(out, columns=["uid", "blocks", *names]).astype({n: "float64" for n in names})

    schema = "uid long, blocks array<string>, " + ", ".join(f"{n} double" for n in names)
    measured = frames.join(grouped, ["stack", "z"]).mapInPandas(run, schema)
    return measured.select("uid", "blocks", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def matrix(catalogue: DataFrame, records: DataFrame, frames: DataFrame, tiles: DataFrame, a: Acquisition = Acquisition(), dome: Dome | None = None, glass: float | None = None, n_theta: int = 48, only: list[str] | None = None) -> DataFrame:
    """All of ``columns()``, or those of ``only``, for each object of ``catalogue`` (H15); what is not asked for is not measured.

    ``records`` are ``record``'s rows of the elected views' fields.  Where a block measures what the record has too, the
    block counts: circularity by the outline, the droplet's distance at the mosaic's place.  Without a droplet only the
    height above the glass is known.
    """
    total = catalogue.count()
    k = max(1, min(NEIGHBOURS, total - 1))
    names = columns(k) if only is None else only
    asked = lambda *group: not set(names).isdisjoint(group)
    by_pixels = asked("missing_blocks", *appearance.QUALITY, *appearance.INTENSITY, *appearance.TEXTURE)
    elected = catalogue.join(records.select(F.col("stack").alias("tile"), F.col("oid").alias("obj"), F.col("radial_profile_px").alias("profile")), ["tile", "obj"])
    elected = elected.select("uid", "tile", "x", "y", "z", "r", "profile")
    near = matching.knn(elected, NEIGHBOURS, scalars.scales(a)["anisotropy"], key="uid").withColumnRenamed("mean_distance_knn_px", f"mean_distance_{k}nn_px")
    place = catalogue.select("uid", "x", "y", "z", "r")
    if dome is not None:
        place = scalars.with_spatial_features(place, dome)
    else:
        place = place.withColumns({c: F.lit(None).cast("double") for c in [*SPATIAL, "dome_distance_px"]}).withColumn("height_above_glass_slices", F.lit(glass).cast("double") - F.col("z"))
    shape = morphology(elected.select("uid", "profile"), n_theta, asked(*HULL)).withColumnRenamed("circularity", "outline_circularity").withColumn("has_shape", F.lit(True))
    grid = tiles.select("tile", F.col("tr").alias("tile_row"), F.col("tc").alias("tile_col"))
    own = records.withColumnsRenamed({"stack": "tile", "circularity": "record_circularity", "dome_distance_px": "record_dome_distance_px"}).withColumn("obj", F.col("oid"))
    out = (
        catalogue.drop("sharp").withColumnsRenamed({"x": "x_mosaic_px", "y": "y_mosaic_px"}).drop("z", "r").join(own, ["tile", "obj"]).join(grid, "tile")
        .join(shape, "uid", "left").join(place.drop("x", "y", "z", "r"), "uid", "left").join(near, "uid", "left")
    )
    if by_pixels:
        out = out.join(pixels(elected, frames, tiles), "uid", "left")
    absent = F.concat(F.when(F.col("has_shape").isNull(), F.array(F.lit("morphology"))).otherwise(F.array().cast("array<string>")), F.coalesce("blocks", F.array(F.lit("intensity"), F.lit("texture"))))
    derived = {
        "circularity": F.coalesce("outline_circularity", "record_circularity"),
        "dome_distance_px": F.coalesce("dome_distance_px", "record_dome_distance_px"),
        "missing_blocks": F.when(F.size(absent) > 0, F.array_join(absent, ";")),
        "appearance_measurable": F.coalesce("appearance_measurable", F.lit(0.0)),
    }
    return out.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in names])
