"""Column expressions: scales, geometry, rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import Acquisition, Dome, Params

PI = math.pi


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def _scales(px: Column, z: Column, na: Column, a: Acquisition) -> dict[str, Column]:
    both = px.isNotNull() & z.isNotNull()
    depth = F.lit(a.wavelength_um) / (na * na) + px / na
    return {
        "calibrated": both,
        "anisotropy": F.when(both, z / px).otherwise(F.lit(a.assumed_anisotropy)),
        "scale_source": F.when(both, "calibration").otherwise("assumed"),
        "dof_um": depth,
        "dof_slices": F.coalesce(depth / z, F.lit(a.assumed_dof_slices)),
    }


def with_scales(df: DataFrame, a: Acquisition = Acquisition()) -> DataFrame:
    """Adds anisotropy with its source, and the depth of field, from ``px_um``, ``z_um`` and ``na``."""
    return df.withColumns(_scales(F.col("px_um"), F.col("z_um"), F.col("na"), a))


def with_calibration(df: DataFrame, **given: float) -> DataFrame:
    """Recorded scales overridden by a user's: px_um, z_um or na; ``px_source`` and ``z_source`` then say ``user`` (L)."""
    if unknown := set(given) - {"px_um", "z_um", "na"}:
        raise ValueError(f"no such scales: {sorted(unknown)}")
    named = {c: F.lit("user") for c, of in (("px_source", "px_um"), ("z_source", "z_um")) if of in given}
    return df.withColumns({k: F.lit(v).cast("double") for k, v in given.items()} | named)


def scales(a: Acquisition) -> dict[str, Column]:
    """The same of one acquisition, as constants."""
    return _scales(*[F.lit(v).cast("double") for v in (a.px_um, a.z_um, a.na)], a)


def assembled(df: DataFrame, p: Params = Params()) -> DataFrame:
    """Radius, axes, volume and best slice of each object (C10); micrometres only where calibrated."""
    out = (
        df.withColumn("diameter_px", 2 * F.col("r"))
        .withColumn("rz_slices", F.col("r") * p.axial_ratio / F.col("anisotropy"))
        .withColumn("volume_px3", F.lit(4 / 3 * PI) * F.col("r") * F.col("r") * F.col("rz_slices"))
        .withColumn("best_slice", half_even(F.col("z")).cast("int"))
    )
    um = F.when(F.col("calibrated"), F.col("px_um"))
    return (
        out.withColumn("diameter_um", F.col("diameter_px") * um)
        .withColumn("z_position_um", F.col("z") * F.when(F.col("calibrated"), F.col("z_um")))
        .withColumn("volume_um3", F.col("volume_px3") * um * um * F.when(F.col("calibrated"), F.col("z_um")))
    )


def tile_index(name: Column) -> Column:
    """Digits of a tile name's last ``_`` part, else 0 (C4)."""
    digits = F.regexp_replace(F.element_at(F.split(name, "_"), -1), "[^0-9]", "")
    return F.when(digits == "", 0).otherwise(digits.cast("int"))


def edge_distance(x: Column, y: Column) -> Column:
    """Distance to the nearest edge of the tile in scope, negative outside."""
    return F.least(x - F.col("x0"), F.col("x0") + F.col("w") - x, y - F.col("y0"), F.col("y0") + F.col("h") - y)


def inside_tile(x: Column, y: Column, margin: float = 0.0) -> Column:
    """Whether a point lies in the tile in scope, borders included."""
    return x.between(F.col("x0") - margin, F.col("x0") + F.col("w") + margin) & y.between(F.col("y0") - margin, F.col("y0") + F.col("h") + margin)


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P**2, 1 where there is no perimeter."""
    return F.when(perimeter == 0, F.lit(1.0)).otherwise(F.lit(4 * PI) * area / (perimeter * perimeter))


def optical_density(v: Column, background: Column, dark: float = 0.0) -> Column:
    """-ln of clipped transmission."""
    t = (v - dark) / F.greatest(background - dark, F.lit(1e-6))
    return -F.log(F.least(F.greatest(t, F.lit(1 / 255)), F.lit(4.0)))


def grey_level(od: Column, low: float = -0.3, high: float = 2.0, levels: int = 16) -> Column:
    """Quantised optical density, truncated."""
    share = F.least(F.greatest((od - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return F.floor(share * (levels - 1)).cast("int")


def dome_distance(d: Dome, x: Column, y: Column, z: Column) -> Column:
    """Depth below the cap's surface, negative outside."""
    dx, dy, dz = x - d.cx, y - d.cy, (z - d.cz) * d.anisotropy
    return F.lit(d.radius) - F.sqrt(dx * dx + dy * dy + dz * dz)


def dome_surface(d: Dome, x: Column, y: Column) -> Column:
    """The slice at which the cap stands over a point; null beside the sphere."""
    left = F.lit(d.radius**2) - ((x - d.cx) * (x - d.cx) + (y - d.cy) * (y - d.cy))
    return F.when(left > 0, F.lit(d.cz) - F.sqrt(left) / d.anisotropy)


def cap_volume(contact: Column, height: Column) -> Column:
    """pi h / 6 (3 a**2 + h**2)."""
    return F.lit(PI / 6) * height * (3 * contact * contact + height * height)


def with_region_widths(df: DataFrame) -> DataFrame:
    """Widths of rim, guard and halo around an outline of radius ``r`` (C17)."""
    r = F.col("r")
    return df.withColumns({"rim_px": F.greatest(F.lit(3.0), 0.2 * r), "guard_px": F.greatest(F.lit(2.0), 0.05 * r), "halo_inner_px": 0.5 * r, "halo_outer_px": 1.2 * r})


def with_spatial_features(df: DataFrame, d: Dome = Dome()) -> DataFrame:
    """Position in the droplet: clearances, azimuth, nearest border and which it is.

    Outside the contact circle the glass border is the depth to the glass alone.
    """
    x, y, z, r = F.col("x"), F.col("y"), F.col("z"), F.col("r")
    radial = F.sqrt((x - d.cx) * (x - d.cx) + (y - d.cy) * (y - d.cy))
    out = (
        df.withColumn("dome_radial_px", radial)
        .withColumn("dome_azimuth_deg", F.pmod(F.degrees(F.atan2(y - d.cy, x - d.cx)), F.lit(360.0)))
        .withColumn("dome_radial_frac", radial / d.contact_radius)
        .withColumn("height_above_glass_slices", F.lit(d.glass) - z)
        .withColumn("dome_distance_px", dome_distance(d, x, y, z) - r)
    )
    lateral, depth = F.lit(d.contact_radius) - F.col("dome_radial_px"), F.abs(F.col("height_above_glass_slices") * d.anisotropy)
    out = out.withColumn("contact_edge_distance_px", F.when(lateral < 0, depth - r).otherwise(lateral - r))
    return out.withColumn("nearest_border_is_cap", (F.col("dome_distance_px") <= F.col("contact_edge_distance_px")).cast("double")).withColumn(
        "nearest_border_px", F.least("dome_distance_px", "contact_edge_distance_px")
    )


def cross_section_scale(dz: Column, rz: Column) -> Column:
    """Radius of a spheroid's cut at ``dz`` against its own, null beyond it."""
    return F.when(F.abs(dz) < rz, F.sqrt(F.greatest(F.lit(1.0) - (dz / rz) * (dz / rz), F.lit(0.0))))


def feather_weight(x: Column, y: Column, w: Column, h: Column, margin: Column) -> Column:
    """Product of linear ramps from each edge, at least a thousandth (C20)."""
    ramp = lambda i, n: F.least(F.lit(1.0), (i + 0.5) / margin, (n - i - 0.5) / margin)
    return F.greatest(ramp(x, w) * ramp(y, h), F.lit(1e-3))
