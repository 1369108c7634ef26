"""A mosaic of fields: geometry, registration, shared glass plane, per-field measurement, one catalogue, features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..kernels import image
from ..operators import catalogue, curves, frames, matching, registration
from ..params import Acquisition, Dome, Params
from ..storage import materialise
from . import features, field


def corrected(stack: DataFrame, gain: DataFrame) -> DataFrame:
    """Frames divided by the flat field's gain."""
    one = gain.agg(F.array_sort(F.collect_list(F.struct("y", "x", "gain"))).alias("c")).select(F.col("c.gain").alias("__gain"))  # one frame's size
    return stack.join(F.broadcast(one)).withColumn("px", F.expr("transform(px, (v, i) -> v / __gain[i])")).drop("__gain")


def _facing(stack: DataFrame, tiles: DataFrame) -> DataFrame:
    """(ta, tb, axis, z) of neighbours with both frames and places, prefixed a_ and b_."""
    side = lambda s: stack.select(F.col("stack").alias(f"t{s}"), "z", *[F.col(c).alias(f"{s}_{c}") for c in ("px", "height", "width")]).join(
        tiles.select(F.col("tile").alias(f"t{s}"), F.col("x0").alias(f"{s}_x"), F.col("y0").alias(f"{s}_y")), f"t{s}"
    )
    return matching.neighbour_pairs(tiles).join(side("a"), "ta").join(side("b"), ["tb", "z"])


def placement(stack: DataFrame, tiles: DataFrame) -> DataFrame:
    """Whether the middle slices of neighbours lie on each other as the layout has it, not mirrored."""
    middle = stack.groupBy("stack").agg(F.floor((F.max("z") + 1) / 2).cast("int").alias("z"))
    both = _facing(stack.join(middle, ["stack", "z"]), tiles)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.a_px).reshape(r.a_height, r.a_width), np.asarray(r.b_px).reshape(r.b_height, r.b_width)
                turn = (lambda m: m) if r.axis == "x" else (lambda m: m.T)  # strips stand upright
                one, two = turn(a), turn(b)
                wide = round(one.shape[1] - (r.b_x - r.a_x if r.axis == "x" else r.b_y - r.a_y))
                if 8 <= wide <= min(one.shape[1], two.shape[1]) and one.shape[0] == two.shape[0]:
                    parts_ = (one[:, -wide:], two[:, :wide], one[:, :wide], two[:, -wide:])
                    out.append((r.ta, r.tb, r.axis, r.z, *[m.reshape(-1) for m in parts_], one.shape[0], wide))
            yield pd.DataFrame(out, columns=["ta", "tb", "axis", "z", "a", "b", "a_far", "b_far", "height", "width"])

    arrays = ", ".join(f"{c} array<double>" for c in ("a", "b", "a_far", "b_far"))
    return registration.placement_peaks(both.mapInPandas(cut, f"ta int, tb int, axis string, z int, {arrays}, height int, width int"))


def strips(stack: DataFrame, tiles: DataFrame, n_planes: int = 9) -> DataFrame:
    """(ta, tb, z, a, b, height, width): the overlapping parts of neighbours on some planes."""
    depth = stack.agg((F.max("z") + 1).alias("d")).first()["d"]
    both = _facing(stack.where(F.col("z").isin(frames.sampled_slices(int(depth), n_planes))), tiles)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.a_px).reshape(r.a_height, r.a_width), np.asarray(r.b_px).reshape(r.b_height, r.b_width)
                dx, dy = int(round(r.b_x - r.a_x)), int(round(r.b_y - r.a_y))
                h, w = min(a.shape[0] - max(dy, 0), b.shape[0] + min(dy, 0)), min(a.shape[1] - max(dx, 0), b.shape[1] + min(dx, 0))
                if min(h, w) < 8:
                    continue
                sa = a[max(dy, 0) : max(dy, 0) + h, max(dx, 0) : max(dx, 0) + w]
                sb = b[max(-dy, 0) : max(-dy, 0) + h, max(-dx, 0) : max(-dx, 0) + w]
                out.append((r.ta, r.tb, r.z, sa.reshape(-1), sb.reshape(-1), h, w))
            yield pd.DataFrame(out, columns=["ta", "tb", "z", "a", "b", "height", "width"])

    return both.mapInPandas(cut, "ta int, tb int, z int, a array<double>, b array<double>, height int, width int")


def registered(stack: DataFrame, tiles: DataFrame, p: Params = Params()) -> tuple[DataFrame, dict[str, float]]:
    """Tiles moved by their measured shifts; unreliable shifts leave the stage's offsets as they are."""
    votes = registration.combined_shifts(registration.pair_shifts(strips(stack, tiles)), p)
    place = lambda s: tiles.select(F.col("tile").alias(f"t{s}"), F.round("x0").alias(f"{s}x"), F.round("y0").alias(f"{s}y"))
    edges = votes.join(place("a"), "ta").join(place("b"), "tb").select("ta", "tb", (F.col("bx") - F.col("ax") + F.col("dx")).alias("dx"), (F.col("by") - F.col("ay") + F.col("dy")).alias("dy"), "confidence")
    offsets, report = registration.solved_offsets(edges, tiles, p)
    if not report["reliable"]:
        return tiles.withColumn("offset_source", F.lit("stage")), report
    moved = tiles.drop("x0", "y0").join(offsets.withColumnsRenamed({"x": "x0", "y": "y0"}), "tile")
    return moved.withColumn("offset_source", F.lit("registered")), report


def sightings(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """Objects of all fields in mosaic coordinates, with their distance to the field's edge (DM15)."""
    at = objects.join(tiles.select("tile", "x0", "y0", "w", "h"), F.col("stack") == F.col("tile"))
    edge = F.least(F.col("x"), F.col("w") - F.col("x"), F.col("y"), F.col("h") - F.col("y"))
    return at.select("tile", F.col("oid").alias("obj"), (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"), "z", "r", "sharp", "profile", edge.alias("edge"))


def rim_rays(stack: DataFrame, cx: float, cy: float, sigma: float = 28.0, k: float = 0.8, n_azimuth: int = 360, dr: float = 3.0, least: float = 24.0) -> DataFrame:
    """(z, azimuth, r): the outermost long enough run of texture on each ray from an axis."""
    need = max(1, int(least / dr))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for z, px, h, w in zip(pdf["z"], pdf["px"], pdf["height"], pdf["width"], strict=True):
                t = np.log1p(image.blur(image.tenengrad(np.asarray(px, dtype=float).reshape(h, w)), sigma))
                radii = np.arange(0, 0.62 * np.hypot(h, w), dr)
                hot = image.polar(t, cx, cy, radii, np.arange(n_azimuth) * 2 * np.pi / n_azimuth) > np.median(t) + k * t.std()
                for az, row in enumerate(hot):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
                    runs = [(s, e) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s >= need]
                    if runs:
                        out.append((z, az, float(radii[runs[-1][1] - 1])))
            yield pd.DataFrame(out, columns=["z", "azimuth", "r"])

    return stack.mapInPandas(run, "z int, azimuth int, r double")


def global_dome(stack: DataFrame, cx: float, cy: float, p: Params = Params(), rounds: int = 3, sigma: float = 28.0) -> tuple[DataFrame, tuple[float, float]]:
    """Rings (z, cx, cy, radius, residual, used) and the axis, refitted until it moves by less than a pixel.

    A scan has one ring for each slice, so the rings come to the driver.
    """
    rings = None
    for _ in range(rounds):
        rays = curves.ray_mad_filter(rim_rays(stack, cx, cy, sigma), 200)
        rings = materialise(curves.huber_circles(rays, 360, cx, cy, p.ring_residual_px), "rings")
        axis = rings.where("used").agg(F.median("cx").alias("x"), F.median("cy").alias("y")).first()
        if axis["x"] is None:
            break
        moved = float(np.hypot(axis["x"] - cx, axis["y"] - cy))
        cx, cy = float(axis["x"]), float(axis["y"])
        if moved < 1:
            break
    return rings, (cx, cy)


def canvas(stack: DataFrame, tiles: DataFrame) -> DataFrame:
    """Frames of the whole mosaic, one for each slice of ``stack``: feathered means of the tiles (F6), 0 where no tile is."""
    low = tiles.agg(F.min("x0").alias("lx"), F.min("y0").alias("ly"))
    at = tiles.join(F.broadcast(low)).select(F.col("tile").alias("stack"), F.round(F.col("x0") - F.col("lx")).cast("int").alias("ox"), F.round(F.col("y0") - F.col("ly")).cast("int").alias("oy"), "w", "h")
    margin = F.greatest(F.lit(1.0), F.least("w", "h") / 4)
    pixels = frames.exploded(stack).join(at, "stack")
    pixels = pixels.select("z", (F.col("x") + F.col("ox")).alias("cx"), (F.col("y") + F.col("oy")).alias("cy"), F.col("value").alias("v"), scalars.feather_weight(F.col("x"), F.col("y"), F.col("w"), F.col("h"), margin).alias("weight"))
    blended = frames.composite(pixels, ["z"])
    return frames.frames_of(_filled(blended).select(F.lit(0).alias("stack"), "z", F.col("cy").alias("y"), F.col("cx").alias("x"), "v"))


def _filled(blended: DataFrame) -> DataFrame:
    """Every cell of each slice's box, 0 where no tile is."""
    box = blended.groupBy("z").agg(F.max("cx").alias("mx"), F.max("cy").alias("my"))
    grid = box.select("z", "mx", F.explode(F.sequence(F.lit(0), F.col("my"))).alias("cy")).select("z", "cy", F.explode(F.sequence(F.lit(0), F.col("mx"))).alias("cx"))
    return grid.join(blended.select("z", "cy", "cx", F.col("v").cast("double").alias("v")), ["z", "cy", "cx"], "left").fillna(0.0, ["v"])


def droplet(stack: DataFrame, tiles: DataFrame, glass: float, a: Acquisition = Acquisition(), p: Params = Params(), z_step: int = 4, margin: int = 8, sigma: float = 28.0) -> tuple[Dome | None, DataFrame | None]:
    """The droplet that the whole scan lies in, and its rings; None where no cap can be fitted.

    Every ``z_step``-th slice up to ``margin`` above the glass is laid out as one canvas.  The axis starts where the
    upper slices have texture and is refitted with the rim around it; four used rings make a cap.  A scan's rings are a
    few dozen rows, its axis and cap one.
    """
    planes = list(range(0, max(4, round(glass) - margin), z_step))
    wide = materialise(canvas(stack.where(F.col("z").isin(planes)), tiles), "canvas")
    if wide.select("z").distinct().count() < 4:
        return None, None
    upper = wide.join(registration.first_planes(wide), ["stack", "z"], "left_semi")
    small = frames.frames_of(registration.block_means(frames.exploded(upper).withColumnRenamed("value", "v")))
    texture = frames.exploded(frames.mapped(small, lambda m: np.log1p(image.blur(image.tenengrad(m), sigma / 4)))).withColumnRenamed("value", "v")
    seed = registration.seed_axis(texture, wide.groupBy("stack").agg(F.max("width").alias("width"), F.max("height").alias("height"))).first()
    rings, (cx, cy) = global_dome(wide, float(seed["cx"]), float(seed["cy"]), p, sigma=sigma)
    scale = wide.sparkSession.range(1).select(scalars.scales(a)["anisotropy"]).first()[0]
    cap = curves.cap_fit(rings.where("used"), scale).first()
    if cap is None or cap["cz"] is None or cap["sphere_radius"] is None or not cap["sphere_radius"] > 0:
        return None, rings
    low = tiles.agg(F.min("x0"), F.min("y0")).first()  # the canvas starts at the least offsets
    return Dome(cx + low[0], cy + low[1], cap["cz"] / scale, cap["sphere_radius"], float(glass), scale), rings


def flat_fielded(stack: DataFrame, n_planes: int = 7, sigma: float = 40.0) -> DataFrame:
    """Frames without the light's fixed pattern: divided by the smoothed median over all tiles on some planes."""
    depth = int(stack.agg(F.max("z")).first()[0]) + 1
    some = frames.exploded(stack.where(F.col("z").isin(frames.sampled_slices(depth, n_planes)))).withColumnRenamed("value", "v")
    return corrected(stack, frames.flat_field(some, sigma))


def run(
    stack: DataFrame, tiles: DataFrame, a: Acquisition = Acquisition(), p: Params = Params(), o: field.FieldOptions = field.FieldOptions(), segmenter=None,
    flat: bool = True, sigma: float = 28.0,
) -> dict[str, DataFrame | Dome | None]:
    """Catalogue, views, seams, droplet and feature matrix of a mosaic.

    ``flat`` takes the light's pattern out of the frames first; ``sigma`` smooths the texture that the droplet's rim is
    traced on.  A droplet that holds less than nine tenths of the objects is dropped (D17): its columns are null then.
    """
    if flat:
        stack = materialise(flat_fielded(stack), "flat")
    placed, _ = registered(stack, tiles, p)
    placed = materialise(placed, "tiles")
    profile = materialise(field.profile(stack), "profile")
    depth = int(profile.agg(F.max("z")).first()[0]) + 1
    glass = float(registration.glass_consensus(registration.glass_votes(profile, p), depth).first()["slice"])
    objects = materialise(field.measure(stack, a, p, replace(o, substrate=glass), segmenter), "measured")
    seen = materialise(matching.with_clipped(catalogue.with_sid(sightings(objects, placed)), p), "sightings")
    pairs = materialise(catalogue.matched(seen, placed, p, a), "matches")
    grouped = catalogue.with_components(seen, pairs)
    merged = materialise(catalogue.catalogue(grouped, placed, p), "catalogue")
    dome, rings = droplet(stack, placed, glass, a, p, sigma=sigma)
    if dome is not None and not catalogue.enclosed(merged, dome).first()["reliable"]:
        dome = None
    return {
        "objects": objects, "catalogue": merged, "views": catalogue.views_long(grouped), "seams": catalogue.seam_report(seen, placed, pairs, p),
        "features": features.matrix(merged, features.record(objects, a, None, p), stack, placed, a, dome, glass, p.n_theta), "tiles": placed, "dome": dome, "rings": rings,
    }
