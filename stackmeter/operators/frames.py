"""Frames as rows ``(stack, z, height, width, px)``: focus measures, depth projections, composites.

Pixels cross from the JVM to numpy once, as one array a frame.  Depth projections keep
a running maximum for each stack, so a task needs the memory of one frame whatever the
number of slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import image

FRAME = "stack int, z int, height int, width int, px array<double>"


def frames_of(pixels: DataFrame) -> DataFrame:
    """Frames from exploded pixels (stack, z, y, x, v)."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    grouped = pixels.groupBy("stack", "z").agg(cells.alias("c"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))
    return grouped.select("stack", "z", "height", "width", F.col("c.v").alias("px"))


def _arrays(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    for px, h, w in zip(pdf["px"], pdf["height"], pdf["width"], strict=True):
        yield np.asarray(px, dtype=np.float64).reshape(h, w)


def mapped(frames: DataFrame, kernel, name: str = "px") -> DataFrame:
    """Every frame through a kernel of the same shape."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(**{name: [kernel(a).reshape(-1) for a in _arrays(pdf)]})[["stack", "z", "height", "width", name]]

    return frames.mapInPandas(run, FRAME.replace("px array", f"{name} array"))


def exploded(frames: DataFrame, name: str = "px") -> DataFrame:
    """(stack, z, y, x, value) of frames."""
    return frames.select("stack", "z", "width", F.posexplode(name).alias("at", "value")).select(
        "stack", "z", F.expr("at div width").cast("int").alias("y"), (F.col("at") % F.col("width")).cast("int").alias("x"), "value"
    )


def focus_measures(frames: DataFrame) -> DataFrame:
    """(stack, z, tenengrad, laplacian): the mean of either measure over each frame."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            arrays = list(_arrays(pdf))
            yield pd.DataFrame({"stack": pdf["stack"], "z": pdf["z"], "tenengrad": [image.tenengrad(a).mean() for a in arrays], "laplacian": [image.abs_laplacian(a).mean() for a in arrays]})

    return frames.mapInPandas(run, "stack int, z int, tenengrad double, laplacian double")


def focus_stacked(frames: DataFrame, sigma: float = 0.0, z_step: int = 1) -> DataFrame:
    """(stack, height, width, edf, best_z, peak): per pixel the value of its sharpest slice, the first of equals.

    Sharpness is rounded to 6 digits, so that both the choice and the ties are the same on every machine.
    """
    schema = "stack int, height int, width int, edf array<double>, best_z array<int>, peak array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack, peak, value, best, shape = None, None, None, None, (0, 0)

        def row() -> pd.DataFrame:
            return pd.DataFrame({"stack": [stack], "height": [shape[0]], "width": [shape[1]], "edf": [value.reshape(-1)], "best_z": [best.reshape(-1)], "peak": [peak.reshape(-1)]})

        for pdf in parts:
            for s, z, a in zip(pdf["stack"], pdf["z"], _arrays(pdf), strict=True):
                sharp = np.round(image.blur(image.tenengrad(a), sigma), 6)
                if s != stack:
                    if stack is not None:
                        yield row()
                    stack, shape, peak, value, best = s, a.shape, sharp, a, np.full(a.shape, z, dtype=np.int32)
                    continue
                new = sharp > peak
                peak, value, best = np.where(new, sharp, peak), np.where(new, a, value), np.where(new, z, best).astype(np.int32)
        if stack is not None:
            yield row()

    wanted = frames.where(F.col("z") % z_step == 0) if z_step > 1 else frames
    return wanted.repartition("stack").sortWithinPartitions("stack", "z").mapInPandas(run, schema)


def band_curve(frames: DataFrame, outlines: DataFrame, width: int = 4) -> DataFrame:
    """(oid, z, v): mean absolute Laplacian in the band around each outline, slice by slice.

    The Laplacian is taken on the band's own box, so its border is mirrored there.  Outlines
    (oid, stack, xs, ys) of a stack are few against its pixels and travel to the frames; with
    ``lo`` and ``hi`` an outline goes to the slices of that window only (G16).
    """
    keys = ["stack"]
    if {"lo", "hi"} <= set(outlines.columns):
        keys, outlines = ["stack", "z"], outlines.where("lo <= hi").withColumn("z", F.explode(F.sequence("lo", "hi")))
    held = outlines.groupBy(*keys).agg(F.collect_list(F.struct("oid", "xs", "ys")).alias("outlines"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for z, a, items in zip(pdf["z"], _arrays(pdf), pdf["outlines"], strict=True):
                for o in items:
                    mask = image.band(image.polygon(np.asarray(o["xs"]), np.asarray(o["ys"]), a.shape), width)
                    if not mask.any():
                        continue
                    ys, xs = np.nonzero(mask)
                    box = slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1)
                    if min(a[box].shape) < 2:
                        continue
                    out.append((o["oid"], z, float(image.abs_laplacian(a[box])[mask[box]].mean())))
            yield pd.DataFrame(out, columns=["oid", "z", "v"]).astype({"oid": "int64", "z": "int32", "v": "float64"})

    return frames.join(held, keys).mapInPandas(run, "oid long, z int, v double")


def flat_field(pixels: DataFrame, sigma: float = 0.0) -> DataFrame:
    """(y, x, gain): per-pixel median over frames, over its own mean, clipped to .2 .. 5."""
    med = pixels.groupBy("y", "x").agg(F.median("v").alias("m"))
    if sigma:
        whole = med.select(F.lit(0).alias("stack"), F.lit(0).alias("z"), "y", "x", F.col("m").alias("v"))
        med = exploded(mapped(frames_of(whole), lambda a: image.blur(a, sigma))).select("y", "x", F.col("value").alias("m"))
    mean = med.agg(F.avg("m").alias("mean"))  # one row
    gain = F.least(F.greatest(F.col("m") / F.col("mean"), F.lit(0.2)), F.lit(5.0))
    return med.join(F.broadcast(mean)).select("y", "x", gain.alias("gain"))


def sampled_slices(depth: int, n: int = 7) -> list[int]:
    """Evenly spaced slices, half-even, without repeats."""
    return sorted({int(v) for v in np.rint(np.linspace(0, depth - 1, n))})


def sampled(depths: DataFrame, depth: str, n: int = 7) -> DataFrame:
    """``depths`` with a row for each of its evenly spaced slices ``z``, half-even, without repeats."""
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col(depth) - 1) / float(n - 1), 0).cast("int"))
    return depths.withColumn("z", F.explode(F.array_distinct(places)))


def composite(tile_pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(cx, cy, v, n): feathered weighted mean on the canvas, truncated to 0 .. 255, and the coverage.

    ``tile_pixels`` has (cx, cy, v, weight); means come from two partial sums.  ``by`` names
    columns with a canvas for each of their values, which lead the result.
    """
    by = by or []
    out = tile_pixels.groupBy(*by, "cx", "cy").agg(F.sum(F.col("weight") * F.col("v")).alias("s"), F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    mean = F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.lit(0.0))
    return out.select(*by, "cx", "cy", F.floor(F.least(F.greatest(F.round(mean, 6), F.lit(0.0)), F.lit(255.0))).cast("int").alias("v"), "n")


def max_composite(tile_pixels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(cx, cy, v): brightest value over each canvas cell (F8), of each value of ``by``."""
    return tile_pixels.groupBy(*(by or []), "cx", "cy").agg(F.max("v").alias("v"))


def segmented(frames: DataFrame, segmenter=None, min_area: int = 30) -> DataFrame:
    """(stack, z, label, cx, cy, area, radius, circ, xs, ys): detections of each frame.

    ``segmenter(frame) -> labels`` is pluggable; an exception there falls back to the built-in one.
    """
    schema = "stack int, z int, label int, cx double, cy double, area double, radius double, circ double, xs array<double>, ys array<double>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for s, z, a in zip(pdf["stack"], pdf["z"], _arrays(pdf), strict=True):
                try:
                    labels = segmenter(a) if segmenter else image.segment(a, min_area)
                except Exception:  # noqa: BLE001  a foreign detector may fail in any way
                    labels = image.segment(a, min_area)
                out += [(s, z, *d) for d in detections(labels)]
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return frames.mapInPandas(run, schema)


def detections(labels: np.ndarray, n_theta: int = 64) -> list[tuple]:
    """(label, cx, cy, area, radius, circularity, contour) of each labelled region.

    The contour has a point for each two cells of the edge, ``n_theta`` at most.
    """
    most = n_theta
    out = []
    for k in range(1, int(labels.max()) + 1):
        ys, xs = np.nonzero(labels == k)
        if len(xs) < 8:
            continue
        cx, cy, area = xs.mean(), ys.mean(), float(len(xs))
        n_theta = int(np.clip(round(np.pi * np.sqrt(area / np.pi)), 8, most))
        angle = np.floor((np.arctan2(ys - cy, xs - cx) % (2 * np.pi)) / (2 * np.pi) * n_theta).astype(int) % n_theta
        reach = np.zeros(n_theta)
        np.maximum.at(reach, angle, np.hypot(ys - cy, xs - cx))
        use = np.flatnonzero(reach > 0)
        theta = (use + 0.5) * 2 * np.pi / n_theta
        px, py = cx + reach[use] * np.cos(theta), cy + reach[use] * np.sin(theta)
        x2, y2 = np.roll(px, -1), np.roll(py, -1)
        perimeter, inner = float(np.hypot(x2 - px, y2 - py).sum()), float(abs((px * y2 - x2 * py).sum()) / 2)
        circ = 1.0 if perimeter == 0 else 4 * np.pi * inner / perimeter**2
        out.append((k, float(cx), float(cy), area, float(np.sqrt(area / np.pi)), float(circ), px.tolist(), py.tolist()))
    return out
