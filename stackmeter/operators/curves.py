"""Focus curves and outlines: peaks, refinement, shape, textures, robust fits by group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import curves as kc
from ..kernels import image


def _vertex(before: Column, at: Column, after: Column) -> Column:
    """How far the top of the parabola through three neighbours lies from the middle one, at most one; 0 at an end or on a line."""
    bend = before - 2 * at + after
    top = F.when(F.abs(bend) >= 1e-12, 0.5 * (before - after) / bend)
    return F.coalesce(F.least(F.greatest(top, F.lit(-1.0)), F.lit(1.0)), F.lit(0.0))


def subslice_peak(curves: DataFrame) -> DataFrame:
    """(oid, z, v, refined): the first highest slice of each curve and its parabola's place."""
    by_curve = Window.partitionBy("oid").orderBy("z")
    w = curves.withColumn("before", F.lag("v").over(by_curve)).withColumn("after", F.lead("v").over(by_curve))
    best = w.groupBy("oid").agg(F.max_by(F.struct("z", "v", "before", "after"), F.struct("v", -F.col("z"))).alias("p")).select("oid", "p.*")
    return best.select("oid", "z", "v", (F.col("z") + _vertex(F.col("before"), F.col("v"), F.col("after"))).alias("refined"))


def sharpness_ratio(curves: DataFrame) -> DataFrame:
    """(oid, ratio): how far the maximum stands above the median, against itself."""
    return curves.groupBy("oid").agg(F.max("v").alias("m"), F.median("v").alias("d")).select("oid", F.when(F.col("m") > 1e-12, (F.col("m") - F.col("d")) / F.col("m")).alias("ratio"))


def in_focus_count(curves: DataFrame) -> DataFrame:
    """(oid, n): slices with at least half of the maximum."""
    top = F.max("v").over(Window.partitionBy("oid"))
    return curves.withColumn("top", top).groupBy("oid").agg(F.sum((F.col("v") >= 0.5 * F.col("top")).cast("int")).cast("long").alias("n"))


def focal_peaks(curves: DataFrame, share: float = 0.15) -> DataFrame:
    """(oid, z, v, prominence): strict inner maxima that stand out by ``share`` of the range (G9 without a gap)."""
    ordered = curves.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("z", "v"))).alias("c"))
    inner = "filter(if(size(c) > 2, sequence(2, size(c) - 1), cast(array() as array<int>)), i -> element_at(c, i).v > element_at(c, i - 1).v and element_at(c, i).v > element_at(c, i + 1).v)"
    each = ordered.select("oid", "c", F.explode(F.expr(inner)).alias("i"))
    side = "aggregate({0}, struct(true as open, element_at(c, i).v as low), (acc, p) -> if(acc.open and p.v <= element_at(c, i).v, struct(true as open, least(acc.low, p.v) as low), struct(false as open, acc.low as low))).low"
    left, right = side.format("reverse(slice(c, 1, i - 1))"), side.format("slice(c, i + 1, size(c))")
    got = each.select("oid", F.expr("element_at(c, i).z").alias("z"), F.expr("element_at(c, i).v").alias("v"), F.expr(f"element_at(c, i).v - greatest({left}, {right})").alias("prominence"), F.expr("array_max(transform(c, p -> p.v)) - array_min(transform(c, p -> p.v))").alias("range"))
    return got.where(F.col("prominence") >= F.greatest(F.lit(1e-9), share * F.col("range"))).drop("range")


def _per_curve(curves: DataFrame, schema: str, rows, *constants: str) -> DataFrame:
    """``rows(oid, z array, v array, constants of the curve)`` for each curve, as arrays in one pass."""
    held = curves.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("z", "v"))).alias("c"), *[F.first(c).alias(c) for c in constants]).select("oid", F.col("c.z").alias("z"), F.col("c.v").alias("v"), *constants)
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = [r for oid, z, v, *more in zip(pdf["oid"], pdf["z"], pdf["v"], *[pdf[c] for c in constants], strict=True) for r in rows(oid, np.asarray(z), np.asarray(v, dtype=np.float64), *more)]
            yield pd.DataFrame(out, columns=names)

    return held.mapInPandas(run, schema)


def focal_planes(curves: DataFrame, min_gap: Column | float = 3.26) -> DataFrame:
    """(oid, rank, z, prominence, refined): planes of each curve, strongest first."""

    def rows(oid, z, v, gap):
        # A plane is never the first or last slice, so it has both neighbours.
        return [(oid, n, int(z[p]), h, *map(float, v[p - 1 : p + 2])) for n, (p, h) in enumerate(kc.focal_planes(v, gap))]

    found = _per_curve(curves.withColumn("gap", F.lit(min_gap)), "oid long, rank int, z int, prominence double, before double, at double, after double", rows, "gap")
    return found.select("oid", "rank", "z", "prominence", (F.col("z") + _vertex(F.col("before"), F.col("at"), F.col("after"))).alias("refined"))


def _cyclic(c: str, n: str = "n") -> Column:
    return F.coalesce(F.lead(c).over(Window.partitionBy("oid").orderBy("k")), F.first(c).over(Window.partitionBy("oid").orderBy("k")))


def outline_morphology(outlines: DataFrame, n: int = 64) -> DataFrame:
    """Area, perimeter, circularity and radius statistics of outlines r(k)."""
    step = 2 * math.pi / n
    theta = F.col("k") * step
    p = outlines.withColumn("r2", _cyclic("r")).withColumn("px", F.col("r") * F.cos(theta)).withColumn("py", F.col("r") * F.sin(theta))
    p = p.withColumn("qx", _cyclic("px")).withColumn("qy", _cyclic("py"))
    out = p.groupBy("oid").agg(
        (0.5 * math.sin(step) * F.sum(F.col("r") * F.col("r2"))).alias("outline_area_px2"),
        F.sum(F.sqrt(F.pow(F.col("qx") - F.col("px"), 2) + F.pow(F.col("qy") - F.col("py"), 2))).alias("outline_perimeter_px"),
        F.avg("r").alias("radius_mean_px"), F.stddev_pop("r").alias("radius_std_px"),
        (F.min("r") / F.greatest(F.max("r"), F.lit(1e-9))).alias("radius_min_over_max"),
    )
    return out.withColumn("circularity", 4 * math.pi * F.col("outline_area_px2") / F.greatest(F.col("outline_perimeter_px") * F.col("outline_perimeter_px"), F.lit(1e-9))).withColumn("radius_cv", F.col("radius_std_px") / F.col("radius_mean_px"))


def harmonics(outlines: DataFrame, n: int = 64) -> DataFrame:
    """(oid, harmonic_1 .. 6, harmonic_high): Fourier amplitudes of outlines over their mean."""
    ks = F.explode(F.sequence(F.lit(0), F.lit(n // 2))).alias("h")
    angle = F.lit(2 * math.pi / n) * ((F.col("h") * F.col("k")) % n)
    parts = outlines.select("oid", "k", "r", ks).groupBy("oid", "h").agg(F.sum(F.col("r") * F.cos(angle)).alias("re"), F.sum(F.col("r") * F.sin(angle)).alias("im"))
    amp = parts.select("oid", "h", (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n).alias("a"))
    dc = F.greatest(F.max(F.when(F.col("h") == 0, F.col("a"))), F.lit(1e-9))
    return amp.groupBy("oid").agg(*[(F.max(F.when(F.col("h") == k, F.col("a"))) / dc).alias(f"harmonic_{k}") for k in range(1, 7)], (F.sum(F.when(F.col("h") >= 7, F.col("a"))) / dc).alias("harmonic_high"))


def hull_shape(outlines: DataFrame, n: int = 64) -> DataFrame:
    """(oid, solidity, convexity, shape_suspect) against the convex hull; no row for a degenerate outline."""

    def rows(oid, k, r):
        theta = k * 2 * np.pi / n
        x, y = r * np.cos(theta), r * np.sin(theta)
        own = kc.hull(x, y)
        if len(own) < 3:
            return []
        area = 0.5 * float((r * np.roll(r, -1)).sum()) * math.sin(2 * math.pi / n)
        perimeter = kc.polygon_size(x, y)[1]
        hull_area, hull_length = kc.polygon_size(own[:, 0], own[:, 1])
        solidity, cv = area / max(hull_area, 1e-9), float(r.std() / r.mean())
        return [(oid, solidity, hull_length / max(perimeter, 1e-9), float(solidity < 0.93 or cv > 0.22))]

    renamed = outlines.select("oid", F.col("k").alias("z"), F.col("r").alias("v"))
    return _per_curve(renamed, "oid long, solidity double, convexity double, shape_suspect double", rows)


def ray_mad_filter(rays: DataFrame, least: int = 30) -> DataFrame:
    """Rays (z, azimuth, r) within four robust deviations of their slice's median; slices with too few go."""
    med = rays.groupBy("z").agg(F.median("r").alias("med"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    off = rays.join(med.drop("n"), "z").withColumn("dev", F.abs(F.col("r") - F.col("med")))
    mad = off.groupBy("z").agg(F.median("dev").alias("mad"))
    kept = off.join(mad, "z").where(F.col("dev") <= 4 * F.greatest(1.4826 * F.col("mad"), F.lit(3.0)))
    enough = kept.groupBy("z").count().where(F.col("count") >= least).select("z")
    return kept.join(enough, "z", "left_semi").select("z", "azimuth", "r")


def huber_circles(rays: DataFrame, n_azimuth: int = 64, cx: float = 0.0, cy: float = 0.0, limit: float = 30.0) -> DataFrame:
    """(z, cx, cy, radius, residual, used): a robust circle for each slice's rays; used where the median residual is within ``limit``."""

    def rows(z, k, r):
        if len(r) < 3:
            return []
        a = k * 2 * np.pi / n_azimuth
        x, y, radius, residual = kc.circle(cx + r * np.cos(a), cy + r * np.sin(a))
        return [(z, x, y, radius, residual, bool(residual <= limit))]

    renamed = rays.select(F.col("z").cast("long").alias("oid"), F.col("azimuth").alias("z"), F.col("r").alias("v"))
    return _per_curve(renamed, "z long, cx double, cy double, radius double, residual double, used boolean", rows)


def cap_fit(rings: DataFrame, anisotropy: float = 4 * 2.65) -> DataFrame:
    """(cz, radius, rms, n): r**2 + z**2 is a straight line in z for a spherical cap; four rings or nothing."""
    z = F.col("z") * anisotropy
    p = rings.select(z.alias("zz"), (F.col("radius") * F.col("radius") + z * z).alias("q"), F.col("radius"))
    line = p.agg(F.regr_slope("q", "zz").alias("s"), F.regr_intercept("q", "zz").alias("i"), F.count(F.lit(1)).alias("n")).where("n >= 4")
    fit = line.select((F.col("s") / 2).alias("cz"), F.sqrt(F.col("i") + F.col("s") * F.col("s") / 4).alias("sphere"), "n")
    off = p.join(F.broadcast(fit)).select("cz", "sphere", "n", (F.sqrt(F.greatest(F.lit(0.0), F.col("sphere") * F.col("sphere") - (F.col("zz") - F.col("cz")) * (F.col("zz") - F.col("cz")))) - F.col("radius")).alias("e"))
    return off.groupBy("cz", F.col("sphere").alias("sphere_radius"), "n").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"))


def cap_bootstrap(rings: DataFrame, glass: float, anisotropy: float = 4 * 2.65, draws: int = 40, seed: int = 0) -> DataFrame:
    """(n, draws, cz_sd, radius_sd, contact_median, contact_sd, spread_pct): how a cap's fit varies over rings drawn with replacement.

    A draw's picks are digests of (seed, draw, slot), so the result is one on any layout; all draws are fitted in one
    aggregate.  Draws without a radius do not count; under four rings there is no row.  ``glass`` is a slice.
    """
    z = F.col("z") * anisotropy
    ringed = rings.select(z.alias("zz"), (F.col("radius") * F.col("radius") + z * z).alias("q"), F.row_number().over(Window.orderBy("z", "radius")).alias("i"))  # a row a slice
    n = rings.agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    slots = n.select("n", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select("n", "draw", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("slot"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long")
    picked = slots.withColumn("i", (digest % F.col("n") + 1).cast("int")).join(ringed, "i")
    line = picked.groupBy("n", "draw").agg(F.regr_slope("q", "zz").alias("s"), F.regr_intercept("q", "zz").alias("c"))
    square = F.col("c") + F.col("s") * F.col("s") / 4
    fits = line.where(square > 0).select("n", (F.col("s") / 2).alias("cz"), F.sqrt(square).alias("radius"))
    down = F.lit(glass * anisotropy) - F.col("cz")
    fits = fits.withColumn("contact", F.sqrt(F.greatest(F.col("radius") * F.col("radius") - down * down, F.lit(0.0))))
    out = fits.groupBy("n").agg(F.count(F.lit(1)).alias("draws"), F.stddev_pop("cz").alias("cz_sd"), F.stddev_pop("radius").alias("radius_sd"), F.median("contact").alias("contact_median"), F.stddev_pop("contact").alias("contact_sd"))
    return out.withColumn("spread_pct", 100 * F.col("contact_sd") / F.greatest("contact_median", F.lit(1e-9)))


def first_last_crossings(hot: DataFrame, step: int = 1) -> DataFrame:
    """(stack, z, y, x): the first and last hot cell of every row and of every column."""
    rows = hot.where(F.col("y") % step == 0).groupBy("stack", "z", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    cols = hot.where(F.col("x") % step == 0).groupBy("stack", "z", "x").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    return (
        rows.select("stack", "z", "y", F.explode(F.array("a", "b")).alias("x"))
        .union(cols.select("stack", "z", F.explode(F.array("a", "b")).alias("y"), "x"))
        .distinct()
    )


def outer_runs(hot: DataFrame, least: int = 2) -> DataFrame:
    """(stack, z, y, r): the end of the last run of at least ``least`` hot cells along each ray."""
    w = Window.partitionBy("stack", "z", "y").orderBy("x")
    islands = hot.withColumn("g", F.col("x") - F.row_number().over(w)).groupBy("stack", "z", "y", "g").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("r"))
    return islands.where(F.col("n") >= least).groupBy("stack", "z", "y").agg(F.max("r").alias("r"))


def region_stats(pixels: DataFrame, value: str = "od", by: tuple[str, ...] = ("stack", "z")) -> DataFrame:
    """Mean, population deviation, quantiles, biased skew and excess kurtosis, 32-bin entropy; four pixels or nothing."""
    keys = list(by)
    v = F.col(value)
    q = F.percentile(v, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    main = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), q.alias("q"), F.skewness(v).alias("skew"), F.kurtosis(v).alias("kurtosis")).where("n >= 4")
    low, high, bins = -0.3, 2.0, 32
    binned = pixels.where((v >= low) & (v <= high)).withColumn("bin", F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)))
    share = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*keys)))
    entropy = share.groupBy(*keys).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    q_at = lambda i: F.col("q")[i]
    out = main.join(entropy, keys, "left")
    return out.select(*keys, "mean", "std", q_at(0).alias("p10"), q_at(2).alias("median"), q_at(4).alias("p90"), (q_at(3) - q_at(1)).alias("iqr"), "skew", "kurtosis", F.coalesce("entropy", F.lit(0.0)).alias("entropy"))


def core_rim_contrast(pixels: DataFrame, by: tuple[str, ...] = ("stack", "z")) -> DataFrame:
    """Core against rim: difference, ratio, separation and filled share (F10, D13); ``core`` tells the two apart."""
    keys, od = list(by), F.col("od")
    core, rim = F.when(F.col("core"), od), F.when(~F.col("core"), od)
    m = pixels.groupBy(*keys).agg(F.avg(core).alias("cm"), F.avg(rim).alias("rm"), F.var_pop(core).alias("cv"), F.var_pop(rim).alias("rv"), F.avg(od).alias("body"))
    fill = pixels.where("core").join(m.select(*keys, "rm"), keys).groupBy(*keys).agg(F.avg((od > 0.5 * F.col("rm")).cast("double")).alias("core_fill_fraction"))
    return m.join(fill, keys).select(
        *keys, (F.col("rm") - F.col("cm")).alias("rim_minus_core_od"), F.when(F.abs("rm") > 1e-6, F.col("cm") / F.col("rm")).alias("core_over_rim_od"),
        ((F.col("rm") - F.col("cm")) / (F.sqrt(0.5 * (F.col("cv") + F.col("rv"))) + 1e-9)).alias("core_rim_separation"), "core_fill_fraction",
        (F.col("body") < 0.06).cast("double").alias("outline_empty"),
    )


def glcm(pixels: DataFrame, distance: int = 1, by: tuple[str, ...] = ("stack", "z")) -> DataFrame:
    """Co-occurrence contrast, dissimilarity, homogeneity, energy and correlation over four angles.

    ``pixels`` has y, x and a grey level ``g``; level 0 is dropped; a group without pairs at some angle has no row.
    """
    keys = list(by)
    offsets = [(int(round(distance * math.sin(a * math.pi / 4))), int(round(distance * math.cos(a * math.pi / 4)))) for a in range(4)]
    held = pixels.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * 4096 + F.col("x")).alias("k"), F.col("g").alias("g")))).alias("m"))
    shifts = F.array(*[F.struct(F.lit(n).alias("angle"), F.lit(dy * 4096 + dx).alias("d")) for n, (dy, dx) in enumerate(offsets)])
    cells = held.select(*keys, "m", F.explode(shifts).alias("s")).select(*keys, "m", "s.angle", "s.d")
    pairs = cells.select(*keys, "angle", F.explode(F.expr("transform(filter(map_entries(m), e -> e.value > 0 and coalesce(m[e.key + d], 0) > 0), e -> struct(e.value as i, m[e.key + d] as j))")).alias("p")).select(*keys, "angle", "p.i", "p.j")
    both = pairs.union(pairs.select(*keys, "angle", F.col("j").alias("i"), F.col("i").alias("j")))
    counted = both.groupBy(*keys, "angle", "i", "j").agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys, "angle"))
    d = F.col("i") - F.col("j")
    i, j = F.col("i"), F.col("j")
    per_angle = counted.withColumn("p", p).groupBy(*keys, "angle").agg(
        F.sum(F.col("p") * d * d).alias("contrast"), F.sum(F.col("p") * F.abs(d)).alias("dissimilarity"), F.sum(F.col("p") / (1 + d * d)).alias("homogeneity"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("energy"),
        F.sum(F.col("p") * i).alias("mi"), F.sum(F.col("p") * i * i).alias("mii"), F.sum(F.col("p") * i * j).alias("mij"),
    )
    # Pairs count both ways, so rows and columns have the same mean and variance.
    var = F.col("mii") - F.col("mi") * F.col("mi")
    per_angle = per_angle.withColumn("correlation", F.when(var < 1e-12, F.lit(1.0)).otherwise((F.col("mij") - F.col("mi") * F.col("mi")) / F.when(var >= 1e-12, var)))
    names = ["contrast", "dissimilarity", "homogeneity", "energy", "correlation"]
    return per_angle.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names]).where("n = 4").select(*keys, *names)


def lbp_histogram(frames: DataFrame) -> DataFrame:
    """(stack, z, bin, share): ten bins of uniform local binary patterns of each frame."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for s, z, px, h, w in zip(pdf["stack"], pdf["z"], pdf["px"], pdf["height"], pdf["width"], strict=True):
                codes = image.local_binary(np.asarray(px, dtype=np.float64).reshape(h, w)).astype(int)
                share = np.bincount(codes.reshape(-1), minlength=10) / codes.size
                out += [(s, z, b, float(x)) for b, x in enumerate(share)]
            yield pd.DataFrame(out, columns=["stack", "z", "bin", "share"])

    return frames.mapInPandas(run, "stack int, z int, bin int, share double")


def gradient_stats(pixels: DataFrame, value: str = "od", by: tuple[str, ...] = ("stack", "z")) -> DataFrame:
    """Central-difference gradient magnitude in core and rim."""
    keys = list(by)
    along = lambda c, o: Window.partitionBy(*keys, c).orderBy(o)

    def slope(w: Window) -> Column:
        v, before, after = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
        return F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2)

    g = pixels.withColumn("gx", slope(along("y", "x"))).withColumn("gy", slope(along("x", "y"))).withColumn("m", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    core, rim = F.when(F.col("core"), F.col("m")), F.when(~F.col("core"), F.col("m"))
    out = g.groupBy(*keys).agg(F.avg(core).alias("core_grad_mean"), F.percentile(core, F.lit(0.9)).alias("core_grad_p90"), F.avg(rim).alias("rim_grad_mean"))
    return out.withColumn("rim_over_core_grad", F.col("rim_grad_mean") / F.greatest("core_grad_mean", F.lit(1e-9)))


def plane_background(pixels: DataFrame, by: tuple[str, ...] = ("stack", "z")) -> DataFrame:
    """(keys, level, slope_x, slope_y, kept, clipped): trimmed background plane of each group."""
    keys = list(by)
    held = pixels.groupBy(*keys).agg(F.collect_list(F.struct("y", "x", "v")).alias("c")).select(*keys, F.col("c.y").alias("y"), F.col("c.x").alias("x"), F.col("c.v").alias("v"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields[: len(keys)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                x, y, v = (np.asarray(getattr(row, c), dtype=np.float64) for c in ("x", "y", "v"))
                order = np.lexsort((x, y))
                coef, keep = kc.plane(x[order], y[order], v[order])
                out.append((*[getattr(row, k) for k in keys], float(coef[0]), float(coef[1]), float(coef[2]), int(keep.sum()), float((v >= 254.5).mean())))
            yield pd.DataFrame(out, columns=[*keys, "level", "slope_x", "slope_y", "kept", "clipped"])

    return held.mapInPandas(run, f"{kinds}, level double, slope_x double, slope_y double, kept int, clipped double")
