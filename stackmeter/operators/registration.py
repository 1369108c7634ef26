"""Stage offsets, pair shifts and the global offset solution; glass plane consensus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import image
from ..params import Params
from ..storage import drop, materialise, new_path


def stage_offsets(stage: DataFrame, nm_per_px: float) -> DataFrame:
    """(tile, x0, y0) from stage nanometres; direction from the tile map, spacing from the stage."""
    out = stage
    limits = stage.agg(*[f.alias(f"{n}_{a}") for a, c, i in (("x", "stage_x", "tc"), ("y", "stage_y", "tr")) for n, f in (("slope", F.regr_slope(c, i)), ("lo", F.min(c)), ("hi", F.max(c)))])
    out = stage.join(F.broadcast(limits))
    zero = lambda a: F.when(F.coalesce(F.col(f"slope_{a}"), F.lit(-1.0)) < 0, F.col(f"hi_{a}")).otherwise(F.col(f"lo_{a}"))
    return out.select("tile", *[(F.abs(F.col(f"stage_{a}") - zero(a)) / nm_per_px).alias(f"{a}0") for a in ("x", "y")])


def nominal_offsets(layout: DataFrame, share: float = 0.70) -> DataFrame:
    """(tile, x0, y0) of a regular layout where no stage was recorded."""
    return layout.select("tile", (F.col("tc") * F.col("w") * share).alias("x0"), (F.col("tr") * F.col("h") * share).alias("y0"))


def pair_shifts(strips: DataFrame) -> DataFrame:
    """(ta, tb, z, dy, dx, quality) of overlapping strips a and b, each an array of height x width."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [image.shift_between(np.asarray(a, dtype=float).reshape(h, w), np.asarray(b, dtype=float).reshape(h, w)) for a, b, h, w in zip(pdf["a"], pdf["b"], pdf["height"], pdf["width"], strict=True)]
            yield pd.DataFrame({"ta": pdf["ta"], "tb": pdf["tb"], "z": pdf["z"], "dy": [g[0] for g in got], "dx": [g[1] for g in got], "quality": [g[2] for g in got]})

    return strips.mapInPandas(run, "ta int, tb int, z int, dy double, dx double, quality double")


def combined_shifts(votes: DataFrame, p: Params = Params()) -> DataFrame:
    """(ta, tb, dy, dx, scatter, confidence, n_planes): medians over the planes good enough."""
    good = votes.where(F.col("quality") >= p.register_quality)
    mid = good.groupBy("ta", "tb").agg(F.median("dy").alias("dy"), F.median("dx").alias("dx"), F.median("quality").alias("q"), F.count(F.lit(1)).alias("n_planes"))
    off = good.select("ta", "tb", F.col("dy").alias("vy"), F.col("dx").alias("vx")).join(mid, ["ta", "tb"])
    ey, ex = F.col("vy") - F.col("dy"), F.col("vx") - F.col("dx")
    out = off.groupBy("ta", "tb", "dy", "dx", "q", "n_planes").agg(F.median(F.sqrt(ey * ey + ex * ex)).alias("scatter"))
    return out.select("ta", "tb", "dy", "dx", "scatter", (F.col("q") / (1 + F.col("scatter"))).alias("confidence"), "n_planes")


def _applied(state: DataFrame, links: DataFrame) -> DataFrame:
    """``state`` with qx, qy: the normal equations' matrix times (px, py)."""
    other = state.select(F.col("tile").alias("other"), F.col("px").alias("ox"), F.col("py").alias("oy"))
    pulled = links.join(other, "other").groupBy("tile").agg(F.sum(F.col("w") * F.col("ox")).alias("sx"), F.sum(F.col("w") * F.col("oy")).alias("sy"))
    out = state.join(pulled, "tile", "left")
    return out.select(state["*"], *[(F.col("degree") * F.col(f"p{a}") - F.coalesce(f"s{a}", F.lit(0.0))).alias(f"q{a}") for a in "xy"])


def solved_offsets(edges: DataFrame, tiles: DataFrame, p: Params = Params(), tolerance: float = 1e-9, rounds: int = 5000) -> tuple[DataFrame, dict[str, float]]:
    """Offsets (tile, x, y) that fit all pair offsets at once, and the residuals.

    ``edges`` (ta, tb, dx, dy, confidence) has the measured offset of tb against ta; a pair's equation is multiplied by
    its confidence.  The normal equations are solved by conjugate gradients over the table of edges, preconditioned by
    their diagonal: a round is one join, one table of a row a tile and five sums, so neither edges nor tiles ever come
    to the driver.  Rounds start at the tiles' own places (x0, y0) and end when the mean correction is below
    ``tolerance`` pixels.  Only differences are observable: tiles that no usable pair ties to the others keep their
    mean place among themselves.  Offsets are counted from the least x and y.
    """
    spark = edges.sparkSession
    usable = edges.where(F.col("confidence") >= p.register_confidence).withColumn("w", F.col("confidence") * F.col("confidence"))
    side = lambda own, other, sign: usable.select(F.col(own).alias("tile"), F.col(other).alias("other"), "w", *[(sign * F.col(f"d{a}")).alias(f"d{a}") for a in "xy"])
    made = [links_at := new_path(spark, "links")]
    links = materialise(side("tb", "ta", 1).unionByName(side("ta", "tb", -1)), "", links_at)
    asked = links.groupBy("tile").agg(F.sum("w").alias("degree"), *[F.sum(F.col("w") * F.col(f"d{a}")).alias(f"g{a}") for a in "xy"])
    place = {a: F.col(f"{a}0").cast("double") if f"{a}0" in tiles.columns else F.lit(0.0) for a in "xy"}
    start = tiles.select("tile", *[place[a].alias(f"u{a}") for a in "xy"]).join(asked, "tile", "left")
    start = start.select("tile", "ux", "uy", F.coalesce("degree", F.lit(0.0)).alias("degree"), *[F.coalesce(f"g{a}", F.lit(0.0)).alias(f"g{a}") for a in "xy"])
    scaled = lambda r: F.when(F.col("degree") > 0, r / F.col("degree")).otherwise(F.lit(0.0))

    def held(df: DataFrame) -> DataFrame:
        made.append(new_path(spark, "offsets"))
        return materialise(df, "", made[-1])

    pushed = _applied(start.withColumns({f"p{a}": F.col(f"u{a}") for a in "xy"}), links)
    state = pushed.select("tile", "ux", "uy", "degree", *[(F.col(f"g{a}") - F.col(f"q{a}")).alias(f"r{a}") for a in "xy"])
    state = held(state.withColumns({f"p{a}": scaled(F.col(f"r{a}")) for a in "xy"}))
    products = {"pq": lambda a: F.col(f"p{a}") * F.col(f"q{a}"), "rz": lambda a: F.col(f"r{a}") * scaled(F.col(f"r{a}")), "rq": lambda a: F.col(f"r{a}") * scaled(F.col(f"q{a}")), "qq": lambda a: F.col(f"q{a}") * scaled(F.col(f"q{a}"))}
    for _ in range(rounds):
        state = held(_applied(state, links))
        s = state.agg(F.sum("degree").alias("degree"), *[F.sum(f(a)).alias(n + a) for n, f in products.items() for a in "xy"]).first()
        if (s["rzx"] or 0.0) + (s["rzy"] or 0.0) <= tolerance**2 * (s["degree"] or 0.0):
            break
        step, turn = {}, {}
        for a in "xy":
            rz, pq = s["rz" + a], s["pq" + a]
            step[a] = rz / pq if pq > 0 else 0.0
            turn[a] = max(0.0, rz - 2 * step[a] * s["rq" + a] + step[a] ** 2 * s["qq" + a]) / rz if rz > 0 else 0.0
        left = {a: F.col(f"r{a}") - step[a] * F.col(f"q{a}") for a in "xy"}
        state = state.select(
            "tile", "degree", *[(F.col(f"u{a}") + step[a] * F.col(f"p{a}")).alias(f"u{a}") for a in "xy"],
            *[left[a].alias(f"r{a}") for a in "xy"], *[(scaled(left[a]) + turn[a] * F.col(f"p{a}")).alias(f"p{a}") for a in "xy"],
        )
        for path in made[1:-1]:
            drop(spark, path)
        del made[1:-1]
    else:
        raise RuntimeError(f"offsets did not settle in {rounds} rounds")
    at = lambda t: state.select(F.col("tile").alias(t), F.col("ux").alias(f"{t}_x"), F.col("uy").alias(f"{t}_y"))
    gap = F.hypot(F.col("tb_x") - F.col("ta_x") - F.col("dx"), F.col("tb_y") - F.col("ta_y") - F.col("dy"))
    e = usable.join(at("ta"), "ta").join(at("tb"), "tb").select(gap.alias("e"))
    n, *rest = e.agg(F.count(F.lit(1)), F.median("e"), F.percentile("e", F.lit(0.9)), F.max("e")).first()
    report = dict(zip(("used", "residual_median", "residual_p90", "residual_max"), [float(n), *[float(v or 0.0) for v in rest]], strict=True))
    report["reliable"] = float(n >= 2 and report["residual_p90"] <= p.register_tolerance_px)
    solved = rebased(state.select("tile", F.col("ux").alias("x0"), F.col("uy").alias("y0"))).select("tile", F.col("x0").alias("x"), F.col("y0").alias("y"))
    solved = materialise(solved, "solved")
    for path in made:
        drop(spark, path)
    return solved, report


def rebased(offsets: DataFrame) -> DataFrame:
    """Offsets from their least x and y."""
    low = offsets.agg(F.min("x0").alias("lx"), F.min("y0").alias("ly"))
    return offsets.join(F.broadcast(low)).select("tile", (F.col("x0") - F.col("lx")).alias("x0"), (F.col("y0") - F.col("ly")).alias("y0"))


def substrate_plane(profile: DataFrame, share: float = 0.5) -> DataFrame:
    """(stack, plane, peak): the first sharpest slice of the deeper part of each focus profile."""
    depth = profile.groupBy("stack").agg((F.max("z") + 1).alias("depth"))
    tail = profile.join(depth, "stack").where(F.col("z") >= F.floor(F.col("depth") * share))
    return tail.groupBy("stack").agg(F.max_by("z", F.struct("v", -F.col("z"))).alias("plane"), F.max("v").alias("peak"))


def glass_votes(profile: DataFrame, p: Params = Params(), share: float = 0.6) -> DataFrame:
    """(stack, plane, contrast, voted): stacks whose peak stands out over their median."""
    mid = profile.groupBy("stack").agg(F.median("v").alias("mid"))
    return substrate_plane(profile, share).join(mid, "stack").select("stack", "plane", (F.col("peak") / F.col("mid")).alias("contrast"), (F.col("peak") / F.col("mid") >= p.glass_contrast).alias("voted"))


def glass_consensus(votes: DataFrame, depth: int) -> DataFrame:
    """(slice, n_votes, n_rejected, spread): the median vote, the last slice without votes."""
    v = F.when(F.col("voted"), F.col("plane"))
    return votes.agg(
        F.coalesce(F.median(v), F.lit(float(depth - 1))).alias("slice"), F.sum(F.col("voted").cast("long")).alias("n_votes"),
        F.sum((~F.col("voted")).cast("long")).alias("n_rejected"), (F.max(v) - F.min(v)).alias("spread"),
    )


def metadata_plane(scores: DataFrame) -> DataFrame:
    """(plane): the slice with the best mean instrument score over tiles of full depth."""
    full = scores.groupBy("tile").agg(F.count("score").alias("n")).where(F.col("n") == F.lit(scores.select("z").distinct().count())).select("tile")
    mean = scores.join(full, "tile", "left_semi").groupBy("z").agg(F.avg("score").alias("m"))
    return mean.agg(F.max_by("z", F.struct("m", -F.col("z"))).alias("plane"))


def block_means(pixels: DataFrame, size: int = 4, across: int | None = None) -> DataFrame:
    """(stack, z, y, x, v): means of whole squares of ``size`` pixels, a rest at the far edges left out.

    ``across`` is their width in ``pixels`` where those already stand for several of a row.
    """
    across = across or size
    own = {"y": F.floor(F.col("y") / size).cast("int"), "x": F.floor(F.col("x") / across).cast("int")}
    return pixels.groupBy("stack", "z", own["y"].alias("y"), own["x"].alias("x")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")).where(F.col("n") == size * across).drop("n")


def first_planes(slices: DataFrame, planes: int = 6) -> DataFrame:
    """(stack, z): the first ``planes`` of each stack's slices, the only ones that ``seed_axis`` looks at."""
    return slices.select("stack", "z").distinct().withColumn("n", F.row_number().over(Window.partitionBy("stack").orderBy("z"))).where(F.col("n") <= planes).drop("n")


def seed_axis(texture: DataFrame, canvases: DataFrame, k: float = 0.8, planes: int = 6, least: int = 100, size: int = 4) -> DataFrame:
    """(stack, cx, cy, n): where a first guess puts the droplet's axis (I16).

    ``texture`` (stack, z, y, x, v) stands for squares of ``size`` pixels, ``canvases`` (stack, width, height) for the
    whole.  Of the first ``planes`` slices those count that have ``least`` hot cells, each by their number; the centre
    of the canvas is taken where none has.
    """
    near = texture.join(first_planes(texture, planes), ["stack", "z"])
    stats = near.groupBy("stack", "z").agg(F.median("v").alias("m"), F.stddev_pop("v").alias("s"))
    hot = near.join(stats, ["stack", "z"]).where(F.col("v") > F.col("m") + k * F.col("s"))
    plane = hot.groupBy("stack", "z").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    found = plane.groupBy("stack").agg((size * F.sum("sx") / F.sum("n")).alias("cx"), (size * F.sum("sy") / F.sum("n")).alias("cy"), F.sum("n").alias("n"))
    out = canvases.join(found, "stack", "left")
    return out.select("stack", F.coalesce("cx", F.col("width") / 2).alias("cx"), F.coalesce("cy", F.col("height") / 2).alias("cy"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def placement_peaks(strips: DataFrame, least: float = 3.0) -> DataFrame:
    """(ta, tb, axis, z, placed, mirrored, ratio, agrees) of neighbours' strips.

    ``strips`` has a and b, the sides that the layout lays over each other, and a_far and b_far, the sides that a
    mirrored layout would.  A layout agrees where its peak is ``least`` times the mirrored one's.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = zip(*[pdf[c] for c in ("a", "b", "a_far", "b_far", "height", "width")], strict=True)
            got = [[image.phase_peak(*[np.asarray(v, dtype=float).reshape(h, w) for v in pair]) for pair in ((a, b), (c, d))] for a, b, c, d, h, w in rows]
            yield pdf[["ta", "tb", "axis", "z"]].assign(placed=[g[0] for g in got], mirrored=[g[1] for g in got])

    peaks = strips.mapInPandas(run, "ta int, tb int, axis string, z int, placed double, mirrored double")
    ratio = F.col("placed") / F.greatest("mirrored", F.lit(1e-9))
    return peaks.withColumn("ratio", ratio).withColumn("agrees", F.col("ratio") > least)
