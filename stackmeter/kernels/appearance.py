"""Appearance of one object on one frame, in numpy: regions from its outline, optical density, texture of the core.

What cannot be measured is absent from the result, never a number that stands for nothing.
"""

from __future__ import annotations

import numpy as np

from . import curves, image

# The window, levels and reaches of the descriptors, and the least sizes of what is measured.
OD_LOW, OD_HIGH, LEVELS, DISTANCES, BINS = -0.3, 2.0, 16, (1, 2, 4), 32
LEAST_RADIUS, LEAST_REGION, LEAST_HALO, LEAST_TEXTURE = 6, 9, 60, 25
EMPTY_OD, SATURATED = 0.06, 254.5

STATISTICS = ("mean", "std", "p10", "median", "p90", "iqr", "skew", "kurtosis", "entropy")
GLCM = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")
INTENSITY = (
    *[f"{region}_od_{s}" for region in ("core", "rim", "body") for s in STATISTICS],
    "outline_empty", "rim_minus_core_od", "core_over_rim_od", "core_rim_separation", "core_fill_fraction",
)
TEXTURE = (
    *[f"core_glcm_{p}_d{d}" for p in GLCM for d in DISTANCES], *[f"core_lbp_{b:02d}" for b in range(10)],
    "core_grad_mean", "core_grad_p90", "rim_grad_mean", "rim_over_core_grad",
)
QUALITY = ("appearance_measurable", "background_dn", "background_tilt_frac", "background_clipped_frac", "halo_px", "halo_lost_to_neighbours_px")


def regions(frame: np.ndarray, x: float, y: float, r: float, profile: np.ndarray, near: list[tuple[float, float, float]]) -> dict | None:
    """Masks of body, core, rim and halo on a patch around an outline r(theta), and the patch with the centre in it.

    The rim is the shell inside the outline, the core lies a guard further in, the halo is a ring of background from which
    discs around neighbours ``(dx, dy, r)`` are taken.  None where the frame does not hold the whole ring or a
    region is too small.
    """
    if not len(profile) or not np.isfinite(profile).all():  # a broken outline
        return None
    side = int(np.ceil(2.4 * r)) + 4
    left, top = round(x) - side, round(y) - side
    if r < LEAST_RADIUS or min(left, top) < 0 or left + 2 * side > frame.shape[1] or top + 2 * side > frame.shape[0]:
        return None
    patch, cx, cy = frame[top : top + 2 * side, left : left + 2 * side], x - left, y - top
    angle = np.arange(len(profile)) * 2 * np.pi / len(profile)
    body = image.polygon(cx + profile * np.cos(angle), cy + profile * np.sin(angle), patch.shape)
    shell, guard = max(3.0, 0.2 * r), max(2.0, 0.05 * r)
    cells = lambda width: max(1, round(width))
    core, rim = image.erode(body, cells(shell + guard)), body & ~image.erode(body, cells(shell))
    ring = image.dilate(body, cells(1.2 * r)) & ~image.dilate(body, cells(0.5 * r))
    yy, xx = np.mgrid[: patch.shape[0], : patch.shape[1]]
    halo = ring.copy()
    for dx, dy, other in near:
        halo &= (xx - cx - dx) ** 2 + (yy - cy - dy) ** 2 > (1.3 * other) ** 2
    if min(body.sum(), core.sum(), rim.sum()) < LEAST_REGION or halo.sum() < LEAST_HALO:
        return None
    return {"patch": patch, "cx": cx, "cy": cy, "xx": xx - cx, "yy": yy - cy, "body": body, "core": core, "rim": rim, "halo": halo, "lost": int(ring.sum() - halo.sum())}


def statistics(v: np.ndarray) -> list[float]:
    """``STATISTICS`` of a region: population moments (excess kurtosis), linear quantiles, entropy of bins in bits."""
    p10, p25, p50, p75, p90 = np.percentile(v, (10, 25, 50, 75, 90))
    mean, sd = v.mean(), v.std()
    third, fourth = (((v - mean) ** k).mean() for k in (3, 4))
    share = np.histogram(v, BINS, (OD_LOW, OD_HIGH))[0]
    share = share[share > 0] / max(share.sum(), 1)
    moment = lambda m, k: m / sd**k if sd > 1e-12 else np.nan
    return [mean, sd, p10, p50, p90, p75 - p25, moment(third, 3), moment(fourth, 4) - 3, -(share * np.log2(share)).sum() + 0.0]


def intensity(od: np.ndarray, found: dict) -> dict[str, float]:
    """Optical density of core, rim and body, and how core and rim differ."""
    core, rim, body = (od[found[k]] for k in ("core", "rim", "body"))
    gap = rim.mean() - core.mean()
    last = [body.mean() < EMPTY_OD, gap, core.mean() / rim.mean() if abs(rim.mean()) > 1e-6 else np.nan, gap / (np.sqrt((core.var() + rim.var()) / 2) + 1e-9), (core > rim.mean() / 2).mean()]
    return dict(zip(INTENSITY, [*statistics(core), *statistics(rim), *statistics(body), *last], strict=True))


def cooccurrence(levels: np.ndarray, distance: int) -> np.ndarray | None:
    """``GLCM`` of a grid of grey levels averaged over four directions; level 0 counts as absent.

    None if a direction has no pair.
    """
    i, j = np.mgrid[1:LEVELS, 1:LEVELS]
    step, found = (i - j).astype(float), []
    h, w = levels.shape
    for k in range(4):
        dy, dx = (round(float(distance * f(k * np.pi / 4))) for f in (np.sin, np.cos))
        a = levels[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
        b = levels[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
        pairs = np.bincount((a * LEVELS + b).reshape(-1), minlength=LEVELS * LEVELS).reshape(LEVELS, LEVELS)[1:, 1:]
        if not pairs.any():
            return None
        p = (pairs + pairs.T) / (2 * pairs.sum())
        mean = (i * p).sum()
        spread = ((i - mean) ** 2 * p).sum()
        # Both orders of a pair count, so rows and columns have one mean and one spread.
        like = ((i - mean) * (j - mean) * p).sum() / spread if spread > 1e-15 else 1.0
        found.append([(step**2 * p).sum(), (abs(step) * p).sum(), (p / (1 + step**2)).sum(), np.sqrt((p**2).sum()), like])
    return np.mean(found, axis=0)


def texture(od: np.ndarray, found: dict) -> dict[str, float]:
    """Co-occurrence, local binary patterns and gradients of the core; nothing where it is too small."""
    core, rim = found["core"], found["rim"]
    rows, columns = np.flatnonzero(core.any(axis=1)), np.flatnonzero(core.any(axis=0))
    box = slice(rows[0], rows[-1] + 1), slice(columns[0], columns[-1] + 1)
    inside = core[box]
    if core.sum() < LEAST_TEXTURE or min(inside.shape) < 2 * max(DISTANCES) + 1:
        return {}
    share = np.clip((od[box] - OD_LOW) / (OD_HIGH - OD_LOW), 0, 1)
    levels = np.where(inside, (share * (LEVELS - 1)).astype(int), 0)
    pairs = [cooccurrence(levels, d) for d in DISTANCES]
    if any(p is None for p in pairs):
        return {}
    patterns = np.bincount(image.local_binary(share * 255.0)[inside].astype(int), minlength=10) / inside.sum()
    slope = np.hypot(*np.gradient(od))
    grads = [slope[core].mean(), np.percentile(slope[core], 90), slope[rim].mean(), slope[rim].mean() / max(slope[core].mean(), 1e-9)]
    return dict(zip(TEXTURE, [*np.stack(pairs, axis=1).reshape(-1), *patterns, *grads], strict=True))


def measured(frame: np.ndarray, x: float, y: float, r: float, profile: np.ndarray, near: list[tuple[float, float, float]]) -> tuple[dict[str, float], list[str]]:
    """The columns of ``QUALITY``, ``INTENSITY`` and ``TEXTURE`` that could be measured, and the blocks that could not."""
    found = regions(frame, x, y, r, profile, near)
    if found is None:
        return {"appearance_measurable": 0.0}, ["intensity", "texture"]
    halo, body = found["halo"], found["body"]
    light = found["patch"][halo]
    (level, across, down), _ = curves.plane(found["xx"][halo], found["yy"][halo], light)
    ground = level + across * found["xx"] + down * found["yy"]
    od = -np.log(np.clip(found["patch"] / np.maximum(ground, 1.0), 1 / 255, 4.0))
    quality = [1.0, level, np.ptp(ground[body]) / max(abs(level), 1e-6), (light >= SATURATED).mean(), halo.sum(), found["lost"]]
    fine = texture(od, found)
    return dict(zip(QUALITY, quality, strict=True)) | intensity(od, found) | fine, [] if fine else ["texture"]
