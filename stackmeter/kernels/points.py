"""Points of one block of the plane: counts within a radius, nearest neighbours, greedy suppression.

Points lie in columns, sorted along x: a square grid over the other axes.  A search meets the columns near a
point and in each a run of x, so its work follows what may lie within reach and not the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Candidates that are held at once.
BATCH = 1 << 21
#: Points whose neighbours are ranked at once.
ROWS = 2048


def runs(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, position) of all positions in [start, stop) of each owner, in batches of whole owners."""
    n = np.maximum(stop - start, 0)
    ends = np.cumsum(n)
    first = 0
    while first < len(n):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + BATCH, "right")))
        own = n[first:last]
        owner = np.repeat(np.arange(first, last), own)
        if len(owner):
            yield owner, np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(start[first:last], own)
        first = last


def cell_size(points: np.ndarray, least: float, most: float, each: float = 10.0) -> float:
    """The side of a cube of ``each`` points on average, within bounds."""
    room = np.prod(np.maximum(np.ptp(points, axis=0), most))
    return float(np.clip((each * room / len(points)) ** (1 / points.shape[1]), least, most))


class Columns:
    """Points (n, axes) in columns of side ``h``."""

    def __init__(self, points: np.ndarray, h: float):
        self.h, self.low = h, points.min(axis=0)
        cells = np.floor((points[:, 1:] - self.low[1:]) / h).astype(np.int64)
        self.shape = cells.max(axis=0) + 1
        self.width = float(np.ptp(points[:, 0])) + 2.0
        code = self._code(cells)
        self.order = np.lexsort((points[:, 0], code))
        self.points = points[self.order]
        self.keys = code[self.order] * self.width + (self.points[:, 0] - self.low[0] + 1.0)
        #: Keys are a little off where there are many columns; what lies this close to a limit is tested.
        self.slack = 1e-9 + 8 * np.finfo(float).eps * float(self.keys[-1])

    def _code(self, cells: np.ndarray) -> np.ndarray:
        code = np.zeros(len(cells), dtype=np.int64)
        for axis in range(cells.shape[1]):
            code = code * self.shape[axis] + cells[:, axis]
        return code

    def _place(self, base: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
        return np.searchsorted(self.keys, base + np.clip(x - self.low[0] + 1.0, 0.5, self.width - 0.5), side)

    def near(self, at: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of ``at``, a, b, c, d) for each step between columns: sorted positions [b, c) lie within ``reach`` for
        certain, [a, b) and [c, d) may, and no others of that column."""
        own = np.floor((at[:, 1:] - self.low[1:]) / self.h).astype(np.int64)
        far = int(np.ceil(reach.max() / self.h)) if len(reach) else 0
        for step in np.ndindex(*[2 * far + 1] * own.shape[1]):
            cell = own + np.array(step) - far
            rows = np.flatnonzero(((cell >= 0) & (cell < self.shape)).all(axis=1))
            lower = self.low[1:] + cell[rows] * self.h - at[rows, 1:]
            upper = lower + self.h
            least = (np.maximum(np.maximum(lower, -upper) - self.slack, 0.0) ** 2).sum(axis=1)
            most = ((np.maximum(np.abs(lower), np.abs(upper)) + self.slack) ** 2).sum(axis=1)
            square = reach[rows] ** 2
            use = least <= square
            rows, least, most, square = rows[use], least[use], most[use], square[use]
            if not len(rows):
                continue
            base, x = self._code(cell[rows]) * self.width, at[rows, 0]
            outer = np.sqrt(square - least) + self.slack
            inner = np.sqrt(np.maximum(square - most, 0.0)) - self.slack
            a, d = self._place(base, x - outer, "left"), self._place(base, x + outer, "right")
            sure = inner > self.slack
            b = np.where(sure, self._place(base, x - inner, "left"), d)
            c = np.where(sure, self._place(base, x + inner, "right"), d)
            b = np.clip(b, a, d)
            yield rows, a, b, np.clip(c, b, d), d


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sum((a[:, i] - b[:, i]) * (a[:, i] - b[:, i]) for i in range(a.shape[1])))


def counts_within(points: np.ndarray, at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """How many of ``points`` lie nearer than ``reach`` to each row of ``at``."""
    out = np.zeros(len(at), dtype=np.int64)
    known = np.flatnonzero(reach > 0)
    if not len(known) or not len(points):
        return out
    at, reach = at[known], reach[known]
    most = float(reach.max())
    grid = Columns(points, cell_size(points, most / 32, most))
    found = np.zeros(len(at), dtype=np.int64)
    for rows, a, b, c, d in grid.near(at, reach):
        found[rows] += c - b
        for start, stop in ((a, b), (c, d)):
            for owner, position in runs(start, stop):
                hit = distances(at[rows[owner]], grid.points[position]) < reach[rows[owner]]
                found += np.bincount(rows[owner[hit]], minlength=len(at))
    out[known] = found
    return out


def coincident(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of ``points`` stand at the very place of each row of ``at``."""
    _, place, n = np.unique(np.concatenate([points, at]) + 0.0, axis=0, return_inverse=True, return_counts=True)
    again = np.bincount(place.ravel()[len(points) :], minlength=len(n))
    return (n - again)[place.ravel()[len(points) :]]


def nearest(points: np.ndarray, ids: np.ndarray, at: np.ndarray, own: np.ndarray, k: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(distances, rows of ``points``), (n, k) each, of the k nearest others by (distance, id); nan and -1 for rows that lack k within ``reach``."""
    dist, who = np.full((len(at), k), np.nan), np.full((len(at), k), -1, dtype=np.int64)
    todo, q = np.arange(len(at)), min(reach, cell_size(points, reach / 64, reach, 3.0 * (k + 1) / (4 if points.shape[1] == 3 else 3)))
    while len(todo):
        grid = Columns(points, q)
        for part in np.split(todo, range(ROWS, len(todo), ROWS)):
            held = []
            for rows, a, _, _, d in grid.near(at[part], np.full(len(part), q)):
                for owner, position in runs(a, d):
                    i = part[rows[owner]]
                    apart = distances(at[i], grid.points[position])
                    keep = (apart <= q) & (ids[grid.order[position]] != own[i])
                    held.append((i[keep], apart[keep], grid.order[position[keep]]))
            if held:
                i, apart, j = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((ids[j], apart, i))
                i, apart, j = i[order], apart[order], j[order]
                start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.array([], dtype=np.int64)
                full = np.diff(np.r_[start, len(i)]) >= k
                at_k = start[full][:, None] + np.arange(k)
                dist[i[start[full]]], who[i[start[full]]] = apart[at_k], j[at_k]
        todo = todo[np.isnan(dist[todo, 0])]
        if q >= reach:
            break
        q = min(2 * q, reach)
    return dist, who


def first_come(x: np.ndarray, y: np.ndarray, z: np.ndarray, r: np.ndarray, state: np.ndarray, home: np.ndarray, anisotropy: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Greedy suppression of a block's points, which come in their order of rank; 1 kept, -1 dropped, 0 open.

    ``state`` is what is known so far.  A point out of reach of every earlier one that stays is kept.  One of the margin
    that is open may have rivals outside, so that it and what it reaches stay open, unless a kept one drops them.
    """
    state = state.copy()
    by_x = np.argsort(x, kind="stable")
    sx, sy, sz, sr, sa, sf = (v[by_x] for v in (x, y, z, r, anisotropy, least))
    waits = np.zeros(len(x), dtype=bool)
    widest = float(r.max()) if len(r) else 0.0
    for i in range(len(x)):
        if state[i] == -1:
            continue
        if state[i] == 0 and home[i] and not waits[i]:
            state[i] = 1
        a, b = np.searchsorted(sx, x[i] - 0.5 * widest - 1e-9, "left"), np.searchsorted(sx, x[i] + 0.5 * widest + 1e-9, "right")
        big = np.maximum(sr[a:b], r[i])
        dx, dy = sx[a:b] - x[i], sy[a:b] - y[i]
        hit = (np.sqrt(dx * dx + dy * dy) < 0.5 * big) & (np.abs(sz[a:b] - z[i]) * sa[a:b] < np.maximum(sf[a:b], 0.6 * big))
        later = by_x[a:b][hit]
        later = later[later > i]
        if state[i] == 1:
            state[later[state[later] == 0]] = -1
        else:
            waits[later] = True
    return state
