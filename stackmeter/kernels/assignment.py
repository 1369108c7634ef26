"""Least-cost one-to-one assignment over the pairs within a gate, in numpy: neither a matrix nor a list of all pairs is held."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

from .points import Columns, cell_size, runs

#: Pairs that are held; where the gate has more, only the cheapest of each circle are, and the others are looked up when they can matter.
HELD = 1 << 25
#: Bands of radius within a factor of two, and rows that are met with them at once.
BANDS, ROWS = 3, 2048
#: Bids in the opening rise by the median least cost over this, in so many rounds at most.
STEPS, ROUNDS = 64, 20_000
#: Choices of a row that are looked at again before its whole list, and entries that are looked at at once.
CHOICES, BATCH = 24, 1 << 20

Lists = tuple[np.ndarray, np.ndarray, np.ndarray]


def _costs(p: np.ndarray, q: np.ndarray, shift: float, ratio: float) -> np.ndarray:
    """Cost of linking circles (x, y, r): distance over mean radius, at most ``shift``, plus half the log of the ratio of radii, at most ``ratio``; else infinite."""
    with np.errstate(divide="ignore", invalid="ignore"):
        dist = np.hypot(p[..., 0] - q[..., 0], p[..., 1] - q[..., 1]) / ((p[..., 2] + q[..., 2]) / 2)
        wide = np.maximum(p[..., 2], q[..., 2]) / np.minimum(p[..., 2], q[..., 2])
        cost = np.where((dist > shift) | (wide > ratio), np.inf, dist + 0.5 * np.log(wide))
    return np.where(np.isnan(cost), np.inf, cost)


def _met(a: np.ndarray, b: np.ndarray, shift: float, ratio: float) -> Iterator[tuple[int, int, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first, last, steps) for runs of rows of ``a``: each step has rows, runs of a band of ``b`` in which their partners lie, and that band's order."""
    cols = np.flatnonzero(np.isfinite(b).all(axis=1))
    bands = np.floor(np.log(np.maximum(b[cols, 2], 1e-300)) * (BANDS / np.log(2.0))).astype(np.int64)
    grids = []
    for band in np.unique(bands):
        own = cols[bands == band]
        r = b[own, 2]
        widest = max(shift * r.max() * (1 + min(ratio, 1e3)) / 2, 1e-9)
        grids.append((own, float(r.min()), float(r.max()), Columns(b[own, :2], cell_size(b[own, :2], widest / 8, widest))))

    def steps(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for own, least, most, grid in grids:
            r = a[rows, 2]
            met = rows[(r * ratio >= least * (1 - 1e-9)) & (r <= most * ratio * (1 + 1e-9))]
            if len(met):
                reach = np.maximum(shift * (a[met, 2] + most) / 2, 0.0) * (1 + 1e-9) + 1e-9
                for at, first, _, _, last in grid.near(a[met, :2], reach):
                    yield met[at], first, last, own[grid.order]

    for first in range(0, len(a), ROWS):
        last = min(first + ROWS, len(a))
        yield first, last, steps(first + np.flatnonzero(np.isfinite(a[first:last]).all(axis=1)))


def bound(a: np.ndarray, b: np.ndarray, shift: float, ratio: float) -> int:
    """At least as many as the pairs within the gate; no pair is looked at."""
    return sum(int((last - first).sum()) for _, _, steps in _met(a, b, shift, ratio) for _, first, last, _ in steps)


def gated(a: np.ndarray, b: np.ndarray, shift: float, ratio: float, limit: float = np.inf) -> Lists:
    """(start, column, cost) of the pairs of circles ``a`` and ``b`` (x, y, r) that may be linked at a cost of at most ``limit``; row i of ``a`` has [start[i], start[i + 1]), cheapest first.

    Circles meet by bands of radius; few are tested in vain where neighbouring rows are of like radius.
    """
    near_shift, near_ratio = min(shift, limit), min(ratio, float(np.exp(2 * min(limit, 350.0))))
    counts, columns, costs = [], [], []
    for low, high, steps in _met(a, b, near_shift, near_ratio):
        held = []
        for at, first, last, order in steps:
            for owner, position in runs(first, last):
                i, j = at[owner], order[position]
                mean = (a[i, 2] + b[j, 2]) / 2
                dx, dy = a[i, 0] - b[j, 0], a[i, 1] - b[j, 1]
                maybe = np.flatnonzero(dx * dx + dy * dy <= (near_shift * (1 + 1e-9) * mean) ** 2 + 1e-12)
                i, j = i[maybe], j[maybe]
                cost = _costs(a[i], b[j], shift, ratio)
                keep = np.flatnonzero(cost <= limit) if limit < np.inf else np.flatnonzero(np.isfinite(cost))
                held.append((i[keep] - low, j[keep].astype(np.int32), cost[keep]))
        i, j, cost = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0))
        order = np.argsort(i + cost / (2 * cost.max() + 1), kind="stable") if len(i) else i
        counts.append(np.bincount(i, minlength=high - low))
        columns.append(j[order])
        costs.append(cost[order])
    if not counts:
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0)
    return np.r_[0, np.cumsum(np.concatenate(counts))], np.concatenate(columns), np.concatenate(costs)


class _Side:
    """Rows or columns: their pairs, complete up to the cost ``limit``, their dual values and mates, and the price of staying alone."""

    def __init__(self, lists: Lists, alone: float, limit: float = np.inf, whole: Callable[[int], tuple[np.ndarray, np.ndarray]] | None = None):
        self.start, self.other, self.cost = lists
        self.alone, self.limit, self.whole = alone, limit, whole
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        n = len(self.start) - 1
        self.dual, self.mate = np.zeros(n), np.full(n, -1, dtype=np.int64)
        #: Choices of least value of each, and the value that no other is below; holds while the others' dual values fall.
        self.choices = np.zeros((n, CHOICES), dtype=np.int32), np.full((n, CHOICES), np.inf), np.full(n, -np.inf)

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(others, costs, the cost up to which they are complete) of i."""
        if i in self.known:
            return *self.known[i], np.inf
        s, e = self.start[i], self.start[i + 1]
        return self.other[s:e], self.cost[s:e], self.limit

    def complete(self, i: int) -> None:
        self.known[i] = self.whole(i)

    def refresh(self, rows: np.ndarray, price: np.ndarray) -> None:
        for kept, new in zip(self.choices, self.cheapest(rows, price, CHOICES), strict=True):
            kept[rows] = new

    def cheapest(self, rows: np.ndarray, price: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(columns, costs, floor) of the ``n`` listed choices of least value for each of ``rows``, and the value that no other is below."""
        column, cost, floor = np.zeros((len(rows), n), dtype=np.int32), np.full((len(rows), n), np.inf), np.full(len(rows), np.inf)
        have = self.start[rows + 1] - self.start[rows]
        by_length = np.argsort(have, kind="stable")
        first = 0
        while first < len(rows):
            size = have[by_length[first:]] * np.arange(1, len(rows) - first + 1)
            last = first + max(1, int(np.searchsorted(size, BATCH, "right")))
            part = by_length[first:last]
            k = np.arange(max(int(have[part[-1]]), n + 1))
            at = np.minimum(self.start[rows[part], None] + k, len(self.cost) - 1)
            value = np.where(k < have[part, None], self.cost[at] - price[self.other[at]], np.inf)
            take = np.argpartition(value, n, axis=1)[:, : n + 1]
            line = np.arange(len(part))[:, None]
            took = value[line, take]
            floor[part] = took[:, n]
            at = at[line, take[:, :n]]
            column[part], cost[part] = self.other[at], np.where(np.isfinite(took[:, :n]), self.cost[at], np.inf)
            first = last
        return column, cost, floor


def _augmented(root: int, one: _Side, two: _Side, dist: np.ndarray, came: np.ndarray, done: np.ndarray, falling: bool) -> None:
    """Give ``root`` a mate over the shortest path, or let the end of a shorter one stay alone; duals stay feasible and mates tight.

    The heap has members of ``two`` and, as negative numbers, members of ``one`` of which more is to be read at that distance.
    ``falling`` says that the dual values of ``two`` have only fallen, so that the choices kept of ``one`` hold.
    """
    top = max(0.0, float(two.dual.max())) if len(two.dual) else 0.0
    heap: list[tuple[float, int]] = []
    touched: list[np.ndarray] = []
    closed: list[int] = []
    base_of: dict[int, float] = {}
    width: dict[int, int] = {}
    best, end, end_row = np.inf, -1, root
    row, far, fresh = root, 0.0, True
    while True:
        if fresh:
            base_of[row] = far - one.dual[row]
        base = base_of[row]
        if base + one.alone < best:
            best, end, end_row = base + one.alone, -1, row
        js, cs, limit = one.of(row)
        if fresh and base + limit - top < best:
            heapq.heappush(heap, (base + limit - top, -2 - 2 * row))
        width[row] = 8 * width.get(row, CHOICES // 8)
        if falling and fresh and row not in one.known and one.choices[2][row] > -np.inf:
            js, cs, rest = one.choices[0][row], one.choices[1][row], base + one.choices[2][row]
        else:
            stop = int(np.searchsorted(cs, best - base + top))
            js, cs, rest = js[:stop], cs[:stop], np.inf
        value = base + cs - two.dual[js]
        if len(js) > 2 * width[row]:  # the others are read when they are next
            rest = float(np.partition(value, width[row])[width[row]])
        better = (value < dist[js]) & (value < best) & (value <= rest) & ~done[js]
        js, value = js[better], value[better]
        if len(js):
            free = two.mate[js] < 0
            if free.any():
                k = int(np.where(free, value, np.inf).argmin())
                best, end, end_row = float(value[k]), int(js[k]), row
                keep = ~free & (value < best)
                js, value = js[keep], value[keep]
            dist[js], came[js] = value, row
            touched.append(js)
            for item in zip(value.tolist(), js.tolist(), strict=True):
                heapq.heappush(heap, item)
        if rest < best:
            heapq.heappush(heap, (rest, -1 - 2 * row))
        while heap and heap[0][1] >= 0 and (done[heap[0][1]] or heap[0][0] > dist[heap[0][1]]):
            heapq.heappop(heap)
        if not heap or heap[0][0] >= best:
            break
        key, j = heapq.heappop(heap)
        if j < 0:  # what was left out of this one may matter now
            row, fresh = (-1 - j) // 2, False
            if j % 2 == 0:
                one.complete(row)
            continue
        far, fresh = key, True
        done[j] = True
        closed.append(j)
        row = int(two.mate[j])
    one.dual[root] += best
    if closed:
        moved = best - dist[closed]
        one.dual[two.mate[closed]] += moved
        two.dual[closed] -= moved
    j, row = end, end_row
    while True:
        before, one.mate[row] = one.mate[row], j
        if j >= 0:
            two.mate[j] = row
        if row == root:
            break
        j, row = int(before), int(came[before])
    for js in touched:
        dist[js], done[js] = np.inf, False


def _opening_prices(rows: _Side, n_columns: int) -> np.ndarray:
    """Prices near the final ones: all rows without a column bid at once, each a little over what its second choice leaves, until few are left.

    Values only grow, so a row looks at its few best choices again until what it had left out may be better.
    """
    price, holder = np.zeros(n_columns), np.full(n_columns, -1, dtype=np.int64)
    todo = np.flatnonzero(np.diff(rows.start))
    if not len(todo):
        return price
    most = min(4 * float(rows.cost.max()), rows.limit)  # where rows outnumber columns, prices end here
    over = float(np.median(rows.cost[rows.start[todo]])) / STEPS
    column, cost, floor = rows.choices
    few, rounds = len(todo) // 1000, 0
    while len(todo) > few and rounds < ROUNDS:
        rounds += 1
        value = cost[todo] - price[column[todo]]
        value.partition(1, axis=1)
        stale = todo[value[:, 1] > floor[todo]]
        if len(stale):
            rows.refresh(stale, price)
        j, line = column[todo], np.arange(len(todo))
        value = cost[todo] - price[j]
        k = value.argmin(axis=1)
        k, first = j[line, k], value[line, k]
        value.partition(1, axis=1)
        use = first < most
        offer = (price[k] - (np.minimum(value[:, 1], most) - first) - over)[use]
        todo, k = todo[use], k[use]
        order = np.argsort(-offer, kind="stable")  # the highest bid is written last
        before = holder[k]
        holder[k[order]], price[k[order]] = todo[order], offer[order]
        won = holder[k] == todo
        todo = np.concatenate([todo[~won], before[won & (before >= 0)]])
    return price


def _solved(rows: _Side, columns: _Side) -> list[tuple[int, int]]:
    """Pairs of a least-cost assignment: bids, then shortest augmenting paths from rows, then from columns that are left with a price."""
    n = len(rows.mate)
    price, own, of_row, of_column = columns.dual, rows.dual, rows.mate, columns.mate
    price[:] = _opening_prices(rows, len(price))

    choice, choice_cost, floor = rows.choices

    def best_two(i: int) -> tuple[float, int, float, int]:
        if i not in rows.known:
            for _ in range(2):
                column, value = choice[i], choice_cost[i] - price[choice[i]]
                k = int(value.argmin())
                least, value[k] = float(value[k]), np.inf
                k2 = int(value.argmin())
                if value[k2] <= floor[i] and value[k2] <= rows.limit:
                    return least, int(column[k]), float(value[k2]), int(column[k2])
                if rows.start[i] == rows.start[i + 1]:
                    break
                rows.refresh(np.array([i]), price)
            if rows.limit == np.inf:  # there is one choice or none
                return (least, int(column[k]), np.inf, -1) if np.isfinite(least) else (np.inf, -1, np.inf, -1)
            rows.complete(i)
        column, cost = rows.known[i]
        if not len(cost):
            return np.inf, -1, np.inf, -1
        value = cost - price[column]
        k = int(value.argmin())
        least, value[k] = float(value[k]), np.inf
        k2 = int(value.argmin())
        return least, int(column[k]), float(value[k2]), int(column[k2])

    listed = np.flatnonzero(np.diff(rows.start))
    best, first, _ = rows.cheapest(listed, price, 1)
    best, first = best[:, 0], first[:, 0] - price[best[:, 0]]
    settled = np.unique(best[first <= rows.limit], return_index=True)[1] if len(listed) else []
    settled = np.flatnonzero(first <= rows.limit)[settled]
    of_row[listed[settled]], of_column[best[settled]], own[listed[settled]] = best[settled], listed[settled], first[settled]
    left, queue = [], deque(np.flatnonzero(of_row < 0).tolist())
    bids = 4 * len(queue)
    while queue:
        i = queue.popleft()
        if bids <= 0:
            left.append(i)
            continue
        bids -= 1
        first, j, second, other = best_two(i)
        if first >= rows.alone:  # alone is cheaper
            own[i] = rows.alone
            continue
        if second >= rows.alone:
            second, other = rows.alone, -1
        if second == first and of_column[j] >= 0:
            if other < 0 or of_column[other] >= 0:
                left.append(i)
                continue
            j = other
        price[j] -= second - first
        own[i] = second
        before = of_column[j]
        if before >= 0:
            of_row[before] = -1
            queue.append(int(before))
        of_row[i], of_column[j] = j, i

    work = np.full(len(price), np.inf), np.full(len(price), -1, dtype=np.int64), np.zeros(len(price), dtype=bool)
    for root in left:
        own[root] = min(best_two(root)[0], rows.alone)
        _augmented(root, rows, columns, *work, True)
    work = np.full(n, np.inf), np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=bool)
    for root in np.flatnonzero((of_column < 0) & (price < 0)).tolist():
        _augmented(root, columns, rows, *work, False)
    return [(i, j) for i, j in enumerate(of_row.tolist()) if j >= 0]


def _turned(lists: Lists, n_columns: int) -> Lists:
    """The same pairs by column."""
    start, column, cost = lists
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    order = np.lexsort((row, cost, column))
    return np.r_[0, np.cumsum(np.bincount(column, minlength=n_columns))], row[order], cost[order]


def pairs(start: np.ndarray, column: np.ndarray, cost: np.ndarray, n_columns: int, forbidden: float = 1e6) -> list[tuple[int, int]]:
    """Pairs (row, column): as many as possible, among those of the least cost.

    Each row may also stay alone at the price ``forbidden``, each column at 0.
    """
    lists = start, column, cost
    return _solved(_Side(lists, forbidden), _Side(_turned(lists, n_columns), 0.0))


def linked(a: np.ndarray, b: np.ndarray, shift: float, ratio: float, forbidden: float = 1e6) -> list[tuple[int, int]]:
    """The pairs that ``pairs`` finds over all that ``gated`` lists; in a crowd only the cheapest of each circle are listed.

    Prices of columns never rise above 0, so a pair matters only when its cost alone is below what the row's choice costs; the
    rest of a circle's list is made at that moment.
    """
    if not len(a) or not len(b):
        return []
    by_size = np.argsort(a[:, 2], kind="stable")
    a, limit = a[by_size], np.inf
    if bound(a, b, shift, ratio) > HELD:
        limit = shift
        while limit > shift / 64 and bound(a, b, limit, min(ratio, float(np.exp(2 * limit)))) > HELD:
            limit /= 1.4
    lists = gated(a, b, shift, ratio, limit)

    def whole(one: np.ndarray, two: np.ndarray) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
        def of(i: int) -> tuple[np.ndarray, np.ndarray]:
            x, y, r = one[i]
            at = np.flatnonzero((np.abs(two[:, 0] - x) <= shift * (r + two[:, 2])) & (np.abs(two[:, 1] - y) <= shift * (r + two[:, 2])))
            cost = _costs(one[i], two[at], shift, ratio)
            order = np.lexsort((at, cost))[: np.isfinite(cost).sum()]
            return at[order], cost[order]

        return of

    none = np.zeros(len(b) + 1, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0)
    found = _solved(_Side(lists, forbidden, limit, whole(a, b)), _Side(none, 0.0, 0.0, whole(b, a)))
    return sorted((int(by_size[i]), j) for i, j in found)
