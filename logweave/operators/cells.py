"""An index of unit vectors in cells around pivots, searched exactly by the triangle inequality.

Every vector lies in the cell of its nearest pivot. The distances of a cell's members to the pivot lie
between two bounds, so a query's own distance to the pivot bounds its distance to all of them; a second
bound comes from the plane between two pivots. Cells are visited in the order of their bounds,
and no more once the bound passes what is already found. Distances are 1 - cosine in steps of 1e-6.
"""

from __future__ import annotations

import numpy as np

from logweave.operators import tiles as T
from logweave.operators.tiles import DIGITS, NONE, STEPS  # noqa: F401

#: Members of a cell; a larger one is cut in the order of the members.
CELL_ROWS = 512
#: (row, pivot) pairs of one step: the bound of its memory.
PAIRS = 1 << 18
#: What a bound may be wrong by, rounding of distances included.
_MARGIN = 2e-6
#: Share of the cells that can hold a row within the limit, beyond which cells are not worth their visits.
_SCAN_SHARE = 0.2


def matrix(vectors) -> np.ndarray:
    if len(vectors) and isinstance(first := next(iter(vectors)), bytes):  # packed
        return np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), len(first) // 8)
    return np.array(vectors.tolist() if hasattr(vectors, "tolist") else list(vectors), dtype=np.float64).reshape(len(vectors), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1))
    n[n == 0] = 1.0
    return m / n[:, None]


def steps(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Distances in whole steps; a zero vector is at distance 1 from everything."""
    return np.rint((1.0 - np.clip(queries @ items.T, -1.0, 1.0)) * STEPS).astype(np.int64)


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Straight distances of unit vectors, for which the triangle inequality holds."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def distinct_rows(m: np.ndarray) -> np.ndarray:
    return np.unique(m[m.any(axis=1)], axis=0)


def nearest_pivot(m: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pivot, chord to it) of every row; a zero vector has the pivot -1."""
    cell, far = np.zeros(len(m), np.int64), np.zeros(len(m))
    step = max(1, min(4096, PAIRS // max(1, len(pivots))))
    for at in range(0, len(m), step):
        d = chords(m[at : at + step], pivots)
        cell[at : at + step] = d.argmin(axis=1)
        far[at : at + step] = d.min(axis=1)
    cell[~m.any(axis=1)] = -1
    return cell, far


def lower_bounds(queries: np.ndarray, pivots: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, cells): no member of a cell is nearer than this distance. Cells have a pivot (-1: no
    bound) and the chords to it of their nearest and farthest member; every member's nearest pivot is its cell's."""
    out = np.zeros((len(queries), len(pivot)))
    known = np.flatnonzero(pivot >= 0)
    live = queries.any(axis=1)
    if len(known) and live.any():
        d = chords(queries[live], pivots)
        own = d[:, pivot[known]]
        home = d.argmin(axis=1)
        apart = chords(pivots[home], pivots)[:, pivot[known]]
        # half of the difference of the squares over the pivots' distance: how far the plane between them is
        plane = np.where(apart > 1e-9, (own**2 - d.min(axis=1)[:, None] ** 2) / (2 * np.maximum(apart, 1e-9)), 0.0)
        chord = np.maximum(np.maximum(own - high[known], low[known] - own), np.maximum(plane, 0.0))
        out[np.ix_(live, known)] = chord**2 / 2
    return out


class CellIndex:
    """Rows in a fixed order (positions); ``compared`` counts the pairs whose distance was computed."""

    def __init__(self, rows: np.ndarray):
        self.compared, self.heads = 0, None
        n = len(rows)
        solid = np.flatnonzero(rows.any(axis=1))
        count = min(len(solid), int(np.ceil(np.sqrt(n))))
        chosen = np.random.default_rng(n).choice(solid, count, replace=False) if count else solid
        self.pivots = distinct_rows(rows[chosen]) if count else np.zeros((0, rows.shape[1]))
        cell, far = nearest_pivot(rows, self.pivots) if len(self.pivots) else (np.full(n, -1), np.zeros(n))
        order = np.argsort(cell, kind="stable")
        cuts = np.flatnonzero(np.diff(cell[order], prepend=-2))
        starts = [s for a, b in zip(cuts, [*cuts, n][1:], strict=True) for s in range(a, b, CELL_ROWS)]
        self.start, self.stop = np.array(starts, np.int64), np.array([*starts, n][1:], np.int64)
        self.position, self.rows = order, rows[order]
        self.pivot = cell[order][self.start]
        far = far[order]
        self.low, self.high = np.minimum.reduceat(far, self.start), np.maximum.reduceat(far, self.start)
        self.first = np.minimum.reduceat(order, self.start)

    def _by_cell(self, queries: np.ndarray, cells: np.ndarray):
        """(cell, queries, distances in steps) for each cell that is asked for."""
        order = np.argsort(cells, kind="stable")
        cuts = np.flatnonzero(np.diff(cells[order], prepend=-1))
        for a, b in zip(cuts, [*cuts, len(cells)][1:], strict=True):
            asked = order[a:b]
            c = cells[asked[0]]
            self.compared += len(asked) * int(self.stop[c] - self.start[c])
            yield c, asked, steps(queries[asked], self.rows[self.start[c] : self.stop[c]])

    def nearest(self, queries: np.ndarray, k: int, limit: float = 2.0) -> np.ndarray:
        """(queries, k): distance in steps << 32 | position of the nearest rows within ``limit``, ascending, NONE where there are fewer."""
        best = np.full((len(queries), k), NONE)
        bounds = lower_bounds(queries, self.pivots, self.pivot, self.low, self.high)
        far = int(np.rint(limit * STEPS))
        if limit < 1 and (bounds <= limit + _MARGIN).mean() > _SCAN_SHARE:
            return self._scan(queries, best, limit)
        order = np.argsort(bounds, axis=1, kind="stable")
        ranked = np.take_along_axis(bounds, order, axis=1)
        todo, at, width = np.arange(len(queries)), 0, 1
        while len(todo) and at < len(self.start):
            reach = np.minimum(best[todo, -1] >> 32, far) / STEPS + _MARGIN
            near = ranked[todo, at : at + width] <= reach[:, None]
            asked, cell = np.broadcast_to(todo[:, None], near.shape)[near], order[todo, at : at + width][near]
            for c, some, d in self._by_cell(queries[asked], cell):
                keys = np.where(d <= far, (d << 32) | self.position[self.start[c] : self.stop[c]], NONE)
                both = np.concatenate([best[asked[some]], keys], axis=1)
                best[asked[some]] = np.sort(np.partition(both, k - 1, axis=1)[:, :k], axis=1)
            todo, at, width = todo[near[:, -1]], at + width, width * 2
        return best

    def _scan(self, queries: np.ndarray, best: np.ndarray, limit: float) -> np.ndarray:
        """``nearest`` for vectors that no cell rules out: their heads do."""
        if self.heads is None:
            self.axes = T.axes(self.pivots)
            self.heads = T.heads(self.rows, self.axes)
        far, k = int(np.rint(limit * STEPS)), best.shape[1]
        asked, keys, waiting = [], [], 0

        def settle() -> None:
            row, key = np.concatenate([np.repeat(np.arange(len(queries)), k), *asked]), np.concatenate([best.ravel(), *keys])
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best[row[place < k], place[place < k]] = key[place < k]

        for i, j, d in T.compared(queries, self.rows, T.heads(queries, self.axes), self.heads, np.full(len(self.rows), T.least_of(limit))):
            self.compared += len(d)
            ok = d <= far
            asked.append(i[ok])
            keys.append((d[ok] << 32) | self.position[j[ok]])
            waiting += int(ok.sum())
            if waiting > PAIRS:
                settle()
                asked, keys, waiting = [], [], 0
        settle()
        return best

    def any_before(self, queries: np.ndarray, before: np.ndarray, limit: float) -> np.ndarray:
        """Whether a row of a position below ``before`` is within ``limit`` of each query."""
        found = np.zeros(len(queries), bool)
        bounds = lower_bounds(queries, self.pivots, self.pivot, self.low, self.high)
        bounds[self.first[None, :] >= before[:, None]] = np.inf
        order = np.argsort(bounds, axis=1, kind="stable")
        ranked = np.take_along_axis(bounds, order, axis=1)
        far = int(np.rint(limit * STEPS))
        todo, at, width = np.arange(len(queries)), 0, 1
        while len(todo) and at < len(self.start):
            near = ranked[todo, at : at + width] <= limit + _MARGIN
            asked, cell = np.broadcast_to(todo[:, None], near.shape)[near], order[todo, at : at + width][near]
            for c, some, d in self._by_cell(queries[asked], cell):
                hit = (d <= far) & (self.position[self.start[c] : self.stop[c]][None, :] < before[asked[some]][:, None])
                found[asked[some]] |= hit.any(axis=1)
            todo, at, width = todo[near[:, -1] & ~found[todo]], at + width, width * 2
        return found
