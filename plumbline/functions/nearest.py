"""Exact nearest neighbours of points in NumPy arrays.

``plan_cells`` cuts space into boxes by a sample, so that points can be dealt to
tasks. Inside a task ``Blocks`` holds a cell's points in boxes of a few dozen
and meets queries with the boxes in their reach only. A box bounds the computed
square itself, not only the true one: subtraction, product and sum are monotone
in floating point too. NaN is the greatest distance.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BLOCK = 64  # points in a block
WIDE = 32 * BLOCK  # queries that would meet more points go on in smaller groups
FEW = 8  # queries that aren't split further
SLACK = 1 + 1e-9  # squares that differ by less may have equal roots


def matrix(x) -> np.ndarray:
    """Points of an Arrow column of equally long lists."""
    return x.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


class Cells(NamedTuple):
    """Boxes that cover space: ``low <= x < high``; a node's children are nodes, or ``~cell``."""

    axis: np.ndarray
    at: np.ndarray
    children: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), 0 if len(self.axis) else ~0)
        while len(inner := np.flatnonzero(node >= 0)):
            n = node[inner]
            node[inner] = self.children[n, (~(x[inner, self.axis[n]] < self.at[n])).astype(int)]
        return ~node

    def others_near(self, x: np.ndarray, reach: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, cell) of all other cells with a point within the squared reach, sorted by row."""
        face = np.minimum(x - self.low[cell], self.high[cell] - x).min(axis=1)
        rows = np.flatnonzero(~(face * face > reach * SLACK))
        rows = rows[np.argsort(reach[rows])]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for part in np.split(rows, range(256, len(rows), 256)) if len(rows) else ():
            q, most = x[part], reach[part]
            near = _apart(q.min(axis=0), q.max(axis=0), self.low, self.high)
            near = np.flatnonzero(~(near > most.max() * SLACK) & (np.arange(len(near)) != cell))
            row, at = np.nonzero(~(_apart(q[:, None], q[:, None], self.low[near], self.high[near]) > most[:, None] * SLACK))
            found.append((part[row], near[at]))
        row, at = (np.concatenate(v) for v in zip(*found))
        order = np.argsort(row, kind="stable")
        return row[order], at[order]


def _apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least squared distance between boxes; the last axis holds coordinates."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0.0)
    total = gap[..., 0] * gap[..., 0]
    for j in range(1, gap.shape[-1]):
        total += gap[..., j] * gap[..., j]
    return total


def _half(x: np.ndarray, share: float) -> tuple[int, float, np.ndarray] | None:
    """Axis, value and rows below it, near to ``share`` of the rows, on the widest axis that has two values."""
    for j in np.argsort(-np.ptp(x, axis=0), kind="stable"):
        v = np.sort(x[:, j])
        want = int(len(v) * share)
        below, upto = np.searchsorted(v, v[want], "left"), np.searchsorted(v, v[want], "right")
        if upto < len(v) and (below == 0 or upto - want < want - below):
            below = upto
        if below:
            return int(j), v[below], x[:, j] < v[below]
    return None


def plan_cells(sample: np.ndarray, cells: int) -> Cells:
    """About ``cells`` boxes with equally many points of the sample, by cuts of the widest axis."""
    sample = sample[np.isfinite(sample).all(axis=1)]
    axis, at, children, lows, highs = [], [], [], [], []

    def grow(x: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
        cut = _half(x, (n // 2) / n) if n > 1 and len(x) > 1 else None
        if cut is None:
            lows.append(low)
            highs.append(high)
            return ~(len(lows) - 1)
        j, value, below = cut
        own = len(axis)
        axis.append(j)
        at.append(value)
        children.append((0, 0))
        left = min(max(round(n * below.mean()), 1), n - 1)
        end, start = high.copy(), low.copy()
        end[j] = start[j] = value
        children[own] = (grow(x[below], left, low, end), grow(x[~below], n - left, start, high))
        return own

    d = sample.shape[1]
    with np.errstate(all="ignore"):
        grow(sample, cells, np.full(d, -np.inf), np.full(d, np.inf))
    return Cells(np.array(axis, np.int64), np.array(at, float), np.array(children, np.int64).reshape(-1, 2), np.array(lows), np.array(highs))


def _blocks(x: np.ndarray) -> list[np.ndarray]:
    """Rows in blocks of near points, halved by the widest axis."""
    done, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= BLOCK:
            done.append(rows)
            continue
        own = x[rows]
        order = rows[np.argpartition(own[:, np.argmax(np.ptp(own, axis=0))], len(rows) // 2)]
        open_ += [order[len(rows) // 2 :], order[: len(rows) // 2]]
    return done


def _squares(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances; ``points`` has a row for each coordinate."""
    total = np.zeros((len(q), points.shape[1]))
    for j in range(len(points)):
        gap = q[:, j, None] - points[j]
        gap *= gap
        total += gap
    return total


def _kth(squares: np.ndarray, same: np.ndarray, k: int) -> np.ndarray:
    """k-th least square of each row without the same ids; NaN if it has fewer."""
    if squares.shape[1] < k:
        return np.full(len(squares), np.nan)
    return np.partition(np.where(same, np.nan, squares), k - 1, axis=1)[:, k - 1]


class Blocks:
    """Points and ids in blocks of near points: a point's place here is that of ``row`` in the input."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        with np.errstate(all="ignore"):
            blocks = _blocks(x)
            self.sizes = np.array([len(b) for b in blocks])
            self.row = np.concatenate(blocks)
            self.x, self.ids = np.ascontiguousarray(x[self.row].T), ids[self.row]
            starts = np.cumsum(self.sizes) - self.sizes
            self.low, self.high = (f.reduceat(self.x, starts, axis=1).T for f in (np.minimum, np.maximum))
        self.slices = [slice(s, s + n) for s, n in zip(starts, self.sizes)]

    def reaches(self, k: int) -> np.ndarray:
        """For each place, the square within which it has ``k`` others of its own block; NaN if it has fewer."""
        out = np.empty(len(self.ids))
        with np.errstate(all="ignore"):
            for s in self.slices:
                out[s] = _kth(_squares(self.x[:, s].T, self.x[:, s]), self.ids[s, None] == self.ids[s], k)
        return out

    def nearest(self, queries: Blocks, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, place of the point, distance, square) of each query's ``k`` nearest points with other ids.

        Points farther than the squared reach may be missing; NaN is no bound. Sorted by query, distance and id.
        """
        found, open_ = [], [np.arange(s.start, s.stop) for s in reversed(queries.slices)]
        with np.errstate(all="ignore"):
            while open_:
                rows = open_.pop()
                q, most = queries.x[:, rows].T, reach[rows]
                near = ~(_apart(q.min(axis=0), q.max(axis=0), self.low, self.high) > most.max() * SLACK)
                if len(rows) > FEW and self.sizes[near].sum() > WIDE:
                    rows = rows[np.argsort(most, kind="stable")]
                    open_ += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
                    continue
                found.append(self._meet(rows, q, queries.ids[rows], most, np.flatnonzero(np.repeat(near, self.sizes)), k))
        order = np.argsort(np.concatenate([f[0] for f in found]), kind="stable")
        return tuple(np.concatenate(v)[order] for v in zip(*found))

    def _meet(self, rows, q, ids, most, places, k):
        squares, others = _squares(q, self.x[:, places]), self.ids[places]
        if len(loose := np.flatnonzero(np.isnan(most))):
            most[loose] = _kth(squares[loose], ids[loose, None] == others, k)
        keep = squares <= most[:, None] * SLACK
        keep[np.isnan(most)] = True
        i, j = np.nonzero(keep)
        other = ids[i] != others[j]
        i, j = i[other], j[other]
        dist = np.sqrt(squares[i, j])
        order = np.lexsort((others[j], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[first], j[first]
        return rows[i], places[j], dist[first], squares[i, j]
