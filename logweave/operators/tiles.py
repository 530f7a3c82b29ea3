"""Exact comparison of many unit vectors: a bound from a few axes first, the distance only of what it leaves.

The vectors are turned to axes that hold most of their length first. The product over the leading axes plus
the product of the lengths of the rest is never below the whole product, so most pairs of vectors without any
structure are ruled out by one short float32 product. What is left is compared as in ``cells``, with the same rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DIGITS = 6
STEPS = 10**DIGITS
NONE = np.iinfo(np.int64).max
#: Numbers of a head: the leading axes and the length of the rest.
HEAD = 40
#: What a float32 product and the rounding of distances may be wrong by.
_LOOSE = 2e-5
#: Rows and columns of one product, whose buffers stay in the cache, and pairs that are compared in one go.
_STRIP, _WIDTH, _EXACT = 256, 2048, 2048


def axes(sample: np.ndarray) -> np.ndarray:
    """Orthogonal axes as columns, those with most of the sample's length first."""
    return np.ascontiguousarray(np.linalg.eigh(sample.T @ sample)[1][:, ::-1])


def heads(rows: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """(rows, numbers of a head), of float32: products of heads are upper bounds of the products of rows."""
    head = rows @ turned[:, : HEAD - 1]
    rest = np.sqrt(np.maximum((rows * rows).sum(axis=1) - (head * head).sum(axis=1), 0.0))
    return np.concatenate([head, rest[:, None]], axis=1).astype(np.float32)


def possible(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of a, row of b) of the pairs of heads whose product reaches ``least`` of the row of b, a strip at a time."""
    product, reached = np.empty((_STRIP, _WIDTH), np.float32), np.zeros((_STRIP, _WIDTH), bool)
    words = reached.reshape(-1).view(np.uint64)
    least = (least - _LOOSE).astype(np.float32)
    for left in range(0, len(b), _WIDTH):
        columns, bound = np.ascontiguousarray(b[left : left + _WIDTH].T), least[left : left + _WIDTH]
        wide = columns.shape[1]
        for at in range(0, len(a), _STRIP):
            some = a[at : at + _STRIP]
            if wide == _WIDTH and len(some) == _STRIP:
                np.matmul(some, columns, out=product)
                np.greater_equal(product, bound, out=reached)
                hit = np.flatnonzero(words)
                if not len(hit):
                    continue
                cell = (hit[:, None] * 8 + np.arange(8)).ravel()
                cell = cell[reached.reshape(-1)[cell]]
            else:
                cell = np.flatnonzero(some @ columns >= bound)
            if len(cell):
                yield at + cell // wide, left + cell % wide


def steps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances, in whole steps, of the rows of ``a`` from those of ``b`` beside them."""
    return np.rint((1.0 - np.clip(np.einsum("ij,ij->i", a, b), -1.0, 1.0)) * STEPS).astype(np.int64)


def compared(a: np.ndarray, b: np.ndarray, head_a: np.ndarray, head_b: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, distance in steps) of every pair whose product reaches ``least`` of the row of b, and of some others."""
    for i, j in possible(head_a, head_b, least):
        for at in range(0, len(i), _EXACT):
            r, c = i[at : at + _EXACT], j[at : at + _EXACT]
            yield r, c, steps(a[r], b[c])


def least_of(limit: float, radius: np.ndarray | float = 0.0) -> np.ndarray | float:
    """Product of a unit vector with the middle of a ball of this radius, at least, if a row in the ball is within ``limit`` of it."""
    chord = np.minimum(np.sqrt(2.0 * limit) + radius, 2.0)
    return 1.0 - chord * chord / 2.0


def chord_of(distance: np.ndarray) -> np.ndarray:
    """Straight distance, at most, of unit vectors that are so many steps apart."""
    return np.sqrt(2.0 * (distance + 1) / STEPS)


def lead(rows: np.ndarray, head: np.ndarray, limit: float, near: float, block: int = 512) -> tuple[np.ndarray, np.ndarray, int]:
    """Leaders among the rows, in their order: (leader of each row, steps << 32 | its nearest earlier leader within ``limit``, or NONE; pairs whose distance was computed).

    A row within ``near`` of an earlier leader belongs to its nearest one, any other is a leader itself.
    """
    n, far, close = len(rows), int(np.rint(limit * STEPS)), int(np.rint(min(near, limit) * STEPS))
    leader, best = np.arange(n), np.full(n, NONE)
    held, held_head, place, count, pairs = np.empty_like(rows), np.empty_like(head), np.empty(n, np.int64), 0, 0
    for at in range(0, n, block):
        to = min(at + block, n)
        mine = best[at:to]
        for i, j, d in compared(rows[at:to], held[:count], head[at:to], held_head[:count], np.full(count, least_of(limit))):
            ok, pairs = d <= far, pairs + len(d)
            np.minimum.at(mine, i[ok], (d[ok] << 32) | place[j[ok]])
        free = np.flatnonzero(mine >> 32 > close)
        some = rows[at:to][free]
        d = np.rint((1.0 - np.clip(some @ some.T, -1.0, 1.0)) * STEPS).astype(np.int64)
        pairs += d.size
        keys = np.where(d <= far, (d << 32) | (at + free)[:, None], NONE)
        own = mine[free]
        for t in range(len(free)):
            if own[t] >> 32 > close:  # a leader: later rows of the block see it
                np.minimum(own[t + 1 :], keys[t, t + 1 :], out=own[t + 1 :])
        mine[free] = own
        follows = mine >> 32 <= close
        leader[at:to][follows] = mine[follows] & 0xFFFFFFFF
        new = at + np.flatnonzero(~follows)
        held[count : count + len(new)], held_head[count : count + len(new)], place[count : count + len(new)] = rows[new], head[new], new
        count += len(new)
    return leader, best, pairs
