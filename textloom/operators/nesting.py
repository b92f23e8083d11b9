"""Trees of bracketed texts by arrays: brackets matched by levels, parents by the nearest open start, subtrees by runs of nodes.

Nodes are numbered in the order of their starts, all texts of a batch in one array, so a subtree is a run of numbers. No step
walks a tree: each is a sort, a running sum, or a search over maxima of blocks, in memory that is linear in the nodes.
"""

from __future__ import annotations

import numpy as np

from textloom.operators.sequences import scrambled

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def matched(group: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each opening token (step 1) the place of the closing token (step -1) of its group that closes it, else -1: a closing
    token closes the latest open one of its group, and one that finds none closes nothing."""
    out = np.full(len(step), -1, np.int64)
    if len(step) < 2:
        return out
    order = np.argsort(group, kind="stable")
    group, step = group[order], step[order]
    level = np.cumsum(step) + (step < 0)
    by_level = np.lexsort((level, group))
    first, then = by_level[:-1], by_level[1:]
    pair = (step[first] > 0) & (step[then] < 0) & (group[first] == group[then]) & (level[first] == level[then])
    out[order[first[pair]]] = order[then[pair]]
    return out


def previous_above(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place i the latest j < i with values[j] > at[i], else -1: up a pyramid of maxima of blocks of 1, 2, 4 ... values
    until a block on the left holds one, then down to it."""
    n = len(values)
    least = np.iinfo(np.int64).min
    pyramid = [np.asarray(values, np.int64)]
    while len(pyramid[-1]) > 1:
        top = pyramid[-1]
        top = np.append(top, least) if len(top) % 2 else top
        pyramid.append(np.maximum(top[::2], top[1::2]))
    end, found, height = np.arange(n), np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for k, top in enumerate(pyramid):
        odd = np.flatnonzero((end % 2 == 1) & (found < 0))
        hit = odd[top[end[odd] - 1] > at[odd]]
        found[hit], height[hit] = end[hit] - 1, k
        end >>= 1
    for k in range(len(pyramid) - 1, 0, -1):
        down = np.flatnonzero((height == k) & (found >= 0))
        right = np.minimum(2 * found[down] + 1, len(pyramid[k - 1]) - 1)
        found[down] = np.where(pyramid[k - 1][right] > at[down], right, 2 * found[down])
        height[down] = k - 1
    return found


def depths(parent: np.ndarray) -> np.ndarray:
    """How many nodes are above each, by jumps that double."""
    depth, jump = (parent >= 0).astype(np.int64), parent.copy()
    while (jump >= 0).any():
        live = np.flatnonzero(jump >= 0)
        over = jump[live]
        depth[live] += depth[over]
        jump[live] = jump[over]
    return depth


def sizes(depth: np.ndarray) -> np.ndarray:
    """How many nodes each subtree has, its root included: up to the next node that is no deeper."""
    flat = -depth[::-1]
    return (np.arange(len(flat)) - previous_above(flat, flat - 1))[::-1]


def children(group: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes in the order of their parents, roots by the group that they are in, and each node's place among its siblings."""
    key = np.where(parent >= 0, parent, -1 - group)
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[order], prepend=key[order][:1] - 1))
    ordinal = np.empty(len(key), np.int64)
    ordinal[order] = np.arange(len(key)) - np.repeat(new, np.diff(np.append(new, len(key))))
    return order, ordinal


class Runs:
    """Hashes of runs of values, wherever they stand, from one running sum."""

    def __init__(self, values: np.ndarray):
        steps = np.full(len(values) + 1, _STEP, np.uint64)
        back = np.full(len(values) + 1, _BACK, np.uint64)
        steps[0] = back[0] = 1
        self._back = np.multiply.accumulate(back)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled(values) * np.multiply.accumulate(steps)[:-1])))

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return scrambled((self._sums[start + length] - self._sums[start]) * self._back[start])

    def alike(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, backwards: bool = False) -> np.ndarray:
        """How many values the runs that start at ``a`` and ``b`` (``backwards``: end before them) have in common, up to ``most``,
        by lengths that halve."""
        length = np.zeros(len(a), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            try_ = np.flatnonzero(length + (1 << k) <= most)
            more = np.full(len(try_), 1 << k)
            shift = -length[try_] - (1 << k) if backwards else length[try_]
            same = self.of(a[try_] + shift, more) == self.of(b[try_] + shift, more)
            length[try_[same]] += 1 << k
        return length


def digests(labels: np.ndarray, size: np.ndarray, lane: int) -> np.ndarray:
    """A hash of each subtree: labels and sizes in the order of nodes tell a tree. Each ``lane`` gives another hash."""
    mixed = scrambled(labels + np.uint64(lane)) ^ scrambled(size.astype(np.uint64) + np.uint64(1 + lane))
    return Runs(mixed).of(np.arange(len(size)), size)
