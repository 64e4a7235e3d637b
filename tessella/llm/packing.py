"""Packing lengths into sequences of a fixed capacity: segment-tree best fit, and Martello-Toth dominance reduction.

All of it works on a histogram of lengths. That has at most ``capacity`` entries however many pieces there are, so a
plan for a whole corpus is small: pieces of equal length are interchangeable, and a plan deals ranks within a length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class CapacityTree:
    """A segment tree over the free capacities 0..capacity that finds the smallest occupied one of at least w."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.capacity = capacity
        self.used = [0] * (2 * self.size)

    def add(self, free: int, n: int = 1) -> None:
        at = free + self.size
        while at:
            self.used[at] += n
            at >>= 1

    def first(self, w: int) -> int:
        """The smallest occupied capacity that is at least w; -1 if there is none."""
        used, at = self.used, w + self.size
        if w > self.capacity:
            return -1
        if used[at]:
            return w
        while at > 1:
            if not at & 1 and used[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if used[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices into ``lengths`` (each 1..capacity); long pieces first, each into the fullest bin that takes it."""
    tree, open_bins, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        w = int(lengths[i])
        free = tree.first(w)
        if free < 0:
            free, at = capacity, len(bins)
            bins.append([])
        else:
            at = open_bins[free].pop()
            tree.add(free, -1)
        bins[at].append(i)
        if free > w:
            open_bins[free - w].append(at)
            tree.add(free - w)
    return bins


@dataclass
class Plan:
    """segments: (length, first rank, end rank, first sequence, pieces of it in a sequence, offset of the first).

    The piece of rank r within its length goes to sequence ``first + (r - lo) // per`` at ``offset + (r - lo) % per * length``.
    """

    capacity: int
    segments: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0
    dealt: dict[int, int] = field(default_factory=dict)

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def deal(self, length: int, first: int, sequences: int, per: int, offset: int) -> None:
        lo = self.dealt.get(length, 0)
        self.dealt[length] = lo + sequences * per
        self.segments.append((length, lo, lo + sequences * per, first, per, offset))


def reduce_dominated(plan: Plan, count: np.ndarray) -> None:
    """Fix, for each length, the sets that dominate all others, and take them out of ``count``.

    With r the room that a piece of length j leaves, the set {j} + S dominates when every other choice that fits in r
    can be mapped into the pieces of S: nothing else fits; one piece fills r; no two others fit and S is the largest;
    or no three fit and every pair whose smaller piece is larger than S's second is no longer than S's first.
    Passes are repeated until none fixes anything.
    """
    capacity = plan.capacity
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while count[j]:
                chosen = _dominating(count, j, capacity)
                if chosen is None:
                    break
                members, each = np.unique([j, *chosen], return_counts=True)
                t = int(min(count[m] // k for m, k in zip(members, each, strict=True)))
                first, offset = plan.open(t), 0
                for m, k in zip(members[::-1].tolist(), each[::-1].tolist(), strict=True):
                    plan.deal(m, first, t, k, offset)
                    offset += m * k
                    count[m] -= t * k
                plan.fixed += t
                changed = True


def _dominating(count: np.ndarray, j: int, capacity: int) -> list[int] | None:
    r = capacity - j
    count[j] -= 1
    try:
        if r == 0:
            return []
        if count[r]:
            return [r]
        there = np.flatnonzero(count[: r + 1])
        if not len(there):
            return []
        least = np.repeat(there[:3], np.minimum(count[there[:3]], 3))[:3]
        k = int(there[-1])
        if len(least) < 2 or least[:2].sum() > r:
            return [k]
        if len(least) == 3 and least.sum() <= r:
            return None
        count[k] -= 1
        second = np.flatnonzero(count[: r - k + 1])
        count[k] += 1
        l = int(second[-1]) if len(second) else 0
        y = there[there > l]
        y = y[2 * y <= r]
        at = np.searchsorted(there, r - y, side="right") - 1
        x = there[at]
        single = (x == y) & (count[x] < 2)
        x = np.where(single, 0, x)
        if np.any((x >= y) & (x + y > k)):
            return None
        return [k, l] if l else [k]
    finally:
        count[j] += 1


def best_fit(plan: Plan, count: np.ndarray) -> None:
    """Deal what ``count`` holds, long lengths first, each into the fullest sequences that take it; equal ones at once."""
    capacity, tree = plan.capacity, CapacityTree(plan.capacity)
    groups: dict[int, list[tuple[int, int]]] = {}

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            groups.setdefault(free, []).append((first, n))
            tree.add(free)

    for w in range(capacity, 0, -1):
        left = int(count[w])
        while left:
            free = tree.first(w)
            if free < 0:
                free, n = capacity, -(-left // (capacity // w))
                first = plan.open(n)
            else:
                first, n = groups[free].pop()
                tree.add(free, -1)
            per = free // w
            full = min(n, left // per)
            offset = capacity - free
            if full:
                plan.deal(w, first, full, per, offset)
                put(free - per * w, first, full)
                left -= full * per
            rest = n - full
            if rest and left and left < per:
                plan.deal(w, first + full, 1, left, offset)
                put(free - left * w, first + full, 1)
                left, full = 0, full + 1
                rest -= 1
            put(free, first + full, rest)
        count[w] = 0


def plan_packing(lengths: dict[int, int], capacity: int, reduce: bool = True) -> Plan:
    """A plan for ``lengths`` (length: number of pieces), by dominance reduction and best fit of the remainder."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in lengths.items():
        count[length] = n
    plan = Plan(capacity)
    if reduce:
        reduce_dominated(plan, count)
    best_fit(plan, count)
    return plan
