"""Vantage-point trees over unit vectors, for joins within a similarity bound.

A node splits its rows by the median angle to a vantage point. Two rows within the angle `reach` of each
other may lie on both sides only if the inner one is at most `reach` from the median, so only such inner
rows are copied to the outer side, and every pair meets exactly once, where the outer row is at home.
Dividing the reach by a factor prunes more and may lose pairs; factor 1 is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

_TRIES = 16
_SEEN = 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, dtype=np.float64)
    scale = np.abs(v).max(axis=1, keepdims=True)
    v = v / scale
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def angles(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ point, -1.0, 1.0))


def choose(rows: np.ndarray, tries: int = _TRIES, shift: int = 0) -> tuple[np.ndarray, float] | None:
    """Of a few evenly picked rows the one whose angles to all (of a bounded number) have the widest middle half, so that few
    rows lie near the median, and that median; None if no split puts rows on both sides. `shift` picks other rows."""
    seen = rows[:: max(1, len(rows) // _SEEN)]
    best, spread = None, -1.0
    for i in (np.unique(np.linspace(0, len(rows) - 1, tries).astype(int)) + shift) % len(rows):
        a = angles(seen, rows[i])
        low, m, high = np.quantile(a, (0.25, 0.5, 0.75))
        if high - low > spread and (a <= m).any() and (a > m).any():
            best, spread = (rows[i], float(m)), high - low
    return best


@dataclass
class Node:
    point: np.ndarray | None = None
    median: float = 0.0
    inner: "Node | None" = None
    outer: "Node | None" = None
    leaf: int = -1


def build(sample: np.ndarray, leaves: int, number: int = 0) -> Node:
    """A tree with about `leaves` leaves of equal shares of the sample. Trees of other `number` have other vantage points."""
    count = 0

    def grow(rows: np.ndarray, wanted: int) -> Node:
        nonlocal count
        split = choose(rows, max(2, min(_TRIES, len(rows) // 8)), 7919 * number) if wanted > 1 and len(rows) >= 4 else None
        if split is None:
            count += 1
            return Node(leaf=count - 1)
        point, median = split
        near = angles(rows, point) <= median
        inner = grow(rows[near], wanted // 2)
        return Node(point, median, inner, grow(rows[~near], wanted - wanted // 2))

    return grow(sample.astype(np.float32), leaves)


def route(tree: Node, rows: np.ndarray, reach: float | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows at home there, rows copied there), as indices. Without reach no row is copied."""
    todo = [(tree, np.arange(len(rows)), np.empty(0, np.int64))]
    while todo:
        node, home, copies = todo.pop()
        if not len(home) and not len(copies):
            continue
        if node.leaf >= 0:
            yield node.leaf, home, copies
            continue
        todo += _sides(rows, node.point, node.median, home, copies, reach, node.inner, node.outer)


def _sides(rows, point, median, home, copies, reach, inner, outer):
    a = angles(rows[home], point)
    near = a <= median
    if reach is None:
        return [(inner, home[near], copies), (outer, home[~near], copies)]
    crossing = home[near & (a >= median - reach)]
    b = angles(rows[copies], point)
    return [
        (inner, home[near], copies[b <= median + reach]),
        (outer, home[~near], np.concatenate([crossing, copies[b >= median - reach]])),
    ]


def self_join(
    rows: np.ndarray, at_home: np.ndarray, reach: float, leaf_rows: int, visit: Callable[[np.ndarray, np.ndarray, bool], None], meet: bool = True
) -> None:
    """Builds a tree over the rows at home and calls visit(home, copies, meet) for every leaf. Every pair of rows within
    reach of which one is at home comes together in one leaf where one of the two is at home. Without `meet` pairs of two
    rows at home are left out: only copies meet rows at home."""
    todo = [(None, np.flatnonzero(at_home), np.flatnonzero(~at_home))]
    while todo:
        _, home, copies = todo.pop()
        if not len(home) or not (meet or len(copies)):
            continue
        split = choose(rows[home], 6) if len(home) > leaf_rows else None
        if split is None:
            for start in range(0, len(home), leaf_rows):  # no split (a ball of almost equal rows): exact, in blocks
                own = home[start : start + leaf_rows]
                visit(own, np.concatenate([home[start + leaf_rows :], copies]) if meet else copies, meet)
            continue
        if meet:
            todo += _sides(rows, *split, home, copies, reach, None, None)
        else:
            near = angles(rows[home], split[0]) <= split[1]
            b = angles(rows[copies], split[0])
            todo += [(None, home[near], copies[b <= split[1] + reach]), (None, home[~near], copies[b >= split[1] - reach])]
