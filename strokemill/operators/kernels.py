"""Linear kernels over flat arrays of points, for rules that look back to the last point that was kept.

Points of many paths lie one after the other. A rule says for each point whether it stays
if a given earlier point is the last one kept. Most points stay right after a kept one,
so all points are tried against their predecessors at once; only where one goes, the
points after it are tried against the same last kept point, in blocks of growing size,
until one stays. So the work is linear in the points, whatever their paths' lengths.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def last_kept(n: int, stays: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which of ``n`` points stay; the first does.

    ``stays(last, at)`` tells for arrays of places whether ``at`` stays if ``last`` is the
    last kept one. It must be true for the first point of each path.
    """
    kept = np.ones(n, bool)
    if n < 2:
        return kept
    at = np.arange(1, n)
    gone, done = at[~stays(at - 1, at)].tolist(), 0
    for first in gone:
        if first <= done:
            continue
        last, here, step = first - 1, first, 16
        while here < n:
            block = np.arange(here, min(n, here + step))
            found = stays(np.full(len(block), last), block)
            size = int(found.argmax()) if found.any() else len(block)
            kept[here : here + size] = False
            here, step = here + size, step * 2
            if size < len(block):
                break
        done = here
    return kept


def far(x: np.ndarray, y: np.ndarray, least: np.ndarray | float) -> Callable:
    """The rule "at least so far from the last kept point"; what is no number counts as far."""
    each = np.broadcast_to(np.asarray(least, float), x.shape)

    def stays(last, at):
        dx, dy = x[at] - x[last], y[at] - y[last]
        return ~(np.sqrt(dx * dx + dy * dy) < each[at])

    return stays


def off_line(x: np.ndarray, y: np.ndarray, ends: np.ndarray, tolerance: float) -> Callable:
    """The rule "further than that from the line between the last kept and the next point"; ``ends`` always stay."""

    def stays(last, at):
        to = np.minimum(at + 1, len(x) - 1)
        dx, dy = x[to] - x[last], y[to] - y[last]
        square = dx * dx + dy * dy
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x[at] - x[last]) * dx + (y[at] - y[last]) * dy) / square
        t = np.where(square != 0, np.clip(t, 0.0, 1.0), 0.0)
        return ends[at] | (np.hypot(x[at] - x[last] - t * dx, y[at] - y[last] - t * dy) > tolerance)

    return stays


class Paths:
    """Points of a batch of paths as flat arrays; a null path is a path without points that stays null."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.type, self.null = column.type, np.asarray(column.is_null())
        points = column.flatten()
        self.x, self.y = (points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
        self.sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)

    def first(self) -> np.ndarray:
        """Places of the first points of paths that have any."""
        out = np.zeros(len(self.x), bool)
        begins = np.cumsum(self.sizes) - self.sizes
        out[begins[self.sizes > 0]] = True
        return out

    def last(self) -> np.ndarray:
        out = np.zeros(len(self.x), bool)
        out[np.cumsum(self.sizes)[self.sizes > 0] - 1] = True
        return out

    def take(self, kept: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.x, self.y, self.sizes = self.x[kept], self.y[kept], np.bincount(owner[kept], minlength=len(self.sizes))

    def collapse(self, least: float) -> None:
        if least > 0:
            each = np.where(self.first(), -np.inf, least)
            self.take(last_kept(len(self.x), far(self.x, self.y, each)))

    def simplify(self, tolerance: float) -> None:
        """Passes until no point goes; a pass looks at all paths at once."""
        while True:
            few = np.repeat(self.sizes <= 2, self.sizes)
            kept = last_kept(len(self.x), off_line(self.x, self.y, self.first() | self.last() | few, tolerance))
            if kept.all():
                return
            self.take(kept)

    def column(self) -> pa.Array:
        fields = self.type.value_type
        points = pa.StructArray.from_arrays([pa.array(self.x), pa.array(self.y)], fields=[pa.field("x", pa.float64()), pa.field("y", pa.float64())])
        offsets = pa.array(np.concatenate(([0], np.cumsum(self.sizes))), pa.int32())
        return pa.ListArray.from_arrays(offsets, points, mask=pa.array(self.null)).cast(pa.list_(fields))
