"""Order of a drawing's paths: greedy nearest neighbour, and two-opt on top of it.

A drawing is one task's work, however many paths it has. Drawings of equally many paths, up
to ``SMALL``, are ordered together, a step of all at a time. Large drawings find their next
path over a grid, and two-opt looks at the pairs of paths that can gain, which are found
over grids, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouped import changes, on_drawings

SCHEMA = "drawing_id bigint, path_id bigint, pos bigint, flipped boolean, points array<struct<x:double,y:double>>"


#: From so many paths on the next one is found over a grid; the result is the same.
GRID = 500
#: Rings of cells that are looked at before all paths that are left.
RINGS = 6
#: Up to so many paths two-opt looks at all pairs at once; pairs that it looks at in one piece beyond.
ALL_PAIRS, PAIRS = 300, 2_000_000
#: Drawings of so many paths at most are ordered together.
SMALL = 40


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])


def nearest(heads: np.ndarray, tails: np.ndarray, start: np.ndarray, grid: int = GRID) -> tuple[list[int], list[bool]]:
    """Nearer end of the unused paths; the earliest path and the forward direction win ties."""
    if len(heads) >= grid and np.isfinite(heads).all() and np.isfinite(tails).all() and np.isfinite(start).all():
        return nearest_by_grid(heads, tails, start)
    ends = np.stack([heads, tails], 1).reshape(-1, 2)
    # ways from the start and from each end to each end; a path's two ends are 2i and 2i + 1
    ways = apart(np.vstack([ends, start])[:, None], ends[None])
    here, order, flips = len(ends), [], []
    for _ in range(len(heads)):
        i, flip = divmod(int(ways[here].argmin()), 2)
        order.append(i)
        flips.append(bool(flip))
        ways[:, 2 * i : 2 * i + 2] = np.inf
        here = 2 * i + 1 - flip
    return order, flips


def nearest_by_grid(heads: np.ndarray, tails: np.ndarray, start: np.ndarray) -> tuple[list[int], list[bool]]:
    """The same order: rings of cells around the place, until no end outside of them can be as near."""
    ends = np.stack([heads, tails], 1).reshape(-1, 2)
    left, here, order, flips = np.ones(len(heads), bool), start, [], []
    planned = 0
    for done in range(len(heads)):
        if len(heads) - done <= planned // 2 or not done:
            # a new grid, as cells grow empty
            planned = len(heads) - done
            alive = np.flatnonzero(np.repeat(left, 2))
            low = ends[alive].min(0)
            side = float((ends[alive].max(0) - low).max()) / np.sqrt(len(alive))
            if side < 1e-9:
                side = 1.0
            cells: dict[tuple[int, int], list[int]] = {}
            for e, (x, y) in zip(alive.tolist(), np.floor((ends[alive] - low) / side).astype(int).tolist(), strict=True):
                cells.setdefault((x, y), []).append(e)
        x, y = (int(v) for v in np.floor((here - low) / side))
        best, found = np.inf, -1
        for r in range(RINGS + 1):
            if r == RINGS:
                alive = alive[left[alive // 2]]
                near = alive
            else:
                ring = [(x + i, y + j) for i in range(-r, r + 1) for j in (range(-r, r + 1) if abs(i) == r else (-r, r))]
                near = []
                for c in ring:
                    if (own := cells.get(c)) is not None:
                        own[:] = [e for e in own if left[e // 2]]
                        near.extend(own)
                near = np.array(sorted(near), int)
            if len(near):
                d = apart(ends[near], here)
                k = int(d.argmin())
                if (d[k], near[k]) < (best, found):
                    best, found = float(d[k]), int(near[k])
            # a little less than r cells, for rounding
            if found >= 0 and best < (r - 0.001) * side:
                break
        i, flip = divmod(found, 2)
        order.append(i)
        flips.append(bool(flip))
        left[i] = False
        here = heads[i] if flip else tails[i]
    return order, flips


def within(places: np.ndarray, points: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, point) that lie within the place's radius, and some more.

    Places of like radius look into nine cells of a grid as wide as the radius; pairs come
    in pieces of about ``PAIRS``.
    """
    asking = np.isfinite(radius) & (radius > 0)
    level = np.ceil(np.log2(np.maximum(np.where(asking, radius, 1.0), 1e-9))).astype(int)
    for lv in np.unique(level[asking]) if len(points) else ():
        asks = np.flatnonzero((level == lv) & asking)
        side = 2.0 ** float(lv)
        low = np.minimum(points.min(0), places[asks].min(0)) - 2 * side
        at, own = (np.floor((p - low) / side).astype(np.int64) for p in (points, places[asks]))
        width = int(max(at[:, 1].max(), own[:, 1].max())) + 3
        keys = at[:, 0] * width + at[:, 1]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        for dx in (-1, 0, 1):
            row = (own[:, 0] + dx) * width + own[:, 1]
            first, last = np.searchsorted(keys, row - 1, "left"), np.searchsorted(keys, row + 1, "right")
            sums = np.cumsum(last - first)
            begin = 0
            while begin < len(asks):
                done = int(sums[begin - 1]) if begin else 0
                end = max(begin + 1, int(np.searchsorted(sums, done + PAIRS, "right")))
                many = (last - first)[begin:end]
                ask = np.repeat(np.arange(begin, end), many)
                hit = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[begin:end], many)
                yield asks[ask], order[hit]
                begin = end


def gaining(a: np.ndarray, b: np.ndarray, ends: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, less) of all reversals of i..j that save more than ``gain``, in order.

    Reversing replaces the ways before i and after j by two others. It can only save if
    the new way to j's end is shorter than the one before i was, or the new way after i's
    head is shorter than the one after j was; so only pairs are looked at in which one of
    these lies within the length of the old way.
    """
    n = len(a)
    before, after = apart(ends, a), np.append(apart(b[:-1], a[1:]), 0.0)
    slack = 1 + 1e-9
    found = []

    def look(i: np.ndarray, j: np.ndarray) -> None:
        good = j > i
        i, j = i[good], j[good]
        rest = np.minimum(j + 1, n - 1)
        less = before[i] + after[j] - (apart(ends[i], b[j]) + np.where(j + 1 < n, apart(a[i], a[rest]), 0.0))
        good = less > gain
        found.append((i[good], j[good], less[good]))

    if n <= ALL_PAIRS:
        look(*np.triu_indices(n, 1))
    else:
        # what lies nowhere saves nothing
        at_a, at_b, at_e = (np.flatnonzero(np.isfinite(p).all(1)) for p in (a, b, ends))
        for i, j in within(ends[at_e], b[at_b], before[at_e] * slack):
            look(at_e[i], at_b[j])
        at_j = at_a[at_a > 0] - 1
        for j, i in within(a[at_j + 1], a[at_a], after[at_j] * slack):
            look(at_a[i], at_j[j])
    i, j, less = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
    _, first = np.unique(i * n + j, return_index=True)
    return i[first], j[first], less[first]


def two_opt(a: np.ndarray, b: np.ndarray, start: np.ndarray, passes: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Order and flips that lower the pen-up way by reversing stretches; the end stays open.

    In a pass the pairs (i, j) are scanned in order and a later one must beat the best so far by ``gain``.
    """
    n = len(a)
    order, flip = np.arange(n), np.zeros(n, bool)
    for _ in range(passes):
        i, j, less = gaining(a, b, np.vstack([start, b[:-1]]), gain)
        if not len(i):
            break
        best, more = 0.0, np.arange(len(i))
        while len(more):
            at, best = more[0], less[more[0]]
            more = more[1:][less[more[1:]] > best + gain]
        s = slice(int(i[at]), int(j[at]) + 1)
        a[s], b[s] = b[s][::-1].copy(), a[s][::-1].copy()
        order[s], flip[s] = order[s][::-1].copy(), ~flip[s][::-1]
    return order, flip


def ordered(heads: np.ndarray, tails: np.ndarray, start: np.ndarray, method: str, passes: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """Order and flips of one drawing's paths."""
    order, flips = (np.array(v) for v in nearest(heads, tails, start))
    if method == "two_opt" and len(order) >= 3:
        f = flips[:, None]
        more, turn = two_opt(np.where(f, tails[order], heads[order]), np.where(f, heads[order], tails[order]), start, passes, gain)
        order, flips = order[more], flips[more] ^ turn
    return order, flips


def ordered_many(heads: np.ndarray, tails: np.ndarray, start: np.ndarray, method: str, passes: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """``ordered`` for drawings of n paths each, all at once: (drawings, n, 2) in, (drawings, n) out."""
    many, n = heads.shape[:2]
    rows = np.arange(many)
    ends = np.stack([heads, tails], 2).reshape(many, 2 * n, 2)
    ways = apart(np.concatenate([ends, np.broadcast_to(start, (many, 1, 2))], 1)[:, :, None], ends[:, None])
    here, used = np.full(many, 2 * n), np.zeros((many, 2 * n), bool)
    order, flips = np.zeros((many, n), int), np.zeros((many, n), bool)
    for k in range(n):
        i, flip = np.divmod(np.where(used, np.inf, ways[rows, here]).argmin(1), 2)
        order[:, k], flips[:, k] = i, flip
        used[rows, 2 * i] = used[rows, 2 * i + 1] = True
        here = 2 * i + 1 - flip
    if method == "two_opt" and n >= 3:
        f = flips[..., None]
        head, tail = (np.take_along_axis(p, order[..., None], 1) for p in (heads, tails))
        more, turn = two_opt_many(np.where(f, tail, head), np.where(f, head, tail), start, passes, gain)
        order, flips = np.take_along_axis(order, more, 1), np.take_along_axis(flips, more, 1) ^ turn
    return order, flips


def two_opt_many(a: np.ndarray, b: np.ndarray, start: np.ndarray, passes: int, gain: float) -> tuple[np.ndarray, np.ndarray]:
    """``two_opt`` for drawings of n paths each, all at once."""
    many, n = a.shape[:2]
    order, flip = np.tile(np.arange(n), (many, 1)), np.zeros((many, n), bool)
    i, j = np.triu_indices(n, 1)
    rest, open_, place = np.minimum(j + 1, n - 1), np.arange(many), np.arange(n)
    for _ in range(passes):
        p, q = a[open_], b[open_]
        ends = np.concatenate([np.broadcast_to(start, (len(p), 1, 2)), q[:, :-1]], 1)
        before, after = apart(ends, p), np.concatenate([apart(q[:, :-1], p[:, 1:]), np.zeros((len(p), 1))], 1)
        less = before[:, i] + after[:, j] - (apart(ends[:, i], q[:, j]) + np.where(j + 1 < n, apart(p[:, i], p[:, rest]), 0.0))
        best, at = np.zeros(len(p)), np.full(len(p), -1)
        for k in range(len(i)):
            more = less[:, k] > best + gain
            best[more], at[more] = less[more, k], k
        found = at >= 0
        open_, at, p, q = open_[found], at[found], p[found], q[found]
        if not len(open_):
            break
        low, high = i[at][:, None], j[at][:, None]
        inside = (place >= low) & (place <= high)
        turn = np.where(inside, low + high - place, place)
        p, q = (np.take_along_axis(v, turn[..., None], 1) for v in (p, q))
        a[open_], b[open_] = np.where(inside[..., None], q, p), np.where(inside[..., None], p, q)
        order[open_] = np.take_along_axis(order[open_], turn, 1)
        flip[open_] = np.take_along_axis(flip[open_], turn, 1) ^ inside
    return order, flip


def turned(points: pa.ListArray, flips: np.ndarray) -> pa.ListArray:
    """The lists, those of ``flips`` the other way round."""
    sizes = np.asarray(points.value_lengths())
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum())
    place = np.where(flips[owner], 2 * begins[owner] + sizes[owner] - 1 - place, place)
    return pa.ListArray.from_arrays(pa.array(np.append(begins, sizes.sum()), pa.int32()), points.flatten().take(pa.array(place)))


def order_paths(paths: DataFrame, method: str = "nearest_neighbor", start: tuple[float, float] = (0.0, 0.0), passes: int = 8, gain: float = 0.01) -> DataFrame:
    """(drawing_id, path_id, pos, flipped, points) by ``nearest_neighbor`` or ``two_opt``; empty paths go."""
    if method not in ("nearest_neighbor", "two_opt"):
        raise ValueError(f"unknown ordering: {method}")

    def run(table: pa.Table) -> pa.Table:
        points = table.column("points").combine_chunks()
        sizes = np.asarray(points.value_lengths())
        begins = np.cumsum(sizes) - sizes
        x, y = (points.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        heads, tails = (np.stack([x[at], y[at]], 1).astype(float) for at in (begins, begins + sizes - 1))
        first = np.flatnonzero(changes(table.column("drawing_id"))[0])
        many = np.diff(np.append(first, len(sizes)))
        order, flips = np.zeros(len(sizes), int), np.zeros(len(sizes), bool)
        for n in np.unique(many):
            if n > SMALL:
                for at in first[many == n]:
                    own = slice(at, at + n)
                    order[own], flips[own] = ordered(heads[own], tails[own], np.array(start), method, passes, gain)
                    order[own] += at
                continue
            least = max(1, PAIRS // int(2 * n * (2 * n + 1)))
            for k in range(0, int((many == n).sum()), least):
                own = first[many == n][k : k + least, None] + np.arange(n)
                some, turn = ordered_many(heads[own], tails[own], np.array(start, float), method, passes, gain)
                order[own], flips[own] = some + own[:, :1], turn
        rows, pos = table.take(pa.array(order)), np.arange(len(order)) - np.repeat(first, many)
        out = [rows.column("drawing_id"), rows.column("path_id"), pa.array(pos), pa.array(flips), turned(points.take(pa.array(order)), flips)]
        return pa.table(out, names=["drawing_id", "path_id", "pos", "flipped", "points"])

    full = paths.filter(F.size("points") > 0).select("drawing_id", "path_id", "points")
    return on_drawings(full, "path_id", run, SCHEMA)
