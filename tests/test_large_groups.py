"""Operators that were one task for a drawing or an image, against plain versions, and on large ones."""

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from strokemill.operators import greedy, kernels, loops, ordering, raster, strokes, tiles

PIXELS = "image_id bigint, y bigint, x bigint"
PATHS = "drawing_id bigint, path_id bigint, points array<struct<x:double,y:double>>"


# -- plain versions


def walked(pixels):
    have = set(pixels)
    near = {p: [q for dy, dx in tiles.AROUND if (q := (p[0] + dy, p[1] + dx)) in have] for p in have}
    nodes = {p for p in have if len(near[p]) not in (0, 2)}
    used, out = set(), []
    for group in (sorted(nodes), sorted(have)):
        for p in group:
            for q in near[p]:
                if frozenset((p, q)) in used:
                    continue
                path = [p, q]
                used.add(frozenset((p, q)))
                while path[-1] not in nodes:
                    r = next((r for r in near[path[-1]] if frozenset((path[-1], r)) not in used), None)
                    if r is None:
                        break
                    used.add(frozenset((path[-1], r)))
                    path.append(r)
                out.append(path)
    return out


def eroded(pixels):
    left, out = set(pixels), set()
    cross = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
    while left:
        small = {(y, x) for y, x in left if all((y + a, x + b) in left for a, b in cross)}
        out |= left - {(y + a, x + b) for y, x in small for a, b in cross}
        left = small
    return out


def filled(pixels):
    """Components by flood fill, numbered by their first pixels."""
    label, n = {}, 0
    for p in sorted(pixels):
        if p in label:
            continue
        n += 1
        label[p], todo = n, [p]
        while todo:
            y, x = todo.pop()
            for dy, dx in tiles.AROUND:
                q = (y + dy, x + dx)
                if q in pixels and q not in label:
                    label[q] = n
                    todo.append(q)
    return label


def noise(seed, h, w, part, y0=0, x0=0):
    rnd = random.Random(seed)
    return {(y + y0, x + x0) for y in range(h) for x in range(w) if rnd.random() < part}


def spiral(n):
    """One long chain of single pixels that winds through n x n."""
    out, y, x, dy, dx, left, turn = [], 0, 0, 0, 1, n - 1, 0
    while left > 1:
        for _ in range(left):
            out.append((y, x))
            y, x = y + dy, x + dx
        dy, dx, turn = dx, -dy, turn + 1
        if turn >= 3 and turn % 2:
            left -= 2
    return set(out)


def ring(n, y0, x0):
    return {(y0 + y, x0 + x) for y in range(n) for x in range(n) if (y in (0, n - 1)) != (x in (0, n - 1))}


SHAPES = {
    1: noise(1, 20, 20, 0.35),
    2: noise(2, 24, 17, 0.2, -7, -5),
    3: spiral(24),
    4: ring(14, -3, 2) | ring(5, 1, 6) | {(30, 30)},
    5: ring(6, 1, 1) | {(7, 7), (8, 8), (9, 9), (8, 20), (8, 21)},
    6: {(y, x) for y in range(9) for x in range(13)} | noise(3, 9, 9, 0.5, 5, 9),
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(i, y, x) for i, s in SHAPES.items() for y, x in s]
    # repeated pixels and incomplete ones count for nothing
    return spark.createDataFrame(rows + rows[:5] + [(1, None, 3), (None, 1, 1)], PIXELS)


@pytest.mark.parametrize("tile", [6, 64])
def test_components_of_any_tile_are_flood_fill(shapes, tile):
    got = {}
    for r in tiles.connected_components(shapes, tile).collect():
        assert got.setdefault(r.image_id, {}).setdefault((r.y, r.x), r.label) == r.label
    assert got == {i: filled(s) for i, s in SHAPES.items()}


@pytest.mark.parametrize("tile", [6, 64])
def test_walks_of_any_tile_are_the_plain_ones(shapes, tile):
    got = {}
    for r in tiles.trace_graph_paths(shapes, tile).orderBy("image_id", "path_id", "seq").collect():
        got.setdefault(r.image_id, {}).setdefault(r.path_id, []).append((r.seq, r.y, r.x))
    for i, s in SHAPES.items():
        want = walked(s)
        assert sorted(got.get(i, {})) == list(range(len(want)))
        assert [[(y, x) for _, y, x in got[i][k]] for k in range(len(want))] == want
        assert all([q for q, _, _ in path] == list(range(len(path))) for path in got[i].values())


def test_skeleton_is_that_of_repeated_erosion(shapes):
    got = {}
    for r in raster.skeletonize(shapes).collect():
        got.setdefault(r.image_id, []).append((r.y, r.x))
    assert {i: sorted(p) for i, p in got.items()} == {i: sorted(eroded(s)) for i, s in SHAPES.items()}


def test_nothing_gives_nothing(spark):
    none = spark.createDataFrame([], PIXELS)
    for f in (raster.connected_components, raster.trace_graph_paths, raster.skeletonize):
        assert f(none).collect() == []


def test_components_of_a_mask_beyond_a_task(spark):
    """20,000 x 20,000 pixels of image with bars across many tiles: one component for each group of bars that touch."""
    side, gap = 20_000, 400
    rows = spark.range(0, side, gap).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("x"))
    # every second bar is joined with the next one by a column
    posts = spark.range(0, side, 2 * gap).select(F.explode(F.sequence(F.col("id"), F.col("id") + gap)).alias("y"), F.lit(7).alias("x"))
    mask = rows.union(posts).select(F.lit(1).alias("image_id"), "y", "x")
    got = raster.component_stats(raster.connected_components(mask)).collect()
    assert len(got) == side // gap // 2
    assert {(r.width, r.height, r.area) for r in got} == {(side, gap + 1, 2 * side + gap - 1)}
    assert sorted((r.label, r.min_y) for r in got) == [(k + 1, k * 2 * gap) for k in range(len(got))]


# -- strokes


def kept_plain(points, least):
    out = points[:1]
    for p in points[1:]:
        if not math.sqrt((p[0] - out[-1][0]) ** 2 + (p[1] - out[-1][1]) ** 2) < least:
            out.append(p)
    return out


def simplified_plain(points, tolerance):
    while len(points) > 2:
        kept = [points[0]]
        for p, (bx, by) in zip(points[1:-1], points[2:]):
            ax, ay = kept[-1]
            dx, dy = bx - ax, by - ay
            square = dx * dx + dy * dy
            t = max(0.0, min(1.0, ((p[0] - ax) * dx + (p[1] - ay) * dy) / square)) if square else 0.0
            if np.hypot(p[0] - ax - t * dx, p[1] - ay - t * dy) > tolerance:
                kept.append(p)
        kept.append(points[-1])
        if len(kept) == len(points):
            break
        points = kept
    return points


def paths_of(rows):
    return kernels.Paths(pa.array([None if r is None else [{"x": x, "y": y} for x, y in r] for r in rows], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def back(own):
    return [None if r is None else [(p["x"], p["y"]) for p in r] for r in own.column().to_pylist()]


COORD = some.sampled_from([0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 10.0])
LISTS = some.lists(some.one_of(some.none(), some.lists(some.tuples(COORD, COORD), max_size=40)), max_size=5)


@settings(max_examples=200, deadline=None)
@given(rows=LISTS)
def test_kernels_are_the_plain_folds(rows):
    own = paths_of(rows)
    own.collapse(1.25)
    assert back(own) == [r and kept_plain(r, 1.25) for r in rows]
    own = paths_of(rows)
    own.simplify(0.4)
    assert back(own) == [r and simplified_plain(r, 0.4) for r in rows]


def test_kernels_are_linear():
    """A hundred thousand points of a path, all near each other, none near, or dense along a line: about a second at most."""
    n = 100_000
    rnd = np.random.default_rng(1)
    for x, y in ((rnd.random(n) * 0.1, rnd.random(n) * 0.1), (np.arange(n) * 1.0, np.zeros(n)), (np.arange(n) * 0.2, rnd.random(n)), (np.arange(n) * 0.001, np.zeros(n))):
        own = paths_of([list(zip(x.tolist(), y.tolist(), strict=True))])
        began = time.perf_counter()
        own.collapse(0.75)
        own.simplify(0.5)
        assert time.perf_counter() - began < 3


def stitched_plain(paths, tolerance):
    strokes_ = []
    for p in paths:
        if not strokes_:
            strokes_.append(list(p))
            continue
        end = strokes_[-1][-1]
        head, tail = math.dist(end, p[0]), math.dist(end, p[-1])
        if head > tolerance and tail > tolerance:
            strokes_.append(list(p))
            continue
        turned, gap = (list(p), head) if head <= tolerance else (list(p)[::-1], tail)
        strokes_[-1] += turned if gap > 0 else turned[1:]
    return strokes_


def made(spark, rows):
    return spark.createDataFrame([(d, p, [{"x": float(x), "y": float(y)} for x, y in pts]) for d, p, pts in rows], PATHS)


def test_stitching_is_the_plain_fold(spark):
    rnd = random.Random(2)
    rows = [(d, p, [(rnd.randrange(3), rnd.randrange(3)) for _ in range(rnd.randrange(1, 5))]) for d in range(8) for p in range(40)]
    got = {}
    for r in strokes.stitch_paths(made(spark, rows), 1.0).orderBy("drawing_id", "path_id").collect():
        got.setdefault(r.drawing_id, []).append([(q.x, q.y) for q in r.points])
    for d in range(8):
        assert got[d] == stitched_plain([pts for e, _, pts in rows if e == d and len(pts) > 1], 1.0)


def test_a_million_paths_of_one_drawing_are_stitched(spark):
    """A chain in which every second path is given the wrong way round, with a break after each thousand."""
    n = 1_000_000
    a = F.col("id") + F.floor(F.col("id") / 1000) * 10
    point = lambda x: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"))
    ends = F.when(F.col("id") % 2 == 0, F.array(point(a), point(a + 1))).otherwise(F.array(point(a + 1), point(a)))
    p = spark.range(n).select(F.lit(1).cast("bigint").alias("drawing_id"), F.col("id").alias("path_id"), ends.alias("points"))
    got = strokes.stitch_paths(p, 0.5).select(F.size("points").alias("n"), (F.element_at("points", -1)["x"] - F.element_at("points", 1)["x"]).alias("way"))
    assert got.groupBy("n", "way").count().collect() == [(1001, 1000.0, n // 1000)]


def test_commands_of_large_drawings_are_the_plain_ones(spark):
    rnd = random.Random(4)
    rows = [(d, p, [(rnd.choice([0, 0.2, 0.4, 3]), rnd.choice([0, 0.3, 5])) for _ in range(rnd.randrange(0, 6))]) for d in range(4) for p in range(30)] + [(9, 0, [(1, 1)])]
    got = {}
    for r in strokes.emit_commands(made(spark, rows)).orderBy("drawing_id", "seq").collect():
        got.setdefault(r.drawing_id, []).append((r.cmd, r.x, r.y, r.speed))
    for d in {r[0] for r in rows}:
        want, here = [("PEN_UP", None, None, None)], (0.0, 0.0)
        for e, _, pts in rows:
            if e != d or len(pts) < 2:
                continue
            for i, q in enumerate(pts):
                if math.dist(here, q) >= 0.5:
                    want.append(("MOVE", q[0], q[1], 35.0 if i else 60.0))
                    here = q
                if not i:
                    want.append(("PEN_DOWN", None, None, None))
            want.append(("PEN_UP", None, None, None))
        assert got[d] == want


# -- order


def two_opt_plain(a, b, start, passes, gain):
    """All pairs, one after the other."""
    a, b = [tuple(p) for p in a], [tuple(p) for p in b]
    order, flip = list(range(len(a))), [False] * len(a)

    def far(p, q):
        dx, dy = p[0] - q[0], p[1] - q[1]
        return float(np.sqrt(dx * dx + dy * dy))

    for _ in range(passes):
        best, at = 0.0, None
        for i in range(len(a) - 1):
            before = tuple(start) if i == 0 else b[i - 1]
            for j in range(i + 1, len(a)):
                old, new = far(before, a[i]), far(before, b[j])
                if j + 1 < len(a):
                    old, new = old + far(b[j], a[j + 1]), new + far(a[i], a[j + 1])
                if old - new > best + gain:
                    best, at = old - new, (i, j)
        if at is None:
            break
        s = slice(at[0], at[1] + 1)
        a[s], b[s] = b[s][::-1], a[s][::-1]
        order[s], flip[s] = order[s][::-1], [not f for f in flip[s][::-1]]
    return order, flip


@settings(max_examples=60, deadline=None)
@given(seed=some.integers(0, 10**6), n=some.integers(3, 40), grid=some.booleans(), coarse=some.booleans())
def test_two_opt_is_the_plain_one(seed, n, grid, coarse):
    rnd = np.random.default_rng(seed)
    a, b = (np.round(rnd.uniform(0, 20, (n, 2)) * rnd.choice([0.1, 1, 30], (n, 1)), 0 if coarse else 6) for _ in range(2))
    want = two_opt_plain(a, b, (0.0, 0.0), 8, 0.01)
    held = ordering.ALL_PAIRS, ordering.PAIRS
    try:
        if grid:
            ordering.ALL_PAIRS, ordering.PAIRS = 0, 7
        order, flip = ordering.two_opt(a.copy(), b.copy(), np.array([0.0, 0.0]), 8, 0.01)
    finally:
        ordering.ALL_PAIRS, ordering.PAIRS = held
    assert (order.tolist(), flip.tolist()) == want


def test_two_opt_of_a_hundred_thousand_paths():
    """Nearest neighbour and eight passes of two-opt: minutes, not days."""
    rnd = np.random.default_rng(5)
    heads = rnd.uniform(0, 2000, (100_000, 2))
    tails = heads + rnd.normal(0, 3, heads.shape)
    began = time.perf_counter()
    order, flips = ordering.nearest(heads, tails, np.zeros(2))
    f = np.array(flips)[:, None]
    a, b = np.where(f, tails[order], heads[order]), np.where(f, heads[order], tails[order])
    before = ordering.apart(np.vstack([[0, 0], b[:-1]]), a).sum()
    ordering.two_opt(a, b, np.zeros(2), 8, 0.01)
    assert ordering.apart(np.vstack([[0, 0], b[:-1]]), a).sum() < before
    assert time.perf_counter() - began < 300


# -- greedy choices and hot cells


def test_greedy_matching_is_the_sequential_one(spark):
    rnd = random.Random(11)
    rows = []
    for d in range(6):
        pairs = {tuple(sorted(rnd.sample(range(12), 2))) for _ in range(30)} | {(100 + k, 101 + k) for k in range(8)}
        rows += [(d, a, b, rnd.choice([0.5, 1.0, 2.0]) if a < 100 else float(b)) for a, b in pairs]
    edges = spark.createDataFrame(rows, "drawing_id bigint, a bigint, b bigint, score double")
    got = greedy.greedy_matching(edges.withColumn("rank", F.struct((-F.col("score")).alias("s"), "a", "b")))
    want = set()
    for d in range(6):
        used = set()
        for _, a, b, _ in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[3], r[1], r[2])):
            if not {a, b} & used:
                used |= {a, b}
                want.add((d, a, b))
    assert {tuple(r) for r in got.collect()} == want
    assert greedy.greedy_matching(edges.filter("false").withColumn("rank", F.struct("a"))).count() == 0


def test_dropping_by_earlier_is_the_sequential_one(spark):
    rnd = random.Random(12)
    rows = [(d, *sorted(rnd.sample(range(20), 2))) for d in range(6) for _ in range(40)] + [(9, k, k + 1) for k in range(9)]
    got = greedy.dropped_by_earlier(spark.createDataFrame(rows + rows[:5], "drawing_id bigint, earlier bigint, later bigint"))
    want = set()
    for d in {r[0] for r in rows}:
        for p in range(30):
            if any((d, e) not in want for x, e, q in rows if x == d and q == p):
                want.add((d, p))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def near_plain(shapes):
    out = set()
    for a in shapes:
        for b in shapes:
            if a.drawing_id != b.drawing_id or not (a.area > b.area or (a.area == b.area and a.path_id < b.path_id)):
                continue
            span = max(a.w, a.h, b.w, b.h, 1.0)
            d = math.sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2)
            gaps = [abs(p - q) / max(p, q, 1.0) for p, q in ((a.w, b.w), (a.h, b.h))]
            if b.area / a.area >= 0.72 and d <= 0.08 * span and max(gaps) <= 0.22:
                out.add((a.drawing_id, a.path_id, b.path_id))
    return out


@pytest.mark.parametrize("most", [500, 4])
def test_near_loops_are_all_found_however_cells_are_cut(spark, monkeypatch, most):
    """Loops of many sizes, a good part of them with one centre."""
    monkeypatch.setattr(loops, "CELL_LOOPS", most)
    rnd = random.Random(13)
    rows = []
    for p in range(150):
        size = rnd.choice([0.5, 1.1, 4])
        w, h = (size * rnd.uniform(1, 1.4) for _ in range(2))
        x, y = (50, 50) if p % 3 else (rnd.uniform(0, 4), rnd.uniform(-3, 3))
        rows.append((p % 2, p, [(x - w, y - h), (x + w, y - h), (x + w, y + h), (x - w, y + h), (x - w, y - h)]))
    shapes = loops.shape_of(made(spark, rows))
    got = [tuple(r)[:3] for r in loops.near_duplicate_loops(shapes).collect()]
    want = near_plain(shapes.filter("closed").collect())
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_merged_loops_are_those_of_the_sequential_choice(spark):
    rnd = random.Random(14)
    rows = []
    for p in range(60):
        w, h = 10 * rnd.uniform(1, 1.3), 10 * rnd.uniform(1, 1.3)
        x, y = rnd.choice([0, 100, 200]) + rnd.uniform(0, 2), rnd.uniform(0, 2)
        rows.append((p % 2, p, [(x - w, y - h), (x + w, y - h), (x + w, y + h), (x - w, y + h), (x - w, y - h)]))
    paths = made(spark, rows)
    shapes = {(r.drawing_id, r.path_id): r for r in loops.shape_of(paths).collect()}
    edges = sorted(loops.near_duplicate_loops(loops.shape_of(paths)).collect(), key=lambda e: (-shapes[e.drawing_id, e.a].area, e.a, -e.score, e.b))
    used, want = set(), set()
    for e in edges:
        if not {(e.drawing_id, e.a), (e.drawing_id, e.b)} & used:
            used |= {(e.drawing_id, e.a), (e.drawing_id, e.b)}
            want.add((e.drawing_id, e.a, e.b))
    got = loops.merge_duplicate_loops(paths).collect()
    assert {(r.drawing_id, r.path_id, r.merged_with) for r in got if r.merged_with is not None} == want and want
    assert {(r.drawing_id, r.path_id) for r in got if r.merged_with is None} == set(shapes) - used
    # the average of two such rings lies between them
    one = next(r for r in got if r.merged_with is not None)
    a, b = shapes[one.drawing_id, one.path_id], shapes[one.drawing_id, one.merged_with]
    xs = [q.x for q in one.points]
    assert min(a.cx - a.w, b.cx - b.w) - 1 <= min(xs) and max(xs) <= max(a.cx + a.w, b.cx + b.w) + 1
