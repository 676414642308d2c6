"""Raster work by tiles: an image may be larger than a task.

Pixels are dealt by (image, tile); what a task does there is bounded by the tile's area,
whatever the image's. Results are joined along the seams: only pixels on the border of a
tile take part in that, and where no image reaches beyond one tile nothing is joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written

#: Width and height of a tile; of one whose steps are listed, up to eight for a pixel.
TILE, WALK_TILE = 1024, 256
#: Neighbours in the order in which walks try them.
AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
#: A pixel as one number that sorts by (y, x).
HALF, SHIFT = 1 << 31, 1 << 32


def packed(y: Column, x: Column) -> Column:
    return y * F.lit(SHIFT) + x + F.lit(HALF)


def row_of(p: Column) -> Column:
    return F.shiftright(p, 32)


def column_of(p: Column) -> Column:
    return p.bitwiseAND(F.lit(SHIFT - 1)) - F.lit(HALF)


def placed(pixels: DataFrame) -> DataFrame:
    """(image_id, y, x) of the pixels that have all three."""
    own = pixels.select("image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))
    return own.dropna()


def merged(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component under the links a-b, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def runs(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted pixels: the run of each, and the first pixel of each run's component."""
    begin = np.ones(len(y), bool)
    begin[1:] = (np.diff(y) != 0) | (np.diff(x) != 1)
    run = np.cumsum(begin) - 1
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(y)) - 1
    width = int(x.max() - x.min()) + 4
    row = (y[first] - y.min()) * width + 1 - x.min()
    starts, ends = row + x[first], row + x[last]
    # runs of the row above that touch this one, corners included
    low = np.searchsorted(ends, starts - width - 1, "left")
    high = np.maximum(low, np.searchsorted(starts, ends - width + 1, "right"))
    many = high - low
    below = np.repeat(np.arange(len(first)), many)
    above = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return run, first, merged(len(first), below, above)


def label_tile(key: tuple, table: pa.Table) -> pa.Table:
    """The pixels of a tile with ``root``: the first pixel of the component inside the tile."""
    code = np.unique(table.column("p").to_numpy())
    y, x = code >> 32, (code & (SHIFT - 1)) - HALF
    run, first, root = runs(y, x)
    keys = [pa.array(np.full(len(code), k.as_py())) for k in key]
    return pa.table([keys[0], pa.array(y), pa.array(x), *keys[1:], pa.array(code[first[root[run]]])], names=["image_id", "y", "x", "ty", "tx", "root"])


def in_tiles(pixels: DataFrame, tile: int) -> DataFrame:
    own = placed(pixels).withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    return own.select("image_id", "ty", "tx", packed(F.col("y"), F.col("x")).alias("p"))


def on_seam(tile: int) -> Column:
    dy, dx = F.pmod("y", F.lit(tile)), F.pmod("x", F.lit(tile))
    return dy.isin(0, tile - 1) | dx.isin(0, tile - 1)


def graph_components(edges: DataFrame) -> DataFrame:
    """(image_id, node, label): the smallest node of each component of the written edges (image_id, a, b).

    Each round a node takes the smallest label around it and then the label of its label, so
    rounds grow with the logarithm of a component's width; each is written.
    """
    both = edges.select("image_id", "a", "b").union(edges.select("image_id", F.col("b"), F.col("a")))
    labels = written(both.groupBy("image_id", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), ["image_id", "b"])
        near = around.groupBy("image_id", F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, ["image_id", "node"]).select("image_id", "node", "label", F.least("label", "near").alias("mid"))
        jump = labels.select("image_id", F.col("node").alias("mid"), F.col("label").alias("far"))
        new = step.join(jump, ["image_id", "mid"]).select("image_id", "node", F.least("mid", "far").alias("new"), "label")
        new = written(new, "labels")
        labels = new.select("image_id", "node", F.col("new").alias("label"))
        if not new.filter("new < label").limit(1).count():
            return labels


def numbered(roots: DataFrame, by: list[str], band: Column, bands: str = "_band") -> DataFrame:
    """``roots`` with ``number`` (from 1) inside its image by ``by``; ``band`` grows with ``by``.

    Ranks are counted inside a band, after the counts of the bands before it, so no task
    sorts an image.
    """
    own = roots.withColumn(bands, band)
    w = Window.partitionBy("image_id").orderBy(bands)
    before = own.groupBy("image_id", bands).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    rank = F.row_number().over(Window.partitionBy("image_id", bands).orderBy(*by))
    return own.withColumn("_rank", rank).join(before.drop("_n"), ["image_id", bands]).withColumn("number", F.col("_before") + F.col("_rank")).drop(bands, "_rank", "_before")


def connected_components(set_pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, y, x, label): 8-connected; labels go by the first pixel in (y, x) order.

    Runs of set pixels are merged inside tiles; components of two tiles that touch across a
    seam are links of a graph of (component in tile), whose components name the whole ones.
    """
    schema = "image_id bigint, y bigint, x bigint, ty bigint, tx bigint, root bigint"
    local = written(in_tiles(set_pixels, tile).groupBy("image_id", "ty", "tx").applyInArrow(label_tile, schema), "labelled-tiles")
    # pixels of a seam meet the four neighbours that come before them, in other tiles
    border = local.filter(on_seam(tile))
    steps = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in AROUND[:4])))
    ahead = border.select("image_id", "y", "x", "ty", "tx", F.col("root").alias("a"), steps.alias("s"))
    ahead = ahead.select("image_id", "ty", "tx", "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    ahead = ahead.filter((F.floor(F.col("y") / tile) != F.col("ty")) | (F.floor(F.col("x") / tile) != F.col("tx")))
    met = ahead.drop("ty", "tx").join(border.select("image_id", "y", "x", F.col("root").alias("b")), ["image_id", "y", "x"])
    edges = written(met.select("image_id", "a", "b").distinct(), "seams")
    parts = local.select("image_id", "ty", "tx", "root").distinct()
    if edges.limit(1).count():
        whole = graph_components(edges).withColumnRenamed("node", "root")
        parts = written(parts.join(whole, ["image_id", "root"], "left").withColumn("whole", F.coalesce("label", "root")).drop("label"), "parts")
    else:
        parts = parts.withColumn("whole", F.col("root"))
    names = numbered(parts.select("image_id", "whole").distinct(), ["whole"], F.shiftright("whole", 38))
    names = names.select("image_id", "whole", F.col("number").alias("label"))
    labels = parts.join(names, ["image_id", "whole"]).select("image_id", "ty", "tx", "root", "label")
    # a tile's part of a component is at most the tile: no key is larger
    return local.join(labels, ["image_id", "ty", "tx", "root"]).select("image_id", "y", "x", F.col("label").cast("bigint").alias("label"))


# -- walks along pixels


def chase(head: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """List ranking: where the pointers of each lead to (a head points to itself), and after how many steps.

    Each turn doubles the steps that a pointer covers; those on a ring never arrive, which
    ends the turns once a pointer covers more than all there are.
    """
    to, steps, covered = np.where(head, np.arange(len(head)), up), np.where(head, 0, 1), 1
    while covered <= len(head) and not head[to].all():
        to, steps, covered = to[to], steps + steps[to], covered * 2
    return to, steps


def walk_tile(tile: int):
    """Directed steps p -> q from each pixel p of a tile, with the place of each in its stretch.

    Besides its own pixels a tile gets those around it, two deep, so it knows the degree of
    all neighbours. A step follows the one that led to p if p has two neighbours; steps from
    other pixels, and the one forward step from an anchor, begin a walk. A stretch is what
    lies in the tile: ``head`` is its first step, ``entry`` the step of another tile that
    leads into it (or none).
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        image, ty, tx = (k.as_py() for k in key)
        code, first = np.unique(table.column("y").to_numpy() * SHIFT + table.column("x").to_numpy() + HALF, return_index=True)
        y, x = code >> 32, (code & (SHIFT - 1)) - HALF
        forward = table.column("forward").to_numpy()[first]
        # no larger than what is set: images are often much smaller than a tile
        y0, x0 = y.min() - 1, x.min() - 1
        at = np.full((y.max() - y0 + 2, x.max() - x0 + 2), -1)
        at[y - y0, x - x0] = np.arange(len(y))
        near = np.stack([at[y - y0 + dy, x - x0 + dx] for dy, dx in AROUND])
        degree = (near >= 0).sum(0)
        anchor = forward >= 0
        node = ~np.isin(degree, (0, 2))
        own = (y // tile == ty) & (x // tile == tx)
        k, p = np.nonzero((near >= 0) & own)
        q = near[k, p]
        number = np.full((8, len(y)), -1)
        number[k, p] = np.arange(len(p))
        # the other neighbour of a pixel with two
        sums = np.where(near >= 0, near, 0).sum(0)
        before = np.where(degree[p] == 2, sums[p] - q, -1)
        way = {(dy, dx): i for i, (dy, dx) in enumerate(AROUND)}
        grid = np.array([[way.get((dy, dx), -1) for dx in (-1, 0, 1)] for dy in (-1, 0, 1)])
        # the direction of the step that leads to p: from ``before`` to p
        lead = np.where(before >= 0, grid[np.clip(y[p] - y[before] + 1, 0, 2), np.clip(x[p] - x[before] + 1, 0, 2)], -1)
        starts = node[p] | (anchor[p] & (forward[p] == k))
        inside = ~starts & (before >= 0) & own[np.maximum(before, 0)]
        up = np.where(inside, number[np.maximum(lead, 0), np.maximum(before, 0)], np.arange(len(p)))
        head, steps = chase(~inside, up)
        ring = inside[head]
        # a ring inside the tile is known by its first pixel
        least = np.full(len(p), np.iinfo(np.int64).max)
        if ring.any():
            low, to, covered = code[p], up.copy(), 1
            while covered <= len(p):
                low, to, covered = np.minimum(low, low[to]), to[to], covered * 2
            least[ring] = low[ring]
        mine = np.full(len(p), np.iinfo(np.int64).max)
        np.minimum.at(mine, head, code[p])
        foreign = ~inside & ~starts & (before >= 0)
        entry = code[np.maximum(before, 0)]
        back = grid[y[p] - y[q] + 1, x[p] - x[q] + 1]
        cols = {
            "image_id": pa.array(np.full(len(p), image)),
            "ty": pa.array(np.full(len(p), ty)),
            "tx": pa.array(np.full(len(p), tx)),
            "p": pa.array(code[p]),
            "k": pa.array(k.astype(np.int64)),
            "q": pa.array(code[q]),
            "back": pa.array(back.astype(np.int64)),
            "ends": pa.array(node[q] | anchor[q]),
            "out": pa.array(~own[q]),
            "starts": pa.array(starts),
            "loop": pa.array(starts & ~node[p]),
            "head_p": pa.array(code[p][head]),
            "head_k": pa.array(k[head].astype(np.int64)),
            "steps": pa.array(steps.astype(np.int64)),
            "ring": pa.array(ring),
            "least": pa.array(np.where(ring, least, mine[head])),
            "entry_p": pa.array(entry[head], mask=~foreign[head]),
            "entry_k": pa.array(lead[head].astype(np.int64), mask=~foreign[head]),
        }
        return pa.table(list(cols.values()), names=list(cols))

    return run


WALK = (
    "image_id bigint, ty bigint, tx bigint, p bigint, k bigint, q bigint, back bigint, ends boolean, out boolean, starts boolean, loop boolean, "
    "head_p bigint, head_k bigint, steps bigint, ring boolean, least bigint, entry_p bigint, entry_k bigint"
)


def steps_of(pixels: DataFrame, tile: int) -> DataFrame:
    """Steps of all tiles; ``pixels`` has image_id, y, x, forward (the direction in which a walk leaves an anchor, else -1)."""
    side = lambda c: F.array_distinct(F.transform(F.array(F.lit(-2), F.lit(0), F.lit(2)), lambda d: F.floor((F.col(c) + d) / tile)))
    dealt = pixels.withColumn("ty", F.explode(side("y"))).withColumn("tx", F.explode(side("x")))
    return written(dealt.groupBy("image_id", "ty", "tx").applyInArrow(walk_tile(tile), WALK), "steps")


def stretches(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stretches with the step that begins their walk and the steps before them, rings as (image_id, first pixel)).

    A stretch that is entered from another tile points to the stretch it continues;
    pointers double until they reach a walk's first step. What doesn't get there within the
    doublings that cover all stretches goes round in a ring, and has seen all of it by then.
    """
    head = ["image_id", "head_p", "head_k"]
    heads = steps.filter("p = head_p AND k = head_k AND NOT ring").select(*head, "ty", "tx", "starts", "loop", "least", "entry_p", "entry_k")
    exits = steps.filter("out AND NOT ring").select("image_id", F.col("p").alias("entry_p"), F.col("k").alias("entry_k"), F.col("head_p").alias("to_p"), F.col("head_k").alias("to_k"), (F.col("steps") + 1).alias("dist"))
    begun = heads.filter("starts").select(*head, "ty", "tx", F.col("head_p").alias("start_p"), F.col("head_k").alias("start_k"), "loop", F.lit(0).cast("bigint").alias("dist"))
    inner = steps.filter("ring").select("image_id", F.col("least").alias("first"))
    entered = heads.filter("NOT starts")
    open_ = entered.join(exits, ["image_id", "entry_p", "entry_k"]).select(*head, "ty", "tx", "least", "to_p", "to_k", "dist", F.lit(False).alias("done"))
    open_ = written(open_, "stretches")
    many, covered = open_.count(), 1
    # a pointer to a first step has arrived
    arrived = begun.select("image_id", F.col("head_p").alias("to_p"), F.col("head_k").alias("to_k"), F.lit(True).alias("there"))
    if many:
        open_ = written(open_.drop("done").join(arrived, ["image_id", "to_p", "to_k"], "left").withColumn("done", F.coalesce("there", F.lit(False))).drop("there"), "stretches")
    while covered <= many and open_.filter("NOT done").limit(1).count():
        far = open_.select("image_id", F.col("head_p").alias("to_p"), F.col("head_k").alias("to_k"), F.struct(F.col("to_p").alias("p"), F.col("to_k").alias("k"), "dist", "least", "done").alias("far"))
        both = open_.filter("NOT done").join(far, ["image_id", "to_p", "to_k"], "left")
        more = both.select(*head, "ty", "tx", F.least("least", "far.least").alias("least"), F.col("far.p").alias("to_p"), F.col("far.k").alias("to_k"), (F.col("dist") + F.col("far.dist")).alias("dist"), F.col("far.done").alias("done"))
        open_ = written(open_.filter("done").select(more.columns).union(more), "stretches")
        covered *= 2
    loops = begun.select("image_id", F.col("head_p").alias("to_p"), F.col("head_k").alias("to_k"), "loop")
    came = open_.filter("done").join(loops, ["image_id", "to_p", "to_k"]).select(*head, "ty", "tx", F.col("to_p").alias("start_p"), F.col("to_k").alias("start_k"), "loop", "dist")
    rings = inner.union(open_.filter("NOT done").select("image_id", F.col("least").alias("first"))).distinct()
    return begun.unionByName(came), rings


def trace_graph_paths(set_pixels: DataFrame, tile: int = WALK_TILE) -> DataFrame:
    """(image_id, path_id, seq, y, x): walks from nodes in (y, x) order, then the loops that are left, closed.

    Every chain of pixels with two neighbours is walked once, from the end that comes first
    by pixel and direction. Places along chains come from list ranking inside tiles and
    pointer doubling over the stretches that cross seams. Rings without a node are found in
    a first pass; their first pixels become anchors of a second one, from which the walk
    leaves towards the first neighbour and comes back.
    """
    own = placed(set_pixels)
    pixels = own.withColumn("forward", F.lit(-1).cast("bigint"))
    steps = steps_of(pixels, tile)
    parts, rings = stretches(steps)
    rings = written(rings, "rings")
    if rings.limit(1).count():
        ways = steps.groupBy("image_id", F.col("p").alias("first")).agg(F.min("k").alias("way")).join(rings, ["image_id", "first"])
        anchors = ways.select("image_id", row_of(F.col("first")).alias("y"), column_of(F.col("first")).alias("x"), "way")
        pixels = own.join(anchors, ["image_id", "y", "x"], "left").withColumn("forward", F.coalesce("way", F.lit(-1)).cast("bigint")).drop("way")
        steps = steps_of(pixels, tile)
        parts, _ = stretches(steps)
    parts = written(parts, "walks")
    # a walk's last step, turned round, is the first of the same chain from its other end
    stretch = ["image_id", "ty", "tx", "head_p", "head_k"]
    last = steps.filter("ends").select(*stretch, "q", "back").join(parts, stretch)
    forth = F.struct("start_p", "start_k") <= F.struct(F.col("q").alias("start_p"), F.col("back").alias("start_k"))
    walks = last.filter(F.col("loop") | forth).select("image_id", "start_p", "start_k", "loop")
    band = F.when(F.col("loop"), F.lit(1 << 40)).otherwise(0) + F.shiftright("start_p", 38)
    named = numbered(walks, ["start_p", "start_k"], band)
    named = named.select("image_id", "start_p", "start_k", (F.col("number") - 1).cast("bigint").alias("path_id"))
    own_parts = parts.join(named, ["image_id", "start_p", "start_k"]).select(*stretch, "path_id", "dist")
    seen = steps.join(own_parts, stretch).withColumn("seq", F.col("dist") + F.col("steps"))
    point = lambda c, seq: F.struct(seq.cast("bigint").alias("seq"), row_of(F.col(c)).alias("y"), column_of(F.col(c)).alias("x"))
    points = F.when(F.col("ends"), F.array(point("p", F.col("seq")), point("q", F.col("seq") + 1))).otherwise(F.array(point("p", F.col("seq"))))
    return seen.select("image_id", "path_id", F.explode(points).alias("o")).select("image_id", "path_id", "o.seq", "o.y", "o.x")


# -- skeleton


def skeletonize(set_pixels: DataFrame) -> DataFrame:
    """(image_id, y, x): what opening with a cross leaves over, while the shape is eroded away.

    A pixel is there after k erosions if its distance to the background, in steps along
    rows and columns, is more than k; the opening of that gives it back if a neighbour is
    further away still. So what is left over are the pixels whose four neighbours are no
    further from the background than they are. The distance is taken in two passes: along
    the runs of a column, then along the runs of a row; all are windows over one row or
    column of one image.
    """
    along = Window.partitionBy("image_id", "x").orderBy("y")
    own = placed(set_pixels).withColumn("_r", F.lag("y").over(along)).filter("_r IS NULL OR _r <> y")
    own = own.withColumn("_r", F.col("y") - F.row_number().over(along))
    run = Window.partitionBy("image_id", "x", "_r")
    own = own.withColumn("_g", F.least(F.col("y") - F.min("y").over(run), F.max("y").over(run) - F.col("y")) + 1)
    across = Window.partitionBy("image_id", "y").orderBy("x")
    own = own.withColumn("_r", F.col("x") - F.row_number().over(across))
    run = Window.partitionBy("image_id", "y", "_r")
    left = run.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    right = run.orderBy("x").rowsBetween(0, Window.unboundedFollowing)
    near = [
        F.col("x") + F.min(F.col("_g") - F.col("x")).over(left),
        F.min(F.col("_g") + F.col("x")).over(right) - F.col("x"),
        F.col("x") - F.min("x").over(run) + 1,
        F.max("x").over(run) - F.col("x") + 1,
    ]
    own = own.withColumn("_d", F.least(*near))

    def beside(c: str, w: Window) -> Column:
        """The larger distance of the two neighbours along ``c``; 0 where there is none."""
        there = lambda get, step: F.when(get(c).over(w) == F.col(c) + step, get("_d").over(w))
        return F.greatest(F.coalesce(there(F.lag, -1), F.lit(0)), F.coalesce(there(F.lead, 1), F.lit(0)))

    own = own.withColumn("_h", beside("x", across)).withColumn("_v", beside("y", along))
    return own.filter("_d >= _h AND _d >= _v").select("image_id", "y", "x")
