"""Operators on strokes: paths are arrays of points; a drawing is an ordered set of paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import dist, dist_points, heading_deg, normalize_angle, page_fit
from .grouped import changes, on_drawings
from .kernels import Paths, far, last_kept

MIN_LENGTH, MIN_SEGMENT, TOLERANCE = 2.0, 0.75, 0.5


def length_of(points: Column) -> Column:
    """Sum of the distances of neighbours; 0 with fewer than two points."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), dist_points)
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, d: a + d))


def path_length(paths: DataFrame) -> DataFrame:
    return paths.withColumn("length_mm", length_of(F.col("points")))


def on_paths(paths: DataFrame, work: Callable[[Paths], None]) -> DataFrame:
    """Run ``work`` on the points of batches of paths: rows are mapped in Arrow batches, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Paths(batch.column("points"))
            work(own)
            columns = [own.column() if c == "points" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return paths.mapInArrow(run, paths.schema)


def collapse_short_segments(paths: DataFrame, least: float = MIN_SEGMENT) -> DataFrame:
    """Points at least so far from the last kept one; the first is kept. Linear in the points."""
    return on_paths(paths, lambda own: own.collapse(least))


def simplify_collinear(paths: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Passes that drop points near the line from the last kept to the next, until none is dropped."""
    return on_paths(paths, lambda own: own.simplify(tolerance))


def clean_paths(paths: DataFrame, min_length: float = MIN_LENGTH, min_segment: float = MIN_SEGMENT, tolerance: float = TOLERANCE) -> DataFrame:
    """Collapse, simplify, collapse; then drop paths that are too short. ``n_in``: points before."""

    def work(own: Paths) -> None:
        own.collapse(min_segment)
        own.simplify(tolerance)
        own.collapse(min_segment)

    out = on_paths(paths.withColumn("n_in", F.size("points")), work)
    return out.filter((F.size("points") >= 2) & (length_of(F.col("points")) >= min_length))


def cleanup_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """(drawing_id, paths and points before, after and dropped); a dropped path's points count as dropped."""

    def counted(paths: DataFrame, side: str) -> DataFrame:
        return paths.groupBy("drawing_id").agg(F.count("*").alias(f"{side}_paths"), F.sum(F.size("points")).alias(f"{side}_points"))

    out = counted(before, "input").join(counted(after, "output"), "drawing_id", "left")
    for what in ("paths", "points"):
        out = out.withColumn(f"output_{what}", F.coalesce(f"output_{what}", F.lit(0)).cast("bigint"))
        out = out.withColumn(f"dropped_{what}", F.col(f"input_{what}") - F.col(f"output_{what}"))
    return out


def stitch_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """(drawing_id, input_paths, output_paths, merged_paths) of ``stitch_paths``; paths of fewer than two points don't take part."""
    count = lambda df, name: df.groupBy("drawing_id").agg(F.count("*").alias(name))
    out = count(before.filter(F.size("points") >= 2), "input_paths").join(count(after, "output_paths"), "drawing_id")
    return out.withColumn("merged_paths", F.col("input_paths") - F.col("output_paths"))


def fit_to_page(paths: DataFrame, width: float, height: float, paper_w: float = 210.0, paper_h: float = 297.0, margin: float = 10.0) -> DataFrame:
    s, ox, oy = page_fit(F.lit(width), F.lit(height), paper_w, paper_h, margin)
    return paths.withColumn("points", F.transform("points", lambda p: F.struct((ox + p["x"] * s).alias("x"), (oy + p["y"] * s).alias("y"))))


def plan_metrics(paths: DataFrame, start_x: float = 0.0, start_y: float = 0.0, order: str = "path_id") -> DataFrame:
    """(drawing_id, num_paths, pen_up_mm, draw_mm, total_mm) over paths of two points or more, in order."""
    drawn = paths.filter(F.size("points") >= 2).select("drawing_id", order, F.element_at("points", 1).alias("a"), F.element_at("points", -1).alias("b"), length_of(F.col("points")).alias("draw"))
    before = F.lag("b").over(Window.partitionBy("drawing_id").orderBy(order))
    up = dist(F.coalesce(before["x"], F.lit(start_x)), F.coalesce(before["y"], F.lit(start_y)), F.col("a.x"), F.col("a.y"))
    return drawn.withColumn("up", up).groupBy("drawing_id").agg(F.count("*").alias("num_paths"), F.sum("up").alias("pen_up_mm"), F.sum("draw").alias("draw_mm"), (F.sum("up") + F.sum("draw")).alias("total_mm"))


def stitch_paths(paths: DataFrame, tolerance: float = TOLERANCE, order: str = "path_id") -> DataFrame:
    """(drawing_id, path_id, points): neighbours in order are joined where ends meet, reversed if need be.

    Whether a path is reversed depends on which end of the path before is free, and that on
    the one before it. So each path is a map from the turn of its predecessor (0 as given,
    1 reversed) to its own: always 0, always 1, the same, or the other one. Such maps
    compose: the turn is that of the last path with a fixed one, changed by the number of
    changes since. That is two running aggregates over the ends of the paths; points are
    gathered for each stroke only, never for a drawing.
    """
    own = paths.filter(F.size("points") >= 2).select("drawing_id", F.col(order).alias("_o"), "points")
    w = Window.partitionBy("drawing_id").orderBy("_o")
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_a", F.element_at("points", 1)).withColumn("_b", F.element_at("points", -1))
    own = own.withColumn("_pa", F.lag("_a").over(w)).withColumn("_pb", F.lag("_b").over(w))

    def meeting(end: str, at: str) -> Column:
        return dist_points(F.col(end), F.col(at))

    def turned(end: str) -> Column:
        """The turn of the path if the free end before is ``end``: a reversed path meets with its tail only."""
        return F.when(meeting(end, "_a") <= tolerance, 0).when(meeting(end, "_b") <= tolerance, 1).otherwise(0)

    first = F.col("_pa").isNull()
    own = own.withColumn("_t0", F.when(first, 0).otherwise(turned("_pb"))).withColumn("_t1", F.when(first, 0).otherwise(turned("_pa")))
    own = own.withColumn("_changes", F.sum(((F.col("_t0") == 1) & (F.col("_t1") == 0)).cast("int")).over(to_here))
    fixed = F.last(F.when(F.col("_t0") == F.col("_t1"), F.struct("_t0", "_changes")), True).over(to_here)
    own = own.withColumn("_f", fixed).withColumn("_turn", (F.col("_f._t0") + F.col("_changes") - F.col("_f._changes")) % 2)
    free = F.when(F.lag("_turn").over(w) == 1, F.col("_pa")).otherwise(F.col("_pb"))
    gap = dist_points(free, F.when(F.col("_turn") == 1, F.col("_b")).otherwise(F.col("_a")))
    own = own.withColumn("_gap", F.when(first, F.lit(None)).otherwise(gap))
    begins = F.coalesce(~(F.col("_gap") <= tolerance), F.lit(True))
    own = own.withColumn("_stroke", F.sum(begins.cast("bigint")).over(to_here) - 1)
    points = F.when(F.col("_turn") == 1, F.reverse("points")).otherwise(F.col("points"))
    # where the ends are one point, it is there once
    rest = F.when(begins | (F.col("_gap") > 0), points).otherwise(F.slice(points, 2, F.size(points) - 1))
    strokes = own.select("drawing_id", F.col("_stroke").alias("path_id"), F.struct(F.col("_o").alias("o"), rest.alias("p")).alias("r"))
    ordered = F.array_sort(F.collect_list("r"))
    return strokes.groupBy("drawing_id", "path_id").agg(F.flatten(F.transform(ordered, lambda r: r["p"])).alias("points"))


def emit_commands(
    paths: DataFrame,
    travel: float = 60.0,
    draw: float = 35.0,
    min_move: float = 0.5,
    min_draw: float = 0.5,
    start_x: float = 0.0,
    start_y: float = 0.0,
    order: str = "path_id",
) -> DataFrame:
    """(drawing_id, seq, cmd, x, y, speed) of each drawing's plan.

    The points of a drawing, from the start position on, are one sequence in which a point
    is reached if it is far enough from the last one that was: one linear kernel.
    """

    def run(table: pa.Table) -> pa.Table:
        new = changes(table.column("drawing_id"))[0]
        own = Paths(table.column("points"))
        own.take(np.repeat(own.sizes >= 2, own.sizes))
        drawn = own.sizes >= 2
        owner, sizes = (np.cumsum(new) - 1)[drawn], own.sizes[drawn]
        # the start of each drawing, then its points
        many = int(new.sum())
        of = np.repeat(owner, sizes)
        here = np.arange(len(of)) + of + 1
        total = len(of) + many
        starts = np.setdiff1d(np.arange(total), here)
        x, y = np.full(total, float(start_x)), np.full(total, float(start_y))
        x[here], y[here] = own.x, own.y
        begins = np.cumsum(sizes) - sizes
        first, last = np.zeros(len(of), int), np.zeros(len(of), int)
        first[begins] = last[begins + sizes - 1] = 1
        least = np.full(total, -np.inf)
        least[here] = np.where(first, min_move, min_draw)
        moved = last_kept(total, far(x, y, least))[here].astype(int)
        # commands of a start: PEN_UP; of a point: the move, PEN_DOWN after the first, PEN_UP after the last
        count = np.ones(total, int)
        count[here] = moved + first + last
        ends = np.cumsum(count)
        n, at = int(ends[-1]), (ends - count)[here]
        cmd = np.full(n, "MOVE", object)
        zero = (ends - count)[starts]
        cmd[zero] = "PEN_UP"
        cmd[(at + moved)[first == 1]] = "PEN_DOWN"
        cmd[(at + moved + first)[last == 1]] = "PEN_UP"
        moves = at[moved == 1]
        values = [np.full(n, np.nan) for _ in range(3)]
        for v, put in zip(values, (own.x, own.y, np.where(first, travel, draw)), strict=True):
            v[moves] = put[moved == 1]
        empty = np.ones(n, bool)
        empty[moves] = False
        each = np.diff(np.append(zero, n))
        drawing = table.column("drawing_id").take(pa.array(np.repeat(np.flatnonzero(new), each)))
        columns = [drawing, pa.array(np.arange(n) - np.repeat(zero, each)), pa.array(cmd, pa.string()), *(pa.array(v, mask=empty) for v in values)]
        return pa.table(columns, names=["drawing_id", "seq", "cmd", "x", "y", "speed"])

    schema = "drawing_id bigint, seq bigint, cmd string, x double, y double, speed double"
    return on_drawings(paths.select("drawing_id", order, "points"), order, run, schema)


def extract_strokes(commands: DataFrame, start_x: float = 0.0, start_y: float = 0.0) -> DataFrame:
    """(session_id, stroke_id, seq, x, y): points of the strokes that a command log draws.

    A pen-down that finds the pen up opens a stroke at the last target that was reached
    with the pen up (or the start); moves with the pen down follow.
    """
    w = Window.partitionBy("session_id").orderBy("seq")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = commands.filter(F.col("cmd").isin("PEN_UP", "PEN_DOWN", "MOVE"))
    rows = rows.withColumn("down", F.coalesce(F.last(F.when(F.col("cmd") != "MOVE", F.col("cmd") == "PEN_DOWN"), True).over(past), F.lit(False)))
    rows = rows.withColumn("up_at", F.last(F.when((F.col("cmd") == "MOVE") & ~F.col("down"), F.struct("x", "y")), True).over(past))
    opens = (F.col("cmd") == "PEN_DOWN") & ~F.col("down")
    rows = rows.withColumn("stroke_id", F.sum(opens.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.filter(opens | ((F.col("cmd") == "MOVE") & F.col("down")))
    return kept.select("session_id", "stroke_id", "seq", F.when(opens, F.coalesce("up_at.x", F.lit(start_x))).otherwise(F.col("x")).alias("x"), F.when(opens, F.coalesce("up_at.y", F.lit(start_y))).otherwise(F.col("y")).alias("y"))


def segment_kinematics(points: DataFrame, min_move: float = 0.5, corner: float = 30.0, forward: float = 0.0, lateral: float = 0.0) -> DataFrame:
    """Segments (session_id, stroke_id, seq): length, heading, turn, skip_draw, requires_lift, centres of the tool.

    A lift is needed if segments between were skipped, the centre has to jump, or the corner is sharp.
    """
    w = Window.partitionBy("session_id", "stroke_id").orderBy("seq")
    seg = points.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).filter("px IS NOT NULL")
    seg = seg.withColumn("length", dist(F.col("px"), F.col("py"), F.col("x"), F.col("y"))).withColumn("heading", heading_deg(F.col("px"), F.col("py"), F.col("x"), F.col("y")))
    seg = seg.withColumn("skip_draw", F.col("length") < min_move)
    r = F.radians("heading")
    ox, oy = forward * F.cos(r) + lateral * F.sin(r), lateral * F.cos(r) - forward * F.sin(r)
    seg = seg.withColumn("cx", F.col("px") - ox).withColumn("cy", F.col("py") - oy).withColumn("ex", F.col("x") - ox).withColumn("ey", F.col("y") - oy)
    seg = seg.withColumn("no", F.row_number().over(w))
    drawn = seg.filter(~F.col("skip_draw"))
    turn = normalize_angle(F.col("heading") - F.lag("heading").over(w))
    gap = dist(F.lag("ex").over(w), F.lag("ey").over(w), F.col("cx"), F.col("cy"))
    skipped = F.col("no") - F.lag("no").over(w) > 1
    return drawn.select("session_id", "stroke_id", "seq", "length", "heading", F.coalesce(turn, F.lit(0.0)).alias("turn"), "cx", "cy", "ex", "ey", F.coalesce(skipped | (gap > max(0.25, min_move)) | (F.abs(turn) >= corner), F.lit(False)).alias("requires_lift"))


def action_table(segments: DataFrame, min_turn: float = 1.0, mm_per_unit: float = 10.0, min_move: float = 0.5, min_units: float = 0.0, places: int | None = 2) -> DataFrame:
    """(session_id, stroke_id, seq, k, op, value): lift, turn, lower, straight for each segment, at ideal positions.

    Values are rounded to ``places`` (null: not at all).
    """
    w = Window.partitionBy("session_id", "stroke_id").orderBy("seq")
    first = F.row_number().over(w) == 1
    rounded = lambda c: c if places is None else F.round(c, places)
    units = rounded(F.greatest(F.col("length"), F.lit(max(min_move, min_units * mm_per_unit))) / mm_per_unit)
    row = lambda ok, op, v: F.when(ok, F.struct(F.lit(op).alias("op"), v.cast("double").alias("value")))
    none = F.lit(None)
    rows = F.array_compact(F.array(row(F.col("requires_lift"), "PU", none), row(F.abs("turn") >= min_turn, "TR", rounded(F.col("turn"))), row(F.col("first") | F.col("requires_lift"), "PD", none), row(F.lit(True), "ST", units)))
    return segments.withColumn("first", first).select("session_id", "stroke_id", "seq", F.posexplode(rows).alias("k", "a")).select("session_id", "stroke_id", "seq", "k", "a.op", "a.value")


def action_counts(actions: DataFrame) -> DataFrame:
    """(session_id, n_actions, strokes, lifts, lowers, turns, straights, turned, units): what a session's action table holds."""
    many = lambda op: F.count_if(F.col("op") == op)
    total = lambda op, v: F.coalesce(F.sum(F.when(F.col("op") == op, v)), F.lit(0.0))
    return actions.groupBy("session_id").agg(
        F.count("*").alias("n_actions"),
        F.countDistinct("stroke_id").alias("strokes"),
        many("PU").alias("lifts"),
        many("PD").alias("lowers"),
        many("TR").alias("turns"),
        many("ST").alias("straights"),
        total("TR", F.abs("value")).alias("turned"),
        total("ST", F.col("value")).alias("units"),
    )


def view_bounds(paths: DataFrame, width: float = 210.0, height: float = 297.0) -> DataFrame:
    """Bounding box of each drawing, padded by max(8, 4 % of its shorter side), inside the page."""
    p = paths.select("drawing_id", F.explode("points").alias("p"))
    box = p.groupBy("drawing_id").agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))
    pad = F.greatest(F.lit(8.0), F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * 0.04)
    return box.select("drawing_id", F.greatest(F.lit(0.0), F.col("x0") - pad).alias("left"), F.greatest(F.lit(0.0), F.col("y0") - pad).alias("top"), F.least(F.lit(width), F.col("x1") + pad).alias("right"), F.least(F.lit(height), F.col("y1") + pad).alias("bottom"))
