"""Queries of the engine's own operators over the given tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import geom, text
from .operators import curation as cu
from .operators import experiments as ex
from .operators import generate as ge
from .operators import loops as lo
from .operators import ordering as od
from .operators import raster as ra
from .operators import strokes as st
from .plans import drawing
from .sources import files, live, manifest
from .streaming import commands as sc
from .tables import shared_folder, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            # DuckDB's count_if is a HUGEINT; a filtered count is a BIGINT
            ORACLE[name] = " ".join(sql.split()).replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return put


def view(name: str):
    sql = getattr(fx, name)
    return (lambda s, d: fx.spark_view(s, d, sql)), fx.duck(sql)


polylines, POLY = view("POLYLINES")
sessions, SESS = view("SESSIONS")
tracked, TRACKED = view("TRACKED")
grid, GRID = view("GRID")
runs, RUNS = view("RUNS")
observations, OBS = view("OBSERVATIONS")
histories, HIST = view("HISTORIES")
images, IMAGES = view("IMAGES")
masks, MASKS = view("MASKS")


def paths(s: SparkSession, d: str) -> DataFrame:
    return fx.paths(polylines(s, d))


def r(c, n=4):
    return F.round(c, n).alias(c) if isinstance(c, str) else F.round(c, n)


D = "sqrt((x - px) * (x - px) + (y - py) * (y - py))"
LAGGED = f"(SELECT *, lag(x) OVER (PARTITION BY drawing_id, path_id ORDER BY seq) AS px, lag(y) OVER (PARTITION BY drawing_id, path_id ORDER BY seq) AS py FROM {POLY} p)"
ENDS = f"(SELECT drawing_id, path_id, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_max(x, seq) AS bx, arg_max(y, seq) AS b_y, count(*) AS n, sum(CASE WHEN px IS NULL THEN 0 ELSE {D} END) AS draw FROM {LAGGED} q GROUP BY ALL)"

# ------------------------------------------------------------------ strokes


@query("path_length", f"SELECT drawing_id, path_id, n AS n_points, round(draw, 4) AS length_mm FROM {ENDS} e")
def path_length(s, d):
    return st.path_length(paths(s, d)).select("drawing_id", "path_id", F.size("points").cast("bigint").alias("n_points"), r("length_mm"))


@query(
    "plan_metrics",
    f"""WITH e AS (SELECT *, lag(bx) OVER (PARTITION BY drawing_id ORDER BY path_id) AS lx, lag(b_y) OVER (PARTITION BY drawing_id ORDER BY path_id) AS ly FROM {ENDS} z WHERE n >= 2)
 SELECT drawing_id, count(*) AS num_paths, round(sum(sqrt((ax - coalesce(lx, 0)) * (ax - coalesce(lx, 0)) + (ay - coalesce(ly, 0)) * (ay - coalesce(ly, 0)))), 4) AS pen_up_mm, round(sum(draw), 4) AS draw_mm FROM e GROUP BY drawing_id""",
)
def plan_metrics(s, d):
    return st.plan_metrics(paths(s, d)).select("drawing_id", "num_paths", r("pen_up_mm"), r("draw_mm"))


COLLAPSE = f"""WITH RECURSIVE p AS (SELECT drawing_id, path_id, CAST(seq AS BIGINT) AS seq, x, y FROM {POLY} z),
 k AS (SELECT drawing_id, path_id, seq, x, y, x AS kx, y AS ky, true AS kept FROM p WHERE seq = 1 UNION ALL
 SELECT p.drawing_id, p.path_id, p.seq, p.x, p.y, CASE WHEN sqrt((p.x - k.kx) * (p.x - k.kx) + (p.y - k.ky) * (p.y - k.ky)) >= {{t}} THEN p.x ELSE k.kx END, CASE WHEN sqrt((p.x - k.kx) * (p.x - k.kx) + (p.y - k.ky) * (p.y - k.ky)) >= {{t}} THEN p.y ELSE k.ky END,
 sqrt((p.x - k.kx) * (p.x - k.kx) + (p.y - k.ky) * (p.y - k.ky)) >= {{t}} FROM k JOIN p ON p.path_id = k.path_id AND p.drawing_id = k.drawing_id AND p.seq = k.seq + 1)
 SELECT drawing_id, path_id, count(*) AS n_points, round(sum(x), 2) AS sum_x, round(sum(y), 2) AS sum_y FROM k WHERE kept GROUP BY drawing_id, path_id"""


@query("collapse_short_segments", COLLAPSE.replace("{t}", "10"))
def collapse_short_segments(s, d):
    p = st.collapse_short_segments(paths(s, d), 10.0)
    add = lambda c: F.round(F.aggregate("points", F.lit(0.0), lambda a, q: a + q[c]), 2)
    return p.select("drawing_id", "path_id", F.size("points").cast("bigint").alias("n_points"), add("x").alias("sum_x"), add("y").alias("sum_y"))


# points as lists {x, y}; a fold keeps a list of the points that stayed
LISTED = f"(SELECT drawing_id, path_id, list({{'x': x, 'y': y}} ORDER BY seq) AS pts FROM {POLY} z GROUP BY drawing_id, path_id)"


def collapsed_sql(pts: str, least: float) -> str:
    gap = "sqrt((e[1].x - k[-1].x) * (e[1].x - k[-1].x) + (e[1].y - k[-1].y) * (e[1].y - k[-1].y))"
    return f"list_reduce(list_transform({pts}, lambda p: [p]), lambda k, e: CASE WHEN {gap} >= {least} THEN list_concat(k, e) ELSE k END)"


def simplified_sql(source: str, tolerance: float) -> str:
    """Recursive CTE s (drawing_id, path_id, pts, open) of the passes over ``source``; where open is false, the last is done."""
    dx, dy = "(e[1].nx - k[-1].x)", "(e[1].ny - k[-1].y)"
    square = f"({dx} * {dx} + {dy} * {dy})"
    t = f"CASE WHEN {square} = 0 THEN 0 ELSE greatest(0, least(1, ((e[1].x - k[-1].x) * {dx} + (e[1].y - k[-1].y) * {dy}) / {square})) END"
    ox, oy = f"(e[1].x - k[-1].x - ({t}) * {dx})", f"(e[1].y - k[-1].y - ({t}) * {dy})"
    inner = "list_transform(range(2, len(pts)), lambda i: [{'x': pts[i].x, 'y': pts[i].y, 'nx': pts[i + 1].x, 'ny': pts[i + 1].y}])"
    begun = "list_prepend([{'x': pts[1].x, 'y': pts[1].y, 'nx': CAST(0 AS DOUBLE), 'ny': CAST(0 AS DOUBLE)}], " + inner + ")"
    kept = f"list_reduce({begun}, lambda k, e: CASE WHEN sqrt({ox} * {ox} + {oy} * {oy}) > {tolerance} THEN list_concat(k, e) ELSE k END)"
    new = f"list_append(list_transform({kept}, lambda p: {{'x': p.x, 'y': p.y}}), pts[-1])"
    return f"""s AS (SELECT drawing_id, path_id, pts, len(pts) > 2 AS open FROM {source} c UNION ALL
 SELECT drawing_id, path_id, new, len(new) < len(pts) AND len(new) > 2 FROM (SELECT drawing_id, path_id, pts, {new} AS new FROM s WHERE open) n)"""


def list_length_sql(pts: str) -> str:
    steps = f"list_transform(range(2, len({pts}) + 1), lambda i: sqrt(({pts}[i].x - {pts}[i - 1].x) ** 2 + ({pts}[i].y - {pts}[i - 1].y) ** 2))"
    return f"coalesce(list_sum({steps}), 0)"


@query(
    "simplify_collinear",
    f"WITH RECURSIVE {simplified_sql(LISTED, 2.0)} SELECT drawing_id, path_id, CAST(len(pts) AS BIGINT) AS n_points, round({list_length_sql('pts')}, 4) AS length_mm FROM s WHERE NOT open",
)
def simplify_collinear(s, d):
    p = st.simplify_collinear(paths(s, d), 2.0)
    return p.select("drawing_id", "path_id", F.size("points").cast("bigint").alias("n_points"), F.round(st.length_of(F.col("points")), 4).alias("length_mm"))


@query(
    "clean_paths",
    f"""WITH RECURSIVE c AS (SELECT drawing_id, path_id, {collapsed_sql('pts', 0.75)} AS pts FROM {LISTED} l), {simplified_sql('c', 0.5)},
 d AS (SELECT drawing_id, {collapsed_sql('pts', 0.75)} AS pts FROM s WHERE NOT open),
 o AS (SELECT drawing_id, count(*) AS paths, sum(len(pts)) AS n FROM d WHERE len(pts) >= 2 AND {list_length_sql('pts')} >= 2.0 GROUP BY drawing_id)
 SELECT drawing_id, i.paths AS input_paths, coalesce(o.paths, 0) AS output_paths, i.paths - coalesce(o.paths, 0) AS dropped_paths, CAST(i.n AS BIGINT) AS input_points, CAST(coalesce(o.n, 0) AS BIGINT) AS output_points, CAST(i.n - coalesce(o.n, 0) AS BIGINT) AS dropped_points
 FROM (SELECT drawing_id, count(*) AS n, count(DISTINCT path_id) AS paths FROM {POLY} z GROUP BY drawing_id) i LEFT JOIN o USING (drawing_id)""",
)
def clean_paths(s, d):
    before = paths(s, d)
    return st.cleanup_stats(before, st.clean_paths(before))


GAP = "sqrt((o.{x} - k.ex) * (o.{x} - k.ex) + (o.{y} - k.ey) * (o.{y} - k.ey))"
HEAD, TAIL = GAP.format(x="ax", y="ay"), GAP.format(x="bx", y="b_y")


@query(
    "stitch_paths",
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY path_id) AS i FROM {ENDS} e WHERE n >= 2),
 k AS (SELECT drawing_id, i, CAST(0 AS BIGINT) AS stroke, n AS added, bx AS ex, b_y AS ey FROM o WHERE i = 1 UNION ALL
 SELECT o.drawing_id, o.i, CASE WHEN least({HEAD}, {TAIL}) <= 5 THEN k.stroke ELSE k.stroke + 1 END, CASE WHEN {HEAD} <= 5 THEN CASE WHEN {HEAD} > 0 THEN o.n ELSE o.n - 1 END WHEN {TAIL} <= 5 THEN CASE WHEN {TAIL} > 0 THEN o.n ELSE o.n - 1 END ELSE o.n END,
 CASE WHEN {HEAD} > 5 AND {TAIL} <= 5 THEN o.ax ELSE o.bx END, CASE WHEN {HEAD} > 5 AND {TAIL} <= 5 THEN o.ay ELSE o.b_y END FROM k JOIN o ON o.drawing_id = k.drawing_id AND o.i = k.i + 1)
 SELECT drawing_id, stroke AS path_id, CAST(sum(added) AS BIGINT) AS n_points, arg_max(ex, i) AS end_x, arg_max(ey, i) AS end_y FROM k GROUP BY drawing_id, stroke""",
)
def stitch_paths(s, d):
    end = F.element_at("points", -1)
    return st.stitch_paths(paths(s, d), 5.0).select("drawing_id", "path_id", F.size("points").cast("bigint").alias("n_points"), end["x"].alias("end_x"), end["y"].alias("end_y"))


@query(
    "order_nearest",
    f"""WITH RECURSIVE c AS (SELECT drawing_id, path_id AS p, false AS f, ax AS sx, ay AS sy, bx AS ex, b_y AS ey FROM {ENDS} e UNION ALL SELECT drawing_id, path_id, true, bx, b_y, ax, ay FROM {ENDS} e),
 k AS (SELECT drawing_id, CAST(-1 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS p, false AS f, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, [CAST(-1 AS BIGINT)] AS seen FROM (SELECT DISTINCT drawing_id FROM c) d UNION ALL
 SELECT drawing_id, pos + 1, m.p, m.f, m.x, m.y, list_append(seen, m.p) FROM (SELECT k.drawing_id, pos, seen, min({{'d': sqrt((c.sx - k.x) * (c.sx - k.x) + (c.sy - k.y) * (c.sy - k.y)), 'p': c.p, 'f': c.f, 'x': c.ex, 'y': c.ey}}) AS m
 FROM k JOIN c ON c.drawing_id = k.drawing_id AND NOT list_contains(seen, c.p) GROUP BY k.drawing_id, pos, seen) z)
 SELECT drawing_id, p AS path_id, pos, f AS flipped FROM k WHERE pos >= 0""",
)
def order_nearest(s, d):
    p = od.order_paths(paths(s, d), "nearest_neighbor")
    return p.select("drawing_id", "path_id", "pos", "flipped")


@query("order_two_opt")
def order_two_opt(s, d):
    p = od.order_paths(paths(s, d), "two_opt")
    return p.select("drawing_id", "path_id", "pos", "flipped")


FAR = "sqrt((p.x - k.cx) * (p.x - k.cx) + (p.y - k.cy) * (p.y - k.cy)) >= 0.5"


@query(
    "emit_commands",
    f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY path_id, seq) AS i FROM (SELECT *, count(*) OVER (PARTITION BY drawing_id, path_id) AS n FROM {POLY} z) q WHERE n >= 2),
 k AS (SELECT drawing_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS cx, CAST(0 AS DOUBLE) AS cy, false AS moved, false AS first, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, false AS last FROM (SELECT DISTINCT drawing_id FROM {POLY} z) d UNION ALL
 SELECT p.drawing_id, p.i, CASE WHEN {FAR} THEN p.x ELSE k.cx END, CASE WHEN {FAR} THEN p.y ELSE k.cy END, {FAR}, p.seq = 1, p.x, p.y, p.seq = p.n FROM k JOIN p ON p.drawing_id = k.drawing_id AND p.i = k.i + 1),
 c AS (SELECT drawing_id, i, 0 AS j, 'PEN_UP' AS cmd, NULL AS x, NULL AS y, NULL AS speed FROM k WHERE i = 0 UNION ALL SELECT drawing_id, i, 1, 'MOVE', x, y, CASE WHEN first THEN 60 ELSE 35 END FROM k WHERE moved
 UNION ALL SELECT drawing_id, i, 2, 'PEN_DOWN', NULL, NULL, NULL FROM k WHERE first UNION ALL SELECT drawing_id, i, 3, 'PEN_UP', NULL, NULL, NULL FROM k WHERE last)
 SELECT drawing_id, row_number() OVER (PARTITION BY drawing_id ORDER BY i, j) - 1 AS seq, cmd, x, y, CAST(speed AS DOUBLE) AS speed FROM c""",
)
def emit_commands(s, d):
    return st.emit_commands(paths(s, d)).select("drawing_id", "seq", "cmd", "x", "y", "speed")


STROKES = f"""WITH c AS (SELECT * FROM {SESS} z WHERE cmd IN ('PEN_UP', 'PEN_DOWN', 'MOVE')),
 a AS (SELECT *, coalesce(last_value(CASE WHEN cmd <> 'MOVE' THEN cmd = 'PEN_DOWN' END IGNORE NULLS) OVER w, false) AS down FROM c WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 b AS (SELECT *, last_value(CASE WHEN cmd = 'MOVE' AND NOT down THEN {{{{'x': x, 'y': y}}}} END IGNORE NULLS) OVER w AS up_at, sum(CASE WHEN cmd = 'PEN_DOWN' AND NOT down THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS stroke_id FROM a WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 strokes AS (SELECT session_id, CAST(stroke_id AS BIGINT) AS stroke_id, seq, CASE WHEN cmd = 'MOVE' THEN x ELSE coalesce(up_at.x, 0) END AS x, CASE WHEN cmd = 'MOVE' THEN y ELSE coalesce(up_at.y, 0) END AS y FROM b WHERE cmd = 'MOVE' AND down OR cmd = 'PEN_DOWN' AND NOT down)""".replace("{{", "{").replace("}}", "}")


@query("extract_strokes", f"{STROKES} SELECT session_id, stroke_id, CAST(seq AS BIGINT) AS seq, round(x, 4) AS x, round(y, 4) AS y FROM strokes")
def extract_strokes(s, d):
    return st.extract_strokes(sessions(s, d)).select("session_id", F.col("stroke_id").cast("bigint"), F.col("seq").cast("bigint"), r("x"), r("y"))


KINEMATICS = f"""{STROKES}, g AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM strokes WINDOW w AS (PARTITION BY session_id, stroke_id ORDER BY seq)),
 h AS (SELECT *, {D} AS length, degrees(atan2(py - y, x - px)) AS heading, row_number() OVER (PARTITION BY session_id, stroke_id ORDER BY seq) AS no FROM g WHERE px IS NOT NULL),
 m AS (SELECT *, lag(heading) OVER w AS ph, lag(x) OVER w AS ex, lag(y) OVER w AS ey, lag(no) OVER w AS pn FROM h WHERE length >= 0.5 WINDOW w AS (PARTITION BY session_id, stroke_id ORDER BY seq)),
 n AS (SELECT *, CASE WHEN ph IS NULL THEN 0 ELSE 180 - (((180 - (heading - ph)) % 360) + 360) % 360 END AS turn FROM m)"""


@query(
    "segment_kinematics",
    f"{KINEMATICS} SELECT session_id, stroke_id, CAST(seq AS BIGINT) AS seq, round(length, 4) AS length, round(heading, 4) AS heading, round(abs(turn), 3) AS abs_turn, coalesce(no - pn > 1 OR sqrt((ex - px) * (ex - px) + (ey - py) * (ey - py)) > 0.5 OR abs(turn) >= 30, false) AS requires_lift FROM n",
)
def segment_kinematics(s, d):
    k = st.segment_kinematics(st.extract_strokes(sessions(s, d)))
    return k.select("session_id", F.col("stroke_id").cast("bigint"), F.col("seq").cast("bigint"), r("length"), r("heading"), F.round(F.abs("turn"), 3).alias("abs_turn"), "requires_lift")


LIFT = "coalesce(no - pn > 1 OR sqrt((ex - px) * (ex - px) + (ey - py) * (ey - py)) > 0.5 OR abs(turn) >= 30, false)"


@query(
    "action_table",
    f"""{KINEMATICS}, f AS (SELECT *, {LIFT} AS lift, row_number() OVER (PARTITION BY session_id, stroke_id ORDER BY seq) = 1 AS first FROM n),
 u AS (SELECT session_id, stroke_id, seq, unnest([o FOR o IN [CASE WHEN lift THEN 'PU' END, CASE WHEN abs(turn) >= 1 THEN 'TR' END, CASE WHEN first OR lift THEN 'PD' END, 'ST'] IF o IS NOT NULL]) AS op, abs(turn) AS turn, length / 10 AS units FROM f)
 SELECT session_id, stroke_id, CAST(seq AS BIGINT) AS seq, op, CASE op WHEN 'TR' THEN floor(turn * 100 + 0.25) WHEN 'ST' THEN floor(units * 100 + 0.25) END AS hundredths FROM u""",
)
def action_table(s, d):
    """All actions; values by the floor of hundredths, which two engines' last bits can't part at a half."""
    a = st.action_table(st.segment_kinematics(st.extract_strokes(sessions(s, d))), places=None)
    hundredths = F.when(F.col("op") == "TR", F.floor(F.abs("value") * 100 + 0.25)).when(F.col("op") == "ST", F.floor(F.col("value") * 100 + 0.25)).cast("double")
    return a.select("session_id", F.col("stroke_id").cast("bigint"), F.col("seq").cast("bigint"), "op", hundredths.alias("hundredths"))


@query(
    "action_counts",
    f"""{KINEMATICS}, f AS (SELECT *, {LIFT} AS lift, row_number() OVER (PARTITION BY session_id, stroke_id ORDER BY seq) = 1 AS first FROM n),
 u AS (SELECT session_id, stroke_id, unnest([o FOR o IN [CASE WHEN lift THEN 'PU' END, CASE WHEN abs(turn) >= 1 THEN 'TR' END, CASE WHEN first OR lift THEN 'PD' END, 'ST'] IF o IS NOT NULL]) AS op, abs(turn) AS turn, length / 10 AS units FROM f)
 SELECT session_id, count(*) AS n_actions, count(DISTINCT stroke_id) AS strokes, count_if(op = 'PU') AS lifts, count_if(op = 'PD') AS lowers, count_if(op = 'TR') AS turns, count_if(op = 'ST') AS straights,
 round(coalesce(sum(turn) FILTER (op = 'TR'), 0), 3) AS turned, round(coalesce(sum(units) FILTER (op = 'ST'), 0), 3) AS units FROM u GROUP BY session_id""",
)
def action_counts(s, d):
    """Counts and totals of unrounded values."""
    counts = st.action_counts(st.action_table(st.segment_kinematics(st.extract_strokes(sessions(s, d))), places=None))
    return counts.select("session_id", "n_actions", "strokes", "lifts", "lowers", "turns", "straights", r("turned", 3), r("units", 3))


@query("drawing_pipeline")
def drawing_pipeline(s, d):
    metrics, _ = drawing.run_drawing_pipeline(paths(s, d), 60.0, 120.0, "two_opt")
    return metrics.select("drawing_id", "num_paths", r("pen_up_mm", 3), r("draw_mm", 3), r("total_mm", 3))


@query("fit_to_page", f"SELECT drawing_id, path_id, round(min(10 + 2.5 + x * least(190.0 / 60, 277.0 / 90)), 4) AS min_x, round(max(10 + y * least(190.0 / 60, 277.0 / 90)), 4) AS max_y FROM (SELECT * FROM {POLY} z) q GROUP BY ALL".replace("10 + 2.5", "10 + (190 - 60 * least(190.0 / 60, 277.0 / 90)) / 2").replace("max(10 +", "max(10 + (277 - 90 * least(190.0 / 60, 277.0 / 90)) / 2 +"))
def fit_to_page(s, d):
    p = st.fit_to_page(paths(s, d), 60.0, 90.0)
    return p.select("drawing_id", "path_id", F.round(F.array_min(F.transform("points", lambda q: q["x"])), 4).alias("min_x"), F.round(F.array_max(F.transform("points", lambda q: q["y"])), 4).alias("max_y"))


@query(
    "view_bounds",
    f"""WITH b AS (SELECT drawing_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {POLY} z GROUP BY drawing_id), p AS (SELECT *, greatest(8.0, least(x1 - x0, y1 - y0) * 0.04) AS pad FROM b)
 SELECT drawing_id, floor(greatest(0, x0 - pad) * 1e4 + 0.25) AS "left", floor(greatest(0, y0 - pad) * 1e4 + 0.25) AS top, floor(least(210, x1 + pad) * 1e4 + 0.25) AS "right", floor(least(297, y1 + pad) * 1e4 + 0.25) AS bottom FROM p""",
)
def view_bounds(s, d):
    """Ten thousandths, cut at a quarter: the values have up to five decimals, so a half would be decided by the last bit."""
    cut = lambda c: F.floor(F.col(c) * 1e4 + 0.25).cast("double").alias(c)
    return st.view_bounds(paths(s, d)).select("drawing_id", cut("left"), cut("top"), cut("right"), cut("bottom"))


# ------------------------------------------------------------------ closed paths

VERTICES = "(SELECT label AS drawing_id, vec_id AS path_id, k, CAST(embedding[2 * k + 1] AS DOUBLE) * 100 AS x, CAST(embedding[2 * k + 2] AS DOUBLE) * 100 AS y FROM (SELECT *, unnest(range(32)) AS k FROM embeddings))"
SHAPES = f"(SELECT CAST(drawing_id AS BIGINT) AS drawing_id, path_id, abs(sum(x * ny - nx * y)) / 2 AS area, avg(x) AS cx, avg(y) AS cy, max(x) - min(x) AS w, max(y) - min(y) AS h FROM (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM {VERTICES} v WINDOW o AS (PARTITION BY path_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) q GROUP BY ALL)"


@query("closed_path_shape", f"SELECT drawing_id, path_id, true AS closed, round(area, 3) AS area, round(cx, 3) AS cx, round(cy, 3) AS cy, round(w, 3) AS w, round(h, 3) AS h FROM {SHAPES} z")
def closed_path_shape(s, d):
    return lo.shape_of(fx.loops(s, d)).select("drawing_id", "path_id", "closed", *(r(c, 3) for c in ("area", "cx", "cy", "w", "h")))


@query(
    "near_duplicate_loops",
    f"""WITH z AS (SELECT *, greatest(w, h, 1) AS span FROM {SHAPES} y WHERE area > 0) SELECT a.drawing_id, a.path_id AS a, b.path_id AS b FROM z a JOIN z b ON a.drawing_id = b.drawing_id AND (a.area > b.area OR a.area = b.area AND a.path_id < b.path_id)
 WHERE b.area / a.area >= 0.72 AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 0.08 * greatest(a.span, b.span) AND abs(a.w - b.w) / greatest(a.w, b.w, 1) <= 0.22 AND abs(a.h - b.h) / greatest(a.h, b.h, 1) <= 0.22""",
)
def near_duplicate_loops(s, d):
    return lo.near_duplicate_loops(lo.shape_of(fx.loops(s, d))).select("drawing_id", "a", "b")


@query("merge_duplicate_loops")
def merge_duplicate_loops(s, d):
    m = lo.merge_duplicate_loops(fx.loops(s, d))
    return m.select("drawing_id", "path_id", "merged_with", F.size("points").alias("n_points"))


@query(
    "resample_closed",
    f"""WITH v AS (SELECT *, coalesce(lead(x) OVER o, first_value(x) OVER o) AS nx, coalesce(lead(y) OVER o, first_value(y) OVER o) AS ny FROM {VERTICES} t WINDOW o AS (PARTITION BY path_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 l AS (SELECT *, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS d FROM v), c AS (SELECT *, sum(d) OVER (PARTITION BY path_id ORDER BY k) AS up_to, sum(d) OVER (PARTITION BY path_id) AS total FROM l),
 g AS (SELECT *, unnest(range(16)) AS j FROM c WHERE total > 0), h AS (SELECT *, j * total / 16 AS target, row_number() OVER (PARTITION BY path_id, j ORDER BY k) AS no FROM g WHERE up_to >= j * total / 16)
 SELECT CAST(drawing_id AS BIGINT) AS drawing_id, path_id, CAST(j AS INT) AS k, round(x + (nx - x) * CASE WHEN d = 0 THEN 0 ELSE (target - up_to + d) / d END, 3) AS x, round(y + (ny - y) * CASE WHEN d = 0 THEN 0 ELSE (target - up_to + d) / d END, 3) AS y FROM h WHERE no = 1""",
)
def resample_closed(s, d):
    return lo.resample_closed(fx.loops(s, d), 16).select("drawing_id", "path_id", "k", r("x", 3), r("y", 3))


def ring_pairs(s, d):
    """Each vector's ring with that of the next vector of its label."""
    from pyspark.sql import Window

    p = fx.loops(s, d).withColumn("ref", F.slice("points", 1, 32))
    return p.withColumn("cand", F.lead("ref").over(Window.partitionBy("drawing_id").orderBy("path_id"))).filter("cand IS NOT NULL").select("drawing_id", "path_id", "ref", "cand")


NEXT = f"(SELECT path_id, lead(path_id) OVER (PARTITION BY drawing_id ORDER BY path_id) AS other FROM (SELECT DISTINCT drawing_id, path_id FROM {VERTICES} v))"


ALIGNED = f"""v AS (SELECT * FROM {VERTICES} t), n AS (SELECT * FROM {NEXT} u WHERE other IS NOT NULL), s AS (SELECT unnest(range(32)) AS shift), e AS (SELECT unnest([0, 1]) AS dir),
 c AS (SELECT n.path_id, n.other, e.dir, s.shift, sum((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS cost FROM n JOIN v a ON a.path_id = n.path_id CROSS JOIN s CROSS JOIN e JOIN v b ON b.path_id = n.other AND b.k = CASE WHEN e.dir = 0 THEN (a.k + s.shift) % 32 ELSE 31 - (a.k + s.shift) % 32 END GROUP BY ALL),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path_id ORDER BY cost, dir, shift) AS no FROM c) q WHERE no = 1)"""


@query("align_closed", f"WITH {ALIGNED} SELECT path_id, round(cost, 2) AS cost, dir, CAST(shift AS INT) AS shift FROM best")
def align_closed(s, d):
    return lo.align_closed(ring_pairs(s, d)).select("path_id", F.round("cost", 2).alias("cost"), "dir", "shift")


@query(
    "average_closed",
    f"WITH {ALIGNED} SELECT n.path_id, CAST(a.k AS INT) AS k, round_even((a.x + b.x) / 2, 0) AS x, round_even((a.y + b.y) / 2, 0) AS y FROM best n JOIN v a ON a.path_id = n.path_id JOIN v b ON b.path_id = n.other AND b.k = CASE WHEN n.dir = 0 THEN (a.k + n.shift) % 32 ELSE 31 - (a.k + n.shift) % 32 END",
)
def average_closed(s, d):
    """The points of the averages; the last one, which closes the ring, is left out."""
    a = lo.align_closed(ring_pairs(s, d))
    avg = lo.average_closed(F.col("ref"), F.col("aligned"))
    return a.select("path_id", F.posexplode(avg).alias("k", "p")).filter("k < 32").select("path_id", "k", (F.col("p.x") + 0.0).alias("x"), (F.col("p.y") + 0.0).alias("y"))


NEAR_ENDS = "sqrt((q.ax - o.{0}) ** 2 + (q.ay - o.{1}) ** 2) <= 4 AND sqrt((q.bx - o.{2}) ** 2 + (q.b_y - o.{3}) ** 2) <= 4"


@query(
    "dedupe_open_paths",
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY drawing_id ORDER BY path_id) AS i FROM {ENDS} e),
 k AS (SELECT drawing_id, i, path_id, true AS stays, [{{'ax': ax, 'ay': ay, 'bx': bx, 'b_y': b_y}}] AS kept FROM o WHERE i = 1 UNION ALL
 SELECT drawing_id, i, path_id, NOT near, CASE WHEN near THEN kept ELSE list_append(kept, {{'ax': ax, 'ay': ay, 'bx': bx, 'b_y': b_y}}) END FROM (SELECT o.*, k.kept,
 len(list_filter(k.kept, lambda q: {NEAR_ENDS.format("ax", "ay", "bx", "b_y")} OR {NEAR_ENDS.format("bx", "b_y", "ax", "ay")})) > 0 AS near FROM k JOIN o ON o.drawing_id = k.drawing_id AND o.i = k.i + 1) z)
 SELECT drawing_id, path_id FROM k WHERE stays""",
)
def dedupe_open_paths(s, d):
    return lo.dedupe_open_paths(paths(s, d), 4.0).select("drawing_id", "path_id")


# ------------------------------------------------------------------ scalar functions


@query(
    "geometry_functions",
    f"""SELECT session_id, CAST(seq AS BIGINT) AS seq, round(sqrt((x - 105) * (x - 105) + (y - 97) * (y - 97)), 4) AS dist, round(degrees(atan2(97 - y, x - 105)), 4) AS heading, round(180 - (((180 - x * 7) % 360) + 360) % 360, 3) AS angle, round(greatest(x / 10, 5), 4) AS clamped,
 CASE WHEN abs(x - 2.0) <= 1e-9 AND abs(y - 0.75) <= 1e-9 THEN 'default' ELSE 'manual' END AS profile, round(sqrt((x - greatest(0, least(100, x))) * (x - greatest(0, least(100, x))) + y * y), 4) AS to_segment FROM {SESS} z WHERE cmd = 'MOVE'""",
)
def geometry_functions(s, d):
    x, y, l = F.col("x"), F.col("y"), F.lit
    return sessions(s, d).filter("cmd = 'MOVE'").select("session_id", F.col("seq").cast("bigint"), F.round(geom.dist(x, y, l(105.0), l(97.0)), 4).alias("dist"), F.round(geom.heading_deg(l(105.0), l(97.0), x, y), 4).alias("heading"), F.round(geom.normalize_angle(x * 7), 3).alias("angle"), F.round(geom.clamp_min_distance(x / 10, 0.5, 0.5, 10.0), 4).alias("clamped"), geom.settings_profile(x, y, l(0.5)).alias("profile"), F.round(geom.point_segment_distance(x, y, l(0.0), l(0.0), l(100.0), l(0.0)), 4).alias("to_segment"))


@query(
    "tool_offset",
    f"SELECT session_id, CAST(seq AS BIGINT) AS seq, round(x - (12 * cos(radians(y)) + 3 * sin(radians(y))), 4) AS cx, round(y - (3 * cos(radians(y)) - 12 * sin(radians(y))), 4) AS cy, round(x + 5 * cos(radians(y)), 4) AS ax, round(y - 5 * sin(radians(y)), 4) AS ay FROM {SESS} z WHERE cmd = 'MOVE'",
)
def tool_offset(s, d):
    x, y = F.col("x"), F.col("y")
    cx, cy = geom.center_for_tip(x, y, y, F.lit(12.0), F.lit(3.0))
    ax, ay = geom.advance(x, y, y, F.lit(5.0))
    return sessions(s, d).filter("cmd = 'MOVE'").select("session_id", F.col("seq").cast("bigint"), *(F.round(c, 4).alias(n) for c, n in ((cx, "cx"), (cy, "cy"), (ax, "ax"), (ay, "ay"))))


@query(
    "name_functions",
    r"""SELECT p_partkey, regexp_replace(regexp_replace(n, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS clean, lower(regexp_replace(regexp_extract(n, '([^/]*)/*$', 1), '\.[^./]+$', '')) AS stem, CASE WHEN contains(p_name, ' ') THEN lower(regexp_extract(replace(p_name, ' ', '_'), '^(.*)_[^_]*$', 1)) END AS trimmed, len(list_filter(regexp_split_to_array(p_name, '[\s,;]+'), lambda t: t <> '')) AS tokens
 FROM (SELECT p_partkey, p_name, concat('a b/', p_name, '.PNG') AS n FROM part) z""",
)
def name_functions(s, d):
    n = F.col("n")
    p = fx.read(s, d, "part").withColumn("n", F.concat(F.lit("a b/"), "p_name", F.lit(".PNG")))
    return p.select("p_partkey", text.sanitize_stem(n).alias("clean"), text.normalize_stem(n).alias("stem"), text.trimmed_suffix_stem(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("trimmed"), F.size(text.tokenize_ids(F.col("p_name"))).cast("bigint").alias("tokens"))


@query("split_names", "SELECT r_regionkey, n, CASE lower(trim(n)) WHEN 'train' THEN 'train' WHEN 'training' THEN 'train' WHEN 'valid' THEN 'val' WHEN 'dev' THEN 'val' WHEN 'test' THEN 'test' END AS split FROM (SELECT r_regionkey, unnest([' Train', 'training', 'VALID', 'dev', 'test ', r_name]) AS n FROM region) z")
def split_names(s, d):
    n = F.explode(F.array(*map(F.lit, (" Train", "training", "VALID", "dev", "test ")), F.col("r_name"))).alias("n")
    return fx.read(s, d, "region").select("r_regionkey", n).withColumn("split", text.normalize_split_name(F.col("n")))


@query("fit_canvas", "SELECT p_partkey, greatest(1, CAST(round_even(w * sc, 0) AS INT)) AS nw, greatest(1, CAST(round_even(h * sc, 0) AS INT)) AS nh FROM (SELECT *, least(210.0::DOUBLE / w, 297.0::DOUBLE / h) AS sc FROM (SELECT p_partkey, p_size + 10 AS w, p_partkey % 37 + 5 AS h FROM part) a) z")
def fit_canvas(s, d):
    p = fx.read(s, d, "part").select("p_partkey", (F.col("p_size") + 10).alias("w"), (F.col("p_partkey") % 37 + 5).alias("h"))
    w, h, _, _ = geom.fit_canvas(F.col("w"), F.col("h"), 210, 297)
    return p.select("p_partkey", w.alias("nw"), h.alias("nh"))


@query("progress", "SELECT run_id, n, round(n / 80.0::DOUBLE * 100, 2) AS pct, CASE WHEN n * 61 >= 3600 THEN concat(n * 61 // 3600, 'h ', (n * 61 % 3600) // 60, 'm ', n * 61 % 60, 's') ELSE concat(n * 61 // 60, 'm ', n * 61 % 60, 's') END AS took FROM (SELECT user_id AS run_id, count(*) AS n FROM events GROUP BY user_id) z")
def progress(s, d):
    n = fx.read(s, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("n"))
    return n.select("run_id", "n", text.progress_pct(F.col("n"), F.lit(80)).alias("pct"), text.duration_text(F.col("n") * 61).alias("took"))


@query("color_region_predicate", "SELECT p_partkey, CASE WHEN hi = 0 THEN false ELSE round_even((hi - lo) * 255.0::DOUBLE / hi, 0) >= 18 END AND sqrt((255 - b) * (255 - b) + (255 - g) * (255 - g) + (255 - r) * (255 - r)) >= 20 AS colored, CAST(least(255, greatest(0, b * 0.25::DOUBLE + 255 * 0.75::DOUBLE)) AS DOUBLE) AS blended FROM (SELECT *, greatest(b, g, r) AS hi, least(b, g, r) AS lo FROM (SELECT p_partkey, p_partkey * 7 % 256 AS b, p_partkey * 13 % 256 AS g, p_size * 5 % 256 AS r FROM part) a) z".replace("CAST(least(255, greatest(0, b * 0.25::DOUBLE + 255 * 0.75::DOUBLE)) AS DOUBLE)", "CAST(floor(b * 0.25::DOUBLE + 255 * 0.75::DOUBLE) AS INT)"))
def color_region_predicate(s, d):
    k = F.col("p_partkey")
    p = fx.read(s, d, "part").select("p_partkey", (k * 7 % 256).alias("b"), (k * 13 % 256).alias("g"), (F.col("p_size") * 5 % 256).alias("r"))
    b = F.col("b")
    return p.select("p_partkey", geom.color_region_predicate(b, F.col("g"), F.col("r")).alias("colored"), geom.alpha_composite(b, F.lit(255), F.lit(0.25)).alias("blended"))


@query(
    "label_functions",
    """SELECT o_orderkey, concat_ws('__', o_orderstatus, o_orderpriority, 'two_opt') AS label, CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'verified' WHEN contains(lower(o_orderpriority), 'high') OR contains(lower(o_orderpriority), 'low') THEN 'experimental' ELSE 'other' END AS tier, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS session,
 o_orderdate::TIMESTAMP AS started, CASE WHEN o_orderkey % 10 > 0 AND o_orderstatus = 'O' THEN round(60.0::DOUBLE / (o_orderkey % 10) * (10 - o_orderkey % 10), 3) END AS eta FROM orders""",
)
def label_functions(s, d):
    k = F.col("o_orderkey")
    o = fx.read(s, d, "orders").withColumn("session", text.session_id(F.col("o_orderdate")))
    started = text.run_started_at(F.concat(F.lit("run_"), "session", F.lit("_x"))).cast("timestamp_ntz")
    eta = text.eta_seconds(F.lit(60.0), k % 10, F.lit(10), F.col("o_orderstatus") == "O")
    return o.select("o_orderkey", text.run_label(F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("two_opt")).alias("label"), text.artifact_tier(F.col("o_orderpriority"), ["1-URGENT"], ["high", "low"]).alias("tier"), "session", started.alias("started"), F.round(eta, 3).alias("eta"))


@query("parse_observation", "SELECT event_id, CASE WHEN value > 0 AND event_id % 4 <> 0 THEN value END AS commanded, CASE WHEN value > 0 AND event_id % 4 <> 0 THEN CAST(event_id % 4 AS DOUBLE) END AS measured FROM events")
def parse_observation(s, d):
    e = fx.read(s, d, "events")
    a, b = text.parse_observation(F.concat(F.col("value").cast("string"), F.lit("="), (F.col("event_id") % 4).cast("string")))
    return e.select("event_id", a.alias("commanded"), b.alias("measured"))


@query("start_pose", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size::DOUBLE END, p_partkey / 2) AS x, coalesce(CASE WHEN p_size > 40 THEN 1.0::DOUBLE END, greatest(0, p_partkey - 200)::DOUBLE) AS y, 90.0::DOUBLE AS heading FROM part")
def start_pose(s, d):
    k = F.col("p_partkey").cast("double")
    x, y, h = geom.start_pose(F.when(F.col("p_size") > 25, F.col("p_size").cast("double")), F.when(F.col("p_size") > 40, F.lit(1.0)), F.lit(None).cast("double"), k, k)
    return fx.read(s, d, "part").select("p_partkey", x.alias("x"), y.alias("y"), h.alias("heading"))


@query("infer_split", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' END AS split FROM part")
def infer_split(s, d):
    name = F.get(F.array(*map(F.lit, ("a/photo_TRAIN_list.txt", "valid-ids.csv", "x.testing.tsv", "trainer.txt"))), (F.col("p_size") % 4).cast("int"))
    return fx.read(s, d, "part").select("p_partkey", text.infer_split_from_filename(name).alias("split"))


# ------------------------------------------------------------------ curation


@query(
    "match_pairs",
    f"SELECT coalesce(a.stem, b.stem) AS stem, a.path AS image, b.path AS mask, CASE WHEN b.stem IS NULL THEN 'image_only' WHEN a.stem IS NULL THEN 'mask_only' ELSE 'pair' END AS side FROM (SELECT stem, max(path) AS path FROM {IMAGES} i GROUP BY stem) a FULL JOIN (SELECT stem, max(path) AS path FROM {MASKS} m GROUP BY stem) b ON a.stem = b.stem",
)
def match_pairs(s, d):
    return cu.match_pairs(images(s, d), masks(s, d))


PARTS_I = "(SELECT DISTINCT p_name AS stem, concat('images/', p_name, '.png') AS path FROM part)"
KIND = "CAST(p_size AS INT) % 5"
PARTS_M = f"(SELECT DISTINCT CASE {KIND} WHEN 0 THEN p_name WHEN 1 THEN concat('x', p_name) WHEN 2 THEN upper(p_name) WHEN 3 THEN concat(p_name, '_', p_brand) ELSE concat('other ', p_name) END AS stem, CASE {KIND} WHEN 1 THEN concat('images/', upper(p_name), '.tif') ELSE concat('masks/', p_name, p_brand, '.png') END AS path FROM part)"
TIERED = f"""m AS (SELECT * FROM {PARTS_M} z), m1 AS (SELECT stem, max(path) AS m FROM m GROUP BY stem), m2 AS (SELECT lower(regexp_replace(path, '\\.[^./]+$', '')) AS rel, max(path) AS m FROM m GROUP BY 1),
 m3 AS (SELECT lower(stem) AS k, min(path) AS m FROM m GROUP BY 1 HAVING count(*) = 1), m4 AS (SELECT lower(regexp_extract(stem, '^(.*)_[^_]*$', 1)) AS k, min(path) AS m FROM m WHERE contains(stem, '_') GROUP BY 1 HAVING count(*) = 1),
 tiered AS (SELECT i.stem, i.path, coalesce(m1.m, m2.m, m3.m, m4.m) AS mask, CASE WHEN m1.m IS NOT NULL THEN 1 WHEN m2.m IS NOT NULL THEN 2 WHEN m3.m IS NOT NULL THEN 3 WHEN m4.m IS NOT NULL THEN 4 END AS tier FROM {PARTS_I} i LEFT JOIN m1 ON i.stem = m1.stem LEFT JOIN m2 ON lower(concat('images/', i.stem)) = m2.rel LEFT JOIN m3 ON lower(i.stem) = m3.k LEFT JOIN m4 ON lower(i.stem) = m4.k)"""


def part_names(s, d):
    """Images by part name, and masks that hit each tier, or none."""
    p = fx.read(s, d, "part")
    p.createOrReplaceTempView("part_names_of")
    both = [s.sql(sql.replace("FROM part)", "FROM part_names_of)").strip("()")) for sql in (PARTS_I, PARTS_M)]
    return both[0], both[1]


@query("match_tiered", f"WITH {TIERED} SELECT * FROM tiered")
def match_tiered(s, d):
    return cu.match_tiered(*part_names(s, d))


NEW_STEM = "regexp_replace(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), '^$', 'sample')"


@query("import_plan", f"WITH {TIERED} SELECT stem, mask, concat('images/logo_', {NEW_STEM}, '.png') AS dest, CASE WHEN mask IS NULL THEN 'failed' WHEN starts_with(stem, 'a') THEN 'skipped_existing' ELSE 'copied' END AS action FROM tiered")
def import_plan(s, d):
    i, m = part_names(s, d)
    there = i.filter(F.col("stem").startswith("a")).select(F.concat(F.lit("images/logo_"), text.sanitize_stem(F.col("stem")), F.lit(".png")).alias("dest"))
    return cu.import_plan(i, m, there).select("stem", "mask", "dest", "action")


@query("plan_actions_dry", f"SELECT i.stem AS dest, CASE WHEN i.stem LIKE '%9' THEN 'failed' ELSE 'dry_run_generated' END AS action FROM {IMAGES} i")
def plan_actions_dry(s, d):
    """Overwriting, as a trial."""
    wanted = images(s, d).select(F.col("stem").alias("dest"), (~F.col("stem").endswith("9")).alias("ok"))
    return cu.plan_actions(wanted, masks(s, d).select(F.col("stem").alias("dest")), overwrite=True, dry_run=True).select("dest", "action")


@query("match_longest_prefix", "SELECT concat(source, '_', doc_id) AS stem, source AS key FROM documents")
def match_longest_prefix(s, d):
    docs = fx.read(s, d, "documents")
    return cu.match_longest_prefix(docs.select(F.concat_ws("_", "source", "doc_id").alias("stem")), docs.select(F.col("source").alias("key")).distinct())


@query("missing_counterparts", f"SELECT stem, path, concat('masks/', stem, '.png') AS expected FROM {IMAGES} i WHERE stem NOT IN (SELECT stem FROM {MASKS} m)")
def missing_counterparts(s, d):
    return cu.missing_counterparts(images(s, d), masks(s, d), "masks")


@query("plan_actions", f"SELECT i.stem AS dest, CASE WHEN i.stem LIKE '%9' THEN 'failed' WHEN i.stem IN (SELECT stem FROM {MASKS} m) THEN 'skipped_existing' ELSE 'copied' END AS action FROM {IMAGES} i")
def plan_actions(s, d):
    wanted = images(s, d).select(F.col("stem").alias("dest"), (~F.col("stem").endswith("9")).alias("ok"))
    return cu.plan_actions(wanted, masks(s, d).select(F.col("stem").alias("dest"))).select("dest", "action")


def split_lines(s, d):
    """Lines of four forms, made from documents; an id's last line wins."""
    i = F.col("doc_id").cast("string")
    docs = fx.read(s, d, "documents")
    forms = F.array(F.concat(F.lit("train: "), i), F.concat(i, F.lit(" val")), F.concat(F.lit("test,"), i), F.concat(F.lit("# "), i), F.lit(""))
    lines = docs.select("doc_id", F.posexplode(F.slice(forms, 1, (F.col("doc_id") % 3 + 1).cast("int"))).alias("line_ord", "value"))
    return lines.select(F.lit("lists.txt").alias("file"), F.lit(1).alias("file_ord"), "line_ord", "value")


@query("split_assignments", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM documents")
def split_assignments(s, d):
    return cu.parse_split_assignments(split_lines(s, d))


@query("split_json", """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN source < 'src2' THEN 'test' ELSE CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'val' ELSE 'test' END END AS split FROM documents""")
def split_json(s, d):
    """A dict of split to ids for each document, then lists of records, which win for the first sources."""
    docs = fx.read(s, d, "documents").select(F.col("doc_id").cast("string").alias("i"), "lang", "source")
    name = F.when(F.col("lang") == "en", "training").when(F.col("lang") == "fr", "dev").otherwise("TEST")
    dicts = docs.select(F.lit("a.json").alias("file_ord"), F.concat(F.lit('{"'), name, F.lit('": [["'), "i", F.lit('"]], "note": 1}')).alias("value"))
    lists = docs.filter("source < 'src2'").select(F.lit("b.json").alias("file_ord"), F.concat(F.lit('[{"split": "te", "id": '), "i", F.lit(', "file": "no"}]')).alias("value"))
    none = s.createDataFrame([], "file string, file_ord string, line_ord int, value string")
    return cu.parse_split_assignments(none, cu.split_json_rows(dicts.union(lists)))


@query("flatten_ids", "SELECT doc_id, n, CASE WHEN n = 2 THEN source ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents CROSS JOIN (SELECT unnest([0, 1, 2]) AS n) z")
def flatten_ids(s, d):
    docs = fx.read(s, d, "documents").select("doc_id", F.to_json(F.array(F.struct(F.col("doc_id").alias("stem"), F.lit("x").alias("other")).cast("struct<stem:string,other:string>"))).alias("a"), "source")
    nested = docs.select("doc_id", F.concat(F.lit('[{"p":'), "a", F.lit(',"q":'), F.col("doc_id").cast("string"), F.lit('},null,"'), "source", F.lit('"]')).alias("v"))
    return nested.withColumn("ids", text.flatten_ids(F.col("v"))).select("doc_id", F.posexplode("ids").alias("n", "id"))


@query("assign_split", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'en' THEN 'val' WHEN lang = 'fr' THEN 'holdout' ELSE 'train' END AS split, CASE WHEN lang = 'fr' THEN 'unknown split: holdout' END AS reason FROM documents")
def assign_split(s, d):
    docs = fx.read(s, d, "documents")
    items = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"))
    some = docs.filter("lang IN ('en', 'fr')").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "en", "val").otherwise("holdout").alias("split"))
    return cu.assign_split(items, some).select("id", "split", "reason")


@query("exact_ratio_split", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN k >= n - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) THEN 'test' WHEN k >= n - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM o")
def exact_ratio_split(s, d):
    return cu.exact_ratio_split(fx.read(s, d, "documents").select("doc_id"), "doc_id", 0.2, 0.1)


@query("group_split", "WITH o AS (SELECT source, row_number() OVER (ORDER BY md5(concat('42:', source)), source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents) g) SELECT d.doc_id, d.source, CASE WHEN k >= n - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) THEN 'test' WHEN k >= n - CAST(floor(n * 0.1::DOUBLE) AS BIGINT) - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM o JOIN documents d ON d.source = o.source")
def group_split(s, d):
    return cu.group_split(fx.read(s, d, "documents").select("doc_id", "source"), "source", 0.2, 0.1).select("doc_id", "source", "split")


@query("limit_per_group", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE n_chars >= 200) z WHERE k <= 3")
def limit_per_group(s, d):
    docs = fx.read(s, d, "documents").select("doc_id", "source", "n_chars")
    return cu.limit_per_group(docs, "source", "doc_id", 3, F.col("n_chars") >= 200).select("doc_id", "source")


QUALITY = f"(SELECT image_id, count_if(gray > 127) AS white, count_if(gray > 5 AND gray < 250) AS grey, count(*) AS n, count(DISTINCT gray) AS kinds, bool_and(gray IN (0, 255)) AS exact FROM {GRID} g GROUP BY image_id)"


@query("pair_quality", f"SELECT image_id, exact AS exact_binary, round(1 - grey / n, 4) AS binary_like_ratio, round(white / n, 4) AS white_ratio, kinds AS unique_value_count, round(1 - grey / n, 4) >= 0.99 AS binary_like FROM {QUALITY} q")
def pair_quality(s, d):
    q = cu.pair_quality(grid(s, d).select("image_id", F.col("gray").alias("v")))
    return q.drop("unique_values_preview").withColumn("unique_value_count", F.col("unique_value_count").cast("bigint"))


@query("pair_shapes", f"SELECT image_id, [8, 8] AS image_shape, [CAST(h AS INT), 8] AS mask_shape, h = 8 AS same_size FROM (SELECT image_id, max(y) + 1 AS h FROM {GRID} g WHERE label > 2 OR y < 6 GROUP BY image_id) z")
def pair_shapes(s, d):
    g = grid(s, d)
    return cu.pair_shapes(g, g.filter("label > 2 OR y < 6"))


#: The masks of documents are the images of like number; documents without one are unreadable pairs.
SHAPED = f"(SELECT CAST(q.image_id AS VARCHAR) AS stem, exact, white > 20 AS binary_like, round(white / n, 4) AS white_ratio, label > 2 AS same_size FROM {QUALITY} q JOIN embeddings e ON e.vec_id = q.image_id WHERE white > 8)"
SUSPECT = "(NOT binary_like OR white_ratio <= 0.001 OR white_ratio >= 0.999)"


def audit_sql(i: str, m: str) -> str:
    return f"""(SELECT *, (SELECT count(*) FROM {i} x) AS image_files, (SELECT count(*) FROM {m} x) AS mask_files FROM (SELECT count_if(side = 'pair') AS pairs, count_if(side = 'image_only') AS image_only, count_if(side = 'mask_only') AS mask_only, count_if(side = 'pair' AND exact IS NOT NULL) AS inspected, count_if(side = 'pair' AND exact IS NULL) AS unreadable,
 count_if(side = 'pair' AND exact) AS exact_binary, count_if(side = 'pair' AND binary_like) AS binary_like, count_if(side = 'pair' AND same_size) AS same_size, count_if(side = 'pair' AND {SUSPECT}) AS suspicious FROM {sides_sql(i, m)} z))"""


def sides_sql(i: str, m: str) -> str:
    return f"(SELECT coalesce(a.stem, b.stem) AS stem, CASE WHEN b.stem IS NULL THEN 'image_only' WHEN a.stem IS NULL THEN 'mask_only' ELSE 'pair' END AS side, q.* EXCLUDE (stem) FROM (SELECT DISTINCT stem FROM {i} x) a FULL JOIN (SELECT DISTINCT stem FROM {m} x) b ON a.stem = b.stem LEFT JOIN {SHAPED} q ON q.stem = coalesce(a.stem, b.stem))"


AUDIT, SIDES = audit_sql(IMAGES, MASKS), sides_sql(IMAGES, MASKS)


def quality(s, d):
    """Quality by stem; an image with more than 20 white pixels counts as like a mask, one with 8 or less as unreadable."""
    q = cu.pair_quality(grid(s, d).select("image_id", F.col("gray").alias("v")))
    labels = fx.read(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("label") > 2).alias("same_size"))
    white = F.round(F.col("white_ratio") * 64)
    return q.join(labels, "image_id").filter(white > 8).select(F.col("image_id").cast("string").alias("stem"), "exact_binary", (white > 20).alias("binary_like"), "white_ratio", "same_size")


@query("audit_dataset", f"SELECT * FROM {AUDIT} z")
def audit_dataset(s, d):
    return cu.audit_dataset(images(s, d), masks(s, d), quality(s, d))


@query("audit_examples", " UNION ALL ".join(f"(SELECT '{kind}' AS kind, stem FROM {SIDES} z WHERE {rule} ORDER BY stem LIMIT 10)" for kind, rule in (("image_only", "side = 'image_only'"), ("mask_only", "side = 'mask_only'"), ("suspicious", f"side = 'pair' AND {SUSPECT}"), ("unreadable", "side = 'pair' AND exact IS NULL"))))
def audit_examples(s, d):
    return cu.audit_examples(images(s, d), masks(s, d), quality(s, d))


@query("unreadable_pairs", f"SELECT stem, concat('images/', stem, '.png') AS image, concat('masks/', stem, '.png') AS mask FROM {SIDES} z WHERE side = 'pair' AND exact IS NULL")
def unreadable_pairs(s, d):
    return cu.unreadable_pairs(images(s, d), masks(s, d), quality(s, d))


@query("readiness", f"SELECT pairs > 0 AS training_ready, pairs > 0 AND binary_like = pairs AND unreadable = 0 AS quality_ready, true AS inference_ready, CASE WHEN pairs = 0 THEN 'add pairs' WHEN binary_like < pairs THEN 'clean masks' ELSE 'infer' END AS next_step FROM {AUDIT} z")
def readiness(s, d):
    return cu.readiness(audit_dataset(s, d), checkpoint=True)


@query("prepare_dataset", "SELECT concat(source, '_', doc_id) AS stem, source AS key, CASE WHEN lang = 'en' THEN 'val' WHEN lang = 'fr' THEN 'holdout' ELSE 'train' END AS split, CASE WHEN lang = 'fr' THEN 'unknown split: holdout' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY concat(source, '_', doc_id)) AS k FROM documents) z WHERE k <= 5")
def prepare_dataset(s, d):
    docs = fx.read(s, d, "documents").withColumn("stem", F.concat_ws("_", "source", "doc_id"))
    some = docs.filter("lang IN ('en', 'fr')").select(F.col("stem").alias("id"), F.when(F.col("lang") == "en", "val").otherwise("holdout").alias("split"))
    return cu.prepare_dataset(docs.select("stem"), docs.select(F.col("source").alias("key")).distinct(), some, 5).select("stem", "key", "split", "reason")


COPIED = f"(SELECT concat('logo_', {NEW_STEM}) AS stem FROM (WITH {TIERED} SELECT stem FROM tiered WHERE mask IS NOT NULL) y)"
ALL_I = f"(SELECT stem FROM {IMAGES} i UNION ALL SELECT stem FROM {COPIED} c)"
ALL_M = f"(SELECT stem FROM {MASKS} i UNION ALL SELECT stem FROM {COPIED} c)"
FILLED = f"(SELECT stem FROM {ALL_M} k UNION ALL SELECT stem FROM {ALL_I} k WHERE stem NOT IN (SELECT stem FROM {ALL_M} h))"


@query(
    "curation_pipeline",
    f"""SELECT z.*, (SELECT count(*) FROM {COPIED} c) AS import_copied, CAST(0 AS BIGINT) AS import_skipped_existing, (WITH {TIERED} SELECT count(*) FROM tiered WHERE mask IS NULL) AS import_failed, (SELECT count(*) FROM {FILLED} f) - (SELECT count(*) FROM {ALL_M} f) AS filled,
 pairs - CAST(floor(pairs * 0.1::DOUBLE) AS BIGINT) * 2 AS train, CAST(floor(pairs * 0.1::DOUBLE) AS BIGINT) AS val, CAST(floor(pairs * 0.1::DOUBLE) AS BIGINT) AS test FROM {audit_sql(ALL_I, FILLED)} z""",
)
def curation_pipeline(s, d):
    return cu.curation_pipeline(images(s, d), masks(s, d), *part_names(s, d), quality(s, d), fill=True)


# ------------------------------------------------------------------ raster masks


def on(s, d):
    return grid(s, d).filter("is_on")


TRUTH = "(SELECT label, min(vec_id) AS t FROM embeddings GROUP BY label)"


def truth(s, d):
    e = fx.read(s, d, "embeddings")
    first = e.groupBy("label").agg(F.min("vec_id").alias("t"))
    set_ = on(s, d).join(first, (F.col("image_id") == F.col("t"))).select(first["label"].alias("l"), "y", "x")
    return e.select(F.col("vec_id").alias("image_id"), "label").join(set_, F.col("label") == F.col("l")).select("image_id", "y", "x")


OVERLAP = f"(SELECT p.image_id, count_if(p.is_on AND q.is_on) AS tp, count_if(p.is_on AND NOT q.is_on) AS fp, count_if(NOT p.is_on AND q.is_on) AS fn FROM {GRID} p JOIN {TRUTH} t ON p.label = t.label JOIN {GRID} q ON q.image_id = t.t AND q.y = p.y AND q.x = p.x GROUP BY p.image_id)"


@query("mask_overlap", f"SELECT image_id, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall, round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS dice, round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE tp / (tp + fp + fn) END, 4) AS iou FROM {OVERLAP} o WHERE tp + fp + fn > 0")
def mask_overlap(s, d):
    return ra.mask_overlap(on(s, d), truth(s, d)).select("image_id", "tp", "fp", "fn", *(r(c) for c in ("precision", "recall", "dice", "iou")))


def labelled(s, d):
    return ra.connected_components(on(s, d))


def components_sql(pixels: str) -> str:
    """CTEs l (image_id, y, x, label) and t (a row for each component) of the set pixels of a query."""
    return f"""o AS (SELECT image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, CAST(y * 8 + x AS BIGINT) AS p FROM ({pixels}) z),
 e AS (SELECT a.image_id, a.p, b.p AS q FROM o a JOIN o b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.p <> b.p),
 reach AS (SELECT image_id, p, p AS q FROM o UNION SELECT r.image_id, r.p, e.q FROM reach r JOIN e ON r.image_id = e.image_id AND r.q = e.p),
 l AS (SELECT o.image_id, o.y, o.x, dense_rank() OVER (PARTITION BY o.image_id ORDER BY m.root) AS label FROM o JOIN (SELECT image_id, p, min(q) AS root FROM reach GROUP BY image_id, p) m ON m.image_id = o.image_id AND m.p = o.p),
 t AS (SELECT image_id, label, min(x) AS min_x, min(y) AS min_y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area FROM l GROUP BY image_id, label)"""


COMPONENTS = "WITH RECURSIVE " + components_sql(f"SELECT image_id, y, x FROM {GRID} g WHERE is_on")
KEPT = COMPONENTS + " SELECT l.image_id, l.y, l.x, l.label FROM l JOIN t ON l.image_id = t.image_id AND l.label = t.label WHERE "


@query("connected_components", f"{COMPONENTS} SELECT * FROM l")
def connected_components(s, d):
    return labelled(s, d)


@query("component_stats", f"{COMPONENTS} SELECT * FROM t")
def component_stats(s, d):
    return ra.component_stats(labelled(s, d))


@query("drop_specks", KEPT + "area >= 3")
def drop_specks(s, d):
    l = labelled(s, d)
    return ra.drop_specks(l, ra.component_stats(l), 3)


@query("suppress_border_components", KEPT + "NOT ((min_x = 0 OR min_y = 0 OR min_x + width >= 8 OR min_y + height >= 8) AND (area / 64 >= 0.02 OR greatest(width, height) / 8 >= 0.35))")
def suppress_border_components(s, d):
    l = labelled(s, d)
    return ra.suppress_border_components(l, ra.component_stats(l), 8, 8)


@query("keep_structural_components", KEPT + "area >= 6 AND (least(width, height) >= 3 OR greatest(width, height) >= 40 AND greatest(width, height) / least(width, height) >= 8)")
def keep_structural_components(s, d):
    l = labelled(s, d)
    return ra.keep_structural_components(l, ra.component_stats(l), 6, 3)


def flags(s, d):
    return ra.image_flags(ra.component_stats(labelled(s, d)), 8, 8)


FLAGS = """f AS (SELECT image_id, bool_or(share >= 0.08 AND extent >= 0.75) AS dense, bool_or(share >= 0.01 AND extent >= 0.65) AS dense_region, bool_or(share >= 0.01 AND greatest(width, height) / 8 >= 0.6 AND greatest(width, height) / least(width, height) >= 6) AS elongated, bool_or(width / 8 >= 0.65 AND height / 8 >= 0.65) AS large_bbox,
 count_if(area >= 60) >= 6) AND coalesce(sum(CASE WHEN area >= 60 THEN share END), 0) >= 0.08 AS artwork, bool_or(share >= 0.018 AND extent >= 0.24) AS filled, count(*) AS num_paths, sum(area) / 64 AS pixel_ratio FROM (SELECT *, area / 64 AS share, area / (width * height) AS extent FROM t) z GROUP BY image_id)""".replace("count_if(area >= 60) >= 6)", "count_if(area >= 60) >= 6")


@query("image_flags", f"{COMPONENTS}, {FLAGS} SELECT image_id, dense, dense_region, elongated, large_bbox, artwork, filled AND NOT elongated AS filled_mask FROM f")
def image_flags(s, d):
    return flags(s, d)


# opening by a 3 x 3 square; outside of the image nothing counts
OPENED = f"""SELECT image_id, y, x FROM (SELECT a.image_id, a.y, a.x, max(b.v) AS v FROM {GRID} a JOIN (SELECT p.image_id, p.y, p.x, min(CAST(q.is_on AS INT)) AS v FROM {GRID} p JOIN {GRID} q ON p.image_id = q.image_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY p.image_id, p.y, p.x) b
 ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.image_id, a.y, a.x) m WHERE v = 1"""
AXIS = f"""(WITH RECURSIVE {components_sql(OPENED)} SELECT g.image_id, CASE WHEN g.n = 0 THEN 0 ELSE coalesce(h.n, 0) / g.n END AS axis_coverage FROM (SELECT image_id, count_if(is_on) AS n FROM {GRID} y GROUP BY image_id) g
 LEFT JOIN (SELECT image_id, sum(area) AS n FROM t WHERE area >= 5 AND greatest(width, height) >= 5 AND greatest(width, height) / least(width, height) >= 5 AND area / (width * height) >= 0.55 GROUP BY image_id) h ON g.image_id = h.image_id)"""


def axes(s, d):
    return ra.axis_coverage(grid(s, d), 5, 5, 3)


@query("axis_coverage", f"SELECT * FROM {AXIS} a")
def axis_coverage(s, d):
    return axes(s, d)


@query(
    "choose_strategy",
    f"""{COMPONENTS}, {FLAGS}, c AS (SELECT image_id, count_if(gray > 200) / count(*) AS color_ratio FROM {GRID} g GROUP BY image_id)
 SELECT f.image_id, CASE WHEN color_ratio > 0 AND (color_ratio >= 0.025 OR artwork) THEN 'color' WHEN axis_coverage >= 0.72 THEN 'axis' WHEN elongated THEN 'elongated' WHEN dense_region THEN 'dense' ELSE 'outline' END AS strategy FROM f JOIN c ON f.image_id = c.image_id JOIN {AXIS} a ON a.image_id = f.image_id""",
)
def choose_strategy(s, d):
    share = grid(s, d).groupBy("image_id").agg((F.count_if(F.col("gray") > 200) / F.count("*")).alias("color_ratio"))
    return ra.choose_strategy(flags(s, d).join(share, "image_id").join(axes(s, d), "image_id")).select("image_id", "strategy")


def measured(s, d):
    l = labelled(s, d)
    n = l.groupBy("image_id").agg(F.countDistinct("label").alias("num_paths"), (F.count("*") / 64).alias("pixel_ratio"))
    return flags(s, d).join(n, "image_id")


REASON = "CASE WHEN num_paths = 0 THEN 'empty' WHEN artwork THEN 'artwork' WHEN num_paths <= 4 AND pixel_ratio < 0.002 THEN 'too few pixels' WHEN num_paths <= 4 AND large_bbox THEN 'blob' END"


@query("fallback_reason", f"{COMPONENTS}, {FLAGS} SELECT image_id, num_paths, {REASON} AS fallback_reason FROM f")
def fallback_reason(s, d):
    return ra.fallback_reason(measured(s, d)).select("image_id", "num_paths", "fallback_reason")


@query(
    "otsu_threshold",
    f"""WITH h AS (SELECT image_id, gray, count(*) AS n FROM {GRID} g GROUP BY image_id, gray), c AS (SELECT *, sum(n) OVER w AS w0, sum(n * gray) OVER w AS s0, sum(n) OVER p AS total, sum(n * gray) OVER p AS su FROM h WINDOW w AS (PARTITION BY image_id ORDER BY gray), p AS (PARTITION BY image_id)),
 b AS (SELECT image_id, gray, CAST(s0 * total - su * w0 AS DOUBLE) * CAST(s0 * total - su * w0 AS DOUBLE) / (CAST(w0 AS DOUBLE) * CAST(total - w0 AS DOUBLE)) AS v FROM c WHERE w0 < total) SELECT image_id, gray AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, gray) AS k FROM b) z WHERE k = 1""",
)
def otsu_threshold(s, d):
    return ra.otsu_threshold(grid(s, d))


@query("binarize", f"SELECT image_id, count_if(CASE WHEN m >= 127.5 THEN gray < 130 ELSE gray > 130 END) AS line_pixels FROM (SELECT *, avg(gray) OVER (PARTITION BY image_id) AS m FROM {GRID} g) z GROUP BY image_id")
def binarize(s, d):
    return ra.binarize(grid(s, d), 130).groupBy("image_id").agg(F.count_if("is_line").alias("line_pixels"))


def morph_sql(first: str, second: str) -> str:
    return f"""WITH g AS (SELECT image_id, y, x, gray FROM {GRID} z), a AS (SELECT p.image_id, p.y, p.x, {first}(q.gray) AS v FROM g p JOIN g q ON p.image_id = q.image_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY ALL),
 b AS (SELECT p.image_id, p.y, p.x, {second}(q.v) AS v FROM a p JOIN a q ON p.image_id = q.image_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY ALL) SELECT image_id, CAST(sum(v) AS BIGINT) AS total, CAST(max(v) AS INT) AS top FROM b GROUP BY image_id"""


@query("morphology_open", morph_sql("min", "max"))
def morphology_open(s, d):
    return ra.morphology(grid(s, d), "open").groupBy("image_id").agg(F.sum("open").alias("total"), F.max("open").alias("top"))


@query("morphology_close", morph_sql("max", "min"))
def morphology_close(s, d):
    return ra.morphology(grid(s, d), "close").groupBy("image_id").agg(F.sum("close").alias("total"), F.max("close").alias("top"))


def cross_sql(first: str, second: str) -> str:
    """Opening or closing by a cross of three."""
    near = "p.image_id = q.image_id AND abs(p.y - q.y) + abs(p.x - q.x) <= 1"
    return f"WITH a AS (SELECT p.image_id, p.y, p.x, {first}(q.gray) AS v FROM {GRID} p JOIN {GRID} q ON {near} GROUP BY ALL) SELECT p.image_id, CAST(p.y AS BIGINT) AS y, CAST(p.x AS BIGINT) AS x, CAST({second}(q.v) AS INT) AS v FROM a p JOIN a q ON {near} GROUP BY p.image_id, p.y, p.x"


@query("morphology_cross", cross_sql("max", "min"))
def morphology_cross(s, d):
    m = ra.morphology(grid(s, d), "close", shape="cross")
    return m.select("image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("close").cast("int").alias("v"))


@query(
    "elongated_centerlines",
    f"""{COMPONENTS}, k AS (SELECT l.* FROM l JOIN t ON l.image_id = t.image_id AND l.label = t.label WHERE area >= 4 AND greatest(width, height) >= 4 AND greatest(width, height) / least(width, height) >= 2 AND area / (width * height) >= 0.3),
 m AS (SELECT image_id, label, avg(x) AS mx, avg(y) AS my, atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) / 2 AS a FROM k GROUP BY image_id, label),
 w AS (SELECT k.image_id, k.label, any_value(mx) AS mx, any_value(my) AS my, any_value(a) AS a, min((x - mx) * cos(a) + (y - my) * sin(a)) AS lo, max((x - mx) * cos(a) + (y - my) * sin(a)) AS hi FROM k JOIN m ON k.image_id = m.image_id AND k.label = m.label GROUP BY k.image_id, k.label),
 r AS (SELECT image_id, label, round(mx + lo * cos(a), 3) + 0 AS x0, round(my + lo * sin(a), 3) + 0 AS y0, round(mx + hi * cos(a), 3) + 0 AS x1, round(my + hi * sin(a), 3) + 0 AS y1 FROM w), u AS (SELECT *, x0 < x1 OR x0 = x1 AND y0 <= y1 AS up FROM r)
 SELECT image_id, label, CASE WHEN up THEN x0 ELSE x1 END AS x0, CASE WHEN up THEN y0 ELSE y1 END AS y0, CASE WHEN up THEN x1 ELSE x0 END AS x1, CASE WHEN up THEN y1 ELSE y0 END AS y1 FROM u""",
)
def elongated_centerlines(s, d):
    """The ends in the order of (x, y): which way an axis points is not told."""
    c = ra.elongated_centerlines(labelled(s, d), 4, 4, 2.0, 0.3)
    end = lambda k: F.struct((F.round(f"x{k}", 3) + 0.0).alias("x"), (F.round(f"y{k}", 3) + 0.0).alias("y"))
    c = c.withColumn("a", F.least(end(0), end(1))).withColumn("b", F.greatest(end(0), end(1)))
    return c.select("image_id", "label", F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("b.x").alias("x1"), F.col("b.y").alias("y1"))


@query("pixel_graph", f"WITH o AS (SELECT image_id, y, x FROM {GRID} g WHERE is_on) SELECT p.image_id, CAST(p.y AS BIGINT) AS y, CAST(p.x AS BIGINT) AS x, count(q.x) AS degree, count(q.x) NOT IN (0, 2) AS is_node FROM o p LEFT JOIN o q ON p.image_id = q.image_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 AND (p.y <> q.y OR p.x <> q.x) GROUP BY p.image_id, p.y, p.x")
def pixel_graph(s, d):
    return ra.pixel_graph(on(s, d))


AT = "{0}.image_id = {1}.image_id AND {0}.p = {1}.{2}"


@query(
    "trace_graph_paths",
    f"""WITH RECURSIVE o AS (SELECT image_id, y * 8 + x AS p, y, x FROM {GRID} g WHERE is_on),
 d AS (SELECT unnest(range(8)) AS k, unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx),
 e AS (SELECT a.image_id, a.p, d.k, b.p AS q FROM o a CROSS JOIN d JOIN o b ON b.image_id = a.image_id AND b.y = a.y + d.dy AND b.x = a.x + d.dx),
 n AS (SELECT image_id, p, count(*) <> 2 AS node FROM e GROUP BY image_id, p),
 w AS (SELECT e.image_id, e.p AS sp, e.k AS sk, e.p AS prev, e.q AS cur, 1 AS seq FROM e JOIN n ON {AT.format("n", "e", "p")} WHERE node UNION ALL
 SELECT w.image_id, sp, sk, w.cur, e.q, seq + 1 FROM w JOIN n ON {AT.format("n", "w", "cur")} AND NOT n.node JOIN e ON {AT.format("e", "w", "cur")} AND e.q <> w.prev),
 kept AS (SELECT w.image_id, sp, sk FROM w JOIN n ON {AT.format("n", "w", "cur")} AND n.node JOIN e ON {AT.format("e", "w", "cur")} AND e.q = w.prev WHERE (sp, sk) <= (w.cur, e.k)),
 rest AS (SELECT image_id, p FROM n WHERE NOT node EXCEPT SELECT image_id, cur FROM w),
 reach AS (SELECT image_id, p, p AS q FROM rest UNION SELECT r.image_id, r.p, e.q FROM reach r JOIN e ON {AT.format("e", "r", "q")}),
 f AS (SELECT DISTINCT image_id, min(q) AS p FROM reach GROUP BY image_id, reach.p),
 l AS (SELECT e.image_id, e.p AS sp, min(e.k) AS sk FROM f JOIN e ON {AT.format("e", "f", "p")} GROUP BY e.image_id, e.p),
 r AS (SELECT e.image_id, sp, sk, e.p AS prev, e.q AS cur, 1 AS seq FROM l JOIN e ON {AT.format("e", "l", "sp")} AND e.k = l.sk UNION ALL
 SELECT r.image_id, sp, sk, r.cur, e.q, seq + 1 FROM r JOIN e ON {AT.format("e", "r", "cur")} AND e.q <> r.prev WHERE r.cur <> r.sp),
 t AS (SELECT image_id, sp, sk, false AS loop FROM kept UNION ALL SELECT image_id, sp, sk, true FROM l),
 i AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY loop, sp, sk) - 1 AS path_id FROM t),
 c AS (SELECT image_id, sp, sk, seq, cur AS p FROM w UNION ALL SELECT image_id, sp, sk, seq, cur FROM r UNION ALL SELECT image_id, sp, sk, 0, sp FROM t)
 SELECT c.image_id, path_id, CAST(seq AS BIGINT) AS seq, CAST(c.p // 8 AS BIGINT) AS y, CAST(c.p % 8 AS BIGINT) AS x FROM c JOIN i ON i.image_id = c.image_id AND i.sp = c.sp AND i.sk = c.sk""",
)
def trace_graph_paths(s, d):
    return ra.trace_graph_paths(on(s, d))


def skeleton_sql() -> str:
    """Rounds of erosion by a cross; an image of 8 x 8 is gone after four."""
    near = "a.image_id = b.image_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1"
    steps = [f"e0 AS (SELECT image_id, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x FROM {GRID} g WHERE is_on)"]
    steps += [f"e{k} AS (SELECT a.image_id, a.y, a.x FROM e{k - 1} a JOIN e{k - 1} b ON {near} GROUP BY ALL HAVING count(*) = 5)" for k in range(1, 6)]
    left = [f"(SELECT * FROM e{k} EXCEPT SELECT a.image_id, a.y, a.x FROM e{k} a JOIN e{k + 1} b ON {near})" for k in range(5)]
    return f"WITH {', '.join(steps)} {' UNION '.join(left)}"


@query("skeletonize", skeleton_sql())
def skeletonize(s, d):
    return ra.skeletonize(on(s, d))


@query("active_crop", f'SELECT image_id, greatest(0, min(x) - 8) AS "left", greatest(0, min(y) - 8) AS top, least(8, max(x) + 9) AS "right", least(8, max(y) + 9) AS bottom FROM {GRID} g WHERE is_on GROUP BY image_id')
def active_crop(s, d):
    return ra.active_crop(on(s, d), 8, 8)


LOSS = f"(SELECT p.image_id, p.value AS l, CASE WHEN q.is_on THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t, 1 / (1 + exp(-p.value)) AS p FROM {GRID} p JOIN {TRUTH} t ON p.label = t.label JOIN {GRID} q ON q.image_id = t.t AND q.y = p.y AND q.x = p.x)"


@query("segmentation_loss", f"WITH g AS (SELECT image_id, 1 - (2 * sum(p * t) + 1e-6) / (sum(p) + sum(t) + 1e-6) AS dice, sum(greatest(l, 0) - l * t + ln(1 + exp(-abs(l)))) AS bce, count(*) AS n FROM {LOSS} z GROUP BY image_id) SELECT round(avg(dice), 6) AS dice_loss, round(sum(bce) / sum(n), 6) AS bce_loss FROM g")
def segmentation_loss(s, d):
    g = grid(s, d)
    t = truth(s, d).withColumn("target", F.lit(1.0))
    px = g.select("image_id", "y", "x", F.col("value").alias("logit")).join(t, ["image_id", "y", "x"], "left").withColumn("target", F.coalesce("target", F.lit(0.0)))
    return ra.segmentation_loss(px).select(r("dice_loss", 6), r("bce_loss", 6))


@query("probability_mask", f"SELECT image_id, count_if(1 / (1 + exp(-value)) >= 0.55) AS pixels FROM {GRID} g GROUP BY image_id")
def probability_mask(s, d):
    return grid(s, d).groupBy("image_id").agg(F.count_if(geom.probability_mask(F.col("value"), 0.55)).alias("pixels"))


@query(
    "mask_report",
    f"""{COMPONENTS}, {FLAGS}, w AS (SELECT p.image_id, count_if(p.is_on AND q.is_on) AS tp, count_if(p.is_on AND NOT q.is_on) AS fp, count_if(NOT p.is_on AND q.is_on) AS fn FROM {GRID} p JOIN {TRUTH} u ON p.label = u.label JOIN {GRID} q ON q.image_id = u.t AND q.y = p.y AND q.x = p.x GROUP BY p.image_id)
 SELECT w.image_id, tp + fp AS raw_pixels, tp + fp AS clean_pixels, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall, round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 4) AS dice, round(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE tp / (tp + fp + fn) END, 4) AS iou,
 {REASON} AS fallback_reason, CASE WHEN {REASON} IS NULL THEN 'ml' ELSE 'classical' END AS effective_mode FROM w JOIN f ON w.image_id = f.image_id""",
)
def mask_report(s, d):
    return ra.mask_report(on(s, d), truth(s, d), measured(s, d))


# ------------------------------------------------------------------ experiments


@query("run_matrix", f"SELECT stem, m AS vision_mode, o AS path_ordering FROM (SELECT stem FROM {IMAGES} i) a CROSS JOIN (SELECT unnest(['classical', 'ml']) AS m) b CROSS JOIN (SELECT unnest(['nearest_neighbor', 'two_opt']) AS o) c")
def run_matrix(s, d):
    return ex.run_matrix(images(s, d).select("stem"), checkpoint=True)


@query("attach_truth", f"SELECT i.stem, i.path, m.path AS mask_path FROM {IMAGES} i LEFT JOIN (SELECT stem, min(path) AS path FROM {MASKS} z GROUP BY stem) m ON i.stem = m.stem")
def attach_truth(s, d):
    return ex.attach_truth(images(s, d).select("stem", "path"), masks(s, d))


@query("run_metrics")
def run_metrics(s, d):
    """A run for each drawing and ordering, from one cleaned set of paths; its mask is the one with the drawing's number."""
    before = written(paths(s, d), "run-paths")
    clean = written(st.clean_paths(before), "run-clean")
    runs_, plans, commands = None, None, None
    for method in ("nearest_neighbor", "two_opt"):
        run = F.concat_ws("__", "drawing_id", F.lit(method)).alias("run_id")
        p = written(od.order_paths(clean, method).select("drawing_id", F.col("pos").alias("path_id"), "points"), "run-order")
        own = before.select(run, "drawing_id", F.lit(method).alias("path_ordering")).distinct(), st.plan_metrics(p).withColumn("run_id", run).drop("drawing_id"), st.emit_commands(p).select(run)
        runs_, plans, commands = own if runs_ is None else (x.union(y) for x, y in zip((runs_, plans, commands), own, strict=True))
    overlap = ra.mask_overlap(on(s, d), truth(s, d)).withColumnRenamed("image_id", "drawing_id")
    return ex.run_metrics(runs_, plans, st.cleanup_stats(before, clean), commands, overlap)


def mean_sql(c: str, places: int, name: str) -> str:
    return f"round(CAST(sum(CAST({c} AS DECIMAL(28,6))) AS DOUBLE) / count({c}), {places}) AS {name}"


MEANS = (("num_paths", 2, "avg_paths"), ("num_commands", 2, "avg_commands"), ("pen_up_distance_mm", 2, "avg_pen_up_mm"), ("draw_distance_mm", 2, "avg_draw_mm"), ("mask_dice", 4, "avg_dice"), ("mask_iou", 4, "avg_iou"))


@query("variant_aggregates", f"SELECT vision_mode, path_ordering, count(*) AS runs, {', '.join(mean_sql(*m) for m in MEANS)} FROM {RUNS} r GROUP BY vision_mode, path_ordering")
def variant_aggregates(s, d):
    return ex.variant_aggregates(runs(s, d))


PLANNING = f"(SELECT image, vision_mode, max(CASE WHEN path_ordering = 'nearest_neighbor' THEN pen_up_distance_mm END) AS base_mm, max(CASE WHEN path_ordering = 'two_opt' THEN pen_up_distance_mm END) AS improved_mm FROM {RUNS} r GROUP BY image, vision_mode HAVING count(DISTINCT path_ordering) = 2)"
SAVED = "round(base_mm - improved_mm, 2) AS saved_mm, CASE WHEN base_mm = 0 THEN 0 ELSE round((base_mm - improved_mm) / base_mm * 100, 2) END AS saved_pct"


MODES = f"(SELECT image, vision_mode, max(CASE WHEN path_ordering = 'nearest_neighbor' THEN effective_vision_mode END) AS bm, max(CASE WHEN path_ordering = 'two_opt' THEN effective_vision_mode END) AS im, string_agg(DISTINCT trim(fallback_reason), ', ' ORDER BY trim(fallback_reason)) FILTER (WHERE trim(fallback_reason) <> '') AS why FROM {RUNS} r GROUP BY image, vision_mode)"


SIDES = f"(SELECT image, vision_mode, max(num_commands) FILTER (path_ordering = 'nearest_neighbor') AS base_commands, max(num_commands) FILTER (path_ordering = 'two_opt') AS improved_commands, max(num_paths) FILTER (path_ordering = 'nearest_neighbor') AS base_paths, max(num_paths) FILTER (path_ordering = 'two_opt') AS improved_paths FROM {RUNS} r GROUP BY image, vision_mode)"


@query("planning_comparison", f"SELECT p.image, p.vision_mode, base_mm, improved_mm, base_commands, improved_commands, base_paths, improved_paths, bm AS base_mode, im AS improved_mode, {SAVED}, CASE WHEN bm = im THEN bm ELSE 'mixed' END AS effective_mode, CASE WHEN p.vision_mode = 'ml' AND (bm <> 'ml' OR im <> 'ml') THEN concat('ran as ', bm, ' and ', im, CASE WHEN why IS NULL THEN '' ELSE concat(': ', why) END) END AS note FROM {PLANNING} p JOIN {MODES} m ON p.image = m.image AND p.vision_mode = m.vision_mode JOIN {SIDES} s ON s.image = p.image AND s.vision_mode = p.vision_mode")
def planning_comparison(s, d):
    return ex.planning_comparison(runs(s, d))


VISION = f"(SELECT a.image, a.path_ordering, round(b.mask_dice - a.mask_dice, 4) AS dice_delta, b.num_commands - a.num_commands AS commands_delta, round(b.pen_up_distance_mm - a.pen_up_distance_mm, 2) AS pen_up_delta_mm, CASE WHEN b.effective_vision_mode <> 'ml' THEN concat('ml ran as ', b.effective_vision_mode, CASE WHEN trim(b.fallback_reason) <> '' THEN concat(': ', trim(b.fallback_reason)) ELSE '' END) END AS note FROM {RUNS} a JOIN {RUNS} b ON a.image = b.image AND a.path_ordering = b.path_ordering AND a.vision_mode = 'classical' AND b.vision_mode = 'ml')"


@query("vision_comparison", f"SELECT * FROM {VISION} v")
def vision_comparison(s, d):
    return ex.vision_comparison(runs(s, d))


@query("experiment_totals", f"SELECT count(*) AS run_count, count(DISTINCT image) AS image_count FROM {RUNS} r")
def experiment_totals(s, d):
    return ex.experiment_totals(runs(s, d))


@query("planning_table", f"SELECT r.image, r.vision_mode, r.path_ordering, num_paths, num_commands, pen_up_distance_mm, saved_pct, CASE WHEN saved_pct IS NULL THEN 'no comparison' WHEN saved_pct > 0 THEN 'improved' WHEN saved_pct = 0 THEN 'same' ELSE 'worse' END AS observation FROM {RUNS} r LEFT JOIN (SELECT image, vision_mode, {SAVED} FROM {PLANNING} p) q ON r.image = q.image AND r.vision_mode = q.vision_mode")
def planning_table(s, d):
    return ex.planning_table(runs(s, d), ex.planning_comparison(runs(s, d)))


@query("perception_table", f"SELECT r.image, r.path_ordering, r.vision_mode, num_commands, mask_dice, dice_delta, CASE WHEN mask_dice IS NULL THEN 'no truth' WHEN dice_delta IS NULL THEN 'single mode' WHEN dice_delta > 0 THEN 'ml better' ELSE 'classical better or equal' END AS observation FROM {RUNS} r LEFT JOIN {VISION} v ON r.image = v.image AND r.path_ordering = v.path_ordering WHERE r.path_ordering = 'two_opt'")
def perception_table(s, d):
    return ex.perception_table(runs(s, d), ex.vision_comparison(runs(s, d)))


@query(
    "highlights",
    f"""SELECT (SELECT concat_ws('/', image, vision_mode, path_ordering) FROM {RUNS} r ORDER BY pen_up_distance_mm, image, vision_mode, path_ordering LIMIT 1) AS least_pen_up, (SELECT concat_ws('/', image, vision_mode, path_ordering) FROM {RUNS} r WHERE mask_dice IS NOT NULL ORDER BY mask_dice DESC, image, vision_mode, path_ordering LIMIT 1) AS best_dice,
 (SELECT image FROM {VISION} v WHERE dice_delta IS NOT NULL ORDER BY dice_delta DESC, image, path_ordering LIMIT 1) AS best_dice_delta, (SELECT image FROM {PLANNING} p ORDER BY image, vision_mode LIMIT 1) AS first_planning, (SELECT image FROM {PLANNING} p ORDER BY round(base_mm - improved_mm, 2) DESC, image, vision_mode LIMIT 1) AS best_planning""",
)
def highlights(s, d):
    x = runs(s, d)
    return ex.highlights(x, ex.vision_comparison(x), ex.planning_comparison(x))


@query("variant_delta", f"SELECT image, raw, cleaned, raw - cleaned AS saved, CASE WHEN raw = 0 THEN 0 ELSE round((raw - cleaned) / raw * 100, 2) END AS saved_pct FROM (SELECT image, CAST(sum(CASE WHEN vision_mode = 'classical' THEN num_commands END) AS BIGINT) AS raw, CAST(sum(CASE WHEN vision_mode = 'ml' THEN num_commands END) AS BIGINT) AS cleaned FROM {RUNS} r GROUP BY image) z WHERE raw IS NOT NULL AND cleaned IS NOT NULL")
def variant_delta(s, d):
    return ex.variant_delta(runs(s, d), "vision_mode", "classical", "ml")


@query("calibration", f"SELECT device, count(*) AS n, round(10 * sum(measured) / sum(commanded), 6) AS mm_per_unit, round(sum(commanded) / sum(measured), 6) AS turn_scale FROM {OBS} o WHERE commanded > 0 AND measured > 0 GROUP BY device")
def calibration(s, d):
    return ex.calibration(observations(s, d)).select("device", "n", r("mm_per_unit", 6), r("turn_scale", 6))


HISTORY = f"(SELECT *, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM {HIST} h)"


STEP_VIEW = "SELECT user_id AS run_id, event_id % 7 AS epoch, CASE WHEN event_type = 'error' THEN 'val' ELSE 'train' END AS phase, CAST(value AS DOUBLE) AS loss FROM {events}"
step_rows, STEP_ROWS = (lambda s, d: fx.spark_view(s, d, STEP_VIEW)), fx.duck(STEP_VIEW)


@query(
    "epoch_losses",
    f"""SELECT run_id, epoch, floor(coalesce(CAST(sum(CAST(loss AS DECIMAL(28,6))) FILTER (phase = 'train') AS DOUBLE) / nullif(count(*) FILTER (phase = 'train'), 0), 0) * 1e4 + 0.25) AS train_loss,
 floor(CAST(sum(CAST(loss AS DECIMAL(28,6))) FILTER (phase = 'val') AS DOUBLE) / nullif(count(*) FILTER (phase = 'val'), 0) * 1e4 + 0.25) AS val_loss FROM {STEP_ROWS} e GROUP BY run_id, epoch""",
)
def epoch_losses(s, d):
    """Ten thousandths, cut at a quarter: a half would be decided by the last bit."""
    cut = lambda c: F.floor(F.col(c) * 1e4 + 0.25).cast("double").alias(c)
    return ex.epoch_losses(step_rows(s, d)).select("run_id", "epoch", cut("train_loss"), cut("val_loss"))


@query("training_history", f"SELECT run_id, epoch, round(val_loss, 6) AS val_loss, is_best FROM {HISTORY} h")
def training_history(s, d):
    return ex.training_history(histories(s, d)).select("run_id", "epoch", r("val_loss", 6), "is_best")


@query("run_summary", f"SELECT run_id, count(*) AS epochs, round(arg_max(train_loss, epoch), 6) AS last_train_loss, round(arg_max(val_loss, epoch), 6) AS last_val_loss, max(CASE WHEN is_best THEN epoch END) AS best_epoch, round(min(val_loss), 6) AS best_val_loss, round(count(*) / 60.0::DOUBLE * 100, 2) AS progress_pct, CASE WHEN count(*) >= 60 THEN 'completed' ELSE 'running' END AS status FROM {HISTORY} h GROUP BY run_id")
def run_summary(s, d):
    return ex.run_summary(histories(s, d), 60)


@query("latest_run", "SELECT o_custkey AS device, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY o_custkey".replace("max_by(o_orderkey, (o_orderdate, o_orderkey))", "arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey})"))
def latest_run(s, d):
    o = fx.read(s, d, "orders").withColumnRenamed("o_custkey", "device")
    return ex.latest_run(o, "device", "o_orderkey", "o_orderdate")


@query("recommended_artifact", "SELECT min(p_name) AS name FROM part WHERE p_name = (SELECT max(p_name) FROM part)")
def recommended_artifact(s, d):
    p = fx.read(s, d, "part").select(F.col("p_name").alias("name"), F.col("p_name").alias("modified"))
    return ex.recommended_artifact(p, ["line_net_best.pt"])


HISTOGRAM = f"(SELECT session_id, cmd, count(*) AS n, list_position(['START', 'PEN_UP', 'PEN_DOWN', 'MOVE', 'END', 'PING'], cmd) AS k FROM {SESS} z GROUP BY session_id, cmd)"


@query("command_histogram", f"SELECT session_id, string_agg(concat(cmd, '=', n), ', ' ORDER BY k) AS summary FROM {HISTOGRAM} h GROUP BY session_id")
def command_histogram(s, d):
    return ex.command_histogram(sessions(s, d))


# ------------------------------------------------------------------ command streams, files, generators


@query("session_wrap", f"SELECT session_id, CAST(seq AS BIGINT) AS seq, cmd FROM {SESS} z UNION ALL SELECT session_id, -2, 'PING' FROM (SELECT DISTINCT session_id FROM {SESS} z) a UNION ALL SELECT session_id, -1, 'START' FROM (SELECT DISTINCT session_id FROM {SESS} z) a UNION ALL SELECT session_id, max(seq) + 1, 'END' FROM {SESS} z GROUP BY session_id")
def session_wrap(s, d):
    return sc.session_wrap(sessions(s, d)).select("session_id", "seq", "cmd")


WRAPPED = f"""(SELECT session_id, CAST(seq AS BIGINT) AS seq, cmd, x, y FROM {TRACKED} z
 UNION ALL SELECT session_id, unnest([-2, -1]), unnest(['PING', 'START']), NULL, NULL FROM (SELECT DISTINCT session_id FROM {TRACKED} z) a
 UNION ALL SELECT session_id, max(seq) + 1, 'END', NULL, NULL FROM {TRACKED} z GROUP BY session_id)"""
POSES = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS i FROM {WRAPPED} w),
 k AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS cmd, CAST(0 AS DOUBLE) AS px, CAST(0 AS DOUBLE) AS py,
 CAST(0 AS DOUBLE) AS heading, false AS pen, false AS pen_before, false AS moved, CAST(0 AS DOUBLE) AS d, CAST(0 AS DOUBLE) AS delta FROM o UNION ALL
 SELECT session_id, i, seq, cmd, CASE WHEN cmd = 'START' THEN 0 WHEN moved THEN x ELSE px END, CASE WHEN cmd = 'START' THEN 0 WHEN moved THEN y ELSE py END,
 CASE WHEN cmd = 'START' THEN 0 WHEN moved THEN toward ELSE heading END, CASE WHEN cmd IN ('START', 'PEN_UP', 'END') THEN false WHEN cmd = 'PEN_DOWN' THEN true ELSE pen END,
 pen, moved, d, 180 - (((180 - (toward - heading)) % 360) + 360) % 360 FROM (SELECT o.*, k.px, k.py, k.heading, k.pen, sqrt((o.x - k.px) * (o.x - k.px) + (o.y - k.py) * (o.y - k.py)) AS d,
 degrees(atan2(-(o.y - k.py), o.x - k.px)) AS toward, coalesce(o.cmd = 'MOVE' AND sqrt((o.x - k.px) * (o.x - k.px) + (o.y - k.py) * (o.y - k.py)) >= 1, false) AS moved
 FROM k JOIN o ON o.session_id = k.session_id AND o.i = k.i + 1) s)"""


@query(
    "pose_tracker",
    f"""{POSES} SELECT session_id, seq, cmd, round(px, 3) AS px, round(py, 3) AS py, round(heading, 3) AS heading, pen AS pen_down, round(CASE WHEN moved AND abs(delta) >= 1 THEN delta ELSE 0 END, 3) AS turn,
 CASE WHEN moved THEN pen_before AND abs(delta) >= 30 ELSE pen_before AND cmd IN ('START', 'PEN_UP', 'END') END AS lift, CASE WHEN moved THEN CAST(format('{{:.2f}}', d / 10) AS DOUBLE) ELSE 0 END AS straight FROM k WHERE i > 0""",
)
def pose_tracker(s, d):
    p = sc.pose_batch(sc.session_wrap(tracked(s, d)))
    return p.select("session_id", "seq", "cmd", r("px", 3), r("py", 3), r("heading", 3), "pen_down", r("turn", 3), "lift", r("straight", 2))


@query("quarantine", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'bad json' WHEN 1 THEN 'not an object' WHEN 2 THEN 'missing cmd' WHEN 3 THEN 'unknown cmd' WHEN 4 THEN 'too long' END AS error_kind FROM events")
def quarantine(s, d):
    bad = F.array(F.lit("{"), F.lit("[]"), F.lit('{"x":1}'), F.lit('{"cmd":"SPIN"}'), F.concat(F.lit('{"cmd":"'), F.repeat(F.lit("M"), 9000), F.lit('"}')), F.lit('{"cmd":"MOVE","x":1,"y":2}'))
    lines = fx.read(s, d, "events").select("event_id", F.get(bad, (F.col("event_id") % 6).cast("int")).alias("value"))
    return sc.quarantine(lines).select("event_id", "error_kind")


@query("command_lines", f"SELECT session_id, CAST(seq AS BIGINT) AS seq, CASE WHEN cmd = 'MOVE' THEN printf('MOVE %.2f %.2f 35.00', floor(x), y) ELSE cmd END AS line FROM {SESS} z")
def command_lines(s, d):
    rows = sessions(s, d).withColumn("x", F.floor("x").cast("double"))
    return files.command_lines(rows).select("session_id", F.col("seq").cast("bigint").alias("seq"), "line")


@query("parse_command_lines", f"SELECT session_id, CAST(seq AS BIGINT) AS seq, cmd, CASE WHEN cmd = 'MOVE' THEN floor(x) END AS x, y, CASE WHEN cmd = 'MOVE' AND seq % 10 = 0 THEN 'bad MOVE' END AS error FROM {SESS} z".replace("CASE WHEN cmd = 'MOVE' THEN floor(x) END AS x, y", "CASE WHEN cmd = 'MOVE' AND seq % 10 <> 0 THEN floor(x) END AS x, CASE WHEN seq % 10 <> 0 THEN y END AS y"))
def parse_command_lines(s, d):
    rows = files.command_lines(sessions(s, d).withColumn("x", F.floor("x").cast("double")))
    lines = rows.select("session_id", F.col("seq").cast("bigint").alias("seq"), F.when((F.col("cmd") == "MOVE") & (F.col("seq") % 10 == 0), F.concat("line", F.lit(" 1"))).otherwise(F.col("line")).alias("value"))
    return files.parse_command_lines(lines).select("session_id", "seq", "cmd", "x", "y", "error")


@query("scorecard", f"SELECT image, vision_mode, path_ordering, num_paths, num_commands, pen_up_distance_mm, draw_distance_mm, '' AS line_quality, '' AS shape_match, '' AS travel, '' AS notes FROM {RUNS} r")
def scorecard(s, d):
    return files.scorecard(runs(s, d))


@query(
    "run_summary_documents",
    f"""WITH e AS (SELECT *, lag(bx) OVER (PARTITION BY drawing_id ORDER BY path_id) AS lx, lag(b_y) OVER (PARTITION BY drawing_id ORDER BY path_id) AS ly FROM {ENDS} z WHERE n >= 2),
 m AS (SELECT drawing_id, count(*) AS num_paths, sum(sqrt((ax - coalesce(lx, 0)) * (ax - coalesce(lx, 0)) + (ay - coalesce(ly, 0)) * (ay - coalesce(ly, 0)))) + sum(draw) AS total FROM e GROUP BY drawing_id),
 p AS (SELECT drawing_id, path_id, n, ax, row_number() OVER (PARTITION BY drawing_id ORDER BY path_id) AS k FROM {ENDS} z)
 SELECT m.drawing_id, num_paths, floor((total + 0.005) / 10) AS total_cm, count(*) AS shown, CAST(sum(least(n, 5)) AS BIGINT) AS points, arg_min(path_id, k) AS first_path, arg_min(ax, k) AS first_x FROM m JOIN p ON m.drawing_id = p.drawing_id WHERE k <= 3 GROUP BY m.drawing_id, num_paths, total""",
)
def run_summary_documents(s, d):
    """The documents, read again."""
    p = paths(s, d)
    shape = "num_paths bigint, total_mm double, preview array<struct<path_id:bigint,points:array<struct<x:double,y:double>>>>"
    doc = files.run_summary_json(p, st.plan_metrics(p)).select("drawing_id", F.from_json("summary", shape).alias("s"))
    points = F.aggregate("s.preview", F.lit(0), lambda a, x: a + F.size(x["points"]))
    first = F.get("s.preview", F.lit(0))
    return doc.select("drawing_id", "s.num_paths", F.floor((F.col("s.total_mm") + 0.005) / 10).cast("double").alias("total_cm"), F.size("s.preview").cast("bigint").alias("shown"), points.cast("bigint").alias("points"), first["path_id"].alias("first_path"), F.get(first["points"], F.lit(0))["x"].alias("first_x"))


@query("manifest_documents", "SELECT source AS split, count(*) OVER (PARTITION BY source) AS pair_count, CAST(doc_id AS VARCHAR) AS stem, concat('m/', doc_id) AS mask FROM documents")
def manifest_documents(s, d):
    """The pairs of the documents that the lines make, read again."""
    p = fx.read(s, d, "documents").select(F.col("source").alias("split"), F.col("doc_id").cast("string").alias("stem"), F.lit("i").alias("image"), F.concat(F.lit("m/"), "doc_id").alias("mask"))
    lines = F.array_sort(F.collect_list(F.struct("part", "place", "line")))
    # the documents of this check are put together in one row each; written manifests are not
    doc = files.manifest_lines(p, rows=100).groupBy("split").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("doc"))
    read = doc.select(F.from_json("doc", "split string, seed int, pair_count bigint, pairs array<struct<stem:string,image:string,mask:string>>").alias("d"))
    return read.select("d.split", "d.pair_count", F.inline("d.pairs")).drop("image")


PATTERNS = [("line", 0, [(0, 0), (100, 0)]), ("square", 0, [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)])]
PATTERNS += [("pen_gaps", i, [(35 * i, 30), (35 * i + 20, 30)]) for i in range(5)] + [("ruler", i, [(0, 120 + 20 * i), (n, 120 + 20 * i)]) for i, n in enumerate((50, 100, 150))]
STEPS = [(name, k, j, *row) for name, k, points in PATTERNS for j, row in enumerate([("PEN_UP", None, None, None), ("MOVE", *points[0], 60), ("PEN_DOWN", None, None, None), *(("MOVE", *p, 35) for p in points[1:]), ("PEN_UP", None, None, None)])]
STEPS_SQL = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in STEPS)


@query("calibration_patterns", f"SELECT s_suppkey AS device, pattern, CAST(row_number() OVER (PARTITION BY s_suppkey, pattern ORDER BY k, j) - 1 AS INT) AS seq, cmd, CAST(s_suppkey + x AS DOUBLE) AS x, CAST(20 + y AS DOUBLE) AS y, CAST(speed AS DOUBLE) AS speed FROM supplier CROSS JOIN (VALUES {STEPS_SQL}) z(pattern, k, j, cmd, x, y, speed)")
def calibration_patterns(s, d):
    dev = fx.read(s, d, "supplier").select(F.col("s_suppkey").alias("device"), F.col("s_suppkey").cast("double").alias("x"), F.lit(20.0).alias("y"), F.lit(100.0).alias("size"))
    return ge.calibration_patterns(dev)


@query(
    "square_actions",
    "SELECT s_suppkey AS device, CAST(k AS INT) AS seq, CASE k WHEN 0 THEN 'PU' WHEN 1 THEN 'PD' WHEN 9 THEN 'PU' ELSE CASE k % 2 WHEN 0 THEN 'ST' ELSE 'TR' END END AS op, CASE WHEN k IN (0, 1, 9) THEN NULL WHEN k % 2 = 0 THEN (s_suppkey % 7 + 5)::DOUBLE ELSE 90 END AS value FROM supplier CROSS JOIN (SELECT unnest(range(10)) AS k) z",
)
def square_actions(s, d):
    dev = fx.read(s, d, "supplier").select(F.col("s_suppkey").alias("device"), ((F.col("s_suppkey") % 7 + 5) * 10).cast("double").alias("size"))
    return ge.square_actions(dev)


@query("square_from_pose", "SELECT s_suppkey AS device, CAST(k AS INT) AS corner, round(s_suppkey + 10 * CASE k WHEN 1 THEN cos(a) WHEN 2 THEN cos(a) - sin(a) WHEN 3 THEN -sin(a) ELSE 0 END, 4) + 0 AS x, round(50 - 10 * CASE k WHEN 1 THEN sin(a) WHEN 2 THEN sin(a) + cos(a) WHEN 3 THEN cos(a) ELSE 0 END, 4) + 0 AS y FROM (SELECT *, radians(s_suppkey % 360) AS a FROM supplier) s CROSS JOIN (SELECT unnest(range(5)) AS k) z")
def square_from_pose(s, d):
    k = F.col("s_suppkey")
    dev = fx.read(s, d, "supplier").select(k.alias("device"), k.cast("double").alias("x"), F.lit(50.0).alias("y"), (k % 360).cast("double").alias("heading"), F.lit(10.0).alias("size"))
    p = ge.square_from_pose(dev)
    return p.select("device", "corner", (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


@query("star_polygon", "SELECT p_partkey, i, CAST(round_even(100 + CASE i % 2 WHEN 0 THEN 50 ELSE 20 END * cos(i * pi() / n), 0) AS INT) AS x, CAST(round_even(100 + CASE i % 2 WHEN 0 THEN 50 ELSE 20 END * sin(i * pi() / n), 0) AS INT) AS y FROM (SELECT p_partkey, p_size % 5 + 3 AS n, unnest(range(2 * (p_size % 5 + 3))) AS i FROM part) z")
def star_polygon(s, d):
    p = fx.read(s, d, "part").select("p_partkey", (F.col("p_size") % 5 + 3).cast("int").alias("n"))
    star = ge.star_polygon(F.lit(100.0), F.lit(100.0), F.lit(50.0), F.lit(20.0), F.col("n"), F.lit(0.0))
    return p.select("p_partkey", F.posexplode(star).alias("i", "v")).select("p_partkey", F.col("i").cast("bigint").alias("i"), "v.x", "v.y")


@query("regular_polygon", "SELECT p_partkey, i, CAST(round_even(100 + 50 * cos(i * 2 * pi() / n), 0) AS INT) AS x, CAST(round_even(100 + 50 * sin(i * 2 * pi() / n), 0) AS INT) AS y FROM (SELECT p_partkey, p_size % 5 + 3 AS n, unnest(range(p_size % 5 + 3)) AS i FROM part) z")
def regular_polygon(s, d):
    p = fx.read(s, d, "part").select("p_partkey", (F.col("p_size") % 5 + 3).cast("int").alias("n"))
    poly = ge.regular_polygon(F.lit(100.0), F.lit(100.0), F.lit(50.0), F.col("n"), F.lit(0.0))
    return p.select("p_partkey", F.posexplode(poly).alias("i", "v")).select("p_partkey", F.col("i").cast("bigint").alias("i"), "v.x", "v.y")


@query("sample_plan", "SELECT doc_id AS id, printf('s_%05d', doc_id) AS stem, true AS in_range FROM documents WHERE lang <> 'en' AND doc_id < (SELECT count(*) FROM documents)")
def sample_plan(s, d):
    docs = fx.read(s, d, "documents")
    n = docs.count()
    have = docs.filter("lang = 'en'").select(F.format_string("s_%05d", "doc_id").alias("stem"))
    p = ge.sample_plan(s, n, "s", have)
    return p.select("id", "stem", (F.col("size").between(180, 320) & F.col("sides").between(3, 8) & F.col("rotation").between(0, 359)).alias("in_range"))


# ------------------------------------------------------------------ files: written, read again, compared


def new_folder(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query(
    "commands_text_files",
    f"SELECT session_id, CAST(seq AS BIGINT) AS seq, cmd, CASE WHEN cmd = 'MOVE' THEN floor(x) END AS x, CAST(CASE WHEN cmd = 'MOVE' THEN format('{{:.2f}}', y) END AS DOUBLE) AS y, speed FROM {SESS} z",
)
def commands_text_files(s, d):
    """A file for each session; a line's number in it is its seq."""
    folder = new_folder(s, "commands-text")
    files.write_commands_text(sessions(s, d).withColumn("x", F.floor("x").cast("double")), folder)
    good, _ = files.read_commands_text(s, folder)
    w = Window.partitionBy("file").orderBy("seq")
    session = F.regexp_extract("file", "session_id=([0-9]+)", 1).cast("bigint")
    return good.select(session.alias("session_id"), F.row_number().over(w).cast("bigint").alias("seq"), "cmd", "x", "y", "speed")


@query("commands_jsonl_files", f"SELECT cmd, x, y, speed FROM {SESS} z")
def commands_jsonl_files(s, d):
    folder = new_folder(s, "commands-jsonl")
    files.write_commands_jsonl(sessions(s, d), folder)
    return files.read_commands_jsonl(s, folder)


@query("report_csv_files", f"SELECT image, vision_mode, path_ordering, num_commands, pen_up_distance_mm, mask_dice FROM {RUNS} r")
def report_csv_files(s, d):
    folder, columns = new_folder(s, "report"), ["image", "vision_mode", "path_ordering", "num_commands", "pen_up_distance_mm", "mask_dice"]
    files.write_report_csv(runs(s, d), folder, columns)
    return s.read.schema("image string, vision_mode string, path_ordering string, num_commands bigint, pen_up_distance_mm double, mask_dice double").option("header", True).csv(folder)


@query("split_list_files", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM documents")
def split_list_files(s, d):
    """Lines of split and id, in as many files as tasks."""
    folder, k = new_folder(s, "split-lists"), F.col("doc_id") % 3
    name = F.when(k == 0, "training").when(k == 1, "Valid").otherwise("te")
    fx.read(s, d, "documents").select(F.concat(name, F.lit(": "), F.col("doc_id").cast("string")).alias("value")).write.text(folder)
    return cu.parse_split_assignments(files.read_split_files(s, folder))


@query("manifest_files", "SELECT source AS split, CAST(doc_id AS VARCHAR) AS stem, concat('i/', doc_id) AS image, concat('m/', doc_id) AS mask FROM documents")
def manifest_files(s, d):
    """One published file for each source."""
    folder, i = new_folder(s, "manifests"), F.col("doc_id").cast("string")
    pairs = fx.read(s, d, "documents").select(F.col("source").alias("split"), i.alias("stem"), F.concat(F.lit("i/"), i).alias("image"), F.concat(F.lit("m/"), i).alias("mask"))
    manifest.publish_manifest(pairs, folder)
    return files.read_manifest(s, folder)


@query("command_log_stream", f"SELECT cmd, x, y, speed FROM {SESS} z")
def command_log_stream(s, d):
    """Commands as JSON lines of log files, taken up by the streaming source in two runs of one query."""
    logs, out, seen = (new_folder(s, name) for name in ("logs", "log-lines", "log-checkpoint"))
    lines = sessions(s, d).select(F.to_json(F.struct("cmd", "x", "y", "speed")).alias("value"), (F.col("session_id") % 2).alias("half"))
    for half in (0, 1):
        lines.filter(F.col("half") == half).select("value").write.mode("append").text(logs)
        stream = live.log_stream(s, logs, ".txt").writeStream.format("parquet").option("path", out).option("checkpointLocation", seen)
        stream.trigger(availableNow=True).start().awaitTermination()
    taken = s.read.schema("log string, at bigint, value string").parquet(out)
    return sc.quarantine(taken).filter("error_kind IS NULL").select("cmd", "x", "y", "speed")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["drawing_pipeline"](spark, sf_dir)


