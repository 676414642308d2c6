"""Operators that SQL can't express, against small independent versions."""

import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from strokemill.operators import experiments, loops, ordering, raster, strokes
from strokemill.plans import drawing
from strokemill.sources import files
from strokemill.streaming import commands as sc

PATHS = "drawing_id bigint, path_id bigint, points array<struct<x:double,y:double>>"


def made(spark, rows):
    return spark.createDataFrame([(d, p, [{"x": float(x), "y": float(y)} for x, y in pts]) for d, p, pts in rows], PATHS)


def some_paths(n=12, seed=1, drawings=3):
    rng = random.Random(seed)
    return [(d, p, [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(rng.randint(1, 6))]) for d in range(drawings) for p in range(n)]


def greedy(rows):
    here, left, out = (0.0, 0.0), list(rows), []
    while left:
        best = min(((math.dist(here, pts[0 if not f else -1]), i, f) for i, (_, pts) in enumerate(left) for f in (0, 1)), key=lambda t: t)
        p, pts = left.pop(best[1])
        out.append((p, bool(best[2])))
        here = pts[0] if best[2] else pts[-1]
    return out


def test_nearest_is_greedy(spark):
    rows = some_paths()
    got = ordering.order_paths(made(spark, rows)).orderBy("drawing_id", "pos").collect()
    for d in range(3):
        assert [(r.path_id, r.flipped) for r in got if r.drawing_id == d] == greedy([(p, pts) for e, p, pts in rows if e == d])


def test_large_drawings_are_ordered(spark):
    rng = random.Random(9)
    rows = [(1, p, [(rng.randint(0, 60), rng.randint(0, 60)), (rng.randint(0, 60), rng.randint(0, 60))]) for p in range(2100)]
    ends = np.array([pts for _, _, pts in rows], float)
    plain = ordering.nearest(ends[:, 0], ends[:, 1], np.array([0.0, 0.0]), grid=10_000)
    assert ordering.nearest(ends[:, 0], ends[:, 1], np.array([0.0, 0.0])) == plain
    way = {}
    for m in ("nearest_neighbor", "two_opt"):
        o = ordering.order_paths(made(spark, rows), m).orderBy("pos").collect()
        if m == "nearest_neighbor":
            assert [(r.path_id, r.flipped) for r in o] == list(zip(*plain, strict=True))
        way[m] = sum(math.dist(a.points[-1], b.points[0]) for a, b in zip(o, o[1:]))
    given = sum(math.dist(a[2][-1], b[2][0]) for a, b in zip(rows, rows[1:]))
    assert way["two_opt"] <= way["nearest_neighbor"] < given / 10


def test_two_opt_never_longer(spark):
    p = made(spark, [r for r in some_paths(seed=4) if len(r[2]) > 1])
    way = {}
    for m in ("nearest_neighbor", "two_opt"):
        o = ordering.order_paths(p, m).select("drawing_id", F.col("pos").alias("path_id"), "points")
        way[m] = {r.drawing_id: r.pen_up_mm for r in strokes.plan_metrics(o).collect()}
    assert all(way["two_opt"][d] <= way["nearest_neighbor"][d] + 1e-9 for d in way["two_opt"])


def test_stitch_joins_and_reverses(spark):
    p = made(spark, [(1, 0, [(0, 0), (1, 0)]), (1, 1, [(2, 0), (1, 0)]), (1, 2, [(9, 9), (8, 8)])])
    got = strokes.stitch_paths(p).orderBy("path_id").collect()
    assert [[(q.x, q.y) for q in r.points] for r in got] == [[(0, 0), (1, 0), (2, 0)], [(9, 9), (8, 8)]]


def test_simplify_and_collapse(spark):
    p = made(spark, [(1, 0, [(0, 0), (0.1, 0), (5, 0.1), (10, 0)]), (1, 1, [(0, 0), (1, 0)])])
    got = {r.path_id: [(q.x, q.y) for q in r.points] for r in strokes.clean_paths(p).collect()}
    assert got == {0: [(0, 0), (10, 0)]}


def test_commands_round_trip(spark):
    p = made(spark, [(1, 0, [(5, 5), (9, 5), (9, 9)]), (1, 1, [(1, 1), (3, 3)])])
    c = strokes.emit_commands(p).withColumnRenamed("drawing_id", "session_id")
    lines = files.command_lines(c).select("session_id", "seq", F.col("line").alias("value"))
    back = files.parse_command_lines(lines)
    assert back.filter("error IS NOT NULL").count() == 0
    got = strokes.extract_strokes(back.select("session_id", "seq", "cmd", "x", "y", "speed")).orderBy("stroke_id", "seq").collect()
    assert [(r.stroke_id, r.x, r.y) for r in got] == [(1, 5, 5), (1, 9, 5), (1, 9, 9), (2, 1, 1), (2, 3, 3)]


def test_components_match_flood_fill(spark):
    rng = random.Random(3)
    px = {(i, y, x) for i in range(4) for y in range(8) for x in range(8) if rng.random() < 0.4}
    got = raster.connected_components(spark.createDataFrame(sorted(px), "image_id bigint, y int, x int")).collect()
    label = {(r.image_id, r.y, r.x): r.label for r in got}
    seen = {}
    for p in sorted(px):
        if p in seen:
            continue
        todo, seen[p] = [p], p
        while todo:
            i, y, x = todo.pop()
            for dy, dx in raster.AROUND:
                q = (i, y + dy, x + dx)
                if q in px and q not in seen:
                    seen[q] = p
                    todo.append(q)
    assert set(label) == px
    assert len({(k[0], label[k]) for k in px}) == len({seen[k] for k in px})
    assert all((label[a] == label[b]) == (seen[a] == seen[b]) for a in px for b in px if a[0] == b[0])


def test_strategy_is_dense_from_a_hundredth_and_065(spark):
    # (width, height, area) of the only component in 100 x 100 pixels
    boxes = {1: (10, 10, 100), 2: (10, 10, 99), 3: (20, 10, 130), 4: (20, 10, 129), 5: (40, 40, 1600), 6: (50, 50, 1700)}
    stats = spark.createDataFrame([(i, 1, 5, 5, *b) for i, b in boxes.items()], "image_id bigint, label bigint, min_x bigint, min_y bigint, width bigint, height bigint, area bigint")
    flags = raster.image_flags(stats, 100, 100)
    got = {r.image_id: (r.dense, r.strategy) for r in raster.choose_strategy(flags.withColumn("color_ratio", F.lit(0.0)).withColumn("axis_coverage", F.lit(0.0))).collect()}
    assert got == {i: (a / 10_000 >= 0.08 and a / (w * h) >= 0.75, "dense" if a / 10_000 >= 0.01 and a / (w * h) >= 0.65 else "outline") for i, (w, h, a) in boxes.items()}


def test_open_duplicates_keep_first(spark):
    p = made(spark, [(1, 0, [(0, 0), (10, 0)]), (1, 1, [(10, 1), (0, 1)]), (1, 2, [(3.9, 1.5), (13, 1)]), (1, 3, [(40, 40), (50, 50)])])
    assert sorted(r.path_id for r in loops.dedupe_open_paths(p, 4.0).collect()) == [0, 2, 3]


def test_stream_is_batch(spark, tmp_path):
    rows = [(s, i, c, x, y) for s in (1, 2) for i, (c, x, y) in enumerate([("START", None, None), ("MOVE", 10.0, 0.0), ("PEN_DOWN", None, None), ("MOVE", 10.0, 10.0), ("MOVE", 10.2, 10.0), ("END", None, None)])]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, cmd string, x double, y double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sc.pose_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.schema(sc.POSE).parquet(str(tmp_path / "out")).orderBy("session_id", "seq").collect()
    assert got == sc.pose_batch(df).orderBy("session_id", "seq").collect()
    assert [r.lift for r in got if r.session_id == 1] == [False, False, False, True, False, True]


def test_stream_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"cmd":"START"}\n\n{\n{"cmd":"SPIN"}\n{"cmd":"MOVE","x":1,"y":2}\n')
    q = sc.write_good_and_bad(sc.quarantine(sc.command_stream(spark, str(tmp_path / "in"))), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r.cmd for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["MOVE", "START"]
    assert sorted(r.error_kind for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["bad json", "unknown cmd"]


def test_files_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("train", "a", "i/a.png", "m/a.png"), ("val", "b", "i/b.png", "m/b.png")], "split string, stem string, image string, mask string")
    files.write_manifest(pairs, str(tmp_path / "m"))
    assert sorted(map(tuple, files.read_manifest(spark, str(tmp_path / "m")).select("split", "stem", "image", "mask").collect())) == sorted(map(tuple, pairs.collect()))
    for n in ("x.PNG", "y.jpeg", "z.txt"):
        (tmp_path / n).write_text("some bytes")
    assert sorted(r.stem for r in files.scan_images(spark, str(tmp_path)).collect()) == ["x", "y"]
    assert files.scan_images(spark, str(tmp_path / "none")).count() == 0


def test_run_summary_holds_settings_and_statistics(spark):
    p = made(spark, [(1, 0, [(0, 0), (0.1, 0), (5, 0)]), (1, 1, [(5, 0), (9, 0)]), (1, 2, [(1, 1)]), (2, 0, [(0, 0), (9, 9)])])
    clean = strokes.clean_paths(p).drop("n_in")
    done = strokes.stitch_paths(clean)
    settings = spark.createDataFrame([(1, "default", 0.5), (2, "manual", 2.0)], "drawing_id bigint, profile string, tolerance double")
    rows = files.run_summary_json(done, strokes.plan_metrics(done), settings, strokes.cleanup_stats(p, clean), strokes.stitch_stats(clean, done), strokes.emit_commands(done)).collect()
    one = json.loads(next(r.summary for r in rows if r.drawing_id == 1))
    assert one["settings"] == {"profile": "default", "tolerance": 0.5}
    assert one["cleanup"] == {"input_paths": 3, "input_points": 6, "output_paths": 2, "output_points": 4, "dropped_paths": 1, "dropped_points": 2}
    assert one["stitching"] == {"input_paths": 2, "output_paths": 1, "merged_paths": 1}
    assert one["num_commands"] == 5 and one["draw_mm"] == 9.0 and len(one["preview"][0]["points"]) == 3


def test_run_metrics_of_runs_with_and_without_a_plan(spark):
    runs = spark.createDataFrame([("a", 1, "i.png"), ("b", 2, "j.png")], "run_id string, drawing_id bigint, image string")
    plans = spark.createDataFrame([("a", 3, 1.236, 2.344, 3.58)], "run_id string, num_paths bigint, pen_up_mm double, draw_mm double, total_mm double")
    cleanup = spark.createDataFrame([(1, 10, 7)], "drawing_id bigint, input_points bigint, output_points bigint")
    overlap = spark.createDataFrame([(1, 0.123456, 0.5, 0.25, 0.2)], "drawing_id bigint, precision double, recall double, dice double, iou double")
    commands = spark.createDataFrame([("a",), ("a",)], "run_id string")
    got = {r.run_id: r.asDict() for r in experiments.run_metrics(runs, plans, cleanup, commands, overlap).collect()}
    one = {"image": "i.png", "mask_precision": 0.1235, "mask_iou": 0.2, "num_paths": 3, "num_commands": 2, "cleanup_input_points": 10, "cleanup_output_points": 7, "draw_distance_mm": 2.34, "pen_up_distance_mm": 1.24, "total_distance_mm": 3.58}
    assert {k: got["a"][k] for k in one} == one
    assert got["b"]["num_paths"] == got["b"]["num_commands"] == 0 and got["b"]["mask_dice"] is None and got["b"]["total_distance_mm"] is None


def test_the_drawing_pipeline_is_its_steps(spark):
    """Fitted, cleaned, ordered and stitched by hand for one drawing of two lines that meet."""
    p = made(spark, [(1, 0, [(30, 0), (60, 0)]), (1, 1, [(0, 0), (30, 0)])])
    metrics, commands = drawing.run_drawing_pipeline(p, 60.0, 90.0)
    s = min(190 / 60, 277 / 90)
    x0, y0 = 10 + (190 - 60 * s) / 2, 10 + (277 - 90 * s) / 2
    m = metrics.first()
    assert m.num_paths == 1 and math.isclose(m.draw_mm, 60 * s) and math.isclose(m.pen_up_mm, math.hypot(x0, y0))
    got = [(r.cmd, r.x, r.y) for r in commands.orderBy("seq").collect()]
    assert [c for c, _, _ in got] == ["PEN_UP", "MOVE", "PEN_DOWN", "MOVE", "MOVE", "PEN_UP"]
    assert [(round(x, 6), round(y, 6)) for _, x, y in got if x is not None] == [(round(x0 + k * s, 6), round(y0, 6)) for k in (0, 30, 60)]
