"""What the findings of round 3 asked for."""

import math
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strokemill import tables
from strokemill.operators import grouped, loops, ordering, raster, strokes, tiles
from strokemill.sources import files
from strokemill.streaming import commands


def test_loops_that_are_all_alike_take_no_round_for_each_choice(spark):
    rnd = random.Random(1)
    n = 120
    rows = []
    for p in range(n):
        w, h = rnd.choice([10.0, rnd.uniform(9, 11)]), rnd.choice([10.0, rnd.uniform(9, 11)])
        x, y = rnd.choice([0.0, rnd.uniform(-1, 1)]), 0.0
        rows.append((1, p, [(x - w, y - h), (x + w, y - h), (x + w, y + h), (x - w, y + h), (x - w, y - h)]))
    paths = spark.createDataFrame(rows, "drawing_id bigint, path_id bigint, points array<struct<x:double,y:double>>")
    folder = tables.shared_folder(spark)
    before = set(os.listdir(folder))
    got = loops.merge_duplicate_loops(paths).collect()
    assert len(set(os.listdir(folder)) - before) <= 2
    shapes = loops.shape_of(paths)
    area = {r.path_id: r.area for r in shapes.collect()}
    edges = sorted(loops.near_duplicate_loops(shapes).collect(), key=lambda e: (-area[e.a], e.a, -e.score, e.b))
    used, want = set(), set()
    for e in edges:
        if not {e.a, e.b} & used:
            used |= {e.a, e.b}
            want.add((e.a, e.b))
    assert {(r.path_id, r.merged_with) for r in got if r.merged_with is not None} == want and len(want) > 50


def test_merged_points_are_those_of_the_expressions(spark):
    rnd = random.Random(2)
    ring = lambda: [(rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for _ in range(8)]
    pairs = spark.createDataFrame([(1, k, k + 100, ring(), ring()) for k in range(40)], "drawing_id bigint, a bigint, b bigint, ref array<struct<x:double,y:double>>, cand array<struct<x:double,y:double>>")
    plain = loops.align_closed(pairs).select("a", loops.average_closed(F.col("ref"), F.col("aligned")).alias("points"))
    got = loops.averaged(pairs, 8).select(F.col("path_id").alias("a"), "points")
    assert sorted(got.collect()) == sorted(plain.collect())


def test_taken_loops_leave_the_arrays():
    rnd = np.random.default_rng(3)
    n = 5000
    w, h = rnd.uniform(9, 11, n), rnd.uniform(9, 11, n)
    a, b = loops.best_matches(np.arange(n), w * h, rnd.uniform(0, 3, n), rnd.uniform(0, 3, n), w, h)
    assert len(set(a) | set(b)) == 2 * len(a) > 4000


def test_manifest_lines_lose_no_pair_between_their_parts(spark):
    # so many rows that the bounds of the parts come from a sample
    pairs = spark.range(0, 60_000, numPartitions=4).select(F.concat(F.lit("s"), F.col("id") % 3).alias("split"), F.sha2(F.col("id").cast("string"), 256).alias("stem"), F.concat(F.lit("i"), "id").alias("image"), F.lit("m").alias("mask"))
    lines = files.manifest_lines(pairs, rows=300)
    # a plan that cuts the ranges itself may cut them twice, and not alike
    assert "rangepartitioning" not in lines._jdf.queryExecution().executedPlan().toString().lower()
    body = lines.filter("place > 0")
    assert body.count() == body.select("line").distinct().count() == 60_000
    assert lines.filter("place = 0").count() == 6
    ends = lines.groupBy("split").agg(F.count_if(F.col("place").__gt__(0) & ~F.col("line").endswith(",")).alias("n")).collect()
    assert [r.n for r in ends] == [1, 1, 1]


def test_a_manifest_is_cut_into_a_bounded_number_of_parts(spark, monkeypatch):
    monkeypatch.setattr(files, "MOST_PARTS", 7, raising=False)
    pairs = spark.range(5000).select(F.lit("s").alias("split"), F.col("id").cast("string").alias("stem"), F.lit("i").alias("image"), F.lit("m").alias("mask"))
    lines = files.manifest_lines(pairs, rows=10)
    assert lines.filter("place > 0").select("part").distinct().count() <= 7
    stems = [r.line[9:].split('"')[0] for r in lines.filter("place > 0").orderBy("part", "place").collect()]
    assert stems == sorted(map(str, range(5000)))


def test_a_turn_back_is_one_of_180():
    rnd = random.Random(4)
    for _ in range(3000):
        x, y = round(rnd.uniform(2, 300), 2), float(rnd.randint(1, 99))
        # there and back: the headings lie 180 apart, but for their last bits
        out = commands.poses_of(np.array(["MOVE", "MOVE"], object), np.array([x, 0.0]), np.array([y, 0.0]))
        assert math.isclose(out["turn"][1], 180.0), (x, y)
        pose, _ = commands.step((0.0, 0.0, 0.0, False), "MOVE", x, y)
        assert math.isclose(commands.step(pose, "MOVE", 0.0, 0.0)[1][0], 180.0)


def test_drawings_ordered_together_are_ordered_as_each_alone():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 20):
        # whole numbers, so there are ties
        heads, tails = (rnd.integers(0, 12, (50, n, 2)).astype(float) for _ in range(2))
        for method in ("nearest_neighbor", "two_opt"):
            order, flips = ordering.ordered_many(heads, tails, np.zeros(2), method, 8, 0.01)
            for k in range(50):
                o, f = ordering.ordered(heads[k], tails[k], np.zeros(2), method, 8, 0.01)
                assert o.tolist() == order[k].tolist() and f.tolist() == flips[k].tolist()


def test_drawings_are_whole_however_batches_are_cut():
    ids = pa.array([None, None, 0, 0, 0, 3, 4, 4, 4, 4, 4, 9])
    for step in (1, 2, 3, 5, 12):
        batches = [pa.RecordBatch.from_arrays([ids.slice(k, step)], ["drawing_id"]) for k in range(0, 12, step)]
        got = [t.column("drawing_id").to_pylist() for t in grouped.whole_drawings(iter(batches))]
        assert sum(got, []) == ids.to_pylist()
        assert all(a[-1] != b[0] for a, b in zip(got, got[1:], strict=False))


def test_commands_of_many_drawings_are_those_of_each_alone(spark):
    rnd = random.Random(6)
    point = lambda: (float(rnd.randint(0, 3)), rnd.choice([0.0, 0.2, 0.4]))
    rows = [(d, p, [point() for _ in range(rnd.randint(0, 5))]) for d in range(40) for p in range(rnd.randint(1, 6))]
    made = lambda rows: spark.createDataFrame(rows, "drawing_id bigint, path_id bigint, points array<struct<x:double,y:double>>")
    got = strokes.emit_commands(made(rows)).orderBy("drawing_id", "seq").collect()
    assert {r.drawing_id for r in got} == set(range(40))
    for d in (0, 17, 39):
        assert [r for r in got if r.drawing_id == d] == strokes.emit_commands(made([r for r in rows if r[0] == d])).orderBy("seq").collect()


def test_command_texts_are_written_by_the_tasks(spark, tmp_path):
    rows = [(s, k, "MOVE", float(k), 2.0, 35.0) for s in ("a/b", "c", None) for k in range(5, 0, -1)] + [("c", 9, "PEN_UP", None, None, None)]
    df = spark.createDataFrame(rows, "session_id string, seq int, cmd string, x double, y double, speed double")
    folder = str(tmp_path / "texts")
    for _ in range(2):
        # the second time the folder is there
        files.write_commands_text(df, folder)
        assert sorted(os.listdir(folder)) == ["session_id=__HIVE_DEFAULT_PARTITION__", "session_id=a%2Fb", "session_id=c"]
        assert os.listdir(f"{folder}/session_id=c") == ["lines.txt"]
        assert open(f"{folder}/session_id=c/lines.txt").read() == "".join(f"MOVE {k}.00 2.00 35.00\n" for k in range(1, 6)) + "PEN_UP\n"
    files.write_commands_text(df.filter("false"), folder)
    assert os.listdir(folder) == []


def test_walks_of_a_small_image_take_no_whole_tile():
    import tracemalloc

    points = [(y, x) for y in range(8) for x in range(8) if (y + x) % 3]
    table = pa.table({"image_id": [1] * len(points), "ty": [0] * len(points), "tx": [0] * len(points), "y": [p[0] for p in points], "x": [p[1] for p in points], "forward": [-1] * len(points)})
    tracemalloc.start()
    tiles.walk_tile(256)((pa.scalar(1), pa.scalar(0), pa.scalar(0)), table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000


def test_tasks_of_an_overlap_grow_with_the_pixels(spark, monkeypatch):
    rnd = random.Random(7)
    a, b = (spark.createDataFrame([(rnd.randint(0, 9), rnd.randint(0, 7), rnd.randint(0, 7)) for _ in range(500)], "image_id bigint, y int, x int").distinct() for _ in range(2))
    plain = raster.mask_overlap(a, b)
    monkeypatch.setattr(raster, "OVERLAP_ROWS", 20)
    more = raster.mask_overlap(a, b)
    assert "REPARTITION_BY_NUM" in more._jdf.queryExecution().toString() and "REPARTITION_BY_NUM" not in plain._jdf.queryExecution().toString()
    assert sorted(more.collect()) == sorted(plain.collect())
