"""Generators: calibration patterns, polygons, sample plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMAND = "struct<cmd:string,x:double,y:double,speed:double>"


def polyline_commands(points: list[tuple[Column, Column]], travel: float = 60.0, draw: float = 35.0) -> Column:
    """Commands that draw one open line through the points."""
    row = lambda cmd, x=None, y=None, s=None: F.struct(F.lit(cmd).alias("cmd"), (F.lit(None) if x is None else x).cast("double").alias("x"), (F.lit(None) if y is None else y).cast("double").alias("y"), F.lit(s).cast("double").alias("speed"))
    return F.array(row("PEN_UP"), row("MOVE", *points[0], travel), row("PEN_DOWN"), *(row("MOVE", x, y, draw) for x, y in points[1:]), row("PEN_UP"))


def calibration_patterns(devices: DataFrame) -> DataFrame:
    """(device, pattern, seq, cmd, x, y, speed) for ``devices`` (device, x, y, size): line, square, pen_gaps, ruler."""
    x, y, s = F.col("x"), F.col("y"), F.col("size")
    line = polyline_commands([(x, y), (x + s, y)])
    square = polyline_commands([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)])
    gaps = F.flatten(F.array(*(polyline_commands([(x + 35 * i, y + 30), (x + 35 * i + 20, y + 30)]) for i in range(5))))
    ruler = F.flatten(F.array(*(polyline_commands([(x, y + 120 + 20 * i), (x + n, y + 120 + 20 * i)]) for i, n in enumerate((50, 100, 150)))))
    kinds = F.array(*(F.struct(F.lit(k).alias("pattern"), c.alias("commands")) for k, c in (("line", line), ("square", square), ("pen_gaps", gaps), ("ruler", ruler))))
    each = devices.select("device", F.explode(kinds).alias("k")).select("device", "k.pattern", F.posexplode("k.commands").alias("seq", "c"))
    return each.select("device", "pattern", "seq", "c.cmd", "c.x", "c.y", "c.speed")


def square_actions(devices: DataFrame, mm_per_unit: float = 10.0) -> DataFrame:
    """(device, seq, op, value) for ``devices`` (device, size): a square by movements alone, pen down, four sides and the turns between."""
    side = F.col("size") / mm_per_unit
    row = lambda op, v=None: F.struct(F.lit(op).alias("op"), (F.lit(None) if v is None else v).cast("double").alias("value"))
    steps = [row("PU"), row("PD"), row("ST", side)] + [x for _ in range(3) for x in (row("TR", F.lit(90.0)), row("ST", side))] + [row("PU")]
    return devices.select("device", F.posexplode(F.array(*steps)).alias("seq", "a")).select("device", "seq", "a.op", "a.value")


def square_from_pose(devices: DataFrame) -> DataFrame:
    """(device, corner, x, y) for ``devices`` (device, x, y, heading, size): corners of a square that begins at a pose and turns left; y points down."""
    a = F.radians("heading")
    fx, fy, lx, ly = F.cos(a), -F.sin(a), -F.sin(a), -F.cos(a)
    at = lambda i, j: F.struct((F.col("x") + F.col("size") * (i * fx + j * lx)).alias("x"), (F.col("y") + F.col("size") * (i * fy + j * ly)).alias("y"))
    corners = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))
    return devices.select("device", F.posexplode(corners).alias("corner", "p")).select("device", "corner", "p.x", "p.y")


def regular_polygon(cx: Column, cy: Column, radius: Column, sides: Column, rotation: Column) -> Column:
    at = lambda i: F.radians(rotation) + i * (2 * math.pi) / sides
    return F.transform(F.sequence(F.lit(0), sides - 1), lambda i: F.struct(F.bround(cx + radius * F.cos(at(i)), 0).cast("int").alias("x"), F.bround(cy + radius * F.sin(at(i)), 0).cast("int").alias("y")))


def star_polygon(cx: Column, cy: Column, outer: Column, inner: Column, tips: Column, rotation: Column) -> Column:
    at = lambda i: F.radians(rotation) + i * math.pi / tips
    r = lambda i: F.when(i % 2 == 0, outer).otherwise(inner)
    return F.transform(F.sequence(F.lit(0), 2 * tips - 1), lambda i: F.struct(F.bround(cx + r(i) * F.cos(at(i)), 0).cast("int").alias("x"), F.bround(cy + r(i) * F.sin(at(i)), 0).cast("int").alias("y")))


def sample_plan(spark: SparkSession, count: int, prefix: str, existing: DataFrame, seed: int = 42) -> DataFrame:
    """(id, stem, size, sides, rotation) of the samples that aren't there yet."""
    h = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(n))
    out = spark.range(count).select("id", F.format_string(prefix + "_%05d", "id").alias("stem"), (180 + h(1, 141)).alias("size"), (3 + h(2, 6)).alias("sides"), h(3, 360).alias("rotation"))
    return out.join(existing.select("stem"), "stem", "left_anti")
