"""Command streams: sources, quarantine, and the pose of each session, in batch and as a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.kernels import far, last_kept
from ..schemas import COMMAND_JSON

KNOWN = ("START", "END", "PING", "PEN_UP", "PEN_DOWN", "MOVE")
MOST_CHARS = 8192
POSE = "session_id bigint, seq bigint, cmd string, px double, py double, heading double, pen_down boolean, turn double, lift boolean, straight double"
STATE = "x double, y double, heading double, pen boolean, seq bigint, until bigint"
WAITING = "seq bigint, cmd string, x double, y double, at bigint"
#: Moves below this are no moves, turns below this are not made, and from this one on the pen is lifted.
MIN_MOVE, LEAST_TURN, CORNER = 1.0, 1.0, 30.0
ORIGIN = (0.0, 0.0, 0.0, False)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def command_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the files of a folder, as they come; files can be read again."""
    return spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("file"))


def quarantine(lines: DataFrame) -> DataFrame:
    """``lines`` (value, ...) with cmd, x, y, speed, error_kind (null: good); blank lines go. Works on streams too."""
    t = F.trim("value")
    v = F.try_parse_json(F.when(F.length("value") <= MOST_CHARS, t))
    c = F.from_json(t, COMMAND_JSON)
    out = lines.filter(t != "").withColumn("_v", v).withColumn("_c", c)
    kind = F.when(F.length("value") > MOST_CHARS, "too long").when(F.col("_v").isNull(), "bad json").when(~F.schema_of_variant("_v").startswith("OBJECT"), "not an object").when(F.col("_c.cmd").isNull(), "missing cmd").when(~F.col("_c.cmd").isin(*KNOWN), "unknown cmd")
    return out.withColumn("error_kind", kind).withColumn("cmd", F.when(F.col("error_kind").isNull(), F.col("_c.cmd"))).withColumn("x", F.col("_c.x")).withColumn("y", F.col("_c.y")).withColumn("speed", F.coalesce("_c.speed", F.when(F.col("cmd") == "MOVE", F.lit(30.0)))).drop("_v", "_c")


def step(pose: tuple, cmd: str, x, y, min_move: float = MIN_MOVE) -> tuple[tuple, tuple]:
    """The pose after a command, and (turn, lift, straight) that it asks for."""
    px, py, heading, pen = pose
    turn, lift, straight = 0.0, False, 0.0
    if cmd == "START":
        return (0.0, 0.0, 0.0, False), (turn, pen, straight)
    if cmd in ("PEN_UP", "END"):
        return (px, py, heading, False), (turn, pen, straight)
    if cmd == "PEN_DOWN":
        return (px, py, heading, True), (turn, lift, straight)
    if cmd == "MOVE" and x is not None and y is not None and x == x and y == y:
        dx, dy = x - px, y - py
        d = math.sqrt(dx * dx + dy * dy)
        if d >= min_move:
            to = math.degrees(math.atan2(-dy, dx))
            # a turn back is one of 180, also where the last bit of the headings would make it -180
            delta = 180.0 - (180.0 - (to - heading)) % 360.0 % 360.0
            turn = delta if abs(delta) >= LEAST_TURN else 0.0
            return (x, y, to, pen), (turn, pen and abs(delta) >= CORNER, round(d / 10, 2))
    return pose, (turn, lift, straight)


COLUMNS = ["session_id", "seq", "cmd", "px", "py", "heading", "pen_down", "turn", "lift", "straight"]


def poses_of(cmd: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The pose after each command of a session, on whole arrays: accepted moves by the kernel
    of last kept points, pen and heading by what was set last."""
    n = len(cmd)
    start = cmd == "START"
    placed = start | ((cmd == "MOVE") & ~np.isnan(x) & ~np.isnan(y))
    # the places that the pen may take: the origin at first and at each START, and targets of moves
    at = np.concatenate(([0], np.flatnonzero(placed) + 1))
    reset = np.concatenate(([True], start))[at]
    px, py = (np.where(reset, 0.0, np.concatenate(([0.0], v))[at]) for v in (x, y))
    kept = last_kept(len(at), far(px, py, np.where(reset, -np.inf, MIN_MOVE)))
    at, px, py, reset = at[kept], px[kept], py[kept], reset[kept]
    dx, dy = np.diff(px, prepend=0.0), np.diff(py, prepend=0.0)
    heading = np.where(reset, 0.0, np.degrees(np.arctan2(-dy, dx)))
    # the remainder of a little less than nothing rounds to 360: a turn back is one of 180, not of -180
    delta = 180.0 - (180.0 - np.diff(heading, prepend=0.0)) % 360.0 % 360.0
    # the last of these places at or before each command
    last = np.searchsorted(at, np.arange(1, n + 1), "right") - 1
    moved = (at[last] == np.arange(1, n + 1)) & ~reset[last]
    pens = np.flatnonzero(start | np.isin(cmd, ("PEN_UP", "PEN_DOWN", "END")))
    held = np.searchsorted(pens, np.arange(n), "right") - 1
    down = np.where(held >= 0, cmd[pens[np.maximum(held, 0)]] == "PEN_DOWN", False) if len(pens) else np.zeros(n, bool)
    before = np.concatenate(([False], down[:-1]))
    corner = np.abs(delta[last])
    length = np.sqrt(dx * dx + dy * dy)[last] / 10
    return {
        "px": px[last],
        "py": py[last],
        "heading": heading[last],
        "pen_down": down,
        "turn": np.where(moved & (corner >= LEAST_TURN), delta[last], 0.0),
        "lift": np.where(moved, before & (corner >= CORNER), before & (start | np.isin(cmd, ("PEN_UP", "END")))),
        "straight": np.array([round(v, 2) if m else 0.0 for v, m in zip(length.tolist(), moved.tolist(), strict=True)], float),
    }


def pose_batch(commands: DataFrame) -> DataFrame:
    """The pose after each command of each session; a seq that comes again is taken once."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        seq = table.column("seq").to_numpy()
        table = table.filter(pa.array(np.diff(seq, prepend=seq[0] - 1) != 0))
        cmd = np.array(table.column("cmd").to_pylist(), object)
        x, y = (table.column(c).to_numpy().astype(float) for c in ("x", "y"))
        out = {c: table.column(c) for c in ("session_id", "seq", "cmd")} | {k: pa.array(v) for k, v in poses_of(cmd, x, y).items()}
        return pa.table([out[c] for c in COLUMNS], names=COLUMNS)

    rows = commands.filter("seq IS NOT NULL").select("session_id", "seq", "cmd", "x", "y")
    return rows.groupBy("session_id").applyInArrow(run, POSE)


class PoseTracker(StatefulProcessor):
    """The pose of a session as keyed state.

    Commands wait in a list until the watermark has passed their time; a timer at that time
    takes them in the order of seq, up to the first one that isn't due. So commands that
    come late or out of order, but within the delay, count as if they had come in order;
    those at or below the last seq taken are replays and give nothing. A session without a
    command for longer than the idle time (by the times of the commands) is forgotten, its
    last seq, too: a timer frees the state, and a command after such a gap finds the origin.

    Without event time nothing waits: what a batch brings is taken in the order of seq, and
    the idle time is measured by the clock.
    """

    def __init__(self, idle_ms: int | None, by_event: bool = True):
        self.idle_ms, self.by_event = idle_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pose = handle.getValueState("pose", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        more = []
        for df in rows:
            number = lambda v: None if v is None or v != v else float(v)
            more += [(int(q), c, number(a), number(b), int(t)) for q, c, a, b, t in zip(df["seq"], df["cmd"], df["x"], df["y"], df["at_ms"], strict=True)]
        if more and not self.by_event:
            now = 0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()
            held = self.pose.get() if self.pose.exists() else None
            yield from self.taken(key, [(*m[:4], now) for m in more], held, now)[0]
            if self.idle_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(now + self.idle_ms)
        elif more:
            self.waiting.appendList(more)
            for at in {min(m[4] for m in more), max(m[4] for m in more)}:
                self.handle.registerTimer(at)

    def taken(self, key: tuple, rows: list, held: tuple | None, now: int) -> tuple[list[pd.DataFrame], list, int | None]:
        """Poses of the rows that are due, the rows that are left, and when the session was last heard; the state is updated."""
        new = (ORIGIN, -(1 << 62), None)
        pose, last, until = (tuple(held[:4]), held[4], held[5]) if held else new
        out, left, blocked = [], [], False
        for row in sorted(rows, key=lambda r: r[0]):
            seq, cmd, ax, ay, at = row
            blocked = blocked or at > now
            if blocked:
                left.append(row)
                continue
            if self.idle_ms is not None and until is not None and at > until + self.idle_ms:
                pose, last, until = new
            if seq > last:
                pose, asked = step(pose, cmd, ax, ay)
                last, until = seq, at if until is None else max(until, at)
                out.append((key[0], seq, cmd, *pose, *asked))
        if until is not None:
            self.pose.update((*pose, last, until))
        return [pd.DataFrame(out, columns=COLUMNS)] if out else [], left, until

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.by_event:
            self.pose.clear()
            return
        now = timerValues.getCurrentWatermarkInMs()
        held = self.pose.get() if self.pose.exists() else None
        out, left, until = self.taken(key, list(self.waiting.get()) if self.waiting.exists() else [], held, now)
        yield from out
        if left:
            self.waiting.put(left)
            # the one that the others wait for
            self.handle.registerTimer(max(left[0][4], now + 1))
        else:
            self.waiting.clear()
        if until is not None and self.idle_ms is not None:
            if now > until + self.idle_ms:
                self.pose.clear()
            else:
                self.handle.registerTimer(max(until + self.idle_ms + 1, now + 1))

    def close(self) -> None:
        pass


def pose_stream(commands: DataFrame, time: str | None = None, delay: str = "10 seconds", idle_seconds: float | None = None) -> DataFrame:
    """The same on a stream of (session_id, seq, cmd, x, y).

    With the column ``time`` a pose comes out once the watermark has passed its command;
    ``delay`` is how late a command may be, and later ones are dropped by the watermark.
    Without it commands are taken as they arrive. Without ``idle_seconds`` sessions are
    kept for good. Such state needs the RocksDB state store, which is set for the session.
    Idle time by the clock (no ``time``) needs a query that keeps running: with
    ``availableNow`` Spark would wait for the timers without end.
    """
    spark, columns = commands.sparkSession, ["session_id", "seq", "cmd", "x", "y"]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = commands if time is None else commands.withWatermark(time, delay)
    at = F.lit(0).cast("bigint") if time is None else F.unix_millis(F.col(time).cast("timestamp"))
    rows = rows.filter("seq IS NOT NULL").select(*columns, *([time] if time else []), at.alias("at_ms"))
    tracker = PoseTracker(None if idle_seconds is None else int(idle_seconds * 1000), time is not None)
    mode = "eventTime" if time else "none" if idle_seconds is None else "processingTime"
    return rows.groupBy("session_id").transformWithStateInPandas(tracker, POSE, "append", mode)


def session_wrap(commands: DataFrame, ping: bool = True) -> DataFrame:
    """[PING] START ... END around each session."""
    ends = commands.groupBy("session_id").agg(F.max("seq").alias("m"))
    extra = [(F.lit(-1), "START"), (F.col("m") + 1, "END")] + ([(F.lit(-2), "PING")] if ping else [])
    rows = F.explode(F.array(*(F.struct(s.cast("bigint").alias("seq"), F.lit(c).alias("cmd")) for s, c in extra))).alias("r")
    none = [F.lit(None).cast("double").alias(c) for c in ("x", "y", "speed")]
    return commands.select("session_id", F.col("seq").cast("bigint").alias("seq"), "cmd", "x", "y", "speed").unionByName(ends.select("session_id", rows).select("session_id", "r.seq", "r.cmd", *none))


def write_good_and_bad(stream: DataFrame, good: str, bad: str, checkpoint: str):
    """Starts a query that writes good rows and quarantined rows to two tables, and stops when all that is there is read."""

    def both(batch: DataFrame, _: int) -> None:
        batch.persist()
        batch.filter("error_kind IS NULL").drop("error_kind", "value").write.mode("append").parquet(good)
        batch.filter("error_kind IS NOT NULL").select("file", "value", "error_kind").write.mode("append").parquet(bad)
        batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
