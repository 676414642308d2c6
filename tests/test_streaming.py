"""The live source, stop and idle, and the pose of sessions as state."""

import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from strokemill.sources import live
from strokemill.streaming import commands as sc

ROWS = "session_id bigint, seq bigint, cmd string, x double, y double, ts timestamp"


def append(path, text):
    with open(path, "a") as f:
        f.write(text)


def started(spark, tmp_path, **options):
    lines = live.log_stream(spark, str(tmp_path / "logs"))
    writer = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    return (writer.trigger(**options) if options else writer).start()


def lines_of(spark, tmp_path):
    return sorted((r.log, r.at, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_pieces_share_no_line(tmp_path, monkeypatch):
    """However the bytes are cut, each line is read once, as it is."""
    (tmp_path / "a.log").write_bytes(b"one\r\n\ntwo two\n" + b"x" * 50 + b"\nlast\nopen")
    reader = live.CommandLogReader(str(tmp_path), ".log")
    end = reader.latestOffset()
    assert end == {"a.log": 70}
    whole = [(0, "one"), (5, ""), (6, "two two"), (14, "x" * 50), (65, "last")]
    for chunk in (1, 2, 3, 7, 13, 64, 1000):
        for tail in (1, 5, 1000):
            monkeypatch.setattr(live, "CHUNK", chunk)
            monkeypatch.setattr(live, "TAIL", tail)
            assert reader.latestOffset() == end
            assert [(at, v) for p in reader.partitions({}, end) for _, at, v in reader.read(p)] == whole
    live.request_stop(str(tmp_path))
    assert reader.latestOffset() == {"a.log": 74}
    assert [v for p in reader.partitions(end, reader.latestOffset()) for _, _, v in reader.read(p)] == ["open"]


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    append(logs / "a.log", "a1\na2\npart")
    append(logs / "note.txt", "no log\n")
    started(spark, tmp_path, availableNow=True).awaitTermination(120)
    assert [v for _, _, v in lines_of(spark, tmp_path)] == ["a1", "a2"]
    append(logs / "a.log", "ial\na4\n")
    append(logs / "b.log", "b1\n")
    # a query that is stopped at any time goes on from its checkpoint
    q = started(spark, tmp_path)
    q.processAllAvailable()
    q.stop()
    append(logs / "b.log", "b2\n")
    started(spark, tmp_path, availableNow=True).awaitTermination(120)
    started(spark, tmp_path, availableNow=True).awaitTermination(120)
    assert lines_of(spark, tmp_path) == [("a.log", 0, "a1"), ("a.log", 3, "a2"), ("a.log", 6, "partial"), ("a.log", 14, "a4"), ("b.log", 0, "b1"), ("b.log", 3, "b2")]


def test_source_needs_a_folder(spark):
    spark.dataSource.register(live.CommandLogSource)
    with pytest.raises(Exception, match="folder"):
        spark.readStream.format("command_log").load().writeStream.format("noop").start().awaitTermination(60)


def test_socket_stop_and_last_lines(spark, tmp_path):
    """What clients sent before the stop request is processed, a last line without its end, too."""
    folder = str(tmp_path / "logs")
    spool = live.SocketSpool(folder)
    q = started(spark, tmp_path)
    ended = []
    waiter = threading.Thread(target=lambda: ended.append(live.run_until_stopped(q, folder, poll=0.2)))
    waiter.start()
    for client in range(2):
        with socket.create_connection(("127.0.0.1", spool.port)) as s:
            for k in range(50):
                s.sendall(f'{{"cmd":"MOVE","x":{client},"y":{k}}}\n'.encode())
            s.sendall(b'{"cmd":"END"}')
    sent = 2 * 51
    for _ in range(200):
        if sum(f.read_bytes().count(b"\n") for f in (tmp_path / "logs").glob("*.log")) >= sent:
            break
        time.sleep(0.05)
    live.request_stop(folder, "button")
    waiter.join(60)
    spool.close()
    assert ended == ["stop: button"] and not q.isActive
    rows = sc.quarantine(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert len(rows) == sent and not [r for r in rows if r.error_kind]
    assert sorted((r.x, r.y) for r in rows if r.cmd == "MOVE") == [(c, k) for c in range(2) for k in range(50)]


def test_idle_ends_the_query(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    append(tmp_path / "logs" / "a.log", "a\n")
    q = started(spark, tmp_path)
    assert live.run_until_stopped(q, str(tmp_path / "logs"), idle=2.0, poll=0.2) == "idle"
    assert not q.isActive and len(lines_of(spark, tmp_path)) == 1


def test_a_failed_query_raises(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    append(tmp_path / "logs" / "a.log", "a\n")
    fails = live.log_stream(spark, str(tmp_path / "logs")).select(F.raise_error(F.lit("broken")))
    q = fails.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
    with pytest.raises(Exception, match="broken"):
        live.run_until_stopped(q, str(tmp_path / "logs"), poll=0.2)


def session_rows(seed, sessions=3, n=40):
    rnd = random.Random(seed)
    rows = []
    for s in range(sessions):
        for i in range(n):
            cmd = rnd.choice(["MOVE"] * 6 + ["PEN_UP", "PEN_DOWN", "PING", "START", "END"])
            x, y = (None, None) if cmd != "MOVE" or rnd.random() < 0.1 else (rnd.choice([rnd.uniform(0, 4), 10.0, float("nan")]), rnd.uniform(0, 4))
            rows.append((s, i * 2, cmd, x, y, i * 1000))
    return rows


def by_hand(rows):
    out = []
    for s in sorted({r[0] for r in rows}):
        pose = (0.0, 0.0, 0.0, False)
        for r in sorted({r[1]: r for r in rows if r[0] == s}.values(), key=lambda r: r[1]):
            pose, asked = sc.step(pose, *r[2:5])
            out.append((s, r[1], r[2], *pose, *asked))
    return out


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:3] == b[:3] and a[6] == b[6] and a[8] == b[8]
        assert [*a[3:6], a[7], a[9]] == pytest.approx([*b[3:6], b[7], b[9]], abs=1e-6)


def frame(spark, rows):
    made = spark.createDataFrame([(*r[:5], r[5]) for r in rows], "session_id bigint, seq bigint, cmd string, x double, y double, ms bigint")
    return made.withColumn("ts", F.timestamp_millis(F.col("ms") + 1_000_000)).drop("ms")


def test_batch_is_the_fold(spark):
    for seed in range(6):
        rows = session_rows(seed)
        near(sorted(map(tuple, sc.pose_batch(frame(spark, rows + rows[:9])).collect())), by_hand(rows))


def stream_of(spark, tmp_path, batches, **options):
    """Poses of batches of rows that arrive one after the other; the last tick moves the watermark past all."""
    out = []
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
        poses = sc.pose_stream(stream, "ts", **options)
        q = poses.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        out.append(i)
    return sorted(map(tuple, spark.read.schema(sc.POSE).parquet(str(tmp_path / "out")).collect()))


def test_late_and_repeated_commands_count_once_in_order(spark, tmp_path):
    """Batches that come shuffled within the delay, with replays, and with restarts between them, give what the batch twin gives."""
    rows = session_rows(7)
    rnd = random.Random(1)
    late = sorted(rows, key=lambda r: r[5] + rnd.uniform(0, 8000))
    first, second = late[:60], late[60:] + late[40:60]
    tick = [(99, 0, "PING", None, None, 10_000_000)]
    got = stream_of(spark, tmp_path, [first, second, tick], delay="10 seconds")
    near([r for r in got if r[0] != 99], by_hand(rows))


def test_idle_sessions_are_forgotten(spark, tmp_path):
    """After the idle time the pose is gone: the session starts at the origin again."""
    one = [(1, 0, "MOVE", 5.0, 0.0, 0), (2, 0, "MOVE", 5.0, 0.0, 0)]
    tick = [(99, 0, "PING", None, None, 40_000)]
    keep = [(2, 1, "PING", None, None, 41_000)]
    two = [(1, 1, "PING", None, None, 200_000), (2, 2, "PING", None, None, 200_000), (99, 1, "PING", None, None, 200_001)]
    last = [(99, 2, "PING", None, None, 10_000_000)]
    got = stream_of(spark, tmp_path, [one, tick, keep, two, last], delay="1 second", idle_seconds=60)
    poses = {(r[0], r[1]): r[3] for r in got}
    assert poses[1, 0] == poses[2, 0] == 5.0 and poses[2, 1] == 5.0
    assert poses[1, 1] == poses[2, 2] == 0.0


def test_idle_by_the_clock(spark, tmp_path):
    """Without event time a session that nobody speaks to for a second starts anew."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("session_id bigint, seq bigint, cmd string, x double, y double").json(str(folder))
    q = sc.pose_stream(stream, idle_seconds=1.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        append(folder / "a.json", '{"session_id":1,"seq":1,"cmd":"MOVE","x":5,"y":0}\n{"session_id":1,"seq":2,"cmd":"PING"}\n')
        for _ in range(600):
            time.sleep(0.1)
            if any(p.numInputRows for p in q.recentProgress):
                break
        time.sleep(6)
        append(folder / "b.json", '{"session_id":1,"seq":1,"cmd":"PING"}\n')
        for _ in range(600):
            time.sleep(0.1)
            if sum(p.numInputRows > 0 for p in q.recentProgress) > 1:
                break
        time.sleep(1)
    finally:
        q.stop()
    got = sorted((r.seq, r.px) for r in spark.read.schema(sc.POSE).parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0.0), (1, 5.0), (2, 5.0)]
