"""Live command logs: a streaming source that tails log files, a socket that fills them, and stop requests.

A log is a file of lines that grows. ``CommandLogSource`` reads a folder of them; its
offset is the number of bytes of each log that belong to whole lines, so a query that
starts again from its checkpoint reads every line once. A socket can't be read twice,
so ``SocketSpool`` appends what it receives to logs, and those are read.

A stop request is the file ``_STOP`` in the folder: once it is there, a last line without
a line end counts as whole, the spool takes no more connections, and ``run_until_stopped``
ends the query after all that was there has been processed.
"""

from __future__ import annotations

import json
import os
import socket
import threading
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

STOP = "_STOP"
#: Bytes that one task reads, and by which the search for the last line end steps back.
CHUNK, TAIL = 8 << 20, 1 << 16


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (local, or any other by its URI) and the folder's path in it."""
    return fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))


@dataclass
class Piece(InputPartition):
    """Bytes ``begin`` to ``end`` of a log; a task takes the lines that begin there. ``last``: where whole lines end."""

    name: str
    begin: int
    end: int
    last: int


class CommandLogReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Bytes of whole lines of each log."""
        files, root = opened(self.folder)
        infos = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        # the stop request is looked for first: what a log holds after that is whole
        stopped = any(i.base_name == STOP for i in infos)
        out = {}
        for i in sorted(infos, key=lambda i: i.base_name):
            if i.type == fs.FileType.File and i.base_name.endswith(self.suffix) and i.size:
                whole = i.size if stopped else self.whole(files, i.path, i.size)
                if whole:
                    out[i.base_name] = whole
        return out

    @staticmethod
    def whole(files: fs.FileSystem, path: str, size: int) -> int:
        """The place after the last line end before ``size``."""
        with files.open_input_file(path) as f:
            end = size
            while end > 0:
                begin = max(0, end - TAIL)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return [
            Piece(name, at, min(at + CHUNK, last), last)
            for name, last in end.items()
            for at in range(start.get(name, 0), last, CHUNK)
        ]

    def read(self, partition: Piece) -> Iterator[tuple]:
        files, root = opened(self.folder)
        with files.open_input_file(f"{root}/{partition.name}") as f:
            at = partition.begin
            # a line that begins before the piece belongs to the task before
            f.seek(max(0, at - 1))
            if at and f.read(1) != b"\n":
                at += len(self.line(f, partition.last - at))
            while at < partition.end:
                line = self.line(f, partition.last - at)
                yield partition.name, at, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                at += len(line)

    @staticmethod
    def line(f, most: int) -> bytes:
        """The bytes up to and with the next line end, ``most`` at most; the file stands behind them."""
        parts, left, begin = [], most, f.tell()
        while left:
            block = f.read(min(TAIL, left))
            at = block.find(b"\n")
            if at >= 0 or not block:
                parts.append(block[: at + 1])
                break
            parts.append(block)
            left -= len(block)
        out = b"".join(parts)
        f.seek(begin + len(out))
        return out

    def commit(self, end: dict) -> None:
        """Logs stay: they are the record that a restart reads."""


class CommandLogSource(DataSource):
    """``spark.readStream.format("command_log").option("folder", ...)``: (log, at, value), ``at`` the byte at which the line begins."""

    @classmethod
    def name(cls) -> str:
        return "command_log"

    def schema(self) -> str:
        return "log string, at bigint, value string"

    def streamReader(self, schema) -> CommandLogReader:
        if "folder" not in self.options:
            raise ValueError("option 'folder' is missing")
        return CommandLogReader(self.options["folder"], self.options.get("suffix", ".log"))


def log_stream(spark: SparkSession, folder: str, suffix: str = ".log") -> DataFrame:
    """Lines of the logs of a folder, as they are appended."""
    spark.dataSource.register(CommandLogSource)
    return spark.readStream.format("command_log").option("folder", folder).option("suffix", suffix).load()


def request_stop(folder: str, reason: str = "") -> None:
    files, root = opened(folder)
    files.create_dir(root)
    with files.open_output_stream(f"{root}/{STOP}") as f:
        f.write(json.dumps({"reason": reason, "at": time.time()}).encode())


def stop_requested(folder: str) -> str | None:
    """The reason of the stop request, or None if there is none."""
    files, root = opened(folder)
    if files.get_file_info(f"{root}/{STOP}").type != fs.FileType.File:
        return None
    with files.open_input_stream(f"{root}/{STOP}") as f:
        return json.loads(f.read() or b"{}").get("reason", "")


def run_until_stopped(query: StreamingQuery, folder: str, idle: float | None = None, poll: float = 0.5) -> str:
    """Wait until a stop is requested, or for ``idle`` seconds no row came; then end the query cleanly.

    Gives "stop: <reason>", "idle", or "ended" if the query ended by itself. A failed query raises.
    Waiting costs nothing: reads go on, as long as nobody asks for a stop.
    """
    seen, since = -1, time.monotonic()
    while not query.awaitTermination(poll):
        reason = stop_requested(folder)
        if reason is not None:
            query.processAllAvailable()
            query.stop()
            return f"stop: {reason}"
        busy = [p for p in query.recentProgress if p.numInputRows]
        last = busy[-1].batchId if busy else -1
        if last != seen or query.status["isTriggerActive"] and query.status["isDataAvailable"]:
            seen, since = last, time.monotonic()
        elif idle is not None and time.monotonic() - since >= idle:
            query.processAllAvailable()
            query.stop()
            return "idle"
    if query.exception():
        raise query.exception()
    return "ended"


class SocketSpool:
    """Appends what clients send to logs in a local or mounted shared folder, one log for each connection.

    A line is in its log before the next bytes are taken, so nothing is lost when the query
    or the driver restarts; a connection that ends without a line end gets one.
    """

    def __init__(self, folder: str, host: str = "127.0.0.1", port: int = 0, timeout: float = 0.5):
        self.folder, self.timeout = folder, timeout
        os.makedirs(folder, exist_ok=True)
        self.server = socket.create_server((host, port))
        self.server.settimeout(timeout)
        self.port = self.server.getsockname()[1]
        self.threads = [threading.Thread(target=self.serve, daemon=True)]
        self.threads[0].start()

    def serve(self) -> None:
        with self.server:
            while stop_requested(self.folder) is None:
                try:
                    connection, (host, port, *_) = self.server.accept()
                except TimeoutError:
                    continue
                name = f"{time.time_ns()}-{host.replace(':', '_')}-{port}.log"
                self.threads.append(threading.Thread(target=self.take, args=(connection, name), daemon=True))
                self.threads[-1].start()

    def take(self, connection: socket.socket, name: str) -> None:
        connection.settimeout(self.timeout)
        with connection, open(f"{self.folder}/{name}", "ab", buffering=0) as log:
            last = b"\n"
            while stop_requested(self.folder) is None:
                try:
                    received = connection.recv(1 << 16)
                except TimeoutError:
                    continue
                except OSError:
                    break
                if not received:
                    break
                log.write(received)
                last = received[-1:]
            if last != b"\n":
                log.write(b"\n")

    def close(self) -> None:
        """Wait until the stop request has ended all threads."""
        for t in list(self.threads):
            t.join()
