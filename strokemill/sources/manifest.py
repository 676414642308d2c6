"""Publishing manifests: one file for each split, there as a whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .files import manifest_lines
from .live import opened

#: Bytes that are copied at a time.
BLOCK = 1 << 20


@dataclass
class Fragments(WriterCommitMessage):
    """What a task wrote: (split, part, place of the first line, file)."""

    files: list = field(default_factory=list)


class ManifestWriter(DataSourceWriter):
    """Tasks write their lines to a folder of this run; the commit puts them together.

    A task that is run again writes to files of its own, and only the files of the attempt
    whose message arrives count. Each split's file is written beside its place and then
    renamed, so a reader sees the old one or the new one. Whatever fails, the folder of
    the run goes.
    """

    def __init__(self, folder: str):
        self.folder, self.run = folder, f"_run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Fragments:
        files, root = opened(self.folder)
        out, sink, here = Fragments(), None, None
        try:
            for r in iterator:
                if r["split"] != here or sink is None:
                    if sink:
                        sink.close()
                    here, name = r["split"], f"{root}/{self.run}/{uuid.uuid4().hex}"
                    files.create_dir(f"{root}/{self.run}")
                    sink = files.open_output_stream(name)
                    out.files.append((here, r["part"], r["place"], name))
                sink.write(f"{r['line']}\n".encode())
        finally:
            if sink:
                sink.close()
        return out

    def commit(self, messages: list) -> None:
        files, root = opened(self.folder)
        by_split: dict = {}
        for split, part, place, name in sorted((f for m in messages if m for f in m.files), key=lambda f: f[:3]):
            by_split.setdefault(split, []).append(name)
        try:
            for split, names in by_split.items():
                beside = f"{root}/{self.run}/{uuid.uuid4().hex}"
                with files.open_output_stream(beside) as sink:
                    for name in names:
                        with files.open_input_stream(name) as part:
                            while block := part.read(BLOCK):
                                sink.write(block)
                files.move(beside, f"{root}/{split}.json")
        finally:
            self.clear(files, root)

    def abort(self, messages: list) -> None:
        self.clear(*opened(self.folder))

    def clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.run}")


class ManifestTarget(DataSource):
    """``df.write.format("manifest").option("folder", ...)`` of ``manifest_lines``."""

    @classmethod
    def name(cls) -> str:
        return "manifest"

    def schema(self) -> str:
        return "split string, part int, place bigint, line string"

    def writer(self, schema, overwrite: bool) -> ManifestWriter:
        if "folder" not in self.options:
            raise ValueError("option 'folder' is missing")
        return ManifestWriter(self.options["folder"])


def publish_manifest(pairs: DataFrame, folder: str, seed: int = 42) -> None:
    """``<split>.json`` for each split of ``pairs`` (split, stem, image, mask), in place of what was there.

    The commit copies bytes in blocks on the driver, split by split. For splits of many
    gigabytes ``files.write_manifest`` leaves the parts as they are.
    """
    pairs.sparkSession.dataSource.register(ManifestTarget)
    files, root = opened(folder)
    files.create_dir(root)
    lines = manifest_lines(pairs, seed).repartitionByRange("split", "part", "place").sortWithinPartitions("split", "part", "place")
    rows = lines.selectExpr("split", "cast(part as int) part", "cast(place as bigint) place", "line")
    rows.write.format("manifest").mode("append").option("folder", folder).save()
