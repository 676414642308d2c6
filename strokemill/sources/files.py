"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import COMMAND_JSON, EXPERIMENT, PAIR
from ..tables import written
from .live import opened

SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
HEADS = ("PEN_UP", "PEN_DOWN", "START", "END", "PING")

#: Ranges of a manifest's pairs, at most: each is a task, and Spark samples 100 rows of each on the driver.
MOST_PARTS = 1000


def scan_images(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, length, stem) of the image files; contents aren't read; a missing folder is empty, and Spark passes over files of no bytes."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length bigint, stem string")
    if not recursive:
        # the file's folder ends like the given one, and nothing more lies between
        tail = re.sub(r"^\w+:/+", "/", folder).rstrip("/")
        below = F.regexp_replace("path", r"^\w+:/+", "/")
        files = files.filter(F.regexp_extract(below, r"^(.*)/[^/]*$", 1).endswith(tail))
    kept = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    return kept.select("path", "length", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, stem, image, mask) of documents ``{pairs: [...]}`` or of bare lists."""
    doc = spark.read.schema(f"split string, pairs array<struct<{PAIR.replace(' string', ':string')}>>, {PAIR}").json(path, multiLine=True)
    listed = doc.filter("pairs IS NOT NULL").select("split", F.inline("pairs"))
    return listed.union(doc.filter("pairs IS NULL AND image IS NOT NULL").select("split", "stem", "image", "mask"))


def manifest_lines(pairs: DataFrame, seed: int = 42, rows: int = 10_000) -> DataFrame:
    """(split, part, place, line): the text of one JSON document for each split, line by line.

    A document is a head, one line for each pair in the order of stem, and a tail, so no
    split is gathered in one row. Ranks come from counts by part of the stem order:
    ranges of about ``rows`` pairs, ``MOST_PARTS`` of them at most, within which they are
    counted by a window. The ranges are written: their bounds come from a sample that
    Spark draws anew for each plan, so parts that were cut twice wouldn't agree.
    """
    own = pairs.select("split", "stem", "image", "mask")
    n = own.count()
    parts = max(1, min(-(-n // rows), MOST_PARTS))
    ranged = written(own.repartitionByRange(parts, "split", "stem").withColumn("part", F.spark_partition_id()), "manifest-parts")
    spread = ranged.groupBy("split", "part").agg(F.count("*").alias("c"))
    # one row for each split and part
    last = spread.groupBy("split").agg(F.max("part").alias("last"), F.sum("c").alias("pair_count"))
    w = Window.partitionBy("split", "part").orderBy("stem", "image", "mask")
    numbered = ranged.withColumn("place", F.row_number().over(w)).join(spread, ["split", "part"]).join(last, "split")
    comma = F.when((F.col("part") == F.col("last")) & (F.col("place") == F.col("c")), "").otherwise(",")
    body = numbered.select("split", "part", F.col("place").cast("bigint").alias("place"), F.concat(F.to_json(F.struct("stem", "image", "mask")), comma).alias("line"))
    begin = F.concat(F.lit('{"split":'), F.to_json(F.struct(F.col("split").alias("s"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("split").alias("s")))) - 6), F.lit(f',"seed":{seed},"pair_count":'), F.col("pair_count").cast("string"), F.lit(',"pairs":['))
    head = last.select("split", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("place"), begin.alias("line"))
    tail = last.select("split", (F.col("last") + 1).alias("part"), F.lit(0).cast("bigint").alias("place"), F.lit("]}").alias("line"))
    return body.unionByName(head).unionByName(tail)


def write_manifest(pairs: DataFrame, folder: str, seed: int = 42) -> None:
    """A folder for each split; its files, in the order of their names, are the lines of one document."""
    lines = manifest_lines(pairs, seed)
    lines.repartitionByRange("split", "part", "place").sortWithinPartitions("split", "part", "place").select("split", "line").write.partitionBy("split").mode("overwrite").text(folder)


def parse_command_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (value, ...) with cmd, x, y, speed and error (null where the line is good); blank lines go."""
    t = F.split(F.trim("value"), r"\s+")
    head = F.get(t, F.lit(0))
    number = lambda i: F.get(t, F.lit(i)).try_cast("double")
    move = head == "MOVE"
    complete = (F.size(t) == 4) & number(1).isNotNull() & number(2).isNotNull() & number(3).isNotNull()
    error = F.when(move & ~complete, "bad MOVE").when(~move & ~head.isin(*HEADS), "unknown command")
    out = lines.filter(F.trim("value") != "").withColumn("cmd", head).withColumn("error", error)
    good = move & F.col("error").isNull()
    for i, c in enumerate(("x", "y", "speed"), 1):
        out = out.withColumn(c, F.when(good, number(i)))
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, value): lines with their place in the file, however files are cut into splits.

    Spark keeps the order of lines inside a block and names the place where it starts, so
    a line is placed by (start of its block, place in the block). The place in a block
    grows with ``monotonically_increasing_id``, which counts rows of one task in order.
    """
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"))


def read_commands_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows) of files of command lines; seq (start of block, row) orders the lines of a file."""
    parsed = parse_command_lines(numbered_lines(spark, path))
    return parsed.filter("error IS NULL").drop("error", "value"), parsed.filter("error IS NOT NULL").select("file", "seq", "value", "error")


def command_lines(commands: DataFrame) -> DataFrame:
    """Add line: two decimals; a MOVE without all its fields is an error at run time."""
    move = F.when(F.col("x").isNull() | F.col("y").isNull() | F.col("speed").isNull(), F.raise_error(F.lit("MOVE needs x, y and speed"))).otherwise(F.format_string("MOVE %.2f %.2f %.2f", "x", "y", "speed"))
    return commands.withColumn("line", F.when(F.col("cmd") == "MOVE", move).otherwise(F.col("cmd")))


def folder_name(column: str, value) -> str:
    """The name that Spark gives the folder of a value."""
    if value is None or value == "":
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + re.sub(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]", lambda c: f"%{ord(c[0]):02X}", str(value))


def write_commands_text(commands: DataFrame, folder: str, session: str = "session_id") -> None:
    """One folder for each session, lines in the order of seq, in one file; what the folder held before goes.

    Tasks write the files themselves. A file is written under a name that readers pass
    over and then renamed, so a task that runs again puts the same file in its place, and
    the driver has nothing to move for each session.
    """
    files, root = opened(folder)
    if files.get_file_info(root).type == fs.FileType.Directory:
        files.delete_dir_contents(root)
    files.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        sink, here, unnamed, many = None, None, None, 0

        def close() -> None:
            if sink:
                sink.close()
                files.move(unnamed, f"{root}/{here}/lines.txt")

        for batch in batches:
            for value, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = folder_name(session, value)
                if name != here:
                    close()
                    here, unnamed, many = name, f"{root}/{name}/_{uuid.uuid4().hex}", many + 1
                    files.create_dir(f"{root}/{name}")
                    sink = files.open_output_stream(unnamed)
                sink.write(f"{line}\n".encode())
        close()
        yield pa.RecordBatch.from_arrays([pa.array([many], pa.int64())], ["sessions"])

    lines = command_lines(commands).repartition(session).sortWithinPartitions(session, "seq").select(F.col(session).cast("string"), "line")
    lines.mapInArrow(run, "sessions bigint").agg(F.sum("sessions")).collect()


def read_commands_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMAND_JSON).json(path)


def write_commands_jsonl(commands: DataFrame, folder: str) -> None:
    """Keys without a value are left out."""
    commands.select("cmd", "x", "y", "speed").write.mode("overwrite").json(folder)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """The result rows of experiment documents."""
    fields = ", ".join(f"{n}:{t}" for n, t in (f.strip().split(" ") for f in EXPERIMENT.split(",")))
    return spark.read.schema(f"results array<struct<{fields}>>").json(path, multiLine=True).select(F.inline("results"))


def read_experiment_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(file, run_count, image_count, section, row): the rows of each section of the documents' summaries, as JSON text."""
    doc = spark.read.schema("summary string").json(path, multiLine=True).withColumn("file", F.input_file_name())
    sections = F.map_filter(F.from_json("summary", "map<string,string>"), lambda _, v: F.trim(v).startswith("["))
    each = doc.select("file", *(F.get_json_object("summary", f"$.{c}").cast("bigint").alias(c) for c in ("run_count", "image_count")), F.explode(sections).alias("section", "rows"))
    return each.select("file", "run_count", "image_count", "section", F.explode(F.transform(F.from_json("rows", "array<variant>"), lambda v: F.to_json(v))).alias("row"))


def write_report_csv(rows: DataFrame, folder: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(folder)


def scorecard(runs: DataFrame) -> DataFrame:
    """Seven columns of the runs and four ratings to be filled in."""
    kept = ["image", "vision_mode", "path_ordering", "num_paths", "num_commands", "pen_up_distance_mm", "draw_distance_mm"]
    return runs.select(*kept, *(F.lit("").alias(c) for c in ("line_quality", "shape_match", "travel", "notes")))


def run_summary_json(
    paths: DataFrame,
    metrics: DataFrame,
    settings: DataFrame | None = None,
    cleanup: DataFrame | None = None,
    stitching: DataFrame | None = None,
    commands: DataFrame | None = None,
) -> DataFrame:
    """(drawing_id, summary): metrics with two decimals and the first five points of the first three paths.

    Where they are given, the document also holds the row of ``settings`` (any columns),
    ``cleanup`` (``strokes.cleanup_stats``) and ``stitching`` (``strokes.stitch_stats``) of
    its drawing, each as an object, and the number of its ``commands``.
    """
    first = paths.withColumn("_r", F.row_number().over(Window.partitionBy("drawing_id").orderBy("path_id"))).filter("_r <= 3")
    preview = first.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("path_id", F.slice("points", 1, 5).alias("points")))).alias("preview"))
    two = [F.round(c, 2).alias(c) for c in ("pen_up_mm", "draw_mm", "total_mm")]
    out, held = metrics.select("drawing_id", "num_paths", *two).join(preview, "drawing_id", "left"), ["num_paths", "pen_up_mm", "draw_mm", "total_mm"]
    for name, rows in (("settings", settings), ("cleanup", cleanup), ("stitching", stitching)):
        if rows is not None:
            own = [c for c in rows.columns if c != "drawing_id"]
            out = out.join(rows.select("drawing_id", F.struct(*own).alias(name)), "drawing_id", "left")
            held.append(name)
    if commands is not None:
        many = commands.groupBy("drawing_id").agg(F.count("*").alias("num_commands"))
        out = out.join(many, "drawing_id", "left")
        held.append("num_commands")
    return out.select("drawing_id", F.to_json(F.struct(*held, "preview")).alias("summary"))


def read_split_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, file_ord, line_ord, value) of text split lists, for ``parse_split_assignments``."""
    return numbered_lines(spark, path).select("file", F.col("file").alias("file_ord"), F.col("seq").alias("line_ord"), "value")


def read_split_json(spark: SparkSession, path: str) -> DataFrame:
    """(file_ord, value): whole JSON split lists, for ``split_json_rows``; such lists are small files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_ord"), "value")
