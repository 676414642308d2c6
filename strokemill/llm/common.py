"""Helpers that the operators of this subpackage share.

Tables written between steps go to the folder that the session names in
``spark.checkpoint.dir``, which every executor can read; a lost executor costs a
re-read, never a recomputation of the whole lineage.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured size stays below this.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch, at most.
BATCH_ROWS = 2000
#: Ranges of hashes by which a sample is cut to its bound.
SHARES = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Where none is set, a local session (tests) gets one of its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("strokemill.scratch", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strokemill-")
        spark.conf.set("strokemill.scratch", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are written: it does so once the driver has
    collected their plans, which would else wait until its heap is full. Nothing that is still used goes."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read any more: neither the result nor a step that is still to be written."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(file)).getParent()
            if not re.fullmatch(r".+-[0-9a-f]{32}", folder.getName()):
                raise ValueError(f"{folder} was not written between steps")
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def join_checked(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Join that broadcasts ``small`` only after its rows have been counted.

    Above ``BROADCAST_BYTES`` the plain join stands: both sides shuffle and AQE
    splits skewed keys. The result is the same either way.
    """
    n = small.count() if rows is None else rows
    return big.join(F.broadcast(small) if n * row_bytes <= BROADCAST_BYTES else small, on, how)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def pick_ids(df: DataFrame, by: str, rows: int, seed: int = 17) -> DataFrame:
    """(doc_id, ``by``): at most ``rows`` ids for each value of ``by``, chosen by a hash of the id.

    Nothing is ranked: a value with n rows keeps the ids whose hash lies in the lowest
    part 2 * rows / n of all hashes, these fall into ``SHARES`` equal ranges, and whole
    ranges are taken from below while their ids sum to ``rows`` at most. So no task
    gathers a value, and the choice depends on ids alone. Only counts by value and range
    go to the driver. Rows with a null take no part; an id that occurs more than once
    counts once.
    """
    known = materialize(df.filter(f"doc_id IS NOT NULL AND `{by}` IS NOT NULL").select("doc_id", by), "sample-known")
    sizes = materialize(known.groupBy(by).agg(F.count("*").alias("_n")), "sample-sizes")
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = F.floor(place * F.greatest(F.lit(1.0), F.col("_n") / (2.0 * rows)) * SHARES)
    near = materialize(join_checked(known, sizes, by, "inner", 64).withColumn("_share", share).filter(F.col("_share") < SHARES).select("doc_id", by, "_share").distinct(), "sample-ids")
    taken: dict = {}
    for value, at, n in sorted(near.groupBy(by, "_share").count().collect(), key=lambda r: r["_share"]):
        total, cut, full = taken.get(value, (0, -1, False))
        full = full or total + n > rows
        taken[value] = (total, cut, full) if full else (total + n, at, full)
    cuts = df.sparkSession.createDataFrame([(v, int(cut)) for v, (_, cut, _) in taken.items()], near.select(by, F.col("_share").alias("_cut")).schema)
    return join_checked(near, cuts, by, "inner", 64, len(taken)).filter("_share <= _cut").select("doc_id", by)


def pick_sample(df: DataFrame, by: str, rows: int, seed: int = 17) -> list:
    """At most ``rows`` rows (doc_id, text, ``by``) for each value of ``by``, see ``pick_ids``.

    The texts of the chosen ids are fetched afterwards; the result is bounded by ``rows``
    times the number of values of ``by`` and goes to the driver.
    """
    df = df.filter(f"doc_id IS NOT NULL AND text IS NOT NULL AND `{by}` IS NOT NULL")
    ids = pick_ids(df, by, rows, seed).select("doc_id").distinct()
    chosen = df.sparkSession.createDataFrame(ids.collect(), ids.schema)
    own = df.select("doc_id", "text", by).join(F.broadcast(chosen), "doc_id", "left_semi")
    return own.groupBy("doc_id").agg(F.min(F.struct("text", by)).alias("_")).select("doc_id", "_.*").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").collect()


def give_back() -> None:
    """Return freed memory of this worker to the system: workers live longer than tasks."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``chars`` bytes at most (or one row)."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(n, int(n * chars / max(1, batch.nbytes)))) if n else 1
        for at in range(0, n, step):
            yield batch.slice(at, step)


def per_text(df: DataFrame, schema: str, make: Callable, *args, chars: int = 1_000_000) -> DataFrame:
    """Run ``make(*args)`` once in each task; what it returns maps piece after piece.

    Arrow batches are kept to ``BATCH_ROWS`` rows, so that a worker holds few texts at a
    time, and what a task has freed goes back to the system when it ends.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        work = make(*args)
        for piece in pieces(batches, chars):
            yield work(piece)
        give_back()

    return df.mapInArrow(run, schema)


def per_task(df: DataFrame, schema: str, make: Callable, *args, chars: int = 1_000_000) -> DataFrame:
    """Like ``per_text``, but ``make(*args)`` gives two functions: one takes piece after piece,
    the other gives what the task has gathered. Both return a list of batches."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        take, finish = make(*args)
        for piece in pieces(batches, chars):
            yield from take(piece)
        yield from finish()
        give_back()

    return df.mapInArrow(run, schema)
