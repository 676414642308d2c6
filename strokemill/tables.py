"""Tables that are written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A local session without one (tests) gets its own; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("strokemill.scratch", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strokemill-")
        spark.conf.set("strokemill.scratch", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read again: its lineage ends here, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
