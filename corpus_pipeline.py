"""A pipeline over documents: language, near copies, personal data, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strokemill.llm import bpe, jaccardjoin, langid, mixing, pii
from strokemill.llm.common import materialize, read

STAGES = [
    ("language_id", langid.stage),
    ("ngram_jaccard_join", jaccardjoin.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: SQL can express neither the trained models nor byte-level BPE; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; between stages the documents are written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
