"""Toxicity: logistic regression learned by FTRL-proximal over hashed word n-grams.

Features of a text are its words, their stems (first ``STEM`` letters), word pairs and
skip-grams (two words with one or two words between them), each counted once, hashed
into ``2**BITS`` places. FTRL-proximal
keeps a learning rate for each coordinate and sets weights whose evidence stays below
L1 to exactly zero, so the model that goes to the executors is a short list of places
and weights (its size is bounded by ``2**BITS``).

Learned from a bounded sample of labelled rows (``SAMPLE_PER_LABEL`` for each label, at
most); every text is scored whole.

Defined cases: null and empty texts, and texts without a word, get the score of the bias
alone; rows without a label are never learned from; repeated rows are scored one by one;
an empty table gives an empty result; with no labels the score is 0.5 and predicted is 1
only from 0.5 on, so such a model scores 0 everywhere instead.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, join_checked, per_text, pick_ids, pick_sample, read

BITS = 20
SKIPS = (1, 2)
#: Letters of a word that stand for its inflected forms.
STEM = 4
#: Distinct words whose hashes are remembered.
REMEMBERED = 500_000
#: Labelled rows that are learned from, for each label, at most.
SAMPLE_PER_LABEL = 6000
EPOCHS = 3
WORD = re.compile(r"[^\W_]+")
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def places(hashes: np.ndarray) -> np.ndarray:
    """Places of all features of a text whose words (row 0) and stems (row 1) have these hashes."""
    top = np.uint64(64 - BITS)
    words, stems = hashes
    out = [words * M1 >> top, stems * M2 >> top]
    for gap in (0, *SKIPS):
        if len(words) > gap + 1:
            out.append(((words[: -gap - 1] * M1) ^ (words[gap + 1 :] + np.uint64(gap))) * M2 >> top)
    return np.concatenate(out).astype(np.int64)


class Hashes(dict):
    """64-bit hash of a word; forgets all once it holds many."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    stems = [w[:STEM] for w in words]
    return np.fromiter(map(HASHES.__getitem__, itertools.chain(words, stems)), np.uint64, 2 * len(words)).reshape(2, -1)


def features(text: str | None) -> np.ndarray:
    """The distinct places of a text's words, pairs and skip-grams."""
    return np.unique(places(word_hashes(text)))


class Ftrl:
    """FTRL-proximal with a rate for each coordinate."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + math.sqrt(self.bias_n)) / self.alpha)

    def learn(self, at: np.ndarray, y: int, scale: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + math.exp(-max(-35.0, min(35.0, self.bias + w.sum()))))
        g = (p - y) * scale
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g
        sigma = (math.sqrt(self.bias_n + g * g) - math.sqrt(self.bias_n)) / self.alpha
        self.bias_z += g - sigma * self.bias
        self.bias_n += g * g

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self.weights(np.arange(1 << BITS))
        at = np.flatnonzero(w)
        return at, w[at].astype(np.float32), self.bias


def train(labelled: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> tuple[np.ndarray, np.ndarray, float]:
    """Learn from rows (doc_id, text, toxic): places, weights and bias."""
    rows = [(features(r.text), int(r.toxic)) for r in pick_sample(labelled.filter("toxic IN (0, 1)"), "toxic", sample_per_label)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -700.0
    ftrl = Ftrl()
    for _ in range(EPOCHS):
        for at, y in rows:
            ftrl.learn(at, y)
    return ftrl.model()


def scorer(shared):
    at, w, bias = shared.value
    table = np.zeros(1 << BITS, np.float32)
    table[at] = w
    hot = np.zeros(1 << BITS, bool)
    hot[at] = True

    def score(text: str | None) -> float:
        found = places(word_hashes(text))
        found = np.unique(found[hot[found]])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, bias + float(table[found].sum(dtype=np.float64))))))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [score(t) for t in batch.column("text").to_pylist()]
        names = [c for c in batch.schema.names if c != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], names=[*names, "toxicity"])

    return work


def toxicity(docs: DataFrame, model) -> DataFrame:
    """All columns of ``docs`` but text, and toxicity (0 to 1)."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "toxicity")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["toxicity double"])
    return per_text(docs.select(*[f.name for f in kept], "text"), schema, scorer, docs.sparkSession.sparkContext.broadcast(model))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 5) == 0
    known = labels.filter(~held).filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # ids first: a bounded choice of labelled rows, then their texts
    some = pick_ids(known, "toxic", SAMPLE_PER_LABEL)
    model = train(join_checked(docs.select("doc_id", "text"), some, "doc_id", "inner", 40))
    out = toxicity(docs.select("doc_id", "text"), model)
    score = F.col("toxicity")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
