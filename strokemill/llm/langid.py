"""Language identification by prediction by partial matching (PPM).

One byte-level context tree of variable order per language is counted on a bounded
sample of labelled rows and then frozen. The code length of a byte ``s`` after the
context ``c`` is exact PPM with escape method C, without exclusions:

* ``s`` was seen after ``c``:  ``-log2(count / (total + kinds))``;
* ``c`` was seen, ``s`` was not:  ``-log2(kinds / (total + kinds))`` plus the length
  after the next shorter context;
* ``c`` was never seen: the length after the next shorter context;
* below order 0: 8 bits.

The language with the shortest code for the whole text wins.

The code lengths of all languages stand side by side in one row for each n-gram that
any language has seen, so scoring is one table lookup for each byte, for all languages
at once; bytes whose longest n-gram is new go on to the next order and carry the
escapes with them.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows
without a label are never learned from but are scored; ties go to the language that
sorts first; repeated rows are scored one by one; an empty table gives an empty result;
if there is nothing to learn from, every row is ``und``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, per_text, pick_sample, read

ORDER = 4
#: Labelled rows that each language is learned from, at most.
SAMPLE_PER_LANG = 400
#: Bytes that are coded at a time.
CHUNK = 1 << 18
LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters count as one space; all other bytes stay.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SHIFT = np.uint64(8)
MULT = np.uint64(0x9E3779B97F4A7C15)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, lower-cased, runs of spaces made one, each text begun by
    ``ORDER`` spaces; and where each text's first own byte stands."""
    parts = [b"    " + t.lower().encode("utf-8", "replace").translate(PLAIN) for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.cumsum(sizes) - sizes
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    for k in range(ORDER):
        keep[at + k] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    return raw[keep], before[at] + ORDER


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` bytes that end at each place, as one number (the first ``n-1`` are short)."""
    out = np.zeros(len(data), np.uint64)
    for k in range(n):
        out[n - 1 :] |= data[n - 1 - k : len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


class Table:
    """Open-addressing table from n-gram to a row of values, for whole arrays of n-grams."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.index = np.full(1 << bits, -1, np.int32)
        self.rows = rows
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.index[slot[left]] < 0
            at, who = np.unique(slot[left[free]], return_index=True)
            put = left[free][who]
            self.index[at], self.keys[at] = put, keys[put]
            placed = np.zeros(len(keys), bool)
            placed[put] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 if it isn't there."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.index[slot], -1)
        open_ = np.flatnonzero((out < 0) & (self.index[slot] >= 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            hit = self.keys[slot[open_]] == keys[open_]
            out[open_[hit]] = self.index[slot[open_[hit]]]
            open_ = open_[~hit & (self.index[slot[open_]] >= 0)]
        return out


class Model:
    """Frozen PPM statistics of all languages."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        trees = []
        for lang in self.langs:
            data, starts = symbols(samples[lang])
            own = np.ones(len(data), bool)
            for k in range(1, ORDER + 1):
                own[starts - k] = False
            trees.append([np.unique(grams(data, n)[own], return_counts=True) for n in range(1, ORDER + 2)])
        self.tables, self.escapes = [], []
        for n in range(1, ORDER + 2):
            keys = np.unique(np.concatenate([t[n - 1][0] for t in trees])) if trees else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> SHIFT) if n > 1 else np.zeros(1, np.uint64)
            rows = np.zeros((len(keys), len(self.langs)), np.float32)
            out = np.zeros((len(contexts), len(self.langs)), np.float32)
            # the length of the same byte after the shorter context, for all languages
            low = self._lower(keys, n)
            for i, tree in enumerate(trees):
                seen, count = tree[n - 1]
                ctx = seen >> SHIFT if n > 1 else np.zeros(len(seen), np.uint64)
                own, where = np.unique(ctx, return_inverse=True)
                total, kinds = np.bincount(where, count), np.bincount(where)
                at = np.searchsorted(contexts, own)
                out[at, i] = np.log2((total + kinds) / kinds)
                to = np.searchsorted(contexts, keys >> SHIFT if n > 1 else np.zeros(len(keys), np.uint64))
                rows[:, i] = out[to, i] + low[:, i]
                rows[np.searchsorted(keys, seen), i] = np.log2((total + kinds)[where] / count)
            self.tables.append(Table(keys, rows))
            self.escapes.append(Table(contexts, out))

    def _lower(self, keys: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return np.full((len(keys), len(self.langs)), 8, np.float32)
        return self.lengths(keys & ((np.uint64(1) << np.uint64(8 * (n - 1))) - np.uint64(1)), n - 1)

    def lengths(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Bits of the last byte of each n-gram after its first ``n-1``, a column for each language."""
        at = self.tables[n - 1].find(keys)
        out = self.tables[n - 1].rows[at] if len(self.tables[n - 1].rows) else np.zeros((len(keys), len(self.langs)), np.float32)
        left = np.flatnonzero(at < 0)
        out[left] = 0
        keys = keys[left]
        while len(left):
            to = self.escapes[n - 1].find(keys >> SHIFT if n > 1 else np.zeros(len(keys), np.uint64))
            known = to >= 0
            out[left[known]] += self.escapes[n - 1].rows[to[known]]
            n -= 1
            if n == 0:
                out[left] += 8
                break
            keys = keys & ((np.uint64(1) << np.uint64(8 * n)) - np.uint64(1))
            at = self.tables[n - 1].find(keys)
            hit = at >= 0
            out[left[hit]] += self.tables[n - 1].rows[at[hit]]
            left, keys = left[~hit], keys[~hit]
        return out

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text in each language, and the number of bytes coded."""
        data, starts = symbols(texts)
        ends = np.concatenate((starts[1:] - ORDER, [len(data)]))
        keys, whose = grams(data, ORDER + 1), np.repeat(np.arange(len(starts)), np.diff(np.append(starts - ORDER, len(data))))
        pads = np.zeros(len(data), bool)
        for k in range(1, ORDER + 1):
            pads[starts - k] = True
        total = np.zeros((len(starts), len(self.langs)))
        for at in range(0, len(data), CHUNK):  # a long text needs no table of all its bytes by all languages
            own = self.lengths(keys[at : at + CHUNK], ORDER + 1)
            own[pads[at : at + CHUNK]] = 0
            first, last = whose[at], whose[min(at + CHUNK, len(data)) - 1] + 1
            for i in range(len(self.langs)):
                total[first:last, i] += np.bincount(whose[at : at + CHUNK] - first, own[:, i], last - first)
        return total, ends - starts


def classifier(shared):
    """What a task does with each piece: adds lang_pred, score, bits a byte."""
    model: Model | None = shared.value

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        langs, scores, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
        some = [i for i, t in enumerate(texts) if has_letter(t)] if model and model.langs else []
        if some:
            total, n = model.bits([texts[i] for i in some])
            best = total.argmin(axis=1)
            odds = np.exp2(np.maximum(total.min(axis=1, keepdims=True) - total, -1000))
            share = odds.max(axis=1) / odds.sum(axis=1)
            for k, i in enumerate(some):
                langs[i], scores[i], rate[i] = model.langs[best[k]], float(share[k]), float(total[k, best[k]] / max(1, n[k]))
        cols = [batch.column(c) for c in batch.schema.names if c != "text" or work.keep]
        names = [c for c in batch.schema.names if c != "text" or work.keep]
        return pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rate, pa.float64())], names=[*names, "lang_pred", "lang_score", "bits_per_byte"])

    work.keep = False
    return work


def keeping_text(shared):
    work = classifier(shared)
    work.keep = True
    return work


def train(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Learn from at most ``sample_per_lang`` rows (text, lang) of each language."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    samples: dict[str, list[str]] = {}
    for r in pick_sample(rows, "lang", sample_per_lang):
        if has_letter(r.text):
            samples.setdefault(r.lang, []).append(r.text)
    return Model(samples)


def identify(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (without text unless ``keep_text``), lang_pred, lang_score, bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's size
    clash = {"lang_pred", "lang_score", "bits_per_byte"}
    docs = docs.select(*[c for c in docs.columns if c not in clash])
    kept = [f for f in docs.schema.fields if f.name != "text" or keep_text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "lang_score double", "bits_per_byte double"])
    return per_text(docs, schema, keeping_text if keep_text else classifier, shared)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "bits_per_byte")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents without a language go, the others carry the predicted one.

    A document is rejected if it has no letter, or if its shortest code is no shorter
    than the plain bytes (8 bits each): then no learned language explains it.
    """
    columns = docs.columns
    out = identify(docs, train(docs), keep_text=True).filter("lang_pred <> 'und' AND bits_per_byte < 8")
    return out.withColumn("lang", F.col("lang_pred")).select(*columns)
