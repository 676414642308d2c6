"""Importance resampling of documents towards a target distribution.

Hashed n-grams of a raw corpus and of a target are counted in buckets; a document's
weight is the mean log ratio of its buckets, and documents are drawn without replacement
by the largest weight plus Gumbel noise.

*Batch concatenation.* The texts of a batch are joined with a separator that no word
holds. One regex pass over the joined bytes finds all words. ``searchsorted`` of their
places among the ends of the documents tells the document of each word, and an n-gram
whose first and last word lie in different documents is masked before the buckets are
counted with ``bincount``. A batch holds about 1 MB of text (or one document).

A task hands on one row of counts for each bucket it met, whatever its size. Gains are a
table of ``buckets`` numbers. Both passes read the text once; nothing but (doc_id,
numbers) is written or shuffled.

*Ranks.* Scores are whole numbers within a fixed range, so the score at which the draw
ends is found from two small histograms. Documents at or above it are sorted by ranges
of (score, doc_id), and a rank is the place in the range after the counts of the ranges
before it: no task sorts more than a range, and no join brings ranks back.

Defined cases: a null or empty text has no features and weight 0; a text with fewer than
``least_words`` words is never drawn; a null doc_id takes the noise of an empty id and
comes last among equal scores; rows that repeat a doc_id are documents of their own, with
equal noise; a target without features gives every bucket its share of one count; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, per_task, per_text, read

BUCKETS, NGRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of words: digits, a to z, and all of UTF-8 beyond ASCII. Other bytes separate.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = b"\x00"
#: Width of a bin of scores in the first histogram, and documents of a range when ranks are given.
BIN, RANGE_ROWS = 512, 1_000_000


def features(texts: list, n: int = NGRAM, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents (places in ``texts``) and buckets of all n-grams of up to ``n`` words, and words of each document."""
    owned = [t or b"" for t in texts]
    ends = np.cumsum([len(t) + 1 for t in owned])
    found = list(WORD.finditer(SENTINEL.join(owned).lower()))
    words = [m.group() for m in found]
    at = np.searchsorted(ends, np.fromiter((m.start() for m in found), np.int64, len(found)), "right")
    sums = list(map(crc32, words))
    docs, hashes = [at], [np.array(sums, np.int64)]
    for k in range(1, n):
        sums = list(map(crc32, words[k:], map(crc32, repeat(b" "), sums)))
        within = at[: len(sums)] == at[k : k + len(sums)]
        docs.append(at[: len(sums)][within])
        hashes.append(np.array(sums, np.int64)[within])
    return np.concatenate(docs), np.concatenate(hashes) % buckets, np.bincount(at, minlength=len(owned))


def texts_of(batch: pa.RecordBatch) -> list:
    return batch.column("text").cast(pa.binary()).to_pylist()


def counter(n: int, buckets: int):
    total = np.zeros(buckets, np.int64)

    def take(batch: pa.RecordBatch) -> list:
        np.add(total, np.bincount(features(texts_of(batch), n, buckets)[1], minlength=buckets), out=total)
        return []

    def finish() -> list:
        met = np.flatnonzero(total)
        return [pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])]

    return take, finish


def bucket_counts(texts: DataFrame, n: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of ``texts`` (text) fall into each bucket that has any."""
    own = per_task(texts.select("text"), "bucket bigint, n bigint", counter, n, buckets)
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the smoothed ratio of each bucket's share in ``target`` and in ``raw``."""
    spark = raw.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket")
    for name, counts in (("s", raw), ("t", target)):
        both = both.join(counts.withColumnRenamed("n", name), "bucket", "left").fillna(0, [name])
    both = materialize(both, "buckets")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    double = lambda c, more: (F.col(c) if isinstance(c, str) else F.lit(c)).cast("double") + more
    ratio = double("t", 1) * double(all_s, buckets) / (double("s", 1) * double(all_t, buckets))
    rows = both.select("bucket", F.floor(F.log(ratio) * 1000).alias("gain")).collect()  # ``buckets`` rows
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.gain for r in rows]
    return out


def weigher(gain: np.ndarray, n: int):
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        docs, at, words = features(texts_of(batch), n, len(gain))
        many = np.bincount(docs, minlength=rows)
        # sums of whole numbers below 2^53 are exact in doubles
        total = np.bincount(docs, weights=gain[at].astype(float), minlength=rows).astype(np.int64)
        weight = np.where(many > 0, total // np.maximum(many, 1), 0)
        cols = [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (many, words, weight))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_features", "n_words", "weight"])

    return work


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of the Gumbel noise g that a hash of seed and id gives."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def lowest_drawn(scored: DataFrame, many: int) -> int | None:
    """The score that the last of the ``many`` highest has."""
    low, left, width = None, many, BIN
    held = scored
    while width:
        at = F.floor(F.col("score") / width).cast("bigint")
        # scores are logarithms of counts plus noise of fixed range: a few hundred bins, then ``BIN`` scores
        for r in held.groupBy(at.alias("bin")).count().orderBy(F.desc("bin")).collect():
            if left <= r["count"]:
                low = r["bin"]
                break
            left -= r["count"]
        held, width = scored.filter(at == F.lit(low)), 1 if width > 1 else 0
    return low


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (doc_id, n_words, score, ..., written) with rank: the best ``percent`` of the documents with enough words."""
    able = F.col("n_words") >= least_words
    many = scored.filter(able).count() * percent // 100
    if not many:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    near = able & (F.col("score") >= F.lit(lowest_drawn(scored.filter(able), many)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranges = scored.filter(near).repartitionByRange(many // RANGE_ROWS + 8, *order, "at")
    ranges = materialize(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").count().orderBy("_range").collect()  # one row for a million documents
    starts, start = [], 0
    for r in sizes:
        starts.append((r["_range"], start))
        start += r["count"]
    first = scored.sparkSession.createDataFrame(starts, "_range int, _start bigint")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "at"))
    rank = F.col("_start") + place
    drawn = ranges.join(F.broadcast(first), "_range").withColumn("rank", rank.cast("bigint")).drop("_range", "_start")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    return drawn.unionByName(scored.filter(~near).withColumn("rank", F.lit(None).cast("bigint")))


def resample(
    docs: DataFrame, target: DataFrame, n: int = NGRAM, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text), by the n-grams of ``target`` (text)."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets), buckets)
    own = per_text(docs.select("doc_id", "text"), "doc_id bigint, n_features bigint, n_words bigint, weight bigint", weigher, gain, n)
    scored = own.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("at", F.monotonically_increasing_id())
    return draw(materialize(scored, "scored"), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc WHERE k < 8),
 steps AS (SELECT list(c ORDER BY i) AS step FROM crc WHERE k = 8),
 texts AS (SELECT 'd' AS side, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
 found AS (SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
 each AS (SELECT side, doc_id, unnest(words) AS word FROM found),
 hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, step[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
   FROM (SELECT DISTINCT word FROM each), steps),
 counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM each JOIN hashed USING (word) GROUP BY bucket),
 sums AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
 gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM counts, sums),
 own AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM each JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
 scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
   ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM documents d LEFT JOIN own USING (doc_id)),
 summed AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
 ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM summed)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) * 10 // 100 FROM summed WHERE n_features >= 20) THEN place END AS rank FROM ranked"""
