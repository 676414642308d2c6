"""Exact deduplication against a persistent index of digests.

The index is a table (digest, keep_id) of all texts that stayed so far, bucketed and
sorted by digest, in a folder that outlives the session. A batch is added in three steps:

1. Each row becomes (doc_id, digest of the normalised text); texts go no further.
2. Rows of one digest are counted, with a partial count before the shuffle, so a text that
   a third of all rows repeat is one row for each task of the map side.
3. The digests of the batch are anti-joined with the index by sort-merge. The index has
   the partitioning it is stored in, so it is never shuffled; only digests of the batch
   are. What isn't in the index is appended to it, one file for each bucket.

An append is one Spark write, so it is there as a whole or not at all; a batch that is
added again after a failure finds its own rows and gives the same result. The number of
buckets is fixed when the index is made (``buckets_for``) and stored with it.

``resolve`` joins rows with what the index says about their digests. Digests that more
than one in ``HOT_PART`` rows has are joined by broadcast (there are at most ``HOT_PART``
of them, whatever the input), the others by shuffle, so no task holds a hot text.

Defined cases: a null text counts as empty, and empty texts are equal; of equal texts the
row with the smallest doc_id stays, a row without doc_id only if no row with that text
has one, and of rows that repeat both doc_id and text one stays; a text that an earlier
batch added keeps that batch's doc_id even if a smaller one comes later; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, shared_dir

#: Digests of one bucket, about.
BUCKET_ROWS = 2_000_000
LEAST_BUCKETS, MOST_BUCKETS = 8, 50_000
#: A digest is hot if more than one row in so many has it: there are fewer than so many hot ones.
HOT_PART = 100_000
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, at) of each row of ``docs``, written; ``at`` tells rows apart."""
    own = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
    return materialize(own.withColumn("at", F.monotonically_increasing_id()), "digests")


def buckets_for(rows: int) -> int:
    """Buckets of an index that is to hold so many rows."""
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


class DigestIndex:
    """The index in a shared folder; made there if there is none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        meta = f"{self.path}/meta"
        try:
            self.buckets = spark.read.schema("buckets int").parquet(meta).first()[0]
        except AnalysisException:
            self.buckets = buckets
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(meta)
        self.table = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def new(self, rows: DataFrame) -> DataFrame:
        """(digest, keep_id) of the digests of ``rows`` that the index doesn't have."""
        own = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        return own.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, rows: DataFrame) -> None:
        """Append the digests of ``rows`` (doc_id, digest) that are new."""
        fresh = materialize(self.new(rows), "new-digests")
        # one task for each bucket, so a bucket gets one file
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of each of ``rows`` (``digests``), which have been added."""
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "at"))
        own = rows.groupBy("digest").agg(F.count("*").alias("group_size"), first.alias("_f"))
        found = own.join(self.rows().hint("merge"), "digest")
        stays = F.when(F.col("keep_id").eqNullSafe(F.col("_f.doc_id")), F.col("_f.at")).alias("stays")
        groups = materialize(found.select("digest", "keep_id", "group_size", stays), "digest-groups")
        hot = groups.filter(F.col("group_size") * HOT_PART > F.lit(rows.count()))
        by_broadcast = rows.join(F.broadcast(hot), "digest")
        others = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        by_shuffle = others.join(groups.filter(F.col("group_size") * HOT_PART <= F.lit(rows.count())).hint("merge"), "digest")
        kept = F.coalesce(F.col("at") == F.col("stays"), F.lit(False)).alias("kept")
        sha = F.lower(F.hex("digest")).alias("text_sha256")
        return by_broadcast.unionByName(by_shuffle).select("doc_id", "keep_id", "group_size", kept, sha)

    def compact(self, path: str) -> DigestIndex:
        """The same index in another folder, with one sorted file for each bucket."""
        out = DigestIndex(self.spark, path, self.buckets)
        self.rows().repartition(self.buckets, "digest").write.insertInto(out.table)
        return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come in two batches: those up to the middle doc_id fill the index, the others are held against it."""
    rows = digests(read(spark, sf_dir, "documents"))
    index = DigestIndex(spark, f"{shared_dir(spark)}/digest-index-{spark.sql('SELECT uuid()').first()[0]}", buckets_for(rows.count()))
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    early = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    index.add(rows.filter(early))
    index.add(rows.filter(~early))
    return index.resolve(rows)


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
 row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)"""
