"""Document fingerprints by spot signatures, on DataFrame functions alone.

Words are runs of letters and digits, lower-cased. Each common word (an anchor) starts
a chain: the anchor and the next ``CHAIN`` content words after it (anchors between them
are passed over). The set of the hashed chains is the fingerprint; likeness is the
Jaccard likeness of two sets. A text with words but without an anchor, or without any
content word after one, has one signature, the hash of all its words.

For pairs, sets are partitioned by their length: only neighbouring classes can hold sets
of the wanted likeness. In a class a set is looked up by its smallest hashes (prefix
filter), and pairs whose lengths alone rule them out are pruned before sets are compared.

Defined cases: null counts as the empty text; a text without words has the empty
fingerprint; two empty fingerprints have likeness 1, an empty and another one 0; an
empty table gives an empty result; of rows that repeat a doc_id, the smaller text comes
first; rows without a doc_id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize, read

#: Anchors, common words of the languages of the corpus.
ANCHORS = ("the", "and", "to", "is", "that", "was", "le", "la", "et", "des", "une", "que", "der", "die", "und", "das", "mit", "el", "los", "en", "una", "por")
CHAIN = 3


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def with_signatures(df: DataFrame, text: str, out: str, anchors: tuple = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Add ``out``: the sorted distinct signatures of ``text`` (array of bigint)."""
    anchor = lambda w: w.isin(*anchors)
    df = df.withColumn("_w", words(F.coalesce(text, F.lit(""))))
    df = df.withColumn("_a", F.filter(F.transform("_w", lambda w, i: F.when(anchor(w), i)), lambda i: i.isNotNull()))
    df = df.withColumn("_c", F.filter("_w", lambda w: ~anchor(w)))
    # before the j-th anchor, at place p, stand p - j content words
    after = lambda p, j: [F.get("_c", p - j + i) for i in range(chain)]
    hashed = F.transform("_a", lambda p, j: F.when(F.get("_c", p - j).isNotNull(), F.xxhash64(F.get("_w", p), *after(p, j))))
    df = df.withColumn("_s", F.sort_array(F.array_distinct(F.array_compact(hashed))))
    whole = F.when(F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(F.size("_s") > 0, F.col("_s")).otherwise(whole)).drop("_w", "_a", "_c", "_s")


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common).cast("double"))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.hex(s))), ".")


def near_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) of classes of equal fingerprints with the wanted likeness.

    ``sets`` has doc_id and sigs; a class is named by its smallest doc_id.
    """
    classes = sets.filter(F.size("sigs") > 0).groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).withColumn("n", F.size("sigs"))
    level = F.floor(F.log("n") / F.log(F.lit(1 / threshold))).cast("int")
    sized = classes.withColumn("level", level)
    prefix = F.slice("sigs", 1, F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    probes = sized.select("doc_id", "sigs", "n", F.explode(F.array("level", F.col("level") + 1)).alias("level"), prefix.alias("p")).select("doc_id", "sigs", "n", "level", F.explode("p").alias("s"))
    held = sized.select(F.col("doc_id").alias("b"), F.col("sigs").alias("sigs_b"), F.col("n").alias("m"), "level", F.explode(prefix).alias("s"))
    near = probes.join(held, ["level", "s"]).filter((F.col("n") <= F.col("m")) & (F.col("doc_id") != F.col("b")) & ((F.col("n") < F.col("m")) | (F.col("doc_id") < F.col("b"))) & (F.col("n") >= threshold * F.col("m")))
    once = near.dropDuplicates(["doc_id", "b"])
    return once.select(F.col("doc_id").alias("a"), "b", likeness(F.col("sigs"), F.col("sigs_b")).alias("likeness")).filter(F.col("likeness") >= threshold)


def ranges(docs: DataFrame, rows: int) -> tuple[DataFrame, Column, int]:
    """Cells of doc_id in ranges of about ``rows`` rows: a table (cell, bucket, top, up), the cell of a row (null without a doc_id), the table's rows.

    ``top`` is the largest id of the cell's range, ``up`` the range above (of the highest:
    the lowest). Cells are equally wide and 8 for each range, so their number grows with
    the rows; ranks come from counts by cell. Rows without a doc_id make the cell -1,
    which is the lowest range.
    """
    n, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    cells = max(1, 8 * n // rows)
    low = low or 0
    width = max(1, -(-((high or 0) - low + 1) // cells))
    # wider than a bigint: ids may lie anywhere
    place = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("bigint")
    own = docs.select("doc_id", F.coalesce(place, F.lit(-1).cast("bigint")).alias("cell"))
    counts = own.groupBy("cell").agg(F.count("*").alias("c"), F.max("doc_id").alias("most"))
    # windows over one small row for each cell, then for each range
    before = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("cell")) - F.col("c")
    placed = counts.withColumn("bucket", F.when(F.col("cell") >= 0, F.floor(before / rows)).otherwise(-1).cast("bigint"))
    tops = placed.groupBy("bucket").agg(F.max("most").alias("top"))
    one = Window.partitionBy(F.lit(0))
    up = F.coalesce(F.lead("bucket").over(one.orderBy("bucket")), F.min("bucket").over(one))
    table = materialize(placed.select("cell", "bucket").join(tops.withColumn("up", up), "bucket").select("cell", "bucket", "top", "up"), "ranges")
    return table, place, table.count()


def with_next(docs: DataFrame, carried: list[str], rows: int = 2000) -> DataFrame:
    """Add next_*: the carried columns of the next row by descending doc_id (after the last: the first).

    Rows are dealt to ranges of ids (see ``ranges``). The top row of a range is also a
    guest in the range above, where it follows the last row, so neighbours meet without
    one global sort; the largest id is a guest of the lowest range.
    """
    table, place, n = ranges(docs, rows)
    own = docs.withColumn("_cell", F.coalesce(place, F.lit(-1).cast("bigint")))
    known = table.select(F.col("cell").alias("_cell"), F.col("bucket").alias("_bucket"), F.col("top").alias("_top"), F.col("up").alias("_up"))
    dealt = join_checked(own, known, "_cell", "inner", 48, n)
    seat = lambda b, guest: F.struct(F.col(b).alias("bucket"), F.lit(guest).alias("guest"))
    seats = F.array_compact(F.array(seat("_bucket", 0), F.when(F.col("doc_id").eqNullSafe(F.col("_top")), seat("_up", 1))))
    order = Window.partitionBy("_seat.bucket").orderBy("_seat.guest", F.desc_nulls_last("doc_id"), "text")
    both = dealt.withColumn("_seat", F.explode(seats)).withColumn("_next", F.lead(F.struct(*carried)).over(order)).filter("_seat.guest = 0")
    return both.select(*docs.columns, *(F.col(f"_next.{c}").alias(f"next_{c}") for c in carried))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_signatures(docs, "text", "sigs")
    both = with_next(own, ["text", "sigs"]).withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    both = with_signatures(both.drop("text", "next_text"), "edited", "edited_sigs")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
