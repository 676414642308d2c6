"""Audit of how sources differ in their terms, language by language.

Every (lang, source) group gives each kept term of its language a smoothed share of
10^9. The report says how far each two sources of a language are apart (the sum of the
differences of their shares), and which terms a source has more of than its language.

*Terms.* Each task counts terms by group and by document as it reads and hands on what it
has gathered whenever that exceeds ``GATHERED`` entries, so texts are never exploded.
Kept terms of a language are cut by hash into ranges of about ``RANGE_TERMS`` and get
their places inside a range, frequent ones first; rare terms, which most groups lack,
stand side by side.

*Trees.* For a range the counts of a group are the leaves of a segment tree over term
places. Trees are hash-consed: equal leaves are one node, and two nodes with equal
children are one node, across all groups in the task. Two groups are compared by one
walk through both trees at once, level by level: pairs of nodes that come up more than
once on a level are kept once, the distinct pairs of leaves are priced, and the sums go
back up. So a stretch that neither group has costs one pair a level.

*Size.* The groups of a language are dealt into blocks of ``BLOCK_GROUPS`` by hash; a
task holds two blocks and one range (at most some 128 x 4,096 counts), and the prices
are summed by pair over the ranges. The number of pairs is that of the report.

All arithmetic is exact: whole numbers, of any size where 64 bits don't hold them.

Defined cases: null text, lang and source count as empty; a group without terms has share
p(0) of every term; where no term is kept all pairs are 0 apart and no terms are
reported; a language with one source has no pairs; an empty table gives an empty result;
other columns are not read. Rows without a doc_id count, for ids are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize, per_task, read

LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of terms: letters and all of UTF-8 beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Entries (group, term) that a task gathers before it hands them on.
GATHERED = 400_000
#: Kept terms of a range, and groups of a block, about.
RANGE_TERMS, BLOCK_GROUPS = 2048, 64
#: Whole numbers below this stay within 64 bits when multiplied by ``SCALE``.
SMALL = 9_000_000_000


def counter():
    held: dict = {}

    def finish() -> list:
        groups, terms, ns, docs_ = list(held), [], [], []
        for counts, docs in held.values():
            terms.append(pa.array(counts, pa.binary()).cast(pa.string()))
            ns.append(np.fromiter(counts.values(), np.int64, len(counts)))
            docs_.append(np.fromiter(map(docs.__getitem__, counts), np.int64, len(counts)))
        held.clear()
        if not groups:
            return []
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(n) for n in ns]))), pa.int32())
        lists = [pa.concat_arrays(terms), pa.array(np.concatenate(ns)), pa.array(np.concatenate(docs_))]
        names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
        cols = [*names, *(pa.ListArray.from_arrays(offsets, v) for v in lists)]
        return [pa.RecordBatch.from_arrays(cols, names=["lang", "source", "terms", "n", "docs"])]

    def take(batch: pa.RecordBatch) -> list:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            terms = TERM.findall(text.lower())
            counts.update(terms)
            docs.update(set(terms))
        return finish() if sum(len(c) for c, _ in held.values()) > GATHERED else []

    return take, finish


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with a null term for each group."""
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = per_task(own, "lang string, source string, terms array<string>, n array<bigint>, docs array<bigint>", counter)
    # the entry without a term says that the group occurs
    none = F.array(F.struct(F.lit(None).cast("string").alias("terms"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("docs")))
    each = counted.select("lang", "source", F.inline(F.concat(none, F.arrays_zip("terms", "n", "docs"))))
    # counted in the tasks already: each row goes to its place, and there is no second count on the way
    dealt = each.withColumnRenamed("terms", "term").repartition("lang", "source", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / whole), in decimals, which hold counts up to 10^27."""
    top = (n + PRIOR).cast("decimal(27,0)") * F.lit(SCALE).cast("decimal(10,0)")
    out = F.call_function("div", top, F.greatest(whole, F.lit(1)).cast("decimal(27,0)"))
    return (out + 1).cast("bigint")


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """The same for an array; -1 stands for a place without a term, which has no share."""
    if int(n.max(initial=0)) + PRIOR >= SMALL:
        return np.array([0 if x < 0 else 1 + SCALE * (int(x) + PRIOR) // whole for x in n], np.int64)
    return np.where(n < 0, 0, 1 + SCALE * (n + PRIOR) // max(1, whole))


class Trees:
    """Hash-consed segment trees of the rows of a matrix whose width is a power of two."""

    def __init__(self, counts: np.ndarray):
        #: Values of the leaves; of each level above, the children of its nodes.
        self.leaves, ids = np.unique(counts, return_inverse=True)
        ids, self.levels = ids.reshape(counts.shape), []
        while ids.shape[1] > 1:
            many = int(ids.max()) + 1
            nodes, at = np.unique(ids[:, ::2].astype(np.int64) * many + ids[:, 1::2], return_inverse=True)
            self.levels.append((nodes // many, nodes % many))
            ids = at.reshape(len(ids), -1)
        #: The root of each row's tree.
        self.roots = ids[:, 0]

    def apart(self, a: int, b: int, whole_a: int, whole_b: int) -> int:
        """The sum of the differences of the shares that rows ``a`` and ``b`` give their terms."""
        x, y, walked = self.roots[a : a + 1], self.roots[b : b + 1], []
        for left, right in reversed(self.levels):
            many = len(left)
            pairs, at = np.unique(x * many + y, return_inverse=True)
            x, y = pairs // many, pairs % many
            walked.append(at)
            x, y = np.concatenate((left[x], right[x])), np.concatenate((left[y], right[y]))
        pairs, at = np.unique(x * len(self.leaves) + y, return_inverse=True)
        left, right = self.leaves[pairs // len(self.leaves)], self.leaves[pairs % len(self.leaves)]
        price = np.abs(shares(left, whole_a) - shares(right, whole_b))[at]
        for at in reversed(walked):
            half = len(price) // 2
            price = (price[:half] + price[half:])[at]
        return int(price[0])


def compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Prices of all pairs of groups of two blocks (or one) on one range of terms."""
    lang, _, low, high = (k.as_py() for k in key)
    terms = rows.column("terms")[0].as_py()
    width = 1 << max(0, int(terms - 1).bit_length())
    counts = np.zeros((rows.num_rows, width), np.int64)
    counts[:, terms:] = -1
    for i, (places, own) in enumerate(zip(rows.column("places").to_pylist(), rows.column("counts").to_pylist(), strict=True)):
        if places:
            counts[i, places] = own
    names, blocks, wholes = (rows.column(c).to_pylist() for c in ("source", "block", "whole"))
    trees, out = Trees(counts), []
    for i in range(len(names)):
        for j in range(len(names)):
            if (names[i] < names[j]) if low == high else (blocks[i] == low and blocks[j] == high):
                out.append((lang, names[i], names[j], trees.apart(i, j, int(wholes[i]), int(wholes[j]))))
    cols = zip(*out, strict=True) if out else ([], [], [], [])
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "a", "b", "value"])


def distances(groups: DataFrame, cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """(lang, a, b, value) of each two groups of a language, both ways round."""
    packed = cells.groupBy("lang", "source", "range").agg(F.collect_list(F.struct("place", "n")).alias("own"))
    packed = packed.select("lang", "source", "range", F.col("own.place").alias("places"), F.col("own.n").alias("counts"))
    every = groups.select("lang", "source", "whole", "block", "blocks").join(ranges, "lang").join(packed, ["lang", "source", "range"], "left")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = every.select("*", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    prices = met.groupBy("lang", "range", "low", "high").applyInArrow(compare, "lang string, a string, b string, value bigint")
    sums = materialize(prices.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pair-sums")
    return sums.union(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups of ``docs`` (lang, source, text)."""
    counts = materialize(term_counts(docs), "term-counts")
    terms = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"))
    terms = materialize(terms.filter(F.col("docs") >= least_docs).select("lang", "term", "all_n"), "kept-terms")
    langs = counts.filter("term IS NULL").groupBy("lang").agg(F.count("*").alias("sources"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("total"))
    langs = langs.join(sizes, "lang", "left").fillna(0, ["v", "total"])
    langs = langs.withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("v") / RANGE_TERMS)).cast("int"))
    langs = materialize(langs.withColumn("blocks", F.ceil(F.col("sources") / BLOCK_GROUPS).cast("int")), "langs")
    many = langs.count()
    # places of terms in ranges
    at = F.pmod(F.xxhash64("term"), F.col("ranges")).cast("int")
    placed = join_checked(terms, langs.select("lang", "ranges"), "lang", "inner", 64, many).withColumn("range", at).drop("ranges")
    place = F.row_number().over(Window.partitionBy("lang", "range").orderBy(F.desc("all_n"), "term")) - 1
    placed = materialize(placed.withColumn("place", place), "placed-terms")
    cells = materialize(counts.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "cells")
    # groups with the divisor of their shares
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").fillna(0, ["own"])
    groups = join_checked(groups, langs.select("lang", "v", "total", "blocks"), "lang", "inner", 64, many)
    whole = F.col("own") + PRIOR * F.col("v")
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
    groups = materialize(groups.withColumn("whole", whole).withColumn("block", block), "groups")
    every = langs.select("lang", F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("range"))
    ranges = every.join(placed.groupBy("lang", "range").agg(F.count("*").alias("terms")), ["lang", "range"], "left").fillna(0, ["terms"])
    # the two parts of the report
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = [F.col("value").cast("bigint").alias("value"), F.row_number().over(w).cast("int").alias("rank")]
    pairs = distances(groups, cells, ranges).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", *named)
    own = join_checked(cells, groups.select("lang", "source", "whole", "total", "v"), ["lang", "source"], "inner", 128)
    more = share(F.col("n"), F.col("whole")) - share(F.col("all_n"), F.col("total") + PRIOR * F.col("v"))
    tops = own.select("lang", "source", F.col("term").alias("item"), more.alias("value")).filter("value > 0")
    tops = tops.select("lang", "source", F.lit("term").alias("part"), "item", *named).filter(F.col("rank") <= top)
    return pairs.union(tops)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
 each AS (SELECT id, lang, source, unnest(terms) AS term FROM docs),
 kept AS (SELECT lang, term, count(*) AS all_n FROM each GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
 langs AS (SELECT lang, sum(all_n)::HUGEINT AS total, count(*) AS v FROM kept GROUP BY lang),
 groups AS (SELECT DISTINCT lang, source FROM docs),
 own AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
 cells AS (SELECT g.lang, g.source, k.term, all_n, coalesce(n, 0)::HUGEINT AS n,
   sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS own_n, total, v
   FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN own o ON (o.lang, o.source, o.term) = (g.lang, g.source, k.term)),
 p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 5) // (own_n + 5 * v))::BIGINT AS p,
   (1 + 1000000000::HUGEINT * (all_n + 5) // (total + 5 * v))::BIGINT AS q FROM cells),
 apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
   LEFT JOIN apart d ON (d.lang, d.source, d.item) = (a.lang, a.source, b.source)),
 parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
