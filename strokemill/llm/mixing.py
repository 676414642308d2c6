"""Mixing sources to target weights by temperature.

A source with the token share p gets the weight p^alpha, normalised. The exponent is
found by bisection (many exponents are tried in each step, in one small aggregation over
the table of sources): the smallest one (the flattest mix) for which no source is
repeated more than ``max_repeats`` times, or the largest one that still reaches
``min_entropy`` (as a part of the entropy of the uniform mix).

Weights are realised as budgets of tokens. The documents of a source lie in blocks, by a
hash of the doc_id; a pass over the source takes the blocks in their order, which is a
random permutation of the documents. A source gets as many whole passes as its budget
holds; of the last, partial pass it gets whole blocks until the budget is reached, and of
the block where that happens the documents in the order of their hash.

Only sums by source and by block are sorted, so a source with a third of all rows is no
single task; inside a block the sort is over one block of the source.

Defined cases: a null source is a source of its own; texts without words have no tokens
and go with every whole pass; a source without tokens gets one pass; repeated rows are
documents of their own, and ties in the hash go by doc_id, then text; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_checked, materialize, read

#: Exponents tried at once in each step, and steps.
WAYS, STEPS = 64, 6
#: Tokens of a block, about.
BLOCK_TOKENS = 1 << 20
HASH_SPACE = 1 << 30


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def exponent(sources: DataFrame, budget: float | None, max_repeats: float | None, min_entropy: float | None) -> float:
    """The exponent in [0, 1] that meets the target. ``budget`` None: as many tokens as
    give the least repeated source one pass, so repeats are compared with that source's."""
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.filter("tokens > 0").select(F.ln(F.col("tokens") / F.lit(float(total))).alias("lp"))
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        tried = F.explode(F.transform(F.sequence(F.lit(0), F.lit(WAYS)), lambda i: F.lit(low) + i * ((high - low) / WAYS))).alias("a")
        powers = shares.select("lp", tried)
        rows = powers.groupBy("a").agg(F.sum(F.exp(F.col("a") * F.col("lp"))).alias("z"), F.sum(F.col("lp") * F.exp(F.col("a") * F.col("lp"))).alias("zl"), F.max((F.col("a") - 1) * F.col("lp")).alias("top"), F.min((F.col("a") - 1) * F.col("lp")).alias("least"), F.count("*").alias("n")).orderBy("a").collect()
        if not rows:
            return 1.0
        good = []
        for r in rows:
            if max_repeats is not None:
                passes = math.exp(r.top - r.least) if budget is None else budget / total * math.exp(r.top) / r.z
                good.append(passes <= max_repeats * (1 + 1e-12))
            else:
                entropy = math.log(r.z) - r.a * r.zl / r.z
                good.append(entropy < min_entropy * math.log(r.n) if r.n > 1 else False)
        # from the first good exponent on all are good (repeats fall, entropy falls)
        at = good.index(True) if any(good) else len(good) - 1
        if at == 0:
            return rows[0].a
        low, high = rows[at - 1].a, rows[at].a
    return high if max_repeats is not None else low


def mix(docs: DataFrame, budget: float | None = None, max_repeats: float | None = None, min_entropy: float | None = None, seed: int = 11) -> DataFrame:
    """All columns of ``docs``, n_tokens, weight, block, and repeats: how often the document is taken."""
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(HASH_SPACE))
    new = ("n_tokens", "weight", "block", "repeats")
    own = docs.select(*[c for c in docs.columns if c not in new]).withColumn("n_tokens", tokens_of(F.col("text")))
    narrow = materialize(own.select("doc_id", F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "n_tokens", F.xxhash64("text").alias("_t")), "tokens")
    sources = materialize(narrow.groupBy("_s", "_n").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    a = exponent(sources, budget, max_repeats, min_entropy)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(max(1, total))), F.lit(a))).otherwise(0.0)
    sums = sources.select(F.sum(power).alias("z"), F.min(F.when(F.col("tokens") > 0, power / F.col("tokens"))).alias("least")).first()
    z = sums.z or 1.0
    spend = budget if budget is not None else (z / sums.least if sums.least else 0.0)
    plan = sources.select("_s", "_n", "tokens", (power / F.lit(z)).alias("weight"))
    plan = plan.withColumn("budget", F.floor(F.col("weight") * F.lit(float(spend)) + 1e-6).cast("bigint"))
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("bigint"))
    plan = materialize(plan.withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0)).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / BLOCK_TOKENS))), "plan")
    count = plan.count()
    placed = join_checked(narrow.withColumn("_h", h), plan, ["_s", "_n"], "inner", 200, count).withColumn("block", F.floor(F.col("_h") * F.col("blocks") / HASH_SPACE).cast("bigint"))
    sized = placed.groupBy("_s", "_n", "block").agg(F.sum("n_tokens").alias("size"), F.first("rest").alias("rest"))
    before = F.sum("size").over(Window.partitionBy("_s", "_n").orderBy("block")) - F.col("size")
    blocks = materialize(sized.withColumn("before", before), "blocks")
    # blocks that the rest takes whole, and the one where it ends
    edge = blocks.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))).select("_s", "_n", "block", (F.col("rest") - F.col("before")).alias("left"))
    order = Window.partitionBy("_s", "_n", "block").orderBy("_h", "doc_id", "_t")
    inside = join_checked(placed, edge, ["_s", "_n", "block"], "inner", 100, count).withColumn("sum", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("sum <= left").select("doc_id", "_s", "_n", "_t").distinct()
    extra = materialize(inside.withColumn("partial", F.lit(1)), "partial-block")
    full = F.col("before") + F.col("size") <= F.col("rest")
    whole = blocks.select("_s", "_n", "block", full.alias("whole"))
    keys = own.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_n", F.col("source").isNull()).withColumn("_t", F.xxhash64("text")).withColumn("_h", h)
    keyed = join_checked(keys, plan.select("_s", "_n", "weight", "passes", "blocks"), ["_s", "_n"], "inner", 200, count).withColumn("block", F.floor(F.col("_h") * F.col("blocks") / HASH_SPACE).cast("bigint"))
    keyed = join_checked(keyed, whole, ["_s", "_n", "block"], "inner", 100)
    keyed = join_checked(keyed, extra, ["doc_id", "_s", "_n", "_t"], "left", 100)
    taken = F.col("passes") + F.when(F.col("whole"), 1).otherwise(F.coalesce("partial", F.lit(0)))
    return keyed.withColumn("repeats", taken.cast("bigint")).select(*own.columns, "weight", "block", "repeats")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of as many tokens as there are, in which no source is repeated more than twice."""
    docs = read(spark, sf_dir, "documents")
    total = docs.agg(F.sum(tokens_of(F.col("text")))).first()[0] or 0
    return mix(docs.select("doc_id", "text", "source"), float(total), max_repeats=2.0).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every document stays; those of small sources are taken up to 1.25 times."""
    out = mix(docs, None, max_repeats=1.25)
    return out.withColumn("_", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("repeats").cast("int"))))).select(*docs.columns)
