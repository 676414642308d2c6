"""N-gram Jaccard self-join by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct word n-grams. The global order
of n-grams (that of their hashes) is cut into fragments; a set falls into parts, one for
each fragment.

1. *Candidates.* Two sets of Jaccard likeness t or more differ in at most
   ``(1-t)/(1+t) * (|x|+|y|)`` n-grams. If the order is cut into more fragments than
   that, at least one fragment has the same part in both sets, so each part becomes one
   key (its digest). Fragment counts depend on the size class of a set; a set that may be
   linked to a smaller class also gets the keys of that class. Empty parts are no keys:
   a set with so many of them that the guarantee would need them also gets the keys of
   another order, so two such sets meet there.
2. *Suspects.* Only sets that share a key with a different set go on, with all their
   n-grams. N-grams that occur in one suspect only can't overlap with anything: a set
   with too many of them can't reach t, and in a pair they bound the overlap. This is an
   exact test, and it thins large groups of half-alike copies to the true ones.
3. *Counting.* For a candidate pair the overlap is counted in each fragment separately
   and summed over the fragments.
4. *Links.* In a few turns each suspect is paired with one leader of its keys, the one
   it shares most keys with; verified pairs make components. Then all pairs that share a key and
   lie in different components are counted, so no link between components is lost, and
   copies inside a component are never expanded into pairs. Sets differ by at least as
   many n-grams as their parity bitmaps have different bits: pairs that are too far
   apart by that (exact) bound are left out before they leave the join.

Sets that are equal are one class from the start (64-bit digest and size).

Defined cases: with fewer words than n the whole sequence is the one n-gram; without
words or text the set is empty and linked with nothing; rows that repeat a doc_id are one
document with the links of all of them; rows without a doc_id have no component_id and
name none; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, join_checked, let_go, materialize, per_text, read

N, NUM, DEN = 3, 90, 100
#: The pipeline's rule for near copies: words in an n-gram, and likeness.
STAGE_N, STAGE_NUM, STAGE_DEN = 5, 80, 100
#: Upper end of a size class is this times its lower end.
STEP = 1.5
#: Fragments beyond what the bound asks for, at least: how many parts may be empty.
SLACK = 2
#: Orders that are tried until a set has few empty parts.
ORDERS = 8
#: Parts into which the order is cut to count overlaps, a power of two, and their columns.
COUNTED = 8
PARTS = [f"p{p}" for p in range(COUNTED)]
#: 64-bit words of the bitmap that bounds how far two sets differ.
WORDS = 16
#: Words of the map of shared keys: at 40 bytes a row it stays below ``BROADCAST_BYTES``.
MARKS = 1 << 19
#: Slices of the space of keys, and of n-grams, that are looked through one after the other.
SLICES = 4
#: Turns in which suspects are paired with leaders before all open pairs are counted.
ROUNDS = 3
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams."""
    words = text.encode("utf-8").lower().split() if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(n, len(h))
    total = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
    for k in range(n):
        total = mixed(total * A + h[k : len(h) - n + 1 + k])
    return np.unique(total)


def slack(low: int, k: int) -> int:
    """Parts that may be empty in sets of ``low`` n-grams or more: few sets have more empty ones."""
    if not k:
        return 0
    tried = SLACK + np.unique(np.linspace(0, k // 6, 200).astype(int))
    empty = (k + 1 + tried) * np.exp(-low / (k + 1 + tried))
    enough = empty + 2 * np.sqrt(empty) <= tried
    return int(tried[enough.argmax()] if enough.any() else tried[-1])


def classes(num: int, den: int, most: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the size classes, the n-grams in which linked sets of each may differ, and the slack of each."""
    lows, low = [], 1
    while low < most:
        lows.append(low)
        low = max(low + 1, int(low * STEP))
    highs = [*[x - 1 for x in lows[1:]], most]
    # |x| <= high, |y| <= |x|/t: differing n-grams at most (1-t)/(1+t)*(|x|+|y|)
    bound = [((den - num) * (h + h * den // num)) // (den + num) for h in highs]
    return np.array(lows), np.array(bound), np.array([slack(*x) for x in zip(lows, bound, strict=True)])


def keys_of(s: np.ndarray, lows: np.ndarray, bound: np.ndarray, slacks: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set: digests of its parts, for its class and the classes below that it may be linked to."""
    n = len(s)
    own = int(np.searchsorted(lows, n, "right")) - 1
    levels = [own]
    while levels[-1] and (lows[levels[-1]] - 1) * den >= num * n:
        levels.append(levels[-1] - 1)
    out, orders = [], [(s, mixed(s))]
    for c in levels:
        k = int(bound[c])
        parts = k + 1 + int(slacks[c])
        for turn in range(ORDERS):
            if turn == len(orders):
                again = np.sort(mixed(s + np.uint64(turn << 32)))
                orders.append((again, mixed(again)))
            placed, body = orders[turn]
            at = ((placed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            begins = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            own_parts = at[begins]
            digest = np.add.reduceat(body, begins)
            sizes = np.diff(np.append(begins, n)).astype(np.uint64)
            few = parts - len(begins) < parts - k
            if not few and turn == ORDERS - 1:
                # too many empty parts in every order to do without them
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), own_parts)
                own_parts = np.concatenate((own_parts, empty))
                digest, sizes = (np.concatenate((x, np.zeros(len(empty), np.uint64))) for x in (digest, sizes))
            out.append(mixed(digest + sizes * B + (own_parts + np.uint64((c << 40) + (turn << 36))) * C))
            if few:
                break
    return np.concatenate(out)


def digest(s: np.ndarray) -> int | None:
    """The class of a set: equal sets have equal digests; an empty set is in no class."""
    return int(np.add.reduce(mixed(s ^ A)).view(np.int64)) if len(s) else None


def sketcher(n: int, num: int, den: int):
    lows, bound, slacks = classes(num, den)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, keys = [], [], []
        for t in batch.column("text").to_pylist():
            s = shingles(t, n)
            sizes.append(len(s))
            digests.append(digest(s))
            keys.append(keys_of(s, lows, bound, slacks, num, den) if len(s) else np.zeros(0, np.uint64))
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        flat = pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "n_shingles", "class", "keys"])

    return work


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the n-grams that fall on each of 64 * WORDS bits."""
    odd = np.bincount(((s >> np.uint64(20)) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def unfolder(n: int):
    """N-grams and bitmaps of the rows whose text is of their class; texts that only share the class's doc_id go.

    The part of an n-gram is given by the top bits of its hash; a column for each, so a step reads the parts it needs.
    """
    ends = np.arange(1, COUNTED, dtype=np.uint64) << np.uint64(65 - COUNTED.bit_length())

    def lists(rows: list) -> pa.ListArray:
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
        own = [i for i, (s, c) in enumerate(zip(sets, batch.column("class").to_pylist(), strict=True)) if digest(s) == c]
        batch, sets = batch.take(pa.array(own, pa.int64())), [sets[i] for i in own]
        cut = [np.split(s.view(np.int64), np.searchsorted(s, ends)) for s in sets]
        parts = [lists([x[p] for x in cut]) for p in range(COUNTED)]
        return pa.RecordBatch.from_arrays([batch.column("class"), batch.column("_t"), *parts, lists([*map(bitmap, sets)])], names=["class", "_t", *PARTS, "bits"])

    return work


def components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component of the links (a, b), which are written tables.

    In each round every node takes the smallest label of its neighbours, then the label
    of its label, until no label moves; each round is written, so lost executors cost one
    round at most.
    """
    both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("mid"), "label")
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "mid").select("node", F.least("mid", "far").alias("label"), (F.least("mid", "far") < F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.filter("moved").limit(1).count():
            break
    return labels.withColumnRenamed("label", "component")


def linked(pairs: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose likeness is num/den or more: overlaps are counted part by part and summed."""
    left = pairs.join(parts.select(F.col("class").alias("a"), F.col("n").alias("na"), "part", F.col("own").alias("own_a")), "a")
    both = left.join(parts.select(F.col("class").alias("b"), F.col("n").alias("nb"), "part", F.col("own").alias("own_b")), ["b", "part"])
    counted = both.select("a", "b", "na", "nb", F.size(F.array_intersect("own_a", "own_b")).alias("common"))
    sums = counted.groupBy("a", "b").agg(F.sum("common").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return sums.filter(den * F.col("common") >= num * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def marked(keys: DataFrame, shared: DataFrame) -> DataFrame:
    """``keys`` without most of those that are not in ``shared``, so fewer go through the exact join that follows.

    A key sets one bit of a map of ``MARKS`` words of 64 bits. The map is broadcast; its
    size does not grow with the data. The fuller it gets, the fewer keys it saves (beyond
    about 100 million shared keys none); it never drops one of ``shared``.
    """
    word, bit = F.pmod(F.shiftrightunsigned("key", 6), F.lit(MARKS)).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")
    marks = materialize(shared.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("marks")), "marks")
    return keys.select("key", "class", word, bit).join(F.broadcast(marks), "word").filter(F.col("marks").bitwiseAND(F.col("bit")) != 0).select("key", "class")


def shared_keys(full: DataFrame) -> DataFrame:
    """(key, class) of the keys that more than one class has, from ``full`` (class, keys), written.

    The space of keys is cut into ``SLICES``, one after the other, so the shuffles of all
    keys never lie on disk together. Each slice takes its part of all rows.
    """

    def slice_of(k: int):
        # a lambda with a second argument would get the place in the array
        return F.filter("keys", lambda x: F.pmod(x, F.lit(SLICES)) == k)

    out = None
    for k in range(SLICES):
        own = slice_of(k)
        keys = full.select(F.explode(own).alias("key"), "class")
        ends = keys.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high"))
        shared = materialize(ends.filter("low <> high").select("key"), "shared-keys")
        let_go(full.sparkSession)
        # keys of ``shared`` are unique; the optimizer would move a semi-join below the bit map
        held = materialize(join_checked(marked(keys, shared), shared, "key", "inner", 40).distinct(), "held-keys")
        let_go(full.sparkSession)
        out = held if out is None else out.union(held)
    return out


def unshared(sets: DataFrame) -> DataFrame:
    """(class, alone): how many n-grams of each class no other class of ``sets`` (class, ``PARTS``) has, if any.

    Like keys, n-grams are looked through in ``SLICES``, so their shuffles never lie on disk together. Each slice reads its
    own parts; the counts are summed.
    """
    out = None
    for k in range(SLICES):
        grams = sets.select("class", F.explode(F.concat(*PARTS[k::SLICES])).alias("s"))
        once = grams.groupBy("s").agg(F.count("*").alias("c"), F.min("class").alias("class")).filter("c = 1")
        counts = materialize(once.groupBy("class").agg(F.count("*").alias("alone")), "alone")
        let_go(sets.sparkSession)
        out = counts if out is None else out.union(counts)
    return out.groupBy("class").agg(F.sum("alone").alias("alone"))


def join_groups(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    own = docs.select("doc_id", "text")
    sketch = materialize(per_text(own, "doc_id bigint, n_shingles bigint, class bigint, keys array<bigint>", sketcher, n, num, den), "sketches")
    held = shared_keys(sketch.filter("class IS NOT NULL"))
    # from here on nothing reads the keys of all documents
    keys, sketch = sketch, materialize(sketch.select("doc_id", "n_shingles", "class"), "classes")
    drop_written(keys)
    full = sketch.filter("class IS NOT NULL")
    # one document of each class that holds such a key, with all its n-grams
    suspects = held.select("class").distinct()
    one = materialize(full.select("doc_id", "class").join(suspects, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL"), "suspects")
    # all texts of the doc_id, for rows may repeat it; the unfolder keeps those of the class
    texts = join_checked(own, one, "doc_id", "inner", 48).select("class", "text", F.xxhash64("text").alias("_t")).dropDuplicates(["class", "_t"])
    unfolded = sets = materialize(per_text(texts.select("class", "_t", "text"), "class bigint, _t bigint, " + "".join(f"{p} array<bigint>, " for p in PARTS) + "bits array<bigint>", unfolder, n), "suspect-sets")
    # texts of one doc_id that differ and still have one set: the one with the smallest hash stays; sets are not shuffled for that
    twice = materialize(sets.groupBy("class").agg(F.count("*").alias("c"), F.min("_t").alias("_m")).filter("c > 1").select("class", "_m"), "sets-met-twice")
    if twice.limit(1).count():
        sets = join_checked(sets, twice, "class", "left", 48).filter("_m IS NULL OR _t = _m").drop("_m")
    sets = sets.drop("_t")
    let_go(docs.sparkSession)
    alone = unshared(sets)
    size = sum((F.size(p) for p in PARTS), F.lit(0)).cast("long")
    bound = materialize(
        sets.select("class", size.alias("n")).join(alone, "class", "left").select("class", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("most")).filter(den * F.col("most") >= num * F.col("n")),
        "bounded-suspects",
    )
    let_go(docs.sparkSession)
    members = materialize(held.select("key", "class").join(bound, "class"), "members")
    left = sets.join(bound.select("class"), "class", "left_semi")
    parts = materialize(left.select("class", size.alias("n"), F.posexplode(F.array(*PARTS)).alias("part", "own")), "parts")
    words = [F.get("bits", F.lit(i)).alias(f"w{i}") for i in range(WORDS)]
    bits = materialize(left.select("class", F.struct(*words).alias("bits")), "bits")
    # from here on nothing reads whole sets
    drop_written(unfolded)
    let_go(docs.sparkSession)

    def possible(a: str, b: str):
        """The overlap that is still possible reaches the threshold."""
        most = F.least(F.col(f"{a}.most"), F.col(f"{b}.most"))
        return (den + num) * most >= num * (F.col(f"{a}.n") + F.col(f"{b}.n"))

    links, tried, groups = None, None, None
    placed = members.withColumn("component", F.col("class"))
    for turn in range(ROUNDS):
        # the leader of a key: the set with the fewest n-grams of its own, another one in each turn
        x = F.struct("class", "n", "most", "component")
        leaders = placed.groupBy("key").agg(F.min(F.struct(F.col("n") - F.col("most"), F.xxhash64("class", F.lit(turn)), x.alias("lead"))).alias("_"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key", "_.lead")
        to_leader = placed.join(leaders, "key").select(x.alias("x"), "lead").filter((F.col("x.component") != F.col("lead.component")) & possible("x", "lead"))
        votes = to_leader.groupBy(F.col("x.class").alias("c"), F.col("lead.class").alias("d")).agg(F.count("*").alias("v"))
        best = votes.groupBy("c").agg(F.max_by("d", F.struct("v", "d")).alias("d"))
        pairs = best.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "leader-pairs")
        new = materialize(linked(pairs, parts, num, den), "leader-links")
        let_go(docs.sparkSession)
        links, tried = (new, pairs) if links is None else (links.union(new), tried.union(pairs))
        if not new.limit(1).count():
            break
        groups = components(links)
        placed = materialize(members.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "placed")
    # pairs that share a key and lie in different components
    still = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    open_ = materialize(placed.join(still, "key", "left_semi").join(bits, "class").select("key", F.struct("class", "n", "most", "component", "bits").alias("x")), "open")
    other = open_.select("key", F.col("x").alias("y"))
    apart = sum(F.bit_count(F.col(f"x.bits.w{i}").bitwiseXOR(F.col(f"y.bits.w{i}"))) for i in range(WORDS))
    near = (den + num) * apart <= (den - num) * (F.col("x.n") + F.col("y.n"))
    rest = open_.join(other, "key").filter((F.col("x.class") < F.col("y.class")) & (F.col("x.component") != F.col("y.component")) & possible("x", "y") & near).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "other-pairs")
    new = materialize(linked(rest, parts, num, den), "other-links")
    # rows that repeat a doc_id are one document: their classes are linked
    spread = materialize(full.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("doc_id", "a"), "spread")
    same = join_checked(full.select("doc_id", F.col("class").alias("b")), spread, "doc_id", "inner", 48).filter("a <> b").select("a", "b").distinct()
    same = materialize(same, "links-of-ids")
    if groups is None or new.limit(1).count() or same.limit(1).count():
        groups = components(links.union(new).union(same))
    # classes to documents
    named = full.select("doc_id", "class").join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = materialize(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("c")).filter("c > 1").select("component", "component_id"), "components")
    ids = materialize(named.join(smallest, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "grouped")
    out = sketch.select("doc_id", "n_shingles")
    return join_checked(out, ids, "doc_id", "left", 48).withColumn("component_id", F.coalesce("component_id", "doc_id")).select("doc_id", "n_shingles", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of near copies the document with the smallest id stays."""
    groups = materialize(join_groups(docs, STAGE_N, STAGE_NUM, STAGE_DEN), "groups")
    gone = materialize(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return join_checked(docs, gone, "doc_id", "left_anti", 40)
