"""Curation of paired collections: matching, audits, splits, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPLITS, dest_stem, infer_split_from_filename, normalize_split_name, relative_stem, tokenize_ids, trimmed_suffix_stem, with_ids


def last_by_path(files: DataFrame) -> DataFrame:
    """One row for each stem: the last path in order."""
    return files.groupBy("stem").agg(F.max("path").alias("path"))


def match_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(stem, image, mask, side): pairs, and what only one side has, from one full join."""
    a, b = last_by_path(images).withColumnRenamed("path", "image"), last_by_path(masks).withColumnRenamed("path", "mask")
    side = F.when(F.col("mask").isNull(), "image_only").when(F.col("image").isNull(), "mask_only").otherwise("pair")
    return a.join(b, "stem", "full").withColumn("side", side)


def match_tiered(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(stem, path, mask, tier): exact stem; relative stem; lower-cased stem if one mask has it; stem without its last part if one has it."""
    exact = masks.groupBy("stem").agg(F.max("path").alias("m1"))
    relative = masks.groupBy(relative_stem(F.col("path")).alias("rel")).agg(F.max("path").alias("m2"))
    alone = lambda key, out: masks.filter(key.isNotNull()).groupBy(key.alias(out + "k")).agg(F.count("*").alias("c"), F.min("path").alias(out)).filter("c = 1").drop("c")
    low, cut = alone(F.lower("stem"), "m3"), alone(trimmed_suffix_stem(F.col("stem")), "m4")
    own = images.withColumn("rel", relative_stem(F.col("path"))).withColumn("m3k", F.lower("stem")).withColumn("m4k", F.lower("stem"))
    met = own.join(exact, "stem", "left").join(relative, "rel", "left").join(low, "m3k", "left").join(cut, "m4k", "left")
    tier = F.when(F.col("m1").isNotNull(), 1).when(F.col("m2").isNotNull(), 2).when(F.col("m3").isNotNull(), 3).when(F.col("m4").isNotNull(), 4)
    return met.select("stem", "path", F.coalesce("m1", "m2", "m3", "m4").alias("mask"), tier.alias("tier"))


def match_longest_prefix(sketches: DataFrame, keys: DataFrame) -> DataFrame:
    """(stem, key): the longest key that the stem equals, or that it begins with before one of ``_-. `` (case ignored).

    Each stem offers its prefixes at such characters, so this is an equi-join.
    """
    low = F.lower("stem")
    ends = F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: (i == F.length(low)) | F.substring(low, i + 1, F.lit(1)).isin("_", "-", ".", " "))
    offered = sketches.select("stem", F.explode(F.transform(ends, lambda i: F.substring(low, F.lit(1), i))).alias("_k"))
    met = offered.join(keys.select(F.col("key"), F.lower("key").alias("_k")), "_k")
    best = met.groupBy("stem").agg(F.max(F.struct(F.length("_k").alias("n"), "key")).getField("key").alias("key"))
    return sketches.join(best, "stem", "left")


def missing_counterparts(images: DataFrame, masks: DataFrame, folder: str) -> DataFrame:
    out = images.join(masks.select("stem").distinct(), "stem", "left_anti")
    return out.select("stem", "path", F.concat(F.lit(folder + "/"), "stem", F.lit(".png")).alias("expected"))


def plan_actions(wanted: DataFrame, existing: DataFrame, overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """``wanted`` (dest, ok) with the action that each row gets."""
    there = existing.select("dest").distinct().withColumn("_there", F.lit(True))
    skip = F.coalesce("_there", F.lit(False)) & F.lit(not overwrite)
    action = F.when(~F.col("ok"), "failed").when(skip, "skipped_existing").when(F.lit(dry_run), "dry_run_generated").otherwise("copied")
    return wanted.join(there, "dest", "left").withColumn("action", action).drop("_there")


def import_plan(images: DataFrame, masks: DataFrame, existing: DataFrame, prefix: str = "logo") -> DataFrame:
    """Tiered matches with destination names and actions."""
    met = match_tiered(images, masks)
    named = met.withColumn("dest", F.concat(F.lit("images/"), dest_stem(prefix, F.col("stem")), F.lit(".png"))).withColumn("ok", F.col("mask").isNotNull())
    return plan_actions(named, existing)


def parse_split_assignments(lines: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """``lines`` (file, file_ord, line_ord, value) to (id, split), the last assignment of an id; see ``split_line_errors``.

    ``records`` are assignments of JSON lists (file_ord, line_ord, id, split), as ``split_json_rows`` makes them.
    """
    rows = _split_rows(lines).filter("split IS NOT NULL").select("file_ord", "line_ord", "id", "split")
    if records is not None:
        rows = rows.unionByName(records.filter("split IS NOT NULL").select("file_ord", "line_ord", "id", "split"))
    return rows.groupBy("id").agg(F.max(F.struct("file_ord", "line_ord", "split")).getField("split").alias("split"))


def _split_rows(lines: DataFrame) -> DataFrame:
    t = F.trim("value")
    rows = lines.filter((t != "") & ~t.startswith("#")).withColumn("t", t)
    head = normalize_split_name(F.regexp_extract("t", r"^([^:]*):", 1))
    tokens = tokenize_ids(F.col("t"))
    first, last = normalize_split_name(F.get(tokens, F.lit(0))), normalize_split_name(F.element_at(tokens, -1))
    split = F.coalesce(head, first, last, infer_split_from_filename(F.col("file")))
    ids = F.when(head.isNotNull(), tokenize_ids(F.regexp_replace("t", r"^[^:]*:", ""))).when(first.isNotNull(), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).when(last.isNotNull(), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    return rows.select("file", "file_ord", "line_ord", "value", split.alias("split"), F.explode(ids).alias("id"))


def split_json_rows(documents: DataFrame) -> DataFrame:
    """``documents`` (file_ord, value: JSON text) to (file_ord, line_ord, id, split): a dict of split to ids, or a list of records with split."""
    fields, items = F.from_json("value", "map<string,variant>"), F.from_json("value", "array<variant>")
    rest = lambda v: F.to_json(F.map_filter(F.from_json(F.to_json(v), "map<string,variant>"), lambda k, _: k != "split"))
    record = lambda v: F.struct(F.get_json_object(F.to_json(v), "$.split").alias("s"), rest(v).alias("v"))
    entry = lambda e: F.struct(e["key"].alias("s"), F.to_json(e["value"]).alias("v"))
    both = F.when(F.trim("value").startswith("["), F.transform(items, record)).otherwise(F.transform(F.map_entries(fields), entry))
    each = documents.select("file_ord", F.posexplode(both).alias("line_ord", "r"))
    ids = with_ids(each.select("file_ord", "line_ord", "r.s", "r.v"), "v")
    return ids.select("file_ord", "line_ord", F.explode("ids").alias("id"), normalize_split_name(F.col("s")).alias("split"))


def split_line_errors(lines: DataFrame) -> DataFrame:
    """Lines for which no split can be told."""
    return _split_rows(lines).filter("split IS NULL").select("file", "line_ord", "value").distinct()


def assign_split(items: DataFrame, assignments: DataFrame, default: str = "train") -> DataFrame:
    """``items`` (id) with split and reason; what isn't train, val or test is rejected."""
    out = items.join(assignments.select("id", F.col("split").alias("_s")), "id", "left").withColumn("split", F.coalesce("_s", F.lit(default))).drop("_s")
    return out.withColumn("reason", F.when(~F.col("split").isin(*sorted(set(SPLITS.values()))), F.concat(F.lit("unknown split: "), "split")))


#: Rows of a bucket of digests, about, when ranks are counted.
BUCKET_ROWS = 200_000


def exact_ratio_split(rows: DataFrame, key: str, val: float, test: float, seed: int = 42, digits: int | None = None) -> DataFrame:
    """Rows with split: exactly int(n * test) and int(n * val) keys, the rest train, in the order of md5(seed:key).

    A row's global rank is its rank among the rows whose digests begin with the same
    ``digits`` digits, after the counts of the beginnings before. There are as many
    beginnings as keep each to about ``BUCKET_ROWS`` rows, so parallelism grows with the
    table. Their counts are summed in two levels, by the first half of the digits and then
    inside each: no task sees all of them, and none is broadcast.
    """
    if val < 0 or test < 0 or val + test >= 1:
        raise ValueError("ratios must not be negative and must leave rows for train")
    if digits is None:
        digits = 2
        many = rows.count()
        while digits < 16 and many >> (4 * digits) > BUCKET_ROWS:
            digits += 2
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    own = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, digits))
    sizes = own.groupBy("_b").agg(F.count("*").alias("c")).withColumn("_first", F.substring("_b", 1, digits // 2))
    inner = F.sum("c").over(Window.partitionBy("_first").orderBy("_b")) - F.col("c")
    # one row for each first half: the square root of the number of beginnings
    outer = sizes.groupBy("_first").agg(F.sum("c").alias("_all"))
    everything = Window.partitionBy(F.lit(1))
    before = F.sum("_all").over(everything.orderBy("_first")) - F.col("_all")
    n = F.sum("_all").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    outer = outer.select("_first", before.alias("_before"), n.alias("_n"))
    starts = sizes.withColumn("_inner", inner).join(outer, "_first").select("_b", (F.col("_before") + F.col("_inner")).alias("_start"), "_n")
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1 + F.col("_start")
    put = own.join(starts, "_b").withColumn("_rank", rank)
    tests, vals = F.floor(F.col("_n") * test), F.floor(F.col("_n") * val)
    split = F.when(F.col("_rank") >= F.col("_n") - tests, "test").when(F.col("_rank") >= F.col("_n") - tests - vals, "val").otherwise("train")
    return put.withColumn("split", split).drop("_h", "_b", "_start", "_n", "_rank")


def group_split(rows: DataFrame, group: str, val: float, test: float, seed: int = 42) -> DataFrame:
    """Whole groups go to one split; the ratios hold for the number of groups."""
    return rows.join(exact_ratio_split(rows.select(group).distinct(), group, val, test, seed), group)


def limit_per_group(rows: DataFrame, group: str, order: str, k: int, valid: Column | None = None) -> DataFrame:
    """The first k valid rows of each group (0: all); rows that are not valid take no place."""
    own = rows if valid is None else rows.filter(valid)
    if k <= 0:
        return own
    return own.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("_r") <= k).drop("_r")


def pair_quality(pixels: DataFrame) -> DataFrame:
    """``pixels`` (image_id, v) to one row for each mask: how binary and how white it is."""
    n = F.count("*")
    grey = F.count_if((F.col("v") > 5) & (F.col("v") < 250))
    seen = F.collect_set("v")  # 256 values at most
    out = pixels.groupBy("image_id").agg(F.bool_and(F.col("v").isin(0, 255)).alias("exact_binary"), F.round(1 - grey / n, 4).alias("binary_like_ratio"), F.round(F.count_if(F.col("v") > 127) / n, 4).alias("white_ratio"), F.size(seen).alias("unique_value_count"), F.slice(F.sort_array(seen), 1, 10).alias("unique_values_preview"))
    return out.withColumn("binary_like", F.col("binary_like_ratio") >= 0.99)


def pair_shapes(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(image_id, image_shape, mask_shape, same_size) of two dense pixel tables (image_id, y, x); shapes are (height, width)."""
    shape = lambda df, name: df.groupBy("image_id").agg(F.array((F.max("y") + 1).cast("int"), (F.max("x") + 1).cast("int")).alias(name))
    return shape(images, "image_shape").join(shape(masks, "mask_shape"), "image_id").withColumn("same_size", F.col("image_shape") == F.col("mask_shape"))


SUSPICIOUS = "NOT binary_like OR white_ratio <= 0.001 OR white_ratio >= 0.999"


def audited(images: DataFrame, masks: DataFrame, quality: DataFrame) -> DataFrame:
    """Pairs and single files (stem, image, mask, side) with the quality of their pair; a pair without one is unreadable.

    ``quality`` has stem, exact_binary, binary_like, white_ratio, same_size.
    """
    pairs = match_pairs(images, masks)
    own = quality.select("stem", "exact_binary", "binary_like", "white_ratio", "same_size", F.lit(True).alias("read"))
    return pairs.join(own, "stem", "left").withColumn("unreadable", (F.col("side") == "pair") & F.col("read").isNull()).drop("read")


def audit_dataset(images: DataFrame, masks: DataFrame, quality: DataFrame) -> DataFrame:
    """One row of eleven counts over a paired collection."""
    pair = F.col("side") == "pair"
    of = lambda c: F.count_if(pair & ~F.col("unreadable") & c)
    counts = audited(images, masks, quality).agg(
        F.count_if(pair).alias("pairs"),
        F.count_if(F.col("side") == "image_only").alias("image_only"),
        F.count_if(F.col("side") == "mask_only").alias("mask_only"),
        of(F.lit(True)).alias("inspected"),
        F.count_if("unreadable").alias("unreadable"),
        of(F.col("exact_binary")).alias("exact_binary"),
        of(F.col("binary_like")).alias("binary_like"),
        of(F.col("same_size")).alias("same_size"),
        of(F.expr(SUSPICIOUS)).alias("suspicious"),
    )
    files = images.agg(F.count("*").alias("image_files")).crossJoin(masks.agg(F.count("*").alias("mask_files")))
    return files.crossJoin(counts)  # one row each


def audit_examples(images: DataFrame, masks: DataFrame, quality: DataFrame, k: int = 10) -> DataFrame:
    """(kind, stem): the first k stems of what an audit counts as single, suspicious or unreadable."""
    own = audited(images, masks, quality)
    rules = {"image_only": "side = 'image_only'", "mask_only": "side = 'mask_only'", "suspicious": f"side = 'pair' AND NOT unreadable AND ({SUSPICIOUS})", "unreadable": "unreadable"}
    out = None
    for kind, rule in rules.items():
        first = own.filter(rule).select(F.lit(kind).alias("kind"), "stem").orderBy("stem").limit(k)
        out = first if out is None else out.union(first)
    return out


def unreadable_pairs(images: DataFrame, masks: DataFrame, quality: DataFrame) -> DataFrame:
    """Quarantine: pairs of which no quality could be told."""
    return audited(images, masks, quality).filter("unreadable").select("stem", "image", "mask")


def readiness(audit: DataFrame, checkpoint: bool = False) -> DataFrame:
    """What a collection is ready for, and the next step: pairs, then clean masks, then a checkpoint."""
    ready = F.col("pairs") > 0
    clean = F.col("binary_like") == F.col("pairs")
    step = F.when(~ready, "add pairs").when(F.col("binary_like") < F.col("pairs"), "clean masks").when(F.lit(not checkpoint), "train").otherwise("infer")
    return audit.select(ready.alias("training_ready"), (ready & clean & (F.col("unreadable") == 0)).alias("quality_ready"), F.lit(checkpoint).alias("inference_ready"), step.alias("next_step"))


def prepare_dataset(sketches: DataFrame, keys: DataFrame, assignments: DataFrame, k: int) -> DataFrame:
    """Prefix matches, quota for each key, split: (stem, key, split, reason)."""
    met = match_longest_prefix(sketches, keys).filter("key IS NOT NULL")
    few = limit_per_group(met, "key", "stem", k)
    return assign_split(few.withColumn("id", F.col("stem")), assignments).drop("id")


def curation_pipeline(images: DataFrame, masks: DataFrame, new_images: DataFrame, new_masks: DataFrame, quality: DataFrame, fill: bool = False, val: float = 0.1, test: float = 0.1, prefix: str = "logo") -> DataFrame:
    """Import, mask fill, audit and split in one summary row.

    New files are matched by tiers and join the collection under their new names; with
    ``fill`` every image that has no mask gets a draft one, which counts as not read yet.
    """
    plan = import_plan(new_images, new_masks, images.select(F.col("path").alias("dest")), prefix)
    done = plan.agg(*(F.count_if(F.col("action") == a).alias(f"import_{a}") for a in ("copied", "skipped_existing", "failed")))
    copied = plan.filter("action = 'copied'").select(F.regexp_extract("dest", r"([^/]+)\.[^./]+$", 1).alias("stem"), "dest", F.col("mask"))
    images = images.select("stem", "path").union(copied.select("stem", "dest"))
    masks = masks.select("stem", "path").union(copied.select("stem", F.concat(F.lit("masks/"), "stem", F.lit(".png"))))
    draft = missing_counterparts(images, masks, "masks").select("stem", F.col("expected").alias("path"))
    filled = draft.filter(F.lit(fill))
    masks = masks.union(filled)
    split = exact_ratio_split(match_pairs(images, masks).filter("side = 'pair'").select("stem"), "stem", val, test)
    counts = split.agg(*(F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")))
    return done.crossJoin(filled.agg(F.count("*").alias("filled"))).crossJoin(audit_dataset(images, masks, quality)).crossJoin(counts)  # one row each
