"""Raster masks as pixel tables (image_id, y, x, ...): components, thresholds, morphology, overlap, graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import AROUND, connected_components, skeletonize, trace_graph_paths

__all__ = ["connected_components", "skeletonize", "trace_graph_paths"]

#: Pixels of two masks that a task compares.
OVERLAP_ROWS = 4_000_000


def binarize(pixels: DataFrame, threshold: int = 245, mode: str = "auto") -> DataFrame:
    """Add is_line: darker than the threshold on light paper, lighter on dark; auto goes by the mean."""
    t = max(0, min(255, threshold))
    dark, light = F.col("gray") < t, F.col("gray") > t
    if mode == "auto":
        mean = F.avg("gray").over(Window.partitionBy("image_id"))
        return pixels.withColumn("is_line", F.when(mean >= 127.5, dark).otherwise(light))
    return pixels.withColumn("is_line", dark if mode == "dark_on_light" else light)


def overlap_scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    part = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return [part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("dice"), part(tp, tp + fp + fn).alias("iou")]


def mask_overlap(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Scores of the set pixels (image_id, y, x) of each image that has any.

    Both sides are sorted by pixel, so there are as many tasks as keep one to ``OVERLAP_ROWS``.
    """
    at = ["image_id", "y", "x"]
    a, b = pred.select(*at), truth.select(*at)
    parts = -(-(a.count() + b.count()) // OVERLAP_ROWS)
    if parts > int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        a, b = a.repartition(parts, *at), b.repartition(parts, *at)
    a, b = a.withColumn("p", F.lit(1)), b.withColumn("t", F.lit(1))
    n = a.join(b, at, "full").groupBy("image_id").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return n.select("image_id", "tp", "fp", "fn", *overlap_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def component_stats(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image_id", "label").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"), F.count("*").alias("area"))


def keep(labelled: DataFrame, stats: DataFrame, rule: Column) -> DataFrame:
    return labelled.join(stats.filter(rule).select("image_id", "label"), ["image_id", "label"], "left_semi")


def drop_specks(labelled: DataFrame, stats: DataFrame, least: int = 3) -> DataFrame:
    return keep(labelled, stats, F.col("area") >= least)


def border_rule(width: int, height: int, area: float = 0.02, span: float = 0.35) -> Column:
    touches = (F.col("min_x") == 0) | (F.col("min_y") == 0) | (F.col("min_x") + F.col("width") >= width) | (F.col("min_y") + F.col("height") >= height)
    return touches & ((F.col("area") / (width * height) >= area) | (F.greatest(F.col("width") / width, F.col("height") / height) >= span))


def suppress_border_components(labelled: DataFrame, stats: DataFrame, width: int, height: int) -> DataFrame:
    return keep(labelled, stats, ~border_rule(width, height))


def structural_rule(min_area: int = 12, min_side: int = 12) -> Column:
    """Outline preset (12, 12); blob preset (40, 8)."""
    short, long = F.least("width", "height"), F.greatest("width", "height")
    return (F.col("area") >= min_area) & ((short >= min_side) | ((long >= 40) & (long / short >= 8)))


def keep_structural_components(labelled: DataFrame, stats: DataFrame, min_area: int = 12, min_side: int = 12) -> DataFrame:
    return keep(labelled, stats, structural_rule(min_area, min_side))


def image_flags(stats: DataFrame, width: int, height: int) -> DataFrame:
    """All flags of an image from one pass over its components."""
    share, extent = F.col("area") / (width * height), F.col("area") / (F.col("width") * F.col("height"))
    aspect = F.greatest("width", "height") / F.least("width", "height")
    w, h = F.col("width") / width, F.col("height") / height
    any_ = F.bool_or
    large = F.col("area") >= 60
    out = stats.groupBy("image_id").agg(any_((share >= 0.08) & (extent >= 0.75)).alias("dense"), any_((share >= 0.01) & (extent >= 0.65)).alias("dense_region"), any_((share >= 0.01) & (F.greatest(w, h) >= 0.6) & (aspect >= 6)).alias("elongated"), any_((w >= 0.65) & (h >= 0.65)).alias("large_bbox"), ((F.count_if(large) >= 6) & (F.coalesce(F.sum(F.when(large, share)), F.lit(0.0)) >= 0.08)).alias("artwork"), any_((share >= 0.018) & (extent >= 0.24)).alias("filled"))
    return out.withColumn("filled_mask", F.col("filled") & ~F.col("elongated")).drop("filled")


def choose_strategy(images: DataFrame) -> DataFrame:
    """``images`` (color_ratio, artwork, axis_coverage, elongated, dense_region) with the first rule that holds."""
    color = (F.col("color_ratio") > 0) & ((F.col("color_ratio") >= 0.025) | F.col("artwork"))
    return images.withColumn("strategy", F.when(color, "color").when(F.col("axis_coverage") >= 0.72, "axis").when(F.col("elongated"), "elongated").when(F.col("dense_region"), "dense").otherwise("outline"))


def fallback_reason(images: DataFrame) -> DataFrame:
    """``images`` (num_paths, pixel_ratio, artwork, large_bbox) with why the model's mask is not used (null: it is)."""
    few = F.col("num_paths") <= 4
    return images.withColumn("fallback_reason", F.when(F.col("num_paths") == 0, "empty").when(F.col("artwork"), "artwork").when(few & (F.col("pixel_ratio") < 0.002), "too few pixels").when(few & F.col("large_bbox"), "blob"))


def otsu_threshold(pixels: DataFrame) -> DataFrame:
    """(image_id, threshold): the least gray that parts the histogram best."""
    hist = pixels.groupBy("image_id", "gray").agg(F.count("*").alias("n"))
    w, all_ = Window.partitionBy("image_id").orderBy("gray"), Window.partitionBy("image_id")
    run = hist.withColumn("w0", F.sum("n").over(w)).withColumn("s0", F.sum(F.col("n") * F.col("gray")).over(w)).withColumn("total", F.sum("n").over(all_)).withColumn("sum", F.sum(F.col("n") * F.col("gray")).over(all_))
    d = F.col("s0") * F.col("total") - F.col("sum") * F.col("w0")
    between = d.cast("double") * d / (F.col("w0").cast("double") * (F.col("total") - F.col("w0")))
    best = run.filter("w0 < total").withColumn("between", between).groupBy("image_id").agg(F.max(F.struct("between", (-F.col("gray")).alias("g"))).getField("g").alias("g"))
    return hist.select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce(-F.col("g"), F.lit(0)).alias("threshold"))


def _slide(pixels: DataFrame, value: str, what: str, rx: int, ry: int, out: str) -> DataFrame:
    """Least or greatest value of a rectangle around each pixel; places outside don't count."""
    f = F.min if what == "erode" else F.max
    over_x = f(value).over(Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-rx, rx))
    return pixels.withColumn("_m", over_x).withColumn(out, f("_m").over(Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-ry, ry))).drop("_m")


def morphology(pixels: DataFrame, op: str, width: int = 3, height: int = 3, value: str = "gray", shape: str = "rect") -> DataFrame:
    """erode, dilate, open or close of dense pixels with a rectangle or a cross."""
    steps = {"erode": ["erode"], "dilate": ["dilate"], "open": ["erode", "dilate"], "close": ["dilate", "erode"]}[op]
    out, rx, ry = pixels.withColumn("_v", F.col(value)), width // 2, height // 2
    for s in steps:
        if shape == "rect":
            out = _slide(out, "_v", s, rx, ry, "_v2")
        else:
            out = _slide(_slide(out, "_v", s, rx, 0, "_a"), "_v", s, 0, ry, "_b").withColumn("_v2", (F.least if s == "erode" else F.greatest)("_a", "_b")).drop("_a", "_b")
        out = out.withColumn("_v", F.col("_v2")).drop("_v2")
    return out.withColumn(op, F.col("_v")).drop("_v")


def axis_coverage(pixels: DataFrame, min_area: int = 40, min_long: int = 32, length: int = 15) -> DataFrame:
    """(image_id, axis_coverage): part of the set pixels on long straight runs; ``pixels`` is dense with is_on."""
    dense = pixels.withColumn("gray", F.col("is_on").cast("int"))
    found = None
    for w, h in ((length, 3), (3, length)):
        open_ = morphology(dense, "open", w, h).filter("open = 1")
        labelled = connected_components(open_)
        stats = component_stats(labelled)
        short, long = F.least("width", "height"), F.greatest("width", "height")
        kept = keep(labelled, stats, (F.col("area") >= min_area) & (long >= min_long) & (long / short >= 5) & (F.col("area") / (F.col("width") * F.col("height")) >= 0.55)).select("image_id", "y", "x")
        found = kept if found is None else found.union(kept)
    on = pixels.groupBy("image_id").agg(F.count_if("is_on").alias("on"))
    hit = found.distinct().groupBy("image_id").agg(F.count("*").alias("hit"))
    return on.join(hit, "image_id", "left").select("image_id", F.when(F.col("on") == 0, 0.0).otherwise(F.coalesce("hit", F.lit(0)) / F.col("on")).alias("axis_coverage"))


def elongated_centerlines(labelled: DataFrame, min_area: int = 80, min_long: int = 24, aspect: float = 6.0, extent: float = 0.55) -> DataFrame:
    """(image_id, label, x0, y0, x1, y1): principal axis of each long component, between its extreme projections."""
    keys = ["image_id", "label"]
    short, long = F.least("width", "height"), F.greatest("width", "height")
    rule = (F.col("area") >= min_area) & (long >= min_long) & (long / short >= aspect) & (F.col("area") / (F.col("width") * F.col("height")) >= extent)
    own = keep(labelled, component_stats(labelled), rule)
    m = own.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    m = m.withColumn("t", 0.5 * F.atan2(2 * F.col("c"), F.col("vx") - F.col("vy")))
    p = (F.col("x") - F.col("mx")) * F.cos("t") + (F.col("y") - F.col("my")) * F.sin("t")
    e = own.join(m, keys).groupBy(*keys).agg(F.min(p).alias("lo"), F.max(p).alias("hi"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("t").alias("t"))
    at = lambda k, f, o: (F.col(o) + F.col(k) * f("t"))
    return e.select(*keys, at("lo", F.cos, "mx").alias("x0"), at("lo", F.sin, "my").alias("y0"), at("hi", F.cos, "mx").alias("x1"), at("hi", F.sin, "my").alias("y1"))


def pixel_graph(set_pixels: DataFrame) -> DataFrame:
    """(image_id, y, x, degree, is_node): 8-neighbour degree; a node is an end, a crossing (not 0, not 2)."""
    own = set_pixels.select("image_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))
    steps = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in AROUND))
    near = own.select("image_id", "y", "x", F.explode(steps).alias("s")).select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    met = near.groupBy("image_id", "y", "x").agg(F.count("*").alias("degree"))
    out = own.join(met, ["image_id", "y", "x"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))
    return out.withColumn("is_node", ~F.col("degree").isin(0, 2))


def active_crop(set_pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Bounding box of each image's set pixels, padded by max(8, 4 % of its shorter side), inside the image."""
    b = set_pixels.groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    pad = F.greatest(F.lit(8), F.floor(F.least(F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1) * 0.04).cast("int"))
    return b.select("image_id", F.greatest(F.lit(0), F.col("x0") - pad).alias("left"), F.greatest(F.lit(0), F.col("y0") - pad).alias("top"), F.least(F.lit(width), F.col("x1") + 1 + pad).alias("right"), F.least(F.lit(height), F.col("y1") + 1 + pad).alias("bottom"))


def segmentation_loss(pixels: DataFrame, eps: float = 1e-6) -> DataFrame:
    """``pixels`` (image_id, logit, target): one row with dice loss (mean of images), BCE (mean of pixels) and their mean."""
    p, t, l = 1 / (1 + F.exp(-F.col("logit"))), F.col("target"), F.col("logit")
    bce = F.greatest(l, F.lit(0.0)) - l * t + F.log1p(F.exp(-F.abs(l)))
    per = pixels.groupBy("image_id").agg((1 - (2 * F.sum(p * t) + eps) / (F.sum(p) + F.sum(t) + eps)).alias("dice"), F.sum(bce).alias("bce"), F.count("*").alias("n"))
    return per.agg(F.avg("dice").alias("dice_loss"), (F.sum("bce") / F.sum("n")).alias("bce_loss")).withColumn("combined_loss", 0.5 * F.col("dice_loss") + 0.5 * F.col("bce_loss"))


def mask_report(pred: DataFrame, truth: DataFrame, flags: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Per image: pixels of the prediction as it came (``raw``, else ``pred``) and cleaned, overlap with the reference (4 places), fallback reason and the mode in effect."""
    came = (pred if raw is None else raw).groupBy("image_id").agg(F.count("*").alias("raw_pixels"))
    o = mask_overlap(pred, truth).withColumn("clean_pixels", F.col("tp") + F.col("fp"))
    out = fallback_reason(o.join(flags.select("image_id", "artwork", "large_bbox", "num_paths", "pixel_ratio"), "image_id"))
    out = out.join(came, "image_id", "left").withColumn("raw_pixels", F.coalesce("raw_pixels", F.lit(0)).cast("bigint"))
    return out.select("image_id", "raw_pixels", "clean_pixels", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "dice", "iou")), "fallback_reason", F.when(F.col("fallback_reason").isNull(), "ml").otherwise("classical").alias("effective_mode"))
