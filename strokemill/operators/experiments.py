"""Experiment sweeps: run matrix, averages, comparisons of variants, highlights, histories, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_matrix(images: DataFrame, modes: list[str] | None = None, orderings: list[str] | None = None, checkpoint: bool = False) -> DataFrame:
    """Images x modes x orderings; without modes: classical, and ml if a checkpoint is given."""
    modes = modes or (["classical", "ml"] if checkpoint else ["classical"])
    orderings = orderings or ["nearest_neighbor", "two_opt"]
    each = F.explode(F.array(*map(F.lit, modes))).alias("vision_mode")
    return images.select("*", each).select("*", F.explode(F.array(*map(F.lit, orderings))).alias("path_ordering"))


def attach_truth(images: DataFrame, masks: DataFrame, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")) -> DataFrame:
    """Left join on stem; of several masks the first suffix of the list wins, then the smaller path."""
    rank = F.array_position(F.array(*map(F.lit, suffixes)), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    best = masks.filter(rank > 0).groupBy("stem").agg(F.min_by("path", F.struct(rank, "path")).alias("mask_path"))
    return images.join(best, "stem", "left")


def mean(c: str, places: int) -> Column:
    """The mean of ``c``, rounded. Values are summed as whole millionths, so a mean that lies
    on a half doesn't hang on the order of the rows."""
    total = F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    return F.round(total / F.count(c), places)


def variant_aggregates(runs: DataFrame) -> DataFrame:
    """(vision_mode, path_ordering): how many runs, and the means of their figures."""
    return runs.groupBy("vision_mode", "path_ordering").agg(
        F.count("*").alias("runs"),
        mean("num_paths", 2).alias("avg_paths"),
        mean("num_commands", 2).alias("avg_commands"),
        mean("pen_up_distance_mm", 2).alias("avg_pen_up_mm"),
        mean("draw_distance_mm", 2).alias("avg_draw_mm"),
        mean("mask_dice", 4).alias("avg_dice"),
        mean("mask_iou", 4).alias("avg_iou"),
    )


def run_metrics(runs: DataFrame, plans: DataFrame, cleanup: DataFrame, commands: DataFrame, overlap: DataFrame | None = None) -> DataFrame:
    """One row for each of ``runs`` (run_id, drawing_id, ...): its columns, and what was measured, rounded.

    ``plans`` (run_id, num_paths, pen_up_mm, draw_mm, total_mm) and ``commands`` (run_id, ...)
    belong to the run, ``cleanup`` (drawing_id, input_points, output_points) and ``overlap``
    (drawing_id, precision, recall, dice, iou) to its drawing. A run without a plan has 0
    paths and no ways; without a reference mask the four scores are null.
    """
    many = commands.groupBy("run_id").agg(F.count("*").alias("num_commands"))
    out = runs.join(plans, "run_id", "left").join(many, "run_id", "left").join(cleanup, "drawing_id", "left")
    scores = ["precision", "recall", "dice", "iou"]
    out = out.join(overlap.select("drawing_id", *scores), "drawing_id", "left") if overlap is not None else out.select("*", *(F.lit(None).cast("double").alias(c) for c in scores))
    return out.select(
        *runs.columns,
        *(F.round(c, 4).alias(f"mask_{c}") for c in scores),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("num_paths", "num_commands")),
        F.coalesce("input_points", F.lit(0)).cast("bigint").alias("cleanup_input_points"),
        F.coalesce("output_points", F.lit(0)).cast("bigint").alias("cleanup_output_points"),
        *(F.round(c, 2).alias(name) for c, name in (("draw_mm", "draw_distance_mm"), ("pen_up_mm", "pen_up_distance_mm"), ("total_mm", "total_distance_mm"))),
    )


def percent(saved: Column, base: Column) -> Column:
    return F.when(base == 0, F.lit(0.0)).otherwise(F.round(saved / base * 100, 2))


def last_of(runs: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for each key; with ``order`` the last, else keys are taken to be unique."""
    if order is None:
        return runs
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return runs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def effective(runs: DataFrame) -> DataFrame:
    """``runs`` with effective_vision_mode (where unknown: the mode itself) and fallback_reason (trimmed, empty: null)."""
    have = runs.columns
    mode = F.coalesce("effective_vision_mode", "vision_mode") if "effective_vision_mode" in have else F.col("vision_mode")
    reason = F.trim("fallback_reason") if "fallback_reason" in have else F.lit(None).cast("string")
    return runs.withColumn("effective_vision_mode", mode).withColumn("fallback_reason", F.when(reason != "", reason))


def planning_comparison(runs: DataFrame, base: str = "nearest_neighbor", improved: str = "two_opt", order: str | None = None) -> DataFrame:
    """(image, vision_mode): pen-up way saved by the better ordering, where both were run; the mode in effect and a note on fallbacks."""
    runs = effective(last_of(runs, ["image", "vision_mode", "path_ordering"], order))
    side = lambda v, c: F.max(F.when(F.col("path_ordering") == v, F.col(c)))
    compared = F.col("path_ordering").isin(base, improved)
    both = runs.groupBy("image", "vision_mode").agg(
        side(base, "pen_up_distance_mm").alias("base_mm"),
        side(improved, "pen_up_distance_mm").alias("improved_mm"),
        *(side(v, c).alias(f"{name}_{short}") for v, name in ((base, "base"), (improved, "improved")) for c, short in (("num_commands", "commands"), ("num_paths", "paths"))),
        side(base, "effective_vision_mode").alias("base_mode"),
        side(improved, "effective_vision_mode").alias("improved_mode"),
        F.array_join(F.sort_array(F.collect_set(F.when(compared, F.col("fallback_reason")))), ", ").alias("reasons"),
    )
    both = both.filter("base_mm IS NOT NULL AND improved_mm IS NOT NULL")
    saved = F.col("base_mm") - F.col("improved_mm")
    mode = F.when(F.col("base_mode") == F.col("improved_mode"), F.col("base_mode")).otherwise("mixed")
    fell = (F.col("vision_mode") == "ml") & ((F.col("base_mode") != "ml") | (F.col("improved_mode") != "ml"))
    note = F.when(fell, F.concat(F.lit("ran as "), "base_mode", F.lit(" and "), "improved_mode", F.when(F.col("reasons") != "", F.concat(F.lit(": "), "reasons")).otherwise("")))
    sides = [f"{name}_{c}" for c in ("commands", "paths", "mode") for name in ("base", "improved")]
    return both.select("image", "vision_mode", "base_mm", "improved_mm", *sides, F.round(saved, 2).alias("saved_mm"), percent(saved, F.col("base_mm")).alias("saved_pct"), mode.alias("effective_mode"), note.alias("note"))


def vision_comparison(runs: DataFrame, base: str = "classical", other: str = "ml", order: str | None = None) -> DataFrame:
    """(image, path_ordering): other minus base; a dice delta is null if either is; a note where a run was not of its mode."""
    runs = effective(last_of(runs, ["image", "vision_mode", "path_ordering"], order))
    cols = ["num_commands", "pen_up_distance_mm", "mask_dice", "effective_vision_mode", "fallback_reason"]
    a, b = (runs.filter(F.col("vision_mode") == m).select("image", "path_ordering", *(F.col(c).alias(f"{p}_{c}") for c in cols)) for m, p in ((base, "a"), (other, "b")))
    delta = lambda c, n: F.round(F.col(f"b_{c}") - F.col(f"a_{c}"), n)
    said = lambda p, m, why: F.when(F.col(f"{p}_effective_vision_mode") != m, F.concat(F.lit(f"{m} ran as "), f"{p}_effective_vision_mode", why))
    why = F.coalesce(F.concat(F.lit(": "), "b_fallback_reason"), F.lit(""))
    note = F.concat_ws("; ", said("a", base, F.lit("")), said("b", other, why))
    return a.join(b, ["image", "path_ordering"]).select("image", "path_ordering", delta("mask_dice", 4).alias("dice_delta"), (F.col("b_num_commands") - F.col("a_num_commands")).alias("commands_delta"), delta("pen_up_distance_mm", 2).alias("pen_up_delta_mm"), F.when(note != "", note).alias("note"))


def experiment_totals(runs: DataFrame) -> DataFrame:
    per_image = runs.groupBy("image").agg(F.count("*").alias("n"))
    return per_image.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("run_count"), F.count("*").alias("image_count"))


def planning_table(runs: DataFrame, comparison: DataFrame) -> DataFrame:
    """Runs with the saving of their image and mode, and what it says; sort by (lower(image), mode, ordering) to show."""
    out = runs.select("image", "vision_mode", "path_ordering", "num_paths", "num_commands", "pen_up_distance_mm").join(comparison.select("image", "vision_mode", "saved_pct"), ["image", "vision_mode"], "left")
    said = F.when(F.col("saved_pct").isNull(), "no comparison").when(F.col("saved_pct") > 0, "improved").when(F.col("saved_pct") == 0, "same").otherwise("worse")
    return out.withColumn("observation", said)


def perception_table(runs: DataFrame, comparison: DataFrame, ordering: str = "two_opt") -> DataFrame:
    """Runs of one ordering, or all runs if there is none, with the dice delta and what it says."""
    any_ = runs.agg(F.coalesce(F.max((F.col("path_ordering") == ordering).cast("int")), F.lit(0)).alias("any"))
    chosen = runs.crossJoin(F.broadcast(any_)).filter((F.col("any") == 0) | (F.col("path_ordering") == ordering))  # one row
    out = chosen.select("image", "vision_mode", "path_ordering", "num_commands", "mask_dice").join(comparison.select("image", "path_ordering", "dice_delta"), ["image", "path_ordering"], "left")
    said = F.when(F.col("mask_dice").isNull(), "no truth").when(F.col("dice_delta").isNull(), "single mode").when(F.col("dice_delta") > 0, "ml better").otherwise("classical better or equal")
    return out.withColumn("observation", said)


def highlights(runs: DataFrame, vision: DataFrame, planning: DataFrame) -> DataFrame:
    """One row: least pen-up, best dice, best dice delta, first and best planning; ties go to the first key."""
    key = F.struct("image", "vision_mode", "path_ordering")
    name = F.concat_ws("/", "image", "vision_mode", "path_ordering")
    a = runs.agg(F.min(F.struct("pen_up_distance_mm", key.alias("k"), name.alias("n"))).getField("n").alias("least_pen_up"), F.min(F.when(F.col("mask_dice").isNotNull(), F.struct((-F.col("mask_dice")).alias("d"), key.alias("k"), name.alias("n")))).getField("n").alias("best_dice"))
    b = vision.agg(F.min(F.when(F.col("dice_delta").isNotNull(), F.struct((-F.col("dice_delta")).alias("d"), "image", "path_ordering"))).getField("image").alias("best_dice_delta"))
    c = planning.agg(F.min(F.struct("image", "vision_mode")).getField("image").alias("first_planning"), F.min(F.struct((-F.col("saved_mm")).alias("s"), "image", "vision_mode")).getField("image").alias("best_planning"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def variant_delta(runs: DataFrame, column: str, raw: str, default: str, measure: str = "num_commands") -> DataFrame:
    """For each image: measure of the raw and the default variant, what was saved, and percent (0 if raw is 0)."""
    side = lambda v: F.sum(F.when(F.col(column) == v, F.col(measure)))
    both = runs.groupBy("image").agg(side(raw).alias("raw"), side(default).alias("cleaned")).filter("raw IS NOT NULL AND cleaned IS NOT NULL")
    return both.withColumn("saved", F.col("raw") - F.col("cleaned")).withColumn("saved_pct", percent(F.col("raw") - F.col("cleaned"), F.col("raw")))


def calibration(observations: DataFrame, mm_per_unit: float = 10.0, turn_scale: float = 1.0) -> DataFrame:
    """For each device: corrected mm per unit and turn scale from sums of pairs above zero."""
    good = observations.filter("commanded > 0 AND measured > 0")
    return good.groupBy("device").agg(F.count("*").alias("n"), (mm_per_unit * F.sum("measured") / F.sum("commanded")).alias("mm_per_unit"), (turn_scale * F.sum("commanded") / F.sum("measured")).alias("turn_scale"))


def epoch_losses(steps: DataFrame) -> DataFrame:
    """(run_id, epoch, train_loss, val_loss): means over the steps of each phase.

    ``steps`` has run_id, epoch, phase (train or val) and loss. An epoch without steps of a
    phase has the train loss 0 and no val loss.
    """
    of = lambda phase: F.when(F.col("phase") == phase, F.col("loss")).cast("decimal(28,6)")
    part = lambda phase: F.sum(of(phase)).cast("double") / F.nullif(F.count(of(phase)), F.lit(0))
    return steps.groupBy("run_id", "epoch").agg(F.coalesce(part("train"), F.lit(0.0)).alias("train_loss"), part("val").alias("val_loss"))


def training_history(histories: DataFrame) -> DataFrame:
    """Epochs with is_best: val loss (or train loss) below that of every earlier epoch."""
    val = F.coalesce("val_loss", "train_loss")
    before = F.min(val).over(Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return histories.withColumn("is_best", before.isNull() | (val < before))


def run_summary(histories: DataFrame, wanted_epochs: int) -> DataFrame:
    h = training_history(histories)
    out = h.groupBy("run_id").agg(F.count("*").alias("epochs"), F.round(F.max_by("train_loss", "epoch"), 6).alias("last_train_loss"), F.round(F.max_by(F.coalesce("val_loss", "train_loss"), "epoch"), 6).alias("last_val_loss"), F.max(F.when(F.col("is_best"), F.col("epoch"))).alias("best_epoch"), F.round(F.min(F.coalesce("val_loss", "train_loss")), 6).alias("best_val_loss"))
    return out.withColumn("progress_pct", F.round(F.col("epochs") / wanted_epochs * 100, 2)).withColumn("status", F.when(F.col("epochs") >= wanted_epochs, "completed").otherwise("running"))


def latest_run(runs: DataFrame, group: str, run: str, modified: str) -> DataFrame:
    return runs.groupBy(group).agg(F.max(F.struct(modified, run)).getField(run).alias("latest"))


def recommended_artifact(artifacts: DataFrame, preferred: list[str]) -> DataFrame:
    """One row: the first preferred name that is there, else the newest, else empty."""
    rank = F.array_position(F.array(*map(F.lit, preferred)), F.col("name"))
    best = artifacts.agg(F.min(F.when(rank > 0, F.struct(rank.alias("r"), "name"))).getField("name").alias("a"), F.max(F.struct("modified", "name")).getField("name").alias("b"))
    return best.select(F.coalesce("a", "b", F.lit("")).alias("name"))


COMMAND_ORDER = ("START", "PEN_UP", "PEN_DOWN", "MOVE", "END", "PING")


def command_histogram(commands: DataFrame) -> DataFrame:
    """(session_id, summary): counts of the kinds that occur, in fixed order, as ``A=n, B=m``."""
    rank = F.array_position(F.array(*map(F.lit, COMMAND_ORDER)), F.col("cmd"))
    n = commands.filter(rank > 0).groupBy("session_id", "cmd").agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat_ws("=", "cmd", F.col("n").cast("string")).alias("t"))))
    return n.groupBy("session_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), ", ").alias("summary"))
