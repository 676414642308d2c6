"""From polylines to commands, for many drawings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import order_paths
from ..operators.strokes import MIN_LENGTH, MIN_SEGMENT, TOLERANCE, clean_paths, emit_commands, fit_to_page, plan_metrics, stitch_paths


def planned(paths: DataFrame, width: float, height: float, method: str = "nearest_neighbor", start: tuple[float, float] = (0.0, 0.0), min_length: float = MIN_LENGTH, min_segment: float = MIN_SEGMENT, tolerance: float = TOLERANCE) -> DataFrame:
    """Scaled to the page, cleaned, ordered and stitched strokes (drawing_id, path_id, points)."""
    clean = clean_paths(fit_to_page(paths, width, height), min_length, min_segment, tolerance)
    ordered = order_paths(clean, method, start).select("drawing_id", F.col("pos").alias("path_id"), "points")
    return stitch_paths(ordered, max(min_segment, tolerance))


def run_drawing_pipeline(paths: DataFrame, width: float, height: float, method: str = "nearest_neighbor", start: tuple[float, float] = (0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """(metrics, commands) of each drawing."""
    strokes = planned(paths, width, height, method, start)
    return plan_metrics(strokes, *start), emit_commands(strokes, start_x=start[0], start_y=start[1])
