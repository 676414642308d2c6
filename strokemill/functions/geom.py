"""Column functions of the plane: x to the right, y down, millimetres; heading 90 is up the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dist(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def dist_points(a: Column, b: Column) -> Column:
    return dist(a["x"], a["y"], b["x"], b["y"])


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance to the nearest point of the segment; to its point if it has no length."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(square, F.lit(0.0))))
    return F.when(square == 0, dist(px, py, ax, ay)).otherwise(dist(px, py, ax + t * dx, ay + t * dy))


def page_fit(width: Column, height: Column, paper_w: float, paper_h: float, margin: float = 10.0):
    """(scale, offset x, offset y) that centre an image on a page inside its margins."""
    inner_w, inner_h = max(1.0, paper_w - 2 * margin), max(1.0, paper_h - 2 * margin)
    scale = F.least(F.lit(inner_w) / width, F.lit(inner_h) / height)
    return scale, F.lit(margin) + (inner_w - width * scale) / 2, F.lit(margin) + (inner_h - height * scale) / 2


def heading_deg(ax, ay, bx, by) -> Column:
    return F.degrees(F.atan2(ay - by, bx - ax))


def normalize_angle(a: Column) -> Column:
    """Into (-180, 180]."""
    return F.lit(180.0) - F.pmod(F.lit(180.0) - a, F.lit(360.0))


def offset_at_heading(forward: Column, lateral: Column, heading: Column) -> tuple[Column, Column]:
    """A local offset (forward, to the right) in page coordinates."""
    r = F.radians(heading)
    return forward * F.cos(r) + lateral * F.sin(r), -(forward * F.sin(r)) + lateral * F.cos(r)


def center_for_tip(x, y, heading, forward, lateral) -> tuple[Column, Column]:
    ox, oy = offset_at_heading(forward, lateral, heading)
    return x - ox, y - oy


def advance(x, y, heading, length) -> tuple[Column, Column]:
    r = F.radians(heading)
    return x + length * F.cos(r), y - length * F.sin(r)


def clamp_min_distance(d: Column, min_move: float, min_units: float, mm_per_unit: float) -> Column:
    return F.greatest(d, F.lit(max(min_move, min_units * mm_per_unit)))


def start_pose(x: Column, y: Column, heading: Column, width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Given start values, else the middle of the page, 200 mm above its lower edge, heading up."""
    return F.coalesce(x, width / 2), F.coalesce(y, F.greatest(F.lit(0.0), height - 200)), F.coalesce(heading, F.lit(90.0))


def settings_profile(length: Column, segment: Column, tolerance: Column) -> Column:
    same = (F.abs(length - 2.0) <= 1e-9) & (F.abs(segment - 0.75) <= 1e-9) & (F.abs(tolerance - 0.5) <= 1e-9)
    return F.when(same, "default").otherwise("manual")


def fit_canvas(w: Column, h: Column, target_w: int, target_h: int):
    """(width, height, pad left, pad top) of an image on a canvas; sizes round half to even."""
    scale = F.least(F.lit(float(target_w)) / w, F.lit(float(target_h)) / h)
    new_w = F.greatest(F.lit(1), F.bround(w * scale, 0).cast("int"))
    new_h = F.greatest(F.lit(1), F.bround(h * scale, 0).cast("int"))
    return new_w, new_h, F.floor((target_w - new_w) / 2).cast("int"), F.floor((target_h - new_h) / 2).cast("int")


def color_region_predicate(b, g, r) -> Column:
    """Coloured enough (saturation 18 of 255) and far enough from white (20)."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    saturation = F.when(top == 0, 0.0).otherwise((top - low) * 255.0 / top)
    white = F.sqrt((255 - b) * (255 - b) + (255 - g) * (255 - g) + (255 - r) * (255 - r))
    return (F.bround(saturation, 0) >= 18) & (white >= 20)


def alpha_composite(fg: Column, bg: Column, alpha: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), fg * alpha + bg * (1 - alpha))).cast("int")


def probability_mask(logit: Column, threshold: float = 0.5) -> Column:
    return 1 / (1 + F.exp(-logit)) >= threshold
