"""Boxes: STRUCT<x1,y1,x2,y2: DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.numbers import half_even

# Names of the nine fields of an image, by row and column.
POSITIONS = [["左上", "上方", "右上"], ["左侧", "中间", "右侧"], ["左下", "下方", "右下"]]


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corners in order; null if one is no number or the box has no area."""
    x1, y1, x2, y2 = (c.try_cast("double") for c in (x1, y1, x2, y2))
    a, b, c, d = F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)
    good = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull() & (a < c) & (b < d)
    return F.when(good, F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))


def is_percent(b: Column) -> Column:
    return b.isNotNull() & F.forall(F.array(b["x1"], b["y1"], b["x2"], b["y2"]), lambda v: v.between(0, 100))


def to_pixels(b: Column, width: Column, height: Column, source: str = "auto") -> Column:
    """A box in whole pixels inside its image, one pixel at least each way. Source auto takes a box for
    percent if all its corners are in 0..100 and the image is larger than 100 (F11)."""
    percent = {"percent": F.lit(True), "pixels": F.lit(False)}.get(source, (F.greatest(width, height) > 100) & is_percent(b))
    scaled = {k: half_even(F.when(percent, side * b[k] / 100.0).otherwise(b[k]), 0).cast("int") for k, side in (("x1", width), ("y1", height), ("x2", width), ("y2", height))}
    left = F.greatest(F.lit(0), F.least(scaled["x1"], F.greatest(width - 1, F.lit(0))))
    top = F.greatest(F.lit(0), F.least(scaled["y1"], F.greatest(height - 1, F.lit(0))))
    right, bottom = F.greatest(left + 1, F.least(scaled["x2"], width)), F.greatest(top + 1, F.least(scaled["y2"], height))
    return F.when(b.isNotNull(), F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2")))


def position(b: Column, width: Column, height: Column, source: str = "auto", names: list[list[str]] = POSITIONS) -> Column:
    """Name of the field, by thirds, that a box's centre is in; empty without a box or an image."""
    p = to_pixels(b, width, height, source)
    third = lambda low, high, side: F.when((low + high) / 2.0 / side < 1 / 3, 0).when((low + high) / 2.0 / side > 2 / 3, 2).otherwise(1)
    grid = F.array(*(F.lit(x) for row in names for x in row))
    at = third(p["y1"], p["y2"], height) * 3 + third(p["x1"], p["x2"], width)
    return F.when(p.isNull() | (width <= 0) | (height <= 0), F.lit("")).otherwise(F.get(grid, at))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for null boxes and those without area."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(a.isNull() | b.isNull() | (union <= 0), F.lit(0.0)).otherwise(w * h / union)


def padded(b: Column, width: Column, height: Column, share: float = 0.08, least: int = 8) -> Column:
    """A crop with 8 % or 8 pixels more on each side, inside the image."""
    px = F.greatest((b["x2"] - b["x1"]) * share, F.lit(float(least)))
    py = F.greatest((b["y2"] - b["y1"]) * share, F.lit(float(least)))
    return F.when(b.isNotNull(), F.struct(
        F.greatest(b["x1"] - px, F.lit(0.0)).alias("x1"), F.greatest(b["y1"] - py, F.lit(0.0)).alias("y1"),
        F.least(b["x2"] + px, width.cast("double")).alias("x2"), F.least(b["y2"] + py, height.cast("double")).alias("y2"),
    ))


def large_enough(b: Column, edge: float = 24.0) -> Column:
    """P22."""
    return b.isNotNull() & (b["x2"] - b["x1"] >= edge) & (b["y2"] - b["y1"] >= edge)


def centre_distance(b: Column, width: Column, height: Column) -> Column:
    """Distance of the centres of box and frame as a share of half the frame's diagonal."""
    dx, dy = (b["x1"] + b["x2"]) / 2 - width / 2, (b["y1"] + b["y2"]) / 2 - height / 2
    return F.sqrt(dx * dx + dy * dy) / F.greatest(F.sqrt(width * width + height * height) / 2, F.lit(1e-6))


def completeness(area_ratio: Column, centre: Column, edge: Column, threshold: float = 0.15) -> Column:
    """How much of a tray a frame shows: area .25, centre .35, no cut edges .40."""
    one = F.lit(1.0)
    return F.least(one, area_ratio / max(threshold, 1e-6)) * 0.25 + (1 - F.least(one, centre)) * 0.35 + (1 - F.least(one, edge * 2)) * 0.40
