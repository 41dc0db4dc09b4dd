"""Angles, sizes and budgets of pages and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SIDE = 8192
MOST_AREA = MOST_SIDE * MOST_SIDE


def normalize_rotation(angle: Column) -> Column:
    return F.pmod(angle, F.lit(360))


def pixel_budget_ok(width_pt: Column, height_pt: Column, dpi: int) -> Column:
    """Finite sides, neither too many pixels on a side nor in all, at this resolution."""
    w, h = F.ceil(width_pt * dpi / 72), F.ceil(height_pt * dpi / 72)
    sound = ~F.isnan(width_pt) & ~F.isnan(height_pt) & (width_pt > 0) & (height_pt > 0) & (width_pt < 1e9) & (height_pt < 1e9)
    return F.coalesce(F.when(sound, (w <= MOST_SIDE) & (h <= MOST_SIDE) & (w * h <= MOST_AREA)).otherwise(F.lit(False)), F.lit(False))


def size_reduction_pct(before: Column, after: Column) -> Column:
    """Percent saved, one decimal; 0 for an empty input."""
    return F.when(before > 0, F.round((1 - after / before) * 100, 1)).otherwise(F.lit(0.0))
