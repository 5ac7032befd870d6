"""Score columns: grades, clamping, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfacts.functions.base import ColumnOrName, band, clamp, col, round_half_up


def grade(score: ColumnOrName) -> Column:
    return band(col(score), [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def clamp_score(x: ColumnOrName, digits: int = 2) -> Column:
    """Round half up, keep within 0..100."""
    return clamp(round_half_up(col(x), digits), 0, 100)


def similarity_level(sim: ColumnOrName) -> Column:
    s = col(sim)
    return F.when(s > 0.85, "high").when(s >= 0.7, "medium").otherwise("low")
