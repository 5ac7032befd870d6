"""Sorted listings with a checked sort column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing(df: DataFrame, sort_by: str, direction: str, limit: int, allowed: dict[str, str], tie: str) -> DataFrame:
    """One page of 1 to 50 rows, sorted by an allowed column; ``tie`` makes the order total."""
    if sort_by not in allowed or direction not in ("asc", "desc"):
        raise ValueError("unknown sort column or direction")
    if not 1 <= limit <= 50:
        raise ValueError("limit must be within 1..50")
    key = F.col(allowed[sort_by])
    return df.orderBy(key.asc() if direction == "asc" else key.desc(), F.asc(tie)).limit(limit)
