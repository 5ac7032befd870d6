"""Shared pieces of the registered queries: table access, derived columns and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webfacts.sources.tables import load as t

__all__ = ["t", "F", "DataFrame", "SparkSession", "vector_of", "r6", "big", "HEX", "hex_of", "COS", "QVEC"]


def vector_of(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    """The query vector of a search: one row, found by key."""
    return [float(x) for x in t(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def r6(c, name: str | None = None):
    c = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return c.alias(name) if name else c


def big(c, name: str):
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name)


# A colour derived from a key, the same on both sides.
HEX = "lpad(lower(hex(({k} * 7919) % 16777216)), 6, '0')"


def hex_of(key: str):
    return F.lpad(F.lower(F.hex((F.col(key) * 7919) % 16777216)), 6, "0")


COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
QVEC = "(SELECT embedding FROM embeddings WHERE vec_id = {i})"
