"""SQL surface: scalar functions as session SQL functions, table functions as Python calls over views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webfacts.operators import aggregates, search

SCALARS = {
    "quality_grade(score DOUBLE) RETURNS STRING": "CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END",
    "rrf_weight(rank BIGINT) RETURNS DOUBLE": "1D / (60 + rank)",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)",
    "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "coalesce(try_divide(vector_dot(a, b), sqrt(vector_dot(a, a) * vector_dot(b, b))), 0D)",
}


def register(spark: SparkSession) -> None:
    """Make the scalar functions callable from SQL in this session."""
    for signature, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def find_similar(spark: SparkSession, view: str, query: list[float], id_col: str, k: int = 10, min_similarity: float | None = None, where: str | None = None) -> DataFrame:
    """Nearest rows of a registered view (narratives, benchmarks, patterns)."""
    cond = F.expr(where) if where else None
    return search.knn(spark.table(view), query, k, id_col, where=cond, min_similarity=min_similarity)


def quality_percentile(spark: SparkSession, view: str, score: str, value: float, where: str | None = None) -> DataFrame:
    rows = spark.table(view)
    return aggregates.score_percentile(rows.filter(where) if where else rows, score, value)


def industry_averages(spark: SparkSession, view: str, industry: str, score: str, min_count: int = 10) -> DataFrame:
    return aggregates.industry_averages(spark.table(view), industry, score, min_count)
