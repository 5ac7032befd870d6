"""Reading fact tables and the keyed write patterns built on plain files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webfacts.functions.url import normalize_url


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A fact table by name: parquet file or folder under ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row with the smallest ``order`` of each key; only key and order are aggregated, not the payload.

    A null key is a key of its own; rows that repeat key and order count once.
    """
    keep = df.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_o"))
    same = F.col(key).eqNullSafe(F.col("_k")) & F.col(order).eqNullSafe(F.col("_o"))
    return df.join(keep, same, "left_semi").dropDuplicates([key, order])


def find_or_create_pages(new: DataFrame, existing: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Existing pages plus the new ones whose normal URL is not there yet; ``created`` tells which is which."""
    known = existing.withColumn("url_norm", normalize_url(url))
    fresh = first_per_key(new.withColumn("url_norm", normalize_url(url)), "url_norm", page_id)
    added = fresh.join(known.select("url_norm"), "url_norm", "left_anti")
    return known.withColumn("created", F.lit(False)).unionByName(added.withColumn("created", F.lit(True)))


def with_status(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``status`` = success, or the name of the first failed check."""
    status = F.lit("success")
    for name, bad in reversed(list(checks.items())):
        status = F.when(bad, name).otherwise(status)
    return df.withColumn("status", status)


def batch_summary(df: DataFrame) -> DataFrame:
    ok = F.when(F.col("status") == "success", 1).otherwise(0)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(ok).alias("succeeded"),
        (F.count(F.lit(1)) - F.sum(ok)).alias("failed"),
        F.round(F.avg(ok.cast("double")), 6).alias("success_rate"),
    )


def ingest_batch(df: DataFrame, checks: dict[str, Column], on_error: str = "skip") -> DataFrame:
    """Good rows of a batch. ``abort`` makes the job fail when any row fails a check."""
    marked = with_status(df, checks)
    if on_error == "skip":
        return marked.filter("status = 'success'").drop("status")
    if on_error != "abort":
        raise ValueError("on_error must be skip or abort")
    failed = F.when(F.col("status") != "success", F.raise_error(F.concat(F.lit("batch aborted: "), F.col("status"))))
    return marked.filter(failed.isNull()).drop("status")


def replace_facts(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Clean slate per key: all old rows of a key that comes again are dropped, then the new rows added."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """The same as a write: only the partitions that occur in ``df`` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row of each key; partial aggregation keeps one row per key and task before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins by ``order``."""
    return latest_per_key(existing.unionByName(new), keys, order)


def seed_benchmarks(evaluations: DataFrame, existing: DataFrame, key: str, score: str, minimum: float = 85) -> DataFrame:
    """Evaluations good enough to become benchmarks and not there yet."""
    return evaluations.filter(F.col(score) >= minimum).join(existing.select(key), key, "left_anti")


def pending(pages: DataFrame, results: DataFrame, html: str = "html") -> DataFrame:
    """Pages whose content hash has no stored result: only these need the expensive job."""
    hashed = pages.withColumn("content_hash", F.sha2(F.col(html), 256))
    return hashed.join(results.select("content_hash").distinct(), "content_hash", "left_anti")


def refresh_view(df: DataFrame, path: str) -> DataFrame:
    """Materialise a view: overwrite its files and read them back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
