"""Streaming forms of the batch jobs. Transformations are shared with batch; only sources, sinks and state differ."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from webfacts.functions.base import flag
from webfacts.functions.url import normalize_url
from webfacts.operators.embedding import backfill, hashing_model


def read_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    """Files arriving in a folder; the schema is given, never inferred."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def fresh_pages(pages: DataFrame, ts: str = "fetched_at", within: str = "1 day", url: str = "url") -> DataFrame:
    """Normal URL added, repeats of a URL inside the watermark dropped (state is bounded by the watermark)."""
    return pages.withColumn("url_norm", normalize_url(url)).withWatermark(ts, within).dropDuplicatesWithinWatermark(["url_norm"])


def hourly_stats(events: DataFrame, ts: str, value: str, late: str = "2 hours") -> DataFrame:
    """Tumbling hours: count and average."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"))
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg")).select(F.col("window.start").alias("hour"), "n", "avg")


def rolling_latency(events: DataFrame, tool: str, ts: str, value: str, length: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sliding windows per tool: count, average, maximum, approximate 95th percentile (bounded state)."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, length, step), tool)
    return w.agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"), F.percentile_approx(value, 0.95, 1000).alias("p95")
    ).select(F.col("window.start").alias("start"), tool, "n", "avg", "max", "p95")


def gap_sessions(events: DataFrame, series: str, ts: str, value: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions closed by a gap: start, end of the last event plus gap, count, sum."""
    s = events.withWatermark(ts, late).groupBy(series, F.session_window(ts, gap).alias("w"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(series, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def capped_sessions(events: DataFrame, series: str, ts: str, value: str, gap_ms: int = 1000, longest_ms: int = 5000, late: str = "10 seconds") -> DataFrame:
    """Sessions with a largest gap and a largest length.

    Rows wait in the state until the watermark has passed them and are then folded in time order, so rows that arrive
    out of order inside the watermark fall into the session they belong to. State per series is one open session and
    the rows of one watermark delay.
    """
    kind = dict(events.dtypes)[series]
    names = [series, "start_ms", "end_ms", "total", "n"]

    def fold(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, last, total, n, waiting_ms, waiting_v = state.get if state.exists else (None, None, 0.0, 0, [], [])
        ms, v = [np.asarray(waiting_ms, dtype=np.int64)], [np.asarray(waiting_v, dtype=np.float64)]
        for part in parts:
            ms.append(part["_ms"].to_numpy())
            v.append(part["_v"].to_numpy())
        ms, v = np.concatenate(ms), np.concatenate(v)
        order, mark = np.argsort(ms, kind="stable"), state.getCurrentWatermarkMs()
        ms, v = ms[order], v[order]
        settled = int(np.searchsorted(ms, mark, side="right"))
        out = []
        for at, x in zip(ms[:settled].tolist(), v[:settled].tolist()):
            if start is not None and (at - last > gap_ms or at - start > longest_ms):
                out.append((key[0], start, last, total, n))
                start, total, n = None, 0.0, 0
            if start is None:
                start = at
            last, total, n = at, total + x, n + 1
        ms, v = ms[settled:], v[settled:]
        if start is not None and mark > last + gap_ms and (not len(ms) or ms[0] - last > gap_ms):
            out.append((key[0], start, last, total, n))
            start, last, total, n = None, None, 0.0, 0
        if start is None and not len(ms):
            if state.exists:
                state.remove()
        else:
            state.update((start, last, total, n, ms.tolist(), v.tolist()))
            due = int(ms[0]) if len(ms) else last + gap_ms + 1
            state.setTimeoutTimestamp(max(due, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=names)

    stamped = events.withWatermark(ts, late).select(series, ts, F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms"), F.col(value).cast("double").alias("_v"))
    return stamped.groupBy(series).applyInPandasWithState(
        fold, f"{series} {kind}, start_ms long, end_ms long, total double, n long",
        "start long, last long, total double, n long, waiting_ms array<long>, waiting_v array<double>", "append", "EventTimeTimeout",
    )


def slo_counters(events: DataFrame, targets: DataFrame, tool: str, value: str, most: float = 0.05) -> DataFrame:
    """Running violation counters per tool and an alert flag, for update mode. ``targets(tool, target)`` is a small
    static table; Spark decides the join by its size."""
    joined = events.join(targets, tool)
    over = flag(F.col(value) > F.col("target"))
    return joined.groupBy(tool).agg(F.count(F.lit(1)).alias("n"), F.sum(over).alias("violations")).withColumn("alert", F.col("violations") > F.col("n") * most)


def late_split(batch: DataFrame, ts: str, limit: Column) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of a micro-batch."""
    return batch.filter(F.col(ts) >= limit), batch.filter(F.col(ts) < limit)


def quarantine_late(events: DataFrame, ts: str, allowed: str, good_path: str, late_path: str, mark_path: str) -> DataStreamWriter:
    """Late rows to their own folder instead of silently dropping them.

    The newest event time seen before a batch is kept as a one-row table per batch number, so a batch that
    runs again after a failure uses the same limit and overwrites its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        if batch_id > 0:
            seen = spark.read.parquet(f"{mark_path}/batch={batch_id - 1}").first()["seen"]
        limit = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {allowed}") if seen else F.lit("1970-01-01").cast("timestamp")
        good, late = late_split(batch, ts, limit)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        newest = batch.agg(F.greatest(F.max(ts).cast("timestamp"), F.lit(seen).cast("timestamp")).alias("seen"))
        newest.write.mode("overwrite").parquet(f"{mark_path}/batch={batch_id}")

    return events.writeStream.foreachBatch(write)


def replace_per_page(pages: DataFrame, facts: Callable[[DataFrame], DataFrame], path: str, page_id: str = "page_id") -> DataStreamWriter:
    """Facts of arriving pages. A batch writes only its own folder, so a retried batch replaces what it wrote before;
    readers take the newest batch of a page (:func:`current_facts`)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        facts(batch).write.mode("overwrite").parquet(f"{path}/facts/batch={batch_id}")
        batch.select(page_id).distinct().write.mode("overwrite").parquet(f"{path}/pages/batch={batch_id}")

    return pages.writeStream.foreachBatch(write)


def current_facts(spark: SparkSession, path: str, page_id: str = "page_id") -> DataFrame:
    """Facts of the newest batch of every page; a page whose newest batch has no facts has none."""
    newest = spark.read.parquet(f"{path}/pages").groupBy(page_id).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/facts").join(newest, [page_id, "batch"], "left_semi").drop("batch")


def compact_facts(spark: SparkSession, path: str, into: str, page_id: str = "page_id") -> None:
    """The current facts as one batch of a new folder with the same layout; readers and later batches go on from there.

    The batch keeps the number of the newest one, so batches that arrive later still win. Run it between batches.
    """
    last = spark.read.parquet(f"{path}/pages").agg(F.max("batch")).first()[0]
    current_facts(spark, path, page_id).write.mode("overwrite").parquet(f"{into}/facts/batch={last}")
    spark.read.parquet(f"{path}/pages").select(page_id).distinct().write.mode("overwrite").parquet(f"{into}/pages/batch={last}")


def embedding_backfill(facts: DataFrame, path: str, id_col: str, text_col: str, make_model=hashing_model) -> DataStreamWriter:
    """Embeddings for new facts only; batch folders make a retry harmless."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        empty = spark.createDataFrame([], f"{id_col} {dict(batch.dtypes)[id_col]}, batch int")
        stored = spark.read.parquet(path).select(id_col, "batch").filter(F.col("batch") < batch_id) if batch_id else empty
        out = backfill(batch, stored, id_col, id_col, text_col, make_model)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return facts.writeStream.foreachBatch(write)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what is there and stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def keep_updates(aggregated: DataFrame, path: str) -> DataStreamWriter:
    """Update-mode results to one folder per batch; :func:`newest_updates` reads the last state of every key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return aggregated.writeStream.outputMode("update").foreachBatch(write)


def newest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    from webfacts.sources.tables import latest_per_key

    return latest_per_key(spark.read.parquet(path), keys, ["batch"]).drop("batch")


def compact_updates(spark: SparkSession, path: str, into: str, keys: list[str]) -> None:
    """The last state of every key as one batch of a new folder, numbered like the newest batch."""
    last = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    newest_updates(spark, path, keys).write.mode("overwrite").parquet(f"{into}/batch={last}")
