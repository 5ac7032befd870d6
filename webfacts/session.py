"""Session helpers: local test session and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "webfacts", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench. Clusters bring their own session."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config(SPREAD, cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="spark-webfacts-")
    sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SPREAD = "spark.webfacts.spread"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-heavy per-row job over a few small files as many partitions as ``spark.webfacts.spread`` names.

    The setting is meant for one machine; without it, as on a cluster, nothing is shuffled.
    """
    width = df.sparkSession.conf.get(SPREAD, None)
    return df.repartition(int(width), *keys) if width and not df.isStreaming else df


def fan_out(df: DataFrame, *keys: str) -> DataFrame:
    """Deal narrow rows, each of which grows into much work, by key over four tasks a core.

    A file of a few MB is one task however many cores there are. Only the narrow rows are shuffled.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
