"""Helpers shared by the training-data operators."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and continue from the files.

    For loops: unlike a checkpoint, the read plan carries nothing over from the plan that made the rows.
    """
    path = posixpath.join(ensure_checkpoint_dir(df.sparkSession), f"rows-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, component)`` per node of an edge.

    ``component`` is the smallest node reachable. Every round draws new random ranks, each node moves to the parent of
    its lowest-ranked neighbour, and edges are renamed and folded, so the graph shrinks geometrically, chains
    included. Groups are only ever reduced with ``min``, so a hub costs no more than its edges. Null ends and
    self-loops are ignored; no edges give no rows.
    """
    live = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    moves: list[DataFrame] = []
    while not moves or not live.isEmpty():
        turn = len(moves) + 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("r"), F.col(c).alias("n"))  # noqa: B023, E731
        both = live.union(live.select("v", "u"))
        parent = both.groupBy("u").agg(F.min(rank("v")).alias("low")).select(F.col("u").alias("node"), F.least(rank("u"), F.col("low"))["n"].alias("parent"))
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("component"))
        moves.append(stored(parent.join(above, "parent").select("node", "component")))
        ends = moves[-1].select(F.col("node").alias("u"), F.col("component").alias("cu"))
        other = moves[-1].select(F.col("node").alias("v"), F.col("component").alias("cv"))
        renamed = live.join(ends, "u").join(other, "v").filter("cu <> cv")
        live = stored(renamed.select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct())
    found = moves[0]
    for move in moves[1:]:
        moved = move.select(F.col("node").alias("component"), F.col("component").alias("moved"))
        found = found.join(moved, "component", "left").select("node", F.coalesce("moved", "component").alias("component"))
    found = stored(found)
    lowest = found.groupBy("component").agg(F.min("node").alias("lowest"))
    return stored(found.join(lowest, "component").select("node", F.col("lowest").alias("component")))
