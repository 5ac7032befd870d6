"""SimHash near-duplicates by segment-popcount embedding (operator 5).

A fingerprint of 64 bits is cut into 21 segments of three bits (the last of four); the bit counts of the segments
place it on an integer grid. The Manhattan distance of two grid points never exceeds the Hamming distance of the fingerprints.
Two points within Manhattan distance 2 have a grid point within distance 1 of both, so each fingerprint visits
the 43 grid cells around it and cells visited by one fingerprint alone rule it out. Survivors are verified
exactly: fingerprints at most two bits apart share a 64-bit value at most one bit away from each. At most 65
fingerprints lie around such a value and all of them link, so a link to the smallest one suffices and no
group is ever expanded into pairs. That one is found where the others are, by a window of at most 65 rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfacts.llm.common import components, fresh, stored

SEED = 42
#: Three bits hold the count of a segment of up to four bits and a step to either side, so 21 segments fill one long.
SEGMENTS = [3] * 20 + [4]
#: Shared cells up to this number are broadcast to find their visitors; beyond it they are joined by shuffle.
BROADCAST_CELLS = 500_000
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_OFFSETS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the three-word shingles; zero for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:]))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE_OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    set_bits = (2 * (seen @ _BYTE_BITS).ravel() > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return F.pandas_udf(run, "long")(text)


def _grid_cells(fp: str) -> tuple[Column, list[int]]:
    """The grid point packed into one long, and the steps to the cells within Manhattan distance 1."""
    # One is added to each count so that a step down from zero stays inside its three bits.
    place, shift = F.lit(0).cast("long"), 0
    for i, width in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned(F.col(fp), shift).bitwiseAND(2**width - 1)
        place = place + F.shiftleft((F.bit_count(segment) + 1).cast("long"), 3 * i)
        shift += width
    steps = [0] + [s << (3 * i) for i in range(len(SEGMENTS)) for s in (1, -1)]
    return place, steps


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """Components ``(node, component)`` of distinct ``fps(fp)`` linked at two differing bits or fewer."""
    place, steps = _grid_cells("fp")
    placed = fps.select("fp", place.alias("place"))
    cells = placed.select("fp", F.explode(F.array(*[F.col("place") + F.lit(s) for s in steps])).alias("cell"))
    shared = stored(cells.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("cell"))
    few = shared.count() <= BROADCAST_CELLS
    near = stored(cells.join(F.broadcast(shared) if few else shared.hint("merge"), "cell", "left_semi").select("fp").distinct())
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long")) for i in range(64)]
    points = near.select("fp", F.explode(F.array(*around)).alias("point"))
    # no join: the planner takes the 65 rows of a fingerprint for one and would broadcast them all
    rooted = points.withColumn("root", F.min("fp").over(Window.partitionBy("point")))
    links = rooted.filter("fp <> root AND bit_count(fp ^ root) <= 2")
    return components(links.select(F.col("fp").alias("a"), F.col("root").alias("b")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable).

    A null or wordless text has fingerprint zero and links like any other; repeated rows give repeated rows; a
    null id is passed through and never becomes a component id unless the component has no other; an empty
    table gives no rows. Only the two named columns are read, so further columns cannot clash.
    """
    return _labelled(docs, doc_id, text).select(
        F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component_id")
    )


def _labelled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = stored(docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_hash"), fingerprints(F.col(text)).alias("fp")))
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    linked = near_fingerprints(distinct.select("fp")).withColumnRenamed("node", "fp")
    classes = stored(distinct.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    lowest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labels = classes.join(lowest, "component").select("fp", "component", "component_id")
    return rows.join(labels, "fp", "left")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row of each near-duplicate group: the one with the smallest id, then text hash.

    Rows equal in id and text count as one. A group without any id keeps one of its rows.
    """
    rows = _labelled(docs, doc_id, text)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"))
    winners = rows.groupBy("component").agg(F.min(order).alias("w"))
    key, key_of = fresh(docs, "_row"), lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), h.cast("string"))
    keep = winners.select(key_of(F.col("w.id"), F.col("w.text_hash")).alias(key)).distinct()
    keyed = docs.withColumn(key, key_of(F.col(doc_id), F.xxhash64(F.col(text))))
    return keyed.join(keep, key, "left_semi").dropDuplicates([key]).drop(key)
