"""Embedding near-duplicates by Euclidean p-stable hashing (operator 8).

Vectors are normalised; then the squared distance of two vectors is 2 - 2 cos. A table hashes a vector to the
whole numbers floor((a.v + b) / width) of ``BITS`` random Gaussian directions a. Vectors that share a bucket in some
table are compared by their exact cosine in double precision. With the parameters below a pair at cosine 0.9
shares a bucket in at least one of the tables with probability above 0.91, at 0.95 above 0.99; unrelated pairs
do so about once in two thousand.

Small buckets give pairs, at most ``CROWD`` - 1 per row. The rows of larger buckets are cut into blocks, and
blocks are compared as matrix products that give counts and one class mark per row, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfacts.llm.common import components
from webfacts.session import cut

MIN_COSINE = 0.9
TABLES = 56
BITS = 16
WIDTH = 2.0
CROWD = 64
BLOCK = 1024
SEED = 8


@lru_cache(maxsize=4)
def _directions(dim: int, tables: int, bits: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    mix = rng.integers(1, 2**63 - 1, size=(tables, bits), dtype=np.int64) | 1
    return rng.standard_normal((dim, tables * bits)), rng.uniform(0, width, tables * bits), mix


def codes(unit: np.ndarray, tables: int = TABLES, bits: int = BITS, width: float = WIDTH) -> np.ndarray:
    """Bucket code of each row in each table."""
    a, b, mix = _directions(unit.shape[1], tables, bits, width)
    cells = np.floor((unit @ a + b) / width).astype(np.int64).reshape(len(unit), tables, bits)
    with np.errstate(over="ignore"):
        return (cells * mix).sum(axis=2)


def normalised(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so no square overflows."""
    v = rows.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _signatures(reps: DataFrame, tables: int, bits: int, width: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.iloc[start : start + 2048]
                sizes = part["vector"].map(len)
                for size, same in part.groupby(sizes):
                    found = codes(normalised(np.stack(same["vector"].to_list())), tables, bits, width)
                    yield pd.DataFrame({"rep": same["rep"], "dim": int(size), "codes": list(found)})

    return reps.select("rep", "vector").mapInPandas(run, "rep long, dim int, codes array<long>")


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    return x @ y.T >= cosine


def _block(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Counts and class marks of one block, or of two blocks with each other.

    A pair is counted in the first crowded table that it shares. The class mark is the smallest vector that links
    reach inside the block pair.
    """
    group = group.sort_values("rep", ignore_index=True)
    t = int(group["t"].iloc[0])
    unit, crowded = normalised(np.stack(group["vector"].to_list())), np.stack(group["crowded"].to_list())
    side, mult, n = group["side"].to_numpy(), group["mult"].to_numpy(), len(group)
    meets = (side[:, None] != side[None, :]) if group["i"].iloc[0] != group["j"].iloc[0] else ~np.eye(n, dtype=bool)
    link = _linked(unit, unit, cosine) & meets
    mark = np.arange(n)
    while True:  # rows are sorted, so the smallest index is the smallest vector
        low = np.minimum(mark, np.where(link, mark[None, :], n).min(axis=1))
        low = low[low]
        if (low == mark).all():
            break
        mark = low
    first = link.copy()
    for earlier in range(t):
        column = crowded[:, earlier]
        first &= ~((column[:, None] == column[None, :]) & (column[:, None] != 0))
    return pd.DataFrame({"rep": group["rep"], "n": (first * mult[None, :]).sum(axis=1), "mark": group["rep"].to_numpy()[mark]})


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = MIN_COSINE,
    tables: int = TABLES, bits: int = BITS, width: float = WIDTH, crowd: int = CROWD, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero, or hold a null, NaN or infinite component link with nothing. Vectors of other
    length never link. Equal vectors are folded and linked with each other without any comparison, so a repeated vector
    costs one row. Repeated rows of one id count as vectors of their own. An empty table gives no rows.
    """
    x = F.col("vector")
    bad = x.isNull() | (F.size(x) <= 0) | F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("vector")).withColumn("good", ~F.coalesce(bad, F.lit(True)))
    same = cut(rows.filter("good").groupBy("vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult")).filter("rep IS NOT NULL"))
    signed = cut(_signatures(same, tables, bits, width))
    spots = signed.select("rep", "dim", F.posexplode("codes").alias("t", "code"))
    shared = cut(spots.groupBy("dim", "t", "code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = spots.join(shared, ["dim", "t", "code"])

    crowded = cut(met.filter(F.col("n") > crowd))
    marks = crowded.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("t", "code"))).alias("m"))
    flags = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.coalesce(F.col("m")[t], F.lit(0).cast("long")))
    lookup = cut(same.join(marks, "rep", "left").select("rep", "vector", "mult", F.when(F.col("m").isNotNull(), flags).alias("crowded")))

    small = met.filter(F.col("n") <= crowd).select("dim", "t", "code", "rep")
    pairs = small.select("dim", "t", "code", F.col("rep").alias("a")).join(small.select("dim", "t", "code", F.col("rep").alias("b")), ["dim", "t", "code"])
    pairs = pairs.filter("a < b").select("a", "b").distinct()
    left = lookup.select(F.col("rep").alias("a"), F.col("vector").alias("va"), F.col("mult").alias("ma"), F.col("crowded").alias("ca"))
    right = lookup.select(F.col("rep").alias("b"), F.col("vector").alias("vb"), F.col("mult").alias("mb"), F.col("crowded").alias("cb"))

    def cosines(va: pd.Series, vb: pd.Series) -> pd.Series:
        if va.empty:
            return pd.Series([], dtype="float64")
        lengths = va.map(len)
        out = pd.Series(0.0, index=va.index)
        for _, at in va.groupby(lengths).groups.items():
            p, q = normalised(np.stack(va[at].to_list())), normalised(np.stack(vb[at].to_list()))
            out[at] = np.einsum("ij,ij->i", p, q)
        return out

    both_crowded = F.coalesce(F.exists(F.arrays_zip("ca", "cb"), lambda z: (z["ca"] == z["cb"]) & (z["ca"] != 0)), F.lit(False))
    linked = cut(
        pairs.join(left, "a").join(right, "b").withColumn("cos", F.pandas_udf(cosines, "double")("va", "vb"))
        .filter(F.col("cos") >= cosine).select("a", "b", "ma", "mb", both_crowded.alias("seen"))
    )
    once = linked.filter("NOT seen")
    counts = once.select(F.col("a").alias("rep"), F.col("mb").alias("n")).union(once.select("b", "ma"))

    dealt = crowded.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "dim", "t", "code", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side")
    )
    blocks = dealt.join(lookup, "rep").groupBy("dim", "t", "code", "i", "j").applyInPandas(lambda g: _block(g, cosine), "rep long, n long, mark long")
    blocks = cut(blocks)
    counts = counts.union(blocks.select("rep", "n")).groupBy("rep").agg(F.sum("n").alias("n"))

    edges = linked.select("a", "b").union(blocks.filter("rep <> mark").select("rep", "mark")).distinct()
    found = components(edges).select(F.col("node").alias("rep"), "component")
    facts = same.join(counts, "rep", "left").join(found, "rep", "left").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    good = rows.filter("good").join(facts, "vector", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    alone = rows.filter("NOT good").select("id", F.lit(0).cast("long"), "id")
    return good.union(alone).select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
