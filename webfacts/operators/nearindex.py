"""A stored index for approximate nearest neighbours: multi-probe signatures of random hyperplanes.

Every vector has one signature of ``bits`` bits in each of ``tables`` tables; bit b says on which side of hyperplane b it lies.
The index is three Parquet folders: ``settings`` (one row), ``signatures`` (table, bucket, id), partitioned by table and a
hash of the bucket, and ``vectors`` (id, unit vector). Rows are appended without touching what is stored. A search reads,
for each query and table, its own bucket and the buckets that differ in one of its ``probes`` least certain bits, the
ones whose hyperplanes it is closest to, and ranks what it finds by exact cosine. Only the partitions that hold such a
bucket are listed and read.

Pairs of a query and a row are not listed: found rows and queries meet in blocks of bounded size, whether a row lies in a
bucket of a query is one bit, and only the best ``k`` of a block leave it.

Recall depends on tables, bits and probes alone, not on the number of rows; more rows ask for more bits.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webfacts.functions.vector import l2_normalize
from webfacts.operators.aggregates import top_per_key
from webfacts.session import cut

TABLES, BITS, PROBES = 16, 7, 5
#: Queries of a block; its rows grow with the index between two bounds, to about 64 blocks.
BLOCK_QUERIES = 8192
LEAST_ROWS, MOST_ROWS = 4096, 32768
#: A block is searched in pieces of so many queries and rows; a piece has a cosine and a bit for each pair.
PIECE_QUERIES, PIECE_ROWS = 512, 4096
#: Below this share of pairs in a piece only those are multiplied, one by one.
FEW = 0.05
#: More than the rounding by which two ways to add up a cosine of unit vectors can differ.
SLACK = 1e-9


@dataclass(frozen=True)
class Settings:
    """What all rows of one index share."""

    dim: int
    tables: int = TABLES
    bits: int = BITS
    parts: int = 32
    seed: int = 17


@lru_cache(maxsize=8)
def planes(settings: Settings) -> np.ndarray:
    """Normals of the hyperplanes, ``tables * bits`` rows, to three decimals so that they can be written down exactly."""
    return np.round(np.random.default_rng(settings.seed).standard_normal((settings.tables * settings.bits, settings.dim)), 3)


def _signed(vectors: pd.Series, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Signed distances to the hyperplanes (row, table, bit) and signatures (row, table)."""
    far = (np.stack(vectors.to_numpy()) @ planes(settings).T).reshape(len(vectors), settings.tables, settings.bits)
    return far, ((far >= 0) << np.arange(settings.bits)).sum(axis=2)


def _unit(rows: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    usable = F.col(vector).isNotNull() & (F.size(vector) == dim) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return rows.filter(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), l2_normalize(vector).alias("vec"))


def _part(bucket: str, parts: int):
    return F.pmod(F.xxhash64(bucket), F.lit(parts)).cast("int")


def signatures(unit: DataFrame, settings: Settings) -> DataFrame:
    """``tab, bucket, id, part`` of every row of ``unit(id, vec)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, codes = _signed(pdf["vec"], settings)
                tabs = np.tile(np.arange(settings.tables, dtype=np.int32), len(pdf))
                yield pd.DataFrame({"tab": tabs, "bucket": codes.ravel().astype(np.int64), "id": np.repeat(pdf["id"].to_numpy(), settings.tables)})

    return unit.mapInPandas(run, "tab int, bucket long, id long").withColumn("part", _part("bucket", settings.parts))


def store(corpus: DataFrame, id_col: str, vector: str, path: str, settings: Settings) -> None:
    """Write a new index of ``corpus`` into the folder ``path``.

    Left out: rows without id, null vectors, other dimensions than ``settings.dim``, entries that are null or not finite.
    """
    row = [(settings.dim, settings.tables, settings.bits, settings.parts, settings.seed)]
    corpus.sparkSession.createDataFrame(row, "dim int, tables int, bits int, parts int, seed int").coalesce(1).write.mode("overwrite").parquet(posixpath.join(path, "settings"))
    _write(_unit(corpus, id_col, vector, settings.dim), path, settings, "overwrite")


def append(corpus: DataFrame, id_col: str, vector: str, path: str) -> None:
    """Add the rows of ``corpus`` whose ids the index does not hold yet."""
    spark = corpus.sparkSession
    settings = stored_settings(spark, path)
    held = _vectors(spark, path).select("id")
    _write(cut(_unit(corpus, id_col, vector, settings.dim).join(held, "id", "left_anti")), path, settings, "append")


def _write(unit: DataFrame, path: str, settings: Settings, mode: str) -> None:
    # a partition is gathered first: else every task leaves a file in each of them
    signatures(unit, settings).hint("rebalance", "tab", "part").write.mode(mode).partitionBy("tab", "part").parquet(posixpath.join(path, "signatures"))
    unit.write.mode(mode).parquet(posixpath.join(path, "vectors"))


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, vec array<double>").parquet(posixpath.join(path, "vectors"))


def stored_settings(spark: SparkSession, path: str) -> Settings:
    return Settings(**spark.read.parquet(posixpath.join(path, "settings")).first().asDict())


def probes_of(queries: DataFrame, settings: Settings, probes: int) -> DataFrame:
    """``tab, bucket, query_id, part``: the own bucket of each query and those behind its ``probes`` least certain bits."""
    flips = min(probes, settings.bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                far, codes = _signed(pdf["vec"], settings)
                least = np.argsort(np.abs(far), axis=2, kind="stable")[:, :, :flips]
                buckets = np.concatenate([codes[:, :, None], codes[:, :, None] ^ (1 << least)], axis=2)
                tabs = np.broadcast_to(np.arange(settings.tables, dtype=np.int32)[None, :, None], buckets.shape)
                ids = np.broadcast_to(pdf["id"].to_numpy()[:, None, None], buckets.shape)
                yield pd.DataFrame({"tab": tabs.ravel(), "bucket": buckets.ravel().astype(np.int64), "query_id": ids.ravel()})

    return queries.select("id", "vec").mapInPandas(run, "tab int, bucket long, query_id long").withColumn("part", _part("bucket", settings.parts))


def partitions(wanted: DataFrame) -> dict[int, list[int]]:
    """The partitions that hold probed buckets, by table: at most ``tables * parts`` numbers."""
    found: dict[int, list[int]] = {}
    for r in wanted.select("tab", "part").distinct().collect():
        found.setdefault(r.tab, []).append(r.part)
    return found


def _read(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``tab, bucket, id`` of the partitions that hold a bucket of ``wanted``."""
    here = F.lit(False)
    for tab, numbers in sorted(partitions(wanted).items()):
        here = here | ((F.col("tab") == tab) & F.col("part").isin(sorted(numbers)))
    return spark.read.schema("bucket long, id long, tab int, part int").parquet(posixpath.join(path, "signatures")).filter(here).select("tab", "bucket", "id")


def candidates(spark: SparkSession, path: str, unit: DataFrame, probes: int = PROBES) -> DataFrame:
    """``query_id, id``: the other rows in the probed buckets of each query of ``unit(id, vec)``; a search does not list them."""
    wanted = cut(probes_of(unit, stored_settings(spark, path), probes))
    met = wanted.select("tab", "bucket", "query_id").join(_read(spark, path, wanted), ["tab", "bucket"]).filter(F.col("query_id") != F.col("id"))
    return met.select("query_id", "id").distinct()


def _bits(codes: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of some queries, in order, and for each the queries that have it as bits; a row without any follows."""
    known, at = np.unique(np.concatenate(codes.to_numpy()), return_inverse=True)
    query = np.repeat(np.arange(len(codes)), codes.map(len))
    bits = np.zeros((len(known) + 1, -(-len(codes) // 8)), np.uint8)
    np.bitwise_or.at(bits, (at, query >> 3), (128 >> (query & 7)).astype(np.uint8))
    return known, bits


def _padded(codes: pd.Series) -> np.ndarray:
    """One line of codes a row, filled up with -1."""
    size = codes.map(len).to_numpy()
    out = np.full((len(codes), size.max()), -1, np.int64)
    out[np.arange(size.max()) < size[:, None]] = np.concatenate(codes.to_numpy())
    return out


def _met(known: np.ndarray, bits: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` queries (lines) have a code of which row."""
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    at[known[at] != codes] = len(known)
    rows = bits[at[:, 0]]
    for i in range(1, at.shape[1]):
        rows |= bits[at[:, i]]
    return np.unpackbits(rows, axis=1, count=n).T.astype(bool)


def _best(met: np.ndarray, asked: np.ndarray, vecs: np.ndarray, ids: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ``k`` ids of each query among the pairs ``met``: query, id, cosine. Any ``least`` rows hold ``k`` different ids."""
    pick = met
    if np.count_nonzero(met) > FEW * met.size and met.shape[1] > least:
        sims = np.where(met, asked @ vecs.T, -np.inf)
        pick = met & (sims >= np.partition(sims, -least, axis=1)[:, -least, None] - SLACK)
    q, m = np.nonzero(pick)
    # added up in the order of dot(): equal vectors have equal cosines wherever they stand
    total = np.zeros(len(q))
    for x, y in zip(asked.T, vecs.T):
        total += x[q] * y[m]
    return _first(q, ids[m], total, k)


def _first(q: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` ids of each query by cosine, then id; of an id that comes again the best."""
    order = np.lexsort((-sims, ids, q))
    q, ids, sims = q[order], ids[order], sims[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
    q, ids, sims = q[new], ids[new], sims[new]
    order = np.lexsort((ids, -sims, q))
    q, ids, sims = q[order], ids[order], sims[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], ids[rank < k], sims[rank < k]


def _block_search(asked: DataFrame, held: DataFrame, n_asked: int, n_held: int, k: int) -> DataFrame:
    """``query_id, neighbour_id, similarity``: the best ``k`` other rows of ``held`` with a code of the query, of each block.

    Both have ``id, vec, codes``. An id stands in one block of its side, however often it comes.
    """
    nq = max(1, -(-n_asked // BLOCK_QUERIES))
    nm = max(1, -(-n_held // min(MOST_ROWS, max(LEAST_ROWS, n_held // 64))))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "vec", "codes", own(nq).alias("_q"), every(nm).alias("_m"))
    right = held.select("id", "vec", "codes", own(nm).alias("_m"), every(nq).alias("_q"))

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))]
        if len(queries) and len(rows):
            ids, vecs, codes = rows["id"].to_numpy(), np.stack(rows["vec"].to_numpy()), _padded(rows["codes"])
            least = k * int(np.unique(ids, return_counts=True)[1].max())
            for at in range(0, len(queries), PIECE_QUERIES):
                some = queries.iloc[at : at + PIECE_QUERIES]
                mine, (known, bits) = some["id"].to_numpy(), _bits(some["codes"])
                vec, found = np.stack(some["vec"].to_numpy()), []
                for i in range(0, len(ids), PIECE_ROWS):
                    j = slice(i, i + PIECE_ROWS)
                    met = _met(known, bits, codes[j], len(some)) & (mine[:, None] != ids[None, j])
                    found.append(_best(met, vec, vecs[j], ids[j], k, least))
                q, near, sims = _first(*map(np.concatenate, zip(*found)), k)
                out.append((mine[q], near, sims))
        return pd.DataFrame(dict(zip(("query_id", "neighbour_id", "similarity"), map(np.concatenate, zip(*out)))))

    blocks = ["_q", "_m"]
    return left.groupBy(*blocks).cogroup(right.groupBy(*blocks)).applyInPandas(run, "query_id long, neighbour_id long, similarity double")


def search(spark: SparkSession, path: str, queries: DataFrame, id_col: str, vector: str, k: int, probes: int = PROBES, min_similarity: float | None = None) -> DataFrame:
    """``query_id, neighbour_id, similarity, rank``: up to ``k`` other stored rows near each query, by exact cosine, ties by id.

    A query whose id is stored does not find itself. Queries with an unusable vector find nothing; an id that is asked
    for with several vectors gets the best of all. No bucket is capped.
    """
    settings = stored_settings(spark, path)
    unit = cut(_unit(queries, id_col, vector, settings.dim))
    vectors = _vectors(spark, path)
    wanted = cut(probes_of(unit, settings, probes))
    code = (F.shiftleft(F.col("tab").cast("long"), settings.bits) + F.col("bucket")).alias("code")
    codes = F.collect_set("code").alias("codes")
    asked = unit.join(wanted.select(F.col("query_id").alias("id"), code).groupBy("id").agg(codes), "id")
    found = _read(spark, path, wanted).join(wanted.select("tab", "bucket").distinct(), ["tab", "bucket"], "left_semi")
    held = vectors.join(found.select("id", code).groupBy("id").agg(codes), "id")
    scored = _block_search(asked, held, unit.count(), vectors.count(), k).groupBy("query_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    if min_similarity is not None:
        scored = scored.filter(F.col("similarity") >= min_similarity)
    order = [F.desc("similarity"), F.asc("neighbour_id")]
    best = top_per_key(scored, ["query_id"], order, k)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))
