"""A stored inverted index with block-max pruning.

Documents fall into blocks of ``span`` neighbouring ids. A stored row is one term in one block: its postings (id, term
frequency, document length) as arrays of at most ``span`` entries, with the greatest frequency and the smallest length in
front. These two bound the score of every document of the block for the term, whatever the corpus statistics are by
then, so documents can be appended. Rows lie in folders by term hash; those of a frequent term are spread over
many tasks and files by block.

A top-k search adds up the bounds of each block over the query terms from the headers alone, scores the blocks with the
highest bounds, and then only those others whose bound reaches the k-th score found. The result is that of scoring everything.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webfacts.functions import text
from webfacts.session import cut, spread

K1, B = 1.2, 0.75
SPAN = 256
#: Blocks scored before the bounds decide about the rest.
FIRST_BLOCKS = 64
#: Blocks of one term that go to one writing task.
RUN = 1024


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.hash(term), F.lit(buckets)).alias("bucket")


def _block(doc: Column, span: int) -> Column:
    return F.floor(doc / F.lit(span)).cast("long")


def postings(docs: DataFrame, id_col: str, text_col: str, only: list[str] | None = None) -> DataFrame:
    """Inverted index ``(term, id, tf, doc_len)``; ``only`` keeps the postings of some terms, for a search without a stored index."""
    toks = spread(docs.select(id_col, text_col), id_col).select(id_col, text.tokens(text_col).alias("_t"))
    wanted = F.col("_t") if only is None else F.filter("_t", lambda t: t.isin(only))
    return (
        toks.select(id_col, F.size("_t").alias("doc_len"), F.explode(wanted).alias("term"))
        .groupBy("term", id_col, "doc_len")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def blocks_of(docs: DataFrame, id_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """``block, term, n, max_tf, min_len, held``: the stored rows; only the texts are shuffled, not their words."""
    # texts are dealt by block, so the postings that come out of them are counted and gathered where they are
    near = docs.select(id_col, text_col, _block(F.col(id_col), span).alias("block")).repartition("block")
    toks = near.select("block", id_col, text.tokens(text_col).alias("_t")).select("block", id_col, F.size("_t").alias("doc_len"), F.explode("_t").alias("term"))
    rows = toks.groupBy("block", "term", id_col, "doc_len").agg(F.count(F.lit(1)).alias("tf"))
    entry = F.struct(F.col(id_col).cast("long").alias("id"), F.col("tf").cast("int").alias("tf"), F.col("doc_len").cast("int").alias("doc_len"))
    return rows.groupBy("block", "term").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").cast("int").alias("max_tf"), F.min("doc_len").cast("int").alias("min_len"), F.sort_array(F.collect_list(entry)).alias("held")
    )


def store(docs: DataFrame, path: str, id_col: str, text_col: str, buckets: int = 64, span: int = SPAN, mode: str = "overwrite") -> None:
    """Write the index of ``docs`` (whole-number ids) and the totals that ranking needs.

    With ``mode="append"`` new documents are added to a stored index, with its own ``buckets`` and ``span``; a document must
    not be added twice. Rows without id are left out.
    """
    spark = docs.sparkSession
    if mode == "append":
        known = spark.read.parquet(posixpath.join(path, "totals")).agg(F.max("buckets"), F.max("span")).first()
        buckets, span = known[0], known[1]
    docs = docs.filter(F.col(id_col).isNotNull())
    blocks = blocks_of(docs, id_col, text_col, span)
    dealt = blocks.withColumn("bucket", _bucket(F.col("term"), buckets))
    dealt = dealt.repartition("bucket", F.floor(F.col("block") / F.lit(RUN))).sortWithinPartitions("bucket", "term", "block")
    dealt.write.partitionBy("bucket").mode(mode).parquet(posixpath.join(path, "postings"))
    lengths = docs.select(F.size(text.tokens(text_col)).alias("n"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    totals.withColumns({"buckets": F.lit(buckets), "span": F.lit(span)}).write.mode(mode).parquet(posixpath.join(path, "totals"))


_ROWS = "term string, block long, n long, max_tf int, min_len int, held array<struct<id: bigint, tf: int, doc_len: int>>, bucket int"


def _totals(spark: SparkSession, path: str) -> tuple[int, float, float]:
    r = spark.read.parquet(posixpath.join(path, "totals")).agg(F.max("buckets"), F.sum("n_docs"), F.sum("n_tokens")).first()
    return r[0], float(r[1]), (r[2] / r[1] if r[1] else 0.0)


def _rows(spark: SparkSession, path: str, terms: list[str], buckets: int) -> DataFrame:
    """Stored rows of the terms; only the folders of their hashes are read."""
    wanted = [_bucket(F.lit(t), buckets) for t in terms]
    rows = spark.read.schema(_ROWS).parquet(posixpath.join(path, "postings"))
    return rows.filter(F.col("bucket").isin(wanted) & F.col("term").isin(terms)) if terms else rows.filter(F.lit(False))


def stored_postings(spark: SparkSession, path: str, query: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Postings ``(term, id, tf, doc_len)`` of the query's terms and one row ``(n_docs, avg_len)`` of a stored index."""
    buckets, n_docs, avg_len = _totals(spark, path)
    held = _rows(spark, path, text.query_terms(query), buckets).select("term", F.explode("held").alias("h"))
    size = spark.createDataFrame([(n_docs, avg_len)], "n_docs double, avg_len double")
    return held.select("term", F.col("h.id").alias(id_col), F.col("h.tf").cast("long").alias("tf"), F.col("h.doc_len").alias("doc_len")), size


def bm25_part(idf: Column, tf: Column, length: Column, avg_len: float | Column, k1: float = K1, b: float = B) -> Column:
    """What one term adds to the score of a document."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len))


def idf(n_docs: float | Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


@dataclass
class TopK:
    """``rows`` (id, score); how many (term, block) rows were scored, of how many that hold all terms."""

    rows: DataFrame
    blocks_read: int
    blocks: int


def top_k(spark: SparkSession, path: str, query: str, id_col: str, k: int, score: str = "bm25", every_term: bool = True, first_blocks: int = FIRST_BLOCKS) -> TopK:
    """The ``k`` best documents of a stored index that hold every term (or any, with ``every_term=False``), ties by id.

    ``score`` is ``bm25`` or ``text_rank`` (term frequencies over one plus the logarithm of the length). A query
    without terms finds nothing.
    """
    terms = text.query_terms(query)
    buckets, n_docs, avg_len = _totals(spark, path)
    rows = _rows(spark, path, terms, buckets)
    dfs = {r.term: r.df for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # one row a term
    weight = F.lit(1.0)
    for t, df in dfs.items():
        weight = F.when(F.col("term") == t, idf(n_docs, F.lit(float(df)))).otherwise(weight)

    def part(tf: Column, length: Column) -> Column:
        return bm25_part(weight, tf, length, avg_len) if score == "bm25" else tf / (1 + F.log(F.greatest(length, F.lit(1))))

    need = len(terms) if every_term else 1
    per_term = rows.groupBy("block", "term").agg(F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"), F.count(F.lit(1)).alias("n_rows"))
    bounds = per_term.groupBy("block").agg(F.sum(part(F.col("max_tf"), F.col("min_len"))).alias("bound"), F.count(F.lit(1)).alias("n_terms"), F.sum("n_rows").alias("n_rows"))
    # a bound may fall a hair short of the score it bounds
    bounds = cut(bounds.filter(F.col("n_terms") >= need).select("block", (F.col("bound") * (1 + 1e-9)).alias("bound"), "n_rows"))
    best_first = [F.desc("bound"), F.asc("block")]
    first = cut(bounds.orderBy(*best_first).limit(first_blocks))

    def scored(chosen: DataFrame) -> DataFrame:
        held = rows.join(chosen.select("block"), "block").select("term", F.explode("held").alias("h"))
        docs = held.groupBy(F.col("h.id").alias(id_col)).agg(F.sum(part(F.col("h.tf"), F.col("h.doc_len"))).alias(score), F.count(F.lit(1)).alias("n_terms"))
        return docs.filter(F.col("n_terms") >= need).drop("n_terms").orderBy(F.desc(score), F.asc(id_col)).limit(k)

    found = cut(scored(first))
    floor = found.agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("s")).first()
    others = bounds.join(first.select("block"), "block", "left_anti")
    rest = cut(others.filter(F.col("bound") >= floor.s) if floor.n >= k else others)
    out = found.union(scored(rest)).orderBy(F.desc(score), F.asc(id_col)).limit(k)
    n = lambda df: df.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    return TopK(out, n(first) + n(rest), n(bounds))
