"""Vector search, full-text search and rank fusion. One logical plan per search; no Python in the row path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfacts.functions import text
from webfacts.functions.vector import cosine_to
from webfacts.operators.textindex import bm25_part, idf, top_k

RRF_K = 60
VECTOR_WEIGHT, TEXT_WEIGHT = 0.6, 0.4
MAX_RRF = 1.0 / (RRF_K + 1)


def similar(corpus: DataFrame, query: list[float], vector: str = "embedding", where: Column | None = None, min_similarity: float | None = None) -> DataFrame:
    """Corpus rows with ``similarity``; filters sit below the vector arithmetic. No limit."""
    rows = corpus.filter(F.col(vector).isNotNull())
    if where is not None:
        rows = rows.filter(where)
    out = rows.withColumn("similarity", cosine_to(vector, query))
    return out if min_similarity is None else out.filter(F.col("similarity") >= min_similarity)


def knn(corpus: DataFrame, query: list[float], k: int, id_col: str, vector: str = "embedding", where: Column | None = None, min_similarity: float | None = None, offset: int = 0) -> DataFrame:
    """The ``k`` nearest rows by cosine, ties by id: per-task top-k, then one merge of k rows per task."""
    hits = similar(corpus, query, vector, where, min_similarity).drop(vector)
    return page(hits, [F.desc("similarity"), F.asc(id_col)], k, offset)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def total_matches(corpus: DataFrame, vector: str = "embedding", where: Column | None = None) -> DataFrame:
    rows = corpus.filter(F.col(vector).isNotNull())
    return (rows if where is None else rows.filter(where)).agg(F.count(F.lit(1)).alias("total"))


def text_search(docs: DataFrame, query: str, id_col: str, text_col: str, limit: int | None = None) -> DataFrame:
    """Documents holding every query term, with ``text_rank``."""
    terms = text.query_terms(query)
    # a token is a substring of the lower-case text: the cheap test spares most documents the tokenizer
    near = F.lit(bool(terms))
    for term in terms:
        near = near & F.contains(F.lower(F.col(text_col)), F.lit(term))
    hits = (
        docs.filter(near).withColumn("_t", text.tokens(text_col))
        .filter(text.matches_all("_t", terms))
        .withColumn("text_rank", text.text_rank("_t", terms))
        .drop("_t", text_col)
    )
    return hits if limit is None else page(hits, [F.desc("text_rank"), F.asc(id_col)], limit)


def bm25(index: DataFrame, corpus_size: DataFrame, query: str, id_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over :func:`webfacts.operators.textindex.postings`. ``corpus_size`` is one row ``(n_docs, avg_len)``; it enters as scalars."""
    terms = text.query_terms(query)
    hits = index.filter(F.col("term").isin(terms))
    df_per_term = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most len(terms) rows
    n_docs = corpus_size.select("n_docs").scalar()
    avg_len = corpus_size.select("avg_len").scalar()
    joined = hits.join(F.broadcast(df_per_term), "term")
    part = bm25_part(idf(n_docs, F.col("df")), F.col("tf"), F.col("doc_len"), avg_len, k1, b)
    return joined.groupBy(id_col).agg(F.sum(part).alias("bm25"), F.count(F.lit(1)).alias("n_terms")).filter(F.col("n_terms") == len(terms))


def ranked(df: DataFrame, id_col: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``(id, rank)`` of the first ``limit`` rows. The unpartitioned window sees only those rows."""
    top = page(df, order, limit, offset)
    return top.select(F.col(id_col).alias("id"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def rrf_score(rank: Column, weight: float | Column = 1.0, k: int = RRF_K) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w * (F.lit(1.0) / (F.lit(float(k)) + rank))


def fuse(lists: dict[str, tuple[DataFrame, float | Column]], k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of any number of ``(id, rank)`` lists.

    Union plus one aggregation instead of a chain of full outer joins. Output: id, rrf_score, one
    ``<name>_rank`` per list.
    """
    names = list(lists)
    parts = []
    for name, (ranks, weight) in lists.items():
        parts.append(
            ranks.select(
                "id",
                rrf_score(F.col("rank"), weight, k).alias("_s"),
                *[(F.col("rank") if n == name else F.lit(None).cast("long")).alias(f"{n}_rank") for n in names],
            )
        )
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("id")
        .agg(F.sum("_s").alias("rrf_score"), *[F.max(f"{n}_rank").alias(f"{n}_rank") for n in names])
    )


def normalized_rrf(score: Column, max_score: float = MAX_RRF) -> Column:
    return F.least(F.lit(1.0), score / F.lit(max_score))


def hybrid_search(corpus: DataFrame, query_vector: list[float], query_text: str, id_col: str, vector: str = "embedding", text_col: str = "text", where: Column | None = None, min_similarity: float | None = None, limit: int = 10, offset: int = 0, fetch: int = 50, weights: tuple[float, float] = (VECTOR_WEIGHT, TEXT_WEIGHT), text_index: str | None = None) -> DataFrame:
    """Vector list and full-text list, each cut to ``fetch``, fused, normalised, paged.

    An empty text list leaves the vector list, because the union simply has one branch with rows. With ``text_index``
    the text list comes from the stored index in that folder, which must hold the documents of ``corpus`` that
    ``where`` keeps; the texts are not read.
    """
    rows = corpus if where is None else corpus.filter(where)
    near = similar(rows.select(id_col, vector), query_vector, vector, None, min_similarity).drop(vector)
    v = ranked(near, id_col, [F.desc("similarity"), F.asc(id_col)], fetch)
    if text_index is not None:
        hits = top_k(corpus.sparkSession, text_index, query_text, id_col, fetch, "text_rank").rows
    else:
        hits = text_search(rows.select(id_col, text_col), query_text, id_col, text_col)
    t = ranked(hits, id_col, [F.desc("text_rank"), F.asc(id_col)], fetch)
    fused = fuse({"vector": (v, weights[0]), "text": (t, weights[1])})
    out = fused.withColumn("similarity", normalized_rrf(F.col("rrf_score")))
    return page(out, [F.desc("rrf_score"), F.asc("id")], limit, offset)


def coverage_weights(n_text: Column, n_vision: Column, wt: float = VECTOR_WEIGHT, wv: float = TEXT_WEIGHT) -> tuple[Column, Column]:
    """Text and vision weights; a vision list shorter than half the longer list loses weight in proportion."""
    ratio = n_vision / F.greatest(n_text, n_vision)
    low = (ratio < 0.5) & (n_vision > 0)
    vision = F.when(n_vision == 0, F.lit(0.0)).when(low, F.lit(wv) * ratio / 0.5).otherwise(F.lit(wv))
    words = F.when(n_vision == 0, F.lit(1.0)).when(low, 1 - vision).otherwise(F.lit(wt))
    return words, vision


def fuse_by_coverage(text_list: DataFrame, vision_list: DataFrame, wt: float = VECTOR_WEIGHT, wv: float = TEXT_WEIGHT) -> DataFrame:
    """RRF whose weights follow the two list lengths; the lengths are scalar subqueries, not a join."""
    nt = text_list.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    nv = vision_list.agg(F.count(F.lit(1)).cast("double").alias("n")).scalar()
    w_text, w_vision = coverage_weights(nt, nv, wt, wv)
    return fuse({"text": (text_list, w_text), "vision": (vision_list, w_vision)})


def combine_similarities(lists: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of similarities by id, a missing list counts 0. Lists are ``(id, similarity)``."""
    names = list(lists)
    parts = [
        df.select("id", *[(F.col("similarity") if n == name else F.lit(None).cast("double")).alias(n) for n in names])
        for name, (df, _) in lists.items()
    ]
    merged = reduce(DataFrame.unionByName, parts).groupBy("id").agg(*[F.max(n).alias(n) for n in names])
    total = F.lit(0.0)
    for name, (_, w) in lists.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * F.lit(float(w))
    return merged.withColumn("similarity", total)


def check_weights(mood: float, brand: float) -> None:
    """Both within 0..1 and together at most 1 (with a small tolerance)."""
    if not (0 <= mood <= 1 and 0 <= brand <= 1) or mood + brand > 1.001:
        raise ValueError("weights must lie in [0, 1] and sum to at most 1")


def context_boost(text_col: Column, industry_words: list[str] | None, style_words: list[str] | None, confidence: float) -> Column:
    """Bonus for result texts that speak the language of the inferred industry and style, at most 0.15."""
    if confidence < 0.5 or (industry_words is None and style_words is None):
        return F.lit(0.0)
    low = F.lower(text_col)
    boost = F.lit(0.0)
    if industry_words:
        boost = boost + F.least(F.lit(0.1), text.keyword_hits(low, industry_words) * 0.02)
    if style_words:
        boost = boost + F.least(F.lit(0.05), text.keyword_hits(low, style_words) * 0.01)
    return F.least(F.lit(0.15), boost * F.lit(float(confidence)))


def merge_sources(limit: int, order: list[Column], *results: DataFrame) -> DataFrame:
    """Result lists with different columns in one schema, best first."""
    return page(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), results), order, limit)
