"""Vector similarity, hybrid search and fusion on the test tables."""

from webfacts.functions import vector
from webfacts.functions.score import similarity_level
from webfacts.operators import nearindex, neighbours, search, textindex
from webfacts.plans.common import COS, QVEC, F, big, r6, t, vector_of
from webfacts.plans.relational import RANKS_SQL, two_lists
from webfacts.plans.scalars import DOC_TOKENS
from webfacts.registry import query

SIM0 = COS.format(a="embedding", b=QVEC.format(i=0))


def emb(spark, d):
    return t(spark, d, "embeddings")


@query(
    "vec_01_cosine",
    f"SELECT vec_id, round({SIM0}, 6) AS similarity FROM embeddings",
)
def vec_01(spark, d):
    q = vector.vector_literal(vector_of(spark, d, 0))
    return emb(spark, d).select("vec_id", r6(vector.cosine("embedding", q), "similarity"))


@query("vec_02_knn", f"SELECT vec_id, round({SIM0}, 6) AS similarity FROM embeddings WHERE label <> 5 ORDER BY {SIM0} DESC, vec_id LIMIT 10 OFFSET 2")
def vec_02(spark, d):
    out = search.knn(emb(spark, d), vector_of(spark, d, 0), 10, "vec_id", where=F.col("label") != 5, offset=2)
    return out.select("vec_id", r6("similarity", "similarity"))


@query("vec_03_total", "SELECT count(*) AS total FROM embeddings WHERE embedding IS NOT NULL AND label <> 5")
def vec_03(spark, d):
    return search.total_matches(emb(spark, d), where=F.col("label") != 5)


PAIR = COS.format(a="a.embedding", b="b.embedding")


@query(
    "vec_04_knn_join",
    f"""
    SELECT vec_id, neighbour_id, round(sim, 6) AS similarity, rn AS rank FROM (SELECT a.vec_id, b.vec_id AS neighbour_id, {PAIR} AS sim,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY {PAIR} DESC, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
      WHERE {PAIR} >= 0.3) WHERE rn <= 5""",
)
def vec_04(spark, d):
    out = neighbours.knn_join(emb(spark, d), "vec_id", "embedding", 5, 0.3)
    return out.select("vec_id", "neighbour_id", r6("similarity", "similarity"), "rank")


@query(
    "vec_04b_knn_join_cells",
    f"""
    SELECT vec_id, neighbour_id, round(sim, 6) AS similarity, rn AS rank FROM (SELECT a.vec_id, b.vec_id AS neighbour_id, {PAIR} AS sim,
      row_number() OVER (PARTITION BY a.vec_id ORDER BY {PAIR} DESC, b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
      WHERE {PAIR} >= 0.3) WHERE rn <= 5""",
)
def vec_04b(spark, d):
    """As vec_04 over several cells, so that the second round has cells to visit."""
    out = neighbours.knn_join(emb(spark, d), "vec_id", "embedding", 5, 0.3, pivots_wanted=12)
    return out.select("vec_id", "neighbour_id", r6("similarity", "similarity"), "rank")


ANN = nearindex.Settings(64)
ANN_PLANES = ", ".join(f"({i // ANN.bits}, {i % ANN.bits}, [{', '.join(f'{x:.3f}' for x in row)}]::DOUBLE[])" for i, row in enumerate(nearindex.planes(ANN)))


@query(
    "vec_05_lsh_knn",
    f"""
    WITH planes(tab, bit, p) AS (VALUES {ANN_PLANES}),
    unit AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
    far AS (SELECT vec_id, tab, bit, list_dot_product(v, p) / sqrt(list_dot_product(v, v)) AS d FROM unit, planes),
    codes AS (SELECT vec_id, tab, sum(CASE WHEN d >= 0 THEN 1 << bit ELSE 0 END)::BIGINT AS bucket FROM far GROUP BY ALL),
    flips AS (SELECT vec_id, tab, bit, row_number() OVER (PARTITION BY vec_id, tab ORDER BY abs(d), bit) AS rn FROM far WHERE vec_id % 100 = 0),
    asked AS (SELECT vec_id AS q, tab, bucket FROM codes WHERE vec_id % 100 = 0
      UNION ALL SELECT vec_id, tab, xor(bucket, (1 << bit)::BIGINT) FROM codes JOIN flips USING (vec_id, tab) WHERE rn <= {nearindex.PROBES}),
    met AS (SELECT DISTINCT q, vec_id FROM asked JOIN codes USING (tab, bucket) WHERE q <> vec_id),
    sims AS (SELECT q, b.vec_id, {PAIR} AS s FROM met JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = met.vec_id)
    SELECT q AS query_id, vec_id AS neighbour_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank
    FROM sims QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) <= 10""",
)
def vec_05(spark, d):
    """Every hundredth vector searched in a stored index of all; a tenth of the rows is appended after the rest."""
    import uuid

    from webfacts.session import ensure_checkpoint_dir

    rows, path = emb(spark, d), f"{ensure_checkpoint_dir(spark)}/near-{uuid.uuid4().hex}"
    late = F.col("vec_id") % 10 == 0
    nearindex.store(rows.filter(~late), "vec_id", "embedding", path, ANN)
    nearindex.append(rows.filter(late), "vec_id", "embedding", path)
    out = nearindex.search(spark, path, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    return out.select("query_id", "neighbour_id", r6("similarity", "similarity"), "rank")


MATCH = f"SELECT doc_id, k FROM (SELECT doc_id, {DOC_TOKENS} AS k FROM documents) WHERE list_contains(k, 'les') AND list_contains(k, 'dans')"
RANK_SQL = "(len(list_filter(k, lambda x: x = 'les')) + len(list_filter(k, lambda x: x = 'dans'))) / (1 + ln(greatest(len(k), 1)))"


@query("vec_06_text_match", f"SELECT doc_id FROM ({MATCH})")
def vec_06(spark, d):
    return search.text_search(t(spark, d, "documents").select("doc_id", "text"), "les dans", "doc_id", "text").select("doc_id")


@query("vec_07_text_rank", f"SELECT doc_id, round({RANK_SQL}, 6) AS text_rank FROM ({MATCH})")
def vec_07(spark, d):
    out = search.text_search(t(spark, d, "documents").select("doc_id", "text"), "les dans", "doc_id", "text")
    return out.select("doc_id", r6("text_rank", "text_rank"))


BM25_SQL = f"""
    WITH dt AS (SELECT doc_id, {DOC_TOKENS} AS k FROM documents), st AS (SELECT count(*) AS n, avg(len(k)) AS al FROM dt),
    p AS (SELECT doc_id, len(k) AS dl, w AS term, len(list_filter(k, lambda x: x = w)) AS tf FROM dt, (VALUES ('les'), ('dans')) AS q(w) WHERE list_contains(k, w)),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al))), 6) AS bm25
    FROM p JOIN df USING (term), st GROUP BY doc_id HAVING count(*) = 2"""


@query("vec_07b_bm25", BM25_SQL)
def vec_07b(spark, d):
    from webfacts.functions.text import query_terms, tokens

    docs = t(spark, d, "documents").select("doc_id", "text")
    size = docs.agg(F.count(F.lit(1)).cast("double").alias("n_docs"), F.avg(F.size(tokens("text"))).alias("avg_len"))
    out = search.bm25(textindex.postings(docs, "doc_id", "text", query_terms("les dans")), size, "les dans", "doc_id")
    return out.select("doc_id", r6("bm25", "bm25"))


@query("vec_07c_stored_bm25", BM25_SQL)
def vec_07c(spark, d):
    import uuid

    from webfacts.session import ensure_checkpoint_dir

    docs, path = t(spark, d, "documents").select("doc_id", "text"), f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    late = F.col("doc_id") % 10 == 0
    textindex.store(docs.filter(~late), path, "doc_id", "text")
    textindex.store(docs.filter(late), path, "doc_id", "text", mode="append")
    index, size = textindex.stored_postings(spark, path, "les dans", "doc_id")
    return search.bm25(index, size, "les dans", "doc_id").select("doc_id", r6("bm25", "bm25"))


@query("vec_07d_block_max_top_k", f"SELECT * FROM ({BM25_SQL.strip().removesuffix(';')}) ORDER BY bm25 DESC, doc_id LIMIT 20")
def vec_07d(spark, d):
    """The best twenty documents from a stored index, read by falling block bounds."""
    import uuid

    from webfacts.session import ensure_checkpoint_dir

    docs, path = t(spark, d, "documents").select("doc_id", "text"), f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    textindex.store(docs, path, "doc_id", "text", span=16)
    return textindex.top_k(spark, path, "les dans", "doc_id", 20).rows.select("doc_id", r6("bm25", "bm25"))


@query("vec_08_rrf_weight", "SELECT event_id, round(1.0::DOUBLE / (60 + 1 + event_id), 9) AS w FROM events")
def vec_08(spark, d):
    return t(spark, d, "events").select("event_id", F.round(search.rrf_score(F.col("event_id") + 1), 9).alias("w"))


FUSED = """
  u AS (SELECT id, 0.6::DOUBLE / (60 + rank) AS s, rank AS vector_rank, NULL::BIGINT AS text_rank FROM v UNION ALL
        SELECT id, 0.4::DOUBLE / (60 + rank), NULL, rank FROM f),
  m AS (SELECT id, sum(s) AS rrf, max(vector_rank) AS vector_rank, max(text_rank) AS text_rank FROM u GROUP BY id)"""


@query("vec_09_rrf_merge", f"WITH {RANKS_SQL}, {FUSED} SELECT id, round(rrf, 9) AS rrf_score, vector_rank, text_rank FROM m")
def vec_09(spark, d):
    v, f = two_lists(spark, d)
    out = search.fuse({"vector": (v, 0.6), "text": (f, 0.4)})
    return out.select("id", F.round("rrf_score", 9).alias("rrf_score"), "vector_rank", "text_rank")


@query("vec_10_rrf_normalized", f"WITH {RANKS_SQL}, {FUSED} SELECT id, round(least(1.0, rrf * 61), 6) AS similarity FROM m")
def vec_10(spark, d):
    v, f = two_lists(spark, d)
    out = search.fuse({"vector": (v, 0.6), "text": (f, 0.4)})
    return out.select("id", r6(search.normalized_rrf(F.col("rrf_score")), "similarity"))


@query(
    "vec_11_hybrid_search",
    f"""
    WITH c AS (SELECT doc_id, embedding, {DOC_TOKENS} AS k FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang <> 'xx'),
    v AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {SIM0} DESC, doc_id) AS rank FROM c QUALIFY rank <= 50),
    f AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {RANK_SQL} DESC, doc_id) AS rank FROM c
      WHERE list_contains(k, 'les') AND list_contains(k, 'dans') QUALIFY rank <= 50), {FUSED}
    SELECT id, round(least(1.0, rrf * 61), 6) AS similarity, vector_rank, text_rank FROM m ORDER BY rrf DESC, id LIMIT 10""",
)
def hybrid(spark, d):
    docs, e = t(spark, d, "documents").select("doc_id", "text", "lang"), emb(spark, d)
    corpus = docs.join(e, docs.doc_id == e.vec_id)
    out = search.hybrid_search(corpus, vector_of(spark, d, 0), "les dans", "doc_id", where=F.col("lang") != "xx")
    return out.select("id", r6("similarity", "similarity"), "vector_rank", "text_rank")


@query(
    "vec_12_coverage_weights",
    f"""
    WITH v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {SIM0} DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50),
    f AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS.format(a='embedding', b=QVEC.format(i=1))} DESC, vec_id) AS rank FROM embeddings WHERE label = 2 QUALIFY rank <= 20),
    n AS (SELECT (SELECT count(*) FROM v) AS nv, (SELECT count(*) FROM f) AS nf),
    w AS (SELECT CASE WHEN nf * 1.0 / greatest(nv, nf) < 0.5 THEN 0.4 * (nf * 1.0 / greatest(nv, nf)) / 0.5 ELSE 0.4 END::DOUBLE AS wv,
      nf * 1.0 / greatest(nv, nf) < 0.5 AS low FROM n),
    u AS (SELECT id, (CASE WHEN low THEN 1 - wv ELSE 0.6 END) / (60 + rank) AS s FROM v, w UNION ALL SELECT id, wv / (60 + rank) FROM f, w)
    SELECT id, round(sum(s), 9) AS rrf_score FROM u GROUP BY id""",
)
def vec_12(spark, d):
    q0, q1 = vector_of(spark, d, 0), vector_of(spark, d, 1)
    order = [F.desc("similarity"), F.asc("vec_id")]
    texts = search.ranked(search.similar(emb(spark, d), q0), "vec_id", order, 50)
    vision = search.ranked(search.similar(emb(spark, d), q1, where=F.col("label") == 2), "vec_id", order, 20)
    return search.fuse_by_coverage(texts, vision).select("id", F.round("rrf_score", 9).alias("rrf_score"))


SIM1 = COS.format(a="embedding", b=QVEC.format(i=1))


@query("vec_13_multimodal", f"SELECT vec_id, round(0.6 * {SIM0} + 0.4 * {SIM1}, 6) AS similarity FROM embeddings")
def vec_13(spark, d):
    a, b = (vector.cosine_to("embedding", vector_of(spark, d, i)) for i in (0, 1))
    return emb(spark, d).select("vec_id", r6(a * 0.6 + b * 0.4, "similarity"))


@query("vec_14_mood_search", f"SELECT vec_id, round({SIM0}, 6) AS similarity FROM embeddings WHERE {SIM0} >= 0.1")
def vec_14(spark, d):
    return search.similar(emb(spark, d), vector_of(spark, d, 0), min_similarity=0.1).select("vec_id", r6("similarity", "similarity"))


@query("vec_15_brand_tone_search", f"SELECT vec_id, round({SIM1}, 6) AS similarity FROM embeddings WHERE {SIM1} >= 0.1")
def vec_15(spark, d):
    return search.similar(emb(spark, d), vector_of(spark, d, 1), min_similarity=0.1).select("vec_id", r6("similarity", "similarity"))


@query(
    "vec_16_mood_brand_combined",
    f"""
    WITH m AS (SELECT vec_id AS id, {SIM0} AS s FROM embeddings WHERE {SIM0} >= 0.1), b AS (SELECT vec_id AS id, {SIM1} AS s FROM embeddings WHERE {SIM1} >= 0.1),
    c AS (SELECT coalesce(m.id, b.id) AS id, 0.6 * coalesce(m.s, 0) + 0.4 * coalesce(b.s, 0) AS s FROM m FULL JOIN b ON m.id = b.id)
    SELECT id, round(s, 6) AS similarity, round((SELECT avg(s) FROM c), 6) AS average FROM c""",
)
def vec_16(spark, d):
    def found(i):
        return search.similar(emb(spark, d), vector_of(spark, d, i), min_similarity=0.1).select(F.col("vec_id").alias("id"), "similarity")

    search.check_weights(0.6, 0.4)
    out = search.combine_similarities({"mood": (found(0), 0.6), "brand": (found(1), 0.4)})
    average = out.agg(F.avg("similarity").alias("a")).scalar()
    return out.select("id", r6("similarity", "similarity"), F.round(average, 6).alias("average"))


@query(
    "vec_18_weighted_combine",
    """
    WITH c AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: 0.6 * p[1] + 0.4 * p[2]) AS v
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM c""",
)
def vec_18(spark, d):
    a = emb(spark, d).select("vec_id", "embedding")
    b = emb(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    v = a.join(b, "vec_id").select("vec_id", vector.weighted_sum("embedding", "other", 0.6, 0.4).alias("v"))
    return v.select("vec_id", r6(F.col("v")[0], "first"), r6(F.col("v")[63], "last"))


@query(
    "vec_19_degraded_combine",
    """
    WITH c AS (SELECT doc_id, e.vec_id IS NOT NULL AS has_text, p.page_id IS NOT NULL AND e.vec_id IS NOT NULL AS has_vision FROM documents
      LEFT JOIN embeddings e ON doc_id = e.vec_id LEFT JOIN pages p ON doc_id = page_id)
    SELECT doc_id, CASE WHEN has_text AND has_vision THEN 'combined' WHEN has_text THEN 'text' ELSE 'none' END AS used FROM c""",
)
def vec_19(spark, d):
    docs, e = t(spark, d, "documents").select("doc_id"), emb(spark, d)
    p = t(spark, d, "pages").select("page_id")
    rows = docs.join(e, docs.doc_id == e.vec_id, "left").join(p, docs.doc_id == p.page_id, "left")
    rows = rows.withColumn("vision", F.when(F.col("page_id").isNotNull(), F.transform("embedding", lambda x: -x * 2)))
    combined = vector.weighted_sum("embedding", "vision", 0.6, 0.4)
    used = F.when(combined.isNull(), "none").when(F.col("vision").isNull(), "text").when(F.col("embedding").isNull(), "vision").otherwise("combined")
    return rows.select("doc_id", used.alias("used"))


@query(
    "vec_20_normalize",
    """
    SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / n)), 6) AS total, round(embedding[1] / n, 6) AS first
    FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)""",
)
def vec_20(spark, d):
    v = emb(spark, d).select("vec_id", vector.l2_normalize("embedding").alias("v"))
    return v.select("vec_id", r6(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), "total"), r6(F.col("v")[0], "first"))


@query(
    "vec_21_uniqueness",
    f"""
    SELECT e.vec_id, e.label::BIGINT AS label, round(1 - greatest(0, coalesce(m, 0)), 6) AS uniqueness FROM embeddings e LEFT JOIN
      (SELECT a.vec_id, max({PAIR}) AS m FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id) x ON x.vec_id = e.vec_id""",
)
def vec_21(spark, d):
    out = neighbours.uniqueness(emb(spark, d), "vec_id", "embedding", "label")
    return out.select("vec_id", big("label", "label"), r6("uniqueness", "uniqueness"))


@query(
    "vec_22_similarity_level",
    f"SELECT vec_id, CASE WHEN {SIM0} > 0.85 THEN 'high' WHEN {SIM0} >= 0.7 THEN 'medium' ELSE 'low' END AS level FROM embeddings",
)
def vec_22(spark, d):
    return emb(spark, d).select("vec_id", similarity_level(vector.cosine_to("embedding", vector_of(spark, d, 0))).alias("level"))


@query(
    "vec_23_similar_benchmarks",
    f"SELECT item_id, round({SIM1}, 6) AS similarity FROM benchmark JOIN embeddings ON item_id = vec_id WHERE {SIM1} >= 0.0 ORDER BY {SIM1} DESC, item_id LIMIT 5",
)
def vec_23(spark, d):
    b, e = t(spark, d, "benchmark").select("item_id"), emb(spark, d)
    out = search.knn(b.join(e, b.item_id == e.vec_id), vector_of(spark, d, 1), 5, "item_id", min_similarity=0.0)
    return out.select("item_id", r6("similarity", "similarity"))


@query(
    "vec_24_similar_narratives",
    f"SELECT doc_id, lang, round({SIM0}, 6) AS similarity FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'fr' ORDER BY {SIM0} DESC, doc_id LIMIT 8",
)
def vec_24(spark, d):
    docs, e = t(spark, d, "documents").select("doc_id", "lang"), emb(spark, d)
    out = search.knn(docs.join(e, docs.doc_id == e.vec_id), vector_of(spark, d, 0), 8, "doc_id", where=F.col("lang") == "fr")
    return out.select("doc_id", "lang", r6("similarity", "similarity"))


IND, STY = ["que", "pour", "avec"], ["tion", "the"]


def _hits(words):
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


@query(
    "vec_25_context_boost",
    f"""
    WITH c AS (SELECT doc_id, {SIM0} AS sim, least(0.15, 0.8 * (least(0.1, 0.02 * ({_hits(IND)})) + least(0.05, 0.01 * ({_hits(STY)}))))::DOUBLE AS boost
      FROM documents JOIN embeddings ON doc_id = vec_id ORDER BY sim DESC, doc_id LIMIT 50)
    SELECT doc_id, round(boost, 6) AS boost, round(least(1.0, sim + boost), 6) AS similarity FROM c ORDER BY sim + boost DESC, doc_id LIMIT 20""",
)
def vec_25(spark, d):
    docs, e = t(spark, d, "documents").select("doc_id", "text"), emb(spark, d)
    top = search.knn(docs.join(e, docs.doc_id == e.vec_id), vector_of(spark, d, 0), 50, "doc_id")
    boosted = top.withColumn("boost", search.context_boost(F.col("text"), IND, STY, 0.8))
    again = search.page(boosted, [F.desc(F.col("similarity") + F.col("boost")), F.asc("doc_id")], 20)
    return again.select("doc_id", r6("boost", "boost"), r6(F.least(F.lit(1.0), F.col("similarity") + F.col("boost")), "similarity"))


@query(
    "vec_26_merged_sources",
    """
    SELECT source, id, sim FROM (SELECT 'css' AS source, p_partkey AS id, p_retailprice / 2000 AS sim FROM part
      UNION ALL SELECT 'js', s_suppkey, s_acctbal / 10000 FROM supplier) ORDER BY sim DESC, source, id LIMIT 30""",
)
def vec_26(spark, d):
    css = t(spark, d, "part").select(F.lit("css").alias("source"), F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("sim"), "p_type")
    js = t(spark, d, "supplier").select(F.lit("js").alias("source"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 10000).alias("sim"), "s_name")
    return search.merge_sources(30, [F.desc("sim"), F.asc("source"), F.asc("id")], css, js).select("source", "id", "sim")


@query(
    "vec_28_clamped_dot",
    "SELECT vec_id, round(greatest(-1, least(1, list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]))), 6) AS sim FROM embeddings",
)
def vec_28(spark, d):
    q = vector.vector_literal(vector_of(spark, d, 0))
    return emb(spark, d).select("vec_id", r6(vector.clamped_dot("embedding", q), "sim"))
