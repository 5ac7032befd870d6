"""Joins, top-k and set operations on the test tables."""

from pyspark.sql import Window

from webfacts.functions.score import similarity_level
from webfacts.functions.vector import cosine
from webfacts.operators import aggregates as agg
from webfacts.operators import joins, search
from webfacts.operators.neighbours import nearest_to
from webfacts.plans.common import COS, HEX, QVEC, F, big, hex_of, r6, t, vector_of
from webfacts.registry import query

NOEMB = "SELECT {i} FROM {tab} WHERE {i} NOT IN (SELECT vec_id FROM embeddings)"


@query("jn_01_fact_page", "SELECT doc_id, url, lang FROM documents JOIN pages ON doc_id = page_id")
def jn_01(spark, d):
    docs, pages = t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "pages").select("page_id", "url")
    return docs.join(pages, docs.doc_id == pages.page_id).select("doc_id", "url", "lang")


@query("jn_02_left_embedding", "SELECT doc_id, label::BIGINT AS label FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def jn_02(spark, d):
    docs, e = t(spark, d, "documents").select("doc_id"), t(spark, d, "embeddings").select("vec_id", "label")
    return docs.join(e, docs.doc_id == e.vec_id, "left").select("doc_id", big("label", "label"))


@query("jn_03_benchmark_preview", "SELECT item_id, left(url, 30) AS preview FROM benchmark LEFT JOIN pages ON item_id = page_id")
def jn_03(spark, d):
    b, p = t(spark, d, "benchmark").select("item_id"), t(spark, d, "pages").select("page_id", "url")
    return b.join(p, b.item_id == p.page_id, "left").select("item_id", F.left("url", F.lit(30)).alias("preview"))


def five_facts(spark, d):
    return {
        "document": t(spark, d, "documents").select(F.col("doc_id").alias("id")),
        "page": t(spark, d, "pages").select(F.col("page_id").alias("id")),
        "benchmark": t(spark, d, "benchmark").select(F.col("item_id").alias("id")),
        "customer": t(spark, d, "customer").select(F.col("c_custkey").alias("id")),
        "part": t(spark, d, "part").select(F.col("p_partkey").alias("id")),
    }


FIVE = {"document": ("doc_id", "documents"), "page": ("page_id", "pages"), "benchmark": ("item_id", "benchmark"), "customer": ("c_custkey", "customer"), "part": ("p_partkey", "part")}
MISSING5 = " UNION ALL ".join(f"SELECT '{n}' AS fact, {i} AS id FROM {tab} WHERE {i} NOT IN (SELECT vec_id FROM embeddings)" for n, (i, tab) in FIVE.items())


@query("jn_04_anti_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def jn_04(spark, d):
    return joins.without_embedding(t(spark, d, "documents").select("doc_id"), t(spark, d, "embeddings"), "doc_id", "vec_id")


@query("jn_05_semi_present", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def jn_05(spark, d):
    return joins.with_embedding(t(spark, d, "documents").select("doc_id"), t(spark, d, "embeddings"), "doc_id", "vec_id")


PROBES = [0, 7, 11, 23]


@query(
    "jn_06_lateral_topk",
    f"""
    SELECT probe_id, vec_id, round(sim, 6) AS similarity FROM (SELECT p.vec_id AS probe_id, c.vec_id, {COS.format(a='p.embedding', b='c.embedding')} AS sim,
      row_number() OVER (PARTITION BY p.vec_id ORDER BY {COS.format(a='p.embedding', b='c.embedding')} DESC, c.vec_id) AS rn
      FROM embeddings p JOIN embeddings c ON p.vec_id <> c.vec_id WHERE p.vec_id IN (0, 7, 11, 23)
        AND {COS.format(a='p.embedding', b='c.embedding')} >= 0.1) WHERE rn <= 5""",
)
def jn_06(spark, d):
    probes = {i: vector_of(spark, d, i) for i in PROBES}
    out = nearest_to(t(spark, d, "embeddings"), "vec_id", "embedding", probes, k=5, min_similarity=0.1)
    return out.select("probe_id", "vec_id", r6("similarity", "similarity"))


@query(
    "jn_07_correlated_percentile",
    "SELECT p_partkey, round(100.0 * cume_dist() OVER (PARTITION BY p_type ORDER BY p_retailprice), 2) AS percentile FROM part",
)
def jn_07(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_type", "p_retailprice")
    return agg.all_percentiles(p, ["p_type"], "p_retailprice").select("p_partkey", "percentile")


RANKS_SQL = """
  v AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank <= 50),
  f AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) AS rank FROM part QUALIFY rank <= 50)"""


def two_lists(spark, d):
    p = t(spark, d, "part")
    v = search.ranked(p, "p_partkey", [F.desc("p_retailprice"), F.asc("p_partkey")], 50)
    f = search.ranked(p, "p_partkey", [F.desc("p_size"), F.desc("p_partkey")], 50)
    return v, f


@query(
    "jn_08_full_outer_merge",
    f"WITH {RANKS_SQL} SELECT coalesce(v.id, f.id) AS id, v.rank AS vector_rank, f.rank AS text_rank FROM v FULL JOIN f ON v.id = f.id",
)
def jn_08(spark, d):
    v, f = two_lists(spark, d)
    return search.fuse({"vector": (v, 0.6), "text": (f, 0.4)}).drop("rrf_score")


def hex2(key):
    return F.lpad(F.lower(F.hex((F.col(key) * 15485863) % 16777216)), 6, "0")


RGBX = "('0x' || substr({h}, 1, 2))::INT AS r, ('0x' || substr({h}, 3, 2))::INT AS g, ('0x' || substr({h}, 5, 2))::INT AS b"


@query(
    "jn_09_color_match",
    f"""
    WITH c AS (SELECT DISTINCT hx, {RGBX.format(h='hx')} FROM (SELECT {HEX.format(k='p_partkey')} AS hx FROM part)),
    q AS (SELECT DISTINCT px, {RGBX.format(h='px')} FROM (SELECT lpad(lower(hex((s_suppkey * 15485863) % 16777216)), 6, '0') AS px FROM supplier)),
    m AS (SELECT hx, px, sqrt(pow(c.r - q.r, 2) + pow(c.g - q.g, 2) + pow(c.b - q.b, 2)) AS dist FROM c, q)
    SELECT hx, min_by(px, (dist, px)) AS px, round(min(dist), 6) AS distance FROM m WHERE dist < 30 GROUP BY hx""",
)
def jn_09(spark, d):
    ours = t(spark, d, "part").select(F.lit(1).alias("project"), hex_of("p_partkey").alias("hx"))
    theirs = t(spark, d, "supplier").select(F.lit(1).alias("project"), hex2("s_suppkey").alias("px"))
    out = joins.nearest_color(ours, theirs, ["project"], "hx", "px")
    return out.select("hx", "px", r6("distance", "distance"))


WORDS = {"nordic": ["tion", "ou"], "latin": ["que", "ción", "ment"], "german": ["sch", "keit", "ung"]}
WORD_ROWS = ", ".join(f"('{c}', '{w}')" for c, ws in WORDS.items() for w in ws)


@query(
    "jn_10_keyword_dictionary",
    f"""
    SELECT doc_id, category, count(*) AS hits FROM documents, (VALUES {WORD_ROWS}) AS k(category, word)
    WHERE contains(lower(text), word) GROUP BY doc_id, category""",
)
def jn_10(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.lower("text").alias("low"))
    return joins.keyword_categories(docs, "low", WORDS).select("doc_id", "category", big("hits", "hits"))


@query(
    "jn_11_viewport_pairs",
    """
    SELECT o_orderkey, vb AS big_width, vs AS small_width, round((o_totalprice / vb) / (o_totalprice / vs), 6) AS ratio FROM orders,
      (VALUES (1440, 768), (1440, 375), (768, 375)) AS v(vb, vs)""",
)
def jn_11(spark, d):
    widths = F.explode(F.array(*[F.lit(w) for w in (1440, 768, 375)]))
    el = t(spark, d, "orders").select("o_orderkey", "o_totalprice", widths.alias("viewport_width"))
    el = el.select("o_orderkey", "viewport_width", (F.col("o_totalprice") / F.col("viewport_width")).alias("font"))
    p = joins.viewport_pairs(el, ["o_orderkey"])
    return p.select(
        "o_orderkey", big("big.viewport_width", "big_width"), big("small.viewport_width", "small_width"), r6(F.col("big.font") / F.col("small.font"), "ratio")
    )


@query(
    "jn_12_palette_tokens",
    f"""
    SELECT n_name, array_to_string(list(hx ORDER BY s_suppkey), ',') AS tokens FROM nation
    LEFT JOIN (SELECT s_nationkey, s_suppkey, {HEX.format(k='s_suppkey')} AS hx FROM supplier) ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def jn_12(spark, d):
    tokens = t(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", hex_of("s_suppkey").alias("hex"))
    out = joins.nested_tokens(t(spark, d, "nation"), tokens, "n_nationkey", "s_suppkey", ["hex"])
    return out.select("n_name", F.array_join(F.transform("tokens", lambda x: x["hex"]), ",").alias("tokens"))


@query("jn_13_project_settings", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def jn_13(spark, d):
    c, n = t(spark, d, "customer").select("c_custkey", "c_nationkey"), t(spark, d, "nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select("c_custkey", "n_name")


@query("top_01_global_topk", "SELECT l_orderkey, l_linenumber::BIGINT AS line, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def top_01(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", big("l_linenumber", "line"), "l_extendedprice")
    return search.page(li, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("line")], 25)


@query("top_02_offset_paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def top_02(spark, d):
    return search.page(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 40)


@query(
    "top_03_per_group_topk",
    "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3",
)
def top_03(spark, d):
    c = t(spark, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal")
    return agg.top_per_key(c, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query(
    "top_04_fetch_then_filter",
    "SELECT p_partkey, p_retailprice FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 60) WHERE p_type = 'ECONOMY'",
)
def top_04(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_retailprice", "p_type")
    return search.page(p, [F.desc("p_retailprice"), F.asc("p_partkey")], 60).filter("p_type = 'ECONOMY'").drop("p_type")


@query("top_05_sorted_listing", "SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC LIMIT 50")
def top_05(spark, d):
    from webfacts.operators.listing import listing

    return listing(t(spark, d, "customer"), "c_name", "desc", 50, {"c_name": "c_name", "c_acctbal": "c_acctbal"}, "c_custkey").select("c_custkey", "c_name")


@query(
    "top_06_multi_key",
    "SELECT o_custkey, o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) = 1",
)
def top_06(spark, d):
    o = t(spark, d, "orders")
    best = F.max_by(F.struct("o_orderpriority", "o_totalprice"), F.struct("o_orderpriority", "o_totalprice", -F.col("o_orderkey")))
    return o.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.*")


@query(
    "top_07_arg_max",
    """
    SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'e' WHEN b >= c THEN 'a' ELSE 'o' END AS best FROM (SELECT doc_id,
      length(text) - length(replace(text, 'e', '')) AS a, length(text) - length(replace(text, 'a', '')) AS b, length(text) - length(replace(text, 'o', '')) AS c FROM documents)""",
)
def top_07(spark, d):
    from webfacts.functions.text import arg_max

    name, _ = arg_max({ch: F.length("text") - F.length(F.replace("text", F.lit(ch), F.lit(""))) for ch in "eao"})
    return t(spark, d, "documents").select("doc_id", name.alias("best"))


@query("set_01_union_all", f"SELECT fact, id FROM ({MISSING5})")
def set_01(spark, d):
    from functools import reduce

    e = t(spark, d, "embeddings")
    parts = [joins.without_embedding(f, e, "id", "vec_id").withColumn("fact", F.lit(n)) for n, f in five_facts(spark, d).items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "set_02_first_wins_union",
    "SELECT id, CASE WHEN min(src) = 0 THEN 'embedding' ELSE 'document' END AS source FROM (SELECT vec_id AS id, 0 AS src FROM embeddings UNION ALL SELECT doc_id, 1 FROM documents) GROUP BY id",
)
def set_02(spark, d):
    a = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("seq"), F.lit("embedding").alias("source"))
    b = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("seq"), F.lit("document").alias("source"))
    return agg.keep_first(a.unionByName(b), ["id"], "seq").select("id", "source")


@query("set_03_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_03(spark, d):
    return t(spark, d, "customer").select("c_custkey").subtract(t(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")))


@query(
    "set_04_array_presence",
    """
    SELECT doc_id, len(list_intersect(w, ['the', 'les', 'der', 'que']))::BIGINT AS n_common, list_has_any(w, ['and', 'und']) AS joins_words
    FROM (SELECT doc_id, list_distinct(string_split(lower(text), ' ')) AS w FROM documents)""",
)
def set_04(spark, d):
    w = t(spark, d, "documents").select("doc_id", F.split(F.lower("text"), " ", -1).alias("w"))
    words = F.array(*[F.lit(x) for x in ("the", "les", "der", "que")])
    return w.select(
        "doc_id", F.size(F.array_intersect("w", words)).cast("long").alias("n_common"), F.arrays_overlap("w", F.array(F.lit("and"), F.lit("und"))).alias("joins_words")
    )


@query("set_05_list_intersection", f"WITH {RANKS_SQL} SELECT v.id FROM v JOIN f ON v.id = f.id")
def set_05(spark, d):
    v, f = two_lists(spark, d)
    both = search.fuse({"vector": (v, 0.6), "text": (f, 0.4)})
    return both.filter("vector_rank IS NOT NULL AND text_rank IS NOT NULL").select("id")


@query(
    "set_06_distinct_values",
    "SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<([a-z0-9]+)', 1)))::BIGINT AS n_tags FROM pages",
)
def set_06(spark, d):
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit("(?i)<([a-z0-9]+)"), F.lit(1)))
    return t(spark, d, "pages").select("page_id", F.size(tags).cast("long").alias("n_tags"))
