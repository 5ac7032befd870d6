"""Aggregations, windows and series on the test tables."""

from webfacts.operators import aggregates as agg
from webfacts.operators import joins, sections, series
from webfacts.operators.filters import newer_than
from webfacts.operators.ordered import OrderedRows
from webfacts.plans.common import HEX, F, big, hex_of, r6, t
from webfacts.plans.relational import FIVE, MISSING5, five_facts
from webfacts.registry import query


def ev(spark, d):
    return t(spark, d, "events")


@query(
    "agg_01_narrative_stats",
    """
    SELECT lang AS mood, count(*) AS n, round(avg(n_chars), 6) AS avg_confidence, count(vec_id) AS with_embedding, max(doc_id) AS latest
    FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY lang""",
)
def agg_01(spark, d):
    docs, e = t(spark, d, "documents").select("doc_id", "lang", "n_chars"), t(spark, d, "embeddings").select("vec_id")
    out = agg.narrative_stats(docs.join(e, docs.doc_id == e.vec_id, "left"), "lang", "n_chars", "vec_id", "doc_id")
    return out.withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "agg_02_industry_averages",
    """
    SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS avg, quantile_cont(o_totalprice, 0.5) AS median, round(quantile_cont(o_totalprice, 0.9), 6) AS p90
    FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAYS GROUP BY 1 HAVING count(*) >= 10""",
)
def agg_02(spark, d):
    o = t(spark, d, "orders").select("o_orderpriority", "o_totalprice", "o_orderdate")
    recent = o.filter(newer_than("o_orderdate", o.agg(F.max("o_orderdate").alias("m")).scalar()))
    return agg.industry_averages(recent, "o_orderpriority", "o_totalprice").withColumn("p90", F.round("p90", 6))


@query(
    "agg_03_section_benchmarks",
    """
    SELECT p_type, count(*) AS n, round(avg(p_retailprice), 6) AS avg_score, min(p_retailprice) AS min_score, max(p_retailprice) AS max_score,
      array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS industries FROM part GROUP BY p_type""",
)
def agg_03(spark, d):
    out = agg.section_benchmarks(t(spark, d, "part"), "p_type", "p_retailprice", "p_brand")
    return out.withColumns({"avg_score": F.round("avg_score", 6), "industries": F.array_join("industries", "|")})


@query("agg_04_conditional_count", "SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal > 0) AS positive FROM customer GROUP BY 1")
def agg_04(spark, d):
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 0).alias("positive"))


@query("agg_05_score_percentile", "SELECT round(100.0::DOUBLE * count(*) FILTER (WHERE o_totalprice <= 250000) / count(*), 2) AS percentile FROM orders")
def agg_05(spark, d):
    return agg.score_percentile(t(spark, d, "orders"), "o_totalprice", 250000)


@query("agg_06_missing_per_page", f"SELECT id, count(*) AS missing FROM ({MISSING5}) GROUP BY id")
def agg_06(spark, d):
    e = t(spark, d, "embeddings")
    return agg.missing_per_page([joins.without_embedding(f, e, "id", "vec_id") for f in five_facts(spark, d).values()], "id")


COVER = " UNION ALL ".join(
    f"SELECT '{n}' AS fact, count(*) AS total, count(vec_id) AS embedded, count(*) - count(vec_id) AS missing, round(count(vec_id) * 1.0 / count(*), 6) AS ratio FROM {tab} LEFT JOIN embeddings ON {i} = vec_id"
    for n, (i, tab) in FIVE.items()
)


@query("agg_07_coverage", COVER)
def agg_07(spark, d):
    e = t(spark, d, "embeddings")
    return agg.coverage({n: (f, "id", e, "vec_id") for n, f in five_facts(spark, d).items()}).withColumn("ratio", F.round("ratio", 6))


@query("agg_08_distinct_over_or", "SELECT count(DISTINCT o_custkey) AS n FROM orders WHERE o_totalprice > 400000 OR o_orderpriority = '1-URGENT'")
def agg_08(spark, d):
    o = t(spark, d, "orders").filter((F.col("o_totalprice") > 400000) | (F.col("o_orderpriority") == "1-URGENT"))
    return o.agg(F.countDistinct("o_custkey").alias("n"))


FLOORP = "list_sort(list(value))[1 + least(count(*) * {p} // 100, count(*) - 1)]"
STATS_SQL = f"""SELECT event_type, count(*) AS n, avg(value) AS avg, min(value) AS min, max(value) AS max,
   {FLOORP.format(p=50)} AS p50, {FLOORP.format(p=95)} AS p95, {FLOORP.format(p=99)} AS p99 FROM events GROUP BY event_type"""
POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("agg_09_latency_floor_index", f"SELECT event_type, n, round(avg, 6) AS avg, min, max, p50, p95, p99 FROM ({STATS_SQL})")
def agg_09(spark, d):
    return agg.floor_percentiles(ev(spark, d), ["event_type"], "value", POINTS).withColumn("avg", F.round("avg", 6))


@query(
    "agg_10_latency_interpolated",
    """
    SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
    FROM events GROUP BY event_type""",
)
def agg_10(spark, d):
    out = agg.exact_percentiles(ev(spark, d), ["event_type"], "value", POINTS)
    return out.select("event_type", "n", *[F.round(p, 6).alias(p) for p in POINTS])


@query(
    "agg_11_slo_violations",
    """
    SELECT event_type, count(*) AS n, (count(*) FILTER (WHERE value > CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 30 END))::BIGINT AS violations FROM events GROUP BY 1""",
)
def agg_11(spark, d):
    return agg.slo_violations(ev(spark, d), "event_type", "value", {"view": 20.0, "click": 30.0})


@query("agg_12_slow_queries", "SELECT event_id, value FROM events WHERE value > 40")
def agg_12(spark, d):
    return ev(spark, d).filter("value > 40").select("event_id", "value")


@query("agg_13_hourly_stats", "SELECT hour(ts)::BIGINT AS hour, count(*) AS n, round(avg(value), 6) AS avg FROM events GROUP BY 1")
def agg_13(spark, d):
    return agg.hourly_stats(ev(spark, d), "ts", "value").select(big("hour", "hour"), "n", r6("avg", "avg"))


SCALED = STATS_SQL.replace("FROM events", "FROM (SELECT event_type, value * 8 AS value FROM events)")


@query(
    "agg_14_suggestions",
    f"""
    WITH s AS ({SCALED}) SELECT event_type, 'index' AS kind, CASE WHEN p95 > 200 THEN 'high' ELSE 'medium' END AS priority FROM s WHERE p95 > 100
    UNION ALL SELECT event_type, 'rewrite', 'high' FROM s WHERE p99 > 500
    UNION ALL SELECT event_type, 'caching', CASE WHEN n > 500 THEN 'high' ELSE 'medium' END FROM s WHERE n > 100 AND avg > 50""",
)
def agg_14(spark, d):
    scaled = ev(spark, d).select("event_type", (F.col("value") * 8).alias("value"))
    return agg.suggestions(agg.floor_percentiles(scaled, ["event_type"], "value", POINTS), "event_type")


FLAGS = ["A", "N", "R"]


@query(
    "agg_15_motion_summary",
    """
    SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS type_A, count(*) FILTER (WHERE l_returnflag = 'N') AS type_N,
      count(*) FILTER (WHERE l_returnflag = 'R') AS type_R, count(*) FILTER (WHERE l_linestatus = 'O') AS trigger_O, count(*) FILTER (WHERE l_linestatus = 'F') AS trigger_F,
      round(avg(l_quantity), 6) AS avg_duration, bool_or(l_quantity = 50) AS has_infinite FROM lineitem GROUP BY l_orderkey""",
)
def agg_15(spark, d):
    li = t(spark, d, "lineitem").select(
        "l_orderkey",
        F.col("l_returnflag").alias("type"),
        F.col("l_linestatus").alias("trigger"),
        F.col("l_quantity").alias("duration"),
        F.when(F.col("l_quantity") == 50, "infinite").otherwise("1").alias("iterations"),
    )
    return agg.motion_summary(li, "l_orderkey", FLAGS, ["O", "F"]).withColumn("avg_duration", F.round("avg_duration", 6))


@query(
    "agg_16_difference_summary",
    """
    SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS A, count(*) FILTER (WHERE l_returnflag = 'N') AS N,
      count(*) FILTER (WHERE l_returnflag = 'R') AS R, count(*) FILTER (WHERE l_returnflag = 'R') > 0 AS has_r FROM lineitem GROUP BY 1""",
)
def agg_16(spark, d):
    li = t(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("category"))
    return agg.difference_summary(li, "l_suppkey", FLAGS, {"has_r": "R"})


@query(
    "agg_17_merge_by_key",
    """
    SELECT conv_id, arg_min(role, turn) AS role, arg_max(length(text), turn)::BIGINT AS n_chars FROM conversations GROUP BY conv_id""",
)
def agg_17(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
    return agg.merge_by_key(c, ["conv_id"], "turn", ["role"], ["n_chars"])


@query(
    "agg_18_keep_first",
    r"""
    SELECT key, min(doc_id) AS doc_id FROM (SELECT doc_id, md5(lang || ':' || trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'))) AS key FROM documents) GROUP BY key""",
)
def agg_18(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.md5(agg.background_key("lang", "text")).alias("key"))
    return agg.keep_first(docs, ["key"], "doc_id")


@query(
    "agg_19_color_histogram",
    """
    WITH c AS (SELECT lpad(lower(hex(p_size * 1000)), 6, '0') AS hx FROM part) SELECT hx, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY hx""",
)
def agg_19(spark, d):
    c = t(spark, d, "part").select(F.lpad(F.lower(F.hex(F.col("p_size") * 1000)), 6, "0").alias("hx"))
    return agg.color_histogram(c, "hx").withColumn("share", F.round("share", 6))


@query("agg_20_palette_quantized")
def agg_20(spark, d):
    from webfacts.functions.color import channel

    c = t(spark, d, "part").select(hex_of("p_partkey").alias("hx")).groupBy("hx").agg(F.count(F.lit(1)).alias("n"))
    return agg.quantize_palette(c.select("n", *[channel("hx", i).alias(x) for i, x in enumerate("rgb")]), 8)


@query("agg_21_distinct_counts", "SELECT source, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def agg_21(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"))


@query(
    "agg_22_batch_abort",
    """
    WITH f AS (SELECT *, l_quantity = 50 AND l_discount = 0.1 AND l_tax = 0.08 AS failed, l_orderkey * 10 + l_linenumber AS idx FROM lineitem),
    k AS (SELECT * FROM f WHERE idx <= (SELECT coalesce(min(idx), 9223372036854775807) FROM f WHERE failed))
    SELECT count(*) AS total, (count(*) FILTER (WHERE NOT failed))::BIGINT AS succeeded, (count(*) FILTER (WHERE failed))::BIGINT AS failed FROM k""",
)
def agg_22(spark, d):
    li = t(spark, d, "lineitem").withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    failed = (F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08)
    return agg.batch_totals(agg.batch_result(li, "idx", failed, "abort"))


@query("agg_23_variance", "SELECT user_id, round(var_pop(value), 6) AS variance, round(stddev_pop(value), 6) AS stddev FROM events GROUP BY user_id")
def agg_23(spark, d):
    return ev(spark, d).groupBy("user_id").agg(r6(F.var_pop("value"), "variance"), r6(F.stddev_pop("value"), "stddev"))


ANG = "(SELECT user_id, ((event_id * 37) % 360)::DOUBLE AS a FROM events)"
MEAN_DEG = "CASE WHEN degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))) < 0 THEN degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))) + 360 ELSE degrees(atan2(avg(sin(radians(a))), avg(cos(radians(a))))) END"


def angles(spark, d):
    return ev(spark, d).select("user_id", ((F.col("event_id") * 37) % 360).cast("double").alias("a"))


@query("agg_24_circular_mean", f"SELECT user_id, round({MEAN_DEG}, 4) AS mean_direction FROM {ANG} GROUP BY user_id")
def agg_24(spark, d):
    return angles(spark, d).groupBy("user_id").agg(F.round(agg.circular_mean(F.col("a")), 4).alias("mean_direction"))


@query(
    "agg_25_hue_variance",
    f"SELECT user_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(1 - sqrt(pow(avg(sin(radians(a))), 2) + pow(avg(cos(radians(a))), 2)), 6) END AS variance FROM {ANG} GROUP BY user_id",
)
def agg_25(spark, d):
    return angles(spark, d).groupBy("user_id").agg(r6(agg.hue_variance(F.col("a")), "variance"))


@query(
    "agg_26_direction_consistency",
    f"""
    WITH m AS (SELECT user_id, {MEAN_DEG} AS md FROM {ANG} GROUP BY user_id)
    SELECT e.user_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE round(1 - avg(least(abs(a - md), 360 - abs(a - md))) / 180, 5) END AS consistency FROM {ANG} e JOIN m ON e.user_id = m.user_id GROUP BY e.user_id""",
)
def agg_26(spark, d):
    return agg.direction_consistency(angles(spark, d), ["user_id"], "a").select("user_id", F.round("consistency", 5).alias("consistency"))


@query(
    "agg_27_inventory",
    """
    SELECT 'part' AS name, count(*) AS total, sum((p_size > 10)::INT)::BIGINT AS with_embedding, sum((p_size * 2 >= 85)::INT)::BIGINT AS good FROM part
    UNION ALL SELECT 'customer', count(*), sum((c_acctbal > 0)::INT)::BIGINT, sum((c_acctbal >= 8500)::INT)::BIGINT FROM customer""",
)
def agg_27(spark, d):
    part, cust = t(spark, d, "part"), t(spark, d, "customer")
    return agg.inventory(
        {"part": (part, F.col("p_size") > 10, F.col("p_size") * 2 >= 85), "customer": (cust, F.col("c_acctbal") > 0, F.col("c_acctbal") >= 8500)}
    )


@query("agg_28_top_benchmarks", "SELECT p_type, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) <= 5")
def agg_28(spark, d):
    p = t(spark, d, "part").select("p_type", "p_partkey", "p_retailprice")
    return agg.top_per_key(p, ["p_type"], [F.desc("p_retailprice"), F.asc("p_partkey")], 5)


@query(
    "agg_x1_rollup_report",
    """
    SELECT r_name, n_name, count(*) AS n, round(avg(s_acctbal), 6) AS avg_score FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY ROLLUP (r_name, n_name)""",
)
def agg_x1(spark, d):
    s, n, r = t(spark, d, "supplier"), t(spark, d, "nation"), t(spark, d, "region")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("s_acctbal"), "avg_score"))


@query("win_01_rank_positions", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 100")
def win_01(spark, d):
    from webfacts.operators.search import ranked

    return ranked(t(spark, d, "orders"), "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 100)


@query(
    "win_02_cap_per_type",
    "SELECT l_orderkey, l_linenumber::BIGINT AS pos, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount DESC, l_linenumber) <= 2",
)
def win_02(spark, d):
    # line numbers repeat inside an order, so the key itself takes part in the tie-break
    li = t(spark, d, "lineitem").select("l_orderkey", big("l_linenumber", "pos"), "l_returnflag", "l_discount", "l_partkey", "l_extendedprice")
    return sections.cap_per_type(li, "l_orderkey", "l_returnflag", "l_discount", "pos", 2).select("l_orderkey", "pos", "l_returnflag")


LINES = """(SELECT l_orderkey, l_partkey * 100000000 + l_suppkey * 1000 + l_linenumber * 100 + l_quantity::BIGINT AS pos, l_quantity, l_discount, l_returnflag, l_linestatus FROM lineitem)"""


def lines(spark, d):
    pos = F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("long")
    return t(spark, d, "lineitem").select("l_orderkey", pos.alias("pos"), "l_quantity", "l_discount", "l_returnflag", "l_linestatus")


@query(
    "win_03_single_hero_footer",
    f"""
    WITH s AS (SELECT l_orderkey, pos, CASE l_returnflag WHEN 'A' THEN 'hero' WHEN 'R' THEN 'footer' ELSE 'other' END AS type, 0.5 + l_discount AS conf,
      CASE WHEN l_linestatus = 'F' THEN 'footer' ELSE 'div' END AS tag, l_quantity * 2 AS top FROM {LINES}),
    h AS (SELECT l_orderkey, arg_max(pos, (conf, -pos)) AS hp FROM s WHERE type = 'hero' AND top <= 30 GROUP BY 1),
    f AS (SELECT l_orderkey, arg_max(pos, (tag = 'footer', conf, -pos)) AS fp FROM s WHERE type = 'footer' AND (top >= 70 OR tag = 'footer') GROUP BY 1)
    SELECT s.l_orderkey, pos, CASE WHEN type = 'hero' AND pos IS DISTINCT FROM hp THEN 'feature' WHEN type = 'footer' AND pos IS DISTINCT FROM fp THEN 'unknown' ELSE type END AS type,
      round(CASE WHEN (type = 'hero' AND pos IS DISTINCT FROM hp) OR (type = 'footer' AND pos IS DISTINCT FROM fp) THEN greatest(0.1, conf - 0.1) ELSE conf END, 6) AS confidence
    FROM s LEFT JOIN h ON s.l_orderkey = h.l_orderkey LEFT JOIN f ON s.l_orderkey = f.l_orderkey""",
)
def win_03(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "hero").when(F.col("l_returnflag") == "R", "footer").otherwise("other")
    s = lines(spark, d).select(
        "l_orderkey", "pos", kind.alias("type"), (0.5 + F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_linestatus") == "F", "footer").otherwise("div").alias("tag"), (F.col("l_quantity") * 2).alias("estimated_top"),
    )
    return sections.single_hero_footer(s, "l_orderkey", "pos").select("l_orderkey", "pos", "type", r6("confidence", "confidence"))


@query(
    "win_04_running_offset",
    f"""
    SELECT l_orderkey, pos, coalesce(sum(h) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_y,
      round(least(100.0, 100.0 * coalesce(sum(h) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(h) OVER (PARTITION BY l_orderkey)), 6) AS estimated_top
    FROM (SELECT l_orderkey, pos, greatest(50, 40 * (l_quantity::INT % 3) + 60 * (l_quantity::INT % 5)) AS h FROM {LINES})""",
)
def win_04(spark, d):
    q = F.col("l_quantity").cast("int")
    s = lines(spark, d).select("l_orderkey", "pos", sections.section_height(q % 3, q % 5, F.lit(0), F.lit(0)).cast("long").alias("height"))
    return sections.with_offsets(s, "l_orderkey", "pos").select("l_orderkey", "pos", "start_y", r6("estimated_top", "estimated_top"))


@query(
    "win_05_contextual_relabel",
    f"""
    WITH RECURSIVE q AS (SELECT l_orderkey, pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, CASE WHEN l_returnflag = 'A' THEN 'feature' ELSE 'unknown' END AS t,
        (l_discount * 5)::DOUBLE AS c, l_linestatus = 'F' AS foot, l_quantity::INT % 5 AS links, l_quantity::INT % 4 AS heads, l_quantity::INT % 3 AS imgs, l_quantity::INT % 2 AS btns, l_quantity::INT % 7 = 0 AS h1, l_quantity::INT % 11 = 0 AS copyright FROM {LINES}),
    o AS (SELECT *, CASE WHEN i = 1 AND (t = 'unknown' OR c < 0.5) THEN CASE WHEN links >= 3 THEN 'navigation' WHEN h1 AND btns > 0 THEN 'hero' END END AS opening FROM q),
    o2 AS (SELECT * REPLACE (coalesce(opening, t) AS t, CASE WHEN opening IS NOT NULL THEN least(greatest(c, 0.6::DOUBLE) * 1.1::DOUBLE, 1) ELSE c END AS c), bool_or(opening = 'navigation') OVER (PARTITION BY l_orderkey) AS nav FROM o),
    s AS (SELECT *, i = 2 AND coalesce(nav, false) AND t = 'unknown' AND h1 AND btns > 0 AS second FROM o2),
    s2 AS (SELECT * REPLACE (CASE WHEN second THEN 'hero' ELSE t END AS t, CASE WHEN second THEN greatest(c, 0.7::DOUBLE) ELSE c END AS c) FROM s),
    z AS (SELECT *, CASE WHEN i = n AND (t = 'unknown' OR c < 0.5) THEN CASE WHEN copyright THEN 0.8::DOUBLE WHEN foot THEN 0.9::DOUBLE END END AS closing FROM s2),
    z2 AS (SELECT * REPLACE (CASE WHEN closing IS NOT NULL THEN 'footer' ELSE t END AS t, CASE WHEN closing IS NOT NULL THEN least(greatest(c, closing) * 1.1::DOUBLE, 1) ELSE c END AS c), (i - 1) / greatest(n - 1, 1)::DOUBLE AS place FROM z),
    p AS (SELECT *, i > 1 AND i < n AND (heads >= 2 OR imgs >= 2) AND (t = 'unknown' OR c < 0.5) AS may_copy,
        CASE WHEN t = 'unknown' AND c < 0.3 THEN CASE WHEN place <= 0.15 THEN CASE WHEN links >= 2 THEN 'navigation' END WHEN place <= 0.3 THEN CASE WHEN h1 AND btns > 0 THEN 'hero' END
          WHEN place <= 0.7 THEN CASE WHEN imgs >= 3 THEN 'feature' END WHEN place <= 0.9 THEN CASE WHEN btns > 0 THEN 'cta' END WHEN copyright OR foot THEN 'footer' END END AS late FROM z2),
    r AS (SELECT l_orderkey, pos, i, coalesce(late, t) AS type, CASE late WHEN 'hero' THEN 0.5::DOUBLE WHEN 'footer' THEN 0.6::DOUBLE ELSE CASE WHEN late IS NULL THEN c ELSE 0.4::DOUBLE END END AS confidence FROM p WHERE i = 1
      UNION ALL SELECT p.l_orderkey, p.pos, p.i, CASE WHEN may_copy AND r.type = 'feature' THEN 'feature' ELSE coalesce(late, t) END,
        CASE WHEN may_copy AND r.type = 'feature' THEN greatest(c, 0.6::DOUBLE) WHEN late IS NULL THEN c WHEN late = 'hero' THEN 0.5::DOUBLE WHEN late = 'footer' THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END
      FROM r JOIN p ON p.l_orderkey = r.l_orderkey AND p.i = r.i + 1)
    SELECT l_orderkey, pos, type, round(confidence, 6) AS confidence FROM r""",
)
def win_05(spark, d):
    q = F.col("l_quantity").cast("int")
    s = lines(spark, d).select(
        "l_orderkey", "pos",
        F.when(F.col("l_returnflag") == "A", "feature").otherwise("unknown").alias("type"),
        (F.col("l_discount") * 5).alias("confidence"),
        F.when(F.col("l_linestatus") == "F", "footer").otherwise("div").alias("tag"),
        (q % 5).alias("n_links"), (q % 4).alias("n_headings"), (q % 3).alias("n_images"), (q % 2).alias("n_buttons"),
        (q % 7 == 0).alias("has_h1"), (q % 11 == 0).alias("has_copyright"),
    )
    return sections.relabel_by_context(s, "l_orderkey", "pos").select("l_orderkey", "pos", "type", r6("confidence", "confidence"))


LAGS = "(SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(
    "win_06_movement",
    f"SELECT event_id, round(sqrt(pow(value - b, 2) + pow((event_id % 100) - (pe % 100), 2)) / 1440, 6) AS movement FROM (SELECT *, lag(value) OVER w AS b, lag(event_id) OVER w AS pe FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE b IS NOT NULL",
)
def win_06(spark, d):
    region = F.struct(F.col("value").alias("x"), (F.col("event_id") % 100).cast("double").alias("y"))
    frames = ev(spark, d).select("user_id", "ts", "event_id", F.array(region).alias("regions"))
    out = series.movements(frames, "user_id", ["ts", "event_id"], "regions", 1440, 900)
    return out.select("event_id", F.round(F.col("movement")[0], 6).alias("movement")).filter("movement IS NOT NULL")


CHANGES = f"""SELECT user_id, count(*) AS n, count(*) FILTER (WHERE b IS NOT NULL AND n IS NOT NULL AND ((value - b >= 0 AND n - value >= 0) OR (value - b <= 0 AND n - value <= 0))) AS same,
   count(*) FILTER (WHERE b IS NOT NULL AND n IS NOT NULL AND ((value - b >= 0 AND n - value < 0) OR (value - b < 0 AND n - value >= 0))) AS turns,
   count(*) FILTER (WHERE abs(value - b) > 2 * m) AS jumps FROM (SELECT *, avg(value) OVER (PARTITION BY user_id) AS m FROM {LAGS}) GROUP BY user_id"""


@query("win_07_direction_agreement", f"SELECT user_id, CASE WHEN n < 3 THEN 0.0 ELSE round(same / (n - 2), 6) END AS directional FROM ({CHANGES})")
def win_07(spark, d):
    return series.change_scores(ev(spark, d), "user_id", ["ts", "event_id"], "value").select("user_id", r6("directional", "directional"))


@query("win_08_sporadic", f"SELECT user_id, CASE WHEN n < 2 THEN 0.0 ELSE round(jumps / (n - 1), 6) END AS sporadic FROM ({CHANGES})")
def win_08(spark, d):
    return series.change_scores(ev(spark, d), "user_id", ["ts", "event_id"], "value").select("user_id", r6("sporadic", "sporadic"))


@query(
    "win_09_gap_sessions",
    """
    WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*) AS n, round(sum(value), 6) AS total FROM k GROUP BY 1, 2""",
)
def win_09(spark, d):
    e = ev(spark, d).select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = series.gap_sessions(e, "user_id", ["us", "event_id"], "us", 6 * 3600 * 1_000_000)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total"))


@query(
    "win_10_runs",
    """
    WITH r AS (SELECT *, value > 10 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    k AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM r WHERE a)
    SELECT user_id, min(i) - 1 AS first, max(i) - 1 AS last, count(*) AS length FROM k GROUP BY user_id, g""",
)
def win_10(spark, d):
    return series.runs_above(ev(spark, d), "user_id", ["ts", "event_id"], "value", 10)


@query("win_11_recent_history", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 500")
def win_11(spark, d):
    e = ev(spark, d).select("event_type", "event_id", "ts")
    return agg.top_per_key(e, ["event_type"], [F.desc("ts"), F.desc("event_id")], 500, salt=F.col("event_id")).select("event_type", "event_id")


@query(
    "win_12_cumulative_percentile",
    """
    SELECT p_partkey, round(100.0 * cume_dist() OVER w, 2) AS percentile, round(percent_rank() OVER w, 6) AS percent_rank, ntile(4) OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS quartile
    FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_size)""",
)
def win_12(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_type", "p_size")
    shares = agg.all_percentiles(p, ["p_type"], "p_size").select("p_partkey", "percentile", r6("percent_rank", "percent_rank"))
    return shares.join(agg.quartiles(p, ["p_type"], ["p_size", "p_partkey"]).select("p_partkey", "quartile"), "p_partkey")


@query(
    "ts_03_series_statistics",
    "SELECT user_id, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min, round(stddev_pop(value), 6) AS stddev, count(*) FILTER (WHERE value > 5) AS changed FROM events GROUP BY 1",
)
def ts_03(spark, d):
    out = series.statistics(ev(spark, d), "user_id", "value", 5)
    return out.withColumns({"avg": F.round("avg", 6), "stddev": F.round("stddev", 6)})


ACF = """
  x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value - avg(value) OVER (PARTITION BY user_id) AS v,
    count(*) OVER (PARTITION BY user_id) AS n, var_pop(value) OVER (PARTITION BY user_id) AS va FROM events),
  acf AS (SELECT a.user_id, l AS lag, sum(a.v * b.v) / ((max(a.n) - l) * max(a.va)) AS acf FROM x a, range(0, 21) r(l), x b
    WHERE a.user_id = b.user_id AND b.i = a.i + l AND l <= a.n // 2 AND a.va > 0 GROUP BY 1, 2)"""


@query("ts_04_autocorrelation", f"WITH {ACF} SELECT user_id, lag, round(acf, 6) AS acf FROM acf")
def ts_04(spark, d):
    return series.autocorrelation(ev(spark, d), "user_id", ["ts", "event_id"], "value", 20).select("user_id", big("lag", "lag"), r6("acf", "acf"))


@query(
    "ts_05_period",
    f"""
    WITH {ACF}, nb AS (SELECT *, lag(acf) OVER w AS p, lead(acf) OVER w AS q FROM acf WINDOW w AS (PARTITION BY user_id ORDER BY lag)),
    lo AS (SELECT user_id, min(lag) AS low FROM nb WHERE acf < p AND acf < q GROUP BY 1),
    pk AS (SELECT nb.user_id, arg_max(lag, (acf, -lag)) AS best, max(acf) AS s FROM nb JOIN lo ON nb.user_id = lo.user_id WHERE acf > p AND acf > q AND lag > low AND acf > 0 GROUP BY 1)
    SELECT u.user_id, round(least(1, coalesce(s, 0)), 6) AS score, coalesce(best, 0) AS period_frames, floor(coalesce(best, 0) / 30 * 1000 + 0.5)::BIGINT AS period_ms
    FROM (SELECT DISTINCT user_id FROM acf) u LEFT JOIN pk ON u.user_id = pk.user_id""",
)
def ts_05(spark, d):
    acf = series.autocorrelation(ev(spark, d), "user_id", ["ts", "event_id"], "value", 20)
    return series.period(acf, "user_id").select("user_id", r6("score", "score"), big("period_frames", "period_frames"), "period_ms")
