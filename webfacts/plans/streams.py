"""Streaming jobs run to the end over the given files, and the user-extension surface."""

import uuid

from webfacts import sqlfunctions
from webfacts.operators import search
from webfacts.pages import structure
from webfacts.plans.common import F, r6, t, vector_of
from webfacts.plans.facts import URL_NORM_SQL
from webfacts.plans.pagejobs import SECTS
from webfacts.plans.relational import RANKS_SQL, two_lists
from webfacts.registry import query
from webfacts.session import ensure_checkpoint_dir
from webfacts.streaming import jobs


def stream(spark, d, name):
    """A table, one file or a folder of files, as a stream with the schema of the table.

    The path is a pattern, since a stream takes a plain path for a folder.
    """
    schema = t(spark, d, name).schema
    df = spark.readStream.schema(schema).parquet(f"{d}/{name}[.]parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def folder(spark):
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def finish(writer, path):
    jobs.run_available(writer, f"{path}/checkpoint")


@query("st_01_fresh_pages", f"SELECT DISTINCT url_norm FROM ({URL_NORM_SQL})")
def st_01(spark, d):
    path = folder(spark)
    p = stream(spark, d, "pages").select("page_id", "url", F.timestamp_seconds(F.col("page_id") + 1_700_000_000).alias("fetched_at"))
    fresh = jobs.fresh_pages(p).select("page_id", "url_norm")
    finish(fresh.writeStream.format("parquet").option("path", f"{path}/out"), path)
    return spark.read.parquet(f"{path}/out").select("url_norm")


@query("st_02_hourly_stats", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, round(avg(value), 6) AS avg FROM events GROUP BY 1")
def st_02(spark, d):
    path = folder(spark)
    finish(jobs.keep_updates(jobs.hourly_stats(stream(spark, d, "events"), "ts", "value"), f"{path}/out"), path)
    out = jobs.newest_updates(spark, f"{path}/out", ["hour"])
    return out.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "n", r6("avg", "avg"))


@query(
    "st_03_rolling_latency",
    """
    WITH q AS (SELECT event_type, value, time_bucket(INTERVAL 15 MINUTES, ts) - INTERVAL 15 MINUTES * i AS start FROM events, range(0, 4) r(i))
    SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max FROM q GROUP BY 1, 2""",
)
def st_03(spark, d):
    path = folder(spark)
    finish(jobs.keep_updates(jobs.rolling_latency(stream(spark, d, "events"), "event_type", "ts", "value"), f"{path}/out"), path)
    out = jobs.newest_updates(spark, f"{path}/out", ["start", "event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", r6("avg", "avg"), "max")


@query(
    "st_04_gap_sessions",
    """
    WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOURS THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g),
    x AS (SELECT user_id, session, count(*) AS n, sum(value) AS total, max(ts) AS last FROM k GROUP BY 1, 2)
    SELECT user_id, n, round(total, 6) AS total FROM x WHERE last + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def st_04(spark, d):
    path = folder(spark)
    s = jobs.gap_sessions(stream(spark, d, "events"), "user_id", "ts", "value", "6 hours")
    finish(s.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out"), path)
    return spark.read.parquet(f"{path}/out").select("user_id", "n", r6("total", "total"))


@query(
    "st_04b_capped_sessions",
    """
    WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (SELECT user_id, i, ms, value, ms AS head FROM e WHERE i = 1 UNION ALL
      SELECT e.user_id, e.i, e.ms, e.value, CASE WHEN e.ms - r.ms > 21600000 OR e.ms - r.head > 86400000 THEN e.ms ELSE r.head END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1),
    m AS (SELECT max(ms) - 10000 AS mark FROM e),
    g AS (SELECT user_id, head, max(ms) AS tail, count(*) AS n, sum(value) AS total FROM r, m WHERE ms <= mark GROUP BY 1, 2),
    k AS (SELECT *, lead(head) OVER (PARTITION BY user_id ORDER BY head) AS later FROM g)
    SELECT user_id, head AS start_ms, tail AS end_ms, n, round(total, 6) AS total FROM k, m WHERE later IS NOT NULL OR mark > tail + 21600000""",
)
def st_04b(spark, d):
    path = folder(spark)
    s = jobs.capped_sessions(stream(spark, d, "events"), "user_id", "ts", "value", 6 * 3600 * 1000, 24 * 3600 * 1000)
    finish(s.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out"), path)
    return spark.read.parquet(f"{path}/out").select("user_id", "start_ms", "end_ms", "n", r6("total", "total"))


@query(
    "st_05_slo_counters",
    """
    SELECT event_type, count(*) AS n, (count(*) FILTER (WHERE value > CASE event_type WHEN 'view' THEN 20 ELSE 30 END))::BIGINT AS violations,
      count(*) FILTER (WHERE value > CASE event_type WHEN 'view' THEN 20 ELSE 30 END) > count(*) * 0.05 AS alert FROM events GROUP BY 1""",
)
def st_05(spark, d):
    path = folder(spark)
    targets = t(spark, d, "events").select("event_type").distinct().withColumn("target", F.when(F.col("event_type") == "view", 20.0).otherwise(30.0))
    finish(jobs.keep_updates(jobs.slo_counters(stream(spark, d, "events"), targets, "event_type", "value"), f"{path}/out"), path)
    return jobs.newest_updates(spark, f"{path}/out", ["event_type"])


@query("st_06_embedding_backfill", "SELECT doc_id, 64::BIGINT AS dims FROM documents")
def st_06(spark, d):
    path = folder(spark)
    finish(jobs.embedding_backfill(stream(spark, d, "documents").select("doc_id", "text"), f"{path}/out", "doc_id", "text"), path)
    return spark.read.parquet(f"{path}/out").select("doc_id", F.size("embedding").cast("long").alias("dims"))


@query(
    "st_07_late_quarantine",
    """
    WITH a AS (SELECT event_id % 10 = 0 AS second, ts, value FROM events),
    k AS (SELECT CASE WHEN second AND ts < (SELECT max(ts) FROM a WHERE NOT second) - INTERVAL 1 HOUR THEN 'late' ELSE 'on_time' END AS kind, value FROM a)
    SELECT kind, count(*) AS n, round(sum(value), 6) AS total FROM k GROUP BY 1""",
)
def st_07(spark, d):
    path = folder(spark)
    events = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    second = F.col("event_id") % 10 == 0  # these rows arrive after all others, most of them late
    for arrival in (~second, second):
        events.filter(arrival).write.mode("append").parquet(f"{path}/in")
        arriving = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        finish(jobs.quarantine_late(arriving, "ts", "1 HOUR", f"{path}/good", f"{path}/late", f"{path}/mark"), path)
    good = spark.read.parquet(f"{path}/good").select(F.lit("on_time").alias("kind"), "value")
    late = spark.read.parquet(f"{path}/late").select(F.lit("late").alias("kind"), "value")
    return good.unionByName(late).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total"))


@query("st_08_replace_per_page", f"SELECT page_id, count(*) AS sections FROM {SECTS} GROUP BY 1")
def st_08(spark, d):
    path = folder(spark)
    finish(jobs.replace_per_page(stream(spark, d, "pages"), lambda b: structure.sections(b).drop("snippet"), path), path)
    return jobs.current_facts(spark, path).groupBy("page_id").agg(F.count(F.lit(1)).alias("sections"))


@query(
    "ud_05_n_way_fusion",
    f"""
    WITH {RANKS_SQL}, w AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier QUALIFY rank <= 50),
    u AS (SELECT id, 0.5::DOUBLE / (60 + rank) AS s FROM v UNION ALL SELECT id, 0.3::DOUBLE / (60 + rank) FROM f UNION ALL SELECT id, 0.2::DOUBLE / (60 + rank) FROM w)
    SELECT id, round(sum(s), 9) AS rrf_score FROM u GROUP BY id""",
)
def ud_05(spark, d):
    v, f = two_lists(spark, d)
    w = search.ranked(t(spark, d, "supplier"), "s_suppkey", [F.desc("s_acctbal"), F.asc("s_suppkey")], 50)
    return search.fuse({"a": (v, 0.5), "b": (f, 0.3), "c": (w, 0.2)}).select("id", F.round("rrf_score", 9).alias("rrf_score"))


@query(
    "ud_06_sql_functions",
    """
    SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 'A' WHEN p_size * 2 >= 80 THEN 'B' WHEN p_size * 2 >= 70 THEN 'C' WHEN p_size * 2 >= 60 THEN 'D' ELSE 'F' END AS grade,
      round(1.0::DOUBLE / (60 + p_size), 9) AS weight FROM part""",
)
def ud_06(spark, d):
    sqlfunctions.register(spark)
    t(spark, d, "part").createOrReplaceTempView("webfacts_part")
    return spark.sql("SELECT p_partkey, quality_grade(CAST(p_size * 2 AS DOUBLE)) AS grade, round(rrf_weight(CAST(p_size AS BIGINT)), 9) AS weight FROM webfacts_part")


@query("ud_06b_similar_by_view", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 3)::DOUBLE[]), 6) AS similarity FROM embeddings WHERE label = 1 ORDER BY 2 DESC, 1 LIMIT 5")
def ud_06b(spark, d):
    t(spark, d, "embeddings").createOrReplaceTempView("webfacts_embeddings")
    out = sqlfunctions.find_similar(spark, "webfacts_embeddings", vector_of(spark, d, 3), "vec_id", 5, where="label = 1")
    return out.select("vec_id", r6("similarity", "similarity"))


@query("vec_17_checked_weights", "SELECT vec_id, round(0.7::DOUBLE * vec_id + 0.3 * label, 6) AS score FROM embeddings")
def vec_17(spark, d):
    search.check_weights(0.7, 0.3)
    return t(spark, d, "embeddings").select("vec_id", r6(F.col("vec_id") * 0.7 + F.col("label") * 0.3, "score"))
