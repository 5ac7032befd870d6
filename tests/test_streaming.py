"""Streaming jobs over several files: state across batches, late rows, retries."""

import datetime as dt

from pyspark.sql import functions as F

from webfacts.streaming import jobs

SCHEMA = "user string, ts timestamp, value double"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def feed(spark, path, batches, schema=SCHEMA):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_capped_sessions_across_batches(spark, tmp_path):
    ticks = [0, 0.5, 1.2, 3.0, 3.5, 4.4, 5.3, 6.2, 7.1, 8.0, 8.9, 30.0, 100.0]
    rows = [("u", at(s), 1.0) for s in ticks]
    stream = feed(spark, f"{tmp_path}/in", [rows[:4], rows[4:9], rows[9:]])
    out = jobs.capped_sessions(stream, "user", "ts", "value", 1000, 5000, "1 second")
    jobs.run_available(out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/c")
    base = int(at(0).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = sorted((r["start_ms"] - base, r["end_ms"] - base, r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 1200, 3), (3000, 8000, 7), (8900, 8900, 1), (30000, 30000, 1)]


def test_late_rows_are_kept_apart(spark, tmp_path):
    stream = feed(spark, f"{tmp_path}/in", [[("u", at(0), 1.0), ("u", at(7200), 1.0)], [("u", at(60), 2.0), ("u", at(7300), 3.0)]])
    jobs.run_available(jobs.quarantine_late(stream, "ts", "1 HOUR", f"{tmp_path}/good", f"{tmp_path}/late", f"{tmp_path}/mark"), f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/good").count() == 3 and [r["value"] for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [2.0]


def test_newest_batch_of_a_page_counts(spark, tmp_path):
    schema = "page_id long, words string"
    stream = feed(spark, f"{tmp_path}/in", [[(1, "a b"), (2, "c")], [(1, "z")]], schema)
    facts = lambda b: b.select("page_id", F.explode(F.split("words", " ")).alias("word"))
    jobs.run_available(jobs.replace_per_page(stream, facts, f"{tmp_path}/o"), f"{tmp_path}/c")
    got = {(r["page_id"], r["word"]) for r in jobs.current_facts(spark, f"{tmp_path}/o").collect()}
    assert got == {(1, "z"), (2, "c")}


def test_backfill_embeds_each_fact_once(spark, tmp_path):
    schema = "id long, t string"
    stream = feed(spark, f"{tmp_path}/in", [[(1, "a"), (2, "b")], [(2, "b"), (3, "a")]], schema)
    jobs.run_available(jobs.embedding_backfill(stream, f"{tmp_path}/e", "id", "t"), f"{tmp_path}/c")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/e").collect()) == [1, 2, 3]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("u", at(i * 977), float(i)) for i in range(40)]
    stream = feed(spark, f"{tmp_path}/in", [rows[:13], rows[13:30], rows[30:]])
    jobs.run_available(jobs.keep_updates(jobs.hourly_stats(stream, "ts", "value"), f"{tmp_path}/o"), f"{tmp_path}/c")
    got = {(r["hour"], r["n"], r["avg"]) for r in jobs.newest_updates(spark, f"{tmp_path}/o", ["hour"]).collect()}
    batch = spark.createDataFrame(rows, SCHEMA).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.avg("value").alias("avg"))
    assert got == {tuple(r) for r in batch.collect()}


def test_tables_of_one_file_or_a_folder_of_files(spark, tmp_path):
    from webfacts.plans.streams import stream

    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/pages.parquet")  # a folder with three files
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/other.parquet")
    file = next(p for p in (tmp_path / "other.parquet").iterdir() if p.suffix == ".parquet")
    file.rename(tmp_path / "labels.parquet")  # one plain file
    for name, n in (("pages", 10), ("labels", 5)):
        out = stream(spark, str(tmp_path), name).writeStream.format("parquet").option("path", f"{tmp_path}/o-{name}")
        jobs.run_available(out, f"{tmp_path}/c-{name}")
        assert spark.read.parquet(f"{tmp_path}/o-{name}").count() == n
