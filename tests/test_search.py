"""Fusion, coverage weights, boosts and argument checks."""

import pytest
from pyspark.sql import functions as F

from webfacts.operators import filters, scoring, search
from webfacts.operators.listing import listing
from webfacts.sources import tables as src


def ranks(spark, ids):
    return spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id string, rank long")


def test_rrf_order_and_symmetry(spark):
    v, f = ranks(spark, ["a", "b"]), ranks(spark, ["c", "b"])
    got = {r["id"]: r for r in search.fuse({"vector": (v, 0.6), "text": (f, 0.4)}).collect()}
    assert got["b"]["rrf_score"] == pytest.approx(1 / 62) and got["a"]["rrf_score"] == pytest.approx(0.6 / 61) and got["c"]["rrf_score"] == pytest.approx(0.4 / 61)
    assert [k for k, _ in sorted(got.items(), key=lambda x: -x[1]["rrf_score"])] == ["b", "a", "c"]
    turned = {r["id"]: r["rrf_score"] for r in search.fuse({"text": (f, 0.4), "vector": (v, 0.6)}).collect()}
    assert turned == pytest.approx({k: r["rrf_score"] for k, r in got.items()})


def test_coverage_weights(spark):
    def weights(nt, nv):
        a, b = search.coverage_weights(F.lit(float(nt)), F.lit(float(nv)))
        return spark.range(1).select(a.alias("a"), b.alias("b")).first()

    assert tuple(weights(10, 10)) == (0.6, 0.4) and tuple(weights(10, 0)) == (1.0, 0.0)
    low = weights(10, 3)
    assert low["b"] == pytest.approx(0.4 * 0.3 / 0.5) and low["a"] == pytest.approx(1 - low["b"])


def test_hybrid_without_text_hits_is_the_vector_list(spark):
    docs = spark.createDataFrame([(i, [float(i), 1.0], "plain words") for i in range(5)], "id long, v array<double>, t string")
    got = search.hybrid_search(docs, [1.0, 0.0], "missing", "id", "v", "t", limit=3).collect()
    assert [r["id"] for r in got] == [4, 3, 2] and all(r["text_rank"] is None for r in got)


def test_argument_checks(spark):
    for bad in ((0.7, 0.4), (-0.1, 0.5), (1.2, 0.0)):
        with pytest.raises(ValueError):
            search.check_weights(*bad)
    search.check_weights(0.6, 0.4)
    df = spark.range(3)
    with pytest.raises(ValueError):
        listing(df, "other", "asc", 5, {"id": "id"}, "id")
    with pytest.raises(ValueError):
        listing(df, "id", "asc", 51, {"id": "id"}, "id")
    with pytest.raises(ValueError):
        filters.light_response(df, ["id"], {"id": 1001})


def test_tenant_filter_is_closed(spark):
    df = spark.range(3)
    assert df.filter(filters.owned_by("id", 1)).count() == 1
    assert df.filter(filters.owned_by("id", None)).count() == 0 and df.filter(filters.owned_by("id", " ")).count() == 0


def test_missing_features_pass_only_an_inactive_filter(spark):
    df = spark.sql("SELECT CAST(NULL AS STRUCT<theme: STRUCT<type: STRING, contrast_ratio: DOUBLE>, colors: STRUCT<dominant: STRING>, density: STRUCT<content_density: DOUBLE, whitespace_ratio: DOUBLE>>) AS vf")
    assert df.filter(filters.visual_filter("vf")).count() == 1 and df.filter(filters.visual_filter("vf", theme="dark")).count() == 0


def test_domains_below_a_listed_one(spark):
    df = spark.createDataFrame([("https://a.b.com/x",), ("https://bb.com",), ("https://b.com",)], "url string")
    listed = spark.createDataFrame([("b.com",)], "domain string")
    for domains in (listed, ["b.com"]):
        assert {r[0] for r in filters.on_domains(df, "url", domains).collect()} == {"https://a.b.com/x", "https://b.com"}
        assert {r[0] for r in filters.on_domains(df, "url", domains, allow=False).collect()} == {"https://bb.com"}


def test_query_context(spark):
    q = spark.createDataFrame([("Minimal SaaS dashboard",), ("zzz",), ("luxury hotel",)], "q string")
    got = {r["q"]: r for r in scoring.infer_context(q, "q").collect()}
    assert got["Minimal SaaS dashboard"]["industry"] == "technology" and got["Minimal SaaS dashboard"]["style"] == "minimal"
    assert got["zzz"]["industry"] is None and got["zzz"]["confidence"] == 0
    assert got["luxury hotel"]["industry"] == "travel" and got["luxury hotel"]["style"] == "elegant" and "hotel" in got["luxury hotel"]["keywords"]


def test_write_patterns(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 1)], "page int, fact string, at int")
    new = spark.createDataFrame([(1, "z", 2)], "page int, fact string, at int")
    assert sorted(r["fact"] for r in src.replace_facts(old, new, "page").collect()) == ["c", "z"]
    assert {(r["page"], r["fact"]) for r in src.upsert(old, new, ["page"], ["at", "fact"]).collect()} == {(1, "z"), (2, "c")}
    path = str(tmp_path / "facts")
    src.overwrite_partitions(old, path, "page")
    src.overwrite_partitions(new, path, "page")
    assert sorted(r["fact"] for r in spark.read.parquet(path).collect()) == ["c", "z"]
    with pytest.raises(Exception, match="batch aborted"):
        src.ingest_batch(old, {"bad": F.col("fact") == "b"}, "abort").collect()
    assert src.ingest_batch(old, {"bad": F.col("fact") == "b"}).count() == 2
