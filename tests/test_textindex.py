"""The stored text index: top-k by block bounds equals scoring everything."""

import math
import random

import pytest

from webfacts.operators import search, textindex


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 80)))) for i in range(n)]


def brute(rows, query, k, every=True):
    docs = {i: (t or "").split() for i, t in rows}
    avg, n, terms = sum(map(len, docs.values())) / len(docs), len(docs), query.split()
    df = {t: sum(t in w for w in docs.values()) for t in terms}
    out = []
    for i, w in docs.items():
        hits = [t for t in terms if t in w]
        if hits and (not every or len(hits) == len(terms)):
            out.append((i, sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in hits)))
    return [(i, round(s, 9)) for i, s in sorted(out, key=lambda r: (-round(r[1], 9), r[0]))[:k]]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows, path = corpus(), str(tmp_path_factory.mktemp("text"))
    frame = lambda r: spark.createDataFrame(r, "id long, t string")
    textindex.store(frame(rows[:600] + [(None, "word0 word1"), (5000, None), (5001, "")]), path, "id", "t", buckets=8, span=32)
    textindex.store(frame(rows[600:]), path, "id", "t", mode="append")
    return rows + [(5000, None), (5001, "")], path


@pytest.mark.parametrize("query, every", [("word0 word1", True), ("word3 word9", True), ("word0 word40 word55", False), ("word59", True)])
def test_top_k_equals_scoring_everything(spark, index, query, every):
    rows, path = index
    for k, first in ((5, 4), (40, 1), (2000, 64)):
        got = textindex.top_k(spark, path, query, "id", k, every_term=every, first_blocks=first)
        assert [(r.id, round(r.bm25, 9)) for r in got.rows.collect()] == brute(rows, query, k, every)
        assert got.blocks_read <= got.blocks


def test_bounds_spare_blocks(spark, tmp_path):
    rows = [(i, "alpha beta " * (40 if i == 77 else 1) + f"filler{i} " * 30) for i in range(640)]
    textindex.store(spark.createDataFrame(rows, "id long, t string"), str(tmp_path), "id", "t", span=16)
    got = textindex.top_k(spark, str(tmp_path), "alpha beta", "id", 1, first_blocks=1)
    assert [r.id for r in got.rows.collect()] == [77] and got.blocks == 80 and got.blocks_read == 2
    assert textindex.top_k(spark, str(tmp_path), "", "id", 3).rows.count() == 0 and textindex.top_k(spark, str(tmp_path), "nowhere", "id", 3).rows.count() == 0


def test_a_frequent_term_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "RUN", 4)
    rows = [(i, "common") for i in range(4096)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be merged again
    textindex.store(spark.createDataFrame(rows, "id long, t string"), str(tmp_path), "id", "t", buckets=4, span=16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spark.read.parquet(f"{tmp_path}/postings").inputFiles()) > 2
    held = textindex.stored_postings(spark, str(tmp_path), "common", "id")[0]
    assert held.count() == 4096 and held.select("id").distinct().count() == 4096


def test_hybrid_search_over_a_stored_index(spark, tmp_path):
    rows = [(i, [1.0, float(i % 7)], t) for i, t in corpus(200)]
    docs = spark.createDataFrame(rows, "id long, v array<double>, t string")
    textindex.store(docs, str(tmp_path), "id", "t", span=8)
    key = lambda df: [(r.id, round(r.similarity, 9), r.text_rank) for r in df.collect()]
    plain = search.hybrid_search(docs, [1.0, 2.0], "word0 word2", "id", "v", "t")
    assert key(search.hybrid_search(docs, [1.0, 2.0], "word0 word2", "id", "v", "t", text_index=str(tmp_path))) == key(plain)
