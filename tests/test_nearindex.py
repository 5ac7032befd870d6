"""The stored signature index: recall with the registered parameters, partial reads, appended rows, odd rows."""

import numpy as np
import pytest
from harness import DATA

from webfacts.operators import nearindex as ni
from webfacts.plans.common import t
from webfacts.plans.vectors import ANN

SCHEMA = "id long, v array<double>"


def brute(vecs, queries, k):
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = unit[queries] @ unit.T
    sims[np.arange(len(queries)), queries] = -9
    return {(q, int(j)) for q, row in zip(queries, sims) for j in np.argsort(-row, kind="stable")[:k]}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_driver_vectors(spark, tmp_path, sf):
    rows = t(spark, f"{DATA}/sf{sf}", "embeddings")
    local = {r.vec_id: r.embedding for r in rows.collect()}
    assert sorted(local) == list(range(len(local)))
    want = brute(np.array([local[i] for i in range(len(local))]), list(range(0, len(local), 100 if sf == "0.1" else 10)), 10)
    ni.store(rows, "vec_id", "embedding", str(tmp_path), ANN)
    asked = rows.filter("vec_id % 100 = 0" if sf == "0.1" else "vec_id % 10 = 0")
    found = {(r.query_id, r.neighbour_id) for r in ni.search(spark, str(tmp_path), asked, "vec_id", "embedding", 10).collect()}
    assert want and len(want & found) / len(want) >= 0.9
    share = ni.candidates(spark, str(tmp_path), ni._unit(asked, "vec_id", "embedding", 64)).count() / asked.count() / len(local)
    assert share < 0.65  # directions without structure: no signature of these sizes tells near from far much better


def test_near_copies_are_found_in_few_buckets(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((500, 64))
    near = base + 0.1 * rng.standard_normal((500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    ni.store(spark.createDataFrame(rows, SCHEMA), "id", "v", str(tmp_path), ni.Settings(64, tables=8, bits=10))
    asked = spark.createDataFrame(rows[:500], SCHEMA)
    got = {(r.query_id, r.neighbour_id) for r in ni.search(spark, str(tmp_path), asked, "id", "v", 1, probes=2).collect()}
    assert sum((i, i + 500) in got for i in range(500)) >= 495
    assert ni.candidates(spark, str(tmp_path), ni._unit(asked, "id", "v", 64), 2).count() < 0.06 * 500 * 1000
    one = ni.partitions(ni.probes_of(ni._unit(asked.limit(1), "id", "v", 64), ni.Settings(64, tables=8, bits=10), 0))
    assert sorted(one) == list(range(8)) and all(len(parts) == 1 for parts in one.values())  # of 32


def test_append_and_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(7)
    vecs = rng.standard_normal((60, 5)).tolist()
    rows = [(i, v) for i, v in enumerate(vecs)]
    odd = [(100, None), (101, [1.0]), (102, [float("nan")] * 5), (103, [1.0, None, 1.0, 1.0, 1.0]), (None, vecs[0]), (104, [0.0] * 5), (105, vecs[0]), (106, vecs[0])]
    path = str(tmp_path)
    ni.store(spark.createDataFrame(rows[:30], SCHEMA), "id", "v", path, ni.Settings(5, tables=4, bits=2, parts=3))
    ni.append(spark.createDataFrame(rows[20:] + odd, SCHEMA), "id", "v", path)  # ids 20 to 29 are there already
    held = spark.read.parquet(path + "/vectors")
    assert sorted(r.id for r in held.collect()) == [*range(60), 104, 105, 106]
    assert spark.read.parquet(path + "/signatures").count() == 63 * 4
    got = ni.search(spark, path, spark.createDataFrame([(0, vecs[0]), (7, None), (500, [0.0] * 5)], SCHEMA), "id", "v", 80, probes=2).collect()
    mine = [(r.neighbour_id, r.rank) for r in got if r.query_id == 0]
    assert mine[:2] == [(105, 1), (106, 2)] and {q.query_id for q in got} == {0, 500} and all(r.similarity == 0 for r in got if r.query_id == 500)
    full = np.array([v for _, v in rows] + [[0.0] * 5, vecs[0], vecs[0]])
    unit = full / np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-300)
    assert len(mine) == 62  # two bits, both probed: every bucket of some table is read
    assert [i for i, _ in mine[2:6]] == [int(j) for j in np.argsort(-(unit[:60] @ unit[0]), kind="stable") if j != 0][:4]
    assert ni.search(spark, path, spark.createDataFrame([], SCHEMA), "id", "v", 3).count() == 0
    settings = ni.Settings(5)
    ni.store(spark.createDataFrame([], SCHEMA), "id", "v", path + "/empty", settings)
    assert ni.search(spark, path + "/empty", spark.createDataFrame(rows, SCHEMA), "id", "v", 3).count() == 0


def test_search_lists_no_pairs_and_equals_them(spark, tmp_path, monkeypatch):
    # copies, an id with two vectors on either side, several blocks and pieces; pairs below and above the share that is multiplied one by one
    rng = np.random.default_rng(8)
    vecs = np.concatenate([rng.standard_normal((150, 6)), np.repeat(rng.standard_normal((1, 6)), 60, axis=0), np.zeros((2, 6))]).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(3, vecs[9].tolist()), (4, vecs[160].tolist())]
    path, settings, asked = str(tmp_path), ni.Settings(6, tables=3, bits=4, parts=2), [*rows[::7], (0, vecs[1].tolist()), (900, vecs[170].tolist())]
    ni.store(spark.createDataFrame(rows, SCHEMA).repartition(5), "id", "v", path, settings)
    assert all(len(list(d.glob("part-*"))) == 1 for d in tmp_path.glob("signatures/tab=*/part=*"))
    queries = spark.createDataFrame(asked, SCHEMA)
    unit = [(i, np.array(v) / (np.linalg.norm(v) or 1)) for i, v in rows]
    met = {(r.query_id, r.id) for r in ni.candidates(spark, path, ni._unit(queries, "id", "v", 6), 1).collect()}
    sims = {}
    for q, v in asked:
        for i, u in unit:
            if (q, i) in met:
                s = round(float(u @ np.array(v) / (np.linalg.norm(v) or 1)), 9)
                sims[q, i] = max(s, sims.get((q, i), -2))
    want = {}
    for (q, i), s in sims.items():
        want.setdefault(q, []).append((-s, i))
    want = {(q, i, n + 1) for q, x in want.items() for n, (_, i) in enumerate(sorted(x)[:4])}

    def listed(*args):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(ni, "candidates", listed)
    for name, value in (("BLOCK_QUERIES", 12), ("LEAST_ROWS", 70), ("PIECE_QUERIES", 5), ("PIECE_ROWS", 30)):
        monkeypatch.setattr(ni, name, value)
    for few in (0.0, 2.0):
        monkeypatch.setattr(ni, "FEW", few)
        assert {(r.query_id, r.neighbour_id, r.rank) for r in ni.search(spark, path, queries, "id", "v", 4, probes=1).collect()} == want
