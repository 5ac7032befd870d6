"""Nearest-neighbour joins against brute force, with copies, zero vectors, groups and several pivots."""

import numpy as np
import pandas as pd
import pytest

from webfacts.operators import neighbours as nb


def brute(ids, vecs, k, floor, groups=None):
    norm = np.linalg.norm(vecs, axis=1, keepdims=True)
    unit = vecs / np.where(norm == 0, 1, norm)
    sims = np.round(unit @ unit.T, 9)
    out = set()
    for i in range(len(ids)):
        order = sorted(
            (j for j in range(len(ids)) if j != i and sims[i, j] >= floor and (groups is None or groups[i] == groups[j])), key=lambda j: (-sims[i, j], ids[j])
        )
        out |= {(int(ids[i]), int(ids[j])) for j in order[:k]}
    return out


def frame(spark, vecs, groups=None):
    pdf = pd.DataFrame({"id": np.arange(len(vecs)), "v": list(vecs.astype(np.float64)), "g": groups if groups is not None else 0})
    return spark.createDataFrame(pdf, "id long, v array<double>, g int")


@pytest.fixture(scope="module")
def cluster():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 12))
    return np.concatenate([c + 0.3 * rng.standard_normal((25, 12)) for c in centres])


@pytest.mark.parametrize("pivots", [1, 9])
@pytest.mark.parametrize("floor", [None, 0.6])
def test_exact(spark, cluster, pivots, floor):
    got = nb.knn_join(frame(spark, cluster), "id", "v", 4, floor, pivots_wanted=pivots).collect()
    assert {(r["id"], r["neighbour_id"]) for r in got} == brute(np.arange(len(cluster)), cluster, 4, -2 if floor is None else floor)


@pytest.mark.parametrize("pivots", [1, 5])
def test_copies_and_zero_vectors(spark, cluster, pivots):
    # a third of all rows are copies of one vector, two rows have no length
    vecs = np.concatenate([cluster, np.repeat(cluster[:1], 80, axis=0), np.zeros((2, 12))])
    got = nb.knn_join(frame(spark, vecs), "id", "v", 3, 0.2, pivots_wanted=pivots).collect()
    assert {(r["id"], r["neighbour_id"]) for r in got} == brute(np.arange(len(vecs)), vecs, 3, 0.2)
    assert all(r["rank"] <= 3 for r in got)


def test_groups_and_block_splits(spark, cluster, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 16)
    groups = np.arange(len(cluster)) % 3
    got = nb.knn_join(frame(spark, cluster, groups), "id", "v", 2, None, "g", pivots_wanted=4).collect()
    assert {(r["id"], r["neighbour_id"]) for r in got} == brute(np.arange(len(cluster)), cluster, 2, -2, groups)


def test_uniqueness_is_one_when_alone_and_in_range(spark, cluster):
    groups = np.zeros(len(cluster), dtype=int)
    groups[0] = 9
    got = {r["id"]: r["uniqueness"] for r in nb.uniqueness(frame(spark, cluster, groups), "id", "v", "g").collect()}
    assert got[0] == 1.0 and all(-1e-9 <= u <= 1 for u in got.values())


def test_few_probes(spark, cluster):
    df = frame(spark, cluster)
    got = nb.nearest_to(df, "id", "v", {3: list(cluster[3])}, 5, 0.1).collect()
    assert {(3, r["id"]) for r in got} == {p for p in brute(np.arange(len(cluster)), cluster, 5, 0.1) if p[0] == 3}
