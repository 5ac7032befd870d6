"""Registered queries of the optional part on the driver's tables."""

import pytest
from harness import DATA, compare, duck

from webfacts.llm.queries import ORACLES, QUERIES

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, duck(FOLDER), ORACLES[name]) is None
    else:
        table = "embeddings" if name in ("op8_near_vectors", "op12_whitening") else "documents"
        rows = 8 if name == "op12_whitening" else 1
        assert df.count() == rows * spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
