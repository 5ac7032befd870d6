"""Every registered query: equal to its SQL twin, or it runs and has rows."""

import os

import pytest
from harness import DATA, compare, duck

from webfacts.registry import load_all

QUERIES, ORACLES = load_all()
FOLDER = f"{DATA}/sf{os.environ.get('WEBFACTS_SF', '0.001')}"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.columns and df.count() > 0
