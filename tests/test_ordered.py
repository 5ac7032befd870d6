"""Ordered folds and percentiles against plain windows, at several partition counts and with one hot key."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from webfacts.operators.aggregates import all_percentiles, exact_percentiles, floor_percentiles, quartiles
from webfacts.operators.ordered import OrderedRows


@pytest.fixture(scope="module")
def rows(spark):
    # key 0 holds four fifths of the rows
    return spark.range(2000).selectExpr("id", "CASE WHEN id % 5 < 4 THEN 0 ELSE id % 7 END AS k", "(id * 7919) % 1009 AS v").cache()


@pytest.mark.parametrize("partitions", [1, 8, 32])
def test_scans_equal_windows(rows, partitions):
    o = OrderedRows(rows, ["k"], ["v", "id"], partitions).row_number("rn").running_sum(total=F.col("v")).sum_before(before=F.col("v"))
    got = o.previous(prev="v").following(nxt="v").rows()
    w = Window.partitionBy("k").orderBy("v", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.row_number().over(w).alias("rn"), F.sum("v").over(upto).alias("total"), (F.sum("v").over(upto) - F.col("v")).alias("before"),
        F.lag("v").over(w).alias("prev"), F.lead("v").over(w).alias("nxt"),
    )
    cols = ["id", "k", "v", "rn", "total", "before", "prev", "nxt"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)


@pytest.mark.parametrize("partitions", [1, 16])
def test_last_known_before(rows, partitions):
    r = rows.withColumn("m", F.when(F.col("id") % 11 == 0, F.col("id")))
    got = OrderedRows(r, ["k"], ["v", "id"], partitions).last_known_before(known="m").rows()
    w = Window.partitionBy("k").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = r.withColumn("known", F.last("m", ignorenulls=True).over(w))
    assert sorted(map(tuple, got.select("id", "known").collect())) == sorted(map(tuple, want.select("id", "known").collect()))


def test_percentile_definitions(rows):
    pdf = rows.toPandas()
    got = {r["k"]: r for r in exact_percentiles(rows, ["k"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    low = {r["k"]: r for r in floor_percentiles(rows, ["k"], "v", {"p95": 0.95, "p99": 0.99}).collect()}
    for k, part in pdf.groupby("k"):
        v = np.sort(part["v"].to_numpy())
        assert got[k]["p50"] == pytest.approx(np.percentile(v, 50)) and got[k]["p90"] == pytest.approx(np.percentile(v, 90))
        assert low[k]["p95"] == v[min(len(v) * 95 // 100, len(v) - 1)] and low[k]["p99"] == v[min(len(v) * 99 // 100, len(v) - 1)]


def test_percentiles_of_all_rows_are_monotone(rows):
    w = Window.partitionBy("k").orderBy("v")
    out = all_percentiles(rows, ["k"], "v").withColumn("before", F.lag("percentile").over(w)).filter("before > percentile")
    assert out.count() == 0


def test_quartiles_equal_ntile(rows):
    w = Window.partitionBy("k").orderBy("v", "id")
    want = rows.select("id", F.ntile(4).over(w).alias("q"))
    got = quartiles(rows, ["k"], ["v", "id"]).select("id", F.col("quartile").alias("q"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
