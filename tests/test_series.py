"""Sessions, fades, autocorrelation and categories on small series and on split blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from webfacts.operators import series


def windows_by_hand(frames, gap, longest):
    out, start, last = [], None, None
    for f in frames:
        if start is None or f - last > gap or f - start > longest:
            if start is not None:
                out.append((start, last))
            start = f
        last = f
    return out + ([(start, last)] if start is not None else [])


@pytest.mark.parametrize("partitions", ["1", "7", "32"])
def test_session_windows(spark, partitions):
    rng = np.random.default_rng(3)
    made = {1: [0, 10, 20, 60, 61], 2: list(range(0, 181, 20)), 3: sorted(set(rng.integers(0, 4000, 900).tolist())), 4: sorted(set(rng.integers(0, 90000, 900).tolist()))}
    rows = [(s, int(f), 0.1, 1) for s, fs in made.items() for f in fs]
    df = spark.createDataFrame(rows, "series int, frame long, cls double, shifts long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = series.session_windows(df, "series", "frame", "cls", "shifts", 30, 150).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for s, fs in made.items():
        assert sorted((r["start"], r["end"]) for r in got if r["series"] == s) == windows_by_hand(fs, 30, 150)
    assert {(r["start"], r["end"]) for r in got if r["series"] == 1} == {(0, 20), (60, 61)}
    assert {(r["start"], r["end"]) for r in got if r["series"] == 2} == {(0, 140), (160, 180)}


def test_shift_scores_and_class(spark):
    box = "struct<x:double,y:double,width:double,height:double>"
    df = spark.createDataFrame(
        [(1, 0, 0.5, [(0.0, 0.0, 720.0, 450.0)]), (1, 1, 0.5, [(144.0, 0.0, 720.0, 450.0)]), (1, 2, 0.5, [])], f"series int, frame long, change double, regions array<{box}>"
    )
    got = {r["frame"]: r["cls"] for r in series.shift_scores(df, "series", "frame", "regions", "change", 1440, 900).collect()}
    assert got[0] == pytest.approx(0.25 * 0.05) and got[1] == pytest.approx(0.25 * 0.1) and got[2] == 0
    assert [r[0] for r in spark.range(1).select(series.shift_class(F.lit(0.05)), series.shift_class(F.lit(0.1))).collect()] == ["good"]
    with pytest.raises(ValueError):
        series.shift_scores(df, "series", "frame", "regions", "change", 0, 900)


def test_fade_events(spark):
    alpha = [0, 0, 0.1, 0.2, 0.3, 0.4, 0.4, 0.4, 0.3, 0.2, 0.1, 0.1]
    df = spark.createDataFrame([(7, i, float(a)) for i, a in enumerate(alpha)], "s int, frame long, alpha double")
    got = sorted((r["type"], r["start_frame"], r["end_frame"]) for r in series.fade_events(df, "s", "frame", "alpha").collect())
    assert got == [("fade_in", 1, 5), ("fade_out", 7, 10)]


def test_periodic_series_is_found(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 64)
    x = [0.1 + 0.05 * np.sin(2 * np.pi * i / 12) for i in range(240)]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "s int, i long, v double")
    acf = series.autocorrelation(df, "s", ["i"], "v", 20)
    got = series.period(acf, "s").first()
    assert got["period_frames"] == 12 and got["score"] > 0.9
    lag3 = acf.filter("lag = 3").first()["acf"]
    m, va = np.mean(x), np.var(x)
    want = sum((x[i] - m) * (x[i + 3] - m) for i in range(237)) / (237 * va)
    assert lag3 == pytest.approx(want)
    cat = series.animation_category(series.series_features(df, "s", ["i"], "v", 60)).first()
    assert cat["category"] in ("pulse", "wave", "rotation") and cat["confidence"] >= 0.8


def test_change_scores_of_a_ramp(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "s int, i long, v double")
    got = series.change_scores(df, "s", ["i"], "v").first()
    assert got["directional"] == 1 and got["sporadic"] == 0 and got["randomness"] == pytest.approx(1 - abs(1 - 4.5) / 4.5)


def test_visual_category(spark):
    rows = [(1, i, 0.0, None, []) for i in range(5)] + [(2, i, 0.05, None, [(10.0, 0.0, 10.0)]) for i in range(5)]
    df = spark.createDataFrame(rows, "s int, f long, diff double, box struct<x:double,y:double,width:double,height:double>, vectors array<struct<dx:double,dy:double,magnitude:double>>")
    got = {r["s"]: r["category"] for r in series.visual_category(df, "s", "f").collect()}
    assert got == {1: "static", 2: "slide"}
