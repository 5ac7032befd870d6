"""Aggregations over evaluations, embeddings, latencies, colours and angles."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfacts.functions.base import flag, round_half_up
from webfacts.operators.ordered import floor_index, interpolated, value_ranks
from webfacts.session import cut


def rows() -> Column:
    return F.count(F.lit(1))


def narrative_stats(narratives: DataFrame, mood: str, confidence: str, embedding: str, created: str) -> DataFrame:
    return narratives.groupBy(F.col(mood).alias("mood")).agg(
        rows().alias("n"),
        F.avg(confidence).alias("avg_confidence"),
        F.count(embedding).alias("with_embedding"),
        F.max(created).alias("latest"),
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Interpolated percentiles per key; a key may be larger than a task."""
    ranks = value_ranks(df, keys, value)
    return ranks.groupBy(*keys).agg(
        F.max("n_total").alias("n"),
        (F.sum(F.col(value) * F.col("n_equal")) / F.max("n_total")).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[interpolated(p, value).alias(name) for name, p in points.items()],
    )


def floor_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Percentiles by floor index ``sorted[floor(n * p)]`` per key, with count, avg, min, max."""
    ranks = value_ranks(df, keys, value)
    return ranks.groupBy(*keys).agg(
        F.max("n_total").alias("n"),
        (F.sum(F.col(value) * F.col("n_equal")) / F.max("n_total")).alias("avg"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *[floor_index(p, value).alias(name) for name, p in points.items()],
    )


def industry_averages(evals: DataFrame, industry: str, score: str, min_count: int = 10) -> DataFrame:
    """Count, average (2 digits), exact median and 90th percentile of groups with enough evaluations."""
    stats = exact_percentiles(evals.filter(F.col(industry).isNotNull()), [industry], score, {"median": 0.5, "p90": 0.9})
    return stats.filter(F.col("n") >= min_count).select(industry, "n", F.round("avg", 2).alias("avg"), "median", "p90")


def section_benchmarks(facts: DataFrame, kind: str, score: str, industry: str) -> DataFrame:
    return facts.groupBy(kind).agg(
        rows().alias("n"),
        F.avg(score).alias("avg_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.array_sort(F.collect_set(industry)).alias("industries"),
    )


def score_percentile(scores: DataFrame, score: str, value: float) -> DataFrame:
    """Share of scores up to ``value`` in percent, 50.0 for an empty table."""
    share = F.round(100.0 * F.sum(flag(F.col(score) <= value)) / rows(), 2)
    return scores.filter(F.col(score).isNotNull()).agg(F.coalesce(share, F.lit(50.0)).alias("percentile"))


def all_percentiles(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Every row with the percentile of its score in its group (cume_dist in percent); null for a null score."""
    ranks = value_ranks(df, keys, score).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        F.col(score).alias("_r_score"),
        F.round(100.0 * F.col("n_upto") / F.col("n_total"), 2).alias("percentile"),
        F.when(F.col("n_total") == 1, 0.0)
        .otherwise((F.col("n_upto") - F.col("n_equal")) / (F.col("n_total") - 1))
        .alias("percent_rank"),
    )
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"_r_{k}")), keys, F.col(score) == F.col("_r_score"))
    return df.join(ranks, same, "left").drop("_r_score", *[f"_r_{k}" for k in keys])


def coverage(parts: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Per fact type: total, embedded, missing, ratio. ``name -> (facts, fact_id, embeddings, embedding_id)``."""

    def one(name, facts, fid, emb, eid):
        has = emb.select(F.col(eid).alias(fid), F.lit(1).alias("_e")).distinct()
        joined = facts.select(fid).join(has, fid, "left")
        return joined.agg(rows().alias("total"), F.count("_e").alias("embedded")).select(
            F.lit(name).alias("fact"),
            "total",
            "embedded",
            (F.col("total") - F.col("embedded")).alias("missing"),
            F.when(F.col("total") == 0, 0.0).otherwise(F.col("embedded") / F.col("total")).alias("ratio"),
        )

    return reduce(DataFrame.unionByName, [one(n, *p) for n, p in parts.items()])


def missing_per_page(branches: list[DataFrame], page: str) -> DataFrame:
    """Facts without embedding per page over several fact types (each branch already anti-joined)."""
    return reduce(DataFrame.unionByName, [b.select(page) for b in branches]).groupBy(page).agg(rows().alias("missing"))


def slo_violations(metrics: DataFrame, tool: str, duration: str, targets: dict[str, float]) -> DataFrame:
    """Runs over the target of their tool; exactly on the target is not a violation."""
    pairs = [F.lit(x) for kv in targets.items() for x in kv]
    limit = F.try_element_at(F.create_map(*pairs), F.col(tool))
    over = flag(F.col(duration) > limit)
    return metrics.groupBy(tool).agg(rows().alias("n"), F.sum(over).alias("violations"))


def hourly_stats(metrics: DataFrame, ts: str, duration: str) -> DataFrame:
    return metrics.groupBy(F.hour(ts).alias("hour")).agg(rows().alias("n"), F.avg(duration).alias("avg"))


def suggestions(stats: DataFrame, pattern: str) -> DataFrame:
    """Tuning hints from floor-percentile stats (n, avg, p95, p99); one row per hint, high priority first."""

    def hint(kind: str, cond: Column, high: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.when(high, 0).otherwise(1).alias("level")))

    p95, p99, n, avg = (F.col(c) for c in ("p95", "p99", "n", "avg"))
    hints = F.array(
        hint("index", p95 > 100, p95 > 200),
        hint("rewrite", p99 > 500, F.lit(True)),
        hint("caching", (n > 100) & (avg > 50), n > 500),
    )
    rows = stats.select(pattern, F.explode(F.array_compact(hints)).alias("h"))
    priority = F.when(F.col("h.level") == 0, "high").otherwise("medium")
    return rows.orderBy("h.level", pattern, "h.kind").select(pattern, F.col("h.kind").alias("kind"), priority.alias("priority"))


def zero_filled_counts(kind: Column, names: list[str], prefix: str = "") -> list[Column]:
    """One counter per known value, 0 when absent: a pivot without the extra pass."""
    return [F.sum(flag(kind == n)).alias(f"{prefix}{n}") for n in names]


def motion_summary(motions: DataFrame, page: str, types: list[str], triggers: list[str]) -> DataFrame:
    return motions.groupBy(page).agg(
        rows().alias("total"),
        *zero_filled_counts(F.col("type"), types, "type_"),
        *zero_filled_counts(F.col("trigger"), triggers, "trigger_"),
        F.coalesce(F.avg("duration"), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.bool_or(F.col("iterations") == "infinite"), F.lit(False)).alias("has_infinite"),
    )


def difference_summary(differences: DataFrame, page: str, categories: list[str], flags: dict[str, str]) -> DataFrame:
    counts = differences.groupBy(page).agg(rows().alias("total"), *zero_filled_counts(F.col("category"), categories))
    return counts.select("*", *[(F.col(c) > 0).alias(name) for name, c in flags.items()])


def merge_by_key(df: DataFrame, keys: list[str], seq: str, keep_first: list[str], overwrite: list[str]) -> DataFrame:
    """Duplicates to one row: some fields from the first occurrence, others from the last that has a value."""
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.col(seq)).alias(c) for c in keep_first],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in overwrite],
    )


def keep_first(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """First row of each key by ``seq``; one row per key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_r")).select(*keys, "_r.*")


def background_key(design_type: str, css: str) -> Column:
    squeezed = F.trim(F.regexp_replace(F.lower(F.col(css)), r"\s+", " "))
    return F.concat(F.col(design_type), F.lit(":"), squeezed)


def color_histogram(colors: DataFrame, hex_col: str, keys: list[str] | None = None) -> DataFrame:
    """Count and share per exact colour. The total comes from the counts, never from the raw rows again."""
    keys = keys or []
    counts = colors.groupBy(*keys, hex_col).agg(rows().alias("n"))
    if not keys:
        total = counts.agg(F.sum("n").alias("t")).scalar()
        return counts.withColumn("share", F.col("n") / total)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return counts.join(totals, keys).select(*keys, hex_col, "n", (F.col("n") / F.col("_t")).alias("share"))


def _cut_boxes(pdf: pd.DataFrame, size: int) -> list[tuple[int, ...]]:
    """Boxes ``(r0, r1, g0, g1, b0, b1)`` of the median cut, every count and median read from one cumulative cube."""
    cube = np.zeros((257, 257, 257), np.int64)
    np.add.at(cube, (pdf["r"].to_numpy(np.int64) + 1, pdf["g"].to_numpy(np.int64) + 1, pdf["b"].to_numpy(np.int64) + 1), pdf["n"].to_numpy(np.int64))
    for axis in range(3):
        np.cumsum(cube, axis=axis, out=cube)

    def histogram(box: list[tuple[int, int]], axis: int) -> np.ndarray:
        """Rows of the box at each value of ``axis``."""
        upto = 0
        others = [i for i in range(3) if i != axis]
        for ends in itertools.product((0, 1), repeat=2):
            at: list = [slice(box[axis][0], box[axis][1] + 2)] * 3
            for i, end in zip(others, ends):
                at[i] = box[i][1] + 1 if end else box[i][0]
            upto = upto + (1 if sum(ends) % 2 == 0 else -1) * cube[tuple(at)]
        return np.diff(upto)

    def facts(box: list[tuple[int, int]]) -> tuple[int, list[int]]:
        """Rows in the box and the extent of the values present on each axis."""
        seen = [np.flatnonzero(histogram(box, axis)) for axis in range(3)]
        return int(histogram(box, 0).sum()), [int(v[-1] - v[0]) if len(v) else 0 for v in seen]

    whole = [(0, 255)] * 3
    boxes = [(whole, *facts(whole))]
    while len(boxes) < size:
        # fullest first, the earlier of equals; a box of one colour cannot be split
        at = max((i for i, (_, _, wide) in enumerate(boxes) if max(wide) > 0), key=lambda i: (boxes[i][1], -i), default=None)
        if at is None:
            break
        box, total, wide = boxes[at]
        axis = wide.index(max(wide))
        hist = histogram(box, axis)
        present = np.flatnonzero(hist)
        last = min(int(np.argmax(np.cumsum(hist) * 2 >= total)), int(present[-2])) + box[axis][0]
        halves = [[(ends if i != axis else part) for i, ends in enumerate(box)] for part in ((box[axis][0], last), (last + 1, box[axis][1]))]
        boxes[at : at + 1] = [(half, *facts(half)) for half in halves]
    return [tuple(v for ends in box for v in ends) for box, total, _ in boxes if total]


def quantize_palette(colors: DataFrame, size: int) -> DataFrame:
    """Median cut of an ``(r, g, b, n)`` colour-count table into ``size`` buckets, fewer only for fewer colours.

    The fullest bucket is split at the weighted median of its widest channel until there are ``size``. All splits are
    read from one cumulative cube of 256 x 256 x 256 counts, built by one task from the distinct colours, of which there
    are at most 2 ** 24 however large the table is; the boxes then are literals and nothing is joined. Rows with a null are
    left out.
    """
    counts = cut(colors.dropna(subset=["r", "g", "b", "n"]).groupBy("r", "g", "b").agg(F.sum("n").alias("n")))
    ends = ["r0", "r1", "g0", "g1", "b0", "b1"]

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_cut_boxes(pdf, size), columns=ends).reset_index(names="bucket")

    one = counts.select(F.lit(0).alias("all"), "r", "g", "b", F.col("n").cast("long").alias("n"))
    boxes = one.groupBy("all").applyInPandas(split, ", ".join(["bucket int", *[f"{e} int" for e in ends]])).collect()  # ``size`` rows
    if not boxes:  # an empty table
        return counts.select(*[F.col(c).cast("int").alias(c) for c in "rgb"], "n").limit(0)
    inside = lambda box: reduce(lambda c, k: c & F.col(k).between(box[f"{k}0"], box[f"{k}1"]), "rgb", F.lit(True))
    bucket = F.coalesce(*[F.when(inside(box), F.lit(box["bucket"])) for box in boxes])
    mean = lambda c: round_half_up(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int").alias(c)
    return counts.groupBy(bucket.alias("bucket")).agg(mean("r"), mean("g"), mean("b"), F.sum("n").alias("n")).drop("bucket")


def batch_result(items: DataFrame, index: str, failed: Column, on_error: str = "skip") -> DataFrame:
    """Items that count: all of them, or up to and including the first failure."""
    marked = items.withColumn("failed", failed)
    if on_error == "skip":
        return marked
    first = marked.filter("failed").agg(F.min(index).alias("i")).scalar()
    return marked.filter(first.isNull() | (F.col(index) <= first))


def batch_totals(items: DataFrame) -> DataFrame:
    return items.agg(rows().alias("total"), F.sum(flag(~F.col("failed"))).alias("succeeded"), F.sum(flag(F.col("failed"))).alias("failed"))


def circular_mean(angle: Column) -> Column:
    """Mean direction in degrees 0..360 (aggregate)."""
    a = F.radians(angle)
    deg = F.degrees(F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))))
    return F.when(deg < 0, deg + 360).otherwise(deg)


def hue_variance(hue: Column) -> Column:
    """1 - mean resultant length, 0 for fewer than two hues (aggregate)."""
    a = F.radians(hue)
    r = F.sqrt(F.pow(F.avg(F.sin(a)), F.lit(2.0)) + F.pow(F.avg(F.cos(a)), F.lit(2.0)))
    return F.when(F.count(hue) < 2, 0.0).otherwise(1 - r)


def direction_consistency(df: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """1 - mean angular distance from the mean direction / 180; 0 for fewer than two angles."""
    means = df.groupBy(*keys).agg(circular_mean(F.col(angle)).alias("mean_direction"))
    diff = F.abs(F.col(angle) - F.col("mean_direction"))
    apart = F.least(diff, 360 - diff)
    out = df.join(means, keys).groupBy(*keys).agg(
        F.max("mean_direction").alias("mean_direction"), F.avg(apart).alias("_d"), F.count(angle).alias("n")
    )
    return out.select(*keys, "mean_direction", F.when(F.col("n") < 2, 0.0).otherwise(1 - F.col("_d") / 180).alias("consistency"))


def inventory(tables: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """Per table: rows, rows with embedding, rows worth a benchmark."""
    parts = [
        df.agg(rows().alias("total"), F.sum(flag(emb)).alias("with_embedding"), F.sum(flag(good)).alias("good")).withColumn("name", F.lit(n))
        for n, (df, emb, good) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, salt: Column | None = None) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark cuts each map task to ``n`` rows per key before the shuffle. Where keys are hot and ``n`` is large, pass
    ``salt``: a first round then cuts to ``n`` per (key, salt).
    """
    if salt is not None:
        pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", F.pmod(F.hash(salt), F.lit(64))).withColumn("_rn", F.row_number().over(pre))
        df = df.filter(F.col("_rn") <= n).drop("_rn", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def quartiles(df: DataFrame, keys: list[str], order: list[str], parts: int = 4) -> DataFrame:
    """``quartile`` 1..parts by position; the first groups take the surplus rows. ``order`` must be total."""
    from webfacts.operators.ordered import OrderedRows

    numbered = OrderedRows(df, keys, order).row_number("_i").rows()
    size = df.groupBy(*keys).agg(rows().alias("_n"))
    n, i = F.col("_n"), F.col("_i") - 1
    small, extra = F.floor(n / parts), n % parts
    wide = extra * (small + 1)
    tile = F.when(i < wide, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - wide) / F.greatest(small, F.lit(1))))
    return numbered.join(size, keys).withColumn("quartile", (tile + 1).cast("long")).drop("_i", "_n")
