"""Metric series: ``(series, order, value)`` rows, frame regions, sessions, periodicity, categories.

A series may be larger than one task, so ordered steps go through :class:`OrderedRows`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webfacts.functions.base import clamp, flag, round_half_up
from webfacts.functions.text import arg_max
from webfacts.operators.ordered import BLOCK, OrderedRows


def statistics(df: DataFrame, series: str, value: str, threshold: float = 0.01) -> DataFrame:
    v = F.col(value)
    return df.groupBy(series).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("avg"),
        F.max(v).alias("max"),
        F.min(v).alias("min"),
        F.stddev_pop(v).alias("stddev"),
        F.sum(flag(v > threshold)).alias("changed"),
    )


def movements(frames: DataFrame, series: str, order: list[str], regions: str, width: float, height: float) -> DataFrame:
    """``movement`` per region: distance to the same-index region of the frame before over the longer side."""
    o = OrderedRows(frames, [series], order).previous(_before=regions)
    longer = float(max(width, height))

    def step(now: Column, old: Column) -> Column:
        dx, dy = now["x"] - old["x"], now["y"] - old["y"]
        return F.sqrt(dx * dx + dy * dy) / longer

    return o.rows().withColumn("movement", F.zip_with(F.col(regions), F.coalesce("_before", F.slice(regions, 1, 0)), step)).drop("_before")


def shift_scores(frames: DataFrame, series: str, frame: str, regions: str, change: str, width: float, height: float) -> DataFrame:
    """Layout-shift score per frame: sum over regions of visible share times distance share."""
    if width <= 0 or height <= 0:
        raise ValueError("viewport sides must be positive")
    moved = movements(frames, series, [frame], regions, width, height)

    def part(region: Column, m: Column) -> Column:
        across = F.least(F.lit(float(width)), region["x"] + region["width"]) - F.greatest(F.lit(0.0), region["x"])
        down = F.least(F.lit(float(height)), region["y"] + region["height"]) - F.greatest(F.lit(0.0), region["y"])
        seen = F.greatest(F.lit(0.0), across) * F.greatest(F.lit(0.0), down) / float(width * height)
        return clamp(seen, 0.0, 1.0) * clamp(F.coalesce(m, F.col(change) * 0.1), 0.0, 1.0)

    # movement may be longer than regions when the frame before had more of them
    scores = F.zip_with(F.col(regions), F.slice("movement", F.lit(1), F.size(regions)), part)
    return moved.select(
        series, frame, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x).alias("cls"), F.size(regions).alias("shifts")
    )


def gap_sessions(df: DataFrame, series: str, order: list[str], position: str, gap: float) -> DataFrame:
    """Rows with ``session`` (1-based per series): a new one starts when the step is larger than ``gap``."""
    o = OrderedRows(df, [series], order).previous(_p=position)
    new = flag(F.col("_p").isNull() | (F.col(position) - F.col("_p") > gap)).cast("long")
    return o.running_sum(session=new).rows().drop("_p")


def _next_starts(frames: np.ndarray, gap: float, longest: float) -> tuple[np.ndarray, int]:
    """For every row taken as a window start the row that starts the next window, and the first gap (n = none)."""
    n = len(frames)
    breaks = np.r_[np.flatnonzero(np.diff(frames) > gap) + 1, n]
    by_gap = breaks[np.searchsorted(breaks, np.arange(n), side="right")]
    return np.minimum(np.searchsorted(frames, frames + longest, side="right"), by_gap), int(breaks[0])


def session_windows(shifts: DataFrame, series: str, frame: str, score: str, count: str, gap: float = 30, longest: float = 150) -> DataFrame:
    """Session windows with a largest gap and a largest length: ``start, end, cls, shifts`` per window.

    The length rule depends on where the window before started, so windows form a chain. The blocks of a
    long series are chained without bringing them together: the start a chain leaves a block with is a
    monotone step function of the frame limit it enters with, with at most ``longest + 1`` steps for whole
    frames. Only those steps go to the fold over blocks.
    """
    per_frame = shifts.groupBy(series, frame).agg(F.sum(score).alias("cls"), F.sum(count).alias("shifts"))
    o = OrderedRows(per_frame.filter("cls > 0 AND shifts > 0"), [series], [frame])
    df = o.df
    kind = dict(df.dtypes)[series]
    every = Window.partitionBy(series)
    spread = df.groupBy(series, BLOCK).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.count(F.lit(1)).over(every))
    crossing = F.broadcast(spread.filter("_b > 1").select(series, BLOCK))  # at most 2 rows per partition

    def steps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.sort(pdf[frame].to_numpy(dtype=np.float64))
        nxt, gap_at = _next_starts(f, gap, longest)
        leave = np.arange(len(f))
        for i in range(len(f) - 1, -1, -1):
            if nxt[i] < len(f):
                leave[i] = leave[nxt[i]]
        keep = np.r_[True, np.diff(leave) != 0]
        above = np.r_[-np.inf, f[:-1]]
        broken = gap_at < len(f)
        return pd.DataFrame(
            {
                series: key[0],
                BLOCK: np.int32(key[1]),
                "above": above[keep],
                "leave": f[leave[keep]],
                "first": f[0],
                "last": f[-1],
                "gap_frame": f[gap_at] if broken else np.inf,
                "gap_leave": f[leave[gap_at]] if broken else np.inf,
            }
        )

    def chain(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, start, last = [], None, None
        for block, part in pdf.groupby(BLOCK, sort=True):
            part = part.sort_values("above")
            head = part.iloc[0]
            joined = start is not None and head["first"] - last <= gap
            out.append((key[0], np.int32(block), start if joined else np.nan))
            limit = start + longest if joined else -np.inf
            if head["gap_frame"] <= limit:
                start = head["gap_leave"]
            elif head["last"] > limit:
                start = part["leave"].to_numpy()[np.searchsorted(part["above"].to_numpy(), limit, side="right") - 1]
            last = head["last"]
        return pd.DataFrame(out, columns=[series, BLOCK, "entry"])

    table = df.join(crossing, [series, BLOCK], "left_semi").groupBy(series, BLOCK).applyInPandas(
        steps,
        f"{series} {kind}, {BLOCK} int, above double, leave double, first double, last double, gap_frame double, gap_leave double",
    )
    entries = table.groupBy(series).applyInPandas(chain, f"{series} {kind}, {BLOCK} int, entry double")

    def label(batches):
        """Rows sorted by (series, block, frame); only the open window is kept between batches."""
        key, start, last = None, np.nan, np.nan
        for pdf in batches:
            if not len(pdf):
                continue
            f = pdf[frame].to_numpy(dtype=np.float64)
            ids, blocks, entries_ = pdf[series].to_numpy(), pdf[BLOCK].to_numpy(), pdf["entry"].to_numpy(dtype=np.float64)
            edges = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]) | (blocks[1:] != blocks[:-1])) + 1, len(f)]
            begin = np.empty(len(f))
            for lo, hi in zip(edges[:-1], edges[1:]):
                part = f[lo:hi]
                nxt, gap_at = _next_starts(part, gap, longest)
                if key != (ids[lo], blocks[lo]):
                    key, start = (ids[lo], blocks[lo]), entries_[lo]
                elif part[0] - last > gap:
                    start = np.nan
                at = 0
                if not np.isnan(start):
                    at = min(int(np.searchsorted(part, start + longest, side="right")), gap_at)
                    begin[lo : lo + at] = start
                while at < len(part):
                    start = part[at]
                    begin[lo + at : lo + nxt[at]] = start
                    at = nxt[at]
                last = part[-1]
            yield pdf[[series, frame, "cls", "shifts"]].assign(start=begin)

    placed = df.join(F.broadcast(entries), [series, BLOCK], "left").repartition(series, BLOCK).sortWithinPartitions(series, BLOCK, frame)
    marked = placed.select(series, BLOCK, frame, "cls", "shifts", "entry").mapInPandas(label, f"{series} {kind}, {frame} long, cls double, shifts long, start double")
    return marked.groupBy(series, F.col("start").cast("long").alias("start")).agg(
        F.max(frame).alias("end"), F.sum("cls").alias("cls"), F.sum("shifts").alias("shifts")
    )


def sequence_shift(shifts: DataFrame, series: str, frame: str, score: str = "cls", count: str = "shifts", gap: float = 30, longest: float = 150) -> DataFrame:
    """Per series: total score, score of the worst session window (the total without one) and its class."""
    total = shifts.groupBy(series).agg(F.sum(score).alias("total"))
    worst = session_windows(shifts, series, frame, score, count, gap, longest).groupBy(series).agg(F.max("cls").alias("_w"))
    out = total.join(worst, series, "left").select(series, "total", F.coalesce("_w", "total").alias("worst_window"))
    return out.withColumn("class", shift_class(F.col("worst_window")))


def shift_class(cls: Column) -> Column:
    return F.when(cls < 0.1, "good").when(cls < 0.25, "needs-improvement").otherwise("poor")


def with_neighbours(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Rows with ``before`` and ``after`` values of the series."""
    return OrderedRows(df, [series], order).previous(before=value).following(after=value).rows()


def change_scores(df: DataFrame, series: str, order: list[str], value: str) -> DataFrame:
    """Directional, sporadic and randomness score per series from its consecutive differences."""
    rows = with_neighbours(df, series, order, value)
    means = df.groupBy(series).agg(F.avg(value).alias("_mean"))
    v, up, down = F.col(value), F.col(value) - F.col("before"), F.col("after") - F.col(value)
    inner = F.col("before").isNotNull() & F.col("after").isNotNull()
    same = ((up >= 0) & (down >= 0)) | ((up <= 0) & (down <= 0))
    turn = ((up >= 0) & (down < 0)) | ((up < 0) & (down >= 0))
    agg = rows.join(means, series).groupBy(series).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(flag(inner & same)).alias("same"),
        F.sum(flag(inner & turn)).alias("turns"),
        F.sum(flag(F.abs(v - F.col("before")) > 2 * F.col("_mean"))).alias("jumps"),
    )
    n, half = F.col("n"), (F.col("n") - 1) / 2
    return agg.select(
        series,
        F.when(n < 3, 0.0).otherwise(F.col("same") / (n - 2)).alias("directional"),
        F.when(n < 2, 0.0).otherwise(F.col("jumps") / (n - 1)).alias("sporadic"),
        F.when(n < 3, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("turns") + 1 - half) / half)).alias("randomness"),
    )


def runs_above(df: DataFrame, series: str, order: list[str], value: str, threshold: float) -> DataFrame:
    """Runs of consecutive rows above the threshold: ``first, last, length`` (0-based positions)."""
    above = F.col(value) > threshold
    o = OrderedRows(df.withColumn("_a", flag(above).cast("long")), [series], order).running_sum(_i=F.lit(1).cast("long"), _r=F.col("_a"))
    rows = o.rows().filter("_a = 1").withColumn("_island", F.col("_i") - F.col("_r"))
    return rows.groupBy(series, "_island").agg(
        (F.min("_i") - 1).alias("first"), (F.max("_i") - 1).alias("last"), F.count(F.lit(1)).alias("length")
    ).drop("_island")


def change_pattern(df: DataFrame, series: str, order: list[str], value: str, threshold: float = 0.01) -> DataFrame:
    """Spikes (above twice the threshold) with their mean spacing, mean length of change runs, dynamic share."""
    durations = runs_above(df, series, order, value, threshold).groupBy(series).agg(F.avg("length").alias("avg_duration"))
    spikes = runs_above(df, series, order, value, 2 * threshold).groupBy(series).agg(
        F.sum("length").alias("spikes"), F.min("first").alias("_f"), F.max("last").alias("_l")
    )
    share = df.groupBy(series).agg(F.avg(flag(F.col(value) > threshold).cast("double")).alias("dynamic"))
    out = share.join(durations, series, "left").join(spikes, series, "left")
    many = F.col("spikes") > 1
    return out.select(
        series,
        F.coalesce("spikes", F.lit(0)).alias("spikes"),
        F.when(many, (F.col("_l") - F.col("_f")) / (F.col("spikes") - 1)).otherwise(0.0).alias("avg_spike_period"),
        F.coalesce("avg_duration", F.lit(0.0)).alias("avg_duration"),
        "dynamic",
    )


CHUNK = 65536


def autocorrelation(df: DataFrame, series: str, order: list[str], value: str, max_lag: int = 60, min_lag: int = 0) -> DataFrame:
    """``(series, lag, acf)`` for lags up to ``min(max_lag, n div 2)``.

    Rows are numbered and cut into chunks; each chunk also receives the first ``max_lag`` rows of the next
    one, so all lags come from one window per chunk instead of one self-join per lag.
    """
    numbered = OrderedRows(df.select(series, *order, F.col(value).cast("double").alias("_v")), [series], order).row_number("_i").rows()
    stats = df.groupBy(series).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"), F.count(F.lit(1)).alias("_n"))
    x = numbered.join(stats, series).filter("_var > 0").select(
        series, (F.col("_i") - 1).alias("_i"), (F.col("_v") - F.col("_mean")).alias("_x"), "_n", "_var"
    )
    chunk, inside = F.floor(F.col("_i") / CHUNK), F.pmod(F.col("_i"), F.lit(CHUNK))
    places = F.when((inside < max_lag) & (F.col("_i") >= CHUNK), F.array(F.struct(chunk.alias("c"), F.lit(True).alias("own")), F.struct((chunk - 1).alias("c"), F.lit(False).alias("own"))))
    placed = x.withColumn("_p", F.explode(F.coalesce(places, F.array(F.struct(chunk.alias("c"), F.lit(True).alias("own"))))))
    placed = placed.select(series, "_i", "_x", "_n", "_var", F.col("_p.c").alias("_c"), F.col("_p.own").alias("_own"))
    w = Window.partitionBy(series, "_c").orderBy("_i")
    lags = list(range(min_lag, max_lag + 1))
    ahead = placed.select("*", *[F.lead("_x", lag).over(w).alias(f"_l{lag}") for lag in lags])
    sums = ahead.filter("_own").groupBy(series).agg(
        F.max("_n").alias("_n"), F.max("_var").alias("_var"), *[F.sum(F.col("_x") * F.col(f"_l{lag}")).alias(f"_s{lag}") for lag in lags]
    )
    long = F.explode(F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"_s{lag}").alias("_sum")) for lag in lags])).alias("_e")
    out = sums.select(series, "_n", "_var", long).select(series, "_n", "_var", "_e.*")
    out = out.filter(F.col("lag") <= F.floor(F.col("_n") / 2))
    return out.select(series, "lag", (F.col("_sum") / ((F.col("_n") - F.col("lag")) * F.col("_var"))).alias("acf"))


def period(acf: DataFrame, series: str, fps: float = 30) -> DataFrame:
    """Best local maximum after the first local minimum of the autocorrelation. At most ``max_lag`` rows per series."""
    w = Window.partitionBy(series).orderBy("lag")
    near = acf.select("*", F.lag("acf").over(w).alias("_p"), F.lead("acf").over(w).alias("_q"))
    low = F.when((F.col("acf") < F.col("_p")) & (F.col("acf") < F.col("_q")), F.col("lag"))
    marked = near.withColumn("_low", F.min(low).over(Window.partitionBy(series)))
    peak = (F.col("acf") > F.col("_p")) & (F.col("acf") > F.col("_q")) & (F.col("lag") > F.col("_low")) & (F.col("acf") > 0)
    best = marked.groupBy(series).agg(F.max(F.when(peak, F.struct("acf", (-F.col("lag")).alias("l")))).alias("b"))
    lag = F.coalesce(-F.col("b.l"), F.lit(0))
    return best.select(
        series,
        clamp(F.coalesce(F.col("b.acf"), F.lit(0.0)), 0.0, 1.0).alias("score"),
        lag.alias("period_frames"),
        round_half_up(lag / fps * 1000).alias("period_ms"),
    )


def directions(frames: DataFrame, series: str, order: list[str], x: str, y: str, minimum: float = 5) -> DataFrame:
    """Direction (degrees, 0 = up) and distance between consecutive centres; moves of up to ``minimum`` per axis dropped."""
    o = OrderedRows(frames, [series], order).previous(_x=x, _y=y).rows()
    dx, dy = F.col(x) - F.col("_x"), F.col(y) - F.col("_y")
    deg = F.degrees(F.atan2(dx, -dy))
    moved = (F.abs(dx) > minimum) | (F.abs(dy) > minimum)
    return o.filter(moved).select(
        series, *order, dx.alias("dx"), dy.alias("dy"), F.when(deg < 0, deg + 360).otherwise(deg).alias("direction"), F.sqrt(dx * dx + dy * dy).alias("distance")
    )


def direction_summary(moves: DataFrame, series: str, minimum: float = 5) -> DataFrame:
    """Dominant direction, consistency and the share of moves per side."""
    from webfacts.operators.aggregates import direction_consistency

    sides = {"up": F.col("dy") < -minimum, "down": F.col("dy") > minimum, "left": F.col("dx") < -minimum, "right": F.col("dx") > minimum}
    shares = moves.groupBy(series).agg(*[F.avg(flag(c).cast("double")).alias(n) for n, c in sides.items()])
    return direction_consistency(moves, [series], "direction").join(shares, series)


# Bands of the animation categories (canvas change ratios).
_FADE_CHANGE, _FADE_STD = 0.05, 0.02
_PULSE_STD, _PULSE_PERIODICITY = 0.03, 0.6
_WAVE_DIRECTION, _WAVE_CHANGE = 0.5, (0.02, 0.2)
_PARTICLE_SPORADIC, _PARTICLE_CHANGE = 0.6, 0.1
_ROTATION_PERIODICITY, _ROTATION_CHANGE = 0.7, (0.03, 0.15)
_PARALLAX_DIRECTION, _PARALLAX_CHANGE = 0.7, (0.01, 0.1)
_NOISE_RANDOMNESS, _COMPLEX_CHANGE = 0.7, 0.15


def series_features(df: DataFrame, series: str, order: list[str], value: str, max_lag: int = 60) -> DataFrame:
    base = statistics(df, series, value).select(series, "n", "avg", "stddev")
    beat = period(autocorrelation(df, series, order, value, max_lag, min_lag=1), series)
    beat = beat.select(series, F.col("score").alias("periodicity"), "period_frames")
    out = base.join(change_scores(df, series, order, value), series).join(beat, series, "left")
    short = F.least(F.lit(max_lag), F.floor(F.col("n") / 2)) < 2
    return out.withColumn("periodicity", F.when(short, 0.0).otherwise(F.coalesce("periodicity", F.lit(0.0)))).withColumn(
        "period_frames", F.when(short, 0).otherwise(F.coalesce("period_frames", F.lit(0)))
    )


def animation_category(features: DataFrame, minimum: float = 0.3) -> DataFrame:
    """Category with the best score; below ``minimum`` it is complex."""
    avg, std, per = F.col("avg"), F.col("stddev"), F.col("periodicity")
    way, jump, rnd = F.col("directional"), F.col("sporadic"), F.col("randomness")

    def points(*terms: tuple[Column, float]) -> Column:
        out = F.lit(0.0)
        for cond, p in terms:
            out = out + F.when(cond, p).otherwise(0.0)
        return F.least(F.lit(1.0), out)

    scores = {
        "fade": points((avg < _FADE_CHANGE, 0.4), (std < _FADE_STD, 0.4), (way > 0.6, 0.2)),
        "pulse": points((per > _PULSE_PERIODICITY, 0.5), (std > _PULSE_STD, 0.3), ((avg > 0.02) & (avg < 0.2), 0.2)),
        "wave": points((way > _WAVE_DIRECTION, 0.4), (avg.between(*_WAVE_CHANGE), 0.3), ((per > 0.3) & (per < 0.8), 0.3)),
        "particle": points((jump > _PARTICLE_SPORADIC, 0.4), (avg > _PARTICLE_CHANGE, 0.3), (per < 0.3, 0.3)),
        "rotation": points((per > _ROTATION_PERIODICITY, 0.5), (avg.between(*_ROTATION_CHANGE), 0.3), (jump < 0.3, 0.2)),
        "parallax": points((way > _PARALLAX_DIRECTION, 0.4), (avg.between(*_PARALLAX_CHANGE), 0.4), (jump < 0.2, 0.2)),
        "noise": points((rnd > _NOISE_RANDOMNESS, 0.5), (per < 0.3, 0.3), (way < 0.3, 0.2)),
        "complex": F.when((avg > _COMPLEX_CHANGE) | ((std > 0.05) & (per < 0.5)), 0.3).otherwise(0.1),
    }
    named = features.select("*", *[c.alias(f"_s_{n}") for n, c in scores.items()])
    name, best = arg_max({n: F.col(f"_s_{n}") for n in scores})
    return named.select(
        *features.columns,
        F.when(best < minimum, "complex").otherwise(name).alias("category"),
        F.when(best < minimum, F.col("_s_complex")).otherwise(best).alias("confidence"),
    )


def fade_events(df: DataFrame, series: str, frame: str, alpha: str, threshold: float = 0.1, min_frames: int = 3, fps: float = 30) -> DataFrame:
    """Fade-in and fade-out events of an opacity series.

    A calm frame (step below 0.001) ends any fade, so the stretches between calm frames are independent.
    They are split by a distributed running count; only one stretch at a time is folded in order.
    """
    if threshold <= 0.01:
        raise ValueError("threshold must be above 0.01: below it a calm step could start a fade")
    o = OrderedRows(df, [series], [frame]).previous(_p=alpha)
    calm = flag(F.col("_p").isNull() | (F.abs(F.col(alpha) - F.col("_p")) < 0.001)).cast("long")
    stretches = o.running_sum(_i=F.lit(1).cast("long"), _calm=calm).rows()
    kind = dict(df.dtypes)[series]

    def events(ident, a: np.ndarray, f: np.ndarray, out: list) -> None:
        begin, up = None, False  # row 0 is the calm frame the stretch starts from

        def close(end: int) -> None:
            change = abs(a[end] - a[begin])
            if end - begin + 1 >= min_frames and change >= threshold:
                out.append((ident, "fade_in" if up else "fade_out", int(f[begin]), int(f[end]), change, (end - begin + 1) * 1000.0 / fps))

        for i in range(1, len(a)):
            strong = abs(a[i] - a[i - 1]) > threshold * 0.1
            if begin is not None and (a[i] == a[begin] or (a[i] > a[begin]) != up):
                close(i - 1)
                begin = None
            if begin is None and strong:
                begin, up = i - 1, a[i] > a[i - 1]
        if begin is not None:
            close(len(a) - 1)

    def fold(batches):
        """Rows sorted by (series, stretch, position); the unfinished stretch is kept between batches."""
        tail = None
        for pdf in batches:
            pdf = pdf if tail is None else pd.concat([tail, pdf])
            if not len(pdf):
                continue
            ids, calm_no = pdf[series].to_numpy(), pdf["_calm"].to_numpy()
            edges = np.r_[0, np.flatnonzero((ids[1:] != ids[:-1]) | (calm_no[1:] != calm_no[:-1])) + 1]
            tail, out = pdf.iloc[edges[-1] :], []
            a, f = pdf[alpha].to_numpy(dtype=np.float64), pdf[frame].to_numpy()
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo >= min_frames:
                    events(ids[lo], a[lo:hi], f[lo:hi], out)
            yield pd.DataFrame(out, columns=names)
        if tail is not None:
            out = []
            events(tail[series].iloc[0], tail[alpha].to_numpy(dtype=np.float64), tail[frame].to_numpy(), out)
            yield pd.DataFrame(out, columns=names)

    names = [series, "type", "start_frame", "end_frame", "change", "duration_ms"]
    placed = stretches.select(series, "_calm", "_i", frame, alpha).repartition(series, "_calm").sortWithinPartitions(series, "_calm", "_i")
    return placed.mapInPandas(fold, f"{series} {kind}, type string, start_frame long, end_frame long, change double, duration_ms double")


def _angle(dx: Column, dy: Column) -> Column:
    deg = F.degrees(F.atan2(dy, dx))
    return F.when(deg < 0, deg + 360).otherwise(deg)


def visual_category(frames: DataFrame, series: str, frame: str, minimum: float = 0.3) -> DataFrame:
    """Category of a frame sequence: static, fade, slide, scale, parallax, complex or unknown.

    Columns: ``diff`` (share of changed pixels), ``box`` (struct x, y, width, height or null) and ``vectors``
    (array of dx, dy, magnitude). All scores are bands over per-series aggregates; only "is it monotonic" and
    the box path look at the frame before.
    """
    v = F.col("vectors")
    n_vec = F.size(v)
    pace = F.transform(v, lambda x: x["magnitude"])
    strong = F.filter(v, lambda x: x["magnitude"] > 0.5)
    mags, angles = F.transform(strong, lambda x: x["magnitude"]), F.transform(strong, lambda x: _angle(x["dx"], x["dy"]))
    mean_angle = F.aggregate(angles, F.lit(0.0), lambda s, a: s + a) / F.size(angles)
    apart = F.aggregate(angles, F.lit(0.0), lambda s, a: s + F.abs(a - mean_angle)) / F.size(angles)
    share = F.array_min(mags) / F.array_max(mags)
    layered = (F.size(strong) >= 2) & (share < 0.7) & (share > 0.1)
    lead = F.array_max(F.transform(v, lambda x: F.struct(x["magnitude"].alias("m"), x["dx"].alias("dx"), x["dy"].alias("dy"))))
    moving = F.filter(v, lambda x: x["magnitude"] > 0.1)
    spokes = F.size(F.array_distinct(F.transform(moving, lambda x: F.floor(_angle(x["dx"], x["dy"]) / 45 + 0.5))))
    per = frames.select(
        series, frame, "diff",
        (F.col("box.width") * F.col("box.height")).alias("size"),
        (F.col("box.x") + F.col("box.width") / 2).alias("cx"), (F.col("box.y") + F.col("box.height") / 2).alias("cy"),
        n_vec.alias("n_vec"), F.aggregate(pace, F.lit(0.0), lambda s, x: s + x).alias("pace"),
        F.coalesce(layered, F.lit(False)).alias("layered"), F.coalesce(layered & (apart < 30), F.lit(False)).alias("aligned"),
        F.when(lead["m"] > 0.1, F.radians(_angle(lead["dx"], lead["dy"]))).alias("lead"),
        ((F.size(moving) >= 2) & (spokes >= 2)).alias("radial"),
        F.size(strong).alias("n_strong"),
        F.aggregate(angles, F.lit(0.0), lambda s, a: s + F.sin(F.radians(a))).alias("s_sin"),
        F.aggregate(angles, F.lit(0.0), lambda s, a: s + F.cos(F.radians(a))).alias("s_cos"),
    )
    rows = OrderedRows(per, [series], [frame]).previous(pd="diff").last_known_before(ps="size", px="cx", py="cy").rows()
    step_x, step_y = F.col("cx") - F.col("px"), F.col("cy") - F.col("py")
    dist = F.sqrt(step_x * step_x + step_y * step_y)
    eps = 0.001
    agg = rows.groupBy(series).agg(
        F.count(F.lit(1)).alias("n"), F.avg("diff").alias("avg"), (F.max("diff") - F.min("diff")).alias("span"),
        (F.sum(flag(F.col("diff") < F.col("pd") - eps)) * F.sum(flag(F.col("diff") > F.col("pd") + eps)) == 0).alias("mono"),
        (F.sum(flag(F.col("size") < F.col("ps") - eps)) * F.sum(flag(F.col("size") > F.col("ps") + eps)) == 0).alias("mono_size"),
        F.sum("n_vec").alias("vecs"), F.sum("pace").alias("pace"), F.count("size").alias("boxes"),
        F.min_by("size", F.when(F.col("size").isNotNull(), F.col(frame))).alias("s0"), F.max_by("size", F.when(F.col("size").isNotNull(), F.col(frame))).alias("s1"),
        F.var_pop("cx").alias("vx"), F.var_pop("cy").alias("vy"), F.sum(flag(F.col("layered"))).alias("layered"), F.sum(flag(F.col("aligned"))).alias("aligned"),
        F.count("lead").alias("leads"), F.sqrt(F.pow(F.avg(F.sin("lead")), F.lit(2.0)) + F.pow(F.avg(F.cos("lead")), F.lit(2.0))).alias("r"),
        F.bool_or("radial").alias("radial"), F.sum(dist).alias("path"), F.sum("n_strong").alias("n_strong"), F.sum("s_sin").alias("s_sin"), F.sum("s_cos").alias("s_cos"), F.var_pop(_angle(step_x, step_y)).alias("turn"),
    )
    c = F.col
    ratio = F.when(c("s0") > 0, c("s1") / c("s0"))
    pull = F.when(c("vecs") > 0, c("pace") / c("vecs")).otherwise(0.0)
    cost = F.when(pull > 8, 0.4).when(pull > 5, 0.25).when(pull > 2, 0.15).when(pull > 0.5, 0.1).otherwise(0.0)
    level = c("avg") / 0.1
    grows = F.coalesce((c("boxes") >= 2) & ((ratio > 1.3) | (ratio < 0.77)) & (c("vx") < 500) & (c("vy") < 500), F.lit(False))
    fade = (
        F.when(grows, 0.25).when(c("span") <= 0.1, 0.2).when(level < 0.5, 0.25)
        .otherwise(clamp(F.when(c("mono") & (level > 1), 0.9).when(c("mono") & (level > 0.5), 0.6 + level * 0.2).when(level > 1.5, 0.7).when(level > 1, 0.55).otherwise(0.35) - cost, 0.0, 1.0))
    )
    by_vectors = F.when(c("leads") < 2, 0.2).when(c("r") > 0.85, 0.9).when(c("r") > 0.7, 0.75).when(c("r") > 0.5, 0.5).otherwise(0.2)
    by_boxes = F.when(c("boxes") < 2, 0.0).when(c("path") < 5, 0.1).when(c("turn") < 100, 0.8).when(c("turn") < 500, 0.5).otherwise(0.2)
    stable = (c("vx") < 100) & (c("vy") < 100)
    semi = ((c("vx") < 500) & (c("vy") < 100)) | ((c("vx") < 100) & (c("vy") < 500))
    big = (ratio > 1.5) | (ratio < 0.67)
    scale = (
        F.when(c("boxes") < 2, 0.0).when((ratio > 0.95) & (ratio < 1.05), 0.1).when(~c("mono_size"), 0.2).when(big & stable, 0.92).when(big & semi, 0.88)
        .when(c("radial") & stable, 0.85).when(stable & ((ratio > 1.1) | (ratio < 0.9)), 0.75).when((ratio > 4) | (ratio < 0.25), 0.95).when((ratio > 2.5) | (ratio < 0.4), 0.85).otherwise(0.4)
    )
    n = c("n")
    parallax = F.when((c("layered") >= n * 0.5) & (c("aligned") >= n * 0.3), 0.92).when(c("layered") >= n * 0.3, 0.85).when(c("layered") > 0, 0.6).otherwise(0.1)
    still = F.when(c("avg") < 0.01, 0.95).when(c("avg") < 0.02, 0.7).when(c("avg") < 0.03, 0.4).otherwise(0.0)
    scored = agg.withColumns({"_static": still, "_fade": fade, "_slide": F.when(c("vecs") > 0, by_vectors).otherwise(by_boxes), "_scale": F.coalesce(scale, F.lit(0.4)), "_parallax": parallax})
    names = ["static", "fade", "slide", "scale", "parallax"]
    name, best = arg_max({x: F.col(f"_{x}") for x in names})
    order = F.reverse(F.array_sort(F.array(*[F.col(f"_{x}") for x in names])))
    scored = scored.withColumns({"_name": name, "_best": best, "_second": order[1]})
    high = sum((flag(F.col(f"_{x}") > 0.4) for x in names[1:]), F.lit(0))
    second_static = (c("_static") == c("_second")) & (c("_name") != "static")
    mixed = (c("_fade") >= 0.5) & (c("_slide") >= 0.5) & c("mono") & (c("_fade") + c("_slide") > 1.3) & (c("_scale") < 0.9)
    mixed = mixed | ((high >= 2) & (c("_second") >= 0.6) & (c("_best") - c("_second") < 0.15) & (c("_best") < 0.9) & (c("_name") != "static") & ~second_static)
    # directions all over the place speak against any single category
    agree = F.sqrt(c("s_sin") * c("s_sin") + c("s_cos") * c("s_cos")) / c("n_strong")
    noise = F.when(c("n_strong") < 3, 0.0).when(agree < 0.3, 0.5).when(agree < 0.5, 0.3).when(agree < 0.7, 0.1).otherwise(0.0)
    sure = F.when(mixed, c("_best")).otherwise(clamp(c("_best") - noise, 0.0, 1.0))
    short = n <= 1
    label = F.when(short, "static").when(mixed, "complex").when(sure < minimum, "unknown").otherwise(c("_name"))
    return scored.select(
        series, label.alias("category"), F.when(short, 0.95).otherwise(sure).alias("confidence"),
        F.when(c("vecs") > 0, clamp(pull / 30, 0.0, 1.0)).otherwise(clamp(c("avg") * 2, 0.0, 1.0)).alias("intensity"),
    )
