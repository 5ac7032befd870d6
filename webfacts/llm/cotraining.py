"""Quality classifier by co-training (operator 7).

Two classifiers see different things of a document: one its text, as shares of word shapes and counts of the whole
text, the other its metadata: source, language and length. Both start from the labelled rows. In every round each view
scores all unlabelled rows and hands those it is sure of, with its guess, to the *other* view. A fifth of the
labelled rows is kept out of training; on it each view is calibrated (a logistic curve over its log-odds). Calibrated
log-odds are added, the prior counted once, and score every document.

Labelled rows are a bounded sample (``LABELLED_ROWS``, chosen by hash of the id). The unlabelled rows are all used: their
features are stored once, executors sum gradients and Hessians over every row handed over, and only those sums reach
the driver. Rows of a stratum (class, source and language slot) count fully until their weight reaches ``STRATUM_WEIGHT``
together; more of them share that weight, so a hot source cannot drown the others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.llm.common import stored
from webfacts.llm.quality_rules import text_counts
from webfacts.session import cut

LABELLED_ROWS = 8_000
ROUNDS = 4
SURE = 0.95
STRATUM_WEIGHT = 400
KEEP = 0.5
HELD_OUT = 5
SEED = 7

SHAPES, SOURCES, LANGS = 96, 64, 16
STRATA = (SOURCES + LANGS + 2) ** 2
#: Groups that the partitions' sums are added up in before the driver adds those.
SUM_GROUPS = 16
_SHAPE = bytes(
    ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else ord(" ") if b in b" \t\n\x0b\x0c\r" else b for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)


def text_view(text: str | None) -> np.ndarray:
    """Shares of hashed word shapes (``Word,`` is ``Xx,``) and ratios of whole-text counts; zeros for no words."""
    words, chars, symbols, dup, repeat, lines, closed, upper, letters, marks = text_counts(text)[:10]
    out = np.zeros(SHAPES + 8)
    if not words:
        return out
    shapes, counts = np.unique(_RUNS.sub(rb"\1", (text or "").encode("utf-8", "surrogatepass").translate(_SHAPE)).split(), return_counts=True)
    for shape, n in zip(shapes, counts):
        out[crc32(shape) % SHAPES] += n / words
    out[SHAPES:] = [
        min(symbols / words, 4), dup / max(lines, 1), repeat / words, closed / max(lines, 1), upper / max(letters, 1), min(marks / words, 4), min(chars / words, 20) / 10, math.log1p(words) / 10
    ]
    return out


def meta_view(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed source and language (an own place for null) and the logarithm of the length."""
    out = np.zeros(SOURCES + LANGS + 3)
    out[SOURCES + LANGS if source is None else crc32(source.encode()) % SOURCES] = 1
    out[SOURCES + LANGS + 1 if lang is None else SOURCES + crc32(lang.encode()) % LANGS] = 1
    out[-1] = 0 if n_chars is None or n_chars != n_chars else math.log1p(max(n_chars, 0)) / 10
    return out


class Logistic:
    """Logistic regression with an L2 penalty by Newton steps; classes are weighed equally."""

    def __init__(self, penalty: float = 1.0, steps: int = 25):
        self.penalty, self.steps = penalty, steps
        self.w: np.ndarray | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        x = np.hstack([x, np.ones((len(x), 1))])
        n, pos = len(y), y.sum()
        weight = np.where(y == 1, n / max(2 * pos, 1), n / max(2 * (n - pos), 1))
        w = np.zeros(x.shape[1])
        ridge = np.full(len(w), self.penalty)
        ridge[-1] = 1e-6
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + ridge * w
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
            step = np.linalg.solve(hessian, gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over log-odds; a view that says nothing gets slope near zero."""
    x = np.column_stack([np.clip(odds, -15, 15), np.ones(len(odds))])
    w, ridge = np.array([0.0, 0.0]), np.diag([1.0, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


class CoTrained:
    """Both views with their calibration, and the prior log-odds of good."""

    def __init__(self, views: list[Logistic], curves: list[tuple[float, float]], prior: float):
        self.views, self.curves, self.prior = views, curves, prior

    def view_odds(self, x: list[np.ndarray]) -> list[np.ndarray]:
        return [a * np.clip(v.log_odds(f), -15, 15) + b for v, (a, b), f in zip(self.views, self.curves, x)]

    def score(self, x: list[np.ndarray]) -> np.ndarray:
        text, meta = self.view_odds(x)
        return 1 / (1 + np.exp(-np.clip(text + meta - self.prior, -500, 500)))


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian (flat, one array) of weighted rows at ``w``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    z = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-z))
    loss = (weight * (np.logaddexp(0, z) - y * z)).sum()
    return np.concatenate([[loss], x.T @ (weight * (p - y)), ((x * (weight * p * (1 - p))[:, None]).T @ x).ravel()])


def _handed(x: list[np.ndarray], history: list[CoTrained], sure: float) -> list[np.ndarray]:
    """For each view the guess it was handed for a row in the rounds so far, else NaN. A row is handed over once."""
    left = np.ones(len(x[0]), bool)
    guesses = [np.full(len(left), np.nan) for _ in x]
    for model in history:
        odds = model.view_odds(x)
        for view in (0, 1):
            p = 1 / (1 + np.exp(-odds[view]))
            for guess, trust in ((1.0, p), (0.0, 1 - p)):
                pick = left & (trust >= sure)
                left &= ~pick
                guesses[1 - view][pick] = guess
    return guesses


def _handed_counts(x: list[np.ndarray], stratum: np.ndarray, history: list[CoTrained], sure: float) -> np.ndarray:
    """Rows handed over by receiving view, guess and stratum, flat."""
    out = np.zeros((2, 2, STRATA))
    for view, y in enumerate(_handed(x, history, sure)):
        for guess in (0, 1):
            out[view, guess] = np.bincount(stratum[y == guess], minlength=STRATA)
    return out.ravel()


def _handed_sums(x: list[np.ndarray], stratum: np.ndarray, history: list[CoTrained], sure: float, weights: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """``_sums`` of the rows handed to each view, one after the other; ``weights`` by view, guess and stratum."""
    parts = []
    for view, y in enumerate(_handed(x, history, sure)):
        on = ~np.isnan(y)
        parts.append(_sums(x[view][on], y[on], weights[view][y[on].astype(int), stratum[on]], at[view]))
    return np.concatenate(parts)


#: Adds up ``f(features, strata)`` over all unlabelled rows.
Total = Callable[[Callable[[list[np.ndarray], np.ndarray], np.ndarray]], np.ndarray]


def _fit_handed(views: list[Logistic], x: list[np.ndarray], y: np.ndarray, total: Total, history: list[CoTrained], sure: float, stratum_weight: float) -> list[Logistic]:
    """Newton steps from ``views`` over the labelled rows and all rows handed over; a step that raises the loss is halved."""
    counts = total(lambda f, s: _handed_counts(f, s, history, sure)).reshape(2, 2, STRATA)
    share = np.minimum(1.0, stratum_weight / np.maximum(counts, 1))
    sizes = [f.shape[1] + 1 for f in x]
    balance = []
    for view in (0, 1):
        pos, neg = y.sum() + (counts * share)[view, 1].sum(), len(y) - y.sum() + (counts * share)[view, 0].sum()
        balance.append(np.array([(pos + neg) / max(2 * neg, 1), (pos + neg) / max(2 * pos, 1)]))
    weights = share * np.stack(balance)[:, :, None]
    ridges = [np.append(np.full(n - 1, v.penalty), 1e-6) for n, v in zip(sizes, views)]
    last = [v.w.copy() for v in views]
    trial, best, step, open_ = [w.copy() for w in last], [np.inf] * 2, [np.zeros(n) for n in sizes], [True, True]
    for _ in range(views[0].steps):
        far = total(lambda f, s: _handed_sums(f, s, history, sure, weights, trial))  # noqa: B023
        for view, n in enumerate(sizes):
            mine, far = far[: 1 + n + n * n], far[1 + n + n * n :]
            if not open_[view]:
                continue
            mine = mine + _sums(x[view], y, balance[view][y.astype(int)], trial[view])
            loss = mine[0] + (ridges[view] * trial[view] ** 2).sum() / 2
            if loss > best[view] + 1e-9 * abs(best[view]):
                step[view] = step[view] / 2
            else:
                best[view], last[view] = loss, trial[view]
                hessian = mine[1 + n :].reshape(n, n) + np.diag(ridges[view])
                step[view] = np.linalg.solve(hessian, mine[1 : 1 + n] + ridges[view] * last[view])
            trial[view] = last[view] - step[view]
            if np.abs(step[view]).max() < 1e-3:
                open_[view], last[view] = False, trial[view]
        if not any(open_):
            break
    out = [Logistic(v.penalty, v.steps) for v in views]
    for v, w in zip(out, last):
        v.w = w
    return out


def co_train(x: list[np.ndarray], y: np.ndarray, held: np.ndarray, pool: list[np.ndarray] | Total, rounds: int = ROUNDS, sure: float = SURE, stratum_weight: float = STRATUM_WEIGHT) -> CoTrained:
    """Train both views on ``x[view]``, ``y``; ``held`` rows calibrate; the pool is unlabelled.

    ``pool`` holds the rows of each view (one stratum), or adds up a function over rows that lie elsewhere.
    With one class only, or no rows, both views abstain and every score is the smoothed share of good.
    """
    prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    train = ~held
    if len(np.unique(y[train])) < 2 or len(np.unique(y[held])) < 2:
        flat = [Logistic() for _ in x]
        for v, f in zip(flat, x):
            v.w = np.zeros(f.shape[1] + 1)
        return CoTrained(flat, [(0.0, prior)] * 2, prior)
    total = pool if callable(pool) else lambda f: f(pool, np.zeros(len(pool[0]), int))
    mine, known = [f[train] for f in x], y[train].astype(float)
    views = [Logistic().fit(f, known) for f in mine]
    history: list[CoTrained] = []
    while True:
        curves = [_calibrate(v.log_odds(f[held]), y[held]) for v, f in zip(views, x)]
        model = CoTrained(views, curves, prior)
        if len(history) == rounds:
            return model
        history.append(model)
        views = _fit_handed(views, mine, known, total, list(history), sure, stratum_weight)


def _packed(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.Series:
    """Features of a row as 32-bit numbers: text view, places of source and language, logarithm of the length."""
    out = []
    for t, s, g, n in zip(text, source, lang, n_chars):
        meta = meta_view(s, g, n)
        out.append(np.concatenate([text_view(t), np.nonzero(meta[:-1])[0], meta[-1:]]).astype(np.float32).tobytes())
    return pd.Series(out, dtype=object)


def _unpacked(rows: pd.Series) -> tuple[list[np.ndarray], np.ndarray]:
    """Both views and the stratum of packed rows."""
    flat = np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), SHAPES + 11).astype(np.float64)
    places, meta, at = np.sort(flat[:, SHAPES + 8 : -1].astype(int), axis=1), np.zeros((len(flat), SOURCES + LANGS + 3)), np.arange(len(flat))
    meta[at, places[:, 0]], meta[at, places[:, 1]], meta[:, -1] = 1, 1, flat[:, -1]
    return [flat[:, : SHAPES + 8], meta], places[:, 0] * (SOURCES + LANGS + 2) + places[:, 1]


def _total_over(pool: DataFrame) -> Total:
    """Sums over the stored rows, a partition at a time; the partitions' sums are added in ``SUM_GROUPS`` groups first."""

    def total(f: Callable[[list[np.ndarray], np.ndarray], np.ndarray]) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = sum(f(*_unpacked(b["x"])) for b in batches if len(b))
            if isinstance(found, np.ndarray):
                yield pd.DataFrame({"v": [found.astype(np.float64).tobytes()]})

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"v": [np.sum([np.frombuffer(v) for v in rows["v"]], axis=0).tobytes()]})

        parts = pool.select("x").mapInPandas(part, "v binary").withColumn("g", F.spark_partition_id() % SUM_GROUPS)
        got = [np.frombuffer(r.v) for r in parts.groupBy("g").applyInPandas(add, "v binary").collect()]
        none = [np.zeros((0, SHAPES + 8)), np.zeros((0, SOURCES + LANGS + 3))], np.zeros(0, int)
        return np.sum(got, axis=0) if got else f(*none)

    return total


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
    n_chars: str = "n_chars", label: str = "quality", labelled_rows: int = LABELLED_ROWS, keep: float = KEEP,
) -> DataFrame:
    """One row per document: id, ``p_text``, ``p_meta``, ``score``, ``kept`` (score >= ``keep``).

    Any column may hold nulls: a null text has no words, null metadata has a place of its own, null ids and null labels
    teach nothing. Ids with contrary labels count once per label. Repeated rows score alike; without labels of both
    classes every score is the share of good; an empty table gives no rows.
    """
    pack = F.pandas_udf(_packed, "binary").asNondeterministic()
    base = stored(docs.select(F.col(doc_id).alias("id"), pack(F.col(text), F.col(source), F.col(lang), F.col(n_chars).cast("double")).alias("x")))
    known = labels.select(F.col(doc_id).alias("s_id"), F.col(label).cast("double").alias("y")).filter("s_id IS NOT NULL AND y IS NOT NULL").distinct()
    order = [F.xxhash64(F.lit(SEED), "s_id"), F.col("s_id"), F.col("y")]
    taught = cut(known.orderBy(*order).limit(labelled_rows))
    seen = base.join(F.broadcast(taught), F.col("id") == F.col("s_id")).select("id", "y", "x").toPandas().sort_values(["id", "y", "x"], ignore_index=True)
    pool = stored(base.filter("id IS NOT NULL").join(known.select("s_id").distinct(), F.col("id") == F.col("s_id"), "left_anti").select("x"))
    held = seen["id"].map(lambda i: crc32(f"{SEED}:{i}".encode()) % HELD_OUT == 0).to_numpy(dtype=bool)
    model = co_train(_unpacked(seen["x"])[0], seen["y"].to_numpy(dtype=float), held, _total_over(pool))

    def scores(x: pd.Series) -> pd.DataFrame:
        f = _unpacked(x)[0]
        a, b = (1 / (1 + np.exp(-np.clip(o, -500, 500))) for o in model.view_odds(f))
        return pd.DataFrame({"p_text": a, "p_meta": b, "score": model.score(f)})

    scored: Column = F.pandas_udf(scores, "p_text double, p_meta double, score double").asNondeterministic()("x")
    out = base.select(F.col("id").alias(doc_id), scored.alias("s")).select(doc_id, "s.*")
    return out.withColumn("kept", F.col("score") >= keep)
