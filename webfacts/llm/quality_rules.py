"""Quality rules as weak supervision (operator 1).

Each rule looks at counts of the whole text and votes good, bad, or abstains. How far a rule can be trusted is not
set by hand: expectation-maximisation over the votes of the whole corpus estimates, without labels, the share of good
documents and how often each rule votes good, bad or abstains on a good and on a bad document, which are its
accuracies on the two classes. A document's verdict is the posterior probability of being good. Votes are folded to distinct vote patterns first; their number is
bounded by 3 to the number of rules, whatever the corpus, so the patterns alone go to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.llm.common import fresh
from webfacts.session import cut

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
KEEP = 0.5
ROUNDS = 50
GOOD_AT_FIRST = 0.8
#: Chances of the votes bad, good and none on a bad and on a good document before the first round: rules seldom vote bad
#: on a good document, which fixes the meaning of the two classes.
VOTES_AT_FIRST = ((0.3, 0.5, 0.2), (0.02, 0.9, 0.08))
#: Rows that each chance counts for before any row is seen.
PRIOR_ROWS = 2.0

FEATURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_closed_lines long, n_upper long, n_letters long, n_marks long, n_symbol_words long, n_plain_words long"
)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
_SYMBOLS = SYMBOLS.encode()
_AROUND = ".,;:!?()\"'«»¿¡"
_SPACES = " \t\n\x0b\x0c\r"


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur at least twice; each word counts once."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    base = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    codes, step = base, 1
    while step < window:  # windows of 1, 2, ... words are numbered exactly; numbers never exceed the text's length
        codes = np.unique(codes[: len(codes) - 1] * n + base[step:], return_inverse=True)[1]
        step += 1
    twice = np.bincount(codes)[codes] >= 2
    edges = np.zeros(n + 1, np.int64)
    at = np.nonzero(twice)[0]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:n])))


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of :data:`FEATURES` for one whole text; a null text has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = [w.decode("utf-8", "surrogatepass") for w in raw.split()]
    seen: set[str] = set()
    lines = again = closed = 0
    for line in (text or "").split("\n"):
        body = line.strip(_SPACES)
        if not body:
            continue
        lines += 1
        again += line in seen
        seen.add(line)
        closed += body[-1] in ".!?:;\"')"
    upper = len(raw) - len(raw.translate(None, _UPPER))
    lower = len(raw) - len(raw.translate(None, _LOWER))
    marks = raw.count(b"!") + raw.count(b"?")
    symbols = sum(map((text or "").count, SYMBOLS))
    with_symbol = sum(len(w) != len(w.translate(None, _SYMBOLS)) for w in raw.split()) if symbols else 0
    plain = sum(w.strip(_AROUND).isalpha() for w in words)
    return len(words), sum(map(len, words)), symbols, again, repeated_words(words), lines, closed, upper, upper + lower, marks, with_symbol, plain


def counts_of(text: Column) -> Column:
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([text_counts(t) for t in texts], columns=names, dtype="int64")

    # Not to be evaluated anew for each field that is used.
    return F.pandas_udf(run, FEATURES).asNondeterministic()(text)


Field = Callable[[str], Column]


def base_failed(c: Field = F.col) -> Column:
    return (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1))


def rules(c: Field = F.col) -> dict[str, Column]:
    """Votes over the counts: 1 good, 0 bad, null abstains. Ratios are compared by multiplication, so no division by zero."""
    words, lines = c("n_words"), c("n_lines")
    return {
        "length": _vote(words < MIN_WORDS, words >= 50),
        "word_length": _vote((c("word_chars") < 2 * words) | (c("word_chars") > 12 * words), (2 * c("word_chars") >= 7 * words) & (2 * c("word_chars") <= 17 * words)),
        "symbols": _vote(5 * c("n_symbols") > words, 50 * c("n_symbols") <= words),
        "symbol_words": _vote(5 * c("n_symbol_words") > words, 50 * c("n_symbol_words") <= words),
        "symbol_share": _vote(20 * c("n_symbols") > c("word_chars"), 200 * c("n_symbols") <= c("word_chars")),
        "plain_words": _vote(10 * c("n_plain_words") < 7 * words, 10 * c("n_plain_words") >= 9 * words),
        "repeated_lines": _vote(10 * c("n_dup_lines") > 4 * lines, 10 * c("n_dup_lines") <= lines),
        "repeated_words": _vote(5 * c("n_repeat_words") > words, 20 * c("n_repeat_words") <= words),
        "capitals": _vote(10 * c("n_upper") > 4 * c("n_letters"), 10 * c("n_upper") <= c("n_letters")),
        "closed_lines": _vote(10 * c("n_closed_lines") < 3 * lines, 10 * c("n_closed_lines") >= 8 * lines),
        "marks": _vote(3 * c("n_marks") > words, 20 * c("n_marks") <= words),
    }


class LabelModel:
    """Share of good documents, and for each rule and class the chances of the votes bad, good and none."""

    def __init__(self, good: float, votes: np.ndarray):
        self.good, self.votes = good, votes  # votes[class, rule, vote]

    def evidence(self) -> tuple[float, np.ndarray]:
        """Prior log-odds of good, and what each vote of each rule adds."""
        return math.log(self.good / (1 - self.good)), np.log(self.votes[1] / self.votes[0])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes 0 (bad), 1 (good) and 2 (none)."""
        prior, added = self.evidence()
        odds = prior + added[np.arange(votes.shape[1]), votes].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns. No rows leave the starting values."""
    first = np.array(VOTES_AT_FIRST)[:, None, :].repeat(patterns.shape[1], axis=1)
    model = LabelModel(GOOD_AT_FIRST, first)
    cast = np.stack([patterns == v for v in range(3)], axis=2)
    for _ in range(rounds):
        p = model.posterior(patterns)
        weights = np.stack([counts * (1 - p), counts * p])
        seen = np.einsum("cn,nrv->crv", weights, cast) + PRIOR_ROWS * first
        good = (weights[1].sum() + PRIOR_ROWS * GOOD_AT_FIRST) / (counts.sum() + PRIOR_ROWS)
        model = LabelModel(float(good), seen / seen.sum(axis=2, keepdims=True))
    return model


def _pattern(c: Field = F.col) -> Column:
    """The votes of one document as a whole number in base three."""
    total = F.lit(0)
    for vote in rules(c).values():
        total = total * 3 + F.coalesce(vote, F.lit(2))
    return total


def label_model(counted: DataFrame, c: Field = F.col) -> LabelModel:
    """The model fitted to the vote patterns of all rows."""
    k = len(rules())
    seen = sorted(counted.groupBy(_pattern(c).alias("pattern")).count().collect())  # at most 3 ** k rows
    digits = np.array([[(p // 3 ** (k - 1 - i)) % 3 for i in range(k)] for p, _ in seen], dtype=int).reshape(-1, k)
    return fit(digits, np.array([n for _, n in seen], dtype=float))


def p_good(model: LabelModel, c: Field = F.col) -> Column:
    """The posterior probability of good as an expression over the counts."""
    prior, added = model.evidence()
    odds = F.lit(prior)
    for vote, (bad, good, none) in zip(rules(c).values(), added.tolist()):
        odds = odds + F.when(vote == 1, F.lit(good)).when(vote == 0, F.lit(bad)).otherwise(F.lit(none))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def judge_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per document: id, counts, ``base_failed``, ``p_good``, ``kept``.

    Null and empty texts have zero counts and fail the base rules; repeated rows are judged alike; an empty table gives
    no rows. Texts are counted once: the counts, without the texts, are written before the votes are folded.
    """
    counted = cut(docs.select(doc_id, counts_of(F.col(text)).alias("f")).select(doc_id, "f.*"))
    out = counted.withColumn("base_failed", base_failed()).withColumn("p_good", p_good(label_model(counted)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep))


def kept_documents(docs: DataFrame, text: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns only.

    Votes are folded in one pass over the texts and applied in another, so no text is shuffled.
    """
    name = fresh(docs, "_counts")

    def c(field: str) -> Column:
        return F.col(f"{name}.{field}")

    model = label_model(docs.select(counts_of(F.col(text)).alias(name)), c)
    return docs.withColumn(name, counts_of(F.col(text))).filter(~base_failed(c) & (p_good(model, c) >= keep)).drop(name)
