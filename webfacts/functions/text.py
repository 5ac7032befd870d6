"""Text columns: tokens, term frequencies, query normal form, keyword dictionaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfacts.functions.base import ColumnOrName, col

# Short stop list used by the full-text tokens.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def tokens(text: ColumnOrName, stop: list[str] = STOP_WORDS) -> Column:
    """Lower-case word tokens without stop words; no stemming."""
    words = F.split(F.lower(col(text)), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(stop))


def query_terms(query: str, stop: list[str] = STOP_WORDS) -> list[str]:
    """Distinct query tokens in order (driver side, a query is a parameter)."""
    import re

    seen: dict[str, None] = {}
    for w in re.split(r"[^\w]+|_", query.lower()):
        if w and w not in stop:
            seen.setdefault(w)
    return list(seen)


def term_frequency(toks: ColumnOrName, term: str) -> Column:
    return F.size(F.filter(col(toks), lambda t: t == term)).cast("double")


def matches_all(toks: ColumnOrName, terms: list[str]) -> Column:
    """True when the query is not empty and every term occurs."""
    out = F.lit(bool(terms))
    for t in terms:
        out = out & F.array_contains(col(toks), t)
    return out


def text_rank(toks: ColumnOrName, terms: list[str]) -> Column:
    """Sum of term frequencies over 1 + ln(number of tokens)."""
    n = F.greatest(F.size(col(toks)), F.lit(1)).cast("double")
    total = F.lit(0.0)
    for t in terms:
        total = total + term_frequency(toks, t)
    return total / (F.lit(1.0) + F.log(n))


def normal_query(text: ColumnOrName) -> Column:
    """Lower case, punctuation to blanks, white space squeezed."""
    t = F.regexp_replace(F.lower(col(text)), r"[^A-Za-z0-9_\s぀-ゟ゠-ヿ一-龯]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def prefixed(text: ColumnOrName, role: str = "query") -> Column:
    """``query: text`` / ``passage: text``, not prefixed twice."""
    t = F.trim(col(text))
    return F.when(t.startswith(f"{role}: "), t).otherwise(F.concat(F.lit(f"{role}: "), t))


def keyword_hits(normal: ColumnOrName, words: list[str]) -> Column:
    """How many dictionary words occur as substrings."""
    n = F.lit(0)
    for w in words:
        n = n + F.when(col(normal).contains(w.lower()), 1).otherwise(0)
    return n


def keyword_list(normal: ColumnOrName, words: list[str]) -> Column:
    """The dictionary words that occur, in dictionary order."""
    distinct = list(dict.fromkeys(w.lower() for w in words))
    return F.filter(F.array(*[F.lit(w) for w in distinct]), lambda w: F.contains(col(normal), w))


def arg_max(scores: dict[str, Column]) -> tuple[Column, Column]:
    """(name, score) of the best score; the first name wins a tie."""
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    name = F.lit(None).cast("string")
    for key in reversed(list(scores)):
        name = F.when(scores[key] == best, F.lit(key)).otherwise(name)
    return name, best
