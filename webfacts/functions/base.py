"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(text: Column) -> Column:
    """Text to double, null when it is not a number."""
    return text.try_cast("double")


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    """Literal table lookup, null (or ``default``) for unknown keys."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, default)


def first_match(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    """Ordered ``when`` chain: the first true condition wins."""
    out = None
    for cond, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return out.otherwise(other)


def band(value: Column, steps: list[tuple[float, object]], otherwise: object) -> Column:
    """Descending bands: the first ``(minimum, result)`` with ``value >= minimum``."""
    return first_match(*[(value >= F.lit(m), r) for m, r in steps], otherwise=otherwise)


def any_of(text: Column, words: list[str]) -> Column:
    """Case-sensitive substring test against a literal word list."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def flag(cond: Column) -> Column:
    """1 for true, 0 for false or null."""
    return F.when(cond, 1).otherwise(0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity."""
    scale = 10**digits
    r = F.floor(x * F.lit(float(scale)) + F.lit(0.5))
    return r if digits == 0 else r.cast("double") / F.lit(float(scale))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``; keeps expression trees small."""
    return F.transform(F.array(value), body)[0]


def required_literal(pattern: str) -> str:
    """A text every match of ``pattern`` must contain, lower case; empty when none is plain to see.

    The longest run of plain characters outside groups and classes; a pattern with alternatives at the top has none.
    """
    best = run = ""
    depth, in_class, i = 0, False, 0
    while i < len(pattern):
        c, plain = pattern[i], None
        if c == "\\":
            i += 1
            plain = pattern[i] if not pattern[i].isalnum() else None
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return ""
        elif c not in "^$.|?*+{}":
            plain = c
        follows = pattern[i + 1 : i + 2]
        if plain is None or depth or in_class or follows in ("?", "*", "{"):
            run = ""
        else:
            run += plain
            best = max(best, run, key=len)
            run = "" if follows == "+" else run
        if c == "{":  # a number of repeats
            i = pattern.index("}", i)
        i += 1
    return best.lower()


def mark(low: Column, pattern: str) -> Column:
    """Case-insensitive ``rlike`` on lower-case text, behind a plain substring test.

    Most marks are absent from most pages; the substring test is far cheaper than the expression.
    """
    need = required_literal(pattern)
    test = low.rlike(f"(?i){pattern}")
    return low.contains(need) & test if len(need) >= 3 else test
