"""Personal data by pattern, checksum and context (operator 9); DataFrame functions only.

Regular expressions propose spans; a check confirms them: ranges for addresses, Luhn for cards, mod-97 for bank accounts,
digit counts for phones. Kinds that look like ordinary text (``iban``, ``ssn``, ``passport``) start from a score that words
nearby raise, and count only from ``MIN_SCORE`` on. Spans are code points, end exclusive.

Texts are split by a pattern and matched by it: gaps and matches alternate, so running sums of their lengths are the
positions. The sums are taken in blocks, first of whole blocks, then inside each. The patterns are possessive where nothing can be given back, and may start only where a run of their first
characters starts or the last match ended (``\\G``): no text, however long, is scanned twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.functions.base import let
from webfacts.llm.common import text_or_empty

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "passport")
NEAR = 40
MIN_SCORE = 0.6
#: Matches folded at a time.
BLOCK = 256
#: Code points of a piece of text; a span with ``NEAR`` on both sides must fit into two.
PIECE = 256

#: kind: pattern, text that a match cannot do without (a faster test), start score
PATTERNS: dict[str, tuple[str, str, float]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 1.0),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 1.0),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", 1.0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 1.0),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.8),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.4),
    "passport": (r"(?<![A-Za-z0-9])[A-Z][0-9]{8}(?![A-Za-z0-9])", "", 0.3),
}
#: kind: words that raise and words that lower the score of a span they stand near
CONTEXT: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "iban": (("iban", "account", "bank", "konto", "cuenta", "compte"), ("example", "order")),
    "ssn": (("ssn", "social security", "tax"), ("isbn", "order", "part")),
    "passport": (("passport", "travel document", "reisepass", "pasaporte", "passeport"), ("order", "model", "part")),
}
RAISE, LOWER = 0.3, 0.3


VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check over a string of digits."""
    n = F.length(digits)
    places = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring(digits, i, F.lit(1)).cast("int").alias("d"), ((n - i) % 2 == 1).alias("twice")))
    total = F.aggregate(places, F.lit(0), lambda t, p: t + F.when(~p["twice"], p["d"]).when(p["d"] < 5, p["d"] * 2).otherwise(p["d"] * 2 - 9))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Bank account check: the first four characters go to the end, letters become 10 to 35, the rest by 97 is 1."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    values = F.transform(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), lambda c: F.position(c, F.lit(VALUES)) - 1)
    return F.aggregate(values, F.lit(0), lambda t, v: (t * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return ~F.exists(F.split(match, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) > 3) & ~F.exists(
            F.split(match, r"\."), lambda p: F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) > 255
        )
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(match, " ", "")).between(15, 34) & mod97(match)
    return F.lit(True)


def _any_word(near: Column, words: tuple[str, ...]) -> Column:
    return near.rlike("(?i)(?<![a-z])(" + "|".join(words) + ")(?![a-z])")


def spans_of(kind: str, text: Column) -> Column:
    """Array of ``struct(start, end, match)`` of confirmed spans of one kind; the method's own kinds need ``MIN_SCORE`` besides.

    The work grows with the text and its matches: they are folded in blocks, and context is read from short pieces.
    """
    pattern, must, score = PATTERNS[kind]
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def width(pair: Column) -> Column:
        return F.length(pair["gaps"]) + F.coalesce(F.length(pair["matches"]), F.lit(0))

    def step(state: Column, pair: Column) -> Column:
        begin, end = state["at"] + F.length(pair["gaps"]), state["at"] + width(pair)
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), pair["matches"].alias("match")))
        confirmed = pair["matches"].isNotNull() & _confirmed(kind, pair["matches"])
        return F.struct(end.alias("at"), F.when(confirmed, F.concat(state["found"], span)).otherwise(state["found"]).alias("found"))

    def blocks(all_pairs: Column) -> Column:
        last = F.floor((F.size(all_pairs) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(all_pairs, b * BLOCK + 1, F.lit(BLOCK)))

    def folded(cut: Column) -> Column:
        widths = F.transform(cut, lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + width(p)))
        offsets = F.aggregate(F.slice(widths, F.lit(1), F.size(widths) - 1), F.array(F.lit(0)), lambda o, w: F.concat(o, F.array(F.element_at(o, -1) + w)))
        found = F.zip_with(cut, offsets, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), step, lambda s: s["found"]))
        return F.flatten(found)

    kept = let(let(pairs, blocks), folded)
    if kind in CONTEXT:
        good, bad = CONTEXT[kind]

        def supported(pieces: Column) -> Column:
            def enough(s: Column) -> Column:
                first = F.greatest(s["start"] - NEAR, F.lit(0))
                piece = F.floor(first / PIECE).cast("int")
                two = F.concat(F.get(pieces, piece), F.coalesce(F.get(pieces, piece + 1), F.lit("")))
                near = F.substring(two, first % PIECE + 1, s["end"] + NEAR - first)
                total = F.lit(score) + F.when(_any_word(near, good), F.lit(RAISE)).otherwise(F.lit(0.0)) - F.when(_any_word(near, bad), F.lit(LOWER)).otherwise(F.lit(0.0))
                return total >= MIN_SCORE

            return F.filter(kept, enough)

        kept = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), supported)
    possible = F.contains(text, F.lit(must)) if must else F.lit(True)
    return F.when(possible & text.rlike(pattern), kept).otherwise(none)


def _written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id and, per kind, an array of ``struct(start, end, match)``.

    A null text counts as empty; repeated rows give repeated results; an empty table gives no rows; only the two named
    columns are read.
    """
    return docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("body")).select(
        F.col("id").alias(doc_id), *[spans_of(kind, F.col("body")).alias(f"_{kind}") for kind in (*BASE, *MORE)]
    )


def pii_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans of every document."""
    found = find_pii(docs, doc_id, text)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE]
    base = F.array_join(F.concat(*[_written(k, F.col(f"_{k}")) for k in BASE]), ",")
    every = F.array_join(F.concat(*[_written(k, F.col(f"_{k}")) for k in (*BASE, *MORE)]), ",")
    return found.select(doc_id, *counts, F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
