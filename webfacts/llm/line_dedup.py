"""Line deduplication by an exact set-similarity join (operator 10); DataFrame functions only.

Lines are sets of words; two lines match at Jaccard similarity 0.8 or more, and a line that matches an earlier one
(documents by id, lines by position) goes, whether or not that earlier line stays itself.

Words become numbers that sort from rare to frequent: corpus counts over a fixed number of hash buckets give each bucket
a frequency class, which goes in front of the hash. Lines with equal sets of words are folded to their first place.

One match is enough to lose a line. So before any pair is made, lines are grouped by a few small samples of their words, and
each is held against the first line of its groups and a few lines before it: a group of many alike lines costs a few
comparisons a line and settles nearly all of them. The rest goes through the prefix join. Of n words, only the rarest n - ceil(0.8 n) + 1 are
posted: two lines with no common posted word cannot match. Postings meet by word, a line that is not settled
as the later one with any line as the earlier one; before a pair is made, lengths and positions bound the overlap it can
have, and 128 parities of the words bound the words it cannot share. Postings carry the places of their lines, so no pair is
made whose later line is settled. Pairs are verified on the words themselves.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from webfacts.llm.common import fresh, stored, text_or_empty

#: Jaccard threshold as a fraction.
SHARE = (4, 5)
CLASS_BITS = 16
#: Candidate lines up to this number are broadcast to fetch their words, and lines that go to take them out; beyond it they are joined by shuffle.
BROADCAST_LINES = 500_000
#: Parts that a group of lines with a common sample is dealt to.
PARTS = 16
#: Lines before it in its part that a line is held against, besides the first.
BEFORE = 3

_BLANKS = "\t\x0b\x0c\r"
#: Bit of ``spot`` that marks lines of documents without id; they come last.
_NO_ID = 62


def _spaced(text: Column) -> Column:
    other = F.lit(False)
    for blank in _BLANKS:
        other = other | F.contains(text, F.lit(blank))
    return F.when(other, F.translate(text, _BLANKS, " " * len(_BLANKS))).otherwise(text)


def _has_word(line: Column) -> Column:
    """Whether a line (without line feeds) holds a word."""
    return F.btrim(line, F.lit(" " + _BLANKS)) != ""


def _words(line: Column) -> Column:
    return F.array_remove(F.split(_spaced(line), " "), "")


def _document(doc_id: str, text: str) -> list[Column]:
    """Documents are told apart by id, and by text where there is no id."""
    return [F.col(doc_id).alias("id"), F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text))).otherwise(F.lit(0).cast("long")).alias("tie")]


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, none, text``: ``doc`` is the id, or the hash of the text where there is ``none``."""
    kind = docs.schema[doc_id].dataType
    kind = "long" if isinstance(kind, IntegralType) else kind.simpleString()
    doc = F.coalesce(F.col(doc_id).cast(kind), F.xxhash64(F.col(text)).cast(kind)).alias("doc")
    return docs.select(doc, F.col(doc_id).isNull().alias("none"), text_or_empty(text).alias("text"))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines that hold a word: their place ``doc, spot`` and ``body``; ``spot`` is the position, with a high bit where there is no id."""
    split = _texts(docs, doc_id, text).select("doc", "none", F.posexplode(F.split("text", "\n")).alias("pos", "body"))
    spot = F.col("pos").cast("long") + F.when(F.col("none"), F.lit(1 << _NO_ID)).otherwise(F.lit(0))
    return split.filter(_has_word(F.col("body"))).select("doc", spot.alias("spot"), "body")


def _order(side: str = "") -> Column:
    """Sorts places: documents by id, those without id last, lines by position."""
    doc, spot = F.col(f"{side}doc"), F.col(f"{side}spot")
    return F.struct((spot >= F.lit(1 << _NO_ID)).alias("none"), doc.alias("doc"), spot.alias("spot"))


def _before(a: str, b: str) -> Column:
    """``_order(a) < _order(b)`` without structs."""
    (doc_a, spot_a), (doc_b, spot_b) = ((F.col(f"{s}doc"), F.col(f"{s}spot")) for s in (a, b))
    none_a, none_b = spot_a >= F.lit(1 << _NO_ID), spot_b >= F.lit(1 << _NO_ID)
    return ((none_a == none_b) & ((doc_a < doc_b) | ((doc_a == doc_b) & (spot_a < spot_b)))) | (~none_a & none_b)


def word_classes(docs: DataFrame, text: str = "text", bits: int = CLASS_BITS) -> list[int]:
    """Frequency class (four to an octave) of each of 2 ** ``bits`` hash buckets, by all words of the corpus."""
    flat = _spaced(F.replace(text_or_empty(text), F.lit("\n"), F.lit(" ")))
    words = docs.select(F.explode(F.split(flat, " ")).alias("w")).filter("w <> ''")
    bucket = F.xxhash64("w").bitwiseAND(F.lit(2**bits - 1))
    found = words.groupBy(bucket.alias("b")).agg(F.floor(F.log2(F.count(F.lit(1)) + 1) * 4).cast("int").alias("c"))
    seen = {b: c for b, c in found.collect()}  # at most 2 ** bits rows
    return [seen.get(b, 0) for b in range(2**bits)]


def _by_rarity(hashes: Column, classes: list[int], bits: int = CLASS_BITS) -> Column:
    """The words as sorted numbers, rarest first: the class in eight bits below the sign, then 55 bits of the hash."""
    table = F.split(F.lit(" ".join(map(str, classes))), " ").cast("array<bigint>")  # small numbers: a plan prints all of them
    rank = lambda h: F.shiftleft(F.get(table, h.bitwiseAND(F.lit(2**bits - 1)).cast("int")), 55)
    return F.sort_array(F.transform(hashes, lambda h: rank(h).bitwiseOR(h.bitwiseAND(F.lit(2**55 - 1)))))


def _parities(hashes: Column) -> Column:
    """64 parities: bit b tells whether an odd number of words falls on b. Where two lines differ in a bit they differ in a word."""
    one = F.lit(1).cast("long")
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int"))))


def distinct_lines(lines: DataFrame, classes: list[int]) -> DataFrame:
    """One row per set of words, at its first place: ``set, doc, spot, n, bits0, bits1, rare`` and the samples ``s0`` and ``s1``.

    Samples are hashes of the two smallest and the two greatest words, by the hash of the words; ``rare`` are the posted words.
    """
    up, down = SHARE
    words = F.transform(F.split(_spaced(F.col("body")), " "), lambda w: F.xxhash64(w))  # gaps between blanks leave as one number
    hashed = lines.select("doc", "spot", F.sort_array(F.array_remove(F.array_distinct(words), F.xxhash64(F.lit("")))).alias("h"))
    split = hashed.select("*", F.size("h").alias("n"), F.filter("h", lambda x: x >= 0).alias("upper")).withColumn("k", F.col("n") - F.size("upper"))
    # the words with hashes below zero and the others have 64 parities each
    halves = split.select("*", F.slice("h", F.lit(1), F.col("k")).alias("lower"))
    need = F.floor((F.col("n") * up + down - 1) / F.lit(down)).cast("int")
    ends = [F.slice("h", 1, 2), F.slice("h", F.greatest(F.lit(1), F.col("n") - 1), F.lit(2))]
    held = halves.select(
        "doc", "spot", "n", F.xxhash64("h").alias("set"), F.xxhash64(F.lit(1), "h").alias("again"), _parities(F.col("lower")).alias("bits0"), _parities(F.col("upper")).alias("bits1"),
        *[F.xxhash64(F.lit(i), e).alias(f"s{i}") for i, e in enumerate(ends)], F.slice(_by_rarity(F.col("h"), classes), F.lit(1), F.col("n") - need + 1).alias("rare"),
    )
    # equal sets have equal facts, so any of them will do
    facts = ("n", "bits0", "bits1", *_SAMPLES, "rare")
    once = held.groupBy("set", "again").agg(F.min(_order()).alias("at"), *[F.first(c).alias(c) for c in facts])
    return once.select("set", "at.doc", "at.spot", *facts)


_SAMPLES = ("s0", "s1")
_PAIR = ("a_doc", "a_spot", "b_doc", "b_spot")


def _apart(a: str, b: str) -> Column:
    """At least so many words belong to one of two lines only."""
    return sum(F.bit_count(F.col(f"{a}bits{h}").bitwiseXOR(F.col(f"{b}bits{h}"))) for h in (0, 1))


def _close(a: str, b: str) -> Column:
    """Whether two lines can reach the threshold by their lengths and parities."""
    up, down = SHARE
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    # at Jaccard u / d at most (d - u) / (d + u) of all words belong to one line only
    return (na * down >= nb * up) & (nb * down >= na * up) & (_apart(a, b) * (up + down) <= (na + nb) * (down - up))


def _named(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select(*more, *[F.col(c).alias(side + c) for c in rows.columns if c not in more])


def _heads(lines: DataFrame) -> DataFrame:
    """Pairs of each line with the closest of the first line and the ``BEFORE`` lines before it that share a sample with it, however large a group is.

    A group is dealt to ``PARTS`` parts by the hash of the lines, so that one that holds a large share of all lines is no single
    task. A line meets lines of its part, and the first lines of parts that hold more than one line meet each other in the same
    way. Small groups with one line a part are left to the prefix join. The facts of a line travel with it, so the groups
    are sorted once and no pair needs a join.
    """
    facts = ("doc", "spot", "n", "bits0", "bits1")
    at = [F.col("spot") >= F.lit(1 << _NO_ID), F.col("doc"), F.col("spot")]

    def met(rows: DataFrame, *keys: str) -> DataFrame:
        """``sample``, facts, ``head`` (first of a group of several) and ``a``, the place of the closest of these lines, if any may be alike."""
        behind = Window.partitionBy(*keys).orderBy(*at)
        line = F.struct(*facts)
        near = {"r0": F.first(line).over(behind.rowsBetween(Window.unboundedPreceding, Window.currentRow))}
        near |= {f"r{k}": F.lag(line, k).over(behind) for k in range(1, BEFORE + 1)}
        known = rows.withColumns(near | {"head": (F.row_number().over(behind) == 1) & F.lead(F.lit(True), 1, False).over(behind)})
        alike = {r: F.coalesce((_order(f"{r}.") < _order()) & _close(f"{r}.", ""), F.lit(False)) for r in near}
        found = known.filter(functools.reduce(Column.__or__, alike.values(), F.col("head")))
        share = lambda r: (_apart(f"{r}.", "") / (F.col(f"{r}.n") + F.col("n"))).alias("apart")
        closest = F.array_min(F.array(*[F.when(ok, F.struct(share(r), f"{r}.doc", f"{r}.spot")) for r, ok in alike.items()]))
        return found.select("sample", *facts, "head", closest.alias("a"))

    keys = [F.pmod("set", F.lit(PARTS)).alias("part"), F.explode(F.array_distinct(F.array(*_SAMPLES))).alias("sample")]
    # most lines are alone in their part of a group and meet nobody there: they are counted away before anything is sorted
    shared = lines.select(*keys).groupBy("sample", "part").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    parted = stored(met(lines.select(*facts, *keys).join(shared, ["sample", "part"], "left_semi"), "sample", "part"))
    tops = met(parted.filter("head").select("sample", *facts), "sample")
    both = parted.select("a", "doc", "spot").union(tops.select("a", "doc", "spot")).filter("a IS NOT NULL")
    return both.select(F.col("a.doc").alias("a_doc"), F.col("a.spot").alias("a_spot"), F.col("doc").alias("b_doc"), F.col("spot").alias("b_spot")).distinct()


def _postings(lines: DataFrame) -> DataFrame:
    """``word, doc, spot, bits0, bits1, size`` of every line: its rarest words, as 40 bits of their hash.

    ``size`` holds the number of words, whether the line is settled, and the position of the word, which keeps a posting at six numbers.
    """
    posted = lines.select("doc", "spot", "n", "bits0", "bits1", "settled", F.posexplode("rare").alias("i", "number"))
    size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("settled").cast("long"), 31)).bitwiseOR(F.col("i").cast("long"))
    return posted.select(F.col("number").bitwiseAND(F.lit(2**40 - 1)).alias("word"), "doc", "spot", "bits0", "bits1", size.alias("size"))


def _candidates(postings: DataFrame) -> DataFrame:
    """Pairs of places, the earlier first, that can reach the threshold and whose later line is not settled."""
    up, down = SHARE
    n, i = (lambda s: F.shiftright(F.col(s + "size"), 32)), (lambda s: F.col(s + "size").bitwiseAND(F.lit(2**31 - 1)))
    both = _named(postings, "a_", "word").join(_named(postings, "b_", "word"), "word").withColumns({s + "n": n(s) for s in ("a_", "b_")})
    most = F.least(i("a_"), i("b_")) + 1 + F.least(n("a_") - i("a_") - 1, n("b_") - i("b_") - 1)
    overlap = most * (up + down) >= (n("a_") + n("b_")) * up
    # one sum over both sides: a filter of its own on the later side would give that side a shuffle of its own
    settled = F.shiftright(F.col("b_size"), 31).bitwiseAND(F.lit(1))
    open_ = settled + F.when(_before("a_", "b_"), 0).otherwise(1) == 0
    return both.filter(overlap & _close("a_", "b_") & open_).select(*_PAIR).distinct()


def _bodies(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, broadcast_lines: int) -> DataFrame:
    """``doc, spot, body`` of the lines in ``pairs``, read from the texts."""
    known = stored(pairs.select(F.col("a_doc").alias("doc"), F.col("a_spot").alias("spot")).union(pairs.select("b_doc", "b_spot")).distinct())
    if known.count() > broadcast_lines:
        return stored(_lines(docs, doc_id, text).join(known, ["doc", "spot"], "left_semi"))
    spots = known.groupBy("doc").agg(F.collect_list("spot").alias("spots"))  # bounded by the lines of a document
    split = _texts(docs, doc_id, text).join(F.broadcast(spots), "doc").select("doc", "none", "spots", F.split("text", "\n").alias("parts"))
    at = lambda s: F.struct(s.alias("spot"), F.get("parts", s.bitwiseAND(F.lit(2**31 - 1)).cast("int")).alias("body"))
    lines = split.select("doc", "none", F.explode(F.transform("spots", at)).alias("l")).select("doc", "none", "l.*")
    return stored(lines.filter(((F.col("spot") >= F.lit(1 << _NO_ID)) == F.col("none")) & _has_word(F.col("body"))).select("doc", "spot", "body"))


def _verified(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The later places ``doc, spot`` of ``pairs`` that reach the threshold, by the words themselves."""
    up, down = SHARE
    # a repeated row has a body twice; the fold shares the exchange of the joins, and words are split once a line, not once a pair
    lists = bodies.groupBy("doc", "spot").agg(F.first("body").alias("body")).select("doc", "spot", F.array_distinct(_words(F.col("body"))).alias("words"))
    both = pairs.join(_named(lists, "a_"), ["a_doc", "a_spot"]).join(_named(lists, "b_"), ["b_doc", "b_spot"])
    alike = F.size(F.array_intersect("a_words", "b_words")) * (down + up) >= (F.size("a_words") + F.size("b_words")) * up
    return both.filter(alike).select(F.col("b_doc").alias("doc"), F.col("b_spot").alias("spot")).distinct()


def _few(places: DataFrame, most: int) -> DataFrame:
    """Stored places, broadcast where there are few of them: the lines they are taken from are not shuffled then."""
    return F.broadcast(places) if places.count() <= most else places


def remaining_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Places ``doc, spot`` of the lines that stay: first of their set of words, and not alike to an earlier line."""
    bodies = lambda pairs: _bodies(pairs, docs, doc_id, text, broadcast_lines)
    distinct = stored(distinct_lines(_lines(docs, doc_id, text), word_classes(docs, text)))
    heads = stored(_heads(distinct))
    settled = stored(_verified(heads, bodies(heads)).withColumn("settled", F.lit(True)))
    flagged = distinct.join(_few(settled, broadcast_lines), ["doc", "spot"], "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    pairs = stored(_candidates(_postings(flagged)))
    gone = stored(settled.select("doc", "spot").union(_verified(pairs, bodies(pairs))))
    return distinct.select("doc", "spot").join(_few(gone, broadcast_lines), ["doc", "spot"], "left_anti")


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """``id, tie, kept``: for every document that keeps a line with words, the positions of those lines, rising."""
    stay = remaining_places(docs, doc_id, text, broadcast_lines)
    none, pos = F.col("spot") >= F.lit(1 << _NO_ID), F.col("spot").bitwiseAND(F.lit(2**31 - 1)).cast("int")
    named = stay.select(F.when(~none, F.col("doc").cast(docs.schema[doc_id].dataType)).alias("id"), F.when(none, F.col("doc").cast("long")).otherwise(F.lit(0).cast("long")).alias("tie"), pos.alias("pos"))
    return named.groupBy("id", "tie").agg(F.sort_array(F.collect_list("pos")).alias("kept"))


def _joined(docs: DataFrame, doc_id: str, text: str, kept: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` with the kept positions of their document in column ``name``."""
    keyed = docs.withColumn(key, F.struct(*_document(doc_id, text)))
    found = kept.select(F.struct("id", "tie").alias(key), F.col("kept").alias(name))
    return keyed.join(found, key, "left").withColumn(name, F.coalesce(name, F.array().cast("array<int>"))).drop(key)


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_lines`` with words, ``n_removed``, ``kept`` positions (from 0).

    A null or empty text has no lines. Lines without a word are neither counted nor removed. Rows that share an id are
    one document, and equal lines at equal positions of it one line; rows without id are told apart by text. An
    empty table gives no rows; further columns are not read.
    """
    has_word = F.filter(F.split(text_or_empty(text), "\n"), _has_word)
    slim = docs.select(*_document(doc_id, text), F.size(has_word).cast("long").alias("n_lines"))
    kept = kept_lines(docs, doc_id, text).select(F.struct("id", "tie").alias("key"), "kept")
    both = slim.withColumn("key", F.struct("id", "tie")).join(kept, "key", "left")
    kept_or_none = F.coalesce("kept", F.array().cast("array<int>"))
    return both.select(F.col("id").alias(doc_id), "n_lines", (F.col("n_lines") - F.size(kept_or_none)).alias("n_removed"), kept_or_none.alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of ``text``; every row and every other column stays.

    Only ``text`` changes; a null text stays null and a text that loses all its lines becomes empty.
    """
    key, kept, flags = fresh(docs, "_line_key"), fresh(docs, "_line_kept"), fresh(docs, "_line_flags")
    both = _joined(docs, doc_id, text, kept_lines(docs, doc_id, text), key, kept)
    # One character for each position up to the last kept one: looked up by index, so long documents stay linear.
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col(kept), i - 1))
    steps = F.transform(F.col(kept), lambda p, i: F.concat(F.repeat(F.lit("0"), p - before(i) - 1), F.lit("1")))
    marked = both.withColumn(flags, F.split(F.array_join(steps, ""), ""))
    stays = F.filter(
        F.split(F.col(text), "\n"), lambda body, i: ~_has_word(body) | F.coalesce(F.get(F.col(flags), i) == "1", F.lit(False))
    )
    return marked.withColumn(text, F.array_join(stays, "\n")).select(docs.columns)
