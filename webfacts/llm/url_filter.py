"""URL filters: host and path rules, then a listed-URL check by blocked Bloom filter and exact join (operator 3).

The list may be as long as the web, so it is never held in one place. Its canonical URLs are folded into a blocked
Bloom filter: a URL's hash names one block of eight 32-bit words and one bit in each word; a block is one row. Pages meet
their one block by a join (the optimizer broadcasts the blocks only while they are below its size limit) and pages
whose eight bits are all set go on to the exact join with the list, which removes the false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.functions.html import html_text
from webfacts.session import cut

#: (verdict, host, path); a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
WORDS = 8
#: Keys for a block of 256 bits: about one false positive in a thousand.
KEYS_PER_BLOCK = 16
SEED_BLOCK, SEED_BITS = 3, 33
#: Numbers among which the pages stopped by the filter are spread.
SPREAD = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(F.col(url), r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(F.col(url), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: str = "host", path: str = "path") -> Column:
    """Host without a leading ``www.`` and path without trailing slashes; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.rtrim(F.col(path), F.lit("/")))


def fitting_rule(rules: tuple = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule over ``host`` and ``path``; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # later, longer ones win
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _spot(key: str, blocks: int) -> tuple[Column, Column]:
    """Block number of a key, and an array of the one bit it sets in each word."""
    block = F.pmod(F.xxhash64(F.lit(SEED_BLOCK), key), F.lit(blocks)).alias("block")
    h = F.xxhash64(F.lit(SEED_BITS), key)
    bits = F.array(*[F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 5 * i).bitwiseAND(31).cast("int")) for i in range(WORDS)])
    return block, bits


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter: ``(block, words)``; equal keys set equal bits, so partial sums fold a hot key before the shuffle."""
    block, bits = _spot(key, blocks)
    spots = keys.select(block, bits.alias("bits"))
    words = spots.groupBy("block").agg(*[F.bit_or(F.col("bits")[i]).alias(f"w{i}") for i in range(WORDS)])
    return words.select("block", F.array(*[f"w{i}" for i in range(WORDS)]).alias("words"))


def judge_urls(
    pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_key: str = "canonical",
    rules: tuple = RULES, keys_per_block: int = KEYS_PER_BLOCK,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, ``canonical``, ``maybe_listed``, ``listed``.

    A page that a rule fits gets the rule's verdict; any other is blocked if ``listed`` holds its canonical URL, else
    allowed. A null url, or one without ``://``, has empty host and path, no rule and is never listed. Repeated rows are
    judged alike; an empty list blocks nothing; null and repeated keys of the list do not matter; ids may be null.
    """
    name, verdict = fitting_rule(rules)
    parts = pages.select(F.col(page_id).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.select("*", canonical().alias("key"), name.alias("rule"), verdict.alias("by_rule"))
    keys = cut(listed.select(F.col(listed_key).alias("listed_key")).filter("listed_key IS NOT NULL AND listed_key <> ''").distinct())
    blocks = max(1, -(-keys.count() // keys_per_block))
    block, bits = _spot("key", blocks)
    open_pages = F.col("rule").isNull() & (F.col("key") != "")
    words = bloom_blocks(keys, "listed_key", blocks)
    met = parts.filter(open_pages).withColumn("block", block).withColumn("bits", bits).join(words, "block", "left")
    all_set = F.lit(True)
    for i in range(WORDS):
        all_set = all_set & (F.col("words")[i].bitwiseAND(F.col("bits")[i]) != 0)
    met = met.withColumn("maybe_listed", F.coalesce(all_set, F.lit(False))).drop("block", "bits", "words")
    # pages the filter stops take a negative number, which no listed key has, so they spread over the tasks of a shuffle
    spread = F.lit(SPREAD)
    at = F.when(F.col("maybe_listed"), F.pmod(F.xxhash64("key"), spread)).otherwise(-1 - F.pmod(F.xxhash64("key", "id"), spread))
    numbered = keys.withColumn("listed_at", F.pmod(F.xxhash64("listed_key"), spread))
    checked = met.withColumn("at", at).join(numbered, (F.col("key") == F.col("listed_key")) & (F.col("at") == F.col("listed_at")), "left")
    found = F.col("listed_key").isNotNull()
    # pages with a rule or without a key need no join
    settled = parts.filter(~open_pages).select("id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), "key", F.lit(False).alias("maybe"), F.lit(False).alias("found"))
    asked = checked.select("id", "host", "path", "rule", F.when(found, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"), "key", F.col("maybe_listed").alias("maybe"), found.alias("found"))
    return settled.unionAll(asked).toDF(page_id, "host", "path", "rule", "verdict", "canonical", "maybe_listed", "listed")


def listed_by_words(pages: DataFrame, words: tuple[str, ...], url: str = "url", html: str = "html") -> DataFrame:
    """A list made from the pages themselves: canonical URLs of pages whose visible text holds one of ``words`` as a whole word, whatever its case."""
    pattern = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(words) + r")(?![\p{L}\p{N}_])"
    hit = pages.filter(html_text(html).rlike(pattern)).select(host_of(url).alias("host"), path_of(url).alias("path"))
    return hit.select(canonical().alias("canonical"))
