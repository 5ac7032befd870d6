"""Joins of facts, embeddings, pages, palettes and keyword dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfacts.functions import text
from webfacts.functions.color import channel
from webfacts.session import cut


def without_embedding(facts: DataFrame, embeddings: DataFrame, fact_id: str, emb_id: str) -> DataFrame:
    """Facts that still need an embedding."""
    return facts.join(embeddings.select(F.col(emb_id).alias(fact_id)), fact_id, "left_anti")


def with_embedding(facts: DataFrame, embeddings: DataFrame, fact_id: str, emb_id: str) -> DataFrame:
    return facts.join(embeddings.select(F.col(emb_id).alias(fact_id)), fact_id, "left_semi")


def nearest_color(colors: DataFrame, palette: DataFrame, by: list[str], hex_col: str = "hex", palette_hex: str = "palette_hex", reach: int = 30) -> DataFrame:
    """Nearest palette colour of each colour with RGB distance below ``reach``, matched inside ``by``.

    Both sides are reduced to distinct colours, then meet on cells, first of a small edge and then of larger ones up to
    ``reach``: a palette colour is entered in its own and the 26 neighbouring cells, so a pair closer than the edge always
    meets. Only colours with no palette colour closer than one edge go on to the next, so a colour meets few others
    however dense the palette is. A cell holds at most ``edge**3`` distinct colours per side, whatever the size of the tables.
    """
    edges = [reach]
    while edges[0] >= 9:
        edges.insert(0, edges[0] // 3)
    width = 4 * colors.sparkSession.sparkContext.defaultParallelism  # narrow rows, much work: not merged into a few tasks
    cell, step = ["_c0", "_c1", "_c2"], F.array(*[F.lit(i) for i in (-1, 0, 1)])

    def channels(df: DataFrame, h: str, side: str) -> DataFrame:
        rgb = df.select(*by, h).distinct().select("*", *[channel(h, i).alias(f"{side}{i}") for i in range(3)])
        return rgb.filter(F.col(f"{side}0").isNotNull())

    def dealt(df: DataFrame, side: str, edge: int, spread: bool) -> DataFrame:
        rows = df.select("*", *[F.floor(F.col(f"{side}{i}") / edge).cast("int").alias(c) for i, c in enumerate(cell)])
        for c in cell if spread else []:
            rows = rows.withColumn("_d", F.explode(step)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
        return rows.repartition(width, *by, *cell)

    theirs, left, found = channels(palette, palette_hex, "_p"), channels(colors, hex_col, "_h"), []
    for edge in edges:
        ours, near = dealt(left, "_h", edge, False).alias("o"), dealt(theirs, "_p", edge, True).alias("n")
        square = sum(((F.col(f"_h{i}") - F.col(f"_p{i}")) * (F.col(f"_h{i}") - F.col(f"_p{i}")) for i in range(3)), F.lit(0))
        same = square < edge * edge
        for c in [*by, *cell]:
            same = same & (F.col(f"o.{c}") == F.col(f"n.{c}"))
        mine = [F.col(f"o.{c}") for c in (*by, *cell, hex_col, "_h0", "_h1", "_h2")]
        pair = F.when(F.col("_p0").isNotNull(), F.struct(square.alias("square"), F.col(palette_hex)))
        best = ours.join(near, same, "left").groupBy(*mine).agg(F.min(pair).alias("_b"))
        best = best if edge == reach else cut(best)
        found.append(best.filter("_b IS NOT NULL"))
        left = best.filter("_b IS NULL").drop("_b", *cell)
    every = reduce(DataFrame.union, found)
    return every.select(*by, hex_col, F.col("_b")[palette_hex].alias(palette_hex), F.sqrt(F.col("_b.square").cast("double")).alias("distance"))


def keyword_categories(df: DataFrame, text_col: str, dictionary: dict[str, list[str]]) -> DataFrame:
    """One row per (row, category) whose words occur as substrings, with the number of words found.

    The dictionary is a literal parameter, so the test is an expression per row and needs no join.
    """
    hits = F.array(
        *[F.struct(F.lit(name).alias("category"), text.keyword_hits(text_col, words).alias("hits")) for name, words in dictionary.items()]
    )
    out = df.withColumn("_h", F.explode(F.filter(hits, lambda h: h["hits"] > 0)))
    return out.select("*", "_h.category", "_h.hits").drop("_h")


def viewport_pairs(elements: DataFrame, keys: list[str], width: str = "viewport_width") -> DataFrame:
    """The same element seen at a larger (``big``) and a smaller (``small``) viewport."""
    rest = [c for c in elements.columns if c not in keys]
    big = elements.select(*keys, F.struct(*rest).alias("big"))
    small = elements.select(*keys, F.struct(*rest).alias("small"))
    return big.join(small, keys).filter(F.col(f"big.{width}") > F.col(f"small.{width}"))


def nested_tokens(palettes: DataFrame, tokens: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Palettes with their tokens as an array in sort order."""
    grouped = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("tokens"))
    return palettes.join(grouped, key, "left")
