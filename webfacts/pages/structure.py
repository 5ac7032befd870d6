"""Sections of pages: landmark elements and marked containers, their content, type and name.

A section is a landmark element, or a container whose role, class, id or data attributes mark it as one. A section's
snippet is its own markup: what lies in a section inside it belongs to that one, and a section that holds nothing but
other sections is none. Everything stays inside the page row until the final explode, so no shuffle is needed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.functions.base import ColumnOrName
from webfacts.functions.html import attribute, cap_snippet, drop_unseen, extract_all, headings, squeeze, strip_tags
from webfacts.pages.nesting import nested_sections
from webfacts.rules.section_rules import SECTION_RULES
from webfacts.session import spread


def _nested(html: pd.Series) -> pd.Series:
    return html.map(lambda page: [{"tag": t, "open": o, "snippet": s} for t, o, s in nested_sections(page)] if page is not None else None)


def section_array(html: ColumnOrName) -> Column:
    """``array<struct<tag, open, snippet>>`` in page order; comments, scripts and styles are dropped first."""
    return F.pandas_udf(_nested, "array<struct<tag:string,open:string,snippet:string>>")(drop_unseen(html))


def sections(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per section: page, position (0-based), tag, id, classes, role, style attribute, snippet."""
    pages = spread(pages.select(page_id, html), page_id)
    rows = pages.select(page_id, F.posexplode(section_array(html)).alias("position", "s"))
    opening = F.col("s.open")
    return rows.select(
        page_id,
        "position",
        F.col("s.tag").alias("tag"),
        attribute(opening, "id").alias("id"),
        F.filter(F.split(attribute(opening, "class"), r"\s+"), lambda c: c != "").alias("classes"),
        attribute(opening, "role").alias("role"),
        attribute(opening, "style").alias("style"),
        F.col("s.snippet").alias("snippet"),
    )


def with_content(secs: DataFrame, snippet: str = "snippet") -> DataFrame:
    """Arrays of headings, paragraphs, links, images, buttons and the facts the rules ask for."""
    texts = lambda tag: F.transform(extract_all(snippet, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), lambda t: squeeze(strip_tags(t)))
    full = secs.withColumns(
        {
            "headings": headings(snippet),
            "paragraphs": F.filter(texts("p"), lambda t: t != ""),
            "links": extract_all(snippet, r'(?is)<a\b[^>]*\shref="([^"]*)"'),
            "images": extract_all(snippet, r"(?is)<img\b[^>]*>", 0),
            "buttons": texts("button"),
        }
    )
    def any_paragraph(words: list[str]) -> Column:
        def test(p: Column) -> Column:
            out = F.lit(False)
            for w in words:
                out = out | F.lower(p).contains(w)
            return out

        return F.exists("paragraphs", test)

    return full.withColumns(
        {
            **{f"n_{c}": F.size(c) for c in ("headings", "paragraphs", "links", "images", "buttons")},
            "has_h1": F.exists("headings", lambda h: h["level"] == 1),
            "has_copyright": any_paragraph(["©", "copyright", "all rights reserved"]),
            "has_email": any_paragraph(["@", "email"]),
        }
    )


def with_style_facts(secs: DataFrame, style: str = "style") -> DataFrame:
    """Background and text colour, gradient and image flags of the style attribute."""
    s = F.col(style)
    value = lambda p: F.nullif(F.trim(F.regexp_extract(s, p, 1)), F.lit(""))
    return secs.withColumns(
        {
            "background_color": value(r"(?i)background-color:\s*([^;]+)"),
            "text_color": value(r"(?i)(?:^|;)\s*color:\s*([^;]+)"),
            "has_gradient": s.rlike("(?i)gradient"),
            "has_image": s.rlike(r"(?i)background-image:\s*url|background:\s*[^;]*url"),
        }
    )


FACTS = {"h1": "has_h1", "copyright": "has_copyright", "email": "has_email", "gradient": "has_gradient", "image": "has_image"}


def _fact(name: str) -> Column:
    """``h1`` and the like are flags, ``links`` means at least one, ``images4`` at least four."""
    if name in FACTS:
        return F.col(FACTS[name])
    if name == "button":
        return F.col("n_buttons") > 0
    if name[-1].isdigit():
        return F.col(f"n_{name[:-1]}") >= int(name[-1])
    return F.col(f"n_{name}") > 0


def _condition(field: str, test) -> Column:
    if field == "tag":
        return F.col("tag") == test
    if field == "classes":
        return F.array_join("classes", " ").rlike(rf"(?i)\b(?:{test})\b")
    if field == "id":
        return F.col("id").rlike(rf"(?i)\b(?:{test})\b")
    if field == "start_y":
        return F.col("start_y").between(*test)
    out = F.lit(field == "has_all")
    for name in test:
        out = (out & _fact(name)) if field == "has_all" else (out | _fact(name))
    return out


def classify(secs: DataFrame, rules: list = SECTION_RULES, keep: str = "type", score: str = "confidence") -> DataFrame:
    """Best rule per section: highest priority, then confidence (matched weight over total weight).

    The rules are a literal parameter and become one expression per section: no join, no explode, no shuffle.
    """
    options = []
    for n, (kind, priority, minimum, conditions) in enumerate(rules):
        total = sum(w for *_, w in conditions)
        got = sum((F.when(_condition(f, t), float(w)).otherwise(0.0) for f, t, w in conditions), F.lit(0.0)) / total
        # 1e-9: the weights are decimal fractions, their binary sums may fall a hair short of the minimum
        options.append(
            F.struct(
                F.lit(priority).alias("priority"), F.least(got, F.lit(1.0)).alias("confidence"), F.lit(-n).alias("n"),
                F.lit(kind).alias("type"), F.lit(minimum - 1e-9).alias("minimum"),
            )
        )
    ok = F.filter(F.array(*options), lambda o: o["confidence"] >= o["minimum"])
    # exploding one element keeps the optimizer from copying the whole rule expression into every use
    best = F.explode(F.array(F.array_max(ok)))
    return secs.withColumn("_b", best).withColumns(
        {keep: F.coalesce(F.col("_b.type"), F.lit("unknown")), score: F.coalesce(F.col("_b.confidence"), F.lit(0.0))}
    ).drop("_b")


def drop_empty(secs: DataFrame) -> DataFrame:
    """Drop unknown low-confidence sections that show nothing."""
    shown = (
        (F.col("n_images") + F.col("n_buttons") + F.col("n_links") + F.col("n_paragraphs") > 0)
        | F.col("background_color").isNotNull() | F.col("has_gradient") | F.col("has_image")
    )
    return secs.filter(~((F.col("type") == "unknown") & (F.col("confidence") < 0.2) & (F.col("n_headings") == 0) & ~shown))


def section_name(secs: DataFrame) -> Column:
    """Readable name: id, else first telling class, else first heading, else type."""
    clean = lambda c: F.initcap(F.trim(F.regexp_replace(c, r"[-_]+", " ")))
    utility = r"^(flex|grid|p-|m-|w-|h-|text-|bg-|container$|row$|col)"
    telling = F.get(F.filter("classes", lambda c: (F.length(c) > 3) & ~c.rlike(utility)), F.lit(0))
    first = F.get("headings", F.lit(0))["text"]
    return F.coalesce(
        F.when(F.col("id") != "", clean(F.col("id"))), clean(telling), F.when(first != "", first), clean(F.col("type"))
    )


def analyzed_sections(pages: DataFrame, page_id: str = "page_id", html: str = "html", rules: list = SECTION_RULES) -> DataFrame:
    """Sections with content, style, vertical place, type, confidence and name; heights come from the content."""
    from webfacts.operators.sections import section_height, with_offsets

    secs = with_style_facts(with_content(sections(pages, page_id, html)))
    secs = secs.withColumn("height", section_height(F.col("n_headings"), F.col("n_paragraphs"), F.col("n_images"), F.col("n_buttons")).cast("long"))
    typed = classify(with_offsets(secs, page_id, "position"), rules)
    return typed.withColumn("name", section_name(typed))


def snippets(secs: DataFrame, limit: int = 10000) -> DataFrame:
    return secs.withColumn("snippet", cap_snippet("snippet", limit))
