"""HTML columns: plain text, headings, attributes, counts. Regular expressions only, no DOM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfacts.functions.base import ColumnOrName, col

_UNSEEN = r"(?is)<!--.*?-->|<(?:script|style|noscript)\b.*?</(?:script|style|noscript)\s*>"


def drop_unseen(html: ColumnOrName) -> Column:
    """Remove comments and the contents of script, style and noscript."""
    return F.regexp_replace(col(html), _UNSEEN, "")


def squeeze(text: ColumnOrName) -> Column:
    return F.trim(F.regexp_replace(col(text), r"[ \t\r\n]+", " "))


def strip_tags(html: ColumnOrName) -> Column:
    return F.regexp_replace(col(html), "<[^>]*>", "")


def html_text(html: ColumnOrName) -> Column:
    """Visible text: unseen blocks dropped, tags to blanks, white space squeezed."""
    return squeeze(F.regexp_replace(drop_unseen(html), "<[^>]*>", " "))


def count_matches(html: ColumnOrName, pattern: str) -> Column:
    return F.regexp_count(col(html), F.lit(pattern)).cast("long")


def extract_all(html: ColumnOrName, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col(html), F.lit(pattern), F.lit(group))


def tag_texts(html: ColumnOrName, tag: str, max_len: int) -> Column:
    """Trimmed inner texts of a tag, kept when 0 < length < ``max_len``."""
    inner = extract_all(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>")
    return F.filter(F.transform(inner, lambda t: F.trim(strip_tags(t))), lambda t: (F.length(t) > 0) & (F.length(t) < max_len))


def headings(html: ColumnOrName) -> Column:
    """``array<struct<level, text>>`` in page order, texts of 1 to 199 characters."""
    whole = extract_all(html, r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>", 0)
    parsed = F.transform(
        whole,
        lambda h: F.struct(
            F.substring(h, 3, 1).cast("int").alias("level"), squeeze(strip_tags(h)).alias("text")
        ),
    )
    return F.filter(parsed, lambda h: (F.length(h["text"]) > 0) & (F.length(h["text"]) < 200))


def attribute_values(html: ColumnOrName, name: str) -> Column:
    """All values of a double-quoted attribute in page order."""
    return extract_all(html, rf'(?i)\s{name}="([^"]*)"')


def attribute(tag: ColumnOrName, name: str) -> Column:
    """One attribute of an opening tag, either quote style; empty when absent."""
    t = col(tag)
    return F.coalesce(
        F.nullif(F.regexp_extract(t, rf'(?i)\s{name}\s*=\s*"([^"]*)"', 1), F.lit("")),
        F.regexp_extract(t, rf"(?i)\s{name}\s*=\s*'([^']*)'", 1),
    )


def class_names(html: ColumnOrName) -> Column:
    """Distinct class names, sorted."""
    names = F.flatten(F.transform(attribute_values(html, "class"), lambda v: F.split(v, r"\s+")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def style_blocks(html: ColumnOrName) -> Column:
    """Contents of the style elements joined by newlines."""
    return F.array_join(extract_all(html, r"(?is)<style\b[^>]*>(.*?)</style\s*>"), "\n")


def cap_snippet(html: ColumnOrName, limit: int) -> Column:
    """Keep short snippets; strip heavy elements from long ones, then cut to ``limit`` characters."""
    h = col(html)
    heavy = r"(?is)<(?:script|style|svg|noscript|iframe)\b.*?</(?:script|style|svg|noscript|iframe)\s*>|<!--.*?-->"
    light = F.regexp_replace(h, heavy, "")
    return F.when(F.octet_length(h) <= limit, h).otherwise(F.substring(light, 1, limit))
