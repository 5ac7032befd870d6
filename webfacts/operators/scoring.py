"""Design quality scores: banded columns over per-page facts, combined with caller-chosen weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.functions import html as H
from webfacts.functions.base import any_of, band, clamp, first_match, flag, mark, round_half_up
from webfacts.functions.color import is_neon
from webfacts.functions.score import clamp_score, grade
from webfacts.functions.text import arg_max, keyword_hits, keyword_list, normal_query
from webfacts.operators import aggregates as agg
from webfacts.rules.keywords import INDUSTRIES, STYLES
from webfacts.session import spread
from webfacts.rules.patterns import (
    AUDIENCE_TERMS, CLICHE_MARKS, CLICHE_PENALTY, COMMON_COLORS, DIV_OVERUSE, FONT_MARKS, GRAPHICS_MARKS, HTML_BASE, HTML_QUALITY, INDUSTRY_TERMS, LAYOUT_MARKS,
    MOTION_MARKS, ORIGINAL_POINTS, ORIGINALITY_MARKS,
)

# Axis weights, key section types, expected sections per industry, generic fonts.
AXIS_WEIGHTS = {"originality": 0.35, "craftsmanship": 0.40, "contextuality": 0.25}
KEY_SECTIONS = ["hero", "feature", "testimonial", "pricing", "cta"]
EXPECTED_SECTIONS = {
    "saas": ["hero", "feature", "pricing", "testimonial", "cta", "footer"],
    "ecommerce": ["hero", "gallery", "feature", "testimonial", "cta", "footer"],
    "portfolio": ["hero", "gallery", "about", "testimonial", "contact", "footer"],
    "corporate": ["hero", "about", "feature", "testimonial", "contact", "footer"],
    "blog": ["hero", "feature", "about", "contact", "footer"],
}
GENERIC_FONTS = ["arial", "helvetica", "times new roman", "times", "georgia", "verdana", "courier new", "sans-serif", "serif", "monospace", "system-ui"]


def overall(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``overall`` (weights scaled to sum 1, 2 digits) and ``grade`` from the axis columns."""
    w = {**AXIS_WEIGHTS, **(weights or {})}
    total = sum(w.values())
    if total <= 0 or min(w.values()) < 0:
        raise ValueError("weights must not be negative and not all zero")
    score = sum((F.col(a) * (v / total) for a, v in w.items()), F.lit(0.0))
    return df.withColumn("overall", clamp_score(score)).withColumn("grade", grade("overall"))


def layout_originality(types: Column, n_sections: Column) -> Column:
    """Variety of section types; ``types`` is the array of distinct types of a page."""
    n = F.size(types)
    keys = F.size(F.array_intersect(types, F.array(*[F.lit(k) for k in KEY_SECTIONS])))
    score = band(n, [(6, 50), (4, 35), (3, 25)], 15) + keys * 6 + band(n_sections, [(6, 20), (4, 15)], 10)
    return F.when(n_sections == 0, 30).otherwise(F.least(score, F.lit(100)))


def color_originality(palette: Column, has_accent: Column, roles: Column, contrast: Column) -> Column:
    score = band(palette, [(5, 40), (3, 25)], 10) + flag(has_accent) * 20 + F.least(roles * 5, F.lit(20)) + flag(contrast >= 4.5) * 20
    return F.when(palette == 0, 30).otherwise(F.least(score, F.lit(100)))


def type_originality(custom_fonts: Column, weights: Column, scale: Column) -> Column:
    return band(custom_fonts, [(2, 40), (1, 25)], 10) + band(weights, [(4, 30), (3, 20)], 10) + band(scale, [(5, 30), (3, 20)], 10)


def originality(df: DataFrame) -> DataFrame:
    """Columns: palette, has_accent, roles, contrast, types, n_sections, custom_fonts, weights, scale, cliche (0..100)."""
    parts = {
        "color_score": color_originality(F.col("palette"), F.col("has_accent"), F.col("roles"), F.col("contrast")),
        "layout_score": layout_originality(F.col("types"), F.col("n_sections")),
        "type_score": type_originality(F.col("custom_fonts"), F.col("weights"), F.col("scale")),
    }
    out = df.withColumns(parts)
    total = F.col("color_score") * 0.2 + F.col("layout_score") * 0.25 + F.col("type_score") * 0.2 + F.col("cliche") * 0.35
    return out.withColumn("originality", clamp_score(total))


def craftsmanship(df: DataFrame) -> DataFrame:
    """Five criteria of equal weight. Columns: grid, columns, gutter, max_width, fonts, scale, ratio_variance,
    line_height, contrast, accent_distance, section_gap, element_gap, gap_ratio_ok, breakpoints, adaptations."""
    c = F.col
    grid = first_match((c("grid") == "grid", 30), (c("grid") == "flex", 25), otherwise=10) + first_match((c("columns") >= 12, 30), (c("columns") >= 6, 20), (c("columns") > 0, 10), otherwise=0) + flag(c("gutter")) * 20 + flag(c("max_width")) * 20
    fonts = first_match((c("fonts").between(1, 2), 30), (c("fonts") == 3, 20), otherwise=10)
    ratio = F.when(c("scale") >= 4, first_match((c("ratio_variance") < 0.1, 40), (c("ratio_variance") < 0.3, 30), otherwise=20)).otherwise(15)
    lines = first_match((c("line_height").between(1.4, 1.7), 30), (c("line_height").between(1.2, 2.0), 20), otherwise=10)
    harmony = band(c("contrast"), [(7, 40), (4.5, 30), (3, 20)], 10) + first_match((c("accent_distance").isNull(), 15), (c("accent_distance") > 50, 30), (c("accent_distance") > 30, 20), otherwise=10) + 30
    space = first_match((c("section_gap").between(60, 120), 40), (c("section_gap").between(40, 150), 25), otherwise=15) + first_match((c("element_gap").between(16, 40), 30), (c("element_gap") >= 8, 20), otherwise=10) + F.when(c("gap_ratio_ok"), 30).otherwise(15)
    space = F.when(c("section_gap").isNull(), 50).otherwise(space)
    steps = lambda x, pts: first_match(*[(x >= n, p) for n, p in zip((4, 3, 2, 1), pts)], otherwise=0)
    responsive = F.when(c("breakpoints").isNull(), 30).otherwise(steps(c("breakpoints"), (50, 40, 25, 15)) + steps(c("adaptations"), (50, 40, 30, 20)))
    out = df.withColumns({"grid_score": grid, "consistency_score": fonts + ratio + lines, "harmony_score": harmony, "whitespace_score": space, "responsive_score": responsive})
    total = sum((F.least(F.col(f"{n}_score"), F.lit(100)) * 0.2 for n in ("grid", "consistency", "harmony", "whitespace", "responsive")), F.lit(0.0))
    return out.withColumn("craftsmanship", clamp_score(total))


def contextuality(df: DataFrame) -> DataFrame:
    """Industry .3, audience .25, brand .25, accessibility .2. Columns: industry, types, audience, fonts_list,
    section_colors, palette_colors, has_dominant, contrast, body_px, line_height."""
    c = F.col
    fit = F.lit(60)
    for name, expected in EXPECTED_SECTIONS.items():
        share = F.size(F.array_intersect("types", F.array(*[F.lit(x) for x in expected]))) * 100 / len(expected)
        fit = F.when(F.lower("industry") == name, clamp(round_half_up(share), 40, 100)).otherwise(fit)
    low = F.transform("fonts_list", lambda f: F.lower(f))
    has = lambda words: F.exists(low, lambda f: any_of(f, words))
    who = F.lower("audience")
    audience = F.lit(60) + flag(who.rlike("developer|technical") & has(["mono", "code", "jetbrains"])) * 20 + flag(who.rlike("young|modern") & has(["inter", "poppins", "montserrat", "space"])) * 20 + flag(F.exists(low, lambda f: ~f.isin(GENERIC_FONTS))) * 10
    audience = F.when(c("audience").isNull(), 60).otherwise(F.least(audience, F.lit(100)))
    used = F.transform("section_colors", lambda x: F.lower(x))
    ours = F.transform("palette_colors", lambda x: F.lower(x))
    match = F.size(F.filter(used, lambda x: F.array_contains(ours, x))) / F.size(used)
    brand = F.when(F.size(used) == 0, 25).otherwise(round_half_up(match * 50)) + flag(c("has_dominant")) * 30 + F.when(F.size("fonts_list") <= 2, 20).otherwise(10)
    access = band(c("contrast"), [(7, 60), (4.5, 45), (3, 25)], 10) + band(c("body_px"), [(16, 20), (14, 10)], 0) + band(c("line_height"), [(1.5, 20), (1.3, 10)], 0)
    out = df.withColumns({"industry_score": fit, "audience_score": audience, "brand_score": F.least(brand, F.lit(100)), "access_score": access})
    total = c("industry_score") * 0.3 + c("audience_score") * 0.25 + c("brand_score") * 0.25 + c("access_score") * 0.2
    return out.withColumn("contextuality", clamp_score(total))


def findings(df: DataFrame, key: str, parts: list[str], strong: float = 70, weak: float = 50) -> DataFrame:
    """Breakdown columns to rows: strengths (>= strong), weaknesses (< weak) with a recommendation."""
    melted = df.select(key, F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("double").alias("score")) for p in parts])).alias("x"))
    rows = melted.select(key, "x.*")
    kind = F.when(F.col("score") >= strong, "strength").when(F.col("score") < weak, "weakness")
    advice = F.when(F.col("score") < weak, F.concat(F.lit("Improve "), F.regexp_replace(F.regexp_replace("part", "_score$", ""), "_", " ")))
    return rows.withColumns({"kind": kind, "advice": advice}).filter(F.col("kind").isNotNull())


Detector = Callable[[], tuple[Column, Column]]


class ClicheRegistry:
    """Detectors for overused designs: id -> (weight, detector). A detector returns (detected, confidence)
    columns over the context row: sections (array of structs type, start_y, height, n_headings, gradient_colors),
    palette (hex array), fonts (lower-case names), columns."""

    def __init__(self, builtin: bool = True):
        self.patterns: dict[str, tuple[float, Detector]] = {}
        if builtin:
            never = lambda: (F.lit(False), F.lit(0.0))
            self.add("excessive-gradients", 0.8, _gradients)
            self.add("unrealistic-colors", 0.9, _neon)
            self.add("over-decoration", 0.6, never)
            self.add("stock-photo-composition", 0.7, _stock)
            self.add("perfect-symmetry", 0.4, never)
            self.add("font-mismatch", 0.5, _fonts)
            self.add("shadow-overuse", 0.5, never)
            self.add("artificial-whitespace", 0.3, lambda: equal_heights(F.transform("sections", lambda s: s["height"])))

    def add(self, name: str, weight: float, detector: Detector) -> None:
        self.patterns[name] = (weight, detector)

    def remove(self, name: str) -> bool:
        return self.patterns.pop(name, None) is not None

    def get(self, name: str) -> tuple[float, Detector] | None:
        return self.patterns.get(name)

    def names(self) -> list[str]:
        return list(self.patterns)

    def detect(self, contexts: DataFrame, key: str) -> DataFrame:
        """One row per page and detected pattern."""
        found = []
        for name, (weight, detector) in self.patterns.items():
            hit, conf = detector()
            found.append(F.when(hit, F.struct(F.lit(name).alias("pattern"), F.lit(float(weight)).alias("weight"), conf.cast("double").alias("confidence"))))
        rows = contexts.select(key, F.explode(F.array_compact(F.array(*found))).alias("d"))
        return rows.select(key, "d.*")


def _gradients() -> tuple[Column, Column]:
    n = F.size(F.filter("sections", lambda s: s["gradient_colors"] >= 3))
    return n > 0, F.least(F.lit(1.0), n / 2)


def _neon() -> tuple[Column, Column]:
    n = F.size(F.filter("palette", lambda h: is_neon(h)))
    return n >= 2, F.least(F.lit(1.0), n / 3)


def _stock() -> tuple[Column, Column]:
    hero = F.exists("sections", lambda s: (s["type"] == "hero") & (s["start_y"] < 100))
    feature = F.get(F.filter("sections", lambda s: s["type"] == "feature"), F.lit(0))
    three = F.coalesce(F.col("columns") == 3, F.lit(False)) | (feature["n_headings"] == 3)
    return (F.size("sections") >= 2) & hero & feature.isNotNull() & three, F.lit(0.8)


def _fonts() -> tuple[Column, Column]:
    # Font pairs that do not go together.
    pairs = [("comic sans ms", "times new roman"), ("papyrus", "arial"), ("impact", "comic sans ms")]
    hit = F.lit(False)
    for a, b in pairs:
        hit = hit | (F.array_contains("fonts", a) & F.array_contains("fonts", b))
    return hit, F.lit(1.0)


def equal_heights(heights: Column) -> tuple[Column, Column]:
    """All heights equal .9, standard deviation below a tenth of the mean .6; at least three are needed."""
    n = F.size(heights)
    mean = F.aggregate(heights, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(heights, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    same = F.size(F.array_distinct(heights)) == 1
    return (n >= 3) & (same | (F.sqrt(var) < mean * 0.1)), F.when(same, 0.9).otherwise(0.6)


def equal_height_pages(sections: DataFrame, page: str, height: str) -> DataFrame:
    """The same test on a section table, as one aggregation."""
    rows = sections.groupBy(page).agg(F.count(F.lit(1)).alias("n"), F.min(height).alias("_a"), F.max(height).alias("_b"), F.avg(height).alias("_m"), F.stddev_pop(height).alias("_s"))
    conf = F.when(F.col("n") < 3, 0.0).when(F.col("_a") == F.col("_b"), 0.9).when(F.col("_s") < F.col("_m") * 0.1, 0.6).otherwise(0.0)
    return rows.select(page, conf.alias("confidence"))


def cliche_score(pages: DataFrame, detected: DataFrame, key: str) -> DataFrame:
    """round(max(0, 100 - sum(weight * confidence) / 5 * 100)), 100 for a page without findings."""
    cost = detected.groupBy(key).agg(F.sum(F.col("weight") * F.col("confidence")).alias("_w"))
    score = round_half_up(F.greatest(F.lit(0.0), 100 - F.coalesce("_w", F.lit(0.0)) / 5 * 100))
    return pages.select(key).join(cost, key, "left").select(key, score.alias("cliche"))


def _original_points(low: Column) -> Column:
    """Points for an own colour scheme, fonts, layout, motion and graphics."""
    some = lambda marks: any_mark(low, marks)
    colors = F.array_distinct(F.regexp_extract_all(low, F.lit("#[0-9a-f]{6}"), F.lit(0)))
    areas = F.regexp_extract_all(low, F.lit("grid-template-areas:\\s*[\"'][^\"']+[\"']"), F.lit(0))
    quotes = lambda a: F.length(F.regexp_replace(a, "[^\"']", ""))
    turns = F.regexp_extract_all(low, F.lit("transition:\\s*([^;]+)"), F.lit(0))
    found = {
        "colors": F.size(F.array_except(colors, F.array(*[F.lit(c) for c in COMMON_COLORS]))) >= 3,
        "fonts": some(FONT_MARKS),
        "layout": some(LAYOUT_MARKS) | F.exists(areas, lambda a: quotes(a) / 2 >= 3),
        "motion": some(MOTION_MARKS) | (H.count_matches("_low", r"@keyframes\s+[a-z]") >= 2) | F.exists(turns, lambda x: F.length(F.regexp_replace(x, "[^,]", "")) >= 2),
        "graphics": some(GRAPHICS_MARKS),
    }
    return sum((F.when(cond, ORIGINAL_POINTS[name]).otherwise(0) for name, cond in found.items()), F.lit(0))


def any_mark(low: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | mark(low, m)
    return out


def _term_points(low: Column, target: str | None, terms: list) -> Column:
    points = F.lit(0)
    for names, n, expressions in terms:
        if target and target.lower() in names:
            hit = F.lit(True)
            for e in expressions:
                hit = hit & mark(low, e)
            points = points + F.when(hit, n).otherwise(0)
    return points


def html_quality(
    pages: DataFrame, page_id: str = "page_id", html: str = "html", strict: bool = False, industry: str | None = None, audience: str | None = None
) -> DataFrame:
    """Axis scores straight from the markup: base points plus the points of every mark that matches.

    ``industry`` and ``audience`` add the points of their terms to contextuality.
    """
    pages = spread(pages.select(page_id, html), page_id).withColumn("_low", F.lower(html))
    low = F.col("_low")
    marks = lambda axis: sum((F.when(mark(low, p), n).otherwise(0) for a, n, p in HTML_QUALITY if a == axis), F.lit(HTML_BASE[axis]))
    imgs = F.when(low.contains("<img"), H.extract_all("_low", "<img[^>]*>", 0)).otherwise(F.array().cast("array<string>"))
    alts = F.size(F.filter(imgs, lambda i: i.contains("alt=")))
    alt = F.when(F.size(imgs) == 0, 0).when(alts == F.size(imgs), 5).otherwise(-5)
    onclick = H.count_matches("_low", "onclick=")
    penalty, most_div, least_semantic = DIV_OVERUSE
    overused = (H.count_matches("_low", "<div[^>]*>") > most_div) & (H.count_matches("_low", "<(header|main|nav|footer|section|article|aside)[^>]*>") < least_semantic)
    craft = marks("craftsmanship") + alt - onclick * 3 - F.when(overused, penalty).otherwise(0)
    cliche = F.lit(0)
    count = F.lit(0)
    for severity, pattern in CLICHE_MARKS:
        if severity == "low" and not strict:
            continue
        hit = mark(low, pattern)
        cliche = cliche + F.when(hit, CLICHE_PENALTY[severity][int(strict)]).otherwise(0)
        count = count + flag(hit)
    own = F.lit(HTML_BASE["originality"]) - cliche
    for points, pattern, least in ORIGINALITY_MARKS:
        own = own + F.when(mark(low, pattern) & (H.count_matches("_low", f"(?i){pattern}") >= least), points).otherwise(0)
    own = own + F.when(low.contains("@keyframes") & (H.count_matches("_low", r"@keyframes\s+[a-z]") == 1), 3).otherwise(0)
    own = own + _original_points(low)
    clear = low.contains("<header") & low.contains("<main") & low.contains("<footer")
    fit = marks("contextuality") + flag(clear) * 5 + _term_points(low, industry, INDUSTRY_TERMS) + _term_points(low, audience, AUDIENCE_TERMS)
    rows = pages.select(
        page_id, clamp(own, 0, 100).alias("originality"), clamp(craft, 0, 100).alias("craftsmanship"), clamp(fit, 0, 100).alias("contextuality"), count.alias("cliches")
    )
    return overall(rows)


def visual_density(media: Column, sections: Column) -> Column:
    """Piecewise points of media elements per section."""
    d = media / F.greatest(sections, F.lit(1))
    score = first_match(
        (media <= 0, F.lit(0.0)), (d < 0.5, d * 80), (d < 1, 40 + (d - 0.5) * 40), (d < 2, 60 + (d - 1) * 20), (d < 3, 80 + (d - 2) * 15),
        otherwise=F.least(F.lit(100.0), 95 + (d - 3) * 2),
    )
    return clamp(round_half_up(score), 0, 100)


def visual_design(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Density, typography, colour, whitespace and depth scores and their weighted mean."""
    from webfacts.functions import css
    from webfacts.pages.styles import declarations, sheet

    pages = spread(pages.select(page_id, html), page_id)
    values = lambda *names: F.transform(F.filter("_d", lambda d: d["property"].isin(list(names))), lambda d: d["value"])
    decls = F.flatten(F.transform(F.regexp_extract_all(F.concat_ws("\n", sheet(html), F.array_join(F.transform(H.extract_all(html, r'(?is)\sstyle="([^"]*)"'), lambda s: F.concat(F.lit("x{"), s, F.lit("}"))), "\n")), F.lit(r"\{([^{}]*)\}"), F.lit(1)), declarations))
    rows = pages.withColumn("_d", decls)
    px = lambda arr: F.array_distinct(F.transform(arr, css.size_px))
    rows = rows.withColumns(
        {
            "_sizes": px(values("font-size")), "_weights": F.array_distinct(F.transform(values("font-weight"), css.weight_number)),
            "_lines": F.array_distinct(values("line-height")), "_colors": F.array_distinct(F.flatten(F.transform(values("color", "background", "background-color", "border-color"), css.color_literals))),
            "_gaps": values("margin", "padding", "gap", "margin-top", "margin-bottom", "padding-top", "padding-bottom"),
        }
    )
    n = F.size("_sizes")
    r = F.array_max("_sizes") / F.array_min("_sizes")
    contrast = first_match((r >= 3, F.lit(40)), (r >= 2, 25 + round_half_up((r - 2) * 15)), (r >= 1.5, 15 + round_half_up((r - 1.5) * 20)), otherwise=round_half_up(r * 10))
    type_score = F.when(n == 0, 10).otherwise(contrast + F.least(n * 5, F.lit(25)) + F.least(F.size("_weights") * 7, F.lit(20)) + F.least(F.size("_lines") * 3, F.lit(15)))
    k = F.size("_colors")
    variety = first_match((k <= 1, F.lit(5)), (k <= 3, 15 + (k - 1) * 5), (k <= 6, 25 + (k - 3) * 5), (k <= 10, 40 + (k - 6) * 2), otherwise=F.least(F.lit(50), 48 + F.floor(k / 10)))
    rows = rows.withColumn("_hues", F.array_compact(F.transform("_colors", _hue_of)))
    rad = lambda f: F.aggregate("_hues", F.lit(0.0), lambda s, h: s + f(F.radians(h))) / F.size("_hues")
    variance = F.when(F.size("_hues") < 2, 0.0).otherwise(1 - F.sqrt(F.pow(rad(F.sin), F.lit(2.0)) + F.pow(rad(F.cos), F.lit(2.0))))
    color_score = F.when(k == 0, 5).otherwise(variety + round_half_up(variance * 50))
    gaps = F.transform(F.filter("_gaps", lambda g: g.rlike(r"\d+px")), lambda g: F.regexp_extract(g, r"(\d+)px", 1).cast("int"))
    share = F.size(F.filter(gaps, lambda g: g % 4 == 0)) / F.size(gaps)
    space = F.least(F.size("_gaps") * 2, F.lit(25)) + F.least(F.size(F.filter("_gaps", lambda g: g.contains("clamp("))) * 8, F.lit(25)) + F.least(F.size(F.filter("_gaps", lambda g: g.contains("var("))) * 5, F.lit(20))
    space = space + F.when(F.size(gaps) >= 3, round_half_up(share * 20)).otherwise(0) + F.least(F.size(F.filter(gaps, lambda g: g >= 80)) * 3, F.lit(10))
    space_score = F.when(F.size("_gaps") == 0, 10).otherwise(space)
    has = lambda p: F.size(F.filter("_d", lambda d: d["property"] == p))
    grads = H.extract_all(html, r"(?i)(?:linear|radial|conic)-gradient\([^;}]*", 0)
    deep = F.least(F.size(grads) * 4, F.lit(10)) + F.size(F.filter(grads, lambda g: F.regexp_count(g, F.lit(",")) >= 3)) * 3
    depth = (
        F.least(has("box-shadow") * 8, F.lit(20)) + F.least(has("text-shadow") * 5, F.lit(10)) + F.least(has("filter") * 5, F.lit(10)) + F.least(has("backdrop-filter") * 5, F.lit(5))
        + F.least(deep, F.lit(20)) + F.least(has("transform") * 5, F.lit(15)) + F.least(has("z-index") * 3, F.lit(10))
        + F.least(H.count_matches(html, r"(?i)::(?:before|after)\s*\{[^}]*(?:content|background|border|position\s*:\s*absolute)") * 3, F.lit(10))
    )
    media = H.count_matches(html, r"(?i)<(?:img|svg|video|canvas|picture)\b") - H.count_matches(html, r"(?i)<img\b[^>]*\salt=(?:\"\"|'')")
    out = rows.select(
        page_id, visual_density(media, H.count_matches(html, r"(?i)<(?:section|article)\b")).alias("density"), clamp(type_score, 0, 100).alias("typography"),
        clamp(color_score, 0, 100).alias("color"), clamp(space_score, 0, 100).alias("whitespace"), clamp(depth, 0, 100).alias("depth"),
    )
    c = F.col
    return out.withColumn("overall", clamp(round_half_up(c("density") * 0.25 + c("typography") * 0.2 + c("color") * 0.15 + c("whitespace") * 0.15 + c("depth") * 0.25), 0, 100))


def _hue_of(literal: Column) -> Column:
    from webfacts.functions.base import let
    from webfacts.functions.color import hex_to_rgb, hue
    from webfacts.functions.css import rgb_literal_hex

    return let(hex_to_rgb(rgb_literal_hex(literal)), lambda c: F.when(F.greatest(c["r"], c["g"], c["b"]) != F.least(c["r"], c["g"], c["b"]), hue(c["r"], c["g"], c["b"])))


def narrative_confidence(df: DataFrame) -> DataFrame:
    """Weighted completeness of the sources -> level -> action.

    Columns: vision_used, vision_confidence, vision_fallback, vision_completeness, n_variables, n_type_styles,
    token_confidence, n_sections, n_section_types, layout_completeness, n_motions (null = not analysed), all_reduced, all_levels.
    """
    c = F.col
    vision = F.when(c("vision_used"), F.coalesce("vision_confidence", F.lit(0.8)) * (0.7 + F.coalesce("vision_completeness", F.lit(1.0)) * 0.3)).when(c("vision_fallback"), 0.4).otherwise(0.3)
    style = F.least(F.lit(1.0), F.when((c("n_variables") > 0) | (c("n_type_styles") > 0), 0.2).otherwise(0.0) + F.least(F.lit(1.0), c("n_variables") / 50) * 0.5 + F.least(F.lit(1.0), c("n_type_styles") / 20) * 0.3 + F.coalesce("token_confidence", F.lit(0.0)) * 0.2)
    markup = F.least(F.lit(1.0), F.when(c("n_sections") > 0, 0.3).otherwise(0.0) + F.least(F.lit(1.0), c("n_sections") / 10) * 0.5 + F.least(F.lit(1.0), c("n_section_types") / 5) * 0.2 + F.coalesce("layout_completeness", F.lit(0.0)) * 0.3)
    motion = F.when(c("n_motions").isNull(), 0.5).when(c("n_motions") == 0, 0.7).otherwise(F.least(F.lit(1.0), 0.3 + F.least(F.lit(1.0), c("n_motions") / 20) * 0.4 + flag(c("all_reduced")) * 0.2 + flag(c("all_levels")) * 0.2))
    out = df.withColumns({"vision": vision, "style": style, "markup": markup, "motion": motion})
    out = out.withColumns(
        {
            "confidence": clamp(c("vision") * 0.4 + c("style") * 0.2 + c("markup") * 0.25 + c("motion") * 0.15, 0.0, 1.0),
            "world_view": clamp(c("vision") * 0.6 + c("style") * 0.4, 0.0, 1.0),
            "layout": clamp(c("markup") * 0.7 + c("style") * 0.3, 0.0, 1.0),
        }
    )
    level = band(c("confidence"), [(0.8, "high"), (0.6, "medium"), (0.4, "low")], "insufficient")
    action = first_match((c("level") == "high", "save"), (c("level") == "medium", "save_with_warning"), (c("level") == "low", "flag_for_review"), otherwise="analyze_again")
    return out.withColumn("level", level).withColumn("action", action)


def infer_context(queries: DataFrame, text_col: str, industries: dict = INDUSTRIES, styles: dict = STYLES) -> DataFrame:
    """Industry, style, confidence and found keywords of query texts. Expressions only: the dictionaries are literals."""
    rows = queries.withColumn("_q", normal_query(text_col))

    def best(table: dict, name: str, df: DataFrame) -> DataFrame:
        cols = {f"_{name}_{k}": keyword_hits("_q", words) * w for k, (w, words) in table.items()}
        df = df.withColumns(cols)
        top, score = arg_max({k: F.col(f"_{name}_{k}") for k in table})
        return df.withColumns({name: F.when(score >= 0.5, top), f"_{name}": F.when(score >= 0.5, score)}).drop(*cols)

    rows = best(styles, "style", best(industries, "industry", rows))
    i, s = F.col("_industry"), F.col("_style")
    conf = (
        F.when(i.isNull() & s.isNull(), 0.0)
        .when(s.isNull(), 0.5 + F.least(F.lit(0.2), i * 0.1))
        .when(i.isNull(), 0.5 + F.least(F.lit(0.2), s * 0.1))
        .otherwise(0.65 + F.least(F.lit(0.2), i * 0.1) + F.least(F.lit(0.1), s * 0.05))
    )
    words = [w for table in (industries, styles) for _, ws in table.values() for w in ws]
    return rows.withColumns({"confidence": F.least(F.lit(1.0), conf), "keywords": keyword_list("_q", words)}).drop("_q", "_industry", "_style")


def evaluate_batch(pages: DataFrame, page_id: str = "page_id", html: str = "html", weights: dict | None = None, strict: bool = False, on_error: str = "skip", industry: str | None = None, audience: str | None = None) -> DataFrame:
    """Quality of many pages in one job; pages without markup fail and carry an error instead of a score."""
    empty = F.col(html).isNull() | (F.trim(F.col(html)) == "")
    marked = agg.batch_result(pages.select(page_id, html), page_id, empty, on_error)
    scored = html_quality(marked.filter(~F.col("failed")), page_id, html, strict, industry, audience)
    if weights:
        scored = overall(scored.drop("overall", "grade"), weights)
    bad = marked.filter("failed").select(page_id, F.lit("empty_html").alias("error"))
    return scored.withColumn("error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
