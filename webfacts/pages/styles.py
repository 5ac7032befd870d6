"""Style facts of pages: rules, keyframes, variables, colours, backgrounds, decorations, typography, layout."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.functions import css
from webfacts.functions.base import ColumnOrName, any_of, col, first_match, let, num
from webfacts.functions.html import extract_all, style_blocks
from webfacts.session import spread

_KEYFRAMES = r"(?is)@(?:-webkit-)?keyframes\s+([\w-]+)\s*\{((?:[^{}]*\{[^{}]*\})*)[^{}]*\}"
_BLOCK = r"([^{}]+)\{([^{}]*)\}"
_NO_COMMENT = r"(?s)/\*.*?\*/"
_SPACE = " \t\n\x0b\f\r"  # \s
# Parts of every property name that a job over rules asks for, see ``about`` of :func:`rule_blocks`.
DECORATION_WORDS = ["shadow", "background", "border", "animation", "backdrop-filter"]
TYPE_WORDS = ["font-"]
LAYOUT_WORDS = ["display", "grid-template-columns", "gap", "margin", "padding"]


def sheet(html: ColumnOrName) -> Column:
    """All style elements of a page without comments."""
    return F.regexp_replace(style_blocks(html), _NO_COMMENT, "")


def declarations(body: ColumnOrName) -> Column:
    """``array<struct<property, value>>`` of a declaration block, properties in lower case."""
    parts = F.filter(F.split(col(body), r";(?![^()]*\))"), lambda d: d.contains(":"))
    # the name before the first colon is plain, so the value is cut out by its place and needs no expression of its own
    after = lambda d: F.trim(F.ltrim(F.substring(d, F.instr(d, ":") + 1, F.length(d)), F.lit(_SPACE)))
    parsed = F.transform(parts, lambda d: F.struct(F.lower(F.regexp_extract(d, r"^\s*([\w-]+)\s*:", 1)).alias("property"), after(d).alias("value")))
    return F.filter(parsed, lambda d: (d["property"] != "") & (d["value"] != ""))


def _selector(block: Column) -> Column:
    """What stands before the brace of a match of ``_BLOCK``."""
    return F.substring_index(block, "{", 1)


def _body(block: Column) -> Column:
    """What stands between the braces of a match of ``_BLOCK``."""
    at = F.instr(block, "{")
    return F.substring(block, at + 1, F.length(block) - at - 1)


def prop(decls: ColumnOrName, *names: str) -> Column:
    """Value of the first named property that is set; the last declaration of a property counts."""

    def last(name: str) -> Column:
        return F.get(F.reverse(F.filter(col(decls), lambda d: d["property"] == name)), F.lit(0))["value"]

    return F.coalesce(*[last(n) for n in names])


def rules_of(html: ColumnOrName, about: list[str] | None = None) -> Column:
    """``array<struct<selector, decls>>`` of a page: its style rules, then its style attributes; ``about`` as in :func:`rule_blocks`."""
    text = F.regexp_replace(sheet(html), _KEYFRAMES, "")
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))
    sheet_rules = F.transform(blocks, lambda b: F.struct(F.trim(_selector(b)).alias("selector"), _body(b).alias("body")))
    styled = extract_all(html, r'(?is)<[a-z][a-z0-9]*\b[^>]*\sstyle="[^"]*"', 0)
    inline = F.transform(
        styled,
        lambda s: F.struct(
            F.lower(F.regexp_extract(s, "^<([A-Za-z][A-Za-z0-9]*)", 1)).alias("selector"), F.regexp_extract(s, r'(?is)\sstyle="([^"]*)"', 1).alias("body")
        ),
    )
    none = F.array().cast("array<struct<property:string,value:string>>")
    read = lambda body: declarations(body) if about is None else F.when(any_of(F.lower(body), about), declarations(body)).otherwise(none)
    # declarations are read before rows are made: a filter on them behind an explode then reads them no second time
    return F.transform(F.concat(sheet_rules, inline), lambda r: F.struct(r["selector"].alias("selector"), read(r["body"]).alias("decls")))


def keyframes_of(html: ColumnOrName) -> Column:
    """``array<struct<name, steps array<struct<property, offset, value>>>>`` of a page, one entry per ``@keyframes`` block."""

    def steps(block: Column) -> Column:
        """The declarations of one step, once for each of its offsets."""
        both = F.struct(css.keyframe_offsets(_selector(block)).alias("at"), declarations(_body(block)).alias("decls"))
        return let(
            both, lambda x: F.flatten(F.transform(x["decls"], lambda d: F.transform(x["at"], lambda o: F.struct(d["property"].alias("property"), o.alias("offset"), d["value"].alias("value")))))
        )

    def whole(k: Column) -> Column:
        blocks = F.regexp_extract_all(F.regexp_extract(k, _KEYFRAMES, 2), F.lit(_BLOCK), F.lit(0))
        return F.struct(F.regexp_extract(k, _KEYFRAMES, 1).alias("name"), F.flatten(F.transform(blocks, steps)).alias("steps"))

    return F.transform(F.regexp_extract_all(sheet(html), F.lit(_KEYFRAMES), F.lit(0)), whole)


def rule_blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html", about: list[str] | None = None) -> DataFrame:
    """One row per style rule or style attribute: page, rule_no, selector, decls.

    With ``about`` (parts of property names, lower case) the declarations of a rule that names none of them are not read; its row
    has none. A caller that asks for such properties only gets the same results for less work.
    """
    pages = spread(pages.select(page_id, html), page_id)
    rows = pages.select(page_id, F.posexplode(rules_of(html, about)).alias("rule_no", "r"))
    return rows.select(page_id, "rule_no", F.col("r.selector").alias("selector"), F.col("r.decls").alias("decls"))


def style_rules(pages: DataFrame, page_id: str = "page_id", html: str = "html", max_css: int | None = None, about: list[str] | None = None) -> DataFrame:
    """Long form ``(page, rule_no, selector, property, value)``. ``max_css`` leaves out pages with larger sheets; ``about`` as in :func:`rule_blocks`."""
    kept = pages if max_css is None else pages.filter(F.length(sheet(html)) <= max_css)
    d = rule_blocks(kept, page_id, html, about).select(page_id, "rule_no", "selector", F.explode("decls").alias("d"))
    return d.select(page_id, "rule_no", "selector", "d.*")


def keyframes(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``(page, name, offset, property, value)``."""
    pages = spread(pages.select(page_id, html), page_id)
    whole = pages.select(page_id, F.explode(F.regexp_extract_all(sheet(html), F.lit(_KEYFRAMES), F.lit(0))).alias("k"))
    steps = whole.select(
        page_id,
        F.regexp_extract("k", _KEYFRAMES, 1).alias("name"),
        F.explode(F.regexp_extract_all(F.regexp_extract("k", _KEYFRAMES, 2), F.lit(_BLOCK), F.lit(0))).alias("b"),
    )
    at = steps.select(page_id, "name", F.explode(css.keyframe_offsets(_selector(F.col("b")))).alias("offset"), "b")
    out = at.select(page_id, "name", "offset", F.explode(declarations(_body(F.col("b")))).alias("d"))
    return out.select(page_id, "name", "offset", "d.*")


def variables(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Inventory of CSS variables: name, value (last declaration), category, use of calc and clamp."""
    rules = style_rules(pages, page_id, html, about=["--"]).filter(F.col("property").startswith("--"))
    last = rules.groupBy(page_id, F.col("property").alias("name")).agg(F.max_by("value", "rule_no").alias("value"))
    return last.select(
        page_id, "name", "value", css.variable_category("name").alias("category"),
        F.col("value").contains("calc(").alias("uses_calc"), F.col("value").contains("clamp(").alias("uses_clamp"),
    )


def token_style(vars_: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Design-token facts per page: variables, categories, share of shades and named scales."""
    n = F.col("name")
    return vars_.groupBy(page_id).agg(
        F.count(F.lit(1)).alias("variables"),
        F.countDistinct("category").alias("categories"),
        F.count_if(n.rlike(r"-\d{2,3}$")).alias("shades"),
        F.count_if(n.rlike("-(xs|sm|md|lg|xl|2xl)$")).alias("scales"),
        F.count_if("uses_calc").alias("calc"),
        F.count_if("uses_clamp").alias("clamp"),
    )


_PLAIN_VAR = re.compile(r"var\(\s*(--[\w-]+)\s*(?:,\s*((?:(?!var\()[^()]|(?!var)\w*\([^()]*\))*))?\)")


def resolve_page(names: list[str], values: list[str], depth: int = 10) -> list[tuple[str, str]]:
    """Value and status of the variables of one page, in their order; see :func:`resolve_variables`."""
    known, out = dict(zip(names, values)), []
    for value in values:
        stuck = False
        for _ in range(depth):
            if stuck or "var(" not in value:
                break
            stuck = True

            def swap(m: re.Match) -> str:
                nonlocal stuck
                new = known.get(m.group(1), (m.group(2) or "").strip() or None)
                stuck = stuck and new is None
                return m.group(0) if new is None else new

            value = _PLAIN_VAR.sub(swap, value)
        out.append((value, "resolved" if "var(" not in value else "unresolved" if stuck else "failed"))
    return out


def resolve_variables(vars_: DataFrame, page_id: str = "page_id", depth: int = 10) -> DataFrame:
    """``(page, name, value, status)`` with references replaced: resolved, unresolved or failed.

    The variables of a page are one row, bounded by the page they come from, and references are followed inside it: one
    shuffle by page, no join. Innermost references go first, so a fallback may itself hold a reference; a name without
    value takes its fallback. A value that nothing in it can be replaced in is unresolved; one that still refers to a
    name after ``depth`` replacements is a cycle or too deep and fails. Null names and values are left out.
    """

    def run(names: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([[{"value": v, "status": s} for v, s in resolve_page(list(n), list(v), depth)] for n, v in zip(names, values)])

    entry = F.struct("name", "value")
    per_page = vars_.filter("name IS NOT NULL AND value IS NOT NULL").groupBy(page_id).agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    solve = F.pandas_udf(run, "array<struct<value:string,status:string>>")
    solved = per_page.select(page_id, F.col("_all.name").alias("_names"), solve(F.col("_all.name"), F.col("_all.value")).alias("_solved"))
    rows = solved.select(page_id, F.explode(F.arrays_zip("_names", "_solved")).alias("_z"))
    return rows.select(page_id, F.col("_z._names").alias("name"), F.col("_z._solved.value").alias("value"), F.col("_z._solved.status").alias("status"))


def page_colors(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Background colours, text colours (variables resolved) and a gradient flag per page."""
    decls = F.flatten(F.transform(rules_of(html, ["--", "background", "color"]), lambda r: r["decls"]))
    # variables are resolved in the row of their page: a join by page and name would bring all pages together, or to the driver where the input is a small file
    none = F.array().cast("array<struct<property:string,value:string>>")
    whole = spread(pages.select(page_id, html), page_id).select(page_id, F.coalesce(decls, none).alias("_decls"))
    own = F.filter("_decls", lambda d: d["property"].startswith("--"))
    shown = F.filter("_decls", lambda d: d["property"].isin("background", "background-color", "background-image", "color"))
    lists = whole.select(page_id, shown.alias("_shown"), F.transform(own, lambda d: d["property"]).alias("_names"), F.transform(own, lambda d: d["value"]).alias("_values"))

    def run(names: pd.Series, values: pd.Series) -> pd.Series:
        last = [dict(zip(n, v)) for n, v in zip(names, values)]  # the last declaration of a name counts
        return pd.Series([[{"name": n, "value": v} for n, (v, _) in zip(d, resolve_page(list(d), list(d.values())))] for d in last])

    solve = F.pandas_udf(run, "array<struct<name:string,value:string>>")
    solved = lists.withColumn("_solved", solve("_names", "_values"))
    ref = lambda v: F.regexp_extract(v, r"^var\(\s*(--[\w-]+)", 1)
    known = lambda v: let(ref(v), lambda r: F.get(F.filter("_solved", lambda s: s["name"] == r), F.lit(0))["value"])
    # a generator over the bare column would filter on its size, which parses the pages once more, before they are spread
    filled = F.transform("_shown", lambda d: F.struct(d["property"].alias("property"), F.coalesce(known(d["value"]), d["value"]).alias("value")))
    used = solved.select(page_id, F.explode(filled).alias("_d")).select(page_id, "_d.*")
    found = used.select(page_id, "property", "value", F.explode_outer(css.color_literals("value")).alias("color"))
    is_text = F.col("property") == "color"
    return found.groupBy(page_id).agg(
        F.array_sort(F.collect_set(F.when(~is_text, F.col("color")))).alias("backgrounds"),
        F.array_sort(F.collect_set(F.when(is_text, F.col("color")))).alias("texts"),
        F.coalesce(F.bool_or(F.col("value").contains("gradient(")), F.lit(False)).alias("has_gradient"),
    )


def backgrounds(rules: DataFrame) -> DataFrame:
    """Typed background designs of :func:`rule_blocks`, first applicable type in a fixed order."""
    bg = prop("decls", "background", "background-image")
    shade = prop("decls", "background-color")
    blur = num(F.regexp_extract(F.coalesce(prop("decls", "backdrop-filter", "-webkit-backdrop-filter"), F.lit("")), r"blur\(\s*(\d*\.?\d+)", 1))
    moving = F.coalesce(prop("decls", "animation"), prop("decls", "animation-name"), F.lit("none"))
    fades = F.coalesce(prop("decls", "transition"), prop("decls", "transition-property"), F.lit(""))
    rows = rules.withColumns(
        {
            "bg": F.coalesce(bg, F.lit("")), "shade": shade, "blur": F.coalesce(blur, F.lit(0.0)),
            "animated": (moving != "none") | F.lower(fades).rlike("background|all"),
        }
    ).filter((F.col("bg") != "") | F.col("shade").isNotNull())
    rows = rows.withColumns({"gradients": css.gradients("bg"), "layers": F.size(css.split_list("bg")), "both": F.lower(F.concat_ws(" ", "bg", "shade"))})
    both, n = F.col("both"), F.size("gradients")
    kind = F.get("gradients", F.lit(0))["type"]
    alpha = both.rlike(r"(rgba|hsla)\([^)]*,\s*0?\.\d+\s*\)|/\s*0?\.\d+|transparent")
    has_url = both.contains("url(")
    pattern = both.contains("repeating-") | (has_url & prop("decls", "background-repeat").rlike("repeat(?!-)") & prop("decls", "background-size").isNotNull())
    design = first_match(
        (F.lower("selector").rlike(r"video") & both.rlike("video|url"), "video_background"),
        (both.rlike("noise|grain|feturbulence"), "noise_texture"),
        ((F.col("blur") > 0) & alpha, "glassmorphism"),
        (css.mesh_of("gradients"), "mesh_gradient"),
        ((n > 0) & (F.col("layers") >= 2), "multi_layer"),
        ((n > 0) & F.col("animated"), "animated_gradient"),
        (n > 0, F.concat(kind, F.lit("_gradient"))),
        (F.coalesce(pattern, F.lit(False)), "pattern_background"),
        (has_url & both.rlike(r"svg"), "svg_background"),
        (has_url, "image_background"),
        otherwise="solid_color",
    )
    stops = F.aggregate("gradients", F.lit(0), lambda s, g: s + F.size(g["stops"]))
    gpu = prop("decls", "will-change").isNotNull() | prop("decls", "transform").isNotNull() | F.coalesce(prop("decls", "contain").contains("paint"), F.lit(False))
    out = rows.withColumns({"design_type": design, "stops": stops, "gpu": gpu})
    impact = (
        F.when((F.col("blur") > 0) | (F.col("layers") > 3) | (F.col("stops") > 10), "high")
        .when(F.col("design_type").isin("animated_gradient", "video_background") | (F.col("layers") > 1) | (F.col("stops") > 5), "medium")
        .otherwise("low")
    )
    return out.withColumns({"triggers_paint": F.col("design_type") != "solid_color", "impact": impact}).drop("both", "bg", "shade")


def decorations(rules: DataFrame) -> DataFrame:
    """Glow, gradient, animated border and glass effects, one row per effect with a confidence."""
    shadow = F.coalesce(prop("decls", "box-shadow"), F.lit("none"))
    rows = rules.withColumns(
        {
            "_shadows": F.when(shadow != "none", css.box_shadows(shadow)),
            "_bg": F.coalesce(prop("decls", "background", "background-image"), F.lit("")),
            "_border": F.coalesce(prop("decls", "border-image", "border-image-source"), F.lit("")),
            "_anim": F.lower(F.coalesce(prop("decls", "animation", "animation-name"), F.lit("none"))),
            "_glass": F.coalesce(prop("decls", "backdrop-filter", "-webkit-backdrop-filter"), F.lit("none")),
            "_round": prop("decls", "border-radius").isNotNull(),
            "_frame": prop("decls", "border").isNotNull(),
        }
    )
    glow_of = lambda s: ~s["inset"] & (s["blur"] > 0) & (F.abs(s["x"]) <= 2) & (F.abs(s["y"]) <= 2)
    glows = F.transform(
        F.filter("_shadows", glow_of),
        lambda s: F.struct(F.lit("glow").alias("type"), (F.lit(0.8) + F.when(s["blur"] >= 10, 0.1).otherwise(0.0) + F.when(s["spread"] > 0, 0.05).otherwise(0.0)).alias("confidence")),
    )
    rows = rows.withColumn("_grads", css.gradients("_bg"))
    grads = F.col("_grads")
    first = F.get(grads, F.lit(0))
    gradient = F.when(
        F.size(grads) > 0,
        F.struct(F.lit("gradient").alias("type"), (F.lit(0.8) + F.when(F.size(first["stops"]) >= 2, 0.1).otherwise(0.0) + F.when(first["angle"].isNotNull(), 0.05).otherwise(0.0)).alias("confidence")),
    )
    image = F.col("_border").contains("gradient")
    moving = (F.col("_anim") != "none") & (F.lower("selector").contains("border") | any_of(F.col("_anim"), ["border", "glow", "pulse", "ring"]) | image)
    glowing = F.col("_round") & F.coalesce(F.exists("_shadows", lambda s: (s["blur"] > 0) & (F.abs(s["x"]) <= 2) & (F.abs(s["y"]) <= 2)), F.lit(False))
    points = F.lit(0.5) + F.when(image, 0.3).otherwise(0.0) + F.when(moving, 0.2).otherwise(0.0) + F.when(glowing, 0.2).otherwise(0.0)
    border = F.when(image | moving | glowing, F.struct(F.lit("animated-border").alias("type"), F.least(F.lit(1.0), points).alias("confidence")))
    blur = num(F.regexp_extract("_glass", r"blur\(\s*(\d*\.?\d+)", 1))
    opacity = num(F.regexp_extract("_bg", r"rgba\(\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*(\d*\.?\d+)", 1))
    glass = F.when(
        F.col("_glass").rlike("blur|saturate|brightness"),
        F.struct(
            F.lit("glass-morphism").alias("type"),
            F.least(F.lit(1.0), F.lit(0.7) + F.when(blur >= 5, 0.15).otherwise(0.0) + F.when((opacity > 0) & (opacity < 0.5), 0.1).otherwise(0.0) + F.when(F.col("_frame"), 0.05).otherwise(0.0)).alias("confidence"),
        ),
    )
    all_ = F.concat(F.coalesce(glows, F.array().cast("array<struct<type:string,confidence:double>>")), F.array_compact(F.array(gradient, border, glass)))
    keep = [c for c in rules.columns if c != "decls"]
    return rows.select(*keep, F.explode(all_).alias("e")).select(*keep, "e.*")


def typography(rules: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Font families, sizes of body and h1..h6, and the type scale fitted to the heading sizes, per page."""
    sized = rules.select(
        page_id, "rule_no", F.lower("selector").alias("selector"), css.size_rem(prop("decls", "font-size")).alias("size"),
        css.font_family(prop("decls", "font-family"))["primary"].alias("family"), css.weight_number(prop("decls", "font-weight")).alias("_w"),
        prop("decls", "font-weight").isNotNull().alias("_hw"),
    )
    tags = ["h1", "h2", "h3", "h4", "h5", "h6"]
    one = lambda tag: F.max_by("size", F.when((F.col("selector") == tag) & F.col("size").isNotNull(), F.col("rule_no"))).alias(tag)
    agg = sized.groupBy(page_id).agg(
        F.array_sort(F.collect_set("family")).alias("families"),
        F.count_distinct("size").alias("sizes"),
        F.count_distinct(F.when(F.col("_hw"), F.col("_w"))).alias("weights"),
        one("body"), *[one(x) for x in tags],
    )
    ladder = F.reverse(F.array_sort(F.array_distinct(F.array_compact(F.array(*tags, "body")))))
    steps = F.zip_with(F.slice(ladder, 1, F.greatest(F.size(ladder) - 1, F.lit(0))), F.slice(ladder, F.lit(2), F.greatest(F.size(ladder), F.lit(1))), lambda a, b: a / b)
    mean = F.when(F.size(ladder) >= 2, F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / (F.size(ladder) - 1))
    out = agg.withColumn("mean_ratio", mean)
    return out.withColumn("scale", F.when(F.col("mean_ratio").isNotNull(), css.type_scale("mean_ratio")))


def layout_structure(rules: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Grid system, spacing rhythm (most frequent gap, base unit) and graphics facts per page."""
    facts = rules.select(
        page_id, prop("decls", "display").alias("display"), prop("decls", "grid-template-columns").alias("cols"),
        css.size_rem(prop("decls", "gap", "margin", "padding", "margin-bottom", "padding-top")).alias("_gap"), F.lower("selector").alias("selector"),
    ).withColumn("gap", F.col("_gap") * 16)
    repeat = F.regexp_extract("cols", r"repeat\(\s*(\d+)", 1).try_cast("int")
    out = facts.groupBy(page_id).agg(
        F.bool_or(F.col("display").contains("grid")).alias("_grid"), F.bool_or(F.col("display").contains("flex")).alias("_flex"),
        F.max(F.coalesce(repeat, F.size(css.split_words("cols")))).alias("columns"),
        F.mode("gap", True).alias("usual_gap"), F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("_least"),
        F.avg(F.when(F.col("gap") > 0, (F.pmod("gap", F.lit(8.0)) == 0).cast("double"))).alias("_by8"),
        F.avg(F.when(F.col("gap") > 0, (F.pmod("gap", F.lit(4.0)) == 0).cast("double"))).alias("_by4"),
    )
    base = F.when(F.col("_by8") >= 0.5, 8.0).when(F.col("_by4") >= 0.5, 4.0).otherwise(F.col("_least"))
    return out.select(
        page_id, F.when(F.col("_grid"), "css-grid").when(F.col("_flex"), "flexbox").otherwise("none").alias("grid_system"),
        F.when(F.col("columns") > 0, F.col("columns")).alias("columns"), "usual_gap", base.alias("base_unit"),
    )


def reduced_motion(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("respects_reduced_motion", F.col(html).rlike("prefers-reduced-motion"))
