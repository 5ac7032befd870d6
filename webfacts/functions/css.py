"""CSS value columns: durations, shorthands, timing functions, gradients, shadows, fonts, variables.

Splitting respects one level of parentheses; deeper nesting inside a list is a documented limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from webfacts.functions.base import ColumnOrName, any_of, col, first_match, let, lookup, num

# Fixed values of the CSS specifications.
TIMING_POINTS = {
    "linear": [0.0, 0.0, 1.0, 1.0],
    "ease": [0.25, 0.1, 0.25, 1.0],
    "ease-in": [0.42, 0.0, 1.0, 1.0],
    "ease-out": [0.0, 0.0, 0.58, 1.0],
    "ease-in-out": [0.42, 0.0, 0.58, 1.0],
}
DIRECTIONS = ["normal", "reverse", "alternate", "alternate-reverse"]
FILL_MODES = ["none", "forwards", "backwards", "both"]
PLAY_STATES = ["running", "paused"]
COLOR_NAMES = ["black", "white", "red", "green", "blue", "yellow", "orange", "purple", "pink", "gray", "grey", "brown", "cyan", "magenta", "navy", "teal", "lime", "maroon", "olive", "silver", "aqua", "fuchsia", "gold", "indigo", "violet", "coral", "salmon", "tomato", "crimson", "turquoise", "lavender", "beige", "ivory", "khaki"]
GRADIENT_SIDES = {
    "to top": 0.0, "to right": 90.0, "to bottom": 180.0, "to left": 270.0,
    "to top right": 45.0, "to right top": 45.0, "to bottom right": 135.0, "to right bottom": 135.0,
    "to bottom left": 225.0, "to left bottom": 225.0, "to top left": 315.0, "to left top": 315.0,
}
# Named type scales and their ratios.
TYPE_SCALES = {
    "Minor Second": 1.067, "Major Second": 1.125, "Minor Third": 1.2, "Major Third": 1.25,
    "Perfect Fourth": 1.333, "Augmented Fourth": 1.414, "Perfect Fifth": 1.5, "Golden Ratio": 1.618,
}
# Variable-name fragments per category, first category wins.
VARIABLE_CATEGORIES = {
    "color": ["color", "bg", "background", "text-", "border-color", "fill", "stroke"],
    "typography": ["font", "text", "line-height", "letter", "leading", "tracking"],
    "spacing": ["spacing", "gap", "padding", "margin", "space", "size"],
    "border": ["border", "radius", "rounded"],
    "shadow": ["shadow", "elevation"],
    "layout": ["z-index", "zindex", "layer", "width", "height", "max-", "min-"],
    "animation": ["transition", "animation", "duration", "delay", "ease", "timing"],
}

_TIME = r"^[+]?(\d*\.?\d+)(ms|s)$"


def duration_ms(c: ColumnOrName) -> Column:
    """``250ms`` -> 250, ``1.5s`` -> 1500, anything else 0."""
    v = F.lower(F.trim(col(c)))
    n = F.coalesce(num(F.regexp_extract(v, r"^(-?\d*\.?\d+)(?:ms|s)$", 1)), F.lit(0.0))
    return F.when(v.endswith("ms"), n).when(v.endswith("s"), n * 1000).otherwise(0.0)


def split_list(c: ColumnOrName) -> Column:
    """Split at top-level commas, parts trimmed, empty parts dropped."""
    parts = F.transform(F.split(col(c), r",(?![^()]*\))"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def split_words(c: ColumnOrName) -> Column:
    """Split at white space outside parentheses."""
    return F.filter(F.split(F.trim(col(c)), r"\s+(?![^()]*\))"), lambda w: w != "")


def strip_prefix(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), "^-(webkit|moz|ms|o)-", "")


def _is_timing(w: Column) -> Column:
    return w.isin([*TIMING_POINTS, "step-start", "step-end"]) | w.rlike(r"^(cubic-bezier|steps)\(")


def _is_count(w: Column) -> Column:
    return (w == "infinite") | w.rlike(r"^\d*\.?\d+$")


def _pick(words: Column, test, default: str | None) -> Column:
    return F.coalesce(F.get(F.filter(words, test), F.lit(0)), F.lit(default))


def animation_shorthand(c: ColumnOrName) -> Column:
    """First animation of a shorthand as struct(name, duration, easing, delay, iterations, direction, fill_mode, play_state)."""
    taken = [*DIRECTIONS, *FILL_MODES, *PLAY_STATES]

    def parse(words: Column) -> Column:
        times = F.filter(words, lambda w: w.rlike(_TIME))
        known = lambda w: w.rlike(_TIME) | _is_count(w) | _is_timing(w) | w.isin(taken)
        return F.struct(
            _pick(words, lambda w: ~known(w), "none").alias("name"),
            duration_ms(F.coalesce(F.get(times, F.lit(0)), F.lit("0s"))).alias("duration"),
            _pick(words, _is_timing, "ease").alias("easing"),
            duration_ms(F.coalesce(F.get(times, F.lit(1)), F.lit("0s"))).alias("delay"),
            _pick(words, _is_count, "1").alias("iterations"),
            _pick(words, lambda w: w.isin(DIRECTIONS), "normal").alias("direction"),
            _pick(words, lambda w: w.isin(FILL_MODES), "none").alias("fill_mode"),
            _pick(words, lambda w: w.isin(PLAY_STATES), "running").alias("play_state"),
        )

    return let(split_words(F.coalesce(F.get(split_list(c), F.lit(0)), F.lit(""))), parse)


def transition_shorthand(c: ColumnOrName) -> Column:
    """``array<struct<property, duration, easing, delay>>``."""

    def parse(words: Column) -> Column:
        times = F.filter(words, lambda w: w.rlike(_TIME))
        return F.struct(
            _pick(words, lambda w: ~(w.rlike(_TIME) | _is_timing(w)), "all").alias("property"),
            duration_ms(F.coalesce(F.get(times, F.lit(0)), F.lit("0s"))).alias("duration"),
            _pick(words, _is_timing, "ease").alias("easing"),
            duration_ms(F.coalesce(F.get(times, F.lit(1)), F.lit("0s"))).alias("delay"),
        )

    return F.transform(F.transform(split_list(c), split_words), parse)


def control_points(c: ColumnOrName) -> Column:
    """Four cubic control points of a keyword or ``cubic-bezier(...)``, null otherwise."""
    v = F.lower(F.trim(col(c)))
    inner = F.regexp_extract(v, r"^cubic-bezier\(([^)]*)\)$", 1)
    points = F.transform(F.split(inner, ","), lambda p: num(F.trim(p)))
    out = F.lit(None).cast("array<double>")
    for name, p in TIMING_POINTS.items():
        out = F.when(v == name, F.array(*[F.lit(x) for x in p])).otherwise(out)
    usable = (F.size(points) == 4) & ~F.exists(points, lambda p: p.isNull())
    return F.when(v.startswith("cubic-bezier(") & usable, points).otherwise(out)


def timing_function(c: ColumnOrName) -> Column:
    """struct(kind, points, steps, jump)."""
    v = F.lower(F.trim(col(c)))
    steps = F.regexp_extract(v, r"^steps\(\s*(\d+)", 1).try_cast("int")
    jump = F.nullif(F.regexp_extract(v, r"^steps\(\s*\d+\s*,\s*([a-z-]+)", 1), F.lit(""))
    is_steps = v.startswith("steps(") | v.isin("step-start", "step-end")
    return F.struct(
        first_match((is_steps, "steps"), (v.startswith("cubic-bezier("), "cubic-bezier"), otherwise="keyword").alias("kind"),
        control_points(c).alias("points"),
        F.when(v.isin("step-start", "step-end"), 1).when(is_steps, F.coalesce(steps, F.lit(1))).alias("steps"),
        F.when(v == "step-start", "start").when(v == "step-end", "end").when(is_steps, F.coalesce(jump, F.lit("end"))).alias("jump"),
    )


def keyframe_offsets(c: ColumnOrName) -> Column:
    """``from, 50%, to`` -> ``[0.0, 0.5, 1.0]``; other selectors dropped."""

    def one(p: Column) -> Column:
        pct = num(F.regexp_extract(p, r"^(\d*\.?\d+)%$", 1)) / 100
        return F.when(p == "from", 0.0).when(p == "to", 1.0).otherwise(pct)

    return F.filter(F.transform(F.split(F.lower(col(c)), ","), lambda p: one(F.trim(p))), lambda x: x.isNotNull())


def color_literals(c: ColumnOrName) -> Column:
    """Colour literals: hex, rgb(a), hsl(a), oklch, then names."""
    v = col(c)
    find = lambda p: F.regexp_extract_all(v, F.lit(p), F.lit(0))
    words = F.transform(F.split(v, r"[\s,()]+"), lambda w: F.regexp_replace(F.lower(w), ";$", ""))
    named = F.filter(words, lambda w: w.isin(COLOR_NAMES))
    return F.concat(
        F.transform(find(r"#[0-9a-fA-F]{3,8}\b"), lambda h: F.lower(h)), find(r"rgba?\([^)]+\)"), find(r"hsla?\([^)]+\)"), find(r"oklch\([^)]+\)"), named
    )


def rgb_literal_hex(c: ColumnOrName) -> Column:
    """``#abc``, ``#aabbcc`` or ``rgb(r, g, b)`` as six hex digits, null for anything else."""
    from webfacts.functions.color import clean_hex

    v = F.lower(F.trim(col(c)))
    part = lambda i: F.regexp_extract(v, r"^rgba?\(\s*(\d+)[\s,]+(\d+)[\s,]+(\d+)", i).try_cast("int")
    from_rgb = F.lower(F.format_string("%02x%02x%02x", part(1), part(2), part(3)))
    return F.when(v.startswith("#"), clean_hex(v)).when(part(1).isNotNull(), from_rgb)


def size_rem(c: ColumnOrName) -> Column:
    """rem as is, px / 16, null otherwise."""
    rem = num(F.regexp_extract(col(c), r"(\d*\.?\d+)\s*rem", 1))
    return F.coalesce(rem, num(F.regexp_extract(col(c), r"(\d*\.?\d+)\s*px", 1)) / 16)


def size_px(c: ColumnOrName) -> Column:
    """px of a font size; ``clamp`` uses its preferred value, 16 when nothing can be read."""
    raw = F.lower(F.trim(col(c)))
    v = F.when(raw.startswith("clamp("), F.trim(F.get(F.split(F.substring(raw, F.lit(7), F.length(raw)), ","), F.lit(1)))).otherwise(raw)
    n = num(F.regexp_extract(v, r"(\d*\.?\d+)(px|rem|em|vw|vh|%)?", 1))
    unit = F.regexp_extract(v, r"(\d*\.?\d+)(px|rem|em|vw|vh|%)?", 2)
    factor = F.when(unit.isin("rem", "em"), 16.0).when(unit.isin("vw", "vh"), 10.0).when(unit == "%", 0.16).otherwise(1.0)
    return F.coalesce(n * factor, F.lit(16.0))


def weight_number(c: ColumnOrName) -> Column:
    v = F.lower(F.trim(col(c)))
    named = lookup({"normal": 400, "bold": 700, "bolder": 800, "lighter": 300}, v)
    return F.coalesce(named, F.regexp_extract(v, r"^(\d+)", 1).try_cast("int"), F.lit(400))


def font_family(c: ColumnOrName) -> Column:
    """struct(primary, fallbacks, category); the last family decides the category."""
    fonts = F.transform(F.split(col(c), ","), lambda f: F.regexp_replace(F.trim(f), r"""^['"]|['"]$""", ""))
    last = F.lower(F.element_at(fonts, -1))
    kind = first_match(
        (last == "serif", "serif"),
        (last == "monospace", "monospace"),
        (last == "cursive", "cursive"),
        (last.isin("fantasy", "display"), "display"),
        ((last == "system-ui") | (F.lower(fonts[0]) == "system-ui"), "system"),
        otherwise="sans-serif",
    )
    return F.struct(fonts[0].alias("primary"), F.slice(fonts, F.lit(2), F.size(fonts)).alias("fallbacks"), kind.alias("category"))


def variable_category(c: ColumnOrName) -> Column:
    n = F.lower(col(c))
    cases = []
    for name, words in VARIABLE_CATEGORIES.items():
        cond = any_of(n, words)
        if name == "spacing":
            cond = any_of(n, words[:-1]) | (n.contains("size") & ~n.contains("font-size"))
        cases.append((cond, name))
    return first_match(*cases, otherwise="other")


_GRADIENT = r"(repeating-)?(linear|radial|conic)-gradient\(((?:[^()]|\([^()]*\))*)\)"


def gradients(c: ColumnOrName) -> Column:
    """``array<struct<type, repeating, angle, args, stops array<struct<color, position>>>>``."""
    whole = F.regexp_extract_all(col(c), F.lit(_GRADIENT), F.lit(0))
    side = r"^(-?\d+(?:\.\d+)?)(deg|grad|rad|turn)$"

    def parse(g: Column) -> Column:
        args = F.regexp_extract(g, _GRADIENT, 3)
        return let(F.struct(args.alias("args"), split_list(args).alias("parts")), lambda x: directed(g, x["args"], x["parts"]))

    def directed(g: Column, args: Column, parts: Column) -> Column:
        first = F.lower(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
        given = first.rlike(r"^(-?\d+(\.\d+)?)(deg|grad|rad|turn)$|^(to|from) |^(circle|ellipse)(\s|$)| at ")
        rest = F.when(given, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
        return let(F.struct(first.alias("first"), rest.alias("rest")), lambda y: built(g, args, y["first"], y["rest"]))

    def built(g: Column, args: Column, first: Column, stops: Column) -> Column:
        n = F.size(stops)

        def stop(p: Column, i: Column) -> Column:
            pct = num(F.regexp_extract(p, r"(\d+(?:\.\d+)?)%\s*$", 1)) / 100
            spread = F.when(i == 0, 0.0).otherwise(i / F.greatest(n - 1, F.lit(1)))
            return F.struct(
                F.trim(F.regexp_replace(p, r"\s+\d+(\.\d+)?%\s*$", "")).alias("color"), F.coalesce(pct, spread).alias("position")
            )

        value = num(F.regexp_extract(first, side, 1))
        unit = F.regexp_extract(first, side, 2)
        turned = value * F.when(unit == "grad", 0.9).when(unit == "rad", 180 / math.pi).when(unit == "turn", 360.0).otherwise(1.0)
        kind = F.regexp_extract(g, _GRADIENT, 2)
        return F.struct(
            kind.alias("type"),
            g.startswith("repeating-").alias("repeating"),
            F.when(kind == "linear", F.coalesce(turned, lookup(GRADIENT_SIDES, first))).alias("angle"),
            args.alias("args"),
            F.transform(stops, stop).alias("stops"),
        )

    return F.transform(whole, parse)


def mesh_of(found: ColumnOrName) -> Column:
    """:func:`is_mesh` on the result of :func:`gradients`."""
    radial = F.filter(col(found), lambda g: g["type"] == "radial")
    faded = F.filter(radial, lambda g: F.lower(g["args"]).contains("transparent"))
    return (F.size(radial) >= 3) & (F.size(faded) >= 2)


def is_mesh(c: ColumnOrName) -> Column:
    """At least three radial gradients, two of them fading to transparent."""
    return mesh_of(gradients(c))


_COLOR = r"#[0-9a-fA-F]{3,8}\b|rgba?\([^)]*\)|hsla?\([^)]*\)|\b[a-z]{3,}\b"


def box_shadows(c: ColumnOrName) -> Column:
    """``array<struct<x, y, blur, spread, color, inset>>`` of a ``box-shadow`` value."""

    def parse(p: Column) -> Column:
        inset = F.lower(p).startswith("inset")
        body = F.regexp_replace(p, "(?i)^inset", "")
        tint = F.regexp_extract(body, rf"(?i)({_COLOR})", 1)
        lengths = F.transform(
            F.regexp_extract_all(F.regexp_replace(body, rf"(?i){_COLOR}", " "), F.lit(r"-?\d*\.?\d+"), F.lit(0)), lambda x: x.cast("double")
        )
        part = lambda i: F.coalesce(F.get(lengths, F.lit(i)), F.lit(0.0))
        return F.when(
            F.size(lengths) >= 2,
            F.struct(
                part(0).alias("x"), part(1).alias("y"), part(2).alias("blur"), part(3).alias("spread"),
                F.when(tint == "", "currentColor").otherwise(tint).alias("color"), inset.alias("inset"),
            ),
        )

    # lengths keep their unit glued on, so units are taken away first
    bare = F.regexp_replace(col(c), r"(?i)(\d)(px|rem|em)\b", "$1")
    return F.filter(F.transform(split_list(bare), parse), lambda s: s.isNotNull())


def type_scale(ratio: ColumnOrName) -> Column:
    """struct(name, ratio): nearest named scale closer than 0.05, else Custom."""
    r = col(ratio)
    options = F.array(*[F.struct(F.abs(r - v).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(v).alias("ratio")) for i, (n, v) in enumerate(TYPE_SCALES.items())])
    best = F.array_min(options)
    return F.when(best["d"] < 0.05, F.struct(best["name"].alias("name"), best["ratio"].alias("ratio"))).otherwise(
        F.struct(F.lit("Custom").alias("name"), r.alias("ratio"))
    )
