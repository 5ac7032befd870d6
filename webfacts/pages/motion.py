"""Motion patterns of pages: detection, warnings, complexity, category, performance, feature vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.functions import css
from webfacts.functions.base import any_of, flag, let, lookup, num
from webfacts.functions.vector import l2_normalize
from webfacts.pages.styles import keyframes_of, prop, rules_of
from webfacts.session import spread
from webfacts.rules.patterns import MOTION_CATEGORIES

# Property groups.
LAYOUT_PROPERTIES = ["width", "height", "top", "left", "right", "bottom", "margin", "padding", "border-width", "font-size", "line-height"]
PAINT_PROPERTIES = ["color", "background-color", "background-image", "box-shadow", "text-shadow", "border-radius", "outline"]
GPU_PROPERTIES = ["transform", "opacity", "filter"]
# Order of the enumerations inside the feature vector.
MOTION_TYPES = ["animation", "transition", "transform", "scroll", "hover", "keyframe"]
TRIGGERS = ["load", "hover", "scroll", "click", "focus", "custom"]


def motions(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Animations (properties from the page's keyframes) and transitions, one row per rule and kind."""
    starts = ["animation", "animation-name", "transition", "transition-duration"]  # a rule with none of them moves nothing
    moves = lambda r: F.exists(r["r"]["decls"], lambda d: d["property"].isin(starts))
    numbered = F.transform(rules_of(html, ["animation", "transition"]), lambda r, i: F.struct(i.alias("rule_no"), r.alias("r")))
    named = lambda r, f: F.exists(r["r"]["decls"], lambda d: d["value"].contains(f["name"]))
    # Keyframes go along with the rules that name them: a join would bring all pages together, or to the driver where the input is a small
    # file. The exploded array is no column of its own, or a filter on its size would parse the pages once more, before they are spread.
    kept = let(keyframes_of(html), lambda frames: F.transform(F.filter(numbered, moves), lambda r: F.struct(r.alias("n"), F.filter(frames, lambda f: named(r, f)).alias("frames"))))
    rules = spread(pages.select(page_id, html), page_id).select(page_id, F.explode(kept).alias("_k")).select(
        page_id, F.col("_k.frames").alias("_frames"), F.col("_k.n.rule_no").alias("rule_no"), F.col("_k.n.r.selector").alias("selector"), F.col("_k.n.r.decls").alias("decls")
    )
    rules = rules.withColumns({"_short": prop("decls", "animation"), "_trans": css.transition_shorthand(F.coalesce(prop("decls", "transition"), F.lit("")))})
    rules = rules.withColumn("_a", css.animation_shorthand(F.coalesce("_short", F.lit(""))))
    rows = rules.withColumn("_name", F.coalesce(prop("decls", "animation-name"), F.when(F.col("_short").isNotNull(), F.col("_a.name"))))
    or_own = lambda own, field: F.coalesce(own, F.col(f"_a.{field}"))
    timed = lambda name: css.duration_ms(prop("decls", name))
    timeline = F.coalesce(prop("decls", "animation-timeline"), F.lit(""))
    has = lambda name: prop("decls", name).isNotNull()
    named = F.col("_name").isNotNull() & (F.col("_name") != "none")
    anim = F.when(
        named,
        F.struct(
            F.lit("animation").alias("type"),
            F.col("_name").alias("name"),
            F.when(has("animation-duration"), timed("animation-duration")).otherwise(F.col("_a.duration")).alias("duration"),
            F.when(has("animation-delay"), timed("animation-delay")).otherwise(F.col("_a.delay")).alias("delay"),
            or_own(prop("decls", "animation-timing-function"), "easing").alias("easing"),
            or_own(prop("decls", "animation-iteration-count"), "iterations").alias("iterations"),
            or_own(prop("decls", "animation-direction"), "direction").alias("direction"),
            or_own(prop("decls", "animation-fill-mode"), "fill_mode").alias("fill_mode"),
            or_own(prop("decls", "animation-play-state"), "play_state").alias("play_state"),
            F.when(timeline.rlike("scroll|view"), "scroll").otherwise("load").alias("trigger"),
            F.lit(0.9).alias("confidence"),
            F.lit(None).cast("array<string>").alias("moved"),
        ),
    )
    trans = F.col("_trans")
    first = F.get(trans, F.lit(0))
    listed = css.split_list(F.coalesce(prop("decls", "transition-property"), F.lit("")))
    names = F.when(F.size(listed) > 0, listed).when(F.size(trans) > 0, F.transform(trans, lambda t: t["property"])).otherwise(F.array(F.lit("all")))
    length = F.when(has("transition-duration"), timed("transition-duration")).otherwise(first["duration"])
    transition = F.when(
        F.col("_length") > 0,
        F.struct(
            F.lit("transition").alias("type"),
            F.concat(F.lit("transition-"), F.col("_names")[0]).alias("name"),
            F.col("_length").alias("duration"),
            F.when(has("transition-delay"), timed("transition-delay")).otherwise(F.coalesce(F.col("_first.delay"), F.lit(0.0))).alias("delay"),
            F.coalesce(prop("decls", "transition-timing-function"), F.col("_first.easing"), F.lit("ease")).alias("easing"),
            F.lit("1").alias("iterations"), F.lit("normal").alias("direction"), F.lit("none").alias("fill_mode"), F.lit("running").alias("play_state"),
            F.when(F.col("selector").contains(":focus"), "focus").otherwise("hover").alias("trigger"),
            F.lit(0.85).alias("confidence"),
            F.col("_names").alias("moved"),
        ),
    )
    rows = rows.withColumns({"_names": names, "_length": length, "_first": first})
    found = rows.select(page_id, "_frames", "rule_no", "selector", F.explode(F.array_compact(F.array(anim, transition))).alias("m"))
    no_steps = F.array().cast("array<struct<offset:double,value:string>>")
    own = F.transform("m.moved", lambda n: F.struct(n.alias("name"), F.lit(0).alias("keyframes"), no_steps.alias("steps")))
    properties = F.coalesce(own, _moved_by(F.col("m.name")))
    fields = [f"m.{c}" for c in found.schema["m"].dataType.names if c not in ("name", "moved")]
    return found.select(page_id, "m.name", "rule_no", "selector", *fields, properties.alias("properties"))


def _moved_by(name: Column) -> Column:
    """Properties that the keyframes of a name move, sorted, each with its steps in order; none where there are no such keyframes."""
    same = F.flatten(F.transform(F.filter("_frames", lambda f: f["name"] == name), lambda f: f["steps"]))

    def grouped(steps: Column) -> Column:
        first = lambda s, i: F.when((i == 0) | (s["property"] != F.get(steps, i - 1)["property"]), i + 1)
        return let(F.array_compact(F.transform(steps, first)), lambda at: F.transform(at, lambda s, j: moved(steps, s, F.coalesce(F.get(at, j + 1), F.size(steps) + 1))))

    def moved(steps: Column, at: Column, end: Column) -> Column:
        part = F.transform(F.slice(steps, at, end - at), lambda s: F.struct(s["offset"].alias("offset"), s["value"].alias("value")))
        return F.struct(F.get(steps, at - 1)["property"].alias("name"), (end - at).alias("keyframes"), part.alias("steps"))

    return let(F.sort_array(same), grouped)


def _names() -> Column:
    return F.transform("properties", lambda p: F.lower(p["name"]))


def warnings(rows: DataFrame) -> DataFrame:
    """One row per warning: long, layout, shadow, rapid."""
    tests = {
        ("long", "medium"): F.col("duration") > 5000,
        ("layout", "high"): F.exists(_names(), lambda n: any_of(n, LAYOUT_PROPERTIES)),
        ("shadow", "medium"): F.arrays_overlap(_names(), F.array(F.lit("box-shadow"), F.lit("text-shadow"))),
        ("rapid", "high"): (F.col("duration") < 300) & (F.col("iterations") == "infinite"),
    }
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("warning"), F.lit(s).alias("severity"))) for (k, s), c in tests.items()]))
    keep = [c for c in rows.columns if c != "properties"]
    return rows.select(*keep, F.explode(found).alias("w")).select(*keep, "w.*")


def complexity(rows: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Motion complexity 0..100 per page."""
    n_props = F.size("properties")
    extra = F.aggregate("properties", F.lit(0), lambda s, p: s + F.greatest(p["keyframes"] - 2, F.lit(0)) * 2)
    own = (
        n_props * 3 + extra + flag(F.col("iterations") == "infinite") * 12 + flag(F.col("duration") > 2000) * 7 + flag(F.col("delay") > 0) * 5
        + flag(F.col("easing").contains("cubic-bezier")) * 3 + flag(F.col("direction").isin("alternate", "alternate-reverse")) * 3
    )
    total = F.least(F.count(F.lit(1)) * 7, F.lit(35)) + F.sum(own)
    return rows.groupBy(page_id).agg(F.least(total, F.lit(100)).alias("complexity"))


def motion_category(rows: DataFrame, rules: list = MOTION_CATEGORIES) -> DataFrame:
    """First matching category of the rule table, else ``unknown``."""
    name, selector, forever = F.lower("name"), F.lower("selector"), F.col("iterations") == "infinite"

    def holds(alt: dict) -> Column:
        out = F.lit(True)
        for field, text in (("name", name), ("name_too", name), ("selector", selector)):
            if field in alt:
                out = out & text.rlike("|".join(alt[field]))
        if "props" in alt:
            out = out & F.arrays_overlap("_props", F.array(*[F.lit(p) for p in alt["props"]]))
        if "props_like" in alt:
            out = out & F.exists("_props", lambda p: any_of(p, alt["props_like"]))
        for p in alt.get("all_props", []):
            out = out & F.array_contains("_props", p)
        if "forever" in alt:
            out = out & (forever if alt["forever"] else ~forever)
        return out

    cases = None
    for category, alternatives in rules:
        cond = F.lit(False)
        for alt in alternatives:
            cond = cond | holds(alt)
        cases = F.when(cond, category) if cases is None else cases.when(cond, category)
    return rows.withColumn("_props", _names()).withColumn("category", cases.otherwise("unknown")).drop("_props")


def performance(rows: DataFrame) -> DataFrame:
    """Level good / acceptable / poor with its points."""
    names = _names()
    layout = F.arrays_overlap(names, F.array(*[F.lit(p) for p in LAYOUT_PROPERTIES]))
    paint = F.arrays_overlap(names, F.array(*[F.lit(p) for p in PAINT_PROPERTIES]))
    cheap = F.exists(names, lambda n: (n == "opacity") | (n == "transform") | n.rlike("^(translate|rotate|scale)"))
    level = F.when(layout, "poor").when(paint & ~cheap, "acceptable").when(cheap, "good").otherwise("acceptable")
    return rows.withColumn("level", level).withColumn("points", lookup({"good": 100, "acceptable": 60, "poor": 20}, F.col("level")))


def motion_vector(rows: DataFrame, name: str = "vector") -> DataFrame:
    """64 features (16 each: properties, timing, easing, keyframes), scaled to unit length."""
    rows = rows.withColumns({"_low": _names(), "_pts": css.control_points("easing")})
    names = F.col("_low")
    n = F.size("properties")
    some = n > 0
    share = lambda words: F.when(some, F.size(F.filter(names, lambda x: any_of(x, words))) / n).otherwise(0.0)
    named = lambda test: flag(F.exists(names, test)).cast("double")
    place = lambda values, c: (F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)) - 1) / (len(values) - 1)
    when_some = lambda c: F.when(some, c).otherwise(0.0)
    with_steps = F.size(F.filter("properties", lambda p: p["keyframes"] > 0))
    property_part = [
        F.least(n / 10, F.lit(1.0)), share(GPU_PROPERTIES), share(LAYOUT_PROPERTIES), share(PAINT_PROPERTIES),
        named(lambda x: x == "opacity"), named(lambda x: x == "transform"), named(lambda x: x == "filter"), named(lambda x: x.contains("color")),
        named(lambda x: x.contains("shadow")), named(lambda x: any_of(x, ["width", "height"])), named(lambda x: any_of(x, ["margin", "padding"])), named(lambda x: x.contains("border")),
        when_some(with_steps / n), F.lit(0.0), when_some(place(MOTION_TYPES, "type")), when_some(place(TRIGGERS, "trigger")),
    ]
    dur, delay = F.col("duration"), F.col("delay")
    forever = F.col("iterations") == "infinite"
    times = F.coalesce(num(F.col("iterations")), F.lit(1.0))
    total = dur + delay
    bit = lambda c: flag(c).cast("double")
    timing_part = [
        F.least(F.log10(dur + 1) / 4, F.lit(1.0)), F.least(F.log10(delay + 1) / 4, F.lit(1.0)),
        F.when(dur == 0, 0.0).when(dur < 300, 0.25).when(dur < 1000, 0.5).when(dur < 3000, 0.75).otherwise(1.0),
        F.when(forever, 1.0).otherwise(F.least(times / 10, F.lit(1.0))), bit(forever), place(css.DIRECTIONS, "direction"), place(css.FILL_MODES, "fill_mode"),
        bit(F.col("play_state") == "running"), place(TRIGGERS, "trigger"), F.col("confidence"), F.when(total > 0, dur / total).otherwise(1.0),
        bit(forever | (times > 1)), bit(delay > 0), bit(F.col("direction").startswith("alternate")), bit(F.col("fill_mode") != "none"),
        F.when(dur < 300, 0.0).when(dur < 1000, 0.5).otherwise(1.0),
    ]
    ease = F.lower(F.trim("easing"))
    pts = F.col("_pts")
    point = lambda i: F.coalesce(pts[i], F.lit(0.0))
    is_steps = ease.startswith("steps")
    step_n = F.regexp_extract(ease, r"steps\s*\(\s*(\d+)", 1).try_cast("double")
    easing_part = [
        *[point(i) for i in range(4)], *[bit(ease == k) for k in css.TIMING_POINTS], bit(ease.startswith("cubic-bezier") & pts.isNotNull()),
        bit(is_steps & step_n.isNotNull()), F.when(is_steps, F.least(F.coalesce(step_n, F.lit(0.0)) / 20, F.lit(1.0))).otherwise(0.0),
        F.when(~is_steps, 0.0).when(ease.contains("start"), 0.0).when(ease.contains("end"), 1.0).otherwise(0.5),
        point(1), point(3) - point(2), bit(ease != "linear"),
    ]
    offsets = F.array_sort(F.flatten(F.transform("properties", lambda p: F.transform(p["steps"], lambda s: s["offset"]))))

    def keyframe_part(o: Column) -> Column:
        k = F.size(o)
        size = F.greatest(k, F.lit(1))
        middle = F.size(F.filter(o, lambda x: (x > 0) & (x < 1)))
        mean = F.aggregate(o, F.lit(0.0), lambda s, x: s + x) / size
        spread = let(mean, lambda m: F.aggregate(o, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))) / size
        gaps = F.zip_with(F.filter(o, lambda _, i: i > 0), F.slice(o, F.lit(1), F.greatest(k - 1, F.lit(0))), lambda b, a: b - a)
        g = F.greatest(k - 1, F.lit(1))
        mean_gap = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / g
        gap_var = let(mean_gap, lambda m: F.aggregate(gaps, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))) / g
        near = lambda at: F.exists(o, lambda x: F.abs(x - at) < 0.01)
        halves = (F.size(F.filter(o, lambda x: x < 0.5)) - F.size(F.filter(o, lambda x: x > 0.5))) / size
        parts = [
            F.least(k / 10, F.lit(1.0)), bit(F.array_contains(o, 0.0)), bit(F.array_contains(o, 1.0)), F.least(middle / 8, F.lit(1.0)),
            F.when(k > 1, F.least(spread * 4, F.lit(1.0))).otherwise(0.0), F.when(k > 1, 1 - F.least(gap_var * 10, F.lit(1.0))).otherwise(0.0),
            F.lit(0.2), F.lit(0.0), bit(near(0.5)), bit(near(0.25) | near(0.75)), halves / 2 + 0.5, bit(k > 1), bit(k > 2), bit(k > 5), bit(k == 2), bit(middle > 0),
        ]
        return F.when(k == 0, F.array(*[F.lit(0.0)] * 16)).otherwise(F.array(*[p.cast("double") for p in parts]))

    head = F.array(*[c.cast("double") for c in property_part + timing_part + easing_part])
    raw = rows.withColumn("_raw", F.concat(head, let(offsets, keyframe_part)))
    return raw.withColumn(name, l2_normalize("_raw")).drop("_raw", "_low", "_pts")
