"""Page quality facts: complexity, frameworks, libraries, links, theme, content gaps, responsiveness, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webfacts.functions import html as H
from webfacts.functions.base import any_of, clamp, first_match, flag, mark, round_half_up
from webfacts.functions.color import contrast_ratio, hex_luminance
from webfacts.functions.text import arg_max
from webfacts.functions.url import absolute_url, url_host
from webfacts.operators.joins import nearest_color, viewport_pairs
from webfacts.session import spread
from webfacts.rules.patterns import CANVAS_LIBRARIES, FRAMEWORK_CLASSES, FRAMEWORK_HOSTS

# Marks of canvas use, single-page frameworks and heavy animation frameworks.
_CANVAS_WORDS = ["three.js", "three.min.js", "three.module.js", "babylon.js", "babylon.min.js", "pixi.js", "pixi.min.js", "webgl", "gl-matrix", "regl", "twgl"]
_CANVAS_MARKS = [r"<canvas\b", r"window\.THREE\b", "WebGLRenderingContext"]
_SPA_MARKS = ["__REACT_DEVTOOLS_GLOBAL_HOOK__", "data-reactroot", "data-react-helmet", r"<div\s+id\s*=\s*[\"']root[\"']", "data-v-[a-f0-9]+", "__VUE__", "data-v-app", "v-cloak", "ng-version", "_ng(host|content|if|for)", "<app-root", "svelte-[a-z0-9]+", "__NEXT_DATA__", "_next/static", "__NUXT__", "_nuxt/"]
_HEAVY_WORDS = ["gsap", "greensock", "tweenmax", "tweenlite", "anime.js", "anime.min.js", "animejs", "framer-motion", "lottie", "bodymovin", "scrollmagic", "locomotive-scroll", "scrolltrigger", "motion.div"]
_RESOURCES = ["link", "img", "script", "video", "audio", "iframe"]


def any_mark(low: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | mark(low, p)
    return out


def complexity(pages: DataFrame, html: str = "html", response_ms: str | None = None) -> DataFrame:
    """Script and resource counts, flags, timeout multiplier and 0..100 score."""
    pages = spread(pages).withColumn("_low", F.lower(html))
    low = F.col("_low")
    ms = F.col(response_ms).cast("double") if response_ms else F.lit(0.0)
    resources = sum((F.when(low.contains(f"<{t}"), H.count_matches("_low", rf"<{t}\b[^>]*{'href' if t == 'link' else 'src'}\s*=")).otherwise(F.lit(0)) for t in _RESOURCES), F.lit(0))
    rows = pages.withColumns(
        {
            "scripts": H.count_matches("_low", r"<script\b[^>]*>"),
            "resources": resources,
            "webgl": any_mark(low, _CANVAS_MARKS) | any_of(low, _CANVAS_WORDS),
            "spa": any_mark(low, _SPA_MARKS),
            "heavy": any_of(low, _HEAVY_WORDS),
        }
    )
    s, r = F.col("scripts"), F.col("resources")
    factor = (
        F.lit(1.0) + F.when(ms > 2000, 1.0).when(ms > 500, 0.5).otherwise(0.0) + F.when(s > 30, 1.5).when(s > 15, 0.75).when(s > 5, 0.25).otherwise(0.0)
        + F.when(r > 50, 1.0).when(r > 30, 0.5).otherwise(0.0) + flag(F.col("webgl")) * 2.0 + flag(F.col("heavy")) * 1.5 + flag(F.col("spa")) * 0.5
    )
    points = (
        F.least(s * 0.5, F.lit(25.0)) + F.least(r * 0.2, F.lit(20.0)) + F.least(ms / 200, F.lit(15.0))
        + flag(F.col("webgl")) * 20 + flag(F.col("heavy")) * 15 + flag(F.col("spa")) * 5
    )
    return rows.withColumns({"timeout_factor": factor, "score": F.least(round_half_up(points), F.lit(100))}).drop("_low")


def _matching(names: str, pattern: str) -> Column:
    return F.size(F.filter(names, lambda c: c.rlike(pattern)))


def _labelled(values: Column, kind: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))


def frameworks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Score per style framework, the best one (first wins a tie), its confidence and the evidence."""
    names = list(dict.fromkeys([*FRAMEWORK_CLASSES, *FRAMEWORK_HOSTS]))
    rows = spread(pages, page_id).withColumn("_classes", H.class_names(html))
    scores, proof = {}, []
    for name in names:
        hosts = sum((flag(F.contains(F.col(html), F.lit(h))) for h in FRAMEWORK_HOSTS.get(name, [])), F.lit(0))
        pattern, each, most = FRAMEWORK_CLASSES.get(name, ("a^", 0, 0))
        hits = _matching("_classes", pattern)
        scores[name] = hosts * 50 + F.least(hits * each, F.lit(most))
        proof.append(F.when(hosts > 0, F.concat(F.lit(f"{name}: "), hosts, F.lit(" host marks"))))
        proof.append(F.when(hits > 0, F.concat(F.lit(f"{name}: "), hits, F.lit(" classes"))))
    rows = rows.select(page_id, *[c.alias(f"_s_{n}") for n, c in scores.items()], F.array_compact(F.array(*proof)).alias("evidence"))
    best_name, best = arg_max({n: F.col(f"_s_{n}") for n in names})
    return rows.select(
        page_id,
        F.when(best > 0, best_name).otherwise("unknown").alias("framework"),
        F.least(best / 100, F.lit(1.0)).alias("confidence"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"_s_{n}") for n in names])).alias("scores"),
        "evidence",
    )


def libraries(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page and drawing or animation library found in its markup, with weight and matched marks."""
    pages = spread(pages, page_id).select(page_id, F.col(html).alias("_html"), F.lower(html).alias("_low"))
    found = []
    for name, weight, anycase, owncase in CANVAS_LIBRARIES:
        hits = sum((flag(mark(F.col("_low"), m)) for m in anycase), F.lit(0)) + sum((flag(F.col("_html").rlike(m)) for m in owncase), F.lit(0))
        found.append(F.struct(F.lit(name).alias("library"), F.lit(weight).alias("weight"), hits.alias("marks")))
    rows = pages.select(page_id, F.explode(F.filter(F.array(*found), lambda x: x["marks"] > 0)).alias("l"))
    return rows.select(page_id, "l.*")


def links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", unsafe: str = r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|\[)|\.local$") -> DataFrame:
    """External style sheets, imports and scripts as absolute URLs; private hosts dropped."""
    pages = spread(pages, page_id)
    tags = H.extract_all(html, r"(?is)<link\b[^>]*>", 0)
    sheets = F.transform(F.filter(tags, lambda t: F.lower(t).rlike(r"rel\s*=\s*[\"']?stylesheet")), lambda t: H.attribute(t, "href"))
    imports = H.extract_all(H.style_blocks(html), r"(?i)@import\s+(?:url\(\s*)?[\"']?([^\"')\s;]+)")
    scripts = F.transform(H.extract_all(html, r"(?is)<script\b[^>]*\ssrc\s*=[^>]*>", 0), lambda t: H.attribute(t, "src"))
    kinds = {"stylesheet": sheets, "import": imports, "script": scripts}
    all_ = F.concat(*[_labelled(v, k) for k, v in kinds.items()])
    rows = pages.select(page_id, url, F.explode(all_).alias("l")).select(page_id, F.col("l.kind").alias("kind"), absolute_url("l.raw", url).alias("target"))
    return rows.filter(F.col("target").isNotNull() & ~F.coalesce(url_host("target").rlike(unsafe), F.lit(True)))


def content_gaps(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Counts of visual content, the gaps with severity, and a 0..100 score."""
    pages = spread(pages.select(page_id, html), page_id).withColumn("_body", H.drop_unseen(html))
    body = F.col("_body")
    imgs = H.extract_all(body, r"(?is)<img\b[^>]*>", 0)
    rows = pages.select(
        page_id,
        F.size(F.filter(imgs, lambda t: ~t.rlike(r"(?i)\salt\s*=\s*(\"\"|'')"))).alias("images"),
        H.count_matches(body, r"(?i)<svg\b").alias("svgs"),
        H.count_matches(body, r"(?i)\sclass\s*=\s*[\"'][^\"']*(icon|fa-|material-icons)").alias("icons"),
        H.count_matches(body, r"(?i)<(video|canvas)\b").alias("videos"),
        H.count_matches(html, r"(?i)background(-image)?\s*:[^;}\"']*url\(").alias("background_images"),
        H.count_matches(body, r"(?i)<(section|article)\b|\srole\s*=\s*[\"'](region|main)[\"']").alias("sections"),
    )
    total = F.col("images") + F.col("svgs") + F.col("icons") + F.col("videos") + F.col("background_images")
    rows = rows.withColumn("density", total / F.greatest(F.col("sections"), F.lit(1)))
    gap = lambda cond, kind, level: F.when(cond, F.struct(F.lit(kind).alias("gap"), F.lit(level).alias("severity")))
    gaps = F.array_compact(
        F.array(
            gap(F.col("images") == 0, "image", "critical"),
            gap((F.col("svgs") == 0) & (F.col("icons") == 0), "icon", "high"),
            gap(F.col("density") < 0.5, "density", "medium"),
            gap(F.col("background_images") == 0, "background", "low"),
        )
    )
    cost = F.aggregate(gaps, F.lit(0), lambda s, g: s + first_match((g["severity"] == "critical", 30), (g["severity"] == "high", 20), (g["severity"] == "medium", 10), otherwise=5))
    bonus = F.when(F.col("density") >= 2, 10).when(F.col("density") >= 1, 5).otherwise(0)
    return rows.withColumns({"gaps": gaps, "score": clamp(F.least(F.lit(100), 100 - cost + bonus), 0, 100)})


def theme(colors: DataFrame, key: str, hex_col: str = "hex", weight: str = "n") -> DataFrame:
    """Light, dark or mixed per key from a colour-count table, with confidence and text contrast."""
    lum = colors.withColumn("_l", hex_luminance(hex_col)).filter(F.col("_l").isNotNull())
    w, l = F.col(weight).cast("double"), F.col("_l")
    agg = lum.groupBy(key).agg(
        (F.sum(w * l) / F.sum(w)).alias("luminance"), (F.sum(w * l * l) / F.sum(w)).alias("_sq"),
        F.count(F.lit(1)).alias("_n"), (F.max(w) / F.sum(w) * 100).alias("dominance"),
    )
    agg = agg.withColumn("spread", F.when(F.col("_n") < 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("luminance") * F.col("luminance")))))
    mean = F.col("luminance")
    mixed = (F.col("spread") > 0.45) & (mean > 0.3) & (mean < 0.7) & (F.col("dominance") < 50)
    sure = F.least(F.lit(1.0), 0.5 + F.abs(mean - 0.5) + F.least(F.lit(0.2), F.col("dominance") / 200))
    ink = F.when(mean > 0.5, 0.0).otherwise(1.0)
    return agg.select(
        key, "luminance", "spread", "dominance",
        F.when(mixed, "mixed").when(mean > 0.5, "light").otherwise("dark").alias("theme"),
        F.when(mixed, F.least(F.lit(0.8), F.col("spread"))).otherwise(sure).alias("confidence"),
        contrast_ratio(mean, ink).alias("text_contrast"),
    )


def adaptability(pages: DataFrame, projects: DataFrame, project_colors: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """How well a page fits its project: 0.4 colours + 0.3 animation + 0.2 framework + 0.1 utility classes.

    ``pages`` and ``project_colors(project_id, palette_hex)`` carry ``project_id``; ``projects`` has hooks,
    framework and utility_classes.
    """
    text = F.col(html)
    colors = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"#[0-9a-fA-F]{6}\b"), F.lit(0)), lambda c: F.lower(F.substring(c, 2, 6))))
    classes = F.filter(F.flatten(F.transform(H.attribute_values(html, "class"), lambda v: F.split(v, r"\s+"))), lambda c: c != "")
    base = pages.select(
        page_id, "project_id", colors.alias("_colors"), classes.alias("_classes"),
        text.rlike(r"(?i)data-scroll|data-aos|scroll-?trigger|intersectionobserver").alias("_scroll"),
        text.rlike(r"(?i)gsap|timeline|keyframes").alias("_complex"),
        text.rlike(r'(?i)class="[^"]*\b(flex|grid|p-|m-|w-|h-|text-|bg-|border-)').alias("_tw"),
    )
    used = base.select(page_id, "project_id", F.explode("_colors").alias("hex"))
    near = nearest_color(used, project_colors, ["project_id"], "hex", "palette_hex")
    hits = used.join(near.select("project_id", "hex", F.lit(1).alias("_m")), ["project_id", "hex"], "left").groupBy(page_id).agg((F.count("_m") / F.count(F.lit(1)) * 100).alias("_c"))
    has_palette = project_colors.select("project_id", F.lit(True).alias("_pal")).distinct()
    rows = base.join(projects, "project_id").join(hits, page_id, "left").join(has_palette, "project_id", "left")
    hook = lambda *words: F.exists("hooks", lambda h: any_of(F.lower(h), list(words)))
    color = F.when(F.col("_pal"), F.coalesce("_c", F.lit(50.0))).otherwise(50.0)
    motion = F.lit(50) + flag(F.col("_scroll") & hook("scroll", "animation")) * 25 + flag(F.col("_complex") & hook("gsap", "timeline")) * 25 + flag(~F.col("_scroll") & ~F.col("_complex")) * 10
    frame = F.when(F.col("framework") == "tailwindcss-v4", F.when(F.col("_tw"), 100).otherwise(60)).otherwise(50)
    known = F.size(F.filter("_classes", lambda c: F.array_contains("utility_classes", c)))
    util = F.when((F.size("utility_classes") == 0) | (F.size("_classes") == 0), 50.0).otherwise(known / F.size("_classes") * 100)
    score = round_half_up(color * 0.4 + F.least(motion, F.lit(100)) * 0.3 + frame * 0.2 + util * 0.1)
    suggested = F.filter("hooks", lambda h: (F.col("_scroll") & F.lower(h).contains("scroll")) | (F.col("_complex") & F.lower(h).contains("gsap")))
    return rows.select(page_id, "project_id", clamp(score, 0, 100).alias("score"), suggested.alias("suggested_hooks"))


def responsive_differences(elements: DataFrame, page_id: str = "page_id") -> DataFrame:
    """Differences of the same element between a larger and a smaller viewport, one row per difference."""
    p = viewport_pairs(elements, [page_id, "selector"])
    b, s = (lambda c: F.col(f"big.{c}")), (lambda c: F.col(f"small.{c}"))
    visible = lambda e: (e("display") != "none") & (e("visibility") != "hidden") & (e("opacity") > 0)
    ratio = s("font_size") / b("font_size")
    gap = s("margin") / b("margin")
    tall = s("scroll_height") / b("scroll_height")
    tests = {
        ("typography", "font_size"): (b("font_size") > 0) & ((ratio < 0.85) | (ratio > 1.15)),
        ("visibility", "visible"): visible(b) != visible(s),
        ("layout", "grid_columns"): b("grid_columns") != s("grid_columns"),
        ("layout", "flex_direction"): b("flex_direction") != s("flex_direction"),
        ("layout", "scroll_height"): (tall > 1.5) | (tall < 0.67),
        ("navigation", "nav_type"): b("nav_type") != s("nav_type"),
        ("spacing", "margin"): (b("margin") > 0) & ((gap < 0.8) | (gap > 1.2)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("category"), F.lit(f).alias("field"))) for (k, f), c in tests.items()]))
    rows = p.select(page_id, "selector", b("viewport_width").alias("big_width"), s("viewport_width").alias("small_width"), F.explode(found).alias("d"))
    return rows.select(page_id, "selector", "big_width", "small_width", "d.*")


def responsive_quality(viewports: DataFrame, page_id: str = "page_id") -> DataFrame:
    """0..100 per page: mean over viewports of touch 30, readability 30, overflow 20, images 20."""
    n = F.col("touch_passed") + F.col("touch_failed")
    touch = F.when(n > 0, F.col("touch_passed") * 30.0 / n).otherwise(30.0)
    readable = flag(F.col("font_size_ok")) * 10 + flag(F.col("line_length_ok")) * 10 + flag(F.col("line_height_ok")) * 10
    fits = F.when(F.col("horizontal_scroll"), 0).when(F.col("overflow_elements") == 0, 20).otherwise(10)
    m = F.col("srcset_images") + F.col("missing_responsive")
    images = F.when(m > 0, F.least((F.col("srcset_images") + F.col("picture_images")) / m, F.lit(1.0)) * 20).otherwise(20.0)
    return viewports.groupBy(page_id).agg(round_half_up(F.avg(touch + readable + fits + images)).alias("score"))


def mood(facts: DataFrame) -> DataFrame:
    """Mood, colour impression, type style and motion pace from style facts, without images.

    Input columns: color_values (array), font_families (array), n_font_sizes, n_motions, avg_duration.
    """
    seen = lambda arr, words: F.exists(arr, lambda c: any_of(F.lower(c), words))
    blue, warm = seen("color_values", ["blue", "#0", "rgb(0"]), seen("color_values", ["orange", "red", "yellow"])
    dark, plain = seen("color_values", ["#1", "#2", "#0"]), seen("color_values", ["gray", "grey", "#f"])
    emotion = first_match(
        (F.size("color_values") == 0, "neutral"), (blue & ~warm, "trust"), (warm & ~blue, "energy"), (dark, "elegance"), (plain, "clarity"), otherwise="neutral"
    )
    serif = F.exists("font_families", lambda f: F.lower(f).contains("serif") & ~F.lower(f).contains("sans-serif"))
    sans = seen("font_families", ["sans-serif", "helvetica", "arial"])
    show = seen("font_families", ["display", "playfair", "oswald"])
    style = first_match((serif & ~sans, "classic serif"), (show, "display/decorative"), otherwise="modern sans-serif")
    pace = F.when(F.col("n_motions") == 0, F.lit(None).cast("string")).when(F.col("avg_duration") > 500, "slow").when(F.col("avg_duration") < 200, "fast").otherwise("moderate")
    rows = facts.withColumns({"emotion": emotion, "type_style": style, "pace": pace})
    label = first_match(
        (F.col("emotion") == "trust", "trustworthy"), (F.col("emotion") == "energy", "energetic"), (F.col("emotion") == "elegance", "elegant"),
        (F.col("type_style").contains("display"), "bold"), (F.col("type_style").contains("serif"), "elegant"), otherwise="professional",
    )
    out = rows.withColumn("mood", label)
    return out.withColumns(
        {
            "hierarchy": F.when(F.col("n_font_sizes") >= 5, "clear").when(F.col("n_font_sizes") <= 2, "flat").otherwise("subtle"),
            "formality": F.when(F.col("mood").isin("professional", "trustworthy"), 0.7).otherwise(0.5),
            "energy": F.when(F.col("n_motions") == 0, 0.5).otherwise(F.least(F.lit(1.0), F.col("n_motions") / 20)),
        }
    )


FIELDS = ["theme", "colors", "density", "gradient", "mood"]


def merge_features(computed: DataFrame, seen: DataFrame, key: str, fields: list[str] = FIELDS) -> DataFrame:
    """Per field the computed value wins over the seen one; confidence weighted 1.2 / 1.0 / 0.5 by origin.

    Both sides hold ``<field>`` and ``<field>_confidence`` columns, each key once.
    """
    a = computed.select(key, *[F.col(c).alias(f"a_{c}") for c in computed.columns if c != key])
    b = seen.select(key, *[F.col(c).alias(f"b_{c}") for c in seen.columns if c != key])
    both = a.join(b, key, "full_outer")
    cols, weight, total, have = [], F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for f in fields:
        mine, theirs = F.col(f"a_{f}").isNotNull(), F.col(f"b_{f}").isNotNull()
        w = F.when(mine, 1.2).when(theirs, 1.0).otherwise(0.5)
        conf = F.when(mine, F.col(f"a_{f}_confidence")).when(theirs, F.col(f"b_{f}_confidence")).otherwise(0.5)
        weight, total = weight + w, total + w * conf
        have = have + F.when(mine | theirs, 1.0).otherwise(0.5)
        cols += [F.coalesce(f"a_{f}", f"b_{f}").alias(f), F.when(mine, "computed").when(theirs, "seen").otherwise("fallback").alias(f"{f}_source")]
    complete = have / len(fields)
    return both.select(key, *cols, (total / weight * F.when(complete < 1, 0.9).otherwise(1.0)).alias("confidence"), complete.alias("completeness"))


def robots_allowed(urls: DataFrame, rules: DataFrame, hosts: DataFrame, agent: str = "*") -> DataFrame:
    """``urls(url, host, path)`` with ``allowed`` by the longest matching rule of the host; allow wins a tie.

    ``rules(host, pattern, allow)`` are path prefixes in which ``*`` stands for any text and a last ``$`` for the end of the
    path. With a column ``agent`` the rules of the group named ``agent`` apply where the host has such a group, else those
    of ``*``. ``hosts(host)`` lists the hosts whose file is known. An unknown host is disallowed, a known host without a
    matching rule allowed. The rules of a host, at most one robots file, travel as an array, so every URL meets its host
    once and no row is multiplied.
    """
    if "agent" not in rules.columns:
        rules = rules.withColumn("agent", F.lit("*"))
    mine = rules.withColumn("_own", F.lower("agent") == agent.lower()).filter(F.col("_own") | (F.col("agent") == "*"))
    to_end = F.endswith("pattern", F.lit("$"))
    body = F.when(to_end, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern"))
    quoted = F.replace(F.regexp_replace(body, r"([\\^$.|?+(){}\[\]])", r"\\$1"), F.lit("*"), F.lit(".*"))
    wild = to_end | F.contains("pattern", F.lit("*"))
    expression = F.when(wild, F.concat(F.lit("^"), quoted, F.when(to_end, F.lit("$")).otherwise(F.lit(""))))
    rule = F.struct(F.length("pattern").alias("n"), "allow", "pattern", expression.alias("expression"), (F.col("_own") & (F.lit(agent) != "*")).alias("own"))
    known = hosts.select("host").distinct().withColumn("_known", F.lit(True))
    per_host = mine.groupBy("host").agg(F.collect_set(rule).alias("_rules"))
    out = urls.join(known.join(per_host, "host", "left"), "host", "left")
    grouped = F.exists("_rules", lambda r: r["own"])
    fits = lambda r: F.when(r["expression"].isNull(), F.startswith(F.col("path"), r["pattern"])).otherwise(F.regexp_like(F.col("path"), r["expression"]))
    best = F.array_max(F.filter("_rules", lambda r: (r["own"] | ~grouped) & fits(r)))
    allowed = F.when(F.col("_known").isNull(), False).otherwise(F.coalesce(best["allow"], F.lit(True)))
    return out.select("url", "host", "path", allowed.alias("allowed"))


# Brief fields, their completeness weight and least length.
BRIEF_FIELDS = {"project_name": (10, 3), "description": (20, 50), "target_audience": (15, 20), "industry": (10, 1), "tone": (15, 1), "color_preferences": (15, 1), "references": (10, 1), "constraints": (5, 1)}
_BRIEF_SEVERITY = {"project_name": "error", "description": "warning", "target_audience": "warning", "industry": "warning", "tone": "warning"}


def brief_check(briefs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(completeness 0..100 per brief, one row per missing or short field). Array fields count their elements."""
    arrays = {f.name for f in briefs.schema if f.dataType.typeName() == "array"}
    size = {f: F.coalesce(F.size(f) if f in arrays else F.length(f), F.lit(0)) for f in BRIEF_FIELDS}
    size = {f: F.greatest(s, F.lit(0)) for f, s in size.items()}
    points = sum((F.when(size[f] >= least, w).otherwise(0) for f, (w, least) in BRIEF_FIELDS.items()), F.lit(0))
    issues = [
        F.when(
            size[f] < least,
            F.struct(F.lit(f).alias("field"), F.lit(_BRIEF_SEVERITY.get(f, "suggestion")).alias("severity"), F.when(size[f] == 0, "missing").otherwise("short").alias("issue")),
        )
        for f, (_, least) in BRIEF_FIELDS.items()
    ]
    rows = briefs.select(key, F.explode(F.array_compact(F.array(*issues))).alias("i")).select(key, "i.*")
    return briefs.select(key, points.alias("completeness")), rows
