"""Page jobs, style facts and scores.

The given pages carry almost no CSS, so style jobs run on pages whose markup Spark builds from the part table.
"""

from webfacts.functions import css, embedtext
from webfacts.functions import html as H
from webfacts.functions.base import flag
from webfacts.functions.url import site_tier
from webfacts.operators import aggregates as agg
from webfacts.operators import embedding, scoring, sections, series
from webfacts.pages import motion, quality, structure, styles
from webfacts.plans.common import HEX, F, big, hex_of, r6, t
from webfacts.plans.scalars import HEADINGS_SQL, TEXT_SQL
from webfacts.registry import query
from webfacts.session import fan_out
from webfacts.rules import patterns as P
from webfacts.rules.keywords import INDUSTRIES, STYLES
from webfacts.rules.section_rules import SECTION_RULES


def styled(spark, d):
    """Pages with style sheets and sections, derived from the part table."""
    k, size, hx = F.col("p_partkey"), F.col("p_size"), hex_of("p_partkey")
    text = F.format_string(
        '<!DOCTYPE html><html lang="en"><head><link rel="stylesheet" href="/css/%3$s.css"><script src="//cdn.example.net/gsap.min.js"></script><style>/* part */'
        ":root{--color-main:#%2$s;--gap:calc(2px * %1$s);--font-a:var(--font-b, serif);--font-b:Arial;--color-alt:var(--color-main);--odd:var(--missing)}"
        ".card{animation:spin%4$s %5$sms ease-in infinite;background:linear-gradient(45deg, #%2$s 0%%, white);box-shadow:0 0 %1$spx 2px #%2$s;border-radius:4px;transition:width 250ms;color:var(--color-alt)}"
        "@keyframes spin%4$s{from{opacity:0}50%%{opacity:.5;width:1px}to{opacity:1}}"
        "h1{font-size:%6$spx;font-family:'Open Sans', Arial, sans-serif;font-weight:bold}h2{font-size:24px}body{font-size:16px;background-color:#%2$s;color:#111}"
        "@media (max-width: 600px){.card{display:grid;grid-template-columns:repeat(3, 1fr);gap:16px;margin:24px}}</style></head>"
        '<body><nav class="menu"><a href="/a">A</a><a href="/b">B</a><a href="/c">C</a></nav>'
        '<header class="hero wide" style="background-image: url(bg.png); color: #fff"><h1>%3$s</h1><button>Go</button></header>'
        '<main><section class="features grid" id="features"><h2>One</h2><h2>Two</h2><img src="a.png" alt="a"><img src="b.png" alt=""><p>Text %3$s</p></section>'
        "<section><p>Plain</p></section></main><footer><p>Copyright %3$s</p><a href=\"/x\">x</a></footer></body></html>",
        size, hx, F.col("p_name"), k % 5, size * 100, size + 16,
    )
    rows = fan_out(t(spark, d, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")  # one small file becomes many pages
    return rows.select(k.alias("page_id"), F.concat(F.lit("https://shop.example.com/p/"), k).alias("url"), text.alias("html"))


def part(spark, d):
    return t(spark, d, "part")


def pages(spark, d):
    return t(spark, d, "pages")


PART = "(SELECT p_partkey AS k, p_size AS s, p_name AS nm, " + HEX.format(k="p_partkey") + " AS hx FROM part)"

# --- CSS value functions on derived values -------------------------------------------------------------


@query("fn_10_duration", f"SELECT k, CASE WHEN s % 2 = 0 THEN s * 10.0 ELSE s * 100.0 END::DOUBLE AS ms FROM {PART}")
def fn_10(spark, d):
    s = F.col("p_size")
    text = F.when(s % 2 == 0, F.concat((s * 10).cast("string"), F.lit("ms"))).otherwise(F.concat((s / 10).cast("string"), F.lit("s")))
    return part(spark, d).select(F.col("p_partkey").alias("k"), F.round(css.duration_ms(text), 6).alias("ms"))


@query("fn_11_split_list", f"SELECT k, 3::BIGINT AS n, 'rgba(' || s || ', 0, 1)' AS second FROM {PART}")
def fn_11(spark, d):
    parts = css.split_list(F.format_string("a %1$s, rgba(%1$s, 0, 1), b", F.col("p_size")))
    return part(spark, d).select(F.col("p_partkey").alias("k"), F.size(parts).cast("long").alias("n"), parts[1].alias("second"))


@query(
    "fn_12_animation_shorthand",
    f"SELECT k, 'spin' || k AS name, s * 100.0::DOUBLE AS duration, 'cubic-bezier(.1, .2, .3, 1)' AS easing, s * 1.0::DOUBLE AS delay, CASE WHEN s % 2 = 0 THEN 'infinite' ELSE s::VARCHAR END AS iterations, 'alternate' AS direction, 'both' AS fill_mode FROM {PART}",
)
def fn_12(spark, d):
    s = F.col("p_size")
    text = F.format_string("%1$sms cubic-bezier(.1, .2, .3, 1) %2$sms %3$s both spin%4$s alternate, other 1s", s * 100, s, F.when(s % 2 == 0, "infinite").otherwise(s.cast("string")), F.col("p_partkey"))
    a = part(spark, d).select(F.col("p_partkey").alias("k"), css.animation_shorthand(text).alias("a"))
    return a.select("k", *[F.col(f"a.{c}").alias(c) for c in ("name", "duration", "easing", "delay", "iterations", "direction", "fill_mode")])


@query("fn_13_transition_shorthand", f"SELECT k, p AS property, CASE WHEN p = 'opacity' THEN s * 10.0 ELSE 200.0 END::DOUBLE AS duration, CASE WHEN p = 'opacity' THEN 'ease-in' ELSE 'ease' END AS easing FROM {PART}, (VALUES ('opacity'), ('transform')) AS v(p)")
def fn_13(spark, d):
    tr = css.transition_shorthand(F.format_string("opacity %1$sms ease-in, transform 200ms", F.col("p_size") * 10))
    return part(spark, d).select(F.col("p_partkey").alias("k"), F.explode(tr).alias("t")).select("k", "t.property", "t.duration", "t.easing")


@query(
    "fn_14_timing_function",
    f"SELECT k, CASE s % 3 WHEN 0 THEN 'keyword' WHEN 1 THEN 'steps' ELSE 'cubic-bezier' END AS kind, CASE s % 3 WHEN 0 THEN 0.42 WHEN 2 THEN round(s / 100.0, 2) END::DOUBLE AS x1, CASE s % 3 WHEN 1 THEN s END::BIGINT AS steps FROM {PART}",
)
def fn_14(spark, d):
    s = F.col("p_size")
    text = F.when(s % 3 == 0, "ease-in").when(s % 3 == 1, F.format_string("steps(%1$s, start)", s)).otherwise(F.format_string("cubic-bezier(%1$s, 0, 1, 1)", F.round(s / 100, 2).cast("string")))
    f = part(spark, d).select(F.col("p_partkey").alias("k"), css.timing_function(text).alias("f"))
    return f.select("k", "f.kind", F.round(F.col("f.points")[0], 6).alias("x1"), big("f.steps", "steps"))


@query("fn_15_keyframe_offsets", f"SELECT k, 3::BIGINT AS n, round(s / 100.0, 6) AS mid FROM {PART}")
def fn_15(spark, d):
    o = part(spark, d).select(F.col("p_partkey").alias("k"), css.keyframe_offsets(F.format_string("from, %1$s%%, to, bad", F.col("p_size"))).alias("o"))
    return o.select("k", F.size("o").cast("long").alias("n"), r6(F.col("o")[1], "mid"))


@query("fn_16_color_literals", f"SELECT k, '#' || hx || '|rgba(' || s || ', 0, 0, .5)|red' AS colors FROM {PART}")
def fn_16(spark, d):
    text = F.format_string("linear-gradient(#%1$s, rgba(%2$s, 0, 0, .5) 20%%, red)", hex_of("p_partkey"), F.col("p_size"))
    return part(spark, d).select(F.col("p_partkey").alias("k"), F.array_join(css.color_literals(text), "|").alias("colors"))


@query("fn_24_sizes", f"SELECT k, s / 16.0 AS rem, CASE WHEN s % 2 = 0 THEN 700 ELSE s * 10 END::BIGINT AS weight, s * 16.0::DOUBLE AS px FROM {PART}")
def fn_24(spark, d):
    s = F.col("p_size")
    weight = F.when(s % 2 == 0, "bold").otherwise((s * 10).cast("string"))
    return part(spark, d).select(
        F.col("p_partkey").alias("k"), css.size_rem(F.concat(s.cast("string"), F.lit("px"))).alias("rem"), big(css.weight_number(weight), "weight"), css.size_px(F.concat(s.cast("string"), F.lit("rem"))).alias("px")
    )


@query("fn_25_font_family", f"SELECT k, nm AS primary_family, 2::BIGINT AS n_fallbacks, CASE s % 3 WHEN 0 THEN 'serif' WHEN 1 THEN 'monospace' ELSE 'sans-serif' END AS category FROM {PART}")
def fn_25(spark, d):
    last = F.when(F.col("p_size") % 3 == 0, "serif").when(F.col("p_size") % 3 == 1, "monospace").otherwise("sans-serif")
    f = part(spark, d).select(F.col("p_partkey").alias("k"), css.font_family(F.concat(F.lit("'"), F.col("p_name"), F.lit("', Arial, "), last)).alias("f"))
    return f.select("k", F.col("f.primary").alias("primary_family"), F.size("f.fallbacks").cast("long").alias("n_fallbacks"), "f.category")


@query("fn_26_variable_category", f"SELECT k, CASE s % 4 WHEN 0 THEN 'border' WHEN 1 THEN 'color' WHEN 2 THEN 'typography' ELSE 'other' END AS category FROM {PART}")
def fn_26(spark, d):
    s = F.col("p_size")
    name = F.when(s % 4 == 0, "--radius-lg").when(s % 4 == 1, "--bg-main").when(s % 4 == 2, "--font-size-sm").otherwise("--brand")
    return part(spark, d).select(F.col("p_partkey").alias("k"), css.variable_category(name).alias("category"))


@query("fn_32_gradient", f"SELECT k, s * 1.0::DOUBLE AS angle, 3::BIGINT AS stops, 0.5::DOUBLE AS mid, '#' || hx AS first_color FROM {PART}")
def fn_32(spark, d):
    g = css.gradients(F.format_string("linear-gradient(%1$sdeg, #%2$s, white, black 90%%)", F.col("p_size"), hex_of("p_partkey")))[0]
    x = part(spark, d).select(F.col("p_partkey").alias("k"), g.alias("g"))
    return x.select("k", "g.angle", F.size("g.stops").cast("long").alias("stops"), F.col("g.stops")[1]["position"].alias("mid"), F.col("g.stops")[0]["color"].alias("first_color"))


@query("fn_33_box_shadow", f"SELECT k, s * 1.0::DOUBLE AS blur, '#' || hx AS color, 2::BIGINT AS n, true AS inset FROM {PART}")
def fn_33(spark, d):
    x = part(spark, d).select(F.col("p_partkey").alias("k"), css.box_shadows(F.format_string("0 1px %1$spx #%2$s, inset 0 0 3px red", F.col("p_size"), hex_of("p_partkey"))).alias("b"))
    return x.select("k", F.col("b")[0]["blur"].alias("blur"), F.col("b")[0]["color"].alias("color"), F.size("b").cast("long").alias("n"), F.col("b")[1]["inset"].alias("inset"))


@query("fn_34_describe_name", "SELECT p_partkey AS k, replace(replace(p_name, 'red', 'crimson'), 'ring', 'loop') || ' ' || lower(p_type) AS description FROM part")
def fn_34(spark, d):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_"), F.initcap("p_type"))
    return part(spark, d).select(F.col("p_partkey").alias("k"), embedtext.describe_name(name, {"red": "crimson", "ring": "loop"}).alias("description"))


@query("fn_35_strip_prefix", f"SELECT k, CASE WHEN s % 2 = 0 THEN 'transition' ELSE 'x-' || s END AS property FROM {PART}")
def fn_35(spark, d):
    s = F.col("p_size")
    return part(spark, d).select(F.col("p_partkey").alias("k"), css.strip_prefix(F.when(s % 2 == 0, "-webkit-transition").otherwise(F.concat(F.lit("x-"), s.cast("string")))).alias("property"))


# --- sections ------------------------------------------------------------------------------------------

UNSEEN = r"regexp_replace(html, '<!--.*?-->|<(?:script|style|noscript)\b.*?</(?:script|style|noscript)\s*>', '', 'gis')"
SECTS = rf"""(SELECT page_id, unnest(l) AS snippet, generate_subscripts(l, 1) - 1 AS position FROM
   (SELECT page_id, regexp_extract_all({UNSEEN}, '(?is)<nav\b[^>]*>.*?</nav>|<article\b[^>]*>.*?</article>|<footer\b[^>]*>.*?</footer>|<section\b[^>]*>.*?</section>|<header\b[^>]*>.*?</header>|<aside\b[^>]*>.*?</aside>|<main\b[^>]*>.*?</main>') AS l FROM pages))"""


@query("pg_01_sections", rf"SELECT page_id, position, lower(regexp_extract(snippet, '^<([A-Za-z]+)', 1)) AS tag, length(snippet) AS n_chars FROM {SECTS}")
def pg_01(spark, d):
    return structure.sections(pages(spark, d)).select("page_id", big("position", "position"), "tag", F.length("snippet").cast("long").alias("n_chars"))


@query(
    "pg_02_section_content",
    rf"""
    SELECT page_id, position, len({HEADINGS_SQL.replace('html', 'snippet')})::BIGINT AS headings,
      len(list_filter(regexp_extract_all(snippet, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g')) <> ''))::BIGINT AS paragraphs,
      len(regexp_extract_all(snippet, '(?is)<a\b[^>]*\shref="([^"]*)"', 1))::BIGINT AS links FROM {SECTS}""",
)
def pg_02(spark, d):
    c = structure.with_content(structure.sections(pages(spark, d)))
    return c.select("page_id", big("position", "position"), big("n_headings", "headings"), big("n_paragraphs", "paragraphs"), big("n_links", "links"))


@query(
    "pg_04_snippet_cap",
    rf"SELECT page_id, CASE WHEN strlen(html) <= 1500 THEN html ELSE left(regexp_replace(html, '<(?:script|style|svg|noscript|iframe)\b.*?</(?:script|style|svg|noscript|iframe)\s*>|<!--.*?-->', '', 'gis'), 1500) END AS snippet FROM pages",
)
def pg_04(spark, d):
    return pages(spark, d).select("page_id", H.cap_snippet("html", 1500).alias("snippet"))


@query("pg_05_inline_style", "SELECT p_partkey AS page_id, 1::BIGINT AS with_image, '#fff' AS text_color FROM part")
def pg_05(spark, d):
    s = structure.with_style_facts(structure.sections(styled(spark, d)))
    return s.groupBy("page_id").agg(F.sum(flag(F.col("has_image"))).alias("with_image"), F.max("text_color").alias("text_color"))


_P_TEXTS = r"list_filter(list_transform(regexp_extract_all(snippet, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda x: lower(trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g')))), lambda x: x <> '')"
_OPENING = r"regexp_extract(snippet, '^<[^>]*>')"
#: The facts that the section rules ask for, from a snippet.
SECTION_FACTS = rf"""
    SELECT page_id, position, lower(regexp_extract(snippet, '^<([A-Za-z]+)', 1)) AS tag, regexp_extract({_OPENING}, '(?i)\sclass="([^"]*)"', 1) AS classes,
      regexp_extract({_OPENING}, '(?i)\sid="([^"]*)"', 1) AS id, regexp_extract({_OPENING}, '(?i)\sstyle="([^"]*)"', 1) AS style,
      {HEADINGS_SQL.replace('html', 'snippet')} AS hs, {_P_TEXTS} AS ps, len(regexp_extract_all(snippet, '(?is)<a\b[^>]*\shref="([^"]*)"', 1)) AS n_links,
      len(regexp_extract_all(snippet, '(?is)<img\b[^>]*>')) AS n_images, len(regexp_extract_all(snippet, '(?is)<button\b[^>]*>(.*?)</button>')) AS n_buttons,
      regexp_matches(snippet, '(?is)<h1\b[^>]*>\s*[^<\s]') AS has_h1 FROM {SECTS}"""
SECTION_PLACES = f"""
    SELECT *, len(hs) AS n_headings, len(ps) AS n_paragraphs, regexp_matches(style, '(?i)gradient') AS has_gradient, regexp_matches(style, '(?i)background-image:\\s*url|background:\\s*[^;]*url') AS has_image,
      coalesce(list_bool_or(list_transform(ps, lambda p: contains(p, '©') OR contains(p, 'copyright') OR contains(p, 'all rights reserved'))), false) AS has_copyright,
      coalesce(list_bool_or(list_transform(ps, lambda p: contains(p, '@') OR contains(p, 'email'))), false) AS has_email,
      coalesce(sum(greatest(50, len(hs) * 40 + len(ps) * 60 + n_images * 200 + n_buttons * 40)) OVER (PARTITION BY page_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_y
    FROM ({SECTION_FACTS})"""


def rule_sql(field: str, test) -> str:
    """One condition of a section rule as SQL over the facts."""
    if field == "tag":
        return f"tag = '{test}'"
    if field in ("classes", "id"):
        return f"regexp_matches({field}, '(?i)\\b(?:{test})\\b')"
    if field == "start_y":
        return f"start_y BETWEEN {test[0]} AND {test[1]}"
    def fact(name: str) -> str:
        if name in ("h1", "copyright", "email", "gradient", "image"):
            return f"has_{name}"
        return "n_buttons > 0" if name == "button" else f"n_{name[:-1]} >= {name[-1]}" if name[-1].isdigit() else f"n_{name} > 0"
    return "(" + (" AND " if field == "has_all" else " OR ").join(fact(name) for name in test) + ")"


def rules_sql(rules: list) -> str:
    """All rules as one list; the greatest entry is the chosen one."""
    rows = []
    for n, (kind, priority, minimum, conditions) in enumerate(rules):
        got = " + ".join(f"CASE WHEN {rule_sql(f, t)} THEN {w:.4f}::DOUBLE ELSE 0 END" for f, t, w in conditions)
        rows.append(f"{{'p': {priority}, 'c': least(1.0::DOUBLE, ({got}) / {sum(w for *_, w in conditions):.4f}::DOUBLE), 'n': {-n}, 't': '{kind}', 'm': {minimum}::DOUBLE - 1e-9}}")
    return "[" + ",\n      ".join(rows) + "]"


@query(
    "pg_06_section_type",
    f"""
    SELECT page_id, position, coalesce(best.t, 'unknown') AS type, round(coalesce(best.c, 0.0), 6) AS confidence
    FROM (SELECT page_id, position, list_max(list_filter({rules_sql(SECTION_RULES)}, lambda x: x.c >= x.m)) AS best FROM ({SECTION_PLACES}))""",
)
def pg_06(spark, d):
    return structure.analyzed_sections(pages(spark, d)).select("page_id", big("position", "position"), "type", r6("confidence", "confidence"))


@query(
    "pg_03_drop_empty",
    "SELECT p_partkey AS page_id, v.position, v.type, v.confidence FROM part, (VALUES (0::BIGINT, 'navigation', 1.0::DOUBLE), (1, 'hero', 1.0), (2, 'feature', 1.0), (3, 'unknown', 0.0), (4, 'footer', 1.0)) AS v(position, type, confidence)",
)
def pg_03(spark, d):
    kept = structure.drop_empty(structure.analyzed_sections(styled(spark, d)))
    return kept.select("page_id", big("position", "position"), "type", r6("confidence", "confidence"))


@query(
    "pg_07_contextual_types",
    rf"""
    SELECT page_id, position, tag, CASE tag WHEN 'nav' THEN 'navigation' WHEN 'article' THEN 'hero' ELSE 'footer' END AS type, CASE tag WHEN 'nav' THEN 1.0 WHEN 'article' THEN 0.65 ELSE 0.88 END::DOUBLE AS confidence
    FROM (SELECT page_id, position, lower(regexp_extract(snippet, '^<([A-Za-z]+)', 1)) AS tag FROM {SECTS})""",
)
def pg_07(spark, d):
    s = structure.analyzed_sections(pages(spark, d)).drop("snippet")
    return sections.relabel_by_context(s, "page_id", "position").select("page_id", big("position", "position"), "tag", "type", r6("confidence", "confidence"))


@query(
    "pg_08_section_names",
    "SELECT p_partkey AS page_id, v.position, v.name FROM part, (VALUES (0::BIGINT, 'Menu'), (1, 'Hero'), (2, 'Features'), (3, 'Unknown'), (4, 'Footer')) AS v(position, name)",
)
def pg_08(spark, d):
    return structure.analyzed_sections(styled(spark, d)).select("page_id", big("position", "position"), "name")


@query(
    "pg_09_complexity",
    r"""
    SELECT page_id, scripts, resources, webgl, spa, round((1.0 + CASE WHEN scripts > 30 THEN 1.5 WHEN scripts > 15 THEN 0.75 WHEN scripts > 5 THEN 0.25 ELSE 0 END + CASE WHEN resources > 50 THEN 1 WHEN resources > 30 THEN 0.5 ELSE 0 END + CASE WHEN webgl THEN 2 ELSE 0 END + CASE WHEN spa THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS timeout_factor,
      least(100, floor(least(scripts * 0.5, 25) + least(resources * 0.2, 20) + CASE WHEN webgl THEN 20 ELSE 0 END + CASE WHEN spa THEN 5 ELSE 0 END + 0.5))::BIGINT AS score FROM
    (SELECT page_id, len(regexp_extract_all(html, '(?i)<script\b[^>]*>'))::BIGINT AS scripts,
      (len(regexp_extract_all(html, '(?i)<link\b[^>]*href\s*=')) + len(regexp_extract_all(html, '(?i)<(?:img|script|video|audio|iframe)\b[^>]*src\s*=')))::BIGINT AS resources,
      regexp_matches(html, '(?i)<canvas\b|webgl|three\.js|pixi\.js|babylon\.js|\bregl|twgl|gl-matrix') AS webgl,
      regexp_matches(html, '(?i)data-reactroot|data-v-[a-f0-9]+|ng-version|svelte-[a-z0-9]+|__NEXT_DATA__|v-cloak') AS spa FROM pages)""",
)
def pg_09(spark, d):
    out = quality.complexity(pages(spark, d))
    return out.select("page_id", "scripts", "resources", "webgl", "spa", r6("timeout_factor", "timeout_factor"), big("score", "score"))


@query("pg_10_frameworks", "SELECT p_partkey AS page_id, 'tailwind' AS framework, 0.02::DOUBLE AS confidence FROM part")
def pg_10(spark, d):
    return quality.frameworks(styled(spark, d)).select("page_id", "framework", r6("confidence", "confidence"))


@query(
    "pg_11_page_colors",
    f"SELECT k AS page_id, array_to_string(list_sort(['#' || hx, 'white']), '|') AS backgrounds, array_to_string(list_sort(list_distinct(['#' || hx, '#111', '#fff'])), '|') AS texts, true AS has_gradient FROM {PART}",
)
def pg_11(spark, d):
    return styles.page_colors(styled(spark, d)).select("page_id", F.array_join("backgrounds", "|").alias("backgrounds"), F.array_join("texts", "|").alias("texts"), "has_gradient")


@query(
    "pg_12_resolved_variables",
    f"""SELECT k AS page_id, name, CASE name WHEN '--font-a' THEN 'Arial' WHEN '--font-b' THEN 'Arial' WHEN '--gap' THEN 'calc(2px * ' || s || ')' WHEN '--odd' THEN 'var(--missing)' ELSE '#' || hx END AS value,
      CASE name WHEN '--odd' THEN 'unresolved' ELSE 'resolved' END AS status FROM {PART}, (VALUES ('--color-main'), ('--gap'), ('--font-a'), ('--font-b'), ('--color-alt'), ('--odd')) AS v(name)""",
)
def pg_12(spark, d):
    return styles.resolve_variables(styles.variables(styled(spark, d)))


@query(
    "pg_13_variable_inventory",
    "SELECT p_partkey AS page_id, v.name, v.category, v.calc AS uses_calc FROM part, (VALUES ('--color-main', 'color', false), ('--gap', 'spacing', true), ('--font-a', 'typography', false), ('--font-b', 'typography', false), ('--color-alt', 'color', false), ('--odd', 'other', false)) AS v(name, category, calc)",
)
def pg_13(spark, d):
    return styles.variables(styled(spark, d)).select("page_id", "name", "category", "uses_calc")


@query(
    "pg_14_style_rules",
    r"""
    SELECT page_id, trim(regexp_extract(b, '([^{}]+)\{([^{}]*)\}', 1)) AS selector, regexp_extract(b, '\{\s*([a-z-]+)\s*:', 1) AS property, regexp_extract(b, ':\s*([^;}]*)', 1) AS value
    FROM (SELECT page_id, unnest(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1), chr(10)), '[^{}]+\{[^{}]*\}')) AS b FROM pages)""",
)
def pg_14(spark, d):
    return styles.style_rules(pages(spark, d)).select("page_id", "selector", "property", "value")


@query(
    "pg_15_keyframes",
    "SELECT p_partkey AS page_id, 'spin' || p_partkey % 5 AS name, v.o AS offset, v.p AS property, v.v AS value FROM part, (VALUES (0.0::DOUBLE, 'opacity', '0'), (0.5, 'opacity', '.5'), (0.5, 'width', '1px'), (1.0, 'opacity', '1')) AS v(o, p, v)",
)
def pg_15(spark, d):
    return styles.keyframes(styled(spark, d))


@query(
    "pg_16_motions",
    "SELECT p_partkey AS page_id, 'animation' AS type, 'spin' || p_partkey % 5 AS name, p_size * 100.0::DOUBLE AS duration, 'infinite' AS iterations, 2::BIGINT AS n_properties FROM part UNION ALL SELECT p_partkey, 'transition', 'transition-width', 250.0, '1', 1 FROM part",
)
def pg_16(spark, d):
    return motion.motions(styled(spark, d)).select("page_id", "type", "name", "duration", "iterations", F.size("properties").cast("long").alias("n_properties"))


@query(
    "pg_17_motion_warnings",
    "SELECT p_partkey AS page_id, 'animation' AS type, 'layout' AS warning FROM part UNION ALL SELECT p_partkey, 'transition', 'layout' FROM part UNION ALL SELECT p_partkey, 'animation', 'rapid' FROM part WHERE p_size * 100 < 300 UNION ALL SELECT p_partkey, 'animation', 'long' FROM part WHERE p_size * 100 > 5000",
)
def pg_17(spark, d):
    return motion.warnings(motion.motions(styled(spark, d))).select("page_id", "type", "warning")


@query("pg_18_motion_complexity", "SELECT p_partkey AS page_id, least(100, 14 + 6 + 2 + 12 + CASE WHEN p_size * 100 > 2000 THEN 7 ELSE 0 END + 3)::BIGINT AS complexity FROM part")
def pg_18(spark, d):
    return motion.complexity(motion.motions(styled(spark, d))).select("page_id", big("complexity", "complexity"))


@query("pg_19_motion_category", "SELECT p_partkey AS page_id, 'animation' AS type, 'loading_state' AS category FROM part UNION ALL SELECT p_partkey, 'transition', 'unknown' FROM part")
def pg_19(spark, d):
    return motion.motion_category(motion.motions(styled(spark, d))).select("page_id", "type", "category")


@query("pg_20_motion_performance", "SELECT p_partkey AS page_id, v.t AS type, 'poor' AS level, 20::BIGINT AS points FROM part, (VALUES ('animation'), ('transition')) AS v(t)")
def pg_20(spark, d):
    return motion.performance(motion.motions(styled(spark, d))).select("page_id", "type", "level", big("points", "points"))


@query("pg_21_reduced_motion", "SELECT page_id, contains(html, 'prefers-reduced-motion') AS respects_reduced_motion FROM pages")
def pg_21(spark, d):
    return styles.reduced_motion(pages(spark, d)).select("page_id", "respects_reduced_motion")


@query(
    "pg_22_backgrounds",
    "SELECT p_partkey AS page_id, v.s AS selector, v.t AS design_type, v.i AS impact FROM part, (VALUES ('.card', 'animated_gradient', 'medium'), ('body', 'solid_color', 'low'), ('header', 'image_background', 'low')) AS v(s, t, i)",
)
def pg_22(spark, d):
    return styles.backgrounds(styles.rule_blocks(styled(spark, d))).select("page_id", "selector", "design_type", "impact")


@query("pg_23_background_performance", "SELECT p_partkey AS page_id, v.s AS selector, v.p AS triggers_paint, false AS gpu, v.a AS animated FROM part, (VALUES ('.card', true, true), ('body', false, false), ('header', true, false)) AS v(s, p, a)")
def pg_23(spark, d):
    return styles.backgrounds(styles.rule_blocks(styled(spark, d))).select("page_id", "selector", "triggers_paint", "gpu", "animated")


@query(
    "pg_24_decorations",
    "SELECT p_partkey AS page_id, 'glow' AS type, round(CASE WHEN p_size >= 10 THEN 0.95 ELSE 0.85 END, 6)::DOUBLE AS confidence FROM part UNION ALL SELECT p_partkey, 'gradient', 0.95 FROM part UNION ALL SELECT p_partkey, 'animated-border', 0.7 FROM part",
)
def pg_24(spark, d):
    return styles.decorations(styles.rule_blocks(styled(spark, d), about=styles.DECORATION_WORDS)).select("page_id", "type", r6("confidence", "confidence"))


@query("pg_25_typography", "SELECT p_partkey AS page_id, 'Open Sans' AS families, (p_size + 16) / 16.0 AS h1, 1.5::DOUBLE AS h2, 1::BIGINT AS weights FROM part")
def pg_25(spark, d):
    return styles.typography(styles.rule_blocks(styled(spark, d), about=styles.TYPE_WORDS)).select("page_id", F.array_join("families", "|").alias("families"), "h1", "h2", "weights")


@query(
    "pg_26_theme",
    f"""
    WITH c AS (SELECT p_type, {HEX.format(k='p_partkey')} AS hx, count(*) AS n FROM part GROUP BY 1, 2),
    l AS (SELECT p_type, n, 0.2126 * f(r) + 0.7152 * f(g) + 0.0722 * f(b) AS lum FROM (SELECT p_type, n, ('0x' || substr(hx, 1, 2))::INT AS r, ('0x' || substr(hx, 3, 2))::INT AS g, ('0x' || substr(hx, 5, 2))::INT AS b FROM c)),
    a AS (SELECT p_type, sum(n * lum) / sum(n) AS m, sqrt(greatest(0, sum(n * lum * lum) / sum(n) - pow(sum(n * lum) / sum(n), 2))) AS sd, max(n) * 100.0 / sum(n) AS dom FROM l GROUP BY 1)
    SELECT p_type, round(m, 6) AS luminance, CASE WHEN sd > 0.45 AND m > 0.3 AND m < 0.7 AND dom < 50 THEN 'mixed' WHEN m > 0.5 THEN 'light' ELSE 'dark' END AS theme,
      round(CASE WHEN sd > 0.45 AND m > 0.3 AND m < 0.7 AND dom < 50 THEN least(0.8, sd) ELSE least(1, 0.5 + abs(m - 0.5) + least(0.2, dom / 200)) END, 6) AS confidence FROM a""".replace(
        "f(r)", "(CASE WHEN r / 255.0 <= 0.04045 THEN r / 255.0 / 12.92 ELSE pow((r / 255.0 + 0.055) / 1.055, 2.4) END)"
    ).replace("f(g)", "(CASE WHEN g / 255.0 <= 0.04045 THEN g / 255.0 / 12.92 ELSE pow((g / 255.0 + 0.055) / 1.055, 2.4) END)").replace(
        "f(b)", "(CASE WHEN b / 255.0 <= 0.04045 THEN b / 255.0 / 12.92 ELSE pow((b / 255.0 + 0.055) / 1.055, 2.4) END)"
    ),
)
def pg_26(spark, d):
    colors = part(spark, d).select("p_type", hex_of("p_partkey").alias("hex"))
    table = agg.color_histogram(colors, "hex", ["p_type"])
    return quality.theme(table, "p_type").select("p_type", r6("luminance", "luminance"), "theme", r6("confidence", "confidence"))


@query(
    "pg_27_content_gaps",
    rf"""
    WITH b AS (SELECT page_id, html, {UNSEEN} AS body FROM pages),
    c AS (SELECT page_id, len(regexp_extract_all(body, '(?i)<img\b')) AS images, len(regexp_extract_all(body, '(?i)<svg\b')) + len(regexp_extract_all(body, '(?i)\sclass\s*=\s*["''][^"'']*(icon|fa-|material-icons)')) AS icons,
      len(regexp_extract_all(body, '(?i)<(?:video|canvas)\b')) AS videos, len(regexp_extract_all(html, '(?i)background(-image)?\s*:[^;}}"'']*url\(')) AS bgs, len(regexp_extract_all(body, '(?i)<(?:section|article)\b')) AS sections FROM b),
    x AS (SELECT *, (images + icons + videos + bgs) * 1.0 / greatest(sections, 1) AS density FROM c)
    SELECT page_id, ((images = 0)::INT + (icons = 0)::INT + (density < 0.5)::INT + (bgs = 0)::INT)::BIGINT AS gaps,
      greatest(0, least(100, 100 - 30 * (images = 0)::INT - 20 * (icons = 0)::INT - 10 * (density < 0.5)::INT - 5 * (bgs = 0)::INT + CASE WHEN density >= 2 THEN 10 WHEN density >= 1 THEN 5 ELSE 0 END))::BIGINT AS score FROM x""",
)
def pg_27(spark, d):
    return quality.content_gaps(pages(spark, d)).select("page_id", F.size("gaps").cast("long").alias("gaps"), big("score", "score"))


@query("pg_28_libraries", "SELECT p_partkey AS page_id, 'gsap' AS library, 2::BIGINT AS marks FROM part")
def pg_28(spark, d):
    return quality.libraries(styled(spark, d)).select("page_id", "library", big("marks", "marks"))


@query(
    "pg_29_links",
    "SELECT p_partkey AS page_id, 'stylesheet' AS kind, 'https://shop.example.com/css/' || p_name || '.css' AS target FROM part UNION ALL SELECT p_partkey, 'script', 'https://cdn.example.net/gsap.min.js' FROM part",
)
def pg_29(spark, d):
    return quality.links(styled(spark, d))


@query(
    "pg_30_site_tier",
    r"""
    SELECT page_id, CASE WHEN regexp_matches(url, '^https?://([a-z0-9-]+\.)*cheap-pills\.example\.com([:/?#]|$)') THEN 'ultra-heavy'
      WHEN regexp_matches(url, '^https?://([a-z0-9-]+\.)*spam-farm\.example\.org([:/?#]|$)') THEN 'heavy' WHEN contains(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1), '/fr/') THEN 'webgl' ELSE 'normal' END AS tier FROM pages""",
)
def pg_30(spark, d):
    tier = site_tier("url", {"ultra-heavy": ["cheap-pills.example.com"], "heavy": ["spam-farm.example.org"]}, ["/fr/"])
    return pages(spark, d).select("page_id", tier.alias("tier"))


@query("pg_31_adaptability")
def pg_31(spark, d):
    p = styled(spark, d).withColumn("project_id", F.col("page_id") % 25)
    projects = t(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("project_id"), F.array(F.lit("useScroll"), F.concat(F.lit("useGsap"), F.col("n_name"))).alias("hooks"),
        F.when(F.col("n_regionkey") == 0, "tailwindcss-v4").otherwise("none").alias("framework"), F.array(F.lit("grid"), F.lit("menu")).alias("utility_classes"),
    )
    palette = t(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("project_id"), hex_of("s_suppkey").alias("palette_hex"))
    return quality.adaptability(p, projects, palette).select("page_id", "project_id", "score")


@query(
    "pg_32_responsive_differences",
    """
    WITH v AS (SELECT unnest([(1440, 768), (1440, 375), (768, 375)]) AS w), e AS (SELECT p_partkey AS page_id, p_size AS s, w[1] AS vb, w[2] AS vs FROM part, v)
    SELECT page_id, vb::BIGINT AS big_width, vs::BIGINT AS small_width, 'typography' AS category FROM e WHERE s % 2 = 0 UNION ALL
    SELECT page_id, vb, vs, 'layout' FROM e WHERE vb = 1440 AND s >= 10 UNION ALL SELECT page_id, vb, vs, 'visibility' FROM e WHERE vs = 375 AND s > 25""",
)
def pg_32(spark, d):
    w, s = F.col("viewport_width"), F.col("p_size")
    e = part(spark, d).select(F.col("p_partkey").alias("page_id"), "p_size", F.explode(F.array(*[F.lit(x) for x in (1440, 768, 375)])).alias("viewport_width"))
    e = e.select(
        "page_id", F.lit("h1").alias("selector"), "viewport_width",
        F.when(s % 2 == 0, F.when(w == 1440, 48.0).when(w == 768, 36.0).otherwise(24.0)).otherwise(24.0).alias("font_size"),
        F.when((w == 375) & (s > 25), "none").otherwise("block").alias("display"), F.lit("visible").alias("visibility"), F.lit(1.0).alias("opacity"),
        F.when((w == 1440) & (s >= 10), 3).otherwise(1).alias("grid_columns"), F.lit("row").alias("flex_direction"),
        F.lit(1000).alias("scroll_height"), F.lit("bar").alias("nav_type"), F.lit(16.0).alias("margin"),
    )
    out = quality.responsive_differences(e)
    return out.select("page_id", big("big_width", "big_width"), big("small_width", "small_width"), "category")


@query(
    "pg_33_responsive_quality",
    """
    SELECT p_partkey AS page_id, floor(avg(30.0 * p_size / (p_size + w) + 20 + CASE WHEN w = 1 THEN 20 ELSE 10 END + 20 * least(1.0, 2.0 / (2 + w))) + 0.5)::BIGINT AS score
    FROM part, (VALUES (1), (2), (3)) AS v(w) GROUP BY 1""",
)
def pg_33(spark, d):
    v = part(spark, d).select(F.col("p_partkey").alias("page_id"), "p_size", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("w"))
    v = v.select(
        "page_id", F.col("p_size").alias("touch_passed"), F.col("w").alias("touch_failed"), F.lit(True).alias("font_size_ok"), F.lit(True).alias("line_length_ok"), F.lit(False).alias("line_height_ok"),
        F.lit(False).alias("horizontal_scroll"), (F.col("w") - 1).alias("overflow_elements"), F.lit(2).alias("srcset_images"), F.lit(0).alias("picture_images"), F.col("w").alias("missing_responsive"),
    )
    return quality.responsive_quality(v)


@query("pg_34_layout_structure", "SELECT p_partkey AS page_id, 'css-grid' AS grid_system, 3::BIGINT AS columns, 16.0::DOUBLE AS usual_gap, 8.0::DOUBLE AS base_unit FROM part")
def pg_34(spark, d):
    out = styles.layout_structure(styles.rule_blocks(styled(spark, d), about=styles.LAYOUT_WORDS))
    return out.select("page_id", "grid_system", big("columns", "columns"), "usual_gap", "base_unit")


@query("pg_35_mood")
def pg_35(spark, d):
    p = styled(spark, d)
    v = styles.variables(p).filter("category = 'color'").groupBy("page_id").agg(F.collect_list("value").alias("color_values"))
    ty = styles.typography(styles.rule_blocks(p, about=styles.TYPE_WORDS)).select("page_id", F.col("families").alias("font_families"), F.col("sizes").alias("n_font_sizes"))
    m = motion.motions(p).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_motions"), F.avg("duration").alias("avg_duration"))
    out = quality.mood(v.join(ty, "page_id").join(m, "page_id"))
    return out.select("page_id", "mood", "emotion", "type_style", "pace", "hierarchy", "formality", r6("energy", "energy"))


@query(
    "pg_36_feature_merge",
    """
    SELECT id, CASE WHEN id % 3 <> 2 THEN 'computed' ELSE 'seen' END AS theme_source, round(CASE WHEN id % 3 = 0 THEN (1.2 * 0.9 + 1.0 * 0.6) / 2.2 WHEN id % 3 = 1 THEN (1.2 * 0.9 + 0.5 * 0.5) / 1.7 * 0.9 ELSE (1.0 * 0.7 + 1.0 * 0.6) / 2.0 END, 6)::DOUBLE AS confidence FROM
      (SELECT p_partkey AS id FROM part)""",
)
def pg_36(spark, d):
    ids = part(spark, d).select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 3).alias("m"))
    computed = ids.filter("m <> 2").select("id", F.lit("dark").alias("theme"), F.lit(0.9).alias("theme_confidence"), F.lit(None).cast("string").alias("mood"), F.lit(None).cast("double").alias("mood_confidence"))
    seen = ids.filter("m <> 1").select("id", F.lit("light").alias("theme"), F.lit(0.7).alias("theme_confidence"), F.lit("calm").alias("mood"), F.lit(0.6).alias("mood_confidence"))
    return quality.merge_features(computed, seen, "id", ["theme", "mood"]).select("id", "theme_source", r6("confidence", "confidence"))


@query(
    "pg_37_robots",
    r"""
    SELECT page_id, NOT starts_with(path, '/fr/') AND NOT starts_with(path, '/en/9') AND host NOT LIKE '%cheap-pills%' AS allowed FROM
      (SELECT page_id, lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)""",
)
def pg_37(spark, d):
    from webfacts.functions.url import url_host, url_path

    u = pages(spark, d).select("page_id", F.col("page_id").cast("string").alias("url"), url_host("url").alias("host"), url_path("url").alias("path"))
    hosts = u.filter(~F.col("host").contains("cheap-pills")).select("host").distinct()
    rule = F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(a).alias("allow")) for p, a in (("/", False), ("/en/", True), ("/de/", True), ("/es/", True), ("/en/9", False))])).alias("r")
    rules = hosts.select("host", rule).select("host", "r.*")
    out = quality.robots_allowed(u, rules, hosts)
    return out.select(F.col("url").cast("long").alias("page_id"), "allowed")


@query(
    "pg_38_brief_check",
    """
    SELECT c_custkey, (10 + CASE WHEN c_acctbal > 0 THEN 20 ELSE 0 END + 10 + CASE WHEN c_nationkey % 2 = 0 THEN 15 ELSE 0 END)::BIGINT AS completeness FROM customer""",
)
def pg_38(spark, d):
    c = t(spark, d, "customer")
    none = F.lit(None).cast("string")
    briefs = c.select(
        "c_custkey", F.col("c_name").alias("project_name"), F.when(F.col("c_acctbal") > 0, F.rpad("c_name", 60, "x")).alias("description"), F.lit("short").alias("target_audience"),
        F.col("c_mktsegment").alias("industry"), F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("calm"))).alias("tone"), none.alias("color_preferences"),
        F.array().cast("array<string>").alias("references"), F.array().cast("array<string>").alias("constraints"),
    )
    return quality.brief_check(briefs, "c_custkey")[0].select("c_custkey", big("completeness", "completeness"))


# --- scores --------------------------------------------------------------------------------------------


@query(
    "sc_01_overall",
    """
    SELECT p_partkey, o AS overall, CASE WHEN o >= 90 THEN 'A' WHEN o >= 80 THEN 'B' WHEN o >= 70 THEN 'C' WHEN o >= 60 THEN 'D' ELSE 'F' END AS grade FROM
      (SELECT p_partkey, floor((p_size * 2 * 0.35 + (p_partkey % 101) * 0.4 + (p_partkey * 7 % 101) * 0.25)::DOUBLE * 100 + 0.5) / 100 AS o FROM part)""",
)
def sc_01(spark, d):
    k = F.col("p_partkey")
    rows = part(spark, d).select("p_partkey", (F.col("p_size") * 2).alias("originality"), (k % 101).alias("craftsmanship"), (k * 7 % 101).alias("contextuality"))
    return scoring.overall(rows).select("p_partkey", "overall", "grade")


TYPES_SQL = "list_distinct(list(CASE l_returnflag WHEN 'A' THEN 'hero' WHEN 'N' THEN 'feature' ELSE 'gallery' END))"


@query(
    "sc_02_layout_originality",
    f"""
    SELECT l_orderkey, least(100, CASE WHEN len(ty) >= 6 THEN 50 WHEN len(ty) >= 4 THEN 35 WHEN len(ty) >= 3 THEN 25 ELSE 15 END + 6 * len(list_intersect(ty, ['hero', 'feature', 'testimonial', 'pricing', 'cta'])) + CASE WHEN n >= 6 THEN 20 WHEN n >= 4 THEN 15 ELSE 10 END)::BIGINT AS score
    FROM (SELECT l_orderkey, {TYPES_SQL} AS ty, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def sc_02(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "hero").when(F.col("l_returnflag") == "N", "feature").otherwise("gallery")
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(kind).alias("types"), F.count(F.lit(1)).alias("n"))
    return rows.select("l_orderkey", big(scoring.layout_originality(F.col("types"), F.col("n")), "score"))


def design_rows(spark, d):
    """Design facts of the scores, spread over their bands by part attributes."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return part(spark, d).select(
        "p_partkey",
        (s % 7).alias("palette"), (s % 2 == 0).alias("has_accent"), (s % 5).alias("roles"), (F.lit(1.0) + s / 5).alias("contrast"),
        F.array_distinct(F.array(F.lit("hero"), F.when(s > 10, "feature").otherwise("hero"), F.when(s > 20, "pricing").otherwise("hero"))).alias("types"), (s % 8).alias("n_sections"),
        (s % 3).alias("custom_fonts"), (s % 5).alias("weights"), (s % 6).alias("scale"), (k % 101).alias("cliche"),
        F.when(s % 3 == 0, "grid").when(s % 3 == 1, "flex").otherwise("none").alias("grid"), (s % 14).alias("columns"), (s % 2 == 0).alias("gutter"), (s % 5 == 0).alias("max_width"),
        (s % 4 + 1).alias("fonts"), (s / 100).alias("ratio_variance"), (F.lit(1.0) + s / 50).alias("line_height"), F.when(s > 5, s * 2).alias("accent_distance"),
        F.when(s > 3, s * 4).alias("section_gap"), s.alias("element_gap"), (s % 2 == 1).alias("gap_ratio_ok"), F.when(s > 2, s % 5).alias("breakpoints"), (s % 6).alias("adaptations"),
        F.when(s % 3 == 0, "saas").when(s % 3 == 1, "Blog").alias("industry"), F.when(s % 2 == 0, "young developers").alias("audience"),
        F.array(F.lit("Inter"), F.when(s > 25, "JetBrains Mono").otherwise("Arial")).alias("fonts_list"), F.array(F.lit("#AAA"), F.lit("#bbb")).alias("section_colors"),
        F.array(F.lit("#aaa")).alias("palette_colors"), (s > 10).alias("has_dominant"), (s % 8 + 10).alias("body_px"),
    )


@query(
    "sc_02_originality",
    """
    WITH x AS (SELECT p_partkey, p_size AS s, CASE WHEN p_size > 20 THEN 3 WHEN p_size > 10 THEN 2 ELSE 1 END AS nt FROM part),
    y AS (SELECT p_partkey, CASE WHEN s % 7 = 0 THEN 30 ELSE least(100, CASE WHEN s % 7 >= 5 THEN 40 WHEN s % 7 >= 3 THEN 25 ELSE 10 END + CASE WHEN s % 2 = 0 THEN 20 ELSE 0 END + least(5 * (s % 5), 20) + CASE WHEN 1 + s / 5.0 >= 4.5 THEN 20 ELSE 0 END) END AS c,
      CASE WHEN s % 8 = 0 THEN 30 ELSE CASE WHEN nt >= 3 THEN 25 ELSE 15 END + 6 * nt + CASE WHEN s % 8 >= 6 THEN 20 WHEN s % 8 >= 4 THEN 15 ELSE 10 END END AS l,
      CASE s % 3 WHEN 2 THEN 40 WHEN 1 THEN 25 ELSE 10 END + CASE WHEN s % 5 >= 4 THEN 30 WHEN s % 5 >= 3 THEN 20 ELSE 10 END + CASE WHEN s % 6 >= 5 THEN 30 WHEN s % 6 >= 3 THEN 20 ELSE 10 END AS ty FROM x)
    SELECT p_partkey, floor((0.2 * c + 0.25 * l + 0.2 * ty + 0.35 * (p_partkey % 101))::DOUBLE * 100 + 0.5) / 100 AS originality FROM y""",
)
def sc_02b(spark, d):
    return scoring.originality(design_rows(spark, d)).select("p_partkey", "originality")


@query(
    "sc_03_craftsmanship",
    """
    WITH x AS (SELECT p_partkey, p_size AS s FROM part),
    y AS (SELECT p_partkey, (CASE s % 3 WHEN 0 THEN 30 WHEN 1 THEN 25 ELSE 10 END + CASE WHEN s % 14 >= 12 THEN 30 WHEN s % 14 >= 6 THEN 20 WHEN s % 14 > 0 THEN 10 ELSE 0 END + CASE WHEN s % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN s % 5 = 0 THEN 20 ELSE 0 END)::BIGINT AS grid_score,
      (CASE s % 4 + 1 WHEN 1 THEN 30 WHEN 2 THEN 30 WHEN 3 THEN 20 ELSE 10 END + CASE WHEN s % 6 >= 4 THEN CASE WHEN s < 10 THEN 40 WHEN s < 30 THEN 30 ELSE 20 END ELSE 15 END + CASE WHEN s BETWEEN 20 AND 35 THEN 30 WHEN s BETWEEN 10 AND 50 THEN 20 ELSE 10 END)::BIGINT AS consistency_score,
      (CASE WHEN 1 + s / 5.0 >= 7 THEN 40 WHEN 1 + s / 5.0 >= 4.5 THEN 30 WHEN 1 + s / 5.0 >= 3 THEN 20 ELSE 10 END + CASE WHEN s <= 5 THEN 15 WHEN s * 2 > 50 THEN 30 WHEN s * 2 > 30 THEN 20 ELSE 10 END + 30)::BIGINT AS harmony_score,
      (CASE WHEN s <= 3 THEN 50 ELSE CASE WHEN s * 4 BETWEEN 60 AND 120 THEN 40 WHEN s * 4 BETWEEN 40 AND 150 THEN 25 ELSE 15 END + CASE WHEN s BETWEEN 16 AND 40 THEN 30 WHEN s >= 8 THEN 20 ELSE 10 END + CASE WHEN s % 2 = 1 THEN 30 ELSE 15 END END)::BIGINT AS whitespace_score,
      (CASE WHEN s <= 2 THEN 30 ELSE CASE s % 5 WHEN 4 THEN 50 WHEN 3 THEN 40 WHEN 2 THEN 25 WHEN 1 THEN 15 ELSE 0 END + CASE WHEN s % 6 >= 4 THEN 50 WHEN s % 6 = 3 THEN 40 WHEN s % 6 = 2 THEN 30 WHEN s % 6 = 1 THEN 20 ELSE 0 END END)::BIGINT AS responsive_score FROM x)
    SELECT *, floor((grid_score + consistency_score + harmony_score + whitespace_score + responsive_score)::DOUBLE * 0.2 * 100 + 0.5) / 100 AS craftsmanship FROM y""",
)
def sc_03(spark, d):
    return scoring.craftsmanship(design_rows(spark, d)).select("p_partkey", *[big(f"{c}_score", f"{c}_score") for c in ("grid", "consistency", "harmony", "whitespace", "responsive")], "craftsmanship")


@query(
    "sc_04_contextuality",
    """
    WITH x AS (SELECT p_partkey, p_size AS s, CASE WHEN p_size > 20 THEN 3 WHEN p_size > 10 THEN 2 ELSE 1 END AS nt FROM part),
    y AS (SELECT p_partkey, CASE s % 3 WHEN 0 THEN greatest(40, floor(nt * 100.0 / 6 + 0.5)) WHEN 1 THEN greatest(40, floor(least(nt, 2) * 100.0 / 5 + 0.5)) ELSE 60 END::BIGINT AS industry_score,
      CASE WHEN s % 2 = 0 THEN least(100, 60 + CASE WHEN s > 25 THEN 20 ELSE 0 END + 20 + 10) ELSE 60 END::BIGINT AS audience_score, (25 + CASE WHEN s > 10 THEN 30 ELSE 0 END + 20)::BIGINT AS brand_score,
      (CASE WHEN 1 + s / 5.0 >= 7 THEN 60 WHEN 1 + s / 5.0 >= 4.5 THEN 45 WHEN 1 + s / 5.0 >= 3 THEN 25 ELSE 10 END + CASE WHEN s % 8 + 10 >= 16 THEN 20 WHEN s % 8 + 10 >= 14 THEN 10 ELSE 0 END
        + CASE WHEN s >= 25 THEN 20 WHEN s >= 15 THEN 10 ELSE 0 END)::BIGINT AS access_score FROM x)
    SELECT *, floor((industry_score * 0.3 + audience_score * 0.25 + brand_score * 0.25 + access_score * 0.2)::DOUBLE * 100 + 0.5) / 100 AS contextuality FROM y""",
)
def sc_04(spark, d):
    return scoring.contextuality(design_rows(spark, d)).select("p_partkey", *[big(c, c) for c in ("industry_score", "audience_score", "brand_score", "access_score")], "contextuality")


@query(
    "sc_05_findings",
    """
    SELECT p_partkey, part, score::DOUBLE AS score, CASE WHEN score >= 70 THEN 'strength' ELSE 'weakness' END AS kind FROM
      (SELECT p_partkey, 'originality' AS part, p_size * 2 AS score FROM part UNION ALL SELECT p_partkey, 'craftsmanship', p_partkey % 101 FROM part) WHERE score >= 70 OR score < 50""",
)
def sc_05(spark, d):
    rows = part(spark, d).select("p_partkey", (F.col("p_size") * 2).alias("originality"), (F.col("p_partkey") % 101).alias("craftsmanship"))
    return scoring.findings(rows, "p_partkey", ["originality", "craftsmanship"]).select("p_partkey", "part", "score", "kind")


def contexts(spark, d):
    s = F.col("p_size")
    section = lambda kind, y, h, heads, grads: F.struct(F.lit(kind).alias("type"), F.lit(y).alias("start_y"), h.cast("double").alias("height"), heads.alias("n_headings"), grads.alias("gradient_colors"))
    return part(spark, d).select(
        "p_partkey",
        F.array(section("hero", 0, F.lit(100), F.lit(1), s % 4), section("feature", 100, F.lit(100), s % 4, F.lit(0)), section("footer", 200, F.lit(100) + s % 3, F.lit(0), F.lit(0))).alias("sections"),
        F.array(F.lit("#ff0000"), F.when(s % 2 == 0, "#00ff00").otherwise("#808080")).alias("palette"),
        F.array(F.lit("impact"), F.when(s % 5 == 0, "comic sans ms").otherwise("arial")).alias("fonts"),
        F.lit(None).cast("int").alias("columns"),
    )


CLICHES = """
    SELECT p_partkey, 'excessive-gradients' AS pattern, 0.8::DOUBLE AS weight, 0.5::DOUBLE AS confidence FROM part WHERE p_size % 4 = 3 UNION ALL
    SELECT p_partkey, 'unrealistic-colors', 0.9, 2.0 / 3 FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'stock-photo-composition', 0.7, 0.8 FROM part WHERE p_size % 4 = 3 UNION ALL
    SELECT p_partkey, 'font-mismatch', 0.5, 1.0 FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'artificial-whitespace', 0.3, CASE WHEN p_size % 3 = 0 THEN 0.9 ELSE 0.6 END FROM part"""


@query("sc_06_cliches", f"SELECT p_partkey, pattern, round(confidence, 6) AS confidence FROM ({CLICHES})")
def sc_06(spark, d):
    return scoring.ClicheRegistry().detect(contexts(spark, d), "p_partkey").select("p_partkey", "pattern", r6("confidence", "confidence"))


@query("sc_07_cliche_score", f"SELECT p_partkey, floor(greatest(0, 100 - sum(weight * confidence) / 5 * 100) + 0.5)::BIGINT AS cliche FROM ({CLICHES}) GROUP BY 1")
def sc_07(spark, d):
    c = contexts(spark, d)
    return scoring.cliche_score(c, scoring.ClicheRegistry().detect(c, "p_partkey"), "p_partkey")


@query(
    "sc_08_equal_heights",
    "SELECT l_suppkey, CASE WHEN count(*) < 3 THEN 0.0 WHEN min(l_quantity + 200) = max(l_quantity + 200) THEN 0.9 WHEN stddev_pop(l_quantity + 200) < 0.1 * avg(l_quantity + 200) THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM lineitem GROUP BY 1",
)
def sc_08(spark, d):
    rows = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_quantity") + 200).alias("height"))
    return scoring.equal_height_pages(rows, "l_suppkey", "height")


@query(
    "sc_09_html_quality",
    r"""
    WITH m AS (SELECT page_id, 80::BIGINT AS o, (65 + 5 * regexp_matches(html, '(?i)<header[^>]*>')::INT + 5 * regexp_matches(html, '(?i)<main[^>]*>')::INT + 5 * regexp_matches(html, '(?i)<nav[^>]*>')::INT + 3 * regexp_matches(html, '(?i)<footer[^>]*>')::INT
      + 2 * regexp_matches(html, '(?i)<section[^>]*>')::INT + 2 * regexp_matches(html, '(?i)<article[^>]*>')::INT + 3 * regexp_matches(html, '(?i)<html[^>]*lang=')::INT)::BIGINT AS c FROM pages)
    SELECT page_id, o AS originality, c AS craftsmanship, 70::BIGINT AS contextuality, floor((o * 0.35 + c * 0.4 + 70 * 0.25)::DOUBLE * 100 + 0.5) / 100 AS overall FROM m""",
)
def sc_09(spark, d):
    out = scoring.html_quality(pages(spark, d))
    return out.select("page_id", big("originality", "originality"), big("craftsmanship", "craftsmanship"), big("contextuality", "contextuality"), "overall")


#: Markup that is put behind the given pages in turn, so that the adjustments they never earn are scored too.
ADDED_MARKUP = [
    "<p>plain</p>",
    "<style>a{color:#aa0001;background:#aa0002;border-color:#aa0003}</style>",
    "<style>a{color:#007bff;background:#28a745;border-color:#333333}</style>",
    "<style>b{font-family:Inter}</style>",
    "<style>b{font-family:Arial, serif}</style>",
    '<div style="grid-template-areas: subgrid"></div>',
    "<style>c{transition:a 1s, b 2s, c 3s}</style>",
    "<style>c{transition:a 1s, b 2s}</style>",
    '<svg><path d="M0"/></svg>',
    "<div></div>" * 11,
    "<div></div>" * 10,
    "<button>go</button> contact us",
    "developer documentation for business",
    '<img src="a.png"><img src="b.png" alt="b">',
    '<img src="a.png" alt="a" loading="lazy" width="4" height="4">',
    '<a href="#main" onclick="x()" tabindex="0" aria-label="skip">Skip</a><div aria-live="polite"></div>',
    "<style>@media (max-width: 9px){x{display:grid;gap: 4px;aspect-ratio: 4/3}}@container (x){y{object-fit: cover}}</style>",
    "<style>@keyframes a{}z{background:linear-gradient(1deg, #667eea, #764ba2);border-radius: 9999px}</style>Transform your business",
    "<style>@keyframes a{}@keyframes b{}:root{--color-a: #010203;--color-b: #040506;--color-c: #070809}</style>get started today",
    "<style>q{color:var(--a);margin:var(--b);gap:var(--c);top:var(--d);left:var(--e);clip-path: circle(4px)}</style>",
]


def _quality_sql(industry: str, audience: str) -> str:
    """The rule tables as DuckDB expressions over ``h``, the page in lower case."""
    text = lambda p: "'" + p.replace("'", "''") + "'"
    hit = lambda p: f"regexp_matches(h, {text(p)})"
    times = lambda p: f"len(regexp_extract_all(h, {text(p)}))"
    when = lambda c, n: f"CASE WHEN {c} THEN {n} ELSE 0 END"
    some = lambda marks: "(" + " OR ".join(map(hit, marks)) + ")"
    axis = lambda name: [when(hit(p), n) for a, n, p in P.HTML_QUALITY if a == name]
    terms = lambda name, table: [when(" AND ".join(map(hit, found)), n) for names, n, found in table if name in names]
    penalty, most, least = P.DIV_OVERUSE
    semantic = "<(header|main|nav|footer|section|article|aside)[^>]*>"
    images = "regexp_extract_all(h, '<img[^>]*>')"
    craft = axis("craftsmanship") + [
        f"CASE WHEN len({images}) = 0 THEN 0 WHEN len(list_filter({images}, lambda x: contains(x, 'alt='))) = len({images}) THEN 5 ELSE -5 END",
        f"-3 * {times('onclick=')}", when(f"{times('<div[^>]*>')} > {most} AND {times(semantic)} < {least}", -penalty),
    ]
    # a family counts as own unless a common name follows the colon at once
    common = "font-family:(?:arial|helvetica|times|georgia|verdana|system-ui|sans-serif|serif|monospace)['\";\\s,]"
    listed = ", ".join(text(c) for c in P.COMMON_COLORS)
    earned = {
        "colors": f"len(list_filter(list_distinct(regexp_extract_all(h, '#[0-9a-f]{{6}}')), lambda x: x NOT IN ({listed}))) >= 3",
        "fonts": some(P.FONT_MARKS[:-1]) + f" OR {times('font-family:')} > {times(common)}",
        "layout": some(P.LAYOUT_MARKS) + " OR len(list_filter(regexp_extract_all(h, 'grid-template-areas:\\s*[\"''][^\"'']+[\"'']'), lambda x: len(regexp_extract_all(x, '[\"'']')) >= 6)) > 0",
        "motion": some(P.MOTION_MARKS) + f" OR {times('@keyframes\\s+[a-z]')} >= 2 OR len(list_filter(regexp_extract_all(h, 'transition:\\s*([^;]+)'), lambda x: len(regexp_extract_all(x, ',')) >= 2)) > 0",
        "graphics": some(P.GRAPHICS_MARKS),
    }
    own = [when(c, P.ORIGINAL_POINTS[n]) for n, c in earned.items()] + [when(f"{times('(?i)' + p)} >= {n}", points) for points, p, n in P.ORIGINALITY_MARKS]
    own += [when(times("@keyframes\\s+[a-z]") + " = 1", 3)] + [when(hit(p), -P.CLICHE_PENALTY[level][0]) for level, p in P.CLICHE_MARKS if level != "low"]
    fit = axis("contextuality") + [when(" AND ".join(f"contains(h, '<{x}')" for x in ("header", "main", "footer")), 5)] + terms(industry, P.INDUSTRY_TERMS) + terms(audience, P.AUDIENCE_TERMS)
    scores = [f"least(100, greatest(0, {P.HTML_BASE[name]} + {' + '.join(parts)}))::BIGINT AS {name}" for name, parts in (("originality", own), ("craftsmanship", craft), ("contextuality", fit))]
    added = ", ".join(text(m) for m in ADDED_MARKUP)
    return f"SELECT page_id, {', '.join(scores)} FROM (SELECT page_id, lower(html || [{added}][page_id % {len(ADDED_MARKUP)} + 1]) AS h FROM pages)"


@query("sc_09b_quality_adjustments", _quality_sql("tech", "business"))
def sc_09b(spark, d):
    added = F.element_at(F.array(*[F.lit(m) for m in ADDED_MARKUP]), (F.col("page_id") % len(ADDED_MARKUP) + 1).cast("int"))
    out = scoring.html_quality(pages(spark, d).withColumn("html", F.concat("html", added)), industry="tech", audience="business")
    return out.select("page_id", *[big(c, c) for c in ("originality", "craftsmanship", "contextuality")])


@query(
    "sc_10_visual_density",
    """
    SELECT p_partkey, floor(CASE WHEN m = 0 THEN 0 WHEN d < 0.5 THEN d * 80 WHEN d < 1 THEN 40 + (d - 0.5) * 40 WHEN d < 2 THEN 60 + (d - 1) * 20 WHEN d < 3 THEN 80 + (d - 2) * 15 ELSE least(100, 95 + (d - 3) * 2) END + 0.5)::BIGINT AS score
    FROM (SELECT p_partkey, p_size % 9 AS m, (p_size % 9) / greatest(p_partkey % 5, 1)::DOUBLE AS d FROM part)""",
)
def sc_10(spark, d):
    return part(spark, d).select("p_partkey", big(scoring.visual_density(F.col("p_size") % 9, F.col("p_partkey") % 5), "score"))


@query("sc_11_visual_design")
def sc_11(spark, d):
    return scoring.visual_design(styled(spark, d))


@query(
    "sc_12_narrative_confidence",
    """
    WITH x AS (SELECT p_partkey, CASE WHEN s % 3 = 0 THEN 0.9 * (0.7 + 0.3 * 0.5) WHEN s % 3 = 1 THEN 0.4 ELSE 0.3 END AS v, least(1, 0.2 + least(1, s / 50.0) * 0.5 + least(1, 10 / 20.0) * 0.3) AS st,
      least(1, CASE WHEN s % 12 > 0 THEN 0.3 ELSE 0 END + least(1, (s % 12) / 10.0) * 0.5 + least(1, 3 / 5.0) * 0.2) AS mk, least(1, 0.3 + least(1, s / 20.0) * 0.4 + 0.2) AS mo FROM (SELECT p_partkey, p_size AS s FROM part)),
    y AS (SELECT p_partkey, v * 0.4 + st * 0.2 + mk * 0.25 + mo * 0.15 AS c FROM x)
    SELECT p_partkey, round(c::DOUBLE, 6) AS confidence, CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' WHEN c >= 0.4 THEN 'low' ELSE 'insufficient' END AS level FROM y""",
)
def sc_12(spark, d):
    s = F.col("p_size")
    rows = part(spark, d).select(
        "p_partkey", (s % 3 == 0).alias("vision_used"), F.lit(0.9).alias("vision_confidence"), (s % 3 == 1).alias("vision_fallback"), F.lit(0.5).alias("vision_completeness"), s.alias("n_variables"),
        F.lit(10).alias("n_type_styles"), F.lit(None).cast("double").alias("token_confidence"), (s % 12).alias("n_sections"), F.lit(3).alias("n_section_types"), F.lit(None).cast("double").alias("layout_completeness"),
        s.alias("n_motions"), F.lit(True).alias("all_reduced"), F.lit(False).alias("all_levels"),
    )
    return scoring.narrative_confidence(rows).select("p_partkey", r6("confidence", "confidence"), "level")


def _context_sql() -> str:
    """The shipped dictionaries as DuckDB lists: hits per entry, the first best entry counts from 0.5 on."""

    def scores(table: dict) -> str:
        hits = lambda words: " + ".join(f"contains(q, '{w}')::INT" for w in words)
        return "[" + ", ".join(f"(({hits(words)}) * {weight})::DOUBLE" for weight, words in table.values()) + "]"

    names = lambda table: "[" + ", ".join(f"'{k}'" for k in table) + "]"
    return f"""
    WITH q AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS q FROM documents),
    h AS (SELECT doc_id, {scores(INDUSTRIES)} AS a, {scores(STYLES)} AS b FROM q),
    m AS (SELECT doc_id, a, b, list_max(a) AS i, list_max(b) AS s FROM h)
    SELECT doc_id, CASE WHEN i >= 0.5 THEN {names(INDUSTRIES)}[list_position(a, i)] END AS industry, CASE WHEN s >= 0.5 THEN {names(STYLES)}[list_position(b, s)] END AS style,
      round((CASE WHEN i < 0.5 AND s < 0.5 THEN 0 WHEN s < 0.5 THEN 0.5 + least(0.2, 0.1 * i) WHEN i < 0.5 THEN 0.5 + least(0.2, 0.1 * s) ELSE 0.65 + least(0.2, 0.1 * i) + least(0.1, 0.05 * s) END)::DOUBLE, 6) AS confidence FROM m"""


@query("sc_13_query_context", _context_sql())
def sc_13(spark, d):
    q = t(spark, d, "documents").select("doc_id", "text")
    return scoring.infer_context(q, "text").select("doc_id", "industry", "style", r6("confidence", "confidence"))


@query(
    "sc_14_batch_evaluation",
    "SELECT p_partkey AS page_id, 86::BIGINT AS originality, 100::BIGINT AS craftsmanship, 78::BIGINT AS contextuality, 89.6::DOUBLE AS overall, 'B' AS grade FROM part",
)
def sc_14(spark, d):
    out = scoring.evaluate_batch(styled(spark, d))
    return out.select("page_id", big("originality", "originality"), big("craftsmanship", "craftsmanship"), big("contextuality", "contextuality"), "overall", "grade")


# --- series and vectors that need page facts -----------------------------------------------------------


def frames(spark, d):
    """A frame series per user: position and size of a region derived from the event."""
    e = t(spark, d, "events")
    i = F.col("event_id")
    box = F.struct((i % 700).cast("double").alias("x"), (i * 3 % 500).cast("double").alias("y"), F.lit(200.0).alias("width"), (F.lit(50.0) + i % 50).alias("height"))
    return e.select("user_id", F.col("event_id").alias("frame"), (F.col("value") / 100).alias("change"), F.array(box).alias("regions"))


SHIFT_SQL = """
  b AS (SELECT user_id, event_id AS frame, (event_id % 700)::DOUBLE AS x, (event_id * 3 % 500)::DOUBLE AS y, 200.0::DOUBLE AS w, (50 + event_id % 50)::DOUBLE AS h, value / 100 AS ch FROM events),
  l AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY frame) AS px, lag(y) OVER (PARTITION BY user_id ORDER BY frame) AS py FROM b),
  s AS (SELECT user_id, frame, least(1, greatest(0, least(1440, x + w) - greatest(0, x)) * greatest(0, least(900, y + h) - greatest(0, y)) / (1440 * 900.0)) * least(1, greatest(0, coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)) / 1440, ch * 0.1))) AS cls FROM l)"""


@query("ts_01_layout_shift", f"WITH {SHIFT_SQL} SELECT user_id, frame, round(cls, 6) AS cls FROM s")
def ts_01(spark, d):
    return series.shift_scores(frames(spark, d), "user_id", "frame", "regions", "change", 1440, 900).select("user_id", "frame", r6("cls", "cls"))


def session_sql(gap: int, longest: int) -> str:
    """Frames with a shift in order; a window ends at a gap or at its largest length, one step of the recursion per frame."""
    return f"""{SHIFT_SQL},
  f AS (SELECT user_id, frame, cls, row_number() OVER w AS i, frame - lag(frame) OVER w AS step FROM s WHERE cls > 0 WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
  r AS (SELECT user_id, i, frame, cls, frame AS head FROM f WHERE i = 1 UNION ALL
    SELECT f.user_id, f.i, f.frame, f.cls, CASE WHEN f.step > {gap} OR f.frame - r.head > {longest} THEN f.frame ELSE r.head END FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1),
  sess AS (SELECT user_id, head, max(frame) AS tail, sum(cls) AS cls, count(*) AS shifts FROM r GROUP BY 1, 2)"""


@query(
    "ts_02_sequence_shift",
    f"""
    WITH RECURSIVE {session_sql(30, 150)},
    x AS (SELECT s.user_id, sum(s.cls) AS total, coalesce((SELECT max(cls) FROM sess WHERE sess.user_id = s.user_id), sum(s.cls)) AS worst FROM s GROUP BY 1)
    SELECT user_id, round(total, 6) AS total, round(worst, 6) AS worst_window, CASE WHEN worst < 0.1 THEN 'good' WHEN worst < 0.25 THEN 'needs-improvement' ELSE 'poor' END AS class FROM x""",
)
def ts_02(spark, d):
    s = series.shift_scores(frames(spark, d), "user_id", "frame", "regions", "change", 1440, 900)
    return series.sequence_shift(s, "user_id", "frame").select("user_id", r6("total", "total"), r6("worst_window", "worst_window"), "class")


@query(
    "win_09_session_windows",
    f"""WITH RECURSIVE {session_sql(200, 600)} SELECT user_id, head AS start, tail AS "end", round(cls, 6) AS cls, shifts FROM sess""",
)
def win_09b(spark, d):
    s = series.shift_scores(frames(spark, d), "user_id", "frame", "regions", "change", 1440, 900)
    out = series.session_windows(s, "user_id", "frame", "cls", "shifts", 200, 600)
    return out.select("user_id", "start", "end", r6("cls", "cls"), "shifts")


@query(
    "ts_06_directions",
    """
    WITH c AS (SELECT user_id, event_id, (event_id % 700)::DOUBLE AS x, (event_id * 3 % 500)::DOUBLE AS y FROM events),
    l AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, round(CASE WHEN degrees(atan2(dx, -dy)) < 0 THEN degrees(atan2(dx, -dy)) + 360 ELSE degrees(atan2(dx, -dy)) END, 5) AS direction, round(sqrt(dx * dx + dy * dy), 6) AS distance FROM l WHERE abs(dx) > 5 OR abs(dy) > 5""",
)
def ts_06(spark, d):
    i = F.col("event_id")
    c = t(spark, d, "events").select("user_id", "event_id", (i % 700).cast("double").alias("x"), (i * 3 % 500).cast("double").alias("y"))
    return series.directions(c, "user_id", ["event_id"], "x", "y").select("user_id", "event_id", F.round("direction", 5).alias("direction"), r6("distance", "distance"))


def _points_sql(*terms: tuple[str, float]) -> str:
    return "least(1::DOUBLE, " + " + ".join(f"CASE WHEN {c} THEN {p}::DOUBLE ELSE 0::DOUBLE END" for c, p in terms) + ")"


#: Category: its points over avg, std, per, way, jump and rnd, in the order in which ties are decided.
CATEGORY_SQL = {
    "fade": _points_sql(("avg < 0.05", 0.4), ("std < 0.02", 0.4), ("way > 0.6", 0.2)),
    "pulse": _points_sql(("per > 0.6", 0.5), ("std > 0.03", 0.3), ("avg > 0.02 AND avg < 0.2", 0.2)),
    "wave": _points_sql(("way > 0.5", 0.4), ("avg BETWEEN 0.02 AND 0.2", 0.3), ("per > 0.3 AND per < 0.8", 0.3)),
    "particle": _points_sql(("jump > 0.6", 0.4), ("avg > 0.1", 0.3), ("per < 0.3", 0.3)),
    "rotation": _points_sql(("per > 0.7", 0.5), ("avg BETWEEN 0.03 AND 0.15", 0.3), ("jump < 0.3", 0.2)),
    "parallax": _points_sql(("way > 0.7", 0.4), ("avg BETWEEN 0.01 AND 0.1", 0.4), ("jump < 0.2", 0.2)),
    "noise": _points_sql(("rnd > 0.7", 0.5), ("per < 0.3", 0.3), ("way < 0.3", 0.2)),
    "complex": "CASE WHEN avg > 0.15 OR (std > 0.05 AND per < 0.5) THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END",
}


@query(
    "ts_07_animation_category",
    f"""
    WITH e AS (SELECT user_id, value / 100 AS v, row_number() OVER w AS i, lag(value / 100) OVER w AS b, lead(value / 100) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    st AS (SELECT user_id, count(*) AS n, avg(v) AS avg, stddev_pop(v) AS std, var_pop(v) AS var FROM e GROUP BY 1),
    ch AS (SELECT user_id, count(*) FILTER (WHERE b IS NOT NULL AND f IS NOT NULL AND ((v >= b AND f >= v) OR (v <= b AND f <= v))) AS same,
        count(*) FILTER (WHERE b IS NOT NULL AND f IS NOT NULL AND ((v >= b AND f < v) OR (v < b AND f >= v))) AS turns, count(*) FILTER (WHERE abs(v - b) > 2 * avg) AS jumps
      FROM e JOIN st USING (user_id) GROUP BY 1),
    ac AS (SELECT x.user_id, lag, sum((x.v - avg) * (y.v - avg)) / ((any_value(n) - lag) * any_value(var)) AS acf
      FROM e x JOIN st USING (user_id) CROSS JOIN range(1, 21) AS g(lag) JOIN e y ON y.user_id = x.user_id AND y.i = x.i + lag WHERE var > 0 AND lag <= n // 2 GROUP BY 1, 2),
    nb AS (SELECT *, lag(acf) OVER w AS p, lead(acf) OVER w AS q FROM ac WINDOW w AS (PARTITION BY user_id ORDER BY lag)),
    lo AS (SELECT user_id, min(lag) AS low FROM nb WHERE acf < p AND acf < q GROUP BY 1),
    pk AS (SELECT user_id, max(acf) AS best FROM nb JOIN lo USING (user_id) WHERE acf > p AND acf > q AND lag > low AND acf > 0 GROUP BY 1),
    ft AS (SELECT st.user_id, avg, std, CASE WHEN least(20, n // 2) < 2 THEN 0::DOUBLE ELSE least(1::DOUBLE, coalesce(best, 0)) END AS per, CASE WHEN n < 3 THEN 0::DOUBLE ELSE same / (n - 2)::DOUBLE END AS way,
        CASE WHEN n < 2 THEN 0::DOUBLE ELSE jumps / (n - 1)::DOUBLE END AS jump, CASE WHEN n < 3 THEN 0::DOUBLE ELSE greatest(0::DOUBLE, 1 - abs(turns + 1 - (n - 1) / 2.0::DOUBLE) / ((n - 1) / 2.0::DOUBLE)) END AS rnd
      FROM st JOIN ch USING (user_id) LEFT JOIN pk USING (user_id)),
    sc AS (SELECT *, [{", ".join(CATEGORY_SQL.values())}] AS points FROM ft)
    SELECT user_id, CASE WHEN list_max(points) < 0.3 THEN 'complex' ELSE ['{"', '".join(CATEGORY_SQL)}'][list_position(points, list_max(points))] END AS category,
      round(CASE WHEN list_max(points) < 0.3 THEN points[8] ELSE list_max(points) END, 6) AS confidence, round(per, 6) AS periodicity, round(way, 6) AS directional FROM sc""",
)
def ts_07(spark, d):
    e = t(spark, d, "events").select("user_id", "event_id", (F.col("value") / 100).alias("change"))
    out = series.animation_category(series.series_features(e, "user_id", ["event_id"], "change", 20))
    return out.select("user_id", "category", r6("confidence", "confidence"), r6("periodicity", "periodicity"), r6("directional", "directional"))


@query("ts_08_visual_category")
def ts_08(spark, d):
    i = F.col("event_id")
    vec = F.struct((i % 13 - 6).cast("double").alias("dx"), (i % 7 - 3).cast("double").alias("dy"), (i % 9).cast("double").alias("magnitude"))
    box = F.struct((i % 100).cast("double").alias("x"), (i % 50).cast("double").alias("y"), (F.lit(50.0) + i % 30).alias("width"), F.lit(40.0).alias("height"))
    f = t(spark, d, "events").select("user_id", F.col("event_id").alias("frame"), (F.col("value") / 100).alias("diff"), box.alias("box"), F.array(vec).alias("vectors"))
    return series.visual_category(f, "user_id", "frame").select("user_id", "category", r6("confidence", "confidence"), r6("intensity", "intensity"))


@query(
    "ts_09_fade_events",
    """
    WITH RECURSIVE x AS (SELECT user_id, event_id AS frame, floor(((event_id % 40) / 40.0::DOUBLE + value / 5000) * 10000 + 0.5::DOUBLE) / 10000 AS a, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    y AS (SELECT *, abs(a - lag(a) OVER (PARTITION BY user_id ORDER BY i)) AS step FROM x),
    r AS (
      SELECT user_id, i, n, frame, a, NULL::STRUCT(i BIGINT, frame BIGINT, a DOUBLE, up BOOLEAN) AS open, NULL::STRUCT(i BIGINT, frame BIGINT, a DOUBLE, up BOOLEAN, last BIGINT, last_frame BIGINT, last_a DOUBLE) AS closed FROM y WHERE i = 1
      UNION ALL
      SELECT y.user_id, y.i, y.n, y.frame, y.a,
        CASE WHEN y.step >= 0.001 AND y.step > 0.1::DOUBLE * 0.1::DOUBLE AND (r.open IS NULL OR y.a = r.open.a OR (y.a > r.open.a) <> r.open.up) THEN {'i': r.i, 'frame': r.frame, 'a': r.a, 'up': y.a > r.a}
          WHEN r.open IS NULL OR y.step < 0.001 OR y.a = r.open.a OR (y.a > r.open.a) <> r.open.up THEN NULL ELSE r.open END,
        CASE WHEN r.open IS NOT NULL AND (y.step < 0.001 OR y.a = r.open.a OR (y.a > r.open.a) <> r.open.up) THEN {'i': r.open.i, 'frame': r.open.frame, 'a': r.open.a, 'up': r.open.up, 'last': r.i, 'last_frame': r.frame, 'last_a': r.a} END
      FROM r JOIN y ON y.user_id = r.user_id AND y.i = r.i + 1),
    c AS (SELECT user_id, closed FROM r WHERE closed IS NOT NULL UNION ALL
      SELECT user_id, {'i': open.i, 'frame': open.frame, 'a': open.a, 'up': open.up, 'last': i, 'last_frame': frame, 'last_a': a} FROM r WHERE i = n AND open IS NOT NULL)
    SELECT user_id, CASE WHEN closed.up THEN 'fade_in' ELSE 'fade_out' END AS type, closed.frame AS start_frame, closed.last_frame AS end_frame, round(abs(closed.last_a - closed.a), 6) AS change,
      round((closed.last - closed.i + 1) * 1000.0::DOUBLE / 30, 6) AS duration_ms FROM c WHERE closed.last - closed.i >= 2 AND abs(closed.last_a - closed.a) >= 0.1::DOUBLE""",
)
def ts_09(spark, d):
    i = F.col("event_id")
    f = t(spark, d, "events").select("user_id", F.col("event_id").alias("frame"), (F.floor(((i % 40) / 40 + F.col("value") / 5000) * 10000 + 0.5) / 10000).alias("alpha"))
    out = series.fade_events(f, "user_id", "frame", "alpha")
    return out.select("user_id", "type", "start_frame", "end_frame", r6("change", "change"), r6("duration_ms", "duration_ms"))


@query("vec_27_motion_vector")
def vec_27(spark, d):
    v = motion.motion_vector(motion.motions(styled(spark, d)))
    return v.select("page_id", "type", F.size("vector").alias("dims"), r6(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), "total"))


@query(
    "vec_29_text_form",
    """
    SELECT p_partkey AS page_id, 'passage: Animation type: transition. Name: transition-width. Trigger: hover. Duration: 250ms. Easing: ease. Iterations: 1. Properties: width' AS text FROM part
    UNION ALL SELECT p_partkey, 'passage: Animation type: animation. Name: spin' || (p_partkey % 5) || '. Trigger: load. Duration: ' || (p_size * 100) || 'ms. Easing: ease-in. Iterations: infinite. Properties: opacity, width' FROM part""",
)
def vec_29(spark, d):
    m = motion.motions(styled(spark, d))
    return m.select("page_id", embedtext.motion_text().alias("text"))


@query("vec_30_embedding")
def vec_30(spark, d):
    out = embedding.embed_texts(t(spark, d, "documents"), "doc_id", "text")
    return out.select("doc_id", F.size("embedding").alias("dims"), r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), "total"))


@query(
    "ud_01_added_rule",
    rf"""SELECT page_id, position, CASE WHEN tag = 'article' THEN 'story' ELSE 'unknown' END AS type FROM (SELECT page_id, position, lower(regexp_extract(snippet, '^<([A-Za-z]+)', 1)) AS tag FROM {SECTS})""",
)
def ud_01(spark, d):
    c = structure.with_style_facts(structure.with_content(structure.sections(pages(spark, d)))).withColumn("start_y", F.lit(0))
    return structure.classify(c, [("story", 200, 0.5, [("tag", "article", 1.0)])]).select("page_id", big("position", "position"), "type")


@query("ud_02_added_cliche", "SELECT p_partkey, 'large' AS pattern, 1.0::DOUBLE AS confidence FROM part WHERE p_size % 4 = 3")
def ud_02(spark, d):
    reg = scoring.ClicheRegistry(builtin=False)
    reg.add("large", 0.5, lambda: (F.exists("sections", lambda s: s["gradient_colors"] >= 3), F.lit(1.0)))
    return reg.detect(contexts(spark, d), "p_partkey").select("p_partkey", "pattern", "confidence")


@query("ud_03_custom_weights", "SELECT p_partkey, floor((p_size * 2 * 0.5 + (p_partkey % 101) * 0.25 + (p_partkey * 7 % 101) * 0.25)::DOUBLE * 100 + 0.5) / 100 AS overall FROM part")
def ud_03(spark, d):
    k = F.col("p_partkey")
    rows = part(spark, d).select("p_partkey", (F.col("p_size") * 2).alias("originality"), (k % 101).alias("craftsmanship"), (k * 7 % 101).alias("contextuality"))
    return scoring.overall(rows, {"originality": 2.0, "craftsmanship": 1.0, "contextuality": 1.0}).select("p_partkey", "overall")


@query("ud_04_pluggable_model", "SELECT doc_id, 1::BIGINT AS dims, length(text)::DOUBLE AS size FROM documents")
def ud_04(spark, d):
    import numpy as np

    def lengths():
        return lambda texts: np.array([[float(len(x))] for x in texts])

    out = embedding.embed_texts(t(spark, d, "documents"), "doc_id", "text", lengths)
    return out.select("doc_id", F.size("embedding").cast("long").alias("dims"), F.col("embedding")[0].cast("double").alias("size"))
