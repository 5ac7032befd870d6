"""Column functions on the test tables."""

from webfacts.functions import color, html, score, text, url
from webfacts.functions.base import round_half_up
from webfacts.plans.common import HEX, F, big, hex_of, r6, t
from webfacts.plans.facts import PART_LAB, URL_NORM_SQL
from webfacts.registry import query


def pages(spark, d):
    return t(spark, d, "pages")


@query("fn_01_normalize_url", f"SELECT page_id, url_norm FROM ({URL_NORM_SQL})")
def fn_01(spark, d):
    return pages(spark, d).select("page_id", url.normalize_url("url").alias("url_norm"))


@query(
    "fn_02_host_path",
    r"""
    SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)), '^www\.', '') AS host,
      CASE WHEN lower(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1)) = '' THEN '/' ELSE lower(regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1)) END AS path,
      regexp_matches(url, '^https?://([a-z0-9-]+\.)*example\.com([:/?#]|$)') AS in_com FROM pages""",
)
def fn_02(spark, d):
    return pages(spark, d).select(
        "page_id", url.url_host("url").alias("host"), url.url_path("url").alias("path"), url.in_domain(url.url_host("url"), "example.com").alias("in_com")
    )


TEXT_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace({h}, '<!--.*?-->|<(?:script|style|noscript)\b.*?</(?:script|style|noscript)\s*>', '', 'gis'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"


@query("fn_03_html_text", f"SELECT page_id, {TEXT_SQL.format(h='html')} AS text FROM pages")
def fn_03(spark, d):
    return pages(spark, d).select("page_id", html.html_text("html").alias("text"))


@query(
    "fn_04_count_matches",
    r"""
    SELECT page_id, len(regexp_extract_all(html, '(?i)<script\b[^>]*>'))::BIGINT AS scripts, len(regexp_extract_all(html, '(?i)<p\b[^>]*>'))::BIGINT AS paragraphs FROM pages""",
)
def fn_04(spark, d):
    return pages(spark, d).select(
        "page_id", html.count_matches("html", r"(?i)<script\b[^>]*>").alias("scripts"), html.count_matches("html", r"(?i)<p\b[^>]*>").alias("paragraphs")
    )


@query(
    "fn_05_keyword_flags",
    """
    SELECT page_id, contains(lower(html), 'three.js') OR contains(lower(html), 'webgl') AS webgl, contains(lower(html), 'track(') AS tracked FROM pages""",
)
def fn_05(spark, d):
    from webfacts.functions.base import any_of

    low = F.lower("html")
    return pages(spark, d).select("page_id", any_of(low, ["three.js", "webgl"]).alias("webgl"), any_of(low, ["track("]).alias("tracked"))


HEADINGS_SQL = r"""list_filter(list_transform(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>'),
  lambda x: {'level': substr(x, 3, 1)::INT, 'text': trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g'))}),
  lambda x: length(x.text) > 0 AND length(x.text) < 200)"""


@query(
    "fn_06_headings",
    f"""
    SELECT page_id, len(h)::BIGINT AS n, array_to_string(list_transform(h[1:5], lambda x: x.level || ':' || x.text), '|') AS first_five
    FROM (SELECT page_id, {HEADINGS_SQL} AS h FROM pages)""",
)
def fn_06(spark, d):
    h = html.headings("html")
    first = F.transform(F.slice("h", 1, 5), lambda x: F.concat(x["level"].cast("string"), F.lit(":"), x["text"]))
    return pages(spark, d).select("page_id", h.alias("h")).select(
        "page_id", F.size("h").cast("long").alias("n"), F.array_join(first, "|").alias("first_five")
    )


@query(
    "fn_07_attributes",
    r"""
    SELECT page_id, array_to_string(regexp_extract_all(html, '(?i)\shref="([^"]*)"', 1), '|') AS hrefs,
      array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)\sclass="([^"]*)"', 1))), '|') AS classes FROM pages""",
)
def fn_07(spark, d):
    return pages(spark, d).select(
        "page_id", F.array_join(html.attribute_values("html", "href"), "|").alias("hrefs"), F.array_join(html.class_names("html"), "|").alias("classes")
    )


@query(
    "fn_08_query_text",
    r"""SELECT item_id, 'query: ' || trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM benchmark""",
)
def fn_08(spark, d):
    return t(spark, d, "benchmark").select("item_id", text.prefixed(text.normal_query("text")).alias("q"))


TOKENS_SQL = "list_filter(regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({stop}))"
STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
DOC_TOKENS = TOKENS_SQL.format(t="text", stop=STOP_SQL)


@query("fn_09_tokens", f"SELECT doc_id, len(k)::BIGINT AS n_tokens, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {DOC_TOKENS} AS k FROM documents)")
def fn_09(spark, d):
    k = t(spark, d, "documents").select("doc_id", text.tokens("text").alias("k"))
    return k.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join("k", " ")).alias("digest"))


RGB_SQL = f"(SELECT p_partkey, hx, ('0x' || substr(hx, 1, 2))::INT AS r, ('0x' || substr(hx, 3, 2))::INT AS g, ('0x' || substr(hx, 5, 2))::INT AS b FROM (SELECT p_partkey, {HEX.format(k='p_partkey')} AS hx FROM part))"


def part_rgb(spark, d):
    p = t(spark, d, "part").select("p_partkey", hex_of("p_partkey").alias("hx"))
    return p.select("*", *[color.channel("hx", i).alias(n) for i, n in enumerate("rgb")])


@query("fn_17_hex_rgb", f"SELECT p_partkey, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b, '#' || upper(hx) AS hex FROM {RGB_SQL}")
def fn_17(spark, d):
    p = part_rgb(spark, d)
    return p.select("p_partkey", *[big(c, c) for c in "rgb"], color.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


HSL_SQL = f"""(SELECT p_partkey, r, g, b, mx, mn, mx - mn AS dl, (mx + mn) / 2 AS ll,
   CASE WHEN mx = mn THEN 0.0 WHEN mx = r / 255.0 THEN 60 * (((g - b) / 255.0 / (mx - mn) + 6) % 6)
     WHEN mx = g / 255.0 THEN 60 * ((b - r) / 255.0 / (mx - mn) + 2) ELSE 60 * ((r - g) / 255.0 / (mx - mn) + 4) END AS h
   FROM (SELECT *, greatest(r, g, b) / 255.0 AS mx, least(r, g, b) / 255.0 AS mn FROM {RGB_SQL}))"""


@query(
    "fn_18_rgb_hsl",
    f"""
    SELECT p_partkey, round(h, 6) AS h, round(CASE WHEN dl = 0 THEN 0.0 ELSE dl / (1 - abs(2 * ll - 1)) END, 6) AS s, round(ll, 6) AS l FROM {HSL_SQL}""",
)
def fn_18(spark, d):
    rgb = (F.col("r"), F.col("g"), F.col("b"))
    return part_rgb(spark, d).select("p_partkey", r6(color.hue(*rgb), "h"), r6(color.hsl_saturation(*rgb), "s"), r6(color.lightness(*rgb), "l"))


@query("fn_19_lab", PART_LAB + " SELECT key AS p_partkey, round(l, 5) AS l, round(a, 5) AS a, round(bb, 5) AS b FROM lab")
def fn_19(spark, d):
    p = t(spark, d, "part").select("p_partkey", color.hex_to_lab(hex_of("p_partkey")).alias("x"))
    return p.select("p_partkey", *[F.round(F.col("x")[c], 5).alias(c) for c in "lab"])


@query("fn_20_delta_e", PART_LAB + " SELECT key AS p_partkey, round(sqrt(pow(l - 100, 2) + pow(a - 0, 2) + pow(bb - 0, 2)), 1) AS de FROM lab")
def fn_20(spark, d):
    white = color.delta_e_to(hex_of("p_partkey"), color.lab(100, 0, 0))  # the reference white; ffffff itself has a = 0.005, b = -0.01
    return t(spark, d, "part").select("p_partkey", F.round(white, 1).alias("de"))


LUM_SQL = "(0.2126 * {0} + 0.7152 * {1} + 0.0722 * {2})".format(
    *[f"(CASE WHEN {c} / 255.0 <= 0.03928 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END)" for c in "rgb"]
)


@query("fn_21_contrast", f"SELECT p_partkey, round({LUM_SQL}, 6) AS lum, round(1.05 / ({LUM_SQL} + 0.05), 6) AS contrast FROM {RGB_SQL}")
def fn_21(spark, d):
    lum = color.luminance(F.col("r"), F.col("g"), F.col("b"))
    return part_rgb(spark, d).select("p_partkey", r6(lum, "lum"), r6(color.contrast_ratio(lum, F.lit(1.0)), "contrast"))


@query(
    "fn_22_rgb_distance",
    f"""
    SELECT p_partkey, round(sqrt(pow(r - 128, 2) + pow(g - 128, 2) + pow(b - 128, 2)), 6) AS dist, round((0.299 * r + 0.587 * g + 0.114 * b)::DOUBLE, 6) AS bright,
      CASE WHEN greatest(r, g, b) = 0 THEN false ELSE (greatest(r, g, b) - least(r, g, b)) * 1.0 / greatest(r, g, b) > 0.8 AND greatest(r, g, b) > 200 END AS neon FROM {RGB_SQL}""",
)
def fn_22(spark, d):
    return part_rgb(spark, d).select(
        "p_partkey", r6(color.rgb_distance("hx", F.lit("808080")), "dist"), r6(color.brightness("hx"), "bright"), color.is_neon("hx").alias("neon")
    )


@query(
    "fn_23_color_similarity",
    f"SELECT p_partkey, round(1 - sqrt(pow(r - 59, 2) + pow(g - 130, 2) + pow(b - 246, 2)) / sqrt(195075), 6) AS similarity FROM {RGB_SQL}",
)
def fn_23(spark, d):
    return part_rgb(spark, d).select("p_partkey", r6(color.color_similarity("hx", F.lit("#3B82F6")), "similarity"))


@query(
    "fn_27_grade",
    "SELECT p_partkey, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT p_partkey, p_size * 2 AS s FROM part)",
)
def fn_27(spark, d):
    return t(spark, d, "part").select("p_partkey", score.grade(F.col("p_size") * 2).alias("grade"))


@query(
    "fn_28_round_clamp",
    "SELECT c_custkey, least(100.0, greatest(0.0, floor(c_acctbal / 64 * 100 + 0.5) / 100)) AS score, floor(c_acctbal / 64 + 0.5)::BIGINT AS whole FROM customer",
)
def fn_28(spark, d):
    x = F.col("c_acctbal") / 64
    return t(spark, d, "customer").select("c_custkey", score.clamp_score(x).alias("score"), round_half_up(x).alias("whole"))


@query("fn_29_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def fn_29(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("fn_30_json_path", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 50")
def fn_30(spark, d):
    e = t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.filter("k >= 50")


@query("fn_31_utc_hour", "SELECT event_id, hour(ts)::BIGINT AS h, strftime(ts + INTERVAL 36 HOURS, '%Y-%m-%d') AS later FROM events")
def fn_31(spark, d):
    return t(spark, d, "events").select(
        "event_id", big(F.hour("ts"), "h"), F.date_format(F.col("ts") + F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd").alias("later")
    )
