"""Column functions on hand-made values."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webfacts.functions import color, css, embedtext, score, text, url, vector
from webfacts.functions import html as H
from webfacts.functions.base import required_literal, round_half_up


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_url(spark):
    norm = lambda u: one(spark, x=url.normalize_url(F.lit(u)))["x"]
    assert norm(" HTTPS://User@WWW.Ex.com:443//a//b/?b=2&a=1&a=0#x ") == "https://www.ex.com/a/b?a=0&a=1&b=2"
    assert norm("http://a.b:8080/") == "http://a.b:8080" and norm("  nope ") == "nope"
    r = one(spark, h=url.url_host(F.lit("https://www.a.b.com/x")), p=url.url_path(F.lit("https://a.b")), s=url.host_suffixes(F.lit("a.b.c")), d=url.in_domain(F.lit("x.b.com"), "b.com"))
    assert r["h"] == "a.b.com" and r["p"] == "/" and r["s"] == ["a.b.c", "b.c", "c"] and r["d"]
    base = F.lit("https://s.com/a/b.html?q")
    got = [one(spark, x=url.absolute_url(F.lit(v), base))["x"] for v in ("c.css", "/c.css", "//d.e/f", "http://x.y/z", "mailto:a@b", "#top")]
    assert got == ["https://s.com/a/c.css", "https://s.com/c.css", "https://d.e/f", "http://x.y/z", None, None]


@settings(max_examples=15, deadline=None)
@given(host=st.from_regex(r"[A-Za-z]{1,8}\.[a-z]{2,3}", fullmatch=True), path=st.from_regex(r"(/{1,2}[a-z0-9.]{1,4}){0,3}/?", fullmatch=True), q=st.lists(st.from_regex("[a-c]=[0-9]", fullmatch=True), max_size=3))
def test_normalize_is_idempotent(spark, host, path, q):
    u = f"https://{host}{path}" + (f"?{'&'.join(q)}" if q else "")
    once = one(spark, x=url.normalize_url(F.lit(u)))["x"]
    assert one(spark, x=url.normalize_url(F.lit(once)))["x"] == once


def test_html(spark):
    page = '<h1>A <b>b</b></h1><!-- <h2>no</h2> --><script>var x="<h3>no</h3>"</script><p class="a b">t</p><h2></h2>'
    r = one(spark, t=H.html_text(F.lit(page)), h=H.headings(H.drop_unseen(F.lit(page))), c=H.class_names(F.lit(page)))
    assert r["t"] == "A b t" and [(h["level"], h["text"]) for h in r["h"]] == [(1, "A b")] and r["c"] == ["a", "b"]


def test_color(spark):
    r = one(
        spark, rgb=color.hex_to_rgb(F.lit("#3B82F6")), short=color.clean_hex(F.lit("#fff")), bad=color.hex_to_rgb(F.lit("zzz")), hsl=color.rgb_to_hsl(F.lit(255), F.lit(0), F.lit(0)),
        back=color.hsl_to_rgb(F.lit(120), F.lit(100), F.lit(50)), same=color.adjust_color(F.lit("#3B82F6"), 0, 0), white=color.hex_to_lab(F.lit("fff")), de=color.delta_e_hex(F.lit("000"), F.lit("fff")),
        con=color.contrast_ratio(color.hex_luminance(F.lit("fff")), color.hex_luminance(F.lit("000"))), neon=color.is_neon(F.lit("00ff00")), grey=color.is_neon(F.lit("888888")), none=color.color_similarity(F.lit("x"), F.lit("000")),
    )
    assert tuple(r["rgb"]) == (59, 130, 246) and r["short"] == "ffffff" and r["bad"] is None and tuple(r["hsl"]) == (0, 100, 50)
    assert tuple(r["back"]) == (0, 255, 0) and r["white"]["l"] == pytest.approx(100, abs=0.01) and r["de"] == pytest.approx(100, abs=0.1)
    assert r["con"] == pytest.approx(21) and r["neon"] and not r["grey"] and r["none"] == 0.0


def test_css_values(spark):
    r = one(
        spark, ms=css.duration_ms(F.lit(".25s")), none=css.duration_ms(F.lit("fast")), a=css.animation_shorthand(F.lit("")), tf=css.timing_function(F.lit("step-end")), k=css.keyframe_offsets(F.lit("from, 12.5%, to")),
        g=css.gradients(F.lit("repeating-linear-gradient(to right, red, blue 30%)")), mesh=css.is_mesh(F.lit("radial-gradient(a, transparent), radial-gradient(b, transparent), radial-gradient(c, d)")),
        sh=css.box_shadows(F.lit("0 2px 4px rgba(0, 0, 0, .2)")), fam=css.font_family(F.lit("'A B', serif")), custom=css.type_scale(F.lit(2.4)), near=css.type_scale(F.lit(1.33)), rem=css.size_rem(F.lit("24px")), w=css.weight_number(F.lit("bolder")), p=css.strip_prefix(F.lit("-moz-transform")),
    )
    assert r["ms"] == 250 and r["none"] == 0 and r["a"]["name"] == "none" and r["a"]["easing"] == "ease"
    assert (r["tf"]["kind"], r["tf"]["steps"], r["tf"]["jump"]) == ("steps", 1, "end") and r["k"] == [0, 0.125, 1]
    g = r["g"][0]
    assert g["repeating"] and g["angle"] == 90 and [s["position"] for s in g["stops"]] == [0, 0.3] and r["mesh"]
    assert tuple(r["sh"][0]) == (0, 2, 4, 0, "rgba(0, 0, 0, .2)", False) and r["fam"]["category"] == "serif"
    assert r["custom"]["name"] == "Custom" and r["near"]["name"] == "Perfect Fourth" and r["rem"] == 1.5 and r["w"] == 800 and r["p"] == "transform"


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    r = one(
        spark, same=vector.cosine(v(1, 2), v(1, 2)), zero=vector.cosine(v(0, 0), v(1, 2)), lit=vector.cosine_to(v(3, 4), [3, 4]), unit=vector.l2_normalize(v(3, 4)), still=vector.l2_normalize(v(0, 0)),
        one=vector.weighted_sum(v(3, 4), F.lit(None).cast("array<double>"), 0.6, 0.4), bad=vector.vector_error(v(1, math.nan), 2), at=vector.first_bad_index(v(1, math.inf)), dim=vector.vector_error(v(1), 2), dot=vector.clamped_dot(v(2, 0), v(2, 0)),
    )
    assert r["same"] == pytest.approx(1) and r["zero"] == 0 and r["lit"] == pytest.approx(1) and r["unit"] == [0.6, 0.8] and r["still"] == [0, 0]
    assert r["one"] == [0.6, 0.8] and r["bad"] == "not_finite" and r["at"] == 1 and r["dim"] == "dimension" and r["dot"] == 1


def test_text_and_scores(spark):
    r = one(
        spark, t=text.tokens(F.lit("The cat, the CAT!")), all=text.matches_all(F.array(F.lit("a")), []), q=text.prefixed(F.lit("query: x")), g=score.grade(F.lit(89.99)), half=round_half_up(F.lit(-0.5)), two=score.clamp_score(F.lit(101)),
        lv=score.similarity_level(F.lit(0.7)), d=embedtext.describe_name(F.lit("heroSection_main"), {"hero": "top"}), lab=embedtext.labelled({"A": F.lit("x"), "B": F.lit("")}),
    )
    assert r["t"] == ["cat", "cat"] and not r["all"] and r["q"] == "query: x" and r["g"] == "B" and r["half"] == 0 and r["two"] == 100
    assert r["lv"] == "medium" and r["d"] == "top section main" and r["lab"] == "A: x"
    assert text.query_terms("The cat cat dog") == ["cat", "dog"]
    assert required_literal(r"<script[^>]*(async|defer)") == "<script" and required_literal("(a|b)c") == "c"
