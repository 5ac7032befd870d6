"""Page jobs on small pages."""

import pytest
from pyspark.sql import functions as F

from webfacts.operators import scoring, sections
from webfacts.pages import motion, quality, structure, styles


def page(spark, html, url="https://a.com/x/"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_innermost_landmarks_and_rules(spark):
    html = (
        '<header class="site-hero hero"><h1>Big</h1><button>Go</button></header><main><section id="pricing"><h2>Plans</h2><button>Buy</button></section>'
        '<section class="faq"><h2>Q</h2></section></main><div><footer><p>© 2024</p><a href="/x">x</a></footer></div>'
    )
    got = structure.analyzed_sections(page(spark, html)).orderBy("position").collect()
    assert [(r["tag"], r["type"]) for r in got] == [("header", "hero"), ("section", "pricing"), ("section", "faq"), ("footer", "footer")]
    assert [r["start_y"] for r in got] == [0, 80, 160, 210] and got[1]["name"] == "Pricing"
    more = structure.analyzed_sections(page(spark, html), rules=[("mine", 999, 0.5, [("tag", "section", 1.0)])])
    assert {r["type"] for r in more.collect()} == {"mine", "unknown"}


def test_single_hero_and_footer(spark):
    rows = [(1, 0, "hero", "div", 0.7, 0.0), (1, 1, "hero", "div", 0.9, 20.0), (1, 2, "hero", "div", 0.95, 80.0), (1, 3, "footer", "div", 0.9, 85.0), (1, 4, "footer", "footer", 0.5, 10.0)]
    df = spark.createDataFrame(rows, "page long, pos int, type string, tag string, confidence double, estimated_top double")
    got = {r["pos"]: (r["type"], round(r["confidence"], 3)) for r in sections.single_hero_footer(df, "page", "pos").collect()}
    assert got == {0: ("feature", 0.6), 1: ("hero", 0.9), 2: ("feature", 0.85), 3: ("unknown", 0.8), 4: ("footer", 0.5)}


def test_context_cascade(spark):
    # feature state is handed on through sections that only copy it
    base = dict(tag="div", n_links=0, n_headings=0, n_images=0, n_buttons=0, has_h1=False, has_copyright=False)
    made = [
        dict(base, type="unknown", confidence=0.0, n_links=4),
        dict(base, type="feature", confidence=0.8),
        dict(base, type="unknown", confidence=0.0, n_headings=2),
        dict(base, type="unknown", confidence=0.4, n_images=2),
        dict(base, type="cta", confidence=0.9, n_headings=3),
        dict(base, type="unknown", confidence=0.4, n_headings=2),
        dict(base, type="unknown", confidence=0.0, has_copyright=True),
    ]
    rows = [dict(r, page=1, pos=i) for i, r in enumerate(made)]
    df = spark.createDataFrame(rows)
    got = {r["pos"]: r["type"] for r in sections.relabel_by_context(df, "page", "pos").collect()}
    assert got == {0: "navigation", 1: "feature", 2: "feature", 3: "feature", 4: "cta", 5: "unknown", 6: "footer"}


def test_variables(spark):
    v = {"--a": "var(--b)", "--b": "var(--c)", "--c": "1px", "--f": "var(--none, 2px)", "--n": "var(--none, var(--c))", "--u": "var(--none)", "--x": "var(--y)", "--y": "var(--x)", "--two": "var(--c) var(--b)"}
    df = spark.createDataFrame([(1, k, val) for k, val in v.items()], "page_id long, name string, value string")
    got = {r["name"]: (r["value"], r["status"]) for r in styles.resolve_variables(df).collect()}
    assert got["--a"] == ("1px", "resolved") and got["--f"] == ("2px", "resolved") and got["--n"] == ("1px", "resolved") and got["--two"] == ("1px 1px", "resolved")
    assert got["--u"] == ("var(--none)", "unresolved") and got["--x"][1] == "failed"
    chain = spark.createDataFrame([(1, f"--v{i}", f"var(--v{i + 1})") for i in range(14)] + [(1, "--v14", "z")], "page_id long, name string, value string")
    deep = {r["name"]: r["status"] for r in styles.resolve_variables(chain).collect()}
    assert deep["--v13"] == "resolved" and deep["--v0"] == "failed"


def test_motions_and_their_facts(spark):
    css = (
        "<style>.a{animation:fadeIn 200ms linear infinite}.b{animation-name:grow;animation-duration:6s;animation-delay:1s;animation-direction:alternate;animation-timing-function:cubic-bezier(0,0,1,1)}"
        ".c:hover{transition:color .3s, box-shadow 1s}@keyframes fadeIn{from{opacity:0}to{opacity:1}}@keyframes grow{0%{width:1px}50%{width:2px}100%{width:3px}}</style>"
    )
    m = motion.motions(page(spark, css)).cache()
    rows = {r["name"]: r for r in m.collect()}
    assert rows["fadeIn"]["duration"] == 200 and [p["name"] for p in rows["fadeIn"]["properties"]] == ["opacity"]
    assert rows["grow"]["delay"] == 1000 and rows["grow"]["properties"][0]["keyframes"] == 3
    assert rows["transition-color"]["trigger"] == "hover" and [p["name"] for p in rows["transition-color"]["properties"]] == ["color", "box-shadow"]
    warned = {(r["name"], r["warning"]) for r in motion.warnings(m).collect()}
    assert warned == {("fadeIn", "rapid"), ("grow", "long"), ("grow", "layout"), ("transition-color", "shadow")}
    assert motion.complexity(m).first()["complexity"] == 21 + (3 + 12) + (3 + 2 + 7 + 5 + 3 + 3) + 6
    assert {r["name"]: r["level"] for r in motion.performance(m).collect()} == {"fadeIn": "good", "grow": "poor", "transition-color": "acceptable"}
    cats = {r["name"]: r["category"] for r in motion.motion_category(m).collect()}
    assert cats["fadeIn"] == "reveal" and cats["transition-color"] == "hover_effect"
    vec = motion.motion_vector(m).select("vector").collect()
    assert all(len(v[0]) == 64 and sum(x * x for x in v[0]) == pytest.approx(1) for v in vec)


def test_backgrounds_in_precedence(spark):
    cases = {
        ".v video": ("background:url(a.mp4)", "video_background"),
        ".n": ("background-image:url(noise.png)", "noise_texture"),
        ".g": ("background:rgba(0,0,0,.3);backdrop-filter:blur(4px)", "glassmorphism"),
        ".m": ("background:radial-gradient(a, transparent), radial-gradient(b, transparent), radial-gradient(c, d)", "mesh_gradient"),
        ".l2": ("background:linear-gradient(red, blue), url(x.png)", "multi_layer"),
        ".an": ("background:linear-gradient(red, blue);animation:move 1s", "animated_gradient"),
        ".r": ("background:radial-gradient(red, blue)", "radial_gradient"),
        ".s": ("background-image:url(x.svg)", "svg_background"),
        ".i": ("background-image:url(x.png)", "image_background"),
        ".c": ("background-color:#fff", "solid_color"),
    }
    css = "<style>" + "".join(f"{k}{{{v}}}" for k, (v, _) in cases.items()) + "</style>"
    got = {r["selector"]: r["design_type"] for r in styles.backgrounds(styles.rule_blocks(page(spark, css))).collect()}
    assert got == {k: t for k, (_, t) in cases.items()}


def test_decorations_and_type(spark):
    css = "<style>.glow{box-shadow:0 0 12px red;border-radius:3px}.glass{backdrop-filter:blur(8px);background:rgba(255, 255, 255, .2);border:1px solid}h1{font-size:40px}h2{font-size:2rem}body{font-size:16px;font-family:Inter, serif}</style>"
    rules = styles.rule_blocks(page(spark, css))
    got = {(r["selector"], r["type"]): round(r["confidence"], 2) for r in styles.decorations(rules).collect()}
    assert got == {(".glow", "glow"): 0.9, (".glow", "animated-border"): 0.7, (".glass", "glass-morphism"): 1.0}
    ty = styles.typography(rules).first()
    assert ty["families"] == ["Inter"] and (ty["h1"], ty["h2"], ty["body"]) == (2.5, 2.0, 1.0) and ty["mean_ratio"] == pytest.approx((1.25 + 2) / 2)


def test_quality_facts(spark):
    html = '<script src="three.min.js"></script><div id="root"></div><section><img src="a" alt=""><img src="b" alt="b"><svg></svg></section><link rel="stylesheet" href="s.css"><script src="http://10.0.0.1/x.js"></script>'
    p = page(spark, html)
    c = quality.complexity(p).first()
    assert (c["scripts"], c["resources"], c["webgl"], c["spa"], c["heavy"]) == (2, 5, True, True, False) and c["timeout_factor"] == 3.5 and c["score"] == 27
    g = quality.content_gaps(p).first()
    assert g["images"] == 1 and [x["gap"] for x in g["gaps"]] == ["background"] and g["score"] == 100
    assert [r["library"] for r in quality.libraries(p).collect()] == ["three.js"]
    assert {r["target"] for r in quality.links(p).collect()} == {"https://a.com/x/s.css", "https://a.com/x/three.min.js"}
    assert quality.frameworks(page(spark, '<p class="btn btn-primary card"></p>')).first()["framework"] == "bootstrap"


def test_robots_and_brief(spark):
    urls = spark.createDataFrame([("u1", "a.com", "/x/y"), ("u2", "a.com", "/x/open/z"), ("u3", "b.com", "/"), ("u4", "c.com", "/")], "url string, host string, path string")
    rules = spark.createDataFrame([("a.com", "/x", False), ("a.com", "/x/open", True)], "host string, pattern string, allow boolean")
    hosts = spark.createDataFrame([("a.com",), ("b.com",)], "host string")
    assert {r["url"]: r["allowed"] for r in quality.robots_allowed(urls, rules, hosts).collect()} == {"u1": False, "u2": True, "u3": True, "u4": False}
    brief = spark.createDataFrame([(1, "Shop", "d" * 50, "short", "retail", ["calm"], None, [], [])], "id int, project_name string, description string, target_audience string, industry string, tone array<string>, color_preferences string, references array<string>, constraints array<string>")
    done, issues = quality.brief_check(brief, "id")
    assert done.first()["completeness"] == 55
    assert {(r["field"], r["severity"], r["issue"]) for r in issues.collect()} == {
        ("target_audience", "warning", "short"), ("color_preferences", "suggestion", "missing"), ("references", "suggestion", "missing"), ("constraints", "suggestion", "missing")
    }


def test_batch_evaluation_keeps_failures(spark):
    df = spark.createDataFrame([(1, "<main></main>"), (2, " "), (3, "<nav></nav>")], "page_id long, html string")
    got = {r["page_id"]: r["error"] for r in scoring.evaluate_batch(df).collect()}
    assert got == {1: None, 2: "empty_html", 3: None}
    assert {r["page_id"] for r in scoring.evaluate_batch(df, on_error="abort").collect()} == {1, 2}


def test_cliche_registry(spark):
    reg = scoring.ClicheRegistry()
    assert len(reg.names()) == 8 and reg.remove("font-mismatch") and not reg.remove("font-mismatch")
    reg.add("mine", 1.0, lambda: (F.size("palette") > 0, F.lit(1.0)))
    df = spark.sql("SELECT 1 AS id, array(named_struct('type', 'hero', 'start_y', 0, 'height', 1D, 'n_headings', 1, 'gradient_colors', 0)) AS sections, array('#ff0000') AS palette, array('arial') AS fonts, CAST(NULL AS INT) AS columns")
    found = reg.detect(df, "id")
    assert [r["pattern"] for r in found.collect()] == ["mine"] and scoring.cliche_score(df, found, "id").first()["cliche"] == 80
    with pytest.raises(ValueError):
        scoring.overall(df, {"originality": -1})


#: Markup, and what it adds to originality, craftsmanship and contextuality for the industry "tech" and the audience "business".
QUALITY_KINDS = [
    ("<p>plain</p>", 0, 0, 0),
    ("<style>a{color:#aa0001;background:#aa0002;border-color:#aa0003}</style>", 5, 0, 0),
    ("<style>a{color:#007bff;background:#28a745;border-color:#333333}</style>", 0, 0, 0),
    ("<style>b{font-family:Inter}</style>", 3, 0, 0),
    ("<style>b{font-family:Arial, serif}</style>", 0, 0, 0),
    ('<div style="grid-template-areas: subgrid"></div>', 5, 0, 5),
    ("<style>c{transition:a 1s, b 2s, c 3s}</style>", 4, 0, 0),
    ("<style>c{transition:a 1s, b 2s}</style>", 0, 0, 0),
    ('<svg><path d="M0"/></svg>', 3, 0, 0),
    ("<div></div>" * 11, 0, -5, 0),
    ("<div></div>" * 10, 0, 0, 0),
    ("<button>go</button> contact us", 0, 0, 8),
    ("developer documentation for business", 0, 0, 10),
]


def test_quality_adjustments(spark):
    from webfacts.operators import scoring

    rows = spark.createDataFrame([(i, k[0]) for i, k in enumerate(QUALITY_KINDS)], "page_id long, html string")
    got = {r["page_id"]: (r["originality"], r["craftsmanship"], r["contextuality"]) for r in scoring.html_quality(rows, industry="tech", audience="business").collect()}
    assert got == {i: (80 + o, 65 + c, 70 + x) for i, (_, o, c, x) in enumerate(QUALITY_KINDS)}
