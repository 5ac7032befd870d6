"""Small inputs on which operators once gave wrong answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_streaming import SCHEMA, at, feed

from webfacts.functions.base import required_literal
from webfacts.operators.aggregates import all_percentiles, quantize_palette
from webfacts.operators.neighbours import knn_join, nearest_to
from webfacts.operators.series import fade_events
from webfacts.pages import motion, quality, structure
from webfacts.sources.tables import find_or_create_pages
from webfacts.streaming import jobs


def page(spark, *html):
    return spark.createDataFrame(list(enumerate(html)), "page_id long, html string")


def test_new_url_is_stored_once_though_ids_repeat(spark):
    new = spark.createDataFrame([(1, "http://x.org/"), (2, "http://x.org/"), (2, "http://y.org/"), (2, "http://y.org/")], "page_id long, url string")
    old = spark.createDataFrame([], "page_id long, url string")
    got = find_or_create_pages(new, old).select("page_id", "url").collect()
    assert sorted(map(tuple, got)) == [(1, "http://x.org/"), (2, "http://y.org/")]


def test_rows_without_score_keep_their_place(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0)], "k string, s double")
    got = sorted(map(tuple, all_percentiles(df, ["k"], "s").select("k", "s", "percentile").collect()), key=repr)
    assert got == sorted([("a", 1.0, 100.0), ("a", None, None), (None, 2.0, 100.0)], key=repr)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 6, 8, 40])
def test_palette_has_the_wanted_size(spark, size):
    rng = np.random.default_rng(1)
    rows = [(*map(int, c), int(n)) for c, n in zip(rng.integers(0, 256, (30, 3)), rng.integers(1, 50, 30))]
    got = quantize_palette(spark.createDataFrame(rows, "r int, g int, b int, n long"), size).collect()
    assert len(got) == min(size, len({r[:3] for r in rows})) and sum(r.n for r in got) == sum(r[3] for r in rows)


def brute_palette(rows, size):
    """Median cut over lists of colours."""
    boxes = [sorted(rows)]
    while len(boxes) < size:
        splittable = [i for i, b in enumerate(boxes) if len({r[:3] for r in b}) > 1]
        if not splittable:
            break
        at = max(splittable, key=lambda i: (sum(r[3] for r in boxes[i]), -i))
        box = boxes[at]
        axis = max(range(3), key=lambda c: max(r[c] for r in box) - min(r[c] for r in box))
        values, total = sorted({r[axis] for r in box}), sum(r[3] for r in box)
        last = next((v for v in values[:-1] if 2 * sum(r[3] for r in box if r[axis] <= v) >= total), values[-2])
        boxes[at : at + 1] = [[r for r in box if r[axis] <= last], [r for r in box if r[axis] > last]]
    return sorted(tuple(int(sum(r[c] * r[3] for r in b) / sum(r[3] for r in b) + 0.5) for c in range(3)) + (sum(r[3] for r in b),) for b in boxes)


@pytest.mark.parametrize("size", [1, 2, 7, 40, 200])
def test_palette_equals_cutting_lists(spark, size):
    rng = np.random.default_rng(size)
    rows = [(*map(int, c), int(n)) for c, n in zip(rng.integers(0, 256, (150, 3)) // rng.choice([1, 1, 60], (150, 3)), rng.integers(1, 50, 150))]
    folded = {}
    for r, g, b, n in rows:
        folded[r, g, b] = folded.get((r, g, b), 0) + n
    frame = spark.createDataFrame(rows + [(None, 1, 2, 3)], "r int, g int, b int, n long")
    assert sorted(tuple(r[c] for c in "rgbn") for r in quantize_palette(frame, size).collect()) == brute_palette([(*k, n) for k, n in folded.items()], size)


def test_variables_inside_one_page():
    from webfacts.pages.styles import resolve_page

    values = {"--a": "var(--b, red) var(--b)", "--b": "rgb(1, 2, 3)", "--c": "var(--d)", "--d": "var(--c, 1px)", "--e": "", "--f": "var(--e)x", "--g": "var(--no, var(--b)) var(--gone)", "--h": "calc(var(--no , 2px) * 2)"}
    got = dict(zip(values, resolve_page(list(values), list(values.values()))))
    assert got["--a"] == ("rgb(1, 2, 3) rgb(1, 2, 3)", "resolved") and got["--f"] == ("x", "resolved") and got["--h"] == ("calc(2px * 2)", "resolved")
    assert got["--c"][1] == got["--d"][1] == "failed" and got["--g"] == ("rgb(1, 2, 3) var(--gone)", "unresolved")


def test_empty_palette(spark):
    assert quantize_palette(spark.createDataFrame([], "r int, g int, b int, n long"), 4).count() == 0


def test_libraries_are_told_from_prose(spark):
    docs = page(spark, "There were three. Then more. Babylon. Pixi. ogl.", "<script>new THREE.Scene()</script>", "<script>AFRAME.registerComponent()</script>", "<script src='gpu.min.js'></script>", "navigator.xr")
    got = {(r.page_id, r.library) for r in quality.libraries(docs).collect()}
    assert got == {(1, "three.js"), (2, "a-frame"), (3, "gpu.js"), (4, "webxr")}


def test_sections_keep_their_own_text(spark):
    html = [
        "<article><header><h1>t</h1></header><p>one</p><p>two</p></article>", '<div class="hero"><p>a</p><div>b</div></div>', '<div role="banner">c</div><div>d</div>',
        "<main><section><p>x</p></section></main>", "<section><div>open<p>y</p></section><footer>z</footer>", "<div>plain</div>", "<nav>never closed", "",
    ]
    got = {(r.page_id, r.position): (r.tag, r.snippet) for r in structure.sections(page(spark, *html)).collect()}
    assert got == {
        (0, 0): ("article", "<article><p>one</p><p>two</p></article>"), (0, 1): ("header", "<header><h1>t</h1></header>"),
        (1, 0): ("div", '<div class="hero"><p>a</p><div>b</div></div>'), (2, 0): ("div", '<div role="banner">c</div>'),
        (3, 0): ("section", "<section><p>x</p></section>"), (4, 0): ("section", "<section><div>open<p>y</p></section>"), (4, 1): ("footer", "<footer>z</footer>"),
    }


def test_marked_containers_and_unclosed_elements():
    from webfacts.pages.nesting import nested_sections

    snippets = lambda html: [(t, s) for t, _, s in nested_sections(html)]
    assert snippets('<div class="hero"><div>inner</div><p>text</p>') == []  # never closed
    assert snippets('<section>a<div class="hero"><div>inner</div>b</section>c') == [("section", '<section>a<div class="hero"><div>inner</div>b</section>')]
    assert snippets('<ul class="FEATURES"><li>x</li></ul><form role="search"><input></form><my-card data-block>y</my-card><figure class="plain">z</figure>') == [
        ("ul", '<ul class="FEATURES"><li>x</li></ul>'), ("form", '<form role="search"><input></form>'), ("my-card", "<my-card data-block>y</my-card>"),
    ]
    assert snippets("<nav id='x'>a</nav></div></section><div id='about-us'>b</div>") == [("nav", "<nav id='x'>a</nav>"), ("div", "<div id='about-us'>b</div>")]
    assert snippets("<section><section>a</section></section>") == [("section", "<section>a</section>")] and snippets("<headers>a</headers><div>") == []


def test_sections_take_time_in_proportion():
    import time

    from webfacts.pages.nesting import nested_sections

    for make in (lambda n: '<div class="hero">x' * n + "</div>" * n, lambda n: '<div class="hero">x</div>' * n, lambda n: "<section>" + '<ul class="nav">x' * n + "</section>"):
        took = []
        for n in (10_000, 40_000):
            start = time.perf_counter()
            found = nested_sections(make(n))
            took.append(time.perf_counter() - start)
        assert len(found) in (1, n) and took[1] < 8 * took[0] + 0.2


def test_part_of_a_property_name_counts(spark):
    rows = spark.createDataFrame([("drift-x", ".a", "infinite", [("background-position-x",)]), ("q", ".b", "1", [("background-position-x",)])], "name string, selector string, iterations string, properties array<struct<name:string>>")
    assert [r.category for r in motion.motion_category(rows).orderBy("selector").collect()] == ["background_animation", "unknown"]


def test_late_rows_inside_the_watermark_join_their_session(spark, tmp_path):
    batches = [[("u", at(0), 1.0), ("u", at(8), 1.0)], [("u", at(2), 1.0), ("u", at(15), 1.0)], [("u", at(300), 1.0)], [("u", at(400), 1.0)]]
    out = jobs.capped_sessions(feed(spark, f"{tmp_path}/in", batches, SCHEMA), "user", "ts", "value", 10_000, 60_000, "10 seconds")
    jobs.run_available(out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/c")
    base = spark.sql("SELECT unix_millis(TIMESTAMP'2024-01-01')").first()[0]
    got = sorted((r.start_ms - base, r.end_ms - base, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got[0] == (0, 15_000, 4)


def test_fades_need_a_step_above_calm(spark):
    with pytest.raises(ValueError):
        fade_events(spark.createDataFrame([("s", 1, 0.5)], "s string, f long, a double"), "s", "f", "a", threshold=0.01)


def test_robots_patterns_and_groups(spark):
    rules = spark.createDataFrame(
        [("h", "*", "/", False), ("h", "*", "/*.pdf$", True), ("h", "*", "/a*b", True), ("h", "bot", "/x", False), ("g", "*", "/p.q", False)], "host string, agent string, pattern string, allow boolean"
    )
    urls = spark.createDataFrame([(str(i), h, p) for i, (h, p) in enumerate([("h", "/m.pdf"), ("h", "/m.pdfx"), ("h", "/acb/d"), ("h", "/x"), ("g", "/p.q"), ("g", "/pzq"), ("n", "/")])], "url string, host string, path string")
    hosts = spark.createDataFrame([("h",), ("g",)], "host string")
    flags = lambda agent: [r.allowed for r in quality.robots_allowed(urls, rules, hosts, agent).orderBy("url").collect()]
    assert flags("*") == [True, False, True, False, False, True, False]
    assert flags("Bot") == [True, True, True, False, False, True, False]


def test_many_probes_and_many_pivots(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 8))
    df = spark.createDataFrame([(i, v.tolist(), "hot" if i % 3 else str(i % 5)) for i, v in enumerate(x)], "id long, v array<double>, g string")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    got = {(r.probe_id, r.id) for r in nearest_to(df, "id", "v", {i: v.tolist() for i, v in enumerate(x[:1100])}, 2).collect()}
    assert got == {(i, int(j)) for i in range(1100) for j in np.argsort(-sims[i])[:2]}
    near = {(r.id, r.neighbour_id) for r in knn_join(df, "id", "v", 2, group="g", pivots_wanted=9).collect()}
    g = np.array(["hot" if i % 3 else str(i % 5) for i in range(1200)])
    sims[g[:, None] != g[None, :]] = -2
    assert near == {(i, int(j)) for i in range(1200) for j in np.argsort(-sims[i])[:2]}


def test_long_heading_is_a_whole_name(spark):
    rows = structure.analyzed_sections(page(spark, f"<section><h2>{'word ' * 30}end</h2><p>x</p></section>"))
    assert len(rows.first()["name"]) > 100


def test_required_literal():
    assert [required_literal(p) for p in (r"a\.bcd", "ab?cd", "(abc)def", "abc|def", r"x\s+yz", "[abc]de+f", "ab{2}cd")] == ["a.bcd", "cd", "def", "", "yz", "de", "cd"]
