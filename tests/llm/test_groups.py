"""Operators over many rows: URL list, near-duplicates, mixing, vectors, lines, pipeline."""

import collections
import re

import numpy as np
import pytest
import xxhash
from fixtures import documents, texts, words

from webfacts.llm import line_dedup, mixing, near_vectors, simhash, url_filter
from webfacts.llm.common import components


def closure(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    import random

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = components(spark.createDataFrame(edges + [(7, 7), (None, 3)], "a long, b long")).collect()
    want = closure({n for e in edges if e[0] != e[1] for n in e}, [e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", w)
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_simhash(spark):
    docs = documents(spark)
    got = simhash.near_duplicates(docs).collect()
    source = docs.collect()
    prints = [brute_fingerprint(r.text) for r in source]
    names = closure(range(len(source)), [(i, j) for i in range(len(source)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    lowest = {c: min((source[i].doc_id for i in names if names[i] == c and source[i].doc_id is not None), default=None) for c in set(names.values())}
    want = [(source[i].doc_id, f"{prints[i]:016x}", lowest[names[i]]) for i in names]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(names.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_simhash_links_by_bits_alone(spark):
    import random

    rng = random.Random(9)
    values = {0, -1, -(1 << 63)}
    for _ in range(40):
        v = rng.getrandbits(64)
        for _ in range(5):
            values.add(v - (1 << 64) * (v >> 63))
            v ^= sum(1 << rng.randrange(64) for _ in range(rng.choice((1, 2, 3)))) & ((1 << 64) - 1)
    nodes = sorted(values)
    linked = [(a, b) for a in nodes for b in nodes if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    got = {r.node: r.component for r in simhash.near_fingerprints(spark.createDataFrame([(v,) for v in nodes], "fp long")).collect()}
    want = closure(nodes, linked)
    assert got == {n: c for n, c in want.items() if any(n in e for e in linked)}


def test_simhash_sends_no_points_to_the_driver(spark, monkeypatch):
    # a point stands for 65 rows of a fingerprint, which the planner takes for one; without a limit on broadcasts it is read off the plan
    monkeypatch.setattr(simhash, "components", lambda edges: edges)
    links = simhash.near_fingerprints(spark.createDataFrame([(0,), (1,), (3,), (7,), (1 << 40,)], "fp long"))
    assert set(map(tuple, links.collect())) == {(1, 0), (3, 0), (3, 1), (7, 1), (7, 3), (1 << 40, 0), (1 << 40, 1)}
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest, share = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and rest * weight[s] / share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        full |= over


@pytest.mark.parametrize("bucket_rows", [7, 4096])
def test_mixing(spark, bucket_rows):
    import random

    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(1, 60)), rng.choice(["a", "a", "a", "a", "b", "c", "ü", None])) for i in range(600)]
    rows += [(700, words(rng, 9), "tiny"), (701, None, "a"), (702, "", "empty"), (5, rows[5][1], rows[5][2]), (None, "x y z", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", docs_extra())
    got = mixing.mix_counts(docs, bucket_rows=bucket_rows, fan_in=3).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        copies = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(copies + 1e-9) <= r.copies <= -int(-copies - 1e-9 // 1) + 1 and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 60
    again = mixing.mix_counts(docs.repartition(5), bucket_rows=bucket_rows, fan_in=3).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    whole = mixing.mix_counts(docs).groupBy("source").sum("taken").collect()
    mixed_words = collections.Counter()
    for r in mixed.collect():
        mixed_words[r.source] += len((r.text or "").split())
    assert {s: n for s, n in whole if n} == {s: n for s, n in mixed_words.items() if n}
    assert mixing.mix_counts(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("an extra column of the same name")


def test_pivotal_keeps_words():
    rng = np.random.default_rng(0)
    sizes, x = rng.integers(1, 500, 400), rng.random(400)
    out, held = mixing.pivotal([str(i) for i in range(400)], sizes, x, "s")
    assert abs((sizes * out).sum() - (sizes * x).sum()) < 1e-6
    assert all(v in (0.0, 1.0) for i, v in enumerate(out) if i != held)
    mean = np.mean([mixing.pivotal([str(i) for i in range(60)], sizes[:60], x[:60], f"r{k}")[0] for k in range(600)], axis=0)
    assert np.abs(mean - x[:60]).mean() < 0.03


@pytest.mark.parametrize(("crowd", "block"), [(64, 1024), (3, 4)])
def test_near_vectors(spark, crowd, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(scale=0.02 * (1 + i % 3), size=16)).tolist()) for i in range(120)] + [(200 + i, rng.normal(size=16).tolist()) for i in range(40)]
    rows += [(300, rows[0][1]), (301, [2 * v for v in rows[0][1]]), (302, rows[0][1]), (303, None), (304, [0.0] * 16), (305, [float("nan")] * 16), (306, [float("inf")] + [1.0] * 15), (307, [None] + [1.0] * 15), (308, [])]
    rows += [(309, [1.0, 2.0]), (310, [2.0, 4.0]), (302, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n long, vector string")
    got = near_vectors.near_vectors(df, crowd=crowd, block=block).collect()
    assert len(got) == len(rows)

    def unit(v):
        if not v or any(x is None or x != x or abs(x) == float("inf") for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9]
    degree = collections.Counter(i for i, _ in linked)
    names = closure(range(len(rows)), linked)
    lowest = {c: min(rows[i][0] for i in names if names[i] == c) for c in set(names.values())}
    want = sorted((rows[i][0], degree[i], lowest[names[i]], rows[i][0] == lowest[names[i]]) for i in names)
    found = sorted(map(tuple, got))
    assert sum(n for _, n, _, _ in found) >= 0.97 * len(linked)
    if sum(n for _, n, _, _ in found) == len(linked):
        assert found == want
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a = near_vectors.normalised(rng.normal(size=(1500, 64)))
    other = rng.normal(size=a.shape)
    other = near_vectors.normalised(other - (other * a).sum(axis=1, keepdims=True) * a)
    for cosine, least in ((0.9, 0.88), (0.93, 0.96)):
        b = cosine * a + np.sqrt(1 - cosine**2) * other
        assert (near_vectors.codes(a) == near_vectors.codes(b)).any(axis=1).mean() >= least


URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/x", "https://www.example.com/en/x?y#z", "https://a.www.example.com/en/", "http://example.com/en", "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/de/1",
    "http://net/fr/", "http://example.org/list/", "https://www.example.org/list?x=1", "https://example.org/other", "http://com", "http://com/", "x://y://z.org/q", "http://example.org/list//", "http://h.org:80/list", "http://x.org\n/a/b",
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[12], "x", "y"), (12, URLS[12], "x", "y")], "page_id long, url string, block string, words string")
    listed = spark.createDataFrame([("example.org/list", 1), ("example.org/list", 2), (None, 3), ("", 4)] + [(f"far.org/{i}", i) for i in range(500)], "canonical string, host int")
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

    def judge(u):
        host = path = ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(h + p, w) for w, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        key = re.sub(r"^www\.", "", host) + path.rstrip("/")
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "block" if key == "example.org/list" else "allow"))
        return host, path, rule, verdict

    got = url_filter.judge_urls(pages, listed).collect()
    want = [(r.page_id, *judge(r.url)) for r in pages.collect()]
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    assert all(r.maybe_listed for r in got if r.listed)
    assert {r.verdict for r in url_filter.judge_urls(pages, listed.limit(0)).collect() if r.rule is None} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0


def test_listed_words_are_whole_words_of_the_text(spark):
    html = ["<p>A sympathetic, empathetic page</p>", '<p class="scum">clean</p><script>idiot()</script>', "<p>Pathetic!</p>", "<b>you</b><i>scum</i>", None, "apathetic <!-- idiot -->"]
    pages = spark.createDataFrame([(f"http://www.s{i}.org/a", h) for i, h in enumerate(html)], "url string, html string")
    got = {r.canonical for r in url_filter.listed_by_words(pages, ("idiot", "scum", "pathetic")).collect()}
    assert got == {"s2.org/a", "s3.org/a"}


def test_bloom_blocks_pass_few_strangers(spark):
    keys = spark.range(4000).selectExpr("concat('k', id) AS canonical")
    pages = spark.range(20000).selectExpr("id AS page_id", "concat('http://s', id, '.org') AS url")
    got = url_filter.judge_urls(pages, keys)
    assert got.filter("maybe_listed").count() < 200 and got.filter("listed").count() == 0


def brute_lines(rows):
    named = sorted(((i is None, i or 0, xxhash64_of(t) if i is None else 0), t) for i, t in rows)
    seen, kept = [], {}
    places = sorted({(doc, pos, line) for doc, t in named for pos, line in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", line)})
    for doc, pos, line in places:
        w = set(re.findall(r"[^\x20\x09-\x0D]+", line))
        if not any(5 * len(w & o) >= 4 * len(w | o) for o in seen):
            kept.setdefault(doc, []).append(pos)
        seen.append(w)
    return kept


def xxhash64_of(t):
    h = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
    return h - (1 << 64) * (h >> 63)


@pytest.mark.parametrize("broadcast_lines", [0, 10**6])
def test_line_dedup(spark, broadcast_lines):
    import random

    rng = random.Random(11)
    pool = [words(rng, rng.randrange(1, 30), 60) for _ in range(60)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(0, 8)):
            w = rng.choice(pool).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
            if rng.random() < 0.3:
                rng.shuffle(w)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w) if rng.random() < 0.9 else rng.choice(["", "   "]))
        rows.append((i, "\n".join(lines)))
    rows += [(None, rows[3][1]), (None, None), (3, rows[3][1]), (99, None), (98, "")] + list(enumerate(texts(), 200))
    docs = documents(spark, rows)
    want = brute_lines(rows)
    stay = {(r.id, r.tie): r.kept for r in line_dedup.kept_lines(docs, broadcast_lines=broadcast_lines).collect()}
    assert stay == {(None if k[0] else k[1], k[2]): v for k, v in want.items()}
    if broadcast_lines:
        report = line_dedup.line_report(docs).collect()
        assert len(report) == len(rows) and all(r.n_removed == r.n_lines - len(r.kept) for r in report)
        out = line_dedup.deduplicated(docs)
        assert out.columns == docs.columns and out.count() == len(rows)
        for r in out.filter("doc_id IS NOT NULL AND text IS NOT NULL").collect():
            t = dict(rows)[r.doc_id] or ""
            keep = set(want.get((False, r.doc_id, 0), []))
            assert r.text == "\n".join(x for p, x in enumerate(t.split("\n")) if p in keep or not re.search(r"[^\x20\x09-\x0D]", x))
        assert line_dedup.line_report(docs.limit(0)).count() == 0 and line_dedup.deduplicated(docs.limit(0)).count() == 0


def test_line_groups_cost_a_few_pairs_a_line(spark):
    """2000 lines that differ from a template in one word each, and 300 from a template that shares most words with it."""
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(30)]
    other = base[:24] + [f"v{i}" for i in range(9)]
    rows = []
    for i in range(2300):
        w = list(base if i < 2000 else other)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = documents(spark, rows)
    distinct = line_dedup.stored(line_dedup.distinct_lines(line_dedup._lines(docs, "doc_id", "text"), [0] * 2**line_dedup.CLASS_BITS))
    heads = line_dedup.stored(line_dedup._heads(distinct))
    assert heads.count() <= 4 * len(rows)
    settled = line_dedup._verified(heads, line_dedup._bodies(heads, docs, "doc_id", "text", 10**6))
    flagged = distinct.join(settled.withColumn("settled", line_dedup.F.lit(True)), ["doc", "spot"], "left").fillna(False, "settled")
    assert flagged.filter("NOT settled").count() < 60 and line_dedup._candidates(line_dedup._postings(flagged)).count() < 20 * len(rows)
    stay = {r.doc for r in line_dedup.remaining_places(docs).collect()}
    sets = [set(t.split()) for _, t in rows]
    want = {i for i in range(len(sets)) if not any(5 * len(sets[i] & s) >= 4 * len(sets[i] | s) for s in sets[:i])}
    assert stay == want


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t) for i, t in enumerate(texts()) if t is None or len(t) < 4000] * 2 + [(900, "ONE!! TWO!! " * 30), (None, texts()[2])]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        nxt = spark.read.parquet(f"{tmp_path}/{name}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert nxt.columns == docs.columns
        docs = nxt
    assert 900 not in {r.doc_id for r in docs.collect()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
