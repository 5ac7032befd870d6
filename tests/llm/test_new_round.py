"""Periodic runs, whitening and decontamination against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import documents, words

from webfacts.llm import decontamination, periodic_runs, whitening


def brute_runs(x):
    """Runs by definition: for each period the maximal stretches, kept if no smaller period holds all of it."""
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and x[i] == x[i + q]:
                i += 1
            if i + q - s >= max(12, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sequences():
    rng = random.Random(6)
    yield []
    yield [1] * 11
    yield [1] * 12
    yield [1] * 500
    yield list(range(300))
    for q in (1, 2, 3, 5, 6, 7, 8, 13, 14, 15, 30, 31, 40, 62, 63, 64):
        base = [rng.randrange(9) for _ in range(q)]
        yield [90] * 3 + (base * 9)[: 2 * q + rng.randrange(12, 40)] + [91, 92]
        yield list(range(100, 117)) + (base * 2 + [77]) + base * 3
    for k in (2, 3, 4):
        yield [rng.randrange(k) for _ in range(700)]
    a, b = [1], [1, 2]
    while len(b) < 600:  # Fibonacci words hold many overlapping runs
        a, b = b, b + a
    yield b
    yield [1, 1, 2] * 40 + [1, 1, 2, 5] * 30 + [1, 1, 2] * 11


def test_runs_of_sequences():
    for x in sequences():
        assert periodic_runs.find_runs(np.array(x, np.int64)) == brute_runs(x), x[:40]
    texts = sorted(([b"%d" % v for v in x] for x in sequences()), key=len, reverse=True)
    assert periodic_runs.runs_of(texts) == [brute_runs(t) for t in texts]  # one batch: no run crosses a border


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, periodic_runs.PRIME, (3, 64)), rng.integers(0, periodic_runs.PRIME, (3, 64))
    got = periodic_runs.inverse(periodic_runs._mod(periodic_runs.transform(a) * periodic_runs.transform(b)))
    want = [[sum(int(r[i]) * int(s[(k - i) % 64]) for i in range(64)) % periodic_runs.PRIME for k in range(64)] for r, s in zip(a, b)]
    assert got.tolist() == want
    assert np.array_equal(periodic_runs.inverse(periodic_runs.transform(a)), a)


def test_long_periodic_text_stays_near_linear():
    import time

    took = []
    for n in (20_000, 80_000):
        x = np.tile(np.arange(7), n // 7 + 1)[:n]
        start = time.perf_counter()
        assert periodic_runs.find_runs(x) == [(0, n, 7)]
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * took[0] + 1


def brute_report(doc_id, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(v for i, v in enumerate(w) if i not in drop)),
    )


def test_run_report(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.randrange(0, 60), 30)) for i in range(60)] + [(i, "a b c " * 30 + "d e " * 20) for i in range(60, 70)]
    for docs in (documents(spark), documents(spark, rows)):
        want = [brute_report(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(tuple, periodic_runs.run_report(docs).collect()), key=repr) == sorted(want, key=repr)
    docs = documents(spark)
    assert periodic_runs.run_report(docs.limit(0)).count() == 0
    plain = {r.doc_id: r for r in periodic_runs.document_runs(docs.filter("text like 'A B C%'")).collect()}
    assert [[tuple(x) for x in r.runs] for r in plain.values()] == [[(0, 120, 3)]] and {r.collapsed for r in plain.values()} == {"A B C"}


VECTORS = "vec_id long, embedding array<float>, component int, x string"


def vector_rows(n=700, dim=40, seed=3):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, dim)) * np.linspace(2, 0.5, dim) + rng.standard_normal(dim)
    return [(i, [float(np.float32(c)) for c in row], 1, "x") for i, row in enumerate(data)]


def check_whitened(got, rows, components):
    vec = np.array([r[1] for r in rows])
    x = np.floor(1024 * vec).astype(np.int64) + 100000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    want = centred @ vectors / np.sqrt(values)
    trace = (centred**2).sum() / n
    at = {}
    for k, r in enumerate(rows):
        at.setdefault(r[0], []).append(k)
    assert len(got) == n * components
    signs = {}
    for r in got:
        k = at[r.vec_id][0]
        assert r.n == n and r.deviation == sum((n * int(c) - int(s)) ** 2 for c, s in zip(x[k], total))
        w = want[k, r.component - 1]
        if abs(w) > 0.1:
            signs.setdefault(r.component, np.sign(w * r.whitened))
        assert abs(w - signs.get(r.component, 1) * r.whitened) < 1e-7 or abs(w) <= 0.1
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-9 and 0 <= r.identity_error < 1e-9


def test_whitening(spark):
    rows = vector_rows()
    odd = [(901, None, 1, "x"), (902, [1.0, None], 1, "x"), (903, [float("nan")] * 40, 1, "x"), (904, [float("inf")] * 40, 1, "x"), (905, [1.0, 2.0], 1, "x"), (None, [], 1, "x")]
    again = rows + [rows[5], (None, rows[6][1], 1, "x")]
    got = whitening.whitened(spark.createDataFrame(again + odd, VECTORS).repartition(5)).collect()
    check_whitened(got, again, 8)


def test_whitening_of_few_dimensions_and_odd_tables(spark):
    rows = vector_rows(50, 3)
    check_whitened(whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect(), rows, 3)
    table = lambda r: whitening.whitened(spark.createDataFrame(r, VECTORS))
    assert table([]).count() == 0 and table(rows[:1]).count() == 0 and table([rows[0]] * 4).count() == 0 and table([(1, [], 1, "x")]).count() == 0
    line = [(i, [float(i), 2.0 * i, 0.0], 1, "x") for i in range(9)]
    assert {r.component for r in table(line).collect()} == {1}
    assert table([(1, [1e38, 0.0], 1, "x"), (2, [-1e38, 1.0], 1, "x"), (3, [0.0, 3.0], 1, "x")]).filter("deviation is null").count() > 0


def test_leading_finds_close_eigenvalues_without_the_matrix():
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    values = np.concatenate([[2.0, 1.9, 1.2, 1.1999, 1.1998, 1.19], np.linspace(1.18, 1.0, 84)])
    matrix = turn * values @ turn.T
    got, vectors = whitening.leading(lambda q: matrix @ q, 90, 8)
    assert np.allclose(got, values[:8], rtol=1e-12) and np.abs(np.abs((vectors * turn[:, :8]).sum(axis=0)) - 1).max() < 1e-12
    assert whitening.lower_bound(lambda q: matrix @ q, 90) <= 1.0


def brute_contamination(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for name, text in items:
        w = split(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(name)
    sizes = {len(w) for w in wins}
    out = []
    for doc_id, text in docs:
        w, hit, names = split(text), set(), set()
        for k, i in itertools.product(sizes, range(len(w))):
            if tuple(w[i : i + k]) in wins and i + k <= len(w):
                hit.update(range(i, i + k))
                names |= wins[tuple(w[i : i + k])]
        digest = hashlib.sha256(",".join(sorted(str(n) for n in names if n is not None)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), digest, bool(hit)))
    return out


def contamination_tables():
    rng = random.Random(11)
    pool = ["a", "b", "cc", "Été", "x9", "日本"]
    talk = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, words(rng, rng.randrange(3, 60), 50)) for i in range(20)] + [(40 + i, talk(rng.randrange(1, 25))) for i in range(12)]
    items += [(60, None), (61, ""), (62, "!!"), (63, "cc"), (64, "CC"), (65, "b a"), (66, items[3][1] + " " + items[4][1]), (67, "q " * 300), (3, items[5][1]), (None, words(rng, 30)), (3, items[3][1])]
    docs = [(i, words(rng, 30) + "\n" + " ".join(items[i % 20][1].split()[: rng.randrange(1, 50)]).upper() + "!" + words(rng, 5)) for i in range(40)]
    docs += [(100 + i, talk(rng.randrange(1, 80))) for i in range(25)] + [(200, items[-2][1]), (201, "q " * 400), (202, "Q-q.q" * 4), (203, None), (204, ""), (0, "again under id 0"), (None, items[2][1])]
    return docs, items


@pytest.mark.parametrize("shard_words, piece_words", [(1 << 17, 4096), (150, 32)])
def test_contamination(spark, shard_words, piece_words):
    docs, items = contamination_tables()
    table = spark.createDataFrame([(i, "e", t, "f") for i, t in items], "item_id long, n_words string, text string, found string")
    frame = documents(spark, docs)
    got = decontamination.contamination(frame, table, shard_words=shard_words, piece_words=piece_words).drop("longest").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute_contamination(docs, items), key=repr)
    if piece_words == 32:
        assert decontamination.automata(table, shard_words=150, piece_words=32).count() > 3
        assert decontamination.contamination(frame.limit(0), table).count() == 0
        none = decontamination.contamination(frame, table.limit(0)).collect()
        assert len(none) == len(docs) and not any(r.contaminated for r in none)


def test_decontaminated(spark):
    rng = random.Random(12)
    item = words(rng, 14)
    docs = [(1, f"Kept before, ({item.upper()}) and kept after as well as some more words to be long enough here"), (2, item + " short"), (3, "clean text"), (4, None), (5, "")]
    frame = documents(spark, docs)
    kept = decontamination.decontaminated(frame, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "Kept before, () and kept after as well as some more words to be long enough here"), (3, "clean text"), (4, None), (5, "")]
