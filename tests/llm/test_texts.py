"""Operators on single texts: rules, encoding, counts, personal data, classifier."""

import collections
import hashlib
import re

import numpy as np
import pytest
import sentencepiece
from fixtures import documents, texts

from webfacts.llm import cotraining, pieces, pii, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def test_every_piece_and_odd_text_encodes_like_the_library(library):
    model = pieces.piece_model(pieces.model_path())
    odd = [t for t in texts() if t] + [p.replace("▁", " ") for p in model.names[259:32000:7]] + [" " * n + "ab" + " " * n for n in range(40)]
    odd += ["the\n\n  of\n and\t\tin", "ﬁ ① ½ Å", "a▁b", "\n", " \n ", "日本語 текст עברית", "\U0001f600" * 3, "0123456789" * 30, "aAbB" * 200]
    for t in odd:
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        assert ids == library.encode(t), t[:80]
        assert model.decode(np.array([1, *ids, 2])) == library.decode([1, *ids, 2]), t[:80]


def test_backtracking_agrees_with_merging():
    import random

    model, rng = pieces.piece_model(pieces.model_path()), random.Random(2)
    for _ in range(3000):
        word = "▁" + "".join(rng.choice("abcdeinorstuABé'.,-9") for _ in range(rng.randrange(1, 25)))
        assert model.split(word) == model.merge(word), word


def test_cache_is_bounded(monkeypatch, library):
    model = pieces.PieceModel(pieces.model_path())
    monkeypatch.setattr(pieces, "CACHE_WORDS", 20)
    for t in texts():
        assert np.frombuffer(model.encode(t or ""), "<u4").tolist() == library.encode(t or "")
    assert len(model.cache) <= 21 and len(model.fits) <= 21


def test_documents_encode_and_decode(spark, library):
    docs = documents(spark)
    want = []
    for r in docs.collect():
        ids = [1, *library.encode(r.text or ""), 2]
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert rows(pieces.digest_documents(docs)) == sorted(want, key=repr)
    assert pieces.digest_documents(docs.limit(0)).count() == 0
    full = pieces.encode_documents(docs).filter("doc_id = 5").first()
    assert full.ids == [1, *library.encode(texts()[5]), 2] and full.decoded == texts()[5]


@pytest.mark.parametrize("head", [0, 30, 1 << 18])
def test_token_counts(spark, library, head):
    docs = documents(spark)
    want = []
    for r in docs.collect():
        n = len(library.encode(r.text or ""))
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 4096))
    assert rows(token_counts.count_tokens(docs, head=head)) == sorted(want, key=repr)
    assert token_counts.count_tokens(docs.limit(0), head=head).count() == 0


def brute_counts(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:], w[3:], w[4:]))
    inside = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], w[3:], w[4:])) if grams[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rule_counts(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(texts() + ["a b c d e", "a b c d e a b c d e", "a a a a a a", "#x|<y>\n#x|<y>\n \nz"])])
    got = {r.doc_id: r for r in quality_rules.judge_documents(docs).collect()}
    for r in docs.collect():
        g, w = got[r.doc_id], brute_counts(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == w
        assert g.base_failed == (w[0] < 10 or 100 * w[4] > 20 * w[0])
        assert g.kept == (not g.base_failed and g.p_good >= 0.5)
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in got.items() if g.kept)
    assert quality_rules.judge_documents(docs.limit(0)).count() == 0
    assert quality_rules.kept_documents(docs.limit(0)).count() == 0


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = (rng.random(20000) < 0.7).astype(int)
    chances = np.array([[[0.6, 0.2, 0.2], [0.5, 0.3, 0.2], [0.3, 0.2, 0.5], [0.7, 0.2, 0.1], [0.4, 0.4, 0.2]], [[0.03, 0.87, 0.1], [0.05, 0.75, 0.2], [0.02, 0.5, 0.48], [0.1, 0.8, 0.1], [0.05, 0.9, 0.05]]])
    draw = rng.random((20000, 5))
    edges = chances.cumsum(axis=2)[truth]
    votes = (draw[:, :, None] > edges).sum(axis=2).clip(0, 2)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.fit(patterns, counts.astype(float), rounds=200)
    assert abs(model.good - 0.7) < 0.03 and np.abs(model.votes - chances).max() < 0.05
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.9


PII = [
    "mail a.b+c@x-y.example.com, or q@d.e@f.g and _x@h.i", "ip 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 12 3", "+44 (20) 7946-0958 and +1 2 and +123456789012345678",
    "iban DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 or DE89 3704 0044 0532 0130 01", "ssn 078-05-1120" + " and so on" * 9 + " part 078-05-1120 order", "passport C01234567" + " and so on" * 9 + " model C01234567", "é☃ 😀 x@y.zz 😀 1.1.1.1", "@@@ a@b a@.c 1..2 +", "9" * 3000,
    "a" * 20000 + "@" + "b" * 10 + ".c", "1 " * 9000, "+1" + " " * 5000 + "2", "a@b.c@d.e_f@g.h",
]


def brute_spans(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, (p, ok) in kinds.items()}


def test_personal_data(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(PII + texts())])
    got = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    for r in docs.collect():
        g, w = got[r.doc_id], brute_spans(r.text)
        flat = [s for k in ("email", "ip", "card", "phone") for s in w[k]]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(len(w[k]) for k in ("email", "ip", "card", "phone")), r.text[:60]
        assert g.base_sha256 == hashlib.sha256(",".join(flat).encode()).hexdigest()
        assert [s for s in g.spans.split(",") if s and s.split(":")[0] in w] == flat
    more = {i: [s.split(":")[0] for s in got[i].spans.split(",") if s.split(":")[0] in pii.MORE] for i in range(len(PII))}
    assert more[4] == ["iban", "iban"] and more[5] == ["ssn"] and more[6] == ["passport"] and not more[0]
    assert pii.pii_digest(docs.limit(0)).count() == 0


def test_texts_full_of_personal_data(spark):
    # blocks and pieces: thousands of spans in a text, with characters of one to four bytes between them
    mails = "".join(f"u{i}@h{i % 7}.org{'é☃😀 ,'[i % 5]} " for i in range(20000))
    codes = [("passport " if i % 3 == 0 else "model " if i % 3 == 1 else "☃" * (i % 60)) + f" C{i:08d}" + " x" * 25 for i in range(6000)]
    mixed = " ".join(f"10.0.{i % 300}.1 4111 1111 1111 111{i % 10} +1 555 {i:07d}" for i in range(3000))
    docs = documents(spark, [(0, mails), (1, "\n".join(codes)), (2, mixed), (3, mails[: pii.BLOCK * 3]), (4, None)])
    got = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    for r in docs.collect():
        flat = [s for k, found in brute_spans(r.text).items() for s in found]
        assert [s for s in got[r.doc_id].spans.split(",") if s and s.split(":")[0] in pii.BASE] == flat
    want, text = [], "\n".join(codes)
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z][0-9]{8}(?![A-Za-z0-9])", text):
        near = text[max(0, m.start() - pii.NEAR) : m.end() + pii.NEAR]
        if re.search(r"(?i)(?<![a-z])passport(?![a-z])", near) and not re.search(r"(?i)(?<![a-z])model(?![a-z])", near):
            want.append(f"passport:{m.start()}:{m.end()}")
    assert len(want) > 1000 and [s for s in got[1].spans.split(",") if s.startswith("passport")] == want


def test_co_training_teaches_across_views():
    rng = np.random.default_rng(1)
    n = 4000
    y = rng.random(n) < 0.6
    a, b = rng.normal(size=(n, 3)), rng.normal(size=(n, 3))
    a[:, 0] += 3.0 * y
    b[:, 0] += 2.5 * y
    few, held = np.arange(60), np.arange(60) % 3 == 0
    model = cotraining.co_train([a[few], b[few]], y[few].astype(float), held, [a[60:2000], b[60:2000]])
    assert ((model.score([a[2000:], b[2000:]]) >= 0.5) == y[2000:]).mean() > 0.93


def test_classifier_on_documents(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 50}" for k in range(40)) + ".") for i in range(60)]
    bad = [(100 + i, "LOUD!! " * 40 + "| # $") for i in range(60)]
    docs = documents(spark, good + bad + [(None, None), (500, ""), (501, None), (1, good[1][1])])
    labels = spark.createDataFrame([(i, int(i < 100), "x") for i in [*range(30), *range(100, 130)]] + [(None, 1, "x"), (7, None, "x")], "doc_id long, quality int, kept string")
    got = cotraining.classify(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.kept == (r.doc_id < 100) for r in got if r.doc_id is not None and r.doc_id < 500)
    flat = cotraining.classify(docs, labels.limit(0)).collect()
    assert len({round(r.score, 9) for r in flat}) == 1
    assert cotraining.classify(docs.limit(0), labels).count() == 0


def test_co_training_reaches_rows_beyond_any_sample(spark, monkeypatch):
    # one hot source fills nearly all of the corpus; a small one has no labels, its texts tell good from bad
    prose, noise = [f"word{i} " * 20 + "." for i in range(50)], "LOUD!! " * 20 + "| #"
    hot = [(i, prose[i % 50] if i % 2 or i > 200 else noise, "en", "hot" if i % 2 or i > 200 else "poor", 100) for i in range(12000)]
    small = [(20000 + i, noise, "en", "small", 100) for i in range(40)]
    docs = spark.createDataFrame(hot + small, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen, fit = [], cotraining._fit_handed

    def spy(views, x, y, total, history, *rest):
        seen.append(int(total(lambda f, s: np.array([float(len(s))]))[0]))
        return fit(views, x, y, total, history, *rest)

    monkeypatch.setattr(cotraining, "_fit_handed", spy)
    got = {r.doc_id: r for r in cotraining.classify(docs, labels).collect()}
    assert seen == [len(docs.collect()) - 200] * cotraining.ROUNDS
    # the metadata view has learnt about the small source from the text view
    assert all(got[20000 + i].p_meta < 0.2 < got[1].p_meta for i in range(40))
