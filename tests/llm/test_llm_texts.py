"""Toxicity, PII, quality, decontamination and the language model: rules, brute force, held-out rows, odd inputs."""

import hashlib
import math
import os
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from srcloom.llm import decontamination as D
from srcloom.llm import neural_lm as N
from srcloom.llm import pii as P
from srcloom.llm import quality as Q
from srcloom.llm import toxicity as T
from srcloom.llm.queries import QUERIES

ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, y int"
ODD_ROWS = [
    (1, None, None, None, None, 1.0, "a", 1), (2, "", "en", "s", 0, None, None, None), (3, "plain words here", None, None, 1, 0.5, "b", 0),
    (3, "plain words here", None, None, 1, 0.5, "b", 0), (None, "no id at all", "en", "s", 1, None, None, None), (4, "word " * 60_000, "en", "s", 1, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_grammar_weighs_clauses():
    g = T.Grammar({b"idiot": 4.0, b"moro*": 3.0})
    score = lambda text: g.features(text.encode())[1]
    plain = score("what an idiot here")
    assert plain == 4.0
    assert score("you are an idiot") > plain  # a target within reach
    assert score("an idiot are you") > plain
    assert score("this is not an idiot") < plain  # negation
    assert score("she said that in the end an idiot came by") < score("in the end of all an idiot came by")
    assert score("moronic things") == 3.0  # beginnings
    assert g.features(b"good words. and more")[2] == 0
    assert g.features(b"an idiot. a line\nan IDIOT!")[2] == 2
    assert g.features(None) == g.features(b"") == (0.0, 0.0, 0)


def test_threats_reach_targets_on_both_sides():
    g = T.Grammar({b"idiot": 4.0})
    score = lambda text: g.features(text.encode())[1]
    assert score("I will kill you") == score("you I will kill") > 0
    assert score("we should burn them") > 0 and score("ich werde dich töten") > 0
    assert score("kill and burn you") == 2 * score("kill you")
    assert score("kill one two three you") > 0 == score("kill one two three four you")
    assert score("kill the lights") == score("kill. you") == score("kill\nyou") == 0.0
    assert score("I will not kill you") == score("I will kill you") * T.NEGATION_LOSS
    assert score("the paper said kill you") == score("kill you") * T.REPORT_LOSS
    assert score("an idiot may kill you") == score("an idiot may see you") + score("kill you")


def test_products_do_what_their_parts_do():
    rng = np.random.default_rng(1)
    parts = [T.weigher(), T.targeted(), T.negated(), T.reported()]
    whole = T.compose(T.compose(parts[0], parts[1]), T.compose(parts[2], parts[3]))
    assert len(whole.step) == (T.TARGET_REACH + 1) * (T.NEGATION_REACH + 1) * 2 - sum(
        1 for i in range(1, T.TARGET_REACH + 1) for j in range(1, T.NEGATION_REACH + 1) if T.TARGET_REACH - i == T.NEGATION_REACH - j) * 2
    for _ in range(200):
        symbols = rng.integers(0, T.SYMBOLS, 30).tolist()
        alone = np.prod([p.run(symbols) for p in parts], axis=0)
        assert whole.run(symbols) == pytest.approx(alone) and T.BEFORE.run(symbols) == pytest.approx(alone)


def test_grammar_against_distances():
    """A clause's weight from the places of its words alone."""
    rng = np.random.default_rng(4)
    g = T.Grammar({b"idiot": 4.0})
    kinds = ["word", "idiot", "kill", "you", "not", "said"]
    for _ in range(300):
        words = [kinds[i] for i in rng.choice(6, 20, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1])]
        places = lambda w: [i for i, x in enumerate(words) if x == w]  # noqa: E731, B023
        want = 0.0
        for i, w in enumerate(words):
            if w in ("idiot", "kill"):
                near = any(abs(i - j) <= T.TARGET_REACH for j in places("you"))
                weight = (4.0 if w == "idiot" else T.THREAT_WEIGHT * near) * (T.TARGET_GAIN if near else 1)
                weight *= T.NEGATION_LOSS if any(0 < i - j <= T.NEGATION_REACH for j in places("not")) else 1
                want += weight * (T.REPORT_LOSS if any(j < i for j in places("said")) else 1)
        assert g.features(" ".join(words).encode())[1] == pytest.approx(want)


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"  # smaller tables hold too few labelled rows
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = QUERIES["op1_toxicity"](spark, sf_dir).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = ([r for r in rows if r.toxic == y] for y in (1, 0))
    wins = np.mean([(a.score > b.score) + 0.5 * (a.score == b.score) for a in bad for b in good])
    assert len(bad) >= 50 and wins > 0.93
    assert np.mean([r.predicted for r in bad]) > 0.85 and np.mean([r.predicted for r in good]) < 0.02


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = list(rng.choice(words, 40))
        if i % 4 == 0:
            text[7] = str(rng.choice(["scummy", "idiotic", "clownish"]))
        rows.append((i, " ".join(text)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = T.toxicity_model(made, marks)
    assert b"scummy" in model[0]
    scored = T.score_toxicity(made, model).collect()
    assert len(scored) == 400 and all(0 <= r.score <= 1 for r in scored)
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.95


def test_toxicity_scores_do_not_move_with_the_sample(spark):
    """per_class binds for no class, for one and for both; the word is weak evidence at the shares of the labels."""
    rng = np.random.default_rng(3)
    rows, marks = [], []
    for i in range(12_000):
        toxic = int(i % 20 == 0)
        text = [f"w{x}" for x in rng.integers(0, 300, 12)]
        if rng.random() < (0.9 if toxic else 0.06):
            text[5] = "scummy"
        rows.append((i, " ".join(text)))
        marks.append((i, 1, toxic))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    probe = spark.createDataFrame([(1, "what a scummy thing"), (2, "a plain thing")], "doc_id long, text string")
    scores = []
    for per_class in (20_000, 1000, 400):
        model = T.toxicity_model(made, labels, per_class=per_class)
        scores.append([r.score for r in T.score_toxicity(probe, model).orderBy("doc_id").collect()])
    for got in scores:
        assert 0.25 < got[0] < 0.65 and got[1] < 0.05  # 0.44 by the shares; 0.94 in a sample of equal classes
        assert abs(got[0] - scores[0][0]) < 0.2


def test_toxicity_on_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = T.toxicity_model(odd, none)
    assert model[0] == {}
    assert Counter(r.doc_id for r in T.score_toxicity(odd, model).collect()) == Counter(r[0] for r in ODD_ROWS)
    assert T.score_toxicity(odd.limit(0), model).collect() == []


def test_quality_separates(docs, labels):
    model = Q.quality_model(docs, labels)
    rows = Q.score_quality(docs, model).join(labels.where("quality is not null"), "doc_id").collect()
    right = np.mean([(r.score >= 0.7) == (r.quality == 1) for r in rows])
    assert right > 0.85


def test_quality_sample_stays_off_the_driver(docs, labels, monkeypatch):
    """A task fits on the sample; only the model comes to the driver."""
    def refuse(self):
        raise AssertionError("rows of the sample on the driver")

    monkeypatch.setattr(type(docs), "toArrow", refuse)
    ratios, w, logistic = Q.quality_model(docs, labels)
    assert ratios.shape == (Q.PLACES,) and w.any() and logistic.shape == (2,)
    one_class = labels.where("quality = 1")
    assert not Q.quality_model(docs, one_class)[1].any()


def test_indicators_are_the_set_of_ngrams():
    marks = np.zeros(Q.PLACES, bool)
    one = Q.indicators(b"abcabc", marks)
    assert not marks.any() and len(one) == len(set(one.tolist()))
    assert len(Q.indicators(b"", marks)) == len(Q.indicators(None, marks)) == 0
    long = b"abcde" * (Q._PIECE // 3)
    assert (Q.indicators(long, marks) == Q.indicators(b"abcde" * 4, marks)).all()


def test_dual_descent_meets_the_conditions():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(50, 6, replace=False)) for _ in range(60)]
    y = np.array([int(r[0] < 4) for r in rows])
    ratios = Q.log_count_ratios(rows, y)
    w = Q.dual_descent(rows, y, ratios, rounds=200)
    assert np.mean([(Q.margin(r, ratios, w) > 0) == (t == 1) for r, t in zip(rows, y, strict=True)]) > 0.95


def test_quality_on_odd_rows(spark, odd):
    model = Q.quality_model(odd, spark.createDataFrame([(1, None, 1), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int"))
    got = Q.score_quality(odd, model, keep=odd.columns).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert Q.score_quality(odd.limit(0), model).collect() == []


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.mark.parametrize(
    "text",
    ["a@b.cc_d@e.ff x", "a@b a@b.c@d.e", "1.2.3.4.5.6.7.8", "300.1.1.1.2 001.02.3.4", "4111 1111-1111 1111 4111111111111112", "+1 (456) 555-2186 +12+3456 7890 1",
     "ü x.y@é.de ü@b.de", "@@a@b.c", "4111111111111111 22", "1.2.3", "+1 22 333 4444 +", "a.b@c-.d-.e.", "00000255.1.1.1 256.1.1.1 1.1.1.1"],
)
def test_base_spans_are_those_of_the_patterns(text):
    assert [f"{P.KINDS[k]}:{s}:{e}" for k, s, e, added, _ in P.find_spans(text) if not added] == base_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "part", "value"),
    [("mail jane [at] site [dot] org now", "email", "jane [at] site [dot] org", "jane@site.org"), ("mail jane at site dot org now", "email", "jane at site dot org", "jane@site.org"),
     ("to jаne@sitе.org !", "email", "jаne@sitе.org", "jane@site.org"), ("ip 10[.]0[.]0[.]7 x", "ip", "10[.]0[.]0[.]7", "10.0.0.7"),
     ("ｊａｎｅ＠site．org", "email", "ｊａｎｅ＠site．org", "jane@site.org"),
     ("card four one one one 1111 1111 one one one one .", "card", "four one one one 1111 1111 one one one one", "4 1 1 1 1111 1111 1 1 1 1"),
     ("call plus four nine 170 555 123 now", "phone", "plus four nine 170 555 123", "+4 9 170 555 123"), ("x ja​ne@site.org", "email", None, None)],
)
def test_disguises_are_found_at_their_source(text, kind, part, value):
    added = [(P.KINDS[k], text[s:e], v) for k, s, e, a, v in P.find_spans(text) if a]
    if part is None:  # a base span of the kind stands there already
        assert added == [] and any(P.KINDS[k] == kind for k, *_ in P.find_spans(text))
    else:
        assert added == [(kind, part, value)]


@pytest.mark.parametrize(
    ("text", "value"),
    [("ann at mail dot pl", "ann@mail.pl"), ("so ann at mail dot se and more", "ann@mail.se"), ("ann at firm dot dev", "ann@firm.dev"), ("ann at mail dot ru", "ann@mail.ru"),
     ("ann at mail.pl", "ann@mail.pl"), ("please write to ann at firm.eu soon", "ann@firm.eu"), ("j.doe at firm.com is", "j.doe@firm.com"),
     ("x a dot b at c dot d dot e dot f dot g dot h dot com", "a.b@c.d.e.f.g.h.com"), ("ann at mail [dot] zone", "ann@mail.zone"), ("j at firm dot in", "j@firm.in"),
     ("ann       at       mail\t\t\t\t\t\tdot com", "ann@mail.com")],
)
def test_spelled_addresses_of_any_ending(text, value):
    [(kind, s, e, added, found)] = P.find_spans(text)
    assert (P.KINDS[kind], added, found) == ("email", True, value)
    assert text[s] == value[0] and text[:e].endswith(value.rsplit(".", 1)[1])


@pytest.mark.parametrize(
    "text",
    ["we look at google.com today", "stay at home.It was", "look at the dot com boom", "polka at polka dot dress.", "at some point in time", "j at firm dot in the end",
     "seen at a.b dot", "read at firm.com/page"],
)
def test_places_are_no_addresses(text):
    assert P.find_spans(text) == []


def test_places_of_the_plain_form_are_those_of_the_source():
    """Against a walk that keeps the span of every character."""
    rng = np.random.default_rng(5)
    parts = ["ann", " at ", "mail", " dot ", "com", "аб", "​", "①⑩", " one ", "plus 4", "[at]", "x", " ", "．", "９", "\n"]
    for _ in range(300):
        text = "".join(rng.choice(parts, 25))
        plain = P.PlainForm(text)
        spans, changed, at, done = [], [], 0, 0
        for start, end, low, high in zip(plain.starts, plain.ends, plain.lows, plain.highs, strict=True):
            assert text[at:low] == plain.text[done:start]
            spans += [(i, i + 1) for i in range(at, low)] + [(low, high)] * (end - start)
            changed += [False] * (low - at) + [True] * (end - start)
            at, done = high, end
        spans += [(i, i + 1) for i in range(at, len(text))]
        changed += [False] * (len(text) - at)
        assert text[at:] == plain.text[done:] and [plain.source(i) for i in range(len(plain.text))] == spans
        for start, end in rng.integers(0, len(plain.text) + 1, (30, 2)):
            if start < end:
                gap = spans[end - 1][1] - spans[start][0] > end - start
                assert plain.changed(start, end) == (any(changed[start:end]) or gap)


def test_pii_of_a_long_text_stays_small():
    text = "plain words and one аn odd at place dot com. " * 45_000
    tracemalloc.start()
    found = P.find_spans(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 45_000 and peak < 15 * len(text)


@pytest.mark.parametrize("text", ["look at the dot here", "one two three", "meet at noon", "дом at home dot", "un dos tres vier fünf 12", "point point", ""])
def test_clean_texts_stay_clean(text):
    assert P.find_spans(text) == []


def test_pii_query_against_the_patterns(spark, sf_dir, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in QUERIES["op3_pii"](spark, sf_dir).collect():
        want = ",".join(base_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_pii_on_odd_rows(odd):
    assert [r.spans for r in P.find_pii(odd).collect()] == [[]] * len(ODD_ROWS)
    assert P.find_pii(odd.limit(0)).collect() == []
    assert P.find_spans("a" * 300_000 + " 1" * 100_000) == []


def hits(words, items):
    hit, found = set(), set()
    for item, text in items:
        w = D.words_of(text)
        size = min(10, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(words) - size + 1 if size else 0):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(item)
    return hit, found


def test_wu_manber_against_brute_force():
    rng = np.random.default_rng(5)
    word = lambda n: b" ".join(rng.choice([b"a", b"b", b"c"], n))
    for _ in range(60):
        items = [(i, word(int(rng.integers(0, 14)))) for i in range(4)] + [(9, None)]
        words = D.words_of(word(80))
        runs, found = D.scan(words, D.searches(items, 10))
        hit, want = hits(words, items)
        assert {i for a, b in runs for i in range(a, b)} == hit and found == want
        assert all(x[1] < y[0] for x, y in zip(runs, runs[1:], strict=False))


def test_decontamination_in_blocks_and_odd_rows(spark, odd, docs, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = {r.doc_id: (r.n_words, r.runs, r["items"]) for r in D.find_contamination(docs, bench).collect()}
    many = {r.doc_id: (r.n_words, r.runs, r["items"]) for r in D.find_contamination(docs, bench, block_bytes=2000).collect()}
    assert one == many and any(v[1] for v in one.values())
    items = spark.createDataFrame([(1, None), (None, "plain words here"), (2, "Plain, words!"), (2, "here"), (3, "")], "item_id long, text string")
    got = D.find_contamination(odd, items, keep=[c for c in odd.columns]).collect()
    assert sorted((r.n_words, r.runs, r["items"]) for r in got if r.doc_id == 3) == [(3, [[0, 3]], [2])] * 2
    assert all(r["items"] == [] for r in got if r.doc_id != 3) and len(got) == len(ODD_ROWS)
    assert D.find_contamination(odd.limit(0), items).collect() == []
    assert all(r.runs == [] for r in D.find_contamination(odd, items.limit(0)).collect())


def test_language_model_is_normalised():
    counts = N.Counts(100, 6, [(b"a", 40), (N.END, 30), (b"b", 20)], np.full(N.ENDINGS, 1.0), np.full(N.ENDINGS, 1.0))
    _, share = N.vocabulary(counts)
    model = N.Model(share)
    model.learn(np.array([0, 1]), np.array([1, 2]), np.array([2, 0]), np.ones(2, np.float32), np.random.default_rng(0))
    near, far, norm = model.tables()
    some = 10.0 ** (near[5][None, :] + far[[3, 9]] - norm[[3, 9], 5][:, None])
    assert np.allclose(some.sum(axis=1), 1, atol=1e-3)


def test_language_model_counts_and_held_out(spark, sf_dir):
    larger = os.path.join(os.path.dirname(sf_dir), "sf0.01")
    rows = QUERIES["op9_neural_lm"](spark, larger).collect()
    words = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    counts = Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w)
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(words)
    for r in rows:
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        want = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        assert r.base_score == pytest.approx(want, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_on_odd_rows(odd):
    got = N.score_texts(odd, odd.where("doc_id = 3")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD_ROWS)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1} and all(math.isfinite(r.score) for r in got)
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in N.score_texts(odd, odd.limit(0)).collect())
    assert N.score_texts(odd.limit(0), odd).collect() == []
