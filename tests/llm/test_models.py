"""Language identification, the quality classifier and token histograms."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import lang_id, quality_pu, token_hist
from treeloom.llm.queries import VOCABULARY

SYLLABLES = {"xx": "ka ro mi tu sa ne lo pi".split(), "yy": "schr ung lich ein aus ver gen".split(), "zz": "ção ñe ães lhe ndo por".split()}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_probabilities_sum_to_one():
    texts = [text("xx", 50, k) for k in range(20)]
    m = lang_id.Model.learn(texts)
    alphabet = sorted(set("".join(texts)))
    for context in ("\x01\x01\x01\x01", "karo", "ro m", "qqqq"):
        p = 0.0
        for c in alphabet:
            codes, places = lang_id.encode([(context, c)], m.order)
            h = [x[places] for x in lang_id.gram_hashes(codes, m.order)]
            e = [x[places - 1] for x in lang_id.gram_hashes(codes, m.order - 1)]
            p += float(np.exp(m.log_prob(h, e)[0]))
        assert p == pytest.approx(1.0, abs=0.02) and p < 1.0 + 1e-9  # the rest is for unseen characters


def test_pieces_do_not_change_the_entropy(monkeypatch):
    m = {k: lang_id.Model.learn([text(k, 200, 1)]) for k in SYLLABLES}
    long = lang_id.normal(text("yy", 3000, 5))
    whole = lang_id.Scorer(m).entropies([long, "", long[:7]])
    monkeypatch.setattr(lang_id, "PIECE", 101)
    cut = lang_id.Scorer(m).entropies([long, "", long[:7]])
    assert np.allclose(whole[[0, 2]], cut[[0, 2]]) and np.isinf(whole[1]).all()


def test_language_id_on_held_out_rows(spark):
    rows = [(k, text(lang, 12, k), lang, "z") for k, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000, None, "xx", "z"), (1001, "", "xx", "z"), (1002, "123 !? ²", "xx", "z"), (None, text("xx", 10, 7), None, "z"), (5, text("yy", 10, 8), None, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    fold = lang_id.held_out(F.col("doc_id"))
    t = lang_id.train(d, fold=F.coalesce(~fold, F.lit(False)))
    got = {(r.doc_id, (r.score > 0.5)): r for r in lang_id.predict(d, t).collect()}
    by = {k[0]: v for k, v in got.items()}
    assert np.mean([by[k].lang_pred == lang for k, _, lang, _ in rows[6:180]]) > 0.98
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (1000, 1001, 1002))
    assert by[None].lang_pred == "xx" and all(0 <= r.score <= 1 for r in got.values())


def test_a_long_text_does_not_end_the_sample(spark):
    rows = [(1000 * n + k, f"{lang} short text", lang) for n, lang in enumerate(SYLLABLES) for k in range(30)]
    rows += [(9000 + 10 * n + k, "long " * 1000, lang) for n, lang in enumerate(SYLLABLES) for k in range(4)] + [(9999, "alone " * 1000, "vv")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_id.learning_sample(d, "doc_id", "text", "lang", F.lit(True), 1500, 2500).collect()
    assert sorted((r.lang, len(r.text)) for r in got) == sorted([(lang, 13) for lang in SYLLABLES for _ in range(30)] + [("vv", 2500)])
    assert lang_id.fitting(["a" * 9, "b" * 3, "c" * 8, "d" * 2], 6) == ["bbb", "dd"] and lang_id.fitting(["a" * 9], 6) == ["a" * 6]


def test_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert lang_id.train(d) is None
    assert [r.lang_pred for r in lang_id.predict(d, None).collect()] == ["und"]
    labels = spark.createDataFrame([(1, 0)], "doc_id long, quality int")
    assert quality_pu.train(d, labels) is None
    assert [(r.score, r.predicted) for r in quality_pu.score(d, None).collect()] == [(0.5, 1)]


def test_non_negative_risk_recovers_the_classes():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1.2, 1, (1500, 4)), rng.normal(-1.2, 1, (500, 4))
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    w = quality_pu.fit(one(good[:500]), one(np.vstack([good[500:], bad])), 1000 / 1500)
    assert (quality_pu.sigmoid(one(good) @ w) > 0.5).mean() > 0.95
    assert (quality_pu.sigmoid(one(bad) @ w) < 0.5).mean() > 0.8


def test_quality_classifier(spark):
    clean = [(k, text("xx", 60, k).capitalize() + ".", "s") for k in range(300)]
    junk = [(1000 + k, " ".join(w + "$$$" for w in text("xx", 60, k).split()), "s") for k in range(60)] + [(2000 + k, "go " * 80, "s") for k in range(40)]
    d = spark.createDataFrame(clean + junk + [(5000, None, "s"), (5001, "", "s"), (None, "abc " * 40000, "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, 1) for k, *_ in clean[::2]] + [(k, 0) for k, *_ in junk[::2]] + [(None, 1), (7, None)], "doc_id long, quality int")
    fold = quality_pu.held_out(F.col("doc_id"))
    t = quality_pu.train(d, labels, fold=F.coalesce(~fold, F.lit(False)))
    got = {r.doc_id: r for r in quality_pu.score(d, t).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[k].predicted for k, *_ in clean]) > 0.97
    assert np.mean([got[k].predicted for k, *_ in junk]) < 0.1


def test_features_do_not_depend_on_pieces(monkeypatch):
    t = (text("zz", 400, 3) + "\n### A\n") * 3
    whole = quality_pu.vector(t)
    monkeypatch.setattr(quality_pu, "PIECE", 1000)
    assert np.allclose(whole, quality_pu.vector(t), atol=0.02)


def test_token_histogram(spark):
    texts = ["hello world", "", None, "<|endoftext|> is text", "a" * 5000, "hello world"] + [text("xx", k, k) for k in range(1, 60)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    with open(VOCABULARY, "rb") as f:
        e = token_hist.load_encoding(f.read())
    lengths = [len(e.encode_ordinary(t or "")) for t in texts]
    h = token_hist.length_histogram(token_hist.token_lengths(d, VOCABULARY)).cache()
    rows = {r.context_limit: r for r in h.collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        reach = [x for x in lengths if x >= n]
        assert (r.n_docs, r.docs_reaching, r.tokens_reaching) == (lengths.count(n), len(reach), sum(reach))
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.tokens_cut == sum(lengths) - r.truncated_total
        assert r.quantile == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = [0, 1, 7, 100, 10**6]
    assert {r.limit: r.truncated_total for r in token_hist.at_limits(h, limits).collect()} == {x: sum(min(y, x) for y in lengths) for x in limits}
    assert {r.share: r.n_tokens for r in token_hist.quantiles(h, [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[(len(lengths) + 1) // 2 - 1], 1.0: max(lengths)}
    assert token_hist.length_histogram(token_hist.token_lengths(d.limit(0), VOCABULARY)).count() == 0


def test_token_counts_of_long_texts_and_clashing_columns(spark):
    texts = [text("yy", 20000, 1), text("zz", 3, 2), None]
    d = spark.createDataFrame([(t, "a", 1, 2) for t in texts], "text string, _text string, n_tokens int, context_limit int")
    with open(VOCABULARY, "rb") as f:
        e = token_hist.load_encoding(f.read())
    assert sorted(r.n_tokens for r in token_hist.token_lengths(d, VOCABULARY).collect()) == sorted(len(e.encode_ordinary(t or "")) for t in texts)
    empty = token_hist.length_histogram(token_hist.token_lengths(d.limit(0), VOCABULARY))
    assert token_hist.at_limits(empty, [5]).count() == 0 and token_hist.quantiles(empty, [0.5]).count() == 0


def plain_kneser_ney(texts, order):
    """Log probability of a character after a context, from counts kept in dictionaries."""
    counts = [None] + [Counter() for _ in range(order)]
    for t in texts:
        t = "\x01" * (order - 1) + t
        for at in range(order - 1, len(t)):
            counts[order][t[at - order + 1 : at + 1]] += 1
    for k in range(order - 1, 0, -1):  # distinct predecessors
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    totals, follow, discounts = [], [], []
    for k in range(order + 1):
        totals.append(defaultdict(int))
        follow.append(defaultdict(int))
        for g, c in (counts[k] or {}).items():
            totals[k][g[:-1]] += c
            follow[k][g[:-1]] += 1
        once, twice = (sum(c == x for c in (counts[k] or {}).values()) for x in (1, 2))
        discounts.append(once / (once + 2 * twice) if once else 0.5)
    uniform = 1 / (len(counts[1]) + 1)

    def log_prob(context, c):
        p = uniform
        for k in range(1, order + 1):
            h = context[len(context) - k + 1 :]
            if totals[k][h]:
                p = max(counts[k][h + c] - discounts[k], 0) / totals[k][h] + discounts[k] * follow[k][h] / totals[k][h] * p
        return math.log(p)

    return lambda t: -sum(log_prob(("\x01" * (order - 1) + t)[at : at + order - 1], c) for at, c in enumerate(t)) / len(t)


@pytest.mark.parametrize("order", [2, 5])
def test_models_follow_plain_kneser_ney(order):
    learnt = [text("xx", 30, k) for k in range(12)] + ["a", "ba"]
    plain = plain_kneser_ney(learnt, order)
    scorer = lang_id.Scorer({"xx": lang_id.Model.learn(learnt, order)})
    asked = [text("xx", 9, 99), text("zz", 9, 98), "k", "???", learnt[0]]
    assert scorer.entropies(asked)[:, 0] == pytest.approx([plain(t) for t in asked], rel=1e-6)


def test_language_ties_empty_tables_and_long_texts(spark, monkeypatch):
    schema = "doc_id long, text string, lang string"
    same = [(10 * n + k, f"equal words {k % 3} for both", lang) for n, lang in enumerate(("b", "a")) for k in range(40)]
    d = spark.createDataFrame(same + [(900, "equal words for both " * 60000, None)], schema)
    t = lang_id.train(d)
    got = {r.doc_id: r for r in lang_id.predict(d, t).collect()}
    assert {r.lang_pred for r in got.values()} == {"a"}  # of equal models the first name
    assert got[900].lang_pred == "a" and got[900].score == pytest.approx(0.5)
    empty = spark.createDataFrame([], schema)
    assert lang_id.train(empty) is None and lang_id.predict(empty, t).count() == 0


def test_risk_and_step_follow_the_definition():
    rng = np.random.default_rng(3)
    p, u, w = rng.normal(0.4, 1, (7, 3)), rng.normal(0, 1, (9, 3)), rng.normal(0, 1, 3)
    s = lambda x, w: 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, w, strict=True))))

    def parts(w, prior):
        first = prior * sum(-math.log(s(x, w)) for x in p) / len(p)
        return first, sum(-math.log(1 - s(x, w)) for x in u) / len(u) - prior * sum(-math.log(1 - s(x, w)) for x in p) / len(p)

    seen = set()
    for prior in (0.1, 0.9, 3.0):  # the last makes the second part negative
        assert quality_pu.risk_parts(w, p, u, prior) == pytest.approx(parts(w, prior))
        negative = parts(w, prior)[1] < 0
        seen.add(negative)
        goal = (lambda w: -parts(w, prior)[1]) if negative else (lambda w: sum(parts(w, prior)))  # noqa: B023
        slope = [(goal(w + 1e-6 * e) - goal(w - 1e-6 * e)) / 2e-6 for e in np.eye(3)]
        assert quality_pu.step_direction(w, p, u, prior) == pytest.approx(slope, abs=1e-6)
    assert seen == {True, False}


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_the_class_prior_comes_from_unlabelled_text(prior):
    rng = np.random.default_rng(11)
    n = 6000
    one = lambda x: np.hstack([x, np.ones((len(x), 1))])
    unlabelled = np.vstack([rng.normal(1.5, 1, (int(n * prior), 3)), rng.normal(-1.5, 1, (n - int(n * prior), 3))])
    assert quality_pu.estimate_prior(one(rng.normal(1.5, 1, (2000, 3))), one(rng.permutation(unlabelled))) == pytest.approx(prior, abs=0.06)


def test_the_learning_sample_is_bounded_and_ignores_repeats(spark):
    rows = [(k, text("xx", 20, k)) for k in range(400)] + [(3, text("xx", 20, 3))] * 200 + [(5, f"other text {k}") for k in range(50)] + [(None, "null id")] * 9
    d = spark.createDataFrame(rows, "doc_id long, text string")
    usable = spark.createDataFrame([(k, 1) for k in range(20)] + [(3, 1)] * 3 + [(30, 0)], "_l long, _y int")
    got = quality_pu.learning_sample(d, usable, "doc_id", "text", 12, 100).collect()
    assert sum(r.y for r in got) == 12 and len(got) == 112
    got = quality_pu.learning_sample(d, usable, "doc_id", "text", 100, 10000).collect()
    assert sum(r.y for r in got) == 20 and len(got) == 20 + 451
    again = quality_pu.learning_sample(d.repartition(7), usable, "doc_id", "text", 12, 100).collect()
    assert sorted(again) == sorted(quality_pu.learning_sample(d, usable, "doc_id", "text", 12, 100).collect())


def test_classifier_on_an_empty_table(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality_pu.train(docs, labels) is None and quality_pu.score(docs, None).count() == 0
    one = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = quality_pu.score(one, quality_pu.train(one, labels)).collect()
    assert len(got) == 3 and len({r.score for r in got if r.doc_id == 1}) == 1
