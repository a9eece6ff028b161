"""Language ID, LM scoring and toxicity: held-out accuracy, brute-force counts and edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from readlens.llm import langid, learn, maxent, toxicity

from .conftest import EDGES

SYLLABLES = {"en": ["the", "ing", "ou", "sh", "er"], "de": ["sch", "ung", "ei", "ü", "ch"], "fr": ["eau", "que", "é", "oi", "ment"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def fold(k, m):
    return zlib.crc32(str(k).encode()) % m


def held(m, r):
    return F.crc32(F.col("doc_id").cast("string")) % m == r


def test_language_identification(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, lang, 30), lang) for k in range(300) for lang in [rng.choice(list(SYLLABLES))]] + [(900, None, "en"), (901, "12 !!", "de"), (902, prose(rng, "de", 20), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identify(df, held(4, 2)).collect()}
    assert len(out) == len(rows)
    test = [(k, lang) for k, _, lang in rows[:300] if fold(k, 4) == 2]
    assert all(out[k].held_out for k, _ in test) and not out[next(k for k, *_ in rows if fold(k, 4) != 2)].held_out
    assert sum(out[k].lang_pred == lang for k, lang in test) >= 0.95 * len(test)
    assert out[900].lang_pred == out[901].lang_pred == "und" and out[902].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_edge_cases(edges, nothing):
    assert langid.identify(edges.select("doc_id", "text", "lang", "key"), held(4, 2)).count() == len(EDGES)
    assert langid.identify(nothing, held(4, 2)).count() == 0
    none = langid.identify(edges.withColumn("lang", F.lit(None).cast("string")), held(4, 2)).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(200, 12, replace=False)), np.ones(12)) for _ in range(600)]
    labels = np.array([int(5 in r[0] or 9 in r[0]) for r in rows])
    dense, sparse = (learn.fit(rows, np.eye(2)[labels], 200, learn.Ftrl(alpha=0.5, l1=l1, l2=0.1, epochs=5)) for l1 in (0.0, 2.0))
    assert np.mean([learn.logits(sparse, r).argmax() == y for r, y in zip(rows, labels)]) > 0.97
    used = lambda w: (w[:, :-1] != 0).any(axis=0).sum()
    assert used(dense) == 200 and used(sparse) < 100
    assert {5, 9} == set(np.argsort(-np.abs(sparse[1, :-1]))[:2].tolist())


def test_temperature_minimises_log_loss():
    rng = np.random.default_rng(1)
    scores = rng.normal(size=(2000, 3))
    labels = np.array([rng.choice(3, p=learn.softmax(2 * s)) for s in scores])
    assert abs(learn.temperature(scores, labels) - 0.5) < 0.06


def test_language_model_counts_and_scores(spark):
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.choice(["en", "de"]), rng.randint(0, 60))) for k in range(200)] + [(500, None), (501, "Only NEW words here"), (502, "x\x0by  z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in maxent.score(df, held(10, 0), maxent.Params(frequent=50, sample=150)).collect()}
    counts = Counter(w for k, t in rows if fold(k, 10) != 0 for w in maxent.tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    assert len(out) == len(rows)
    for k, text in rows:
        tokens = maxent.tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens)
        own = out[k]
        assert (own.n_tokens, own.n_known, own.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert abs(own.base_score - base) < 1e-6 and own.score < 0
    assert maxent.tokens("A\tÀ \x0b\x1cb") == [b"a", "À".encode(), b"\x1cb", b""]


def test_language_model_learns_word_order(spark):
    rng = random.Random(9)
    cycle = [f"w{k}" for k in range(24)]
    rows = []
    for k in range(300):
        at = rng.randrange(24)
        rows.append((k, " ".join(cycle[(at + i) % 24] for i in range(40))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    test = [r for r in maxent.score(df, held(10, 0)).collect() if r.held_out]
    assert sum(r.score for r in test) > 0.8 * sum(r.base_score for r in test)  # a fifth better at least, as order tells the next word


def test_language_model_learns_from_all_rows(spark):
    rng = random.Random(12)
    rows = []
    for k in range(400):  # each text goes round one of 40 rings of words; a sample of a few texts knows few rings
        ring, at = rng.randrange(40), rng.randrange(6)
        rows.append((k, " ".join(f"r{ring}w{(at + i) % 6}x{(ring * 7 + at + i) % 6}" for i in range(60))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = [r for r in maxent.score(df, held(10, 0), maxent.Params(sample=4)).collect() if r.held_out]
    assert sum(r.score for r in few) > 0.8 * sum(r.base_score for r in few)


def test_language_model_is_a_distribution():
    params = maxent.Params(own=2, classes=5, buckets=64)
    words = [b"a", b"b", b"cat", b"dog", b"hat"]
    kinds = np.array([0, 1, *(maxent.word_class(w, params) for w in words[2:])])
    n = np.array([9, 7, 4, 3, 2])
    per, many = np.bincount(kinds, n, 5), np.bincount(kinds, minlength=5)
    known = maxent.Vocabulary(params, {w: k for k, w in enumerate(words)}, kinds, n, per, many, 25, 5)
    table = np.random.default_rng(0).normal(size=(64, 5)).astype(np.float32)
    rows = np.repeat(maxent.features(np.array([1]), np.array([1]), np.array([1]), 64), 5, axis=0)
    classes = 10 ** maxent.log_classes(table, rows, np.arange(5))
    assert abs(classes.sum() - 1) < 1e-5
    shares = 10 ** known.within(n, kinds)
    unknown = 10 ** known.within(0, np.arange(5))
    assert np.allclose(np.bincount(kinds, shares, 5) + unknown, 1)


def test_language_model_edge_cases(edges, nothing):
    assert maxent.score(edges, held(10, 0)).count() == len(EDGES)
    assert maxent.score(nothing, held(10, 0)).count() == 0
    alone = maxent.score(edges, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in alone} == {(0, 0)}


def toxic_fold(id_):
    return F.crc32(id_.cast("string")) % 5 == 0


def test_toxicity(spark):
    rng = random.Random(6)
    insults = {"en": ["idiot", "moron", "scum"], "de": ["lumpidei", "lumpidan", "lumpidor", "lumpidus"]}
    rows, labels = [], []
    for k in range(1200):
        lang = rng.choice(["en", "de"])
        words = prose(rng, lang, rng.randint(10, 80)).split()
        toxic = rng.random() < 0.25
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(insults[lang])
        rows.append((k, " ".join(words)))
        labels.append((k, int(any(w in insults[lang] for w in words))))
    df, marks = spark.createDataFrame(rows + [(5000, None), (5001, "")], "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(df, marks, toxic_fold).collect()}
    test = [(out[k].predicted, y) for k, y in labels if out[k].held_out]
    assert len(out) == 1202 and sum(a == b for a, b in test) >= 0.97 * len(test)
    assert out[5000].score == out[5001].score < 0.5
    clean = toxicity.remove(df.withColumn("score", F.lit("x")), marks, toxic_fold)
    assert clean.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in clean.collect()} == {k for k, r in out.items() if r.predicted == 0}


def test_label_model_finds_rates_and_correlations_without_labels():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.2
    table = np.zeros((6000, 7), bool)
    for j, reach in enumerate((0.6, 0.5, 0.4, 0.3)):
        table[:, j] = (y & (rng.random(6000) < reach)) | (~y & (rng.random(6000) < 0.002))
    table[:, 4] = table[:, 0]  # a voter that copies another
    table[:, 5] = rng.random(6000) < np.where(y, 0.1, 0.7)  # a pattern that speaks for clean
    table[:, 6] = rng.random(6000) < 0.3  # and one that says nothing
    rows, counts = np.unique(table, axis=0, return_counts=True)
    model = toxicity.label_model(rows, counts.astype(float), 5, 30)
    assert ((model.posterior(table) > 0.5) == y).mean() > 0.95
    assert 4 in (model.parents[0],) or model.parents[4] == 0  # the copy hangs on what it copies
    plain = lambda j, c: (table[y == c, j]).mean()
    for j in (1, 2, 3, 5, 6):  # rates against those that the hidden classes give
        above = table[:, model.parents[j]] if model.parents[j] >= 0 else np.zeros(6000, bool)
        got = [np.where(above, model.rates[c, j, 1], model.rates[c, j, 0])[y == c].mean() for c in (0, 1)]
        assert abs(got[0] - plain(j, 0)) < 0.05 and abs(got[1] - plain(j, 1)) < 0.08


def test_posterior_of_a_tree_equals_brute_force():
    rng = np.random.default_rng(5)
    model = toxicity.LabelModel(0.3, np.array([-1, 0, 0, 2]), rng.uniform(0.05, 0.95, (2, 4, 2)))
    table = np.array([[m >> j & 1 for j in range(4)] for m in range(16)], bool)
    for row, p in zip(table, model.posterior(table)):
        joint = []
        for c, q in ((0, 0.7), (1, 0.3)):
            for j, up in enumerate((-1, 0, 0, 2)):
                rate = model.rates[c, j, int(row[up]) if up >= 0 else 0]
                q *= rate if row[j] else 1 - rate
            joint.append(q)
        assert abs(p - joint[1] / sum(joint)) < 1e-9


def test_toxicity_edge_cases(spark, edges, nothing):
    marks = spark.createDataFrame([(1, 1), (4, 0), (6, 0)], "doc_id long, toxic int")
    assert toxicity.score(edges, marks, toxic_fold).count() == len(EDGES)
    assert toxicity.score(nothing, marks, toxic_fold).count() == 0
    none = toxicity.score(edges, marks.filter("false"), toxic_fold).collect()
    assert {r.score for r in none} == {0.5} and toxicity.remove(edges, marks.filter("false"), toxic_fold).count() == len(EDGES)
