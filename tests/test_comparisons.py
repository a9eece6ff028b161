"""Indel lengths against the objective's formula, and heads beside each other against plain sums."""

import math

import numpy as np
import pandas as pd
import pytest

from readlens.models import indel
from readlens.models.heads import Head
from readlens.models.spec import SpecError
from readlens.operators import model_compare as mc
from readlens.table import CountTable

ALPHABET = (2, 12, 30)
EVENTS = "indel string, indel_length int, run int, q int, n long"


def events(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, int(min(1 + rng.geometric(0.8 if k == "D" else 0.5), 7)), int(rng.integers(1, 12)), int(rng.choice(ALPHABET)), int(rng.integers(1, 9))) for k in "ID" for _ in range(150)]
    return rows, spark.createDataFrame(rows, EVENTS)


def test_indel_lengths_minimise_the_penalised_likelihood(spark):
    rows, df = events(spark)
    c = indel.fit(df, "IndelLength(4)", ALPHABET, l2=0.7)
    assert c.arrays["bias"].shape == (2, 4) and c.arrays["run"].shape == (2, 8, 4) and c.arrays["q"].shape == (2, 3, 4)
    grads = {k: 0.7 * a.copy() for k, a in c.arrays.items()}
    ll = 0.0
    for k, length, run, q, n in rows:
        at = "ID".index(k), min(run, 8) - 1, ALPHABET.index(q)
        x = c.arrays["bias"][at[0]] + c.arrays["run"][at[0], at[1]] + c.arrays["q"][at[0], at[2]]
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        g = n * p
        g[min(length, 4) - 1] -= n
        ll += n * math.log(p[min(length, 4) - 1])
        grads["bias"][at[0]] += g
        grads["run"][at[0], at[1]] += g
        grads["q"][at[0], at[2]] += g
    assert max(np.abs(g).max() for g in grads.values()) < 1e-4
    assert indel.log_likelihood(c, df, ALPHABET) == pytest.approx(ll)
    p = indel.probabilities(c, pd.DataFrame({"indel": ["I", "D"], "run": [1, 30], "q": [2, 30]}), ALPHABET)
    assert np.allclose(p.sum(axis=1), 1) and p[1, 1] > p[0, 1]


def test_indel_edge_cases(spark):
    rows, df = events(spark)
    for token in ("IndelLength", "IndelLength(0)", "Mate"):
        with pytest.raises(SpecError):
            indel.fit(df, token, ALPHABET)
    with pytest.raises(SpecError, match="alphabet"):
        indel.fit(df, "IndelLength(3)", (2, 12))
    none = indel.fit(df.filter("false"), "IndelLength(3)", ALPHABET)
    assert all((a == 0).all() for a in none.arrays.values())
    assert np.allclose(indel.fit(df.unionByName(df), "IndelLength(3)", ALPHABET, l2=2.0).arrays["run"], indel.fit(df, "IndelLength(3)", ALPHABET, l2=1.0).arrays["run"], atol=1e-5)


def heads(seed):
    rng, out = np.random.default_rng(seed), []
    for tokens, slots in ((["QualityWindow(0)", "Context(1,1)"], 1 + 4 + 15), (["QualityWindow(0)", "Mate"], 1 + 4 + 2)):
        h = Head("E", tokens, ALPHABET, (1, 1), 20)
        h.theta = rng.normal(size=(slots, 10))
        h.theta[0, 0] += 3
        out.append(h)
    return out


def compared(spark, indels):
    rng = np.random.default_rng(3)
    rows = {}
    for _ in range(400):
        context = "".join(rng.choice(list("ACGT"), 3))
        op = rng.choice(["=", context[1] + ">" + "CGTA"["ACGT".index(context[1])], "->A", context[1] + ">-"], p=[0.7, 0.2, 0.05, 0.05])
        rows[int(rng.choice(ALPHABET)), context, int(rng.integers(1, 3)), int(rng.integers(1, 12)), str(op)] = int(rng.integers(1, 60))
    table = pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["q", "context", "mate", "pos_start", "op", "n"])
    df = spark.createDataFrame(table.values.tolist(), "q int, context string, mate int, pos_start int, op string, n long")
    a, b = heads(4)
    own = table if indels else table[~table.op.str.contains("-")]
    p = []
    for h in (a, b):
        x = np.exp(h.log_probabilities(own.reset_index(drop=True)))[:, : 10 if indels else 5]
        p.append(x / x.sum(axis=1, keepdims=True))
    fields = ("q", "context", "mate", "pos_start", "op")
    return mc.predicted(CountTable(df, fields, truth=True), a, b, indels), own.reset_index(drop=True), p


@pytest.mark.parametrize("indels", [False, True])
def test_heads_beside_each_other(spark, indels):
    rows, own, (a, b) = compared(spark, indels)
    n = own.n.to_numpy(float)
    kinds = Head._categories(own.op)
    got = mc.overall(rows).first()
    rate = lambda p, s=slice(None): float(n[s] @ (1 - p[s, 0]) / n[s].sum())
    assert got.rows == n.sum() and got.rate_a == pytest.approx(rate(a)) and got.ratio == pytest.approx(rate(b) / rate(a)) and got.excess == pytest.approx(rate(b) - rate(a))
    assert got.op_tv == pytest.approx(float(n @ np.abs(a - b).sum(axis=1) / 2 / n.sum()))
    assert got.log_likelihood_b == pytest.approx(float(n @ np.log(b[np.arange(len(n)), kinds]) / n.sum()))
    parts = mc.by_component(rows, least=100).collect()
    assert [r.value for r in parts if r.axis == "pos_start"] == sorted((r.value for r in parts if r.axis == "pos_start"), key=int)
    for r in parts:
        s = (own[r.axis].astype(str) == r.value).to_numpy()
        assert r.n == n[s].sum() >= 100 and (r.rate_a, r.rate_b) == pytest.approx((rate(a, s), rate(b, s)))
    shape = mc.context_shape(rows, least=50).first()
    each = [((own.context == c).to_numpy()) for c in sorted(set(own.context)) if n[(own.context == c).to_numpy()].sum() >= 50]
    x, y = (np.array([math.log(rate(p, s) / (1 - rate(p, s))) for s in each]) for p in (a, b))
    assert shape.contexts == len(each) and shape.r == pytest.approx(np.corrcoef(x, y)[0, 1]) and shape.log_odds_slope == pytest.approx(np.polyfit(x, y, 1)[0])
    mass = {r.category: (r.share_a, r.share_b) for r in mc.label_mass(rows).collect()}
    for k, (x, y) in enumerate(mass[c] for c in sorted(mass, key=lambda c: ["=", ">A", ">C", ">G", ">T", "->A", "->C", "->G", "->T", "-"].index(c))):
        assert x == pytest.approx(float(n @ a[:, k + 1] / (n @ a[:, 1:].sum(axis=1)))) and y == pytest.approx(float(n @ b[:, k + 1] / (n @ b[:, 1:].sum(axis=1))))


def test_comparison_edge_cases(spark):
    rows, *_ = compared(spark, False)
    none = rows.filter("false")
    assert mc.overall(none).first().rows is None and mc.by_component(none).count() == 0 and mc.label_mass(none).count() == 0
    assert mc.context_shape(none).first().contexts == 0 and mc.context_shape(rows.filter("context = 'AAA'")).first().r is None
    with pytest.raises(ValueError, match="none of"):
        mc.by_component(rows, ("tile",))
