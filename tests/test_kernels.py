"""Walks, alignments, placements and optimisers on literal inputs and against brute force."""

import hashlib
import math
import random
import tracemalloc
import warnings
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from readlens import functions as fn
from readlens.kernels import newton, realign, walk
from readlens.kernels.place import Rules, place_all
from readlens.models import rake, spread
from readlens.models.heads import Design, Head, Penalised, Penalty
from readlens.models.spec import Component, ModelSpec, SpecError, Token
from readlens.operators import alignments
from readlens.operators import kmers as km


def quality(*values):
    return "".join(chr(v + 33) for v in values)


def test_indel_events_of_a_literal_read():
    read = walk.Read("ACGTTTTGCA", "ACGTTGGGCA", quality(*range(10, 20)), "4M2D2M2I2M")
    assert list(walk.indel_events(read)) == [("D", 2, 4, 14), ("I", 2, 1, 18)]
    masked = walk.Read("ACGTTTTGCA", "ACGTTGGGCA", quality(*range(10, 20)), "4M2D2M2I2M", masked=frozenset({4}))
    assert [e[0] for e in walk.indel_events(masked)] == ["I"]


def test_unknown_bases_make_no_draws():
    read = walk.Read("ACGTCA", "ANGTNCA", quality(*[30] * 7), "4M1I2M")
    assert [row[-1] for row in walk.observations(read, (1, 1), 1)] == ["="] * 5


def test_observations_of_gaps_clips_and_windows():
    read = walk.Read("ACGT", "AGGT", quality(10, 20, 30, 40), "1M1D1M1I1M", clip_before=quality(5), mate=2)
    rows = list(walk.observations(read, (1, 1), 1))
    assert [(r[0], r[-1]) for r in rows] == [(0, "="), (1, "C>-"), (2, "="), (3, "->G"), (3, "=")]
    assert [r[1] for r in rows] == [10, 20, 20, 40, 40]  # a deleted base has the next read base's quality
    assert rows[0][2] == [5, 20] and rows[-1][2] == [20, None]
    assert [r[4] for r in rows] == [2, 3, 4, 5, 5] and rows[0][5] == 4 and rows[0][7] == "-"
    assert walk.gapped(read) == ("ACG-T", "A-GGT", "=D=I=")
    twice = walk.Read("AAAA", "AAGGAA", quality(*[30] * 6), "2M2I2M")
    assert sum(r[-1] == "->G" for r in walk.observations(twice, (0, 0), 0)) == 2
    assert sum(r[-1] == "->G" for r in walk.observations(twice, (0, 0), 0, per_event=True)) == 1


def test_cigar_must_fit():
    with pytest.raises(ValueError):
        walk.Read("ACGT", "ACG", quality(1, 1, 1), "4M")
    with pytest.raises(ValueError):
        walk.parts("3M1S")
    assert walk.encode("MMMIDDM") == "3M1I2D1M"


def brute_score(a, b, s):
    """Best affine score over all alignments, by memo."""
    from functools import cache

    @cache
    def best(i, j, state):
        if i == len(a) and j == len(b):
            return 0
        out = -(10**9)
        if i < len(a) and j < len(b):
            out = max(out, best(i + 1, j + 1, "M") + (s.match if a[i] == b[j] else s.mismatch))
        if i < len(a):
            out = max(out, best(i + 1, j, "D") + s.extend + (0 if state == "D" else s.open))
        if j < len(b):
            out = max(out, best(i, j + 1, "I") + s.extend + (0 if state == "I" else s.open))
        return out

    return best(0, 0, "M")


def test_alignment_score_equals_brute_force():
    rng = random.Random(1)
    s = realign.Scores()
    for _ in range(150):
        a = "".join(rng.choice("AC") for _ in range(rng.randint(1, 7)))
        b = "".join(rng.choice("AC") for _ in range(rng.randint(1, 7)))
        found = realign.align(a, b, s)
        assert found.score == brute_score(a, b, s)
        i = j = 0
        for n, op in walk.parts(found.cigar):
            i += n * (op != "I")
            j += n * (op != "D")
        assert (i, j + found.after) == (len(a), len(b))


def all_best(a, b, s, free):
    """Every way of the best score, as (start, operations): by trying all."""
    from functools import cache

    @cache
    def ways(i, j, state):
        out = [(0, "")] if j == len(b) and (i == len(a) or free) else []
        if i < len(a) and j < len(b):
            out += [(x + (s.match if a[i] == b[j] else s.mismatch), "M" + o) for x, o in ways(i + 1, j + 1, "M")]
        if i < len(a):
            out += [(x + s.extend + (0 if state == "D" else s.open), "D" + o) for x, o in ways(i + 1, j, "D")]
        if j < len(b):
            out += [(x + s.extend + (0 if state == "I" else s.open), "I" + o) for x, o in ways(i, j + 1, "I")]
        top = max((x for x, _ in out), default=0)
        return [(x, o) for x, o in out if x == top]

    found = [(x, i, o) for i in (range(len(a) + 1) if free else [0]) for x, o in ways(i, 0, "M")]
    top = max(x for x, *_ in found)
    return top, {(i, o) for x, i, o in found if x == top}


@pytest.mark.parametrize("free", [False, True])
def test_any_band_finds_a_best_way(free):
    """Narrow bands are widened until nothing outside can be better; all give the same way, which is a best one."""
    rng = random.Random(11)
    s = realign.Scores()
    for _ in range(120):
        a = "".join(rng.choice("ACG") for _ in range(rng.randint(1, 8)))
        b = "".join(rng.choice("ACG") for _ in range(rng.randint(1, 6)))
        found = [realign.align(a, b, s, free, band) for band in (1, 2, 64)]
        assert found[0] == found[1] == found[2]
        top, best = all_best(a, b, s, free)
        ops = "".join(op * n for n, op in walk.parts(found[0].cigar)) + "I" * found[0].after
        assert found[0].score == top and (found[0].start, ops) in best


def test_narrow_bands_equal_wide_ones_on_long_reads():
    rng = random.Random(12)
    for _ in range(6):
        a = "".join(rng.choice("ACGT") for _ in range(400))
        b, i = [], 30
        while i < 370:
            x = rng.random()
            b.append(rng.choice("ACGT") if x < 0.05 else a[i])
            i += 1 + (rng.randint(1, 25) if x > 0.985 else 0)
            if 0.97 < x < 0.985:
                b.append("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 25))))
        for free in (True, False):
            assert realign.align(a, "".join(b), free_ends=free, band=4) == realign.align(a, "".join(b), free_ends=free, band=1000)


def test_long_pairs_stay_small():
    rng = np.random.default_rng(13)
    a = rng.choice(np.frombuffer(b"ACGT", np.uint8), 20_000)
    b = a.copy()
    at = rng.choice(20_000, 3000, replace=False)
    b[at] = rng.choice(np.frombuffer(b"ACGT", np.uint8), 3000)
    b = np.delete(b, rng.choice(20_000, 500, replace=False))
    tracemalloc.start()
    found = realign.align(a.tobytes().decode(), b.tobytes().decode())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 << 20 and found.score > 15_000


def test_reads_without_gaps_as_arrays_equal_the_walk(spark):
    rng = random.Random(21)
    text = lambda n, signs="ACGT": "".join(rng.choice(signs) for _ in range(n))
    rows = []
    for i in range(60):
        n = rng.randint(1, 30)
        template = text(n, "ACGTNa")
        sequence = "".join(rng.choice("ACGTN") if rng.random() < 0.2 else c for c in template)
        cigar = f"{n}M"
        if i % 4 == 0 and n > 6:
            sequence, cigar = sequence[:3] + sequence[5:], f"3M2D{n - 5}M"
        clips = [text(rng.randint(0, 3), "!5I") if i % 3 == 0 else None for _ in range(2)]
        rows.append((i, "c", rng.randint(0, 99), i % 2 == 0, template, sequence, text(len(sequence), "!+5I"), cigar, 1 + i % 2, *clips, rng.choice([None, "+"]), rng.choice([None, [], [0, n - 1, n + 5]])))
    names = "read_id long, contig string, start long, reverse boolean, template string, sequence string, quality string, cigar string, mate int, clip_before string, clip_after string, strand string, masked array<int>"
    df = spark.createDataFrame(rows, names)
    for flank, m in (((2, 1), 1), ((0, 0), 0), ((1, 2), 2)):
        wanted = []
        for r in rows:
            read = walk.Read(*r[4:8], r[9] or "", r[10] or "", r[11], r[8], frozenset(r[12] or ()))
            for t, q, near, *rest in walk.observations(read, flank, m):
                wanted.append((r[0], "c", r[2] + (len(r[4]) - 1 - t if r[3] else t), t, q, *near, *rest))
        assert sorted(map(str, wanted)) == sorted(str(tuple(x)) for x in alignments.observations(df, flank, m).collect())
    assert alignments.observations(df.filter("false")).count() == 0


def test_gaps_are_whole_and_stand_left_on_the_forward_strand():
    window = "GATTACAGGCCAAAATCGTACCGTTAGCATG"
    read = window[4:12] + window[14:27]  # AA of AAAA is gone
    found, before, behind = realign.align_forward(window, read, False)
    assert (found.start, found.end, found.cigar, before, behind) == (4, 27, "7M2D14M", 0, 0)
    turned, before, behind = realign.align_forward(window, walk.revcomp(read), True)
    assert (turned.start, turned.end, turned.cigar, before, behind) == (4, 27, "14M2D7M", 0, 0)
    plain = realign.align(walk.revcomp(window), walk.revcomp(read), free_ends=True)
    assert plain.cigar == "12M2D9M"  # in the read's own direction the gap would be at the run's other end
    longer = read + "TTTTTTTTT"
    kept, before, behind = realign.align_forward(window, longer, False, realign.Scores(2, -9, -1, -1))
    assert behind == 9 - (kept.end - 27) and before == 0 and not kept.cigar.endswith("I")
    back, before, behind = realign.align_forward(window, walk.revcomp(longer), True, realign.Scores(2, -9, -1, -1))
    assert before == 9 - (back.end - 27) and behind == 0 and sum(n for n, op in walk.parts(back.cigar) if op != "D") + before == len(longer)


def test_gaps_stand_left():
    assert realign.align("ACGTTTTGCA", "ACGTTGCA").cigar == "3M2D5M"
    free = realign.align("GGGGACGTACGTCCCC", "ACGTACGT", free_ends=True)
    assert (free.start, free.end, free.cigar) == (4, 12, "8M")


def test_clipped_ends_are_aligned_or_refused():
    reference = "".join(random.Random(3).choices("ACGT", k=100))
    read = reference[20:80]
    found, low = realign.end_to_end(reference, 30, 80, read, 10, 0)
    assert (low + found.start, low + found.end, found.cigar) == (20, 80, "60M")
    other = "".join({"A": "C", "C": "A", "G": "T", "T": "G"}[c] for c in read[:10]) + read[10:]
    assert realign.end_to_end(reference, 30, 80, other, 10, 0) is None


def test_placement_finds_offset_rivals_and_indels():
    seq = "".join(random.Random(8).choices("ACGT", k=120))
    first, second = seq[:70], seq[30:100]
    gone = second[:20] + second[22:] + "AC"
    repeat = "ACGT" * 20
    got = place_all([first, first, first, repeat[:70]], [second, "A" * 70, gone, repeat[:70]], Rules())
    assert (got[0].status, got[0].offset, got[0].overlap, got[0].mismatches) == ("placed", 30, 40, 0)
    assert got[1].status == "no_overlap"
    assert got[2].status == "indel"
    assert got[3].status == "no_overlap" and got[3].rival
    assert place_all([], [], Rules()) == [] and place_all(["ACG"], ["ACG"], Rules())[0].status == "no_overlap"


def test_optimiser_solves_a_quadratic():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(20, 20))
    a, b = a @ a.T + np.eye(20), rng.normal(size=20)
    class Quadratic:
        value = staticmethod(lambda x: (0.5 * x @ a @ x - b @ x, a @ x - b))
        product = staticmethod(lambda x, v: a @ v)
        diagonal = staticmethod(lambda x: np.diag(a))

    found = newton.minimise(Quadratic, np.zeros(20))
    assert found.converged and np.abs(found.x - np.linalg.solve(a, b)).max() < 1e-4


def test_head_gradient_and_fit():
    rng = np.random.default_rng(2)
    alphabet, n = (2, 12, 23, 37), 4000
    rows = pd.DataFrame({"q": rng.choice(alphabet, n), "context": ["".join(x) for x in rng.choice(list("ACGT"), (n, 3))], "mate": rng.integers(1, 3, n)})
    p = {2: 0.2, 12: 0.05, 23: 0.02, 37: 0.005}
    counts = np.zeros((n, 10))
    for i, (q, c) in enumerate(zip(rows["q"], rows["context"])):
        wrong = rng.random() < p[q]
        counts[i, 1 + "ACGT".index("CGTA"["ACGT".index(c[1])]) if wrong else 0] = 1
    head = Head("E", ["QualityWindow(0)", "Context(1,1)", "Mate"], alphabet, (1, 1), 10)
    head.fit(rows, counts)
    probabilities = np.exp(head.log_probabilities(rows))
    assert np.allclose(probabilities.sum(axis=1), 1)
    centre = np.array(["ACGT".index(c[1]) for c in rows["context"]])
    assert (probabilities[np.arange(n), 1 + centre] == 0).all()  # no base is substituted by itself
    for q in alphabet:
        at = (rows["q"] == q).to_numpy()
        assert abs((1 - probabilities[at, 0]).sum() - counts[at, 1:].sum()) < 0.1 * counts[at, 1:].sum() + 3
    with pytest.raises(SpecError):
        Head("E", ["Mate"], alphabet, (1, 1), 10)


def test_objective_derivatives_and_a_separable_fit():
    """Gradient and curvature by differences; and a table where errors are sure by context still converges, to a small gradient."""
    rng = np.random.default_rng(3)
    alphabet = (2, 12, 23, 37)
    rows = pd.DataFrame({"q": rng.choice(alphabet, 60), "context": ["".join(x) for x in rng.choice(list("ACGT"), (60, 3))], "mate": rng.integers(1, 3, 60)})
    counts = np.zeros((60, 10))
    counts[:, 0] = rng.integers(1000, 500_000, 60)
    counts[np.arange(60), 1 + np.array(["CGTA".index(c[1]) for c in rows["context"]])] = rng.integers(1, 20_000, 60)
    counts[np.arange(60), 1 + np.array(["ACGT".index(c[1]) for c in rows["context"]])] = 0
    head = Head("E", ["QualityWindow(0)", "Context(1,1)", "Mate"], alphabet, (1, 1), 10)
    blocks = head.design(rows, True)
    data = Design(np.concatenate([b.places for b in blocks], axis=1), np.concatenate([b.values for b in blocks], axis=1), head._mask(rows), counts)
    size = blocks[-1].first + blocks[-1].size
    f = Penalised(data, Penalty(1.0, 0.5, 30.0), size, 10, blocks[0].size, head._curvature(), True)
    x, v = rng.normal(size=size * 10) / 5, rng.normal(size=size * 10)
    h = 1e-5
    (up, g_up), (down, g_down) = f.value(x + h * v), f.value(x - h * v)
    assert (up - down) / (2 * h) == pytest.approx(f.value(x)[1] @ v, rel=1e-5)
    assert np.allclose((g_up - g_down) / (2 * h), f.product(x, v), rtol=1e-3, atol=1e-2 * np.abs(f.product(x, v)).max())
    for i in rng.choice(size * 10, 5):
        assert f.product(x, np.eye(size * 10)[i])[i] == pytest.approx(f.diagonal(x)[i], rel=1e-6)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        found = head.fit(rows, counts, Penalty(smooth=30.0))
    value, grad = Penalised(data, Penalty(smooth=30.0), size, 10, blocks[0].size, head._curvature(), True).value(found.x)
    assert found.converged and np.abs(grad).max() <= 1e-7 * value


@pytest.mark.parametrize("kind", ["E", "Q"])
def test_spread_fit_and_scores_equal_the_local_ones(spark, kind):
    rng = np.random.default_rng(4)
    n, alphabet = 3000, (2, 12, 37)
    context = ["".join(x) for x in rng.choice(list("ACGT"), (n, 3))]
    op = ["=" if rng.random() < 0.9 else c[1] + ">" + "CGTA"["ACGT".index(c[1])] for c in context]
    start = rng.integers(1, 30, n)
    table = pd.DataFrame({"q": rng.choice(alphabet, n), "q_m1": [None if s == 1 else int(rng.choice(alphabet)) for s in start], "context": context, "pos_start": start, "pos_end": 31 - start, "mate": rng.integers(1, 3, n), "op": op, "n": rng.integers(1, 9, n)})
    df = spark.createDataFrame(table.astype({"q_m1": "Int64"}).astype(object).where(table.notna(), None).values.tolist(), "q int, q_m1 int, context string, pos_start int, pos_end int, mate int, op string, n long")
    tokens = ["QualityWindow(0)", "Context(1,1)", "Position(4)"] if kind == "E" else ["QualityMarkov(1)", "Position(4)", "Mate"]
    local, far = (Head(kind, tokens, alphabet, (1, 1), 30) for _ in range(2))
    spread.fit(df, local)
    found = spread.fit(df, far, most=10)
    assert found.converged and np.allclose(local.theta, far.theta, atol=1e-3)
    rows = spread.scored(df, local).select(*local.fields(), "logp").toPandas()
    assert np.allclose(np.stack(rows["logp"].to_numpy()), local.log_probabilities(rows))
    gathered = Head(kind, tokens, alphabet, (1, 1), 30)
    gathered.fit(*gathered.gather(df))
    assert np.allclose(gathered.theta, local.theta, atol=1e-3)


def test_spec_round_trip(tmp_path):
    spec = ModelSpec((2, 12), "reference", [Component("QualityMarkov(1)", {"weights": np.ones((4, 2))})], [Component("QualityWindow(0)", {"weights": np.zeros((4, 10))})], {"rate": np.array([0.5])}, {"reads": 3})
    spec.save(str(tmp_path / "m"))
    back = ModelSpec.load(str(tmp_path / "m"))
    assert back.alphabet == (2, 12) and back.provenance == {"reads": 3} and (back.quality[0].arrays["weights"] == 1).all()
    assert str(Token.of("Context(1, 2)", "E")) == "Context(1,2)"
    for bad in ("Context", "Nothing(1)", "Strand"):
        with pytest.raises(SpecError):
            Token.of(bad + "!", "E") if bad == "Context" else Token.of(bad, "Q")
    with pytest.raises(SpecError):
        ModelSpec((3, 2), "reference")


def test_raking_meets_margins():
    rng = np.random.default_rng(1)
    n = rng.integers(500, 1000, (4, 6)).astype(float)
    truth = n * np.outer([0.02, 0.01, 0.03, 0.01], np.linspace(1, 2, 6))
    e = rake.ipf(n, {0: truth.sum(axis=1), 1: truth.sum(axis=0)})
    assert np.allclose(e.sum(axis=1), truth.sum(axis=1)) and np.allclose(e.sum(axis=0), truth.sum(axis=0)) and (e <= n).all()


def test_levels_tails_and_posteriors():
    t = np.arange(1, 12)
    beta, rate = 0.9, 0.02
    h = 1 - np.exp(-rate * beta * t ** (beta - 1.0))
    fit = rake.weibull(t, h)
    assert abs(fit["beta"] - beta) < 1e-6 and abs(fit["lambda"] - rate) < 1e-9
    assert all(low <= mid <= high for mid, low, high in rake.pinned_band(t, h).values())
    exact = sum(math.comb(10, j) * 0.1**j * 0.9 ** (10 - j) for j in range(3, 11))
    assert abs(rake.binomial_tail(np.array([3]), np.array([10]), 0.1)[0] - exact) < 1e-12
    p = rake.site_posterior(np.array([100.0, 100.0]), np.ones((2, 3)), np.array([[1, 1, 1], [30, 1, 1.0]]))
    assert p[0] < 0.01 and p[1] > 0.99
    assert rake.strand_shift(5, 10) == (0.0, 0.0)


def test_selection_stops_where_nothing_is_gained():
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"q": rng.choice([2, 37], 3000), "context": rng.choice(list("ACGT"), 3000), "mate": rng.integers(1, 3, 3000), "strand": rng.choice(["+", "-"], 3000)})
    counts = np.zeros((3000, 10))
    counts[np.arange(3000), np.where(rng.random(3000) < np.where(rows["mate"] == 2, 0.3, 0.02), 9, 0)] = 1
    make = lambda tokens: (Head("E", tokens, (2, 37), (0, 0), 5), rows, counts)
    steps = rake.select(make, ["QualityWindow(0)"], {"mate": ["Mate"], "strand": ["Strand"]}, penalty=Penalty(0.1))
    assert steps[-1][0] == ["QualityWindow(0)", "Mate"]


def test_many_alignments_at_once_are_those_of_one_by_one(monkeypatch):
    rng = random.Random(8)
    templates, reads = [], []
    for k in range(600):
        a = "".join(rng.choice("AC" if k % 3 else "ACGT") for _ in range(rng.choice((0, 1, 5, 12, 30, 30, 100))))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.choice((0, 0, 1, 2, 20))] = "".join(rng.choice("ACGT") for _ in range(rng.choice((0, 1, 2, 15))))
        templates.append(a)
        reads.append("".join(b))
    for scores in (realign.Scores(), realign.Scores(1, -1, -1, -1), realign.Scores(2, -9, -1, -1)):
        alone = [realign.align(a, b, scores) for a, b in zip(templates, reads)]
        assert realign.align_many(templates, reads, scores) == alone
        assert realign.align_many(templates, reads, scores, band=1) == alone
    monkeypatch.setattr(realign, "CELLS", 3000)
    assert realign.align_many(templates, reads, band=2) == [realign.align(a, b) for a, b in zip(templates, reads)]


def test_windows_are_those_of_both_strands_whatever_the_signs_and_lengths(spark):
    rng = random.Random(5)
    signs = "ACGT" * 9 + "acgtNxé"
    rows = [("".join(rng.choice(signs) for _ in range(rng.randint(0, 90))), rng.randint(1, 4)) for _ in range(120)] + [(None, 1), ("", 1), ("ẗ" * 30, 2)]
    df = spark.createDataFrame(rows, "seq string, w int")
    for k, v, c in ((5, 4, 3), (11, 13, 1), (13, 9, 2), (17, 16, 2), (1, 1, 2), (2, 3, 5)):
        for weight in (None, F.col("w")):
            want = Counter()
            for s, w in rows:
                up = (s or "").upper()
                for own in (up, up[::-1].translate(str.maketrans("ACGT", "TGCA"))):
                    for i in range(len(own) - k - v + 1):
                        x = own[i : i + k + v]
                        if set(x) <= set("ACGT") and (c == 1 or hashlib.md5(x[:k].encode()).hexdigest() < f"{(1 << 128) // c:032x}"):
                            want[x[:k], x[k:]] += 1 if weight is None else w
            got = {(r["key"], r["value"]): r["n"] for r in km.pairs(df, k, v, weight=weight, c=c).collect()}
            assert got == dict(want) and (want or k > 11)


def test_values_beside_each_other_are_labelled_as_by_the_column_functions(spark):
    rng = random.Random(6)
    rows = [("A" * 6, "A" * 6), ("ACG", "ACGT"), ("ACGTAC", "ACGTAC"), (None, "A"), ("A", None), ("é" * 6, "é" * 5 + "A"), ("", "")]
    for _ in range(1500):
        b = "".join(rng.choice("ACGT"[: rng.choice((2, 4))]) for _ in range(6))
        i, x = rng.randrange(6), rng.choice("ACGT")
        rows.append((rng.choice((b[:i] + x + b[i + 1 :], (b[:i] + b[i + 1 :] + x)[:6], (b[:i] + x + b[i:])[:6], b[:i] + x * (6 - i))), b))
    df = spark.createDataFrame(rows, "value string, consensus string")
    a, b = F.col("value"), F.col("consensus")
    for part in (df, df.filter("length(value) = 6 and length(consensus) = 6")):
        own = km.compared(part, "consensus", 6)
        wrong = own.filter(~(F.col("through").eqNullSafe(km.agreement(a, b, 6)) & F.col("op").eqNullSafe(F.when(fn.one_edit(a, b, F.lit(6)), fn.edit_label(a, b, 6)))))
        assert wrong.collect() == [] and own.filter("op is not null").count() > 500


def test_a_sketch_goes_to_tasks_as_windows_not_as_interpreted_arrays(spark):
    """The windows of every place and their hashes were made by functions that Spark interprets, several microseconds a base."""
    df = spark.createDataFrame([("ACGT" * 20,)], "seq string")
    plan = km.pairs(df, 11, 13, c=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "mapinarrow" in plan.lower()


def test_rows_of_the_same_covariates_are_scored_once(spark):
    """Every row was scored by itself, all reads' alike."""
    seen = []

    class Noting(Head):
        def log_probabilities(self, rows):
            seen.append(len(rows))
            return super().log_probabilities(rows)

    given = [(i, (None, 2, 12)[i % 3], 2) for i in range(5000)]
    rows = pd.DataFrame(given, columns=["i", "q_m1", "q"])
    for classes, tokens in ((None, ["QualityMarkov(1)"]), (2, ["QualityMarkov(1)", "Latent(2)"])):
        head = Noting("Q", tokens, (2, 12, 23, 37), (0, 0), 100)
        head.theta = np.random.default_rng(1).normal(size=(8 if classes else 6, 4))
        want = np.concatenate([Head.log_probabilities(head, rows.assign(latent=s)) for s in range(classes or 1)], axis=1)
        seen.clear()
        assert np.allclose(spread._scores(head, rows[["q_m1"]], classes), want) and seen == [3] * (classes or 1)
        plain = Head("Q", tokens, (2, 12, 23, 37), (0, 0), 100)
        plain.theta = head.theta
        df = spark.createDataFrame(given, "i int, q_m1 int, q int")
        got = {r["i"]: r["logp"] for r in spread.scored(df, plain, classes=classes).collect()}
        assert np.allclose([got[i] for i in range(5000)], want)


def test_observations_counted_within_the_tasks_equal_the_walk(spark):
    rng = random.Random(22)
    text = lambda n, signs="ACGT": "".join(rng.choice(signs) for _ in range(n))
    rows = []
    for i in range(80):
        cigar = rng.choice(["2I3M", "3M2D4M", "1D2I1D5M2I", "4M1I1D1I1D2M", "2M1D1I1D1M3D", "9M", "3D", "2I", "4M2I2D"])
        parts = walk.parts(cigar)
        template, sequence = text(sum(n for n, op in parts if op != "I"), "ACGTNa"), text(sum(n for n, op in parts if op != "D"), "ACGTN")
        clips = [text(rng.randint(0, 2), "!5I") if i % 3 == 0 else None for _ in range(2)]
        rows.append((i, "cd"[i % 2], rng.randint(0, 99), i % 2 == 0, template, sequence, text(len(sequence), "!+5I"), cigar, 1 + i % 2, *clips, rng.choice([None, "", "+"]), rng.choice([None, [], [0, 3, 50]])))
    names = "read_id long, contig string, start long, reverse boolean, template string, sequence string, quality string, cigar string, mate int, clip_before string, clip_after string, strand string, masked array<int>"
    df = spark.createDataFrame(rows, names)
    for flank, per_event in (((2, 1), True), ((0, 0), False)):
        fields = ["read_id", "contig", "site", "t", "q", "q_m1", "q_p1", "context", "pos_start", "pos_end", "mate", "strand", "gc", "op"]
        each = []
        for r in rows:
            read = walk.Read(*r[4:8], r[9] or "", r[10] or "", r[11], r[8], frozenset(r[12] or ()))
            for t, q, near, *rest in walk.observations(read, flank, 1, per_event):
                each.append(dict(zip(fields, (r[0], r[1], r[2] + (len(r[4]) - 1 - t if r[3] else t), t, q, *near, *rest))))
        for own in (fields, ["q", "context", "op"], ["op"]):
            wanted = Counter(tuple(x[f] for f in own) for x in each)
            assert {tuple(x)[:-1]: x.n for x in alignments.observation_counts(df, own, flank, per_event).collect()} == wanted and sum(wanted.values()) > 200
    with pytest.raises(Exception, match="fit"):
        alignments.observation_counts(spark.createDataFrame([rows[0][:7] + ("99M",) + rows[0][8:]], names), ["op"]).collect()


def test_draws_of_gapped_reads_are_added_up_before_they_leave_a_task(spark):
    rows = [(i, "c", 0, False, "ACGTACGT", "ACGACGTT", "I" * 8, "3M1D4M1I", 1) for i in range(300)]
    df = spark.createDataFrame(rows, "read_id long, contig string, start long, reverse boolean, template string, sequence string, quality string, cigar string, mate int").coalesce(1)
    table = alignments.observation_table(df).df
    assert {(r.t_op, r.n) for r in table.select(F.concat("pos_start", "op").alias("t_op"), "n").collect()} == {("4T>-", 300), *((f"{t}=", 300) for t in (1, 2, 3, 5, 6, 7, 8))}
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(n" in plan and "count(1)" not in plan


def test_kmers_dealt_in_blocks_are_added_up(monkeypatch):
    import pyarrow as pa

    from readlens.kernels import windows

    rng = random.Random(23)
    reads = ["".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["ACGTTGCAAGTCAACGTTGCAAGTCAACGTTGCAAGTCA"] * 50
    monkeypatch.setattr(windows, "GATHERED", 500)
    monkeypatch.setattr(windows, "EMITTED", 100)
    flip = str.maketrans("ACGT", "TGCA")
    for k in (1, 5, 6, 7, 21, 31):
        own = [r for r in reads if len(r) >= k]
        batches = [pa.RecordBatch.from_arrays([pa.array(own[i : i + 20])], names=["up"]) for i in range(0, len(own), 20)]
        blocks = pa.Table.from_batches(list(windows.canonical(k)(batches))).sort_by("bucket")
        found = pa.Table.from_batches(list(windows.totals(k)(blocks.to_batches(max_chunksize=7))))
        each = (r[i : i + k] for r in own for i in range(len(r) - k + 1))
        wanted = Counter(min(w, w.translate(flip)[::-1]) for w in each if "N" not in w)
        assert len(found) == len(wanted) and dict(zip(found["kmer"].to_pylist(), found["n"].to_pylist())) == wanted
    assert not list(windows.totals(5)([]))


def test_canonical_kmers_are_not_shuffled_as_text(spark):
    counts = km.kmers(spark.createDataFrame([("acgtACGTACGTACGTACGTAC",), ("ACGTN",), (None,), ("",)], "seq string"), 21)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and {tuple(r) for r in counts.collect()} == {("ACGTACGTACGTACGTACGTA", 1), ("CGTACGTACGTACGTACGTAC", 1)}
    assert km.kmers(spark.createDataFrame([("A" * 40,), ("T" * 33,)], "seq string"), 33).collect()[0].n == 9
