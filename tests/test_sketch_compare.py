"""Sketch files as one source, comparisons, and cases that were once wrong."""

import warnings
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlens import functions as fn
from readlens.kernels import place, walk
from readlens.models import kmer_source
from readlens.operators import alignments as al
from readlens.operators import compare as cp
from readlens.operators import kmers as km
from readlens.operators import sketch as sk
from readlens.sim import variation
from readlens.sources import sam
from readlens.sources.sketch_csv import HEADERS, SketchFormatError
from readlens.table import CountTable

OPS = [a + b for a in "ACGT" for b in "ACGT" if a != b] + ["_" + b for b in "ACGT"] + [a + "_" for a in "ACGT"]


@pytest.fixture
def run(tmp_path):
    """The nine files of a run with keys of 4 bases and values of 3."""
    rows = {
        "summary_error_rate": ["0.01,0.009~0.011,0.01,0.009~0.011,0.02,0.01~0.03,1.0,0.9~1.1,45,32~56,51.5,36.5~63.5,0.9,0.05,0.05"],
        "hazard_rate": ["5,100,99,0.01,0.005,0.02", "6,99,99,NA,0.0,0.01"],
        "survival_rate": ["5,0.99"],
        "summary_error_spectrum": ["A>C,G,T,7,3", "->G,A,C,2,2", "T>-,C,A,1,0"],
        "summary_phred": ["37,33.0,0.0005,0.0004~0.0006,90,1", "12,13.0,0.05,0.04~0.06,8,1"],
        "summary_gc_content": ["40,45,0.01,0.009~0.02,50,2"],
        "summary_read_position": ["1,true,30,1,0.03", "2,true,29,0,0.0", "1,false,28,2,0.07"],
    }
    for part, lines in rows.items():
        (tmp_path / f"x.{part}.csv").write_text("\n".join([HEADERS[part].replace(" ", ","), *lines]) + "\n")
    (tmp_path / "x.summary_error_spectrum_dependence_on_t.csv").write_text("operation,prev_base,next_base,total,freq_at_t5,freq_at_t6\nA>C,G,T,7,4,3\n")
    head = "key,consensus_value,passes_filter,homopolymer_length,consensus_count,neighbor_count,total_count"
    tail = [f"consensus_count_up_to_v{i}" for i in (1, 2, 3)]
    lines = [",".join([head, *OPS, *tail])]
    for key, ok, ac in (("ACGT", "true", 2), ("CCGT", "false", 5)):
        lines.append(",".join([key, "GGA", ok, "2", "10", str(ac), "14", *(str(ac if o == "AC" else 0) for o in OPS), "13", "12", "10"]))
    (tmp_path / "x.kvmer.csv").write_text("\n".join(lines) + "\n")
    return tmp_path


def rows_of(table):
    return sorted(tuple(r) for r in table.df.collect())


def test_a_run_gives_its_tables(spark, run):
    a = sk.read_analyze(spark, str(run / "x"))
    assert (a.k, a.v) == (4, 3)
    t = sk.tables(a)
    assert rows_of(t["phred"]) == [(12, "!", 1), (12, "=", 8), (37, "!", 1), (37, "=", 90)]
    assert rows_of(t["hazard"]) == [(1, "!", 1), (1, "=", 99), (2, "=", 99)]
    assert rows_of(t["spectrum"]) == [("A-C", "+", "->G", 2), ("CTA", "-", "T>-", 1), ("GAT", "+", "A>C", 3), ("GAT", "-", "A>C", 4)]
    assert rows_of(t["spectrum_by_t"]) == [("GAT", 1, "A>C", 4), ("GAT", 2, "A>C", 3)]
    assert rows_of(t["read_position_end"]) == [(1, "!", 2), (1, "=", 28)]
    assert rows_of(t["kvmer"]) == [("ACGTGGA", "=", 10), ("ACGTGGA", "A>C", 2)]
    assert rows_of(t["kvmer_survival"]) == [("ACGTGGA", 0, "=", 14), ("ACGTGGA", 1, "=", 13), ("ACGTGGA", 2, "=", 12), ("ACGTGGA", 3, "=", 10)]
    assert len(rows_of(sk.tables(a, use_all=True)["kvmer"])) == 4
    stats = sk.filter_stats(a.kvmer).first()
    assert (stats.keys_dropped, stats.error_mass_dropped, stats.observations_dropped, stats.consensus_values_dropped) == (1, 5, 14, 0)
    level = sk.kvmer_level(a.kvmer).first()
    assert (level.single_edit_values, level.exposure) == (2, 12 + 12 + 12)
    position = sk.position_level(a.parts["summary_read_position"]).first()
    assert position.cycles == 2 and abs(position.per_base_rate - 1 / 60) < 1e-12
    assert [tuple(r) for r in sk.hazard_window(a.parts["hazard_rate"]).collect()] == [(5, 0.01)]


def test_a_run_and_its_reads_are_fitted(spark, run):
    reads = spark.createDataFrame([(i, 1, "ACGTGGACCT" * 2, [12, 37] * 10) for i in range(20)], "read_id long, mate int, seq string, q array<int>")
    a = sk.read_analyze(spark, str(run / "x"))
    with pytest.raises(ValueError):
        kmer_source.of_run(a, reads, (1, 1))
    with pytest.warns(UserWarning):
        source = kmer_source.of_run(replace(a, v=4), reads, (1, 1), least_key=3)
    source.v = 3
    source.hazard = spark.createDataFrame([(t, 0.01) for t in range(5, 9)], "t int, hazard double")
    spec = kmer_source.fit(source, ["QualityWindow(0)", "Context(1,1)", "Position(4)", "Strand", "GC(3)"], ["QualityMarkov(1)", "Context(1,1)"])
    assert spec.alphabet == (12, 37) and len(spec.error) == 5 and spec.provenance["k"] == 4 and spec.provenance["level_scale"] == 1.0


def test_incomplete_runs_raise(spark, run):
    (run / "x.survival_rate.csv").unlink()
    with pytest.raises(SketchFormatError, match="older than 0.3"):
        sk.read_analyze(spark, str(run / "x"))
    with pytest.raises(SketchFormatError):
        sk.read_analyze(spark, str(run / "nothing"))


def test_guards_refuse_and_warn():
    for bad in (lambda: sk.check_value_length(3), lambda: sk.check_key_length(11)):
        with pytest.raises(ValueError):
            bad()
    for poor in (lambda: sk.check_value_length(6), lambda: sk.check_key_length(15), lambda: sk.check_key_length(11, least=9)):
        with pytest.warns(UserWarning):
            poor()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        sk.check_value_length(13)
        sk.check_key_length(21)


def test_labels_of_single_edits(spark):
    rows = [("GGTCA", "GGACA", "A>T"), ("GGCAT", "GGACA", "A>-"), ("GGTAC", "GGACA", "->T"), ("ACGTT", "AACGT", "A>-"), (None, "AACGT", None)]
    got = spark.createDataFrame(rows, "a string, b string, op string").select("op", fn.edit_label(F.col("a"), F.col("b"), 5).alias("got")).collect()
    assert all(r.op == r.got for r in got)


def test_small_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(fn.gc_ten(F.lit(45), F.lit(50))) == 40
    with pytest.raises(Exception, match="crosses"):
        value(fn.gc_ten(F.lit(45), F.lit(55)))
    assert value(fn.error_context(F.lit("CGATC"), F.lit("->T"), 2)) == "G-A" and value(fn.error_context(F.lit("CGATC"), F.lit("A>T"), 2)) == "GAT"
    assert [value(fn.truth_label(F.lit(o), F.lit(t), F.lit(c))) for o, t, c in (("A>C", "A", "A"), ("=", "A", "."), ("=", "A", "C"), ("=", "a", "A"), ("A>-", "A", "A"))] == ["error", "adapter", "variant", "match", None]
    assert abs(value(fn.logit(F.lit(0.8))) - np.log(4)) < 1e-12
    shares = spark.createDataFrame([(0.5, 0.25), (0.5, 0.75), (0.0, 0.0)], "a double, b double")
    assert abs(shares.agg(fn.divergence(F.col("a"), F.col("b")).alias("d")).first().d - (0.5 * np.log(2) + 0.5 * np.log(2 / 3))) < 1e-12
    names = spark.createDataFrame([("b",), ("10",), ("9",), ("a",)], "x string")
    assert [r.x for r in names.orderBy(*fn.numbers_first(F.col("x"))).collect()] == ["9", "10", "a", "b"]


def test_key_columns_are_put_in_and_replaced(spark):
    table = CountTable(spark.createDataFrame([(2, 1, 3), (2, 2, 4)], "q int, mate int, n long"), ("q", "mate"))
    assert rows_of(table.with_key("mate", 1)) == [(2, 1, 7)]
    assert table.with_key("latent", 0).fields == ("q", "mate", "latent")


def test_verdicts(spark):
    rows = spark.createDataFrame([(0.1, 0.105), (0.1, 0.2), (0.3, 0.2), (0.0, 0.009)], "a double, b double")
    assert [r.v for r in rows.select(cp.verdict(F.col("a"), F.col("b")).alias("v")).collect()] == ["matches", "beats", "trails", "matches"]


def test_reports_are_json(spark, tmp_path):
    import json

    cp.report(spark.createDataFrame([("rate", 0.5)], "name string, distance double"), str(tmp_path / "r.json"), source="x")
    assert json.loads((tmp_path / "r.json").read_text()) == {"source": "x", "rows": [{"name": "rate", "distance": 0.5}]}


def test_indel_profile(spark):
    events = spark.createDataFrame([("D", 2, 4, 3), ("D", 9, 5, 1), ("I", 1, 1, 2)], "indel string, indel_length int, run int, n long")
    bases = spark.createDataFrame([(1, 100), (2, 50), (3, 10), (7, 30)], "run int, n long")
    assert sorted(tuple(r) for r in cp.indel_profile(events, bases).collect()) == [("D", 3, 2, 3, 0.075), ("D", 3, 4, 1, 0.025), ("I", 1, 1, 2, 0.02)]


def test_indel_parts_that_touch_are_one_event():
    read = walk.Read("ACGTACGT", "ACGTTTACG", "IIIIIIIII", "3M1I1I1D4M")
    assert [e[:2] for e in walk.indel_events(read)] == [("I", 2), ("D", 1)]
    split = walk.Read("ACGTACGT", "ACTTTCGT", "IIIIIIII", "2M1I1D1I1D4M")
    assert [e[:2] for e in walk.indel_events(split)] == [("I", 1), ("D", 1), ("I", 1), ("D", 1)]
    joined = walk.Read("ACGTACGT", "ACTCGT", "IIIIII", "2M1D1D1I1D3M")
    assert [e[:2] for e in walk.indel_events(joined)] == [("D", 2), ("I", 1), ("D", 1)]
    assert not list(walk.indel_events(walk.Read("ANGT", "AGT", "III", "1M1D2M")))


def test_a_split_may_shift_either_side():
    rng = np.random.default_rng(3)
    seq = "".join(rng.choice(list("ACGT"), 60))
    late, early = seq[:30] + "A" + seq[30:59], seq[:8] + "A" + seq[8:59]
    got = place.place_all([seq, seq], [late, early])
    assert [p.status for p in got] == ["indel", "indel"]


def test_a_refused_clip_leaves_the_aligners(spark):
    reference = "ACGTTGCAACGGTTACCAGT" * 6
    row = {"cigar": "12S40M", "pos": 30, "seq": "T" * 12 + reference[30:70], "qual": "I" * 52, "flag": 0, "contig": "c"}
    made = sam._aligned(row, reference, unclip=True)
    assert made is not None and made["cigar"] == "40M" and len(made["clip_before"]) == 12


def test_tips_of_a_tree_are_equally_deep():
    root = "ACGT" * 5000
    tips = variation.haplotypes(root, 6, 0.9, shape="tree", seed=4, rules=variation.Rules(indel_fraction=0))
    apart = [1 - variation.identity(root, t) for t in tips]
    assert max(apart) < 0.056 and min(apart) > 0.040
    assert all(variation.identity(a, b) > 0.89 for a in tips for b in tips)


def test_pileup_by_arrays_equals_the_walk(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        n = int(rng.integers(5, 30))
        seq = "".join(rng.choice(list("ACGTN"), n))
        rows.append((k, f"c{k % 3}", int(rng.integers(0, 40)), bool(k % 2), "A" * n, seq, "I" * n, f"{n}M", 1))
    rows.append((99, "c0", 3, True, "ACGTAC", "ACTTAC", "IIIIII", "2M1D1I3M", 1))
    df = spark.createDataFrame(rows, "read_id long, contig string, start long, reverse boolean, template string, sequence string, quality string, cigar string, mate int")
    plain = sorted(map(tuple, al.pileup(df).collect()))
    wanted = {}
    for _, contig, start, reverse, template, seq, _, cigar, _ in rows[:-1]:
        own = walk.revcomp(seq) if reverse else seq
        for i, b in enumerate(own):
            if b in "ACGT":
                wanted[contig, start + i, b] = wanted.get((contig, start + i, b), 0) + 1
    gapped = {(r[0], r[1], r[2]): r[3] for r in al.pileup(df.filter("read_id = 99")).collect()}
    assert {"del", "ins"} <= {a for _, _, a in gapped}
    for key, n in gapped.items():
        wanted[key] = wanted.get(key, 0) + n
    assert plain == sorted((*k, n) for k, n in wanted.items())


def test_scanned_bases_are_added_up_within_the_tasks(spark):
    rng = np.random.default_rng(12)
    genome = "".join(rng.choice(list("ACGT"), 90))
    rows = []
    for i in range(400):
        at, size = int(rng.integers(0, 50)), int(rng.integers(5, 41))
        seq = "".join(rng.choice(list("ACGTNé")) if rng.random() < 0.03 else b for b in genome[at : at + size])
        q = rng.choice([2, 12, 37], len(seq)).tolist()
        rows.append((i, seq, None if i % 50 == 0 else [None if rng.random() < 0.02 else x for x in q][: len(seq) - i % 3]))
    rows += [(900, None, None), (901, "", [])]
    reads = spark.createDataFrame(rows, "read_id long, seq string, q array<int>")
    for k, v, c in ((4, 7, 1), (5, 5, 2), (3, 13, 1)):
        best = km.consensus(km.pairs(reads, k, v, c=c), 2)
        lines = lambda df: sorted(map(tuple, df.collect()))
        wanted = lines(sk.covariate_rates(sk.scan(reads, best, k, v, c), v))
        found = sk.scan_rates(reads, best, k, v, c)
        assert lines(found) == wanted and sum(x[3] for x in wanted) > 20
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert lines(sk.scan_rates(reads, best, k, v, c, most=1)) == wanted
    assert sk.scan_rates(reads, best.filter("false"), 3, 13, 1).count() == 0


def test_a_position_level_shuffles_no_read(spark):
    from readlens.plans import queries

    plan = queries.QUERIES["sketch_position_level"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
