"""Tables for read simulators, on alignments small enough to follow by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from readlens.report import exporters as ex


def _strings(spark, *rows):
    return spark.createDataFrame([(i, ops, q) for i, (ops, q) in enumerate(rows)], "read_id long, ops string, q array<int>")


def test_column_strings_of_gapped_alignments(spark):
    df = spark.createDataFrame([(1, "c", 0, False, "ACGTA", "ACTTTA", "IIII5I", "2M1D1M2I1M", 1)], "read_id long, contig string, start long, reverse boolean, template string, sequence string, quality string, cigar string, mate int")
    (row,) = ex.column_strings(df).collect()
    assert (row.read_id, row.ops, row.q) == (1, "==D=II=", [40, 40, 40, 40, 20, 40])


def test_qscore_windows_hold_the_deletions_between_their_bases(spark):
    rows = ex.qscore_model(_strings(spark, ("==" + "D" * 9 + "X", [10, 20, 30]), ("", [])), least=1).collect()
    assert {(r.cigar, r.q): r.n for r in rows} == {("=", 10): 1, ("=", 20): 1, ("X", 30): 1, ("==" + "D" * 6 + "X", 20): 1, ("overall", 10): 1, ("overall", 20): 1, ("overall", 30): 1}


def test_qscore_limits_spare_single_columns(spark):
    rows = ex.qscore_model(_strings(spark, ("===", [1, 1, 1]), ("=X=", [1, 2, 1])), least=2, most=1).collect()
    assert {r.cigar for r in rows} == {"=", "X", "overall"}


def test_identity(spark):
    rows = ex.identities(_strings(spark, ("==XD", [1, 1, 1]), ("", []))).collect()
    assert {r.read_id: r.identity for r in rows} == {0: 0.5, 1: 0.0}


def test_quality_states_are_runs_of_qualities_the_larger_first(spark):
    reads = spark.createDataFrame([([1, 2, 3, 5, 9],), ([9],), ([],)], "q array<int>")
    model = {(r.kind, r.state, r.target): r.p for r in ex.quality_hmm(reads, most=2).collect()}
    assert model == {
        ("IP", 0, None): 0.5, ("IP", 1, None): 0.5,
        ("TP", 0, 0): 2 / 3, ("TP", 0, 1): 1 / 3, ("TP", 1, 1): 1.0,
        ("EP", 0, 1): 1 / 3, ("EP", 0, 2): 1 / 3, ("EP", 0, 3): 1 / 3, ("EP", 1, 5): 1 / 3, ("EP", 1, 9): 2 / 3,
    }


def test_a_state_that_nothing_follows_has_the_shares_of_all_places(spark):
    model = {(r.kind, r.state, r.target): r.p for r in ex.error_hmm(_strings(spark, ("==X", [1, 1, 1]))).collect()}
    assert model[("TP", 0, 0)] == model[("TP", 0, 1)] == 0.5
    for state in (1, 2, 3):
        assert (model[("TP", state, 0)], model[("TP", state, 1)]) == (2 / 3, 1 / 3)
    assert all(model[("EP", s, s)] == 1.0 for s in range(4))


def test_model_text_has_whole_rows(spark):
    text = ex.hmm_text(ex.error_hmm(_strings(spark, ("=X", [1, 1]))), levels=(1, 2)).splitlines()
    assert len(text) == 2 * (4 + 4 + 4) and text[0] == "1 IP 1 1.000000e+00" and text[4].split() == ["1", "EP", "1", "1.000000e+00"] + ["0.000000e+00"] * 3


def test_empty_tables(spark):
    none = _strings(spark).filter(F.lit(False))
    assert ex.qscore_model(none).count() == ex.identities(none).count() == ex.quality_hmm(none).count() == 0
    assert {r.kind for r in ex.error_hmm(none).collect()} == {"EP"}


def test_mate_tables(spark):
    rows = [(1, "M", 1, "A", "A", 6), (1, "M", 1, "A", "C", 3), (1, "M", 1, "A", "G", 1), (1, "M", 1, "N", "A", 5), (1, "I", 1, "-", "T", 2), (1, "D", 1, "C", "-", 1), (1, "M", 1, "C", "C", 3)]
    got = {(r.kind, r.base, r.alt): r.p for r in ex.mate_tables(spark.createDataFrame(rows, "mate int, op string, pos int, ref string, alt string, n long")).collect()}
    assert got == {("sub", "A", "C"): 0.75, ("sub", "A", "G"): 0.25, ("ins", "T", None): 2 / 14, ("del", "C", None): 0.25}


def test_mean_quality_bins_are_counted_without_a_row_of_each_base(spark):
    reads = spark.createDataFrame([([2, 50, 38],), ([9, None, 10],), ([None, None],), ([],), (None,), ([30, 30],)], "q array<int>")
    found = ex.mean_quality_cdf(reads)
    got = {(r.bin, r.pos, r.q): round(r.cdf, 6) for r in found.collect()}
    assert got == {(3, 1, 2): 0.5, (3, 1, 30): 1.0, (3, 2, 30): 0.5, (3, 2, 40): 1.0, (3, 3, 38): 1.0, (0, 1, 9): 1.0, (0, 3, 10): 1.0}
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert ex.mean_quality_cdf(reads.filter("false")).count() == 0
