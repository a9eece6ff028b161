"""Counts that are made within a task, against the plain ones."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from readlens.kernels import groups, place
from readlens.models.heads import Head
from readlens.operators import alignments as al
from readlens.operators import bases as ba
from readlens.operators import compare as cp
from readlens.operators import overlap as ov
from readlens.plans import queries
from readlens.report import exporters as ex
from readlens.table import counted


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())) != []


def _reads(spark):
    rows = [
        (1, 1, "acgtN", [2, 12, None, 37, 2], "a", 7), (2, 2, "ACG", None, None, 9), (3, None, "", [], "a", 1), (4, 1, None, [2], "b", 2),
        (5, 2, "GGGäGG", [2, 2, 2], "b", None), (6, 2, "T", [-5, 3], "", 1 << 40), (None, 1, "ACGTACGT" * 30, [12] * 240, "a", 7),
    ]
    return spark.createDataFrame(rows, "read_id long, mate int, seq string, q array<int>, source string, start long")


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_base_counts_equal_the_counted_bases(spark, monkeypatch, size):
    reads = _reads(spark)
    fields = ["source", "mate", "gc", "q_m1", "pos_start", "q_p2", "pos_end", "base", "context", "q", "site"]
    plain = ba.bases(reads, 2, 2, (2, 1), ("source", "start")).withColumn("site", F.col("start") + F.col("pos_start") - 1)
    monkeypatch.setattr(groups.chunks, "__defaults__", (size,))
    for own in (fields, ["q"], ["context", "source"], ["site"]):
        _same(ba.base_counts(reads, own, (2, 1)), counted(plain, own))


def test_base_counts_with_a_template(spark):
    reads = spark.createDataFrame([(1, "ACGNA", "ACTAn", [2] * 5, 10), (2, "C", "G", [3], 0)], "read_id long, template string, seq string, q array<int>, start long")
    found = {tuple(r) for r in ba.base_counts(reads, ["site", "context", "op", "q"], (1, 1)).collect()}
    assert found == {(10, ".AC", "=", 2, 1), (11, "ACG", "=", 2, 1), (12, "CGN", "G>T", 2, 1), (0, ".C.", "C>G", 3, 1)}
    with pytest.raises(Exception, match="differ in length"):
        ba.base_counts(reads.withColumn("seq", F.lit("AC")), ["op"]).collect()


def test_rows_are_grouped_in_keys_that_no_long_holds():
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 3, 500) * ((1 << 40) + k) for k in range(5)]
    found, n = groups.grouped(columns)
    plain = {}
    for row in zip(*(c.tolist() for c in columns)):
        plain[row] = plain.get(row, 0) + 1
    assert dict(zip(zip(*(c.tolist() for c in found)), n.tolist())) == plain


def test_a_heads_rows_are_counted_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame([(2, 2, 5), (2, 12, 3)], "q_m1 int, q int, n long").mapInArrow(run, "q_m1 int, q int, n long")
    rows, counts = Head("Q", ["QualityMarkov(1)"], (2, 12), (0, 0), 5).gather(table)
    assert len(rows) == 1 and counts.tolist() == [[5, 3]] and seen.value == 2


def test_linked_reads_equal_the_join_of_their_edits(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        true = "".join(rng.choice(list("ACGTN"), 12))
        called = "".join(b if rng.random() < 0.6 else str(rng.choice(list("ACGTN"))) for b in true)
        rows.append((None if k == 7 else k // 2 * 2, None if k == 9 else "ab"[k % 4 // 3], int(rng.integers(-2, 2)), true, called))
    reads = spark.createDataFrame([*rows, (70, "a", 0, "", "")], "read_id long, contig string, start long, template string, seq string")
    edits = [(r, c, s + i, b) for r, c, s, t, q in rows for i, (a, b) in enumerate(zip(t, q)) if a != b and "N" not in (a, b)]
    plain = al.linked(spark.createDataFrame(edits, "read_id long, contig string, site long, allele string"), 2)
    _same(al.linked_reads(reads, 2), plain)


def test_masked_observations_take_counts(spark):
    rows = spark.createDataFrame([("c", s, "=" if s % 3 else "A>C", q) for s in range(6) for q in (2, 2, 12)], "contig string, site long, op string, q int")
    masks = spark.createDataFrame([("c", 1), ("c", 3)], "contig string, site long")
    _same(cp.quality_at_masks(counted(rows, ["contig", "site", "op", "q"]), masks), cp.quality_at_masks(rows, masks))


@pytest.mark.parametrize("name", ["masked_observations", "quality_at_masks", "conservative_sites", "linked_sites"])
def test_bases_are_counted_before_they_are_rows(spark, name, monkeypatch):
    """No plan of these makes a row of each base."""
    monkeypatch.setattr(queries.ba, "bases", None)
    assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_windows_of_column_strings_equal_the_plain_ones(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, "".join(rng.choice(list("==XIDDD"), int(rng.integers(0, 40)))) + "D" * (9 * (k % 3)) + "=" * (k % 2), [int(x) for x in rng.integers(-1, 3, 30)] if k % 7 else None) for k in range(40)]
    plain = {}
    for _, ops, q in rows:
        at = [i for i, c in enumerate(ops) if c != "D"]
        for k in (1, 3, 5, 7, 9):
            for j in range(len(at) - k + 1):
                cigar, i = re.sub("D{7,}", "D" * 6, ops[at[j] : at[j + k - 1] + 1]), j + k // 2
                for name in (cigar, "overall") if k == 1 else (cigar,):
                    key = name, q[i] if q and i < len(q) else None
                    plain[key] = plain.get(key, 0) + 1
    for size in (1, 1 << 20):
        monkeypatch.setattr(groups.chunks, "__defaults__", (size,))
        found = ex.qscore_model(spark.createDataFrame(rows, "read_id long, ops string, q array<int>"), least=1)
        assert "transform(" not in found._jdf.queryExecution().analyzed().toString()
        assert {(r.cigar, r.q): r.n for r in found.collect()} == plain


def test_calibration_counts_no_rows_of_bases(spark):
    rng = np.random.default_rng(6)
    text = lambda n, alphabet="ACGTN": "".join(rng.choice(list(alphabet), n))
    rows = []
    for k in range(50):
        one, two = int(rng.integers(1, 12)), int(rng.integers(1, 12))
        offset = int(rng.integers(-two + 1, one))
        overlap = min(one, offset + two) - max(0, offset)
        q = lambda n: None if rng.random() < 0.1 else [None if x < 0 else int(x) for x in rng.integers(-1, 4, n)]
        rows.append((k, ["a", None][k % 2], text(one), q(one), text(two), q(two), offset, overlap))
    placed = spark.createDataFrame(rows, "pair_id long, source string, r1 string, q1 array<int>, r2 string, q2 array<int>, offset int, overlap int")
    each = ov._one_way(placed, 0, (0, 0), ("source",)).filter("b1 in ('A', 'C', 'G', 'T') and b2 in ('A', 'C', 'G', 'T') and q_1 is not null and q_2 is not null")
    plain = each.groupBy("source", "q_1", "q_2").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("b1") != F.col("b2")).cast("long")).alias("differ"))
    _same(ov._cells(placed, ("source",)), plain)


@pytest.mark.parametrize("alphabet", ["ACGT", "ACGTN"])
def test_pairs_are_placed_alike_alone_and_together(alphabet, monkeypatch):
    rng = np.random.default_rng(7)
    first, second = [], []
    for _ in range(120):
        m = int(rng.integers(15, 60))
        whole = "".join(rng.choice(list(alphabet), m * 3 // 2))
        b = "".join(str(rng.choice(list(alphabet))) if rng.random() < 0.05 else c for c in whole[-m:])
        i = int(rng.integers(0, m))
        first.append(whole[:m])
        second.append(b[:i] + b[i + int(rng.integers(0, 3)) :])
    alone = [place.place_all([a], [b])[0] for a, b in zip(first, second)]
    assert {p.status for p in alone} == {"placed", "indel", "no_overlap"}
    monkeypatch.setattr(place, "BLOCK", 50)
    assert place.place_all(first, second) == alone
