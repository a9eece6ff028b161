"""Sources, tables and operators on literal inputs; the registered queries against DuckDB."""

import gzip
import io
import json
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from readlens import functions as fn
from readlens.operators import alignments as al
from readlens.operators import bases as ba
from readlens.operators import compare as cp
from readlens.operators import evidence as ev
from readlens.operators import kmers as km
from readlens.operators import overlap as ov
from readlens.plans import queries as plans
from readlens.report import exporters
from readlens.sim import generate, variation
from readlens.sources import fastq, sam, sketch_csv, splits
from readlens.streaming import counts as streaming
from readlens.table import CountTable, TableError

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cells(df):
    out = []
    for row in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None):
        out.append(tuple(str(round(float(v), 5) + 0.0) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = plans.QUERIES[name](spark, SF).toArrow().to_pandas()
    theirs = con.sql(plans.ORACLE_SQL[name]).to_arrow_table().to_pandas()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert cells(ours) == cells(theirs)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 16
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture
def tiny(tmp_path):
    path = tmp_path / "tiny.fq"
    path.write_text("@a x\nACGT\n+\n!+5?\n\n@b\nGG\n+b\n55\n")
    return str(path)


def test_fastq_profile(spark, tiny):
    reads = fastq.read_fastq(spark, [tiny]).select(F.col("idx").alias("read_id"), F.lit(1).alias("mate"), "seq", "q")
    found = ba.profile(reads, flank=(1, 1))
    get = lambda name: {tuple(r[:-1]): r[-1] for r in found[name].df.select(*found[name].fields, "n").collect()}
    assert get("length") == {(4,): 1, (2,): 1}
    assert get("transition") == {(0, 10): 1, (10, 20): 1, (20, 30): 1, (20, 20): 1}
    assert set(k[0] for k in get("context")) == {".AC", "ACG", "CGT", "GT.", ".GG", "GG."}


def test_fastq_is_unzipped_by_content_and_strided_within_files(spark, tiny, tmp_path):
    packed = tmp_path / "packed.txt"
    packed.write_bytes(gzip.compress(open(tiny, "rb").read()))
    rows = fastq.read_fastq(spark, [tiny, str(packed)], every_n=2, offset=1).collect()
    assert [(r.name, r.seq, list(r.q)) for r in rows] == [("b", "GG", [20, 20])] * 2
    assert fastq.read_fastq(spark, [tiny, str(packed)], limit=3).count() == 3
    assert fastq.write_subset(tiny, str(tmp_path / "out.fq.gz"), every_n=2) == 1
    assert gzip.open(tmp_path / "out.fq.gz", "rt").read() == "@a x\nACGT\n+\n!+5?\n"
    fastq.write_fastq(fastq.read_fastq(spark, [tiny]).coalesce(1), str(tmp_path / "back"), quality=False)
    assert "@b\nGG\n+\n**" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "back")).collect())


def bgzf(data, size):
    """Gzip members of so many bytes each, with their sizes in an extra field, and the empty one at the end."""
    out = b""
    for at in [*range(0, len(data), size), len(data)]:
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(data[at : at + size]) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[at : at + size]), len(data[at : at + size]))
    return out


@pytest.fixture(scope="module")
def long_fastq():
    """Records whose qualities begin like headers and separators, with blank lines between some, an empty read, and no line end at the end."""
    rng, text = random.Random(5), []
    for i in range(60):
        n = rng.randint(0, 40) if i % 7 else 0
        quality = "".join(rng.choice("@+I5") for _ in range(n))
        text.append(f"@r{i} x\n{''.join(rng.choice('ACGT') for _ in range(n))}\n+{'r' if i % 5 == 0 else ''}\n{quality}\n" + ("\n" if i % 9 == 3 else ""))
    return "".join(text)[:-1].encode()


@pytest.mark.parametrize("packing", ["plain", "blocks", "gzip"])
def test_parts_of_a_file_hold_each_record_once(long_fastq, packing, tmp_path):
    path = str(tmp_path / "x.fq")
    made = {"plain": lambda: long_fastq, "blocks": lambda: bgzf(long_fastq, 90), "gzip": lambda: gzip.compress(long_fastq)}[packing]()
    (tmp_path / "x.fq").write_bytes(made)
    wanted = list(fastq.records(iter(io.BytesIO(long_fastq)), "x"))
    assert len(wanted) == 60
    for size in (1, 2, 3, 7, 31, 100, 1000, 10**6) if packing != "blocks" else (1, 13, 60, 100, 500, 10**6):
        parts = splits.ranges(path, size)
        assert packing == "gzip" or len(parts) == -(-len(made) // size)
        assert [r for part in parts for r in splits.records(path, *part)] == wanted


def test_split_files_are_numbered_and_strided_alike(spark, long_fastq, tmp_path):
    paths = []
    for name, data in (("a.fq", long_fastq), ("b.fq.gz", bgzf(long_fastq, 200)), ("c.fq.gz", gzip.compress(long_fastq))):
        (tmp_path / name).write_bytes(data)
        paths.append(str(tmp_path / name))
    rows = lambda **how: sorted(map(str, fastq.read_fastq(spark, paths, **how).collect()))
    assert rows(split_bytes=300) == rows(split_bytes=77) == rows()
    assert rows(split_bytes=300, every_n=7, offset=2) == rows(every_n=7, offset=2)
    assert rows(split_bytes=300, limit=70) == rows(limit=70)
    assert fastq.read_fastq(spark, paths, split_bytes=300).rdd.getNumPartitions() > 10


@pytest.fixture(scope="module")
def many_records():
    rng, out = random.Random(6), ["@HD\tVN:1.6"]
    for i in range(150):
        n = rng.randint(1, 60)
        text = "".join(rng.choice("ACGT") for _ in range(n))
        cigar = f"{n}M" if n < 10 or i % 3 else f"4M1D{n - 6}M2I"
        out.append("\t".join([f"read{i}", str(rng.choice([0, 16])), "c", str(rng.randint(1, 29)), "60", cigar, "*", "0", "0", text, "".join(rng.choice("!+5I") for _ in range(n))]))
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("packing", ["sam", "zipped sam", "bam", "bam in small blocks"])
def test_parts_of_alignments_hold_each_record_once(spark, many_records, packing, tmp_path):
    plain = gzip.decompress(as_bam(many_records))
    data = {"sam": many_records.encode(), "zipped sam": bgzf(many_records.encode(), 300), "bam": bgzf(plain, 4000), "bam in small blocks": bgzf(plain, 70)}[packing]
    path = str(tmp_path / "x")
    (tmp_path / "x").write_bytes(data)
    wanted = list(sam.sam_rows(many_records.encode().splitlines(True)))
    for size in (150, 400, 1000, 10**6):
        assert [r for part in splits.ranges(path, size) for r in sam.part_rows(path, *part)] == wanted
    whole = sorted(map(str, sam.read_records(spark, [path]).collect()))
    assert sorted(map(str, sam.read_records(spark, [path], split_bytes=700).collect())) == whole and len(whole) == 150


def test_broken_parts_raise(tmp_path):
    good = "".join(f"@r{i}\nACGT\n+\nIIII\n" for i in range(20))
    for bad in (good + "x\n" * 9 + good, good + "@r\nACGT\n+\n", good + "@r\nACGT\n", good[:100] + "@r\nACG\n+\nIIII\n" + good[100:]):
        (tmp_path / "bad.fq").write_text(bad)
        with pytest.raises(fastq.FastqFormatError):
            [r for part in splits.ranges(str(tmp_path / "bad.fq"), 50) for r in splits.records(str(tmp_path / "bad.fq"), *part)]


@pytest.mark.parametrize(("text", "line"), [("@a\nACGT\n+\n!!\n", 1), ("@a\nAC\n+\n!!\n@b\nAC\n+\n", 5), ("@a\nAC\n+\n! \n", 4)])
def test_broken_fastq_names_the_line(text, line):
    with pytest.raises(fastq.FastqFormatError, match=f":{line}:"):
        list(fastq.records(iter(x + b"\n" for x in text.encode().split(b"\n")[:-1]), "f"))


def test_fasta_and_coverage(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">c1 cov=2.5 y\nAC\n;note\nGT\n>c2\nTT\n")
    rows = fastq.coverage(fastq.read_fasta(spark, [str(tmp_path / "x.fa")])).orderBy("name").collect()
    assert [(r.name, r.seq, r.coverage) for r in rows] == [("c1", "ACGT", 2.5), ("c2", "TT", 1.0)]


REFERENCE = "ACGTTGCAAGTCAGGCTTAACCGGATATCG"
SAM = (
    "@HD\tVN:1.6\n"
    "f\t0\tc\t1\t60\t10M\t*\t0\t0\tACGTTGCAAG\tIIIIIIIIII\n"
    "r\t16\tc\t5\t60\t3=2I5M\t*\t0\t0\tTGCTTAAGTC\tABCDEFGHIJ\n"
    "second\t256\tc\t1\t60\t10M\t*\t0\t0\tACGTTGCAAG\tIIIIIIIIII\n"
    "low\t0\tc\t1\t5\t10M\t*\t0\t0\tACGTTGCAAG\tIIIIIIIIII\n"
    "copy\t1024\tc\t1\t60\t10M\t*\t0\t0\tACGTTGCAAG\tIIIIIIIIII\n"
    "clip\t0\tc\t4\t60\t2S6M2S\t*\t0\t0\tCGTTGCAAGT\tIIIIIIIIII\n"
    "skip\t0\tc\t1\t60\t3M5N3M\t*\t0\t0\tACGAAG\tIIIIII\n"
)


def as_bam(text):
    out = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", len(REFERENCE))
    for line in text.splitlines()[1:]:
        f = line.split("\t")
        ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in sam._PART.findall(f[5])]
        codes = ["=ACMGRSVTWYHKDBN".index(c) for c in f[9]] + [0] * (len(f[9]) % 2)
        body = struct.pack("<iiBBHHHiiii", 0, int(f[3]) - 1, len(f[0]) + 1, int(f[4]), 0, len(ops), int(f[1]), len(f[9]), -1, -1, 0)
        body += f[0].encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + bytes(ord(c) - 33 for c in f[10])
        out += struct.pack("<i", len(body)) + body
    return gzip.compress(out)


def test_sam_and_bam_alignments(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.bam").write_bytes(as_bam(SAM))
    contigs = spark.createDataFrame([("c", REFERENCE)], "name string, seq string")
    for name in ("a.sam", "a.bam"):
        records = sam.read_records(spark, [str(tmp_path / name)])
        assert records.count() == 7
        rows = {r.start: r for r in sam.alignments(records, contigs).collect()}
        assert set(rows) == {0, 4, 3}
        assert rows[0].template == REFERENCE[:10] and rows[0].cigar == "10M"
        assert (rows[4].reverse, rows[4].template, rows[4].sequence, rows[4].quality, rows[4].cigar) == (True, "GACTTGCA", "GACTTAAGCA", "JIHGFEDCBA", "5M2I3M")
        assert (rows[3].cigar, rows[3].clip_before, rows[3].clip_after) == ("6M", "II", "II")
        whole = {r.start: r.cigar for r in sam.alignments(records, contigs, unclip=True).collect()}
        assert whole[1] == "10M" and 3 not in whole
        for unclip in (False, True):
            plain = sam.alignments(records, contigs, unclip=unclip)
            assert sorted(map(str, sam.alignments(records, contigs, unclip=unclip, broadcast_bases=0, piece=3).collect())) == sorted(map(str, plain.collect()))
        assert sam.reads_as_sequenced(records).count() == 6


def test_pairs_are_written_interleaved_and_their_flags_found(spark, tmp_path):
    pairs = spark.createDataFrame([("p", "ACGT", "IIII", "GG", "!!"), ("q", "A", "I", "C", "I")], "name string, r1 string, qual1 string, r2 string, qual2 string").coalesce(1)
    text = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    fastq.write_interleaved(pairs, str(tmp_path / "both"))
    fastq.write_interleaved(pairs, str(tmp_path / "second"), only=2)
    assert text("both") == "@p:m1\nACGT\n+\nIIII\n@p:m2\nGG\n+\n!!\n@q:m1\nA\n+\nI\n@q:m2\nC\n+\nI\n"
    assert [n for n, *_ in fastq.records(iter(text("second").encode().splitlines(True)), "x")] == ["p:m2", "q:m2"]
    with pytest.raises(ValueError):
        fastq.write_interleaved(pairs, str(tmp_path / "third"), only=3)
    df = spark.createDataFrame([("a:m1", 16), ("a:m2", 0), ("b", 4), (None, 0), (":m3", 0)], "name string, flag int")
    assert {(r.name, r.flag) for r in sam.pair_flags(df).collect()} == {("a", 16 | 0x41), ("a", 0x81), ("b", 4), (None, 0), (":m3", 0)}


def test_outliers_are_found_in_turns(spark):
    """A key that loses much hides a second one until it is gone; the tail is the binomial's."""
    rows = []
    for key in range(60):
        n = [100, 99, 98, 97]
        if key == 7:
            n = [30_000, 15_000, 15_000, 15_000]
        if key == 9:
            n = [100, 55, 54, 53]
        rows += [(f"k{key}", t, x) for t, x in enumerate(n)]
    rows += [("gone", 0, 40), ("none", 0, 0)]
    alive = spark.createDataFrame(rows, "key string, t int, n long")
    first = {(r.key, r.t) for r in km.outliers(alive, 1e-12, turns=1).collect()}
    found = {(r.key, r.t): r for r in km.outliers(alive, 1e-12).collect()}
    assert first == {("k7", 1), ("gone", 1)} and found.keys() == {("k7", 1), ("k9", 1), ("gone", 1)}
    lost, at_risk = 58 + 45, 58 * 100 + 100  # what is left once the two of the first turn are gone
    p = lost / at_risk
    exact = sum(math.comb(100, j) * p**j * (1 - p) ** (100 - j) for j in range(45, 101))
    assert found["k9", 1].lost == 45 and found["k9", 1].tail == pytest.approx(exact, rel=1e-6)
    assert km.outliers(alive.filter("false")).count() == 0


def test_rates_by_exposure_and_histograms(spark):
    columns = spark.createDataFrame([("M", "A", "A", 10, 7), ("M", "A", "C", 20, 2), ("I", "-", "G", 10, 1), ("D", "T", "-", 30, 3)], "op string, ref string, alt string, q int, n long")
    out = {r.kind: r for r in ev.column_rates(columns).collect()}
    assert (out["substitution"].exposure, out["substitution"].errors, out["any"].exposure, out["any"].errors) == (9, 2, 10, 6)
    assert out["any"].implied == pytest.approx((0.1 * 8 + 0.01 * 2) / 10) and out["substitution"].rate == pytest.approx(2 / 9)
    assert ev.column_rates(columns.filter("false")).count() == 0 and ev.column_rates(columns.filter("op = 'D'")).filter("kind = 'any'").first().rate is None
    bins = lambda *x: spark.createDataFrame(list(x), "v int, n long")
    assert cp.histogram_distance(bins((1, 3), (2, 1)), bins((1, 1), (60, 1), (70, 2)), "v", "n").first().distance == pytest.approx((0.5 + 0.25 + 0.75) / 2)
    assert cp.histogram_distance(bins((1, 3)), bins((1, 1)).filter("false"), "v", "n").first().distance is None
    counts = spark.createDataFrame([("AA", 3), ("AC", 1)], "kmer string, n long")
    assert cp.absent_share(counts, counts.filter("kmer = 'AA'")).first().share == 0.25 and cp.absent_share(counts, counts.filter("false")).first().share == 1.0


def test_pileup_masks_and_anti_join(spark):
    rows = [(k, "c", 0, False, "ACGTACGT", "ACGAACGT" if k < 3 else "ACGTACGT", "I" * 8, "8M", 1) for k in range(8)] + [(9, "c", 0, True, "ACGTACGT", "ACGTACT", "I" * 7, "6M1D1M", 1)]
    df = spark.createDataFrame(rows, "read_id long, contig string, start long, reverse boolean, template string, sequence string, quality string, cigar string, mate int")
    piled = {(r.site, r.allele): r.n for r in al.pileup(df).collect()}
    assert piled[3, "A"] == 3 and piled[3, "T"] == 6 and piled[1, "del"] == 1
    at = al.sites(al.pileup(df))
    masks = al.site_masks(at, freq=0.2)
    assert [r.site for r in masks.collect()] == [3]
    kept = al.contig_report(at, freq=0.2).filter("kept")
    left = al.unmasked(al.observations(df), masks, kept)
    assert left.filter("site = 3").count() == 0 and left.filter("op = 'T>A'").count() == 0
    links = al.linked(spark.createDataFrame([(r, "c", s, "A") for r in range(3) for s in (4, 12)] + [(7, "c", 4, "A"), (7, "c", 20, "G")], "read_id long, contig string, site long, allele string"))
    assert [(r.site_a, r.site_b, r.n) for r in links.collect()] == [(4, 12, 3)]
    assert {r.reason for r in al.conservative(at, links).collect()} >= {"linked"}


def test_one_edit(spark):
    base = "ACGTTGCAAGTCA"
    others = [("ACGTTGCTAGTCA", True), ("ACGTGCAAGTCAT", True), ("ACGTTTGCAAGTC", True), ("CCGTTGCTAGTCA", False), ("ACTTGCAGTCAAA", False), (base, False)]
    df = spark.createDataFrame([(base, b, x) for b, x in others], "a string, b string, wanted boolean")
    assert df.filter(fn.one_edit(F.col("a"), F.col("b"), F.lit(13)) != F.col("wanted")).count() == 0


def test_kmers_are_canonical_and_skip_unknown_bases(spark):
    df = spark.createDataFrame([("ACGN",), ("CGT",), ("AC",)], "seq string")
    assert {r.kmer: r.n for r in km.kmers(df, 3).collect()} == {"ACG": 2}
    counts = spark.createDataFrame([("K", "AA", 9), ("K", "AC", 9), ("L", "AA", 3)], "key string, value string, n long")
    assert [(r.key, r.consensus, r.total) for r in km.consensus(counts).collect()] == [("K", "AA", 18)]
    loci = spark.createDataFrame([("K", "AA", 1)], "key string, value string, n long")
    assert [(r["class"], r.true_value) for r in km.by_loci(km.consensus(counts), loci).collect()] == [("1", True)]


def test_tables(spark):
    df = spark.createDataFrame([(2, "=", 5), (2, "A>C", 1), (12, "->A", 2)], "q int, op string, n long")
    table = CountTable(df, ("q", "op"), truth=True).validate()
    assert {tuple(r) for r in table.marginal("q").df.collect()} == {(2, 6), (12, 2)}
    assert {tuple(r) for r in table.substitutions().df.collect()} == {(2, "=", 5), (2, "A>C", 1)}
    assert {tuple(r) for r in table.exposure("q").collect()} == {(2, 6, 1), (12, 2, 2)}
    less = CountTable(df.withColumn("n", F.lit(2)), ("q", "op"), truth=True)
    assert {tuple(r) for r in table.minus(less).df.collect()} == {(2, "=", 3)}
    for bad in (lambda: CountTable(df, ("q", "op")), lambda: CountTable(df, ("q", "q"), truth=True), lambda: CountTable(df, ("nothing",)), lambda: CountTable(df, ("q",), "mile"), lambda: CountTable(df.withColumn("n", F.lit(-1)), ("q", "op"), truth=True).validate()):
        with pytest.raises(TableError):
            bad()


def test_mates_must_pair(spark):
    r1 = spark.createDataFrame([(0, "AC", [1, 2]), (1, "GG", [1, 2])], "idx long, seq string, q array<int>")
    assert ov.pair_up(r1, r1).count() == 2
    with pytest.raises(Exception, match="differ in length"):
        ov.pair_up(r1, r1.filter("idx = 0")).collect()


def test_pairs_with_tiles(spark):
    reads = lambda *names: spark.createDataFrame([(i, n, "ACGT", [2] * 4) for i, n in enumerate(names)], "idx long, name string, seq string, q array<int>")
    assert [r.tile for r in ov.with_tiles(reads("m:1:f:2:17:9:9 x", "m:3:4:9:9"), reads("a", "b")).orderBy("pair_id").collect()] == ["2_17", "3_4"]
    with pytest.raises(Exception, match="no tile in the name m:a"):
        ov.with_tiles(reads("m:a"), reads("b")).collect()


def test_art_profile_round_trip(spark):
    rows = spark.createDataFrame([("A", 1, 2), ("C", 1, 12), ("A", 1, 12), ("A", 2, 45)], "base string, pos_start int, q int")
    back = exporters.read_art(exporters.art_text(exporters.art_profile(rows)))
    assert back[0] == {2: 1 / 3, 12: 2 / 3} and back[1] == {41: 1.0}


def test_generated_reads_fit_their_cigars(spark):
    from readlens.kernels import walk
    from readlens.models.heads import Head

    head = Head("E", ["QualityWindow(0)"], (2, 37), (0, 0), 50)
    theta = np.zeros((1 + 3, 10))
    theta[1, 1:] = -2.0
    theta[2, 1:] = -9.0
    head.theta = theta
    chain = generate.QualityChain((2, 37), np.array([0.5, 0.5]), np.array([[0.6, 0.4], [0.1, 0.9]]))
    templates = spark.createDataFrame([(k, "ACGTTGCAAGTNACGGATTAC", 1 + k % 2) for k in range(60)], "read_id long, template string, mate int")
    rows = generate.generate(templates, head, chain, m=0).collect()
    for r in rows:
        walk.Read(r.template, r.sequence, r.quality, r.cigar)
    again = {r.read_id: r.sequence for r in generate.generate(templates.repartition(3), head, chain, m=0).collect()}
    assert all(again[r.read_id] == r.sequence for r in rows) and len({r.cigar for r in rows}) > 1
    pairs = generate.fragments({"c": "ACGT" * 50}, 20, 30, 40, 5, ("TTTT", "GGGG"))
    assert all(len(p["r1"]) == len(p["r2"]) == 30 for p in pairs)


def test_haplotypes_are_as_alike_as_asked():
    root = "".join(np.random.default_rng(0).choice(list("ACGT"), 20_000))
    a, b = variation.haplotypes(root, 2, 0.95, rules=variation.Rules(indel_fraction=0))
    assert abs(variation.identity(a, b) - 0.95) < 0.01
    assert len(variation.sites(a, b)) == sum(x != y for x, y in zip(a, b))
    assert abs(variation.abundances(5).sum() - 1) < 1e-9 and all(0.01 <= f <= 0.5 for *_, f in variation.minor_alleles(root, 30))


def test_sketch_files(spark, tmp_path):
    p = str(tmp_path / "x")
    (tmp_path / "x.hazard_rate.csv").write_text("t,num_candidates,num_survival,hazard_ratio,5th_percentile,95th_percentile\n12,10,9,0.1,0.05,0.2\n13,9,9,NA,NA,NA\n")
    rows = sketch_csv.read(spark, p, "hazard_rate").orderBy("t").collect()
    assert (rows[0].hazard_ratio, rows[1].hazard_ratio, rows[1].num_survival) == (0.1, None, 9)
    (tmp_path / "x.kvmer.csv").write_text("key,consensus_value,passes_filter,homopolymer_length,consensus_count,neighbor_count,total_count,AC,_A,A_,consensus_count_up_to_v1,consensus_count_up_to_v2\nAC,GT,true,1,8,2,10,1,0,1,10,9\n")
    row = sketch_csv.read_kvmer(spark, p).first()
    assert row.op_counts == {"A>C": 1, "->A": 0, "A>-": 1} and row.survival == [10, 9] and row.passes_filter is True
    (tmp_path / "x.survival_rate.csv").write_text("t,rate\n1,1\n")
    with pytest.raises(sketch_csv.SketchFormatError):
        sketch_csv.read(spark, p, "survival_rate")


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").select("event_type", (F.col("user_id") % 3).alias("mate"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.maintain(stream, ["event_type", "mate"], "running", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    wanted = {(r.event_type, r.mate): r["count"] for r in rows.groupBy("event_type", "mate").count().collect()}
    assert {(r.event_type, r.mate): r.n for r in spark.table("running").collect()} == wanted


def test_command_line(spark, tiny, tmp_path, capsys):
    from readlens import cli
    from readlens.models.spec import ModelSpec

    cli.main(["subset", tiny, str(tmp_path / "half.fq"), "--every-n", "2"])
    assert capsys.readouterr().out.strip() == "1"
    cli.main(["profile", tiny, "--out", str(tmp_path / "profile")])
    assert spark.read.csv(str(tmp_path / "profile/length"), sep="\t", header=True).count() == 2
    cli.main(["pairs", tiny, tiny])
    assert '"pairs": 2' in capsys.readouterr().out
    rng = np.random.default_rng(5)
    genome = "".join(rng.choice(list("ACGT"), 400))
    lines = ["@HD\tVN:1.6"]
    for k in range(300):
        start = int(rng.integers(0, 350))
        read = list(genome[start : start + 50])
        if k % 3 == 0:
            read[10] = "A" if read[10] != "A" else "C"
        lines.append("\t".join([f"r{k}", "0", "c", str(start + 1), "60", "50M", "*", "0", "0", "".join(read), "".join(chr(33 + int(q)) for q in rng.choice([2, 37], 50))]))
    (tmp_path / "x.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "x.fa").write_text(f">c\n{genome}\n")
    common = ["--alignments", str(tmp_path / "x.sam"), "--reference", str(tmp_path / "x.fa"), "--mask-frequency", "0.5"]
    cli.main(["contigs", *common, "--out", str(tmp_path / "contigs")])
    assert spark.read.csv(str(tmp_path / "contigs"), sep="\t", header=True).first().contig == "c"
    cli.main(["fit-reference", *common, "--out", str(tmp_path / "model")])
    spec = ModelSpec.load(str(tmp_path / "model"))
    assert spec.alphabet == (2, 37) and [c.token for c in spec.error] == ["QualityWindow(1)", "Context(1,1)", "Homopolymer", "Mate"]
    cli.main(["baseline", *[str(tmp_path / "x.sam")] * 3, "--reference", str(tmp_path / "x.fa"), "--out", str(tmp_path / "verdicts.json")])
    assert {r["verdict"] for r in json.loads((tmp_path / "verdicts.json").read_text())["rows"]} == {"matches"}
    capsys.readouterr()
    cli.main(["multiplicity", str(tmp_path / "x.fa"), "--k", "11", "--v", "5"])
    assert json.loads(capsys.readouterr().out)["multi_value"] < 0.05
    pairs = []
    for k in range(60):
        start = int(rng.integers(0, 340))
        text, q = genome[start : start + 50], "".join(rng.choice(["#", "F"], 40))
        pairs.append((k, text[:40], q, text[10:][::-1].translate(str.maketrans("ACGT", "TGCA")), q))
    for name, a, b in (("r1.fq", 1, 2), ("r2.fq", 3, 4)):
        (tmp_path / name).write_text("".join(f"@p{r[0]}\n{r[a]}\n+\n{r[b]}\n" for r in pairs))
    cli.main(["fit-overlap", str(tmp_path / "r1.fq"), str(tmp_path / "r2.fq"), "--out", str(tmp_path / "pairs")])
    spec = ModelSpec.load(str(tmp_path / "pairs"))
    assert spec.mode == "pe-overlap" and spec.provenance["stats"]["pairs"] == 60 and [c.token for c in spec.quality][0] == "QualityMarkov(1)"


def test_joint_site_model_finds_planted_sites(spark):
    from readlens.models import sites

    rng = np.random.default_rng(1)
    genome = "".join(rng.choice(list("ACGT"), 60))
    rows = []
    for k in range(60):
        read = [("ACGT".replace(b, ""))[int(rng.integers(3))] if rng.random() < 0.01 else b for b in genome]
        if k % 2:
            read[20] = "A" if genome[20] != "A" else "G"
        rows.append((k, "c", 0, False, genome, "".join(read), "F" * 60, "60M", 1))
    df = spark.createDataFrame(rows, "read_id long, contig string, start long, reverse boolean, template string, sequence string, quality string, cigar string, mate int")
    head, found = sites.joint(al.observations(df, flank=(0, 0), m=0), ["QualityWindow(0)"], (37,), (0, 0))
    assert [r.site for r in found.collect()] == [20]
    assert head.theta is not None


def test_one_row_group_is_dealt_out_to_all_cores(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from readlens.plans import bridge

    texts = [f"{i} " + "abcdefghij klmno " * 40 for i in range(3000)]
    pq.write_table(pa.table({"doc_id": list(range(3000)), "source": ["s"] * 3000, "text": texts}), tmp_path / "documents.parquet", use_dictionary=False, compression="none")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")  # many parts, of which one has the rows
    try:
        docs = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "source", "text")
        cores = spark.sparkContext.defaultParallelism
        assert docs.rdd.getNumPartitions() >= cores
        sizes = [n for n in bridge.spread(docs).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(sizes) == 3000 and len(sizes) >= cores and max(sizes) < 3000 // cores * 2


def test_mates_are_counted_in_one_pass(spark):
    from readlens.plans import queries

    plan = queries.QUERIES["on_support"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # the bases were counted before; the rest reads counts


def test_columns_are_added_up_within_a_batch(spark):
    from readlens.operators import alignments as al

    reads = [(k, "c", 0, False, "ACGTAC", s, "5" * len(s), c, m) for k, (s, c, m) in enumerate([("ACGTAC", "6M", 1), ("ACTTAC", "6M", 1), ("ACAC", "2M2D2M", 2), ("ACGGTAC", "3M1I3M", 2)] * 5)]
    df = spark.createDataFrame(reads, "read_id long, contig string, start long, reverse boolean, template string, sequence string, quality string, cigar string, mate int").coalesce(1)
    fields = ["mate", "op", "pos", "ref", "alt"]
    each = {tuple(r[f] for f in fields): r["count"] for r in al.columns(df).groupBy(*fields).count().collect()}
    assert {tuple(r[f] for f in fields): r.n for r in al.column_counts(df, fields).collect()} == each
    assert each[1, "M", 3, "G", "T"] == 5 and each[2, "D", 3, "G", "-"] == 5 and each[2, "I", 4, "-", "G"] == 5


def test_pairs_are_placed_once_for_both_mates_rows(spark):
    from readlens.plans import queries

    plan = queries.QUERIES["overlap_certain_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_documents_are_read_once_for_absent_kmers(spark):
    from readlens.plans import queries

    df = queries.QUERIES["kmer_absent_fraction"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
