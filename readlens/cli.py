"""python -m readlens COMMAND ...: profiles, subsets, k-mers, pileups, fits and registered queries from a shell."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import kmer_source, overlap_em, shapes
from .models.heads import Head, Penalty
from .models.spec import ModelSpec
from .operators import alignments, bases, compare, kmers, overlap
from .operators import sketch as sketch_run
from .plans import queries
from .session import Stages, ship
from .sources import fastq, sam
from .table import counted


def _reads(spark: SparkSession, paths: list[str], every_n: int = 1, mate: int = 1) -> DataFrame:
    rows = fastq.read_fastq(spark, paths, every_n)
    return rows.select(F.xxhash64("file", "idx").alias("read_id"), F.lit(mate).alias("mate"), "seq", "q", "idx")


def _alphabet(df: DataFrame, *columns: str) -> tuple[int, ...]:
    found = df.select(F.explode(F.array(*columns)).alias("q")).filter("q is not null").distinct().collect()
    return tuple(sorted(r.q for r in found))


def _quality_head(reads: DataFrame, alphabet: tuple[int, ...]) -> tuple[Head, list]:
    table = bases.quality_table(reads, 1, (1, 1)).df
    top = table.agg(F.max("pos_start")).first()[0] or 2
    head = Head("Q", ["QualityMarkov(1)", "Position(12)", "Mate", "Context(1,1)"], alphabet, (1, 1), top)
    rows, counts = head.gather(table)
    head.fit(rows, counts)
    return head, head.components(rows)


def _error_head(table: DataFrame, alphabet: tuple[int, ...], tokens: list[str]) -> list:
    top = table.agg(F.max("pos_start")).first()[0] or 2
    head = Head("E", tokens, alphabet, (2, 2), top)
    rows, counts = head.gather(table)
    head.fit(rows, counts, Penalty())
    return head.components(rows)


def fit_reference(spark: SparkSession, a: argparse.Namespace) -> None:
    """Both heads from alignments to a reference, sites with a second allele left out."""
    records, reference = sam.read_records(spark, a.alignments), fastq.read_fasta(spark, [a.reference])
    usable = sam.alignments(records, reference, a.min_mapq, a.unclip).persist()
    at = alignments.sites(alignments.pileup(usable)).persist()
    kept = alignments.contig_report(at, a.mask_frequency).filter("kept")
    rows = alignments.unmasked(alignments.observations(usable, m=1), alignments.site_masks(at, a.mask_frequency), kept)
    fields = ["q", "q_m1", "q_p1", "context", "pos_start", "pos_end", "mate", "strand", "gc", "op"]
    table = counted(rows, fields).persist()
    alphabet = _alphabet(table, "q", "q_m1", "q_p1")
    reads = usable.select("read_id", "mate", F.col("sequence").alias("seq"), F.transform(F.split("quality", ""), lambda c: F.ascii(c) - 33).alias("q"))
    _, quality = _quality_head(reads, alphabet)
    error = _error_head(table, alphabet, ["QualityWindow(1)", "Context(1,1)", "Homopolymer", "Mate"])
    ModelSpec(alphabet, "reference", quality, error, provenance={"alignments": a.alignments, "reference": a.reference}).save(a.out)


def fit_overlap(spark: SparkSession, a: argparse.Namespace) -> None:
    """Both heads from the overlaps of mates."""
    placed = Stages(spark, "fit-overlap").write(overlap.placements(overlap.pair_up(_reads(spark, [a.r1]), _reads(spark, [a.r2], mate=2))).drop("r2_rc"), "placed")
    found = overlap_em.fit(placed, ["QualityWindow(1)", "Context(1,1)", "Position(4)", "Mate"], ["QualityMarkov(1)", "Position(12)", "Mate", "Context(1,1)"])
    found.spec(r1=a.r1, r2=a.r2, stats=overlap.agreement(placed).first().asDict()).save(a.out)


def fit_kmer(spark: SparkSession, a: argparse.Namespace) -> None:
    """Both heads from a k-mer sketch's files and the reads that it was of."""
    run = sketch_run.read_analyze(spark, a.prefix)
    source = kmer_source.of_run(run, _reads(spark, a.fastq), (1, 1), a.least_key)
    kmer_source.fit(source, ["QualityWindow(0)", "Context(1,1)", "Position(4)", "Strand", "GC(3)"], ["QualityMarkov(1)", "Position(12)", "Context(1,1)"], a.use_all, level_from=a.level_from, run=a.prefix).save(a.out)


def multiplicity(spark: SparkSession, a: argparse.Namespace) -> None:
    """How often keys stand for several places of a genome, weighted by the contigs' coverage."""
    contigs = fastq.coverage(fastq.read_fasta(spark, [a.reference]))
    print(json.dumps(kmers.multiplicity(kmers.pairs(contigs, a.k, a.v, weight=F.col("coverage")), a.v).first().asDict()))


def baseline(spark: SparkSession, a: argparse.Namespace) -> None:
    """Whether our reads are nearer to real ones than theirs, by the distances of their profiles. Alignments are of one reference."""
    reference = fastq.read_fasta(spark, [a.reference])
    stages = Stages(spark, "baseline")

    def rows(paths: list[str], name: str) -> DataFrame:
        usable = sam.alignments(sam.read_records(spark, paths), reference, a.min_mapq)
        return stages.write(counted(alignments.observations(usable, flank=(1, 1)), ["q", "q_m1", "pos_start", "context", "op"]), name)

    found = compare.verdicts(*(rows([p], name) for p, name in ((a.real, "real"), (a.ours, "ours"), (a.theirs, "theirs"))))
    compare.report(found, a.out, real=a.real, ours=a.ours, theirs=a.theirs)


def profile(spark: SparkSession, a: argparse.Namespace) -> None:
    for name, table in bases.profile(_reads(spark, a.fastq, a.every_n)).items():
        table.df.orderBy(*table.fields).coalesce(1).write.mode("overwrite").csv(f"{a.out}/{name}", sep="\t", header=True)


def pairs(spark: SparkSession, a: argparse.Namespace) -> None:
    both = overlap.pair_up(_reads(spark, [a.r1]), _reads(spark, [a.r2], mate=2))
    print(json.dumps(overlap.agreement(overlap.placements(both)).first().asDict()))


def sketch(spark: SparkSession, a: argparse.Namespace) -> None:
    counts = kmers.sketch(kmers.pairs(_reads(spark, a.fastq), a.k, a.v), a.c)
    best = kmers.consensus(counts)
    print(json.dumps(kmers.levels(counts, best, a.v).first().asDict() | kmers.weibull(kmers.hazard(kmers.survival(counts, best, a.v))).first().asDict()))


def subset(spark: SparkSession | None, a: argparse.Namespace) -> None:
    print(fastq.write_subset(a.source, a.target, a.every_n, a.offset, a.limit))


def contigs(spark: SparkSession, a: argparse.Namespace) -> None:
    usable = sam.alignments(sam.read_records(spark, a.alignments), fastq.read_fasta(spark, [a.reference]), a.min_mapq)
    alignments.contig_report(alignments.sites(alignments.pileup(usable)), a.mask_frequency).orderBy("contig").coalesce(1).write.mode("overwrite").csv(a.out, sep="\t", header=True)


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    queries.QUERIES[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="readlens")
    commands = out.add_subparsers(dest="command", required=True)

    def add(run, *arguments: tuple, spark: bool = True) -> None:
        own = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        for names, options in arguments:
            own.add_argument(*names.split(), **options)
        own.set_defaults(run=run, spark=spark)

    whole = {"type": int}
    files = ("--alignments", {"nargs": "+", "required": True}), ("--reference", {"required": True}), ("--out", {"required": True}), ("--min-mapq", whole | {"default": 20}), ("--mask-frequency", {"type": float, "default": 0.1})
    add(profile, ("fastq", {"nargs": "+"}), ("--every-n", whole | {"default": 1}), ("--out", {"required": True}))
    add(pairs, ("r1", {}), ("r2", {}))
    add(sketch, ("fastq", {"nargs": "+"}), ("--k", whole | {"default": 21}), ("--v", whole | {"default": 13}), ("--c", whole | {"default": 1}))
    add(subset, ("source", {}), ("target", {}), ("--every-n", whole | {"default": 1}), ("--offset", whole | {"default": 0}), ("--limit", whole), spark=False)
    add(contigs, *files)
    add(fit_reference, *files, ("--unclip", {"action": "store_true"}))
    add(fit_overlap, ("r1", {}), ("r2", {}), ("--out", {"required": True}))
    add(fit_kmer, ("prefix", {}), ("fastq", {"nargs": "+"}), ("--out", {"required": True}), ("--use-all", {"action": "store_true"}), ("--level-from", {"choices": shapes.LEVELS, "default": "skiver"}), ("--least-key", whole | {"default": sketch_run.LEAST_KEY}))
    add(multiplicity, ("reference", {}), ("--k", whole | {"default": 21}), ("--v", whole | {"default": 13}))
    add(baseline, ("real", {}), ("ours", {}), ("theirs", {}), ("--reference", {"required": True}), ("--out", {"required": True}), ("--min-mapq", whole | {"default": 20}))
    add(query, ("name", {"choices": sorted(queries.QUERIES)}), ("tables", {}), ("--out", {"required": True}))
    return out


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(ship(SparkSession.builder.appName("readlens").getOrCreate()) if a.spark else None, a)
