"""What a (k, v)-mer sketch gives: its tables, the cost of its outlier filter, levels without a fit, scans by covariate.

kvmer rows: key, consensus_value, passes_filter, consensus_count, neighbor_count, total_count, op_counts (map from label)
and survival (values that agree with the consensus through 1, 2 .. bases).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import windows
from ..session import Stages
from ..sources import sketch_csv
from ..sources.sketch_csv import SketchFormatError
from ..table import CountTable
from . import kmers as km

#: Value lengths under the first see too few errors, under the second too few of them; key lengths likewise repeat in genomes.
LEAST_VALUE, GOOD_VALUE = 4, 13
LEAST_KEY, GOOD_KEY = 15, 17


@dataclass(frozen=True)
class Analysis:
    """All files of one run; k and v as its keys and values have them."""

    k: int
    v: int
    parts: dict[str, DataFrame]
    spectrum_by_t: DataFrame
    kvmer: DataFrame


def read_analyze(spark: SparkSession, prefix: str) -> Analysis:
    """Every file that a run has written as `<prefix>.<part>.csv`; all nine have to be there, and keys."""
    missing = sketch_csv.missing(spark, prefix)
    if newer := [m for m in missing if m in sketch_csv.SINCE_0_3]:
        raise SketchFormatError(f"{prefix}: no {newer[0]} file; the run is of a version older than 0.3")
    if missing:
        raise SketchFormatError(f"{prefix}: missing {', '.join(missing)}")
    kvmer = sketch_csv.read_kvmer(spark, prefix)
    k, v = kvmer.select(F.length("key"), F.length("consensus_value")).first()
    return Analysis(k, v, {part: sketch_csv.read(spark, prefix, part) for part in sketch_csv.HEADERS}, sketch_csv.read_spectrum_by_t(spark, prefix), kvmer)


def check_value_length(v: int) -> None:
    """Refuse values too short to show errors; warn of those that show too few."""
    if v < LEAST_VALUE:
        raise ValueError(f"values of {v} bases are too short to see errors in; use {GOOD_VALUE} or more")
    if v < GOOD_VALUE:
        warnings.warn(f"values of {v} bases give an error rate that is too low; use {GOOD_VALUE} or more", stacklevel=2)


def check_key_length(k: int, least: int = LEAST_KEY) -> None:
    """Refuse keys so short that they repeat within a genome; warn of those that may."""
    if k < least:
        raise ValueError(f"keys of {k} bases repeat within a genome; use {GOOD_KEY} or more, or lower `least` for one where they don't")
    if k < GOOD_KEY:
        warnings.warn(f"keys of {k} bases may stand for several places, which count as errors; use {GOOD_KEY} or more", stacklevel=2)


def kvmer_rows(counts: DataFrame, best: DataFrame, v: int) -> DataFrame:
    """The kvmer rows of a sketch made here. A key passes the filter if its one-edit values are no more than its consensus.

    A key's rows are added up before they are gathered into its row, which holds at most one entry of each label and place.
    """
    facts = km.compared(counts.join(best.select("key", "consensus"), "key").select("key", "value", "n", "consensus"), "consensus", v)
    agreeing = F.struct("through", F.lit(None).cast("string").alias("op"))
    label = F.struct(F.lit(None).cast("int").alias("through"), "op")
    each = facts.select("key", "n", F.explode(F.when(F.col("op").isNull(), F.array(agreeing)).otherwise(F.array(agreeing, label))).alias("e"))
    added = each.select("key", "n", "e.*").groupBy("key", "through", "op").agg(F.sum("n").alias("n"))
    by_key = added.groupBy("key").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("op").isNotNull(), F.struct("op", "n"))))).alias("op_counts"), F.sum(F.when(F.col("op").isNotNull(), F.col("n"))).alias("neighbor_count"),
        F.map_from_entries(F.collect_list(F.when(F.col("through").isNotNull(), F.struct("through", "n")))).alias("through"),
    )
    rows = best.join(by_key, "key", "left")
    survival = F.transform(F.sequence(F.lit(1), F.lit(v)), lambda t: km.through(F.col("through"), t, F.lit(v)))
    near_n = F.coalesce("neighbor_count", F.lit(0).cast("long"))
    return rows.select(
        "key", F.col("consensus").alias("consensus_value"), (near_n <= F.col("consensus_count")).alias("passes_filter"), "consensus_count", near_n.alias("neighbor_count"),
        F.col("total").alias("total_count"), F.coalesce("op_counts", F.create_map().cast("map<string,bigint>")).alias("op_counts"), survival.alias("survival"),
    )


def _passing(rows: DataFrame, use_all: bool) -> DataFrame:
    return rows if use_all else rows.filter("passes_filter")


def _locus() -> Column:
    return F.concat("key", "consensus_value").alias("locus")


def _entries(*pairs: tuple[Column, Column]) -> Column:
    return F.explode(F.array(*(F.struct(op.alias("op"), n.cast("long").alias("n")) for op, n in pairs))).alias("e")


def _table(df: DataFrame, fields: tuple[str, ...], unit: str, **meta) -> CountTable:
    return CountTable(df.select(*fields, "n").filter("n > 0"), fields, unit, True, meta)


def kvmer_table(rows: DataFrame, use_all: bool = False) -> CountTable:
    """(locus, op, n): values equal to the consensus, and those one edit away by label."""
    own = _passing(rows, use_all)
    equal = own.select(_locus(), F.lit("=").alias("op"), F.col("consensus_count").alias("n"))
    return _table(equal.unionByName(own.select(_locus(), F.explode("op_counts").alias("op", "n"))), ("locus", "op"), "value")


def survival_table(rows: DataFrame, use_all: bool = False) -> CountTable:
    """(locus, t, op, n): values that agree through t bases; at t = 0 all of the key's."""
    counts = F.concat(F.array("total_count"), "survival")
    each = _passing(rows, use_all).select(_locus(), F.posexplode(counts).alias("t", "n"), F.lit("=").alias("op"))
    return _table(each, ("locus", "t", "op"), "value")


def tables(a: Analysis, use_all: bool = False) -> dict[str, CountTable]:
    """The counts of a run as tables, t counted from the value's first base. Fitted files are no counts and stay out."""
    equal, wrong = F.lit("="), F.lit("!")
    meta = {"k": a.k, "v": a.v}

    def scanned(part: str, field: str, value: Column, only: Column | None = None) -> CountTable:
        rows = a.parts[part] if only is None else a.parts[part].filter(only)
        return _table(rows.select(value.cast("int").alias(field), _entries((equal, F.col("num_correct")), (wrong, F.col("num_error")))).select(field, "e.*"), (field, "op"), "base", **meta)

    def around(df: DataFrame) -> DataFrame:
        return df.withColumn("op", F.col("operation")).withColumn("context", F.concat("prev_base", F.substring("operation", 1, 1), "next_base"))

    hazard = a.parts["hazard_rate"].select((F.col("t") - a.k).cast("int").alias("t"), _entries((equal, F.col("num_survival")), (wrong, F.col("num_candidates") - F.col("num_survival")))).select("t", "e.*")
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("forward").alias("n")), F.struct(F.lit("-").alias("strand"), (F.col("total") - F.col("forward")).alias("n")))).alias("s")
    by_t = around(a.spectrum_by_t).select("context", "op", F.explode("freq").alias("t", "n")).withColumn("t", F.col("t") - a.k)
    return {
        "phred": scanned("summary_phred", "q", F.col("qscore")),
        "gc_content": scanned("summary_gc_content", "gc", F.col("gc_content_min")),
        "read_position_start": scanned("summary_read_position", "pos_start", F.col("index"), F.col("from_start")),
        "read_position_end": scanned("summary_read_position", "pos_end", F.col("index"), ~F.col("from_start")),
        "hazard": _table(hazard, ("t", "op"), "value", **meta),
        "spectrum": _table(around(a.parts["summary_error_spectrum"]).select("context", "op", both).select("context", "op", "s.*"), ("context", "strand", "op"), "error", flank=(1, 1), **meta),
        "spectrum_by_t": _table(by_t, ("context", "t", "op"), "error", flank=(1, 1), **meta),
        "kvmer": kvmer_table(a.kvmer, use_all),
        "kvmer_survival": survival_table(a.kvmer, use_all),
    }


def filter_stats(rows: DataFrame) -> DataFrame:
    """One row: keys, different consensus values, one-edit values and all values, and how many of each the filter drops."""
    mass = F.aggregate(F.map_values("op_counts"), F.lit(0).cast("long"), lambda a, x: a + x)
    own = rows.select("passes_filter", "consensus_value", mass.alias("mass"), F.col("total_count").alias("n"))
    gone = ~F.col("passes_filter")
    none = F.lit(0)
    out = own.agg(
        F.count(F.lit(1)).alias("keys"), F.sum(gone.cast("long")).alias("keys_dropped"),
        F.countDistinct("consensus_value").alias("consensus_values"), F.countDistinct(F.when(F.col("passes_filter"), F.col("consensus_value"))).alias("kept_values"),
        F.sum("mass").alias("error_mass"), F.sum(F.when(gone, F.col("mass")).otherwise(none)).alias("error_mass_dropped"),
        F.sum("n").alias("observations"), F.sum(F.when(gone, F.col("n")).otherwise(none)).alias("observations_dropped"),
    )
    out = out.withColumn("consensus_values_dropped", F.col("consensus_values") - F.col("kept_values")).drop("kept_values")
    return out.withColumn("error_mass_dropped_fraction", F.coalesce(F.try_divide("error_mass_dropped", "error_mass"), F.lit(0.0)))


def kvmer_level(rows: DataFrame, use_all: bool = False) -> DataFrame:
    """One row: keys, one-edit values, bases at risk, and their ratio: the mean hazard over the value without a model of it.

    At risk before base t are the values that still agree, of those that are equal to the consensus or one edit away.
    """
    at_risk = F.col("consensus_count") + F.col("neighbor_count")
    before = F.aggregate(F.slice("survival", 1, F.size("survival") - 1), at_risk, lambda total, n: total + F.least(n, at_risk))
    out = _passing(rows, use_all).agg(F.count(F.lit(1)).alias("keys"), F.sum("neighbor_count").alias("single_edit_values"), F.sum(before).alias("exposure"))
    return out.withColumn("per_base_rate", F.try_divide("single_edit_values", "exposure"))


def position_level(positions: DataFrame) -> DataFrame:
    """One row: cycles and error rate of the bases counted from the reads' starts. positions: from_start, num_correct, num_error."""
    out = positions.filter("from_start").agg(F.count(F.lit(1)).alias("cycles"), F.sum("num_error").alias("errors"), F.sum(F.col("num_error") + F.col("num_correct")).alias("total"))
    return out.select("cycles", F.try_divide("errors", "total").alias("per_base_rate"))


def hazard_window(rates: DataFrame, hazard: str = "hazard_ratio") -> DataFrame:
    """(t, hazard) where the hazard can be refitted: it is there, above 0 and below 1."""
    return rates.filter((F.col(hazard) > 0) & (F.col(hazard) < 1)).select("t", F.col(hazard).alias("hazard"))


def scan(reads: DataFrame, best: DataFrame, k: int, v: int, c: int) -> DataFrame:
    """(read_id, t, pos_start, pos_end, q, right): bases of the reads' values up to and with the first that differs from the consensus.

    reads: read_id, seq, q. Only keys of the sketch (one in c) are looked up; bases of a read meet its key's consensus once.
    """
    size = F.length("seq")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(size - (k + v) + 1, F.lit(1))), lambda i: km.picked(F.substring("seq", i, F.lit(k)), c) & (i + (k + v) - 1 <= size))
    # Only a key's value and its qualities meet the consensus, so that no read is shuffled once for each of its keys.
    cut = F.transform(starts, lambda i: F.struct(i.alias("i"), F.substring("seq", i, F.lit(k)).alias("key"), F.substring("seq", i + k, F.lit(v)).alias("value"), F.slice("q", i + k, F.lit(v)).alias("q")))
    rows = reads.select("read_id", size.alias("size"), F.explode(cut).alias("w")).select("read_id", "size", "w.*").join(best.select("key", "consensus"), "key")
    through = km.agreement(F.col("value"), F.col("consensus"), v)
    each = rows.select("read_id", "size", "i", "q", through.alias("through")).select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("through") + 1, F.lit(v)))).alias("t"))
    pos = F.col("i") + k + F.col("t") - 1
    return each.select("read_id", "t", pos.alias("pos_start"), (F.col("size") - pos + 1).alias("pos_end"), F.get("q", F.col("t") - 1).alias("q"), (F.col("t") <= F.col("through")).alias("right"))


def covariate_rates(scanned: DataFrame, v: int) -> DataFrame:
    """(axis, value, num_correct, num_error): by quality at t from 3 to v - 2, and by place from both ends at all t."""
    axes = [("q", F.when(F.col("t").between(3, v - 2), F.col("q"))), ("pos_start", F.col("pos_start")), ("pos_end", F.col("pos_end"))]
    each = scanned.select("right", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), x.cast("int").alias("value")) for a, x in axes))).alias("x")).select("right", "x.*").filter("value is not null")
    return each.groupBy("axis", "value").agg(F.sum(F.col("right").cast("long")).alias("num_correct"), F.sum((~F.col("right")).cast("long")).alias("num_error"))


#: Keys whose consensus goes to every task, at most: 16 bytes each.
SENT = 1 << 20


def scan_rates(reads: DataFrame, best: DataFrame, k: int, v: int, c: int, most: int = SENT) -> DataFrame:
    """covariate_rates of the scan. Up to `most` keys go to every task, which adds its own bases up, so that nothing of a read is shuffled.

    best: as kmers.consensus has it of kmers.pairs.
    """
    if k > km.TABLED or k + v > 31 or v > 26:
        return covariate_rates(scan(reads, best, k, v, c), v)
    best = Stages(reads.sparkSession, "scan").write(best.select("key", "consensus"), "best")
    if best.limit(most + 1).count() > most:
        return covariate_rates(scan(reads, best, k, v, c), v)
    table = best.filter(km.picked(F.col("key"), c)).toArrow().combine_chunks()
    key, consensus = (windows.codes(pa.array(table[name].to_pylist(), pa.string()), n) for name, n in (("key", k), ("consensus", v)))
    order = np.argsort(key)
    sent = reads.sparkSession.sparkContext.broadcast((key[order], consensus[order]))
    own = reads.filter(F.length("seq") >= k + v).select("seq", F.col("q").cast("array<int>").alias("q"))
    rows = own.mapInArrow(windows.scan(k, v, sent), "axis string, value int, num_correct long, num_error long")
    return rows.groupBy("axis", "value").agg(F.sum("num_correct").alias("num_correct"), F.sum("num_error").alias("num_error"))
