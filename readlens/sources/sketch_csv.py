"""Result files of an external (k, v)-mer sketcher: fixed headers, checked; typed; wide columns made long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OPS

# The headers of the files, by the part of the name behind the prefix.
HEADERS = {
    "summary_error_rate": "per_base_error_rate per_base_error_rate_5-95th_percentile mean_hazard_rate mean_hazard_rate_5-95th_percentile lambda lambda_5-95th_percentile "
    "beta beta_5-95th_percentile key_median_coverage key_coverage_5-95th_percentile true_median_coverage true_coverage_5-95th_percentile "
    "substitution_error_proportion insertion_error_proportion deletion_error_proportion",
    "hazard_rate": "t num_candidates num_survival hazard_ratio 5th_percentile 95th_percentile",
    "survival_rate": "t survival_rate",
    "summary_error_spectrum": "operation prev_base next_base total forward",
    "summary_phred": "qscore empirical_qscore per_base_error_rate percentile num_correct num_error",
    "summary_gc_content": "gc_content_min gc_content_max_exclusive per_base_error_rate percentile num_correct num_error",
    "summary_read_position": "index from_start num_correct num_error error_rate",
}
_WHOLE = {"t", "num_candidates", "num_survival", "total", "forward", "qscore", "num_correct", "num_error", "gc_content_min", "gc_content_max_exclusive", "index", "consensus_count", "neighbor_count", "total_count", "homopolymer_length"}
_REAL = {"mean_hazard_rate", "lambda", "beta", "key_median_coverage", "true_median_coverage", "substitution_error_proportion", "insertion_error_proportion", "deletion_error_proportion", "hazard_ratio", "5th_percentile", "95th_percentile", "survival_rate", "empirical_qscore", "per_base_error_rate", "error_rate"}


#: Parts that only versions from 0.3 on write.
SINCE_0_3 = ("survival_rate", "summary_gc_content")
PARTS = (*HEADERS, "summary_error_spectrum_dependence_on_t", "kvmer")


class SketchFormatError(ValueError):
    """A file whose header or cells aren't as they should be."""


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    if first is None:
        raise SketchFormatError(f"{path}: empty")
    return first[0].split(",")


def _typed(name: str):
    cell = F.col(f"`{name}`")
    own = F.when(cell != "NA", cell)
    if name in _WHOLE or name.startswith(("freq_at_t", "consensus_count_up_to_v")):
        return own.cast("long").alias(name)
    if name in _REAL:
        return own.cast("double").alias(name)
    if name in ("from_start", "passes_filter"):
        return F.when(cell == "true", True).when(cell == "false", False).otherwise(F.raise_error(F.lit(f"{name} is true or false"))).alias(name)
    if name == "percentile" or name.endswith("_5-95th_percentile"):
        parts = F.split(cell, "~")
        return F.struct(F.get(parts, F.lit(0)).cast("double").alias("lo"), F.get(parts, F.lit(1)).cast("double").alias("hi")).alias(name)
    return cell.alias(name)


def _read(spark: SparkSession, path: str, wanted: list[str] | None) -> DataFrame:
    header = _header(spark, path)
    if wanted and header[: len(wanted)] != wanted:
        raise SketchFormatError(f"{path}: header {header[:6]} isn't {wanted[:6]}")
    schema = ", ".join(f"`{h}` string" for h in header)
    raw = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=True)
    return raw.select(*map(_typed, header))


def missing(spark: SparkSession, prefix: str) -> list[str]:
    """Parts of PARTS that have no file, on whatever file system the prefix is."""
    context = spark.sparkContext
    out = []
    for part in PARTS:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{prefix}.{part}.csv")
        if not path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path):
            out.append(part)
    return out


def read(spark: SparkSession, prefix: str, part: str) -> DataFrame:
    """One of HEADERS' files, as `<prefix>.<part>.csv`."""
    return _read(spark, f"{prefix}.{part}.csv", HEADERS[part].split())


def read_spectrum_by_t(spark: SparkSession, prefix: str) -> DataFrame:
    """operation, prev_base, next_base, total, and freq by t as a map."""
    df = _read(spark, f"{prefix}.summary_error_spectrum_dependence_on_t.csv", ["operation", "prev_base", "next_base", "total"])
    wide = [c for c in df.columns if c.startswith("freq_at_t")]
    pairs = [x for c in wide for x in (F.lit(int(c.removeprefix("freq_at_t"))), F.col(c))]
    return df.select("operation", "prev_base", "next_base", "total", F.create_map(*pairs).alias("freq"))


def _label(name: str) -> str | None:
    """AC is A>C, _A is ->A, A_ is A>-."""
    if len(name) != 2:
        return None
    a, b = name[0].replace("_", "-"), name[1].replace("_", "-")
    label = f"{a}>{b}"
    return label if label in OPS else None


def read_kvmer(spark: SparkSession, prefix: str) -> DataFrame:
    """key, consensus_value, passes_filter, counts, op_counts (map by label) and survival (counts through v = 1, 2 ..)."""
    df = _read(spark, f"{prefix}.kvmer.csv", ["key", "consensus_value"])
    if df.isEmpty():
        raise SketchFormatError(f"{prefix}: no keys")
    ops = {c: _label(c) for c in df.columns if _label(c)}
    tail = [c for c in df.columns if c.startswith("consensus_count_up_to_v")]
    if tail != [f"consensus_count_up_to_v{k}" for k in range(1, len(tail) + 1)]:
        raise SketchFormatError(f"{prefix}: the survival columns aren't v1, v2 ..")
    counts = F.create_map(*(x for c, label in ops.items() for x in (F.lit(label), F.col(c).cast("long"))))
    fixed = [c for c in ("key", "consensus_value", "passes_filter", "homopolymer_length", "consensus_count", "neighbor_count", "total_count") if c in df.columns]
    return df.select(*fixed, counts.alias("op_counts"), F.array(*tail).alias("survival"))
