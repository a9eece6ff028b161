"""k-mers, their multiplicity on contigs, and the (k, v)-mer sketch with its hazard estimates.

Sequences are columns of a DataFrame; k-mers are strings, which sort as their two-bit codes do. A sequence that is null or
shorter than a window has none, repeated sequences count as often as they occur, and empty tables give no rows (reports of
one row: counts of 0, and nulls for sums and shares of nothing).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import revcomp
from ..kernels import windows
from ..session import Stages


def _windows(seq: Column, width: int) -> Column:
    n = F.length(seq) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(seq, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


_BLOCKS = "bucket int, low binary, high binary, n binary"


def kmers(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(kmer, n): counts of canonical k-mers, the lesser of each window and its reverse complement; windows with other signs go.

    Up to 31 bases are a number until they have been added up. Most k-mers are rare, so what is shuffled is blocks of them and not rows."""
    own = df.select(F.upper(seq).alias("up")).filter(F.length("up") >= k)
    if k <= 31:
        found = own.mapInArrow(windows.canonical(k), _BLOCKS)
        return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(windows.totals(k), "kmer string, n long")
    # Both strands are made once a read; window i of a read is window size - k + 2 - i of the other strand.
    own = own.select("up", revcomp(F.col("up")).alias("down"), (F.length("up") - k + 2).alias("ends"), F.translate("up", "ACGT", "") == "").toDF("up", "down", "ends", "plain")
    each = own.select("up", "down", "ends", "plain", F.explode(F.sequence(F.lit(1), F.col("ends") - 1)).alias("i"))
    each = each.select(F.substring("up", F.col("i"), F.lit(k)).alias("w"), F.substring("down", F.col("ends") - F.col("i"), F.lit(k)).alias("other"), "plain")
    each = each.filter(F.col("plain") | F.col("w").rlike("^[ACGT]+$"))
    return each.groupBy(F.least("w", "other").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def absent(counts: DataFrame, known: DataFrame) -> DataFrame:
    """k-mers that are not among the known ones."""
    return counts.join(known.select("kmer"), "kmer", "left_anti")


def spectrum(counts: DataFrame, cap: int = 50) -> DataFrame:
    """(multiplicity, kmers): how many k-mers occur so often; the cap also holds all above it."""
    return counts.groupBy(F.least("n", F.lit(cap)).alias("multiplicity")).agg(F.count(F.lit(1)).alias("kmers"))


def picked(key: Column, c: int) -> Column:
    """Whether a key's hash is in the least 1/c of all (fractional MinHash); md5, so that other engines pick the same."""
    if c < 1:
        raise ValueError("c is at least 1")
    return F.lit(True) if c == 1 else F.md5(key) < F.lit(f"{(1 << 128) // c:032x}")


#: Keys up to this length are hashed once each, before any read is looked at: a bit of each, 2 MB at most, goes to every task.
TABLED = 12
_tables: dict[tuple[str, int, int], Broadcast] = {}


def _picked_keys(spark: SparkSession, k: int, c: int) -> Broadcast:
    """Which of all keys `picked` leaves, as bits in order of the keys; once an application."""
    context = spark.sparkContext
    at = context.applicationId, k, c
    if at not in _tables:
        key = F.translate(F.lpad(F.conv(F.col("id").cast("string"), 10, 4), k, "0"), "0123", "ACGT")
        found = spark.range(4**k).select("id", picked(key, c).alias("some")).mapInArrow(windows.flags, "first long, n long, bits binary").toArrow()
        some = np.zeros(4**k, np.uint8)
        for first, n, bits in zip(*(found[name].to_pylist() for name in found.column_names)):
            some[first : first + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
        _tables[at] = context.broadcast(np.packbits(some).tobytes())
    return _tables[at]


def pairs(df: DataFrame, k: int, v: int, seq: str = "seq", weight: Column | None = None, c: int = 1) -> DataFrame:
    """(key, value, n): windows of k + v bases on both strands; n adds up the weights of their sequences. Of the keys that
    `picked` leaves. Windows without weights are counted within a task before they are shuffled."""
    if not (1 <= k <= 31 and 1 <= v <= 31):
        raise ValueError("k and v are 1 to 31")
    own = df.select(F.upper(seq).alias("up"), *([] if weight is None else [weight.alias("n")])).filter(F.length("up") >= k + v)
    kind = "bigint" if weight is None else own.schema["n"].dataType.simpleString()
    table = _picked_keys(df.sparkSession, k, c) if c > 1 and k <= TABLED else None
    blocks = weight is None and k + v <= 31
    rows = own.mapInArrow(windows.cut(k, v, weight is not None, table), _BLOCKS if blocks else f"key string, value string, n {kind}")
    if blocks:
        rows = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(windows.totals(k, v), "key string, value string, n long")
        return rows if table is not None or c == 1 else rows.filter(picked(F.col("key"), c))
    if table is None and c != 1:
        rows = rows.filter(picked(F.col("key"), c))
    return rows.groupBy("key", "value").agg(F.sum("n").alias("n"))


def sketch(counts: DataFrame, c: int) -> DataFrame:
    """The keys that `picked` leaves of counts that were made of all."""
    return counts.filter(picked(F.col("key"), c))


def consensus(counts: DataFrame, least: int = 10) -> DataFrame:
    """(key, consensus, consensus_count, total): of keys with `least` windows the most frequent value, the first in order of equals."""
    best = F.min_by(F.col("value"), F.struct(-F.col("n"), F.col("value")))
    return counts.groupBy("key").agg(best.alias("consensus"), F.max("n").alias("consensus_count"), F.sum("n").alias("total")).filter(F.col("total") >= least)


def agreement(a: Column, b: Column, v: int) -> Column:
    """How many first bases two values have in common."""
    same = F.filter(F.sequence(F.lit(1), F.lit(v)), lambda t: F.substring(a, F.lit(1), t) == F.substring(b, F.lit(1), t))
    return F.size(same)


def compared(df: DataFrame, other: str, v: int) -> DataFrame:
    """df with `through`, the `agreement` of its value with another column, and `op`, the `edit_label` that makes it of that one; null
    unless they are one edit apart. A batch at once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(windows.compare("value", other, v), f"{schema}, through int, op string")


def survival(counts: DataFrame, best: DataFrame, v: int) -> DataFrame:
    """(key, t, n): windows of a key that agree with its consensus through position t, for t from 0 to v."""
    rows = compared(counts.join(best.select("key", "consensus"), "key"), "consensus", v)
    each = rows.groupBy("key", "through").agg(F.sum("n").alias("n"))
    # What agrees through t bases is added up within the key's row, so that a key is shuffled once.
    by_key = each.groupBy("key").agg(F.max("through").alias("last"), F.map_from_entries(F.collect_list(F.struct("through", "n"))).alias("own"))
    alive = F.transform(F.sequence(F.lit(0), "last"), lambda t: through(F.col("own"), t, F.col("last")))
    return by_key.select("key", F.posexplode(alive).alias("t", "n"))


def through(own: Column, t: Column, last: Column) -> Column:
    """How many windows agree through t bases or more, of a map of those that agree through just so many."""
    return F.aggregate(F.sequence(t, last), F.lit(0).cast("long"), lambda s, u: s + F.coalesce(F.element_at(own, u), F.lit(0).cast("long")))


def hazard(alive: DataFrame) -> DataFrame:
    """(t, at_risk, survived, hazard) over all keys, for t from 1."""
    total = alive.groupBy("t").agg(F.sum("n").alias("survived"))
    before = total.select((F.col("t") + 1).alias("t"), F.col("survived").alias("at_risk"))
    return total.join(before, "t").select("t", "at_risk", "survived", (1 - F.col("survived") / F.col("at_risk")).alias("hazard"))


def weibull(rates: DataFrame) -> DataFrame:
    """One row: beta, lambda and h1 by least squares of log(-log(1 - hazard)) on log t, over the t whose hazard lies between 0 and 1."""
    ok = rates.filter("hazard > 0 and hazard < 1").select(F.log("t").alias("x"), F.log(-F.log1p(-F.col("hazard"))).alias("y"))
    fit = ok.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("points"))
    beta = F.col("slope") + 1
    rate = F.exp("intercept") / beta
    return fit.select(beta.alias("beta"), rate.alias("lambda"), (1 - F.exp(-rate)).alias("h1"), "points")


def neighbours(counts: DataFrame, best: DataFrame, v: int) -> DataFrame:
    """(key, value, n) of the values one edit away from their key's consensus."""
    rows = compared(counts.join(best.select("key", "consensus"), "key"), "consensus", v)
    return rows.filter("op is not null").select("key", "value", "consensus", "n")


def substitutions(near: DataFrame, v: int) -> DataFrame:
    """(op, n): the spectrum of the neighbours that differ by one substitution."""
    places = F.sequence(F.lit(1), F.lit(v))
    base = lambda s, i: F.substring(s, i, F.lit(1))
    differ = F.filter(places, lambda i: base(F.col("value"), i) != base(F.col("consensus"), i))
    one = near.withColumn("__at", differ).filter(F.size("__at") == 1).withColumn("__i", F.get("__at", F.lit(0)))
    return one.groupBy(F.concat(base(F.col("consensus"), F.col("__i")), F.lit(">"), base(F.col("value"), F.col("__i"))).alias("op")).agg(F.sum("n").alias("n"))


def levels(counts: DataFrame, best: DataFrame, v: int) -> DataFrame:
    """One row: keys, consensus windows, one-edit windows, all windows, and the level: one-edit windows over bases at risk."""
    near = neighbours(counts, best, v).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("neighbour_n"))
    total = best.agg(F.count(F.lit(1)).alias("keys"), F.sum("consensus_count").alias("consensus_n"), F.sum("total").alias("total_n"))
    out = total.crossJoin(near)  # one row each
    return out.withColumn("level", F.col("neighbour_n") / (v * (F.col("consensus_n") + F.col("neighbour_n"))))


def multiplicity(loci: DataFrame, v: int) -> DataFrame:
    """One row of weighted shares over keys of contigs: several loci, several values, off the majority value, by one edit or more.

    loci: (key, value, n), n being weighted occurrences.
    """
    order = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    ranked = loci.withColumn("rank", F.row_number().over(order)).withColumn("major", F.first("value").over(order))
    ranked = compared(ranked.select("key", "value", "n", "rank", "major"), "major", v)
    near = F.col("op").isNotNull()
    off = F.when(F.col("rank") > 1, F.col("n")).otherwise(0)
    by_key = ranked.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"), F.sum(off).alias("off"), F.sum(F.when((F.col("rank") > 1) & near, F.col("n")).otherwise(0)).alias("near"))
    share = lambda x: F.sum(x) / F.sum("n")
    return by_key.agg(
        share(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("multi_locus"),
        share(F.when(F.col("n_values") > 1, F.col("n")).otherwise(0)).alias("multi_value"),
        share(F.col("off")).alias("off_majority"), share(F.col("near")).alias("one_edit"), share(F.col("off") - F.col("near")).alias("more_edits"),
    )


def _tail(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chances of as many losses or more, of rows at_risk, lost and hazard."""
    for batch in batches:
        out = []
        for n, k, p in zip(*(batch[c].to_pylist() for c in ("at_risk", "lost", "hazard"))):
            if k <= 0:
                out.append(1.0)
                continue
            j = np.arange(k, n + 1)
            logs = math.lgamma(n + 1) - np.array([math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in j.tolist()]) + j * math.log(p) + (n - j) * math.log1p(-p)
            out.append(min(1.0, float(np.exp(logs).sum())))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "tail"])


def outliers(alive: DataFrame, p0: float = 1e-12, turns: int | None = None) -> DataFrame:
    """(key, t, at_risk, lost, tail) where a key loses more windows at a place than the hazard of all other keys lets expect.

    alive: (key, t, n) of `survival`; places that a key has no row for have none left. Hazards, one a place, are taken anew
    without the keys found, until no key joins them (or for so many turns). The tail is worked out once for each different
    count at a place, which are far fewer than keys.
    """
    stages = Stages(alive.sparkSession, "outliers")
    last = alive.agg(F.max("t")).first()[0] or 0
    before = alive.withColumn("t", F.col("t") + 1).withColumnRenamed("n", "at_risk").filter(F.col("t") <= last)
    rows = before.join(alive, ["key", "t"], "left").select("key", "t", "at_risk", (F.col("at_risk") - F.coalesce("n", F.lit(0))).alias("lost"))
    rows = stages.write(rows, "rows")
    counts = stages.write(rows.groupBy("t", "at_risk", "lost").count(), "counts")
    found: DataFrame | None = None
    known = 0
    turn = 0
    while True:
        turn += 1
        good = rows if found is None else rows.join(found.select("key").distinct(), "key", "left_anti")
        hazard = good.groupBy("t").agg(F.least(F.greatest(F.sum("lost") / F.greatest(F.sum("at_risk"), F.lit(1)), F.lit(1e-9)), F.lit(0.5)).alias("hazard"))
        # Where no good key is left at a place, nothing is expected of it.
        tails = counts.drop("count").join(F.broadcast(hazard), "t").mapInArrow(_tail, "t int, at_risk long, lost long, hazard double, tail double").filter(F.col("tail") < p0)
        new = stages.write(rows.join(tails, ["t", "at_risk", "lost"]).select("key", "t", "at_risk", "lost", "tail"), f"turn{turn}")
        both = new if found is None else found.unionByName(new.join(found.select("key", "t"), ["key", "t"], "left_anti"))
        keys = both.select("key").distinct().count()
        found = both
        if keys == known or turn == turns:
            return found
        known = keys


def by_loci(rows: DataFrame, loci: DataFrame) -> DataFrame:
    """(class, true_value, keys, n): keys of a sketch by how many loci of the contigs have them (0, 1, 2, 3-4, 5+), and whether their consensus is one of those loci's values."""
    at = loci.groupBy("key").agg(F.sum("n").alias("loci"))
    found = rows.join(at, "key", "left").join(loci.select("key", F.col("value").alias("consensus"), F.lit(True).alias("true_value")), ["key", "consensus"], "left")
    n = F.coalesce("loci", F.lit(0))
    kind = F.when(n >= 5, "5+").when(n >= 3, "3-4").otherwise(n.cast("long").cast("string"))
    return found.groupBy(kind.alias("class"), F.coalesce("true_value", F.lit(False)).alias("true_value")).agg(F.count(F.lit(1)).alias("keys"), F.sum("total").alias("n"))
