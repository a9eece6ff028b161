"""Comparing sources of evidence: shared support, standardised rates, spectra and distances, over count tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import op_class
from ..table import CountTable, errors


def on_support(table: CountTable, like: CountTable, by: list[str]) -> DataFrame:
    """table's rows reweighted so that its marginal over `by` has the shares of like's; values that only one has go."""
    def share(t: CountTable, name: str) -> DataFrame:
        own = t.marginal(*by).df
        return own.select(*by, (F.col("n") / own.agg(F.sum("n").alias("total")).select("total").scalar()).alias(name))

    both = share(table, "own").join(share(like, "wanted"), by)
    return table.df.join(both, by).select(*table.fields, (F.col("n") * F.col("wanted") / F.col("own")).alias("n"))


def standardised(a: CountTable, b: CountTable, by: list[str], least: int = 100) -> DataFrame:
    """One row: error rates of both over the values that have `least` exposure in each, weighted by the pooled exposure."""
    x, y = a.exposure(*by), b.exposure(*by).withColumnsRenamed({"n": "n_b", "errors": "errors_b"})
    shared = x.filter(F.col("n") >= least).join(y.filter(F.col("n_b") >= least), by)
    w = F.col("n") + F.col("n_b")
    rate = lambda e, n: F.sum(w * F.col(e) / F.col(n)) / F.sum(w)
    out = shared.agg(F.count(F.lit(1)).alias("shared"), rate("errors", "n").alias("rate_a"), rate("errors_b", "n_b").alias("rate_b"), F.sum("n").alias("n_a"), F.sum("n_b").alias("n_b"))
    return out.withColumn("ratio", F.try_divide("rate_b", "rate_a")).withColumn("excess", F.col("rate_b") - F.col("rate_a"))


def spectrum_distance(a: CountTable, b: CountTable, by: list[str]) -> DataFrame:
    """One row: total variation and correlation of the shares that error rows have in both, rows of one alone included."""
    x, y = (t.marginal(*by, "op").df.filter(errors(F.col("op"))) for t in (a, b))
    both = x.join(y.withColumnRenamed("n", "n_b"), [*by, "op"], "full").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_b", F.lit(0)).alias("n_b"))
    total = both.agg(F.sum("n").alias("t"), F.sum("n_b").alias("t_b"))
    shares = both.crossJoin(total).select((F.col("n") / F.col("t")).alias("a"), (F.col("n_b") / F.col("t_b")).alias("b"))  # total has one row
    return shares.agg((F.sum(F.abs(F.col("a") - F.col("b"))) / 2).alias("tv"), F.corr("a", "b").alias("r"), F.count(F.lit(1)).alias("rows"))


def rate_distance(real: CountTable, simulated: CountTable, by: list[str]) -> DataFrame:
    """One row: mean distance of log error rates (0.5 error and 1 base added), weighted by the real exposure."""
    x, y = real.exposure(*by), simulated.exposure(*by).withColumnsRenamed({"n": "n_s", "errors": "errors_s"})
    log = lambda e, n: F.log((F.col(e) + 0.5) / (F.col(n) + 1))
    gap = F.abs(log("errors_s", "n_s") - log("errors", "n"))
    return x.join(y, by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("distance"), F.count(F.lit(1)).alias("shared"))


def error_axes(rows: DataFrame, cycle_bin: int = 10) -> DataFrame:
    """(axis, value, class, n): observations by quality, by cycle bin and by context at once, as grouping sets."""
    own = rows.select(F.col("q").cast("string").alias("q"), F.floor((F.col("pos_start") - 1) / cycle_bin).cast("string").alias("cycle"), "context", op_class(F.col("op")).alias("class"), "n")
    sets = own.groupingSets([["q", "class"], ["cycle", "class"], ["context", "class"]], "q", "cycle", "context", "class").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    axis = F.when(F.col("q").isNotNull(), "q").when(F.col("cycle").isNotNull(), "cycle").otherwise("context")
    return sets.select(axis.alias("axis"), F.coalesce("q", "cycle", "context").alias("value"), "class", "n")


def read_rates(rows: DataFrame, width: float = 0.002, cap: int = 50) -> DataFrame:
    """(bin, reads): reads by their error rate, in bins of a width; the last bin also holds all above."""
    per = rows.groupBy("read_id").agg(F.sum(F.when(errors(F.col("op")), F.col("n")).otherwise(0)).alias("e"), F.sum("n").alias("n"))
    return per.groupBy(F.least(F.floor(F.col("e") / F.col("n") / width), F.lit(cap)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("reads"))


def quantiles(bins: DataFrame, shares: list[float], width: float = 0.002) -> DataFrame:
    """(share, value): the middle of the first bin in which so great a share of the reads has been passed."""
    order = Window.orderBy("bin")  # a histogram of at most cap + 1 rows
    running = bins.withColumn("share_so_far", F.sum("reads").over(order) / F.sum("reads").over(Window.partitionBy()))
    wanted = bins.sparkSession.createDataFrame([(s,) for s in shares], "share double")
    return running.join(F.broadcast(wanted), F.col("share_so_far") >= F.col("share")).groupBy("share").agg(((F.min("bin") + 0.5) * width).alias("value"))


def implied_rate(rows: DataFrame) -> DataFrame:
    """One row: the error rate that the qualities claim, and the share of bases that are errors."""
    return rows.agg(
        (F.sum(F.pow(F.lit(10.0), -F.col("q") / 10) * F.col("n")) / F.sum("n")).alias("implied"),
        (F.sum(F.when(errors(F.col("op")), F.col("n")).otherwise(0)) / F.sum("n")).alias("measured"),
    )


def column_rates(columns: DataFrame) -> DataFrame:
    """(kind, exposure, errors, rate, implied): error rates of alignment columns by what counts.

    columns: op (M, I or D), ref, alt, q and n. substitution: read bases that stand for a template base, and those that differ.
    any: all read bases, and every edit, deletions too. implied: what the qualities of the exposed bases claim. Without
    exposure rates are null.
    """
    differs = (F.col("op") == "M") & (F.col("ref") != F.col("alt"))
    kinds = {"substitution": (F.col("op") == "M", differs), "any": (F.col("op") != "D", differs | (F.col("op") != "M"))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), e.alias("exposed"), x.alias("error")) for k, (e, x) in kinds.items()))).alias("k")
    own = columns.select("n", "q", each).select("n", "q", "k.*")
    some = lambda c, x=F.col("n"): F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    claimed = F.pow(F.lit(10.0), -F.col("q") / 10) * F.col("n")
    out = own.groupBy("kind").agg(some(F.col("exposed")).alias("exposure"), some(F.col("error")).alias("errors"), F.sum(F.when(F.col("exposed"), claimed)).alias("c"))
    return out.select("kind", "exposure", "errors", F.try_divide("errors", "exposure").alias("rate"), F.try_divide("c", "exposure").alias("implied"))
