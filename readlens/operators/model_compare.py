"""Two fitted error heads beside each other, by what they predict for the same rows: rates, shares of labels, shapes by context.

Heads may have different components; rows are scored in Spark with both, and all else is adding up. Without indels, only
matches and substitutions count, and chances are taken given that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import category, numbers_first
from ..models.heads import Head
from ..models.spread import scored
from ..schema import CATEGORIES
from ..table import CountTable, counted

AXES = ("q", "pos_start", "pos_end", "gc", "strand", "mate")
_SUBSTITUTIONS = 5


def predicted(table: CountTable, a: Head, b: Head, indels: bool = False) -> DataFrame:
    """The table's rows with `a` and `b`, each head's chances of the categories that count. Both need covariates of the table alone."""
    own = table.substitutions(indels).df
    width = len(CATEGORIES) if indels else _SUBSTITUTIONS
    out = scored(scored(own, a, "a"), b, "b")

    def given(name: str) -> Column:
        p = F.transform(F.slice(name, 1, width), lambda x: F.exp(x))
        return F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda s, y: s + y))

    return out.withColumns({"a": given("a"), "b": given("b")})


def _rate(name: str) -> Column:
    return F.sum(F.col("n") * (1 - F.get(name, F.lit(0)))) / F.sum("n")


def overall(rows: DataFrame) -> DataFrame:
    """One row: rows, rates of both, b's over a's, b's less a's, total variation of the chances and log-likelihoods, a row each. No rows: nulls."""
    apart = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2
    likely = lambda name: F.sum(F.col("n") * F.log(F.get(name, category(F.col("op"))))) / F.sum("n")
    out = rows.agg(F.sum("n").alias("rows"), _rate("a").alias("rate_a"), _rate("b").alias("rate_b"), (F.sum(F.col("n") * apart) / F.sum("n")).alias("op_tv"), likely("a").alias("log_likelihood_a"), likely("b").alias("log_likelihood_b"))
    return out.withColumns({"ratio": F.try_divide("rate_b", "rate_a"), "excess": F.col("rate_b") - F.col("rate_a")})


def by_component(rows: DataFrame, by: tuple[str, ...] = AXES, least: float = 100) -> DataFrame:
    """(axis, value, n, rate_a, rate_b, ratio) for each value of those covariates that the rows have, if it has exposure enough; numbers in order.

    A null value (a quality beyond a read's end, say) is none.
    """
    have = [f for f in by if f in rows.columns]
    if not have:
        raise ValueError(f"the rows have none of {', '.join(by)}")
    axes = F.explode(F.array(*(F.struct(F.lit(f).alias("axis"), F.col(f).cast("string").alias("value")) for f in have)))
    each = rows.select(axes.alias("x"), "n", "a", "b").select("x.axis", "x.value", "n", "a", "b").filter("value is not null")
    out = each.groupBy("axis", "value").agg(F.sum("n").alias("n"), _rate("a").alias("rate_a"), _rate("b").alias("rate_b")).filter(F.col("n") >= least)
    return out.withColumn("ratio", F.try_divide("rate_b", "rate_a")).orderBy("axis", *numbers_first(F.col("value")))


def context_shape(rows: DataFrame, least: float = 100) -> DataFrame:
    """One row: contexts with exposure enough, slope and correlation of b's log-odds of an error on a's, and the mean size of the rates' log ratio.

    A slope under 1 is an effect that b has shrunk. Fewer than two contexts leave slope and correlation null.
    """
    own = rows.groupBy("context").agg(F.sum("n").alias("n"), _rate("a").alias("rate_a"), _rate("b").alias("rate_b")).filter(F.col("n") >= least)
    inside = lambda r: F.greatest(F.least(r, F.lit(1 - 1e-12)), F.lit(1e-12))
    odds = lambda r: F.log(inside(r) / (1 - inside(r)))
    own = own.select(odds(F.col("rate_a")).alias("x"), odds(F.col("rate_b")).alias("y"), F.abs(F.log(inside(F.col("rate_b")) / inside(F.col("rate_a")))).alias("gap"))
    return own.agg(F.count(F.lit(1)).alias("contexts"), F.regr_slope("y", "x").alias("log_odds_slope"), F.corr("x", "y").alias("r"), F.avg("gap").alias("mean_abs_log_ratio"))


def label_mass(rows: DataFrame) -> DataFrame:
    """(category, share_a, share_b): how both split the errors that they expect among the categories."""
    each = [rows.select(F.posexplode(name).alias("k", "p"), "n").filter("k > 0").select("k", (F.col("n") * F.col("p")).alias(f"mass_{name}"), F.lit(0.0).alias(f"mass_{'b' if name == 'a' else 'a'}")) for name in ("a", "b")]
    mass = reduce(DataFrame.unionByName, each).groupBy("k").agg(F.sum("mass_a").alias("mass_a"), F.sum("mass_b").alias("mass_b"))
    total = mass.agg(F.sum("mass_a").alias("all_a"), F.sum("mass_b").alias("all_b"))
    names = F.array(*map(F.lit, CATEGORIES))
    return mass.crossJoin(F.broadcast(total)).select(F.get(names, F.col("k")).alias("category"), F.try_divide("mass_a", "all_a").alias("share_a"), F.try_divide("mass_b", "all_b").alias("share_b"))  # total has one row


def rows_of(df: DataFrame, a: Head, b: Head, by: tuple[str, ...] = AXES) -> CountTable:
    """A count table of the covariates that either head reads, those to compare by, and op."""
    fields = tuple(dict.fromkeys([*a.fields(), *b.fields(), *(f for f in by if f in df.columns), "op"]))
    return CountTable(counted(df, list(fields), "n" if "n" in df.columns else None), fields, truth=True)
