"""Sites that vary, told apart from errors: an error head and the sites' posteriors are fitted in turns.

Scores come back to the bases by an equi-join on covariates, and posteriors are columns, so nothing of a genome's size is
held by the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import category
from ..table import counted
from . import spread
from .heads import Head, Penalty

CATEGORIES = range(1, 10)


def _scores(head: Head, rows: DataFrame, fields: list[str]) -> DataFrame:
    """(fields, p1 .. p9): chances of each edit, for the covariate tuples that occur."""
    scored = spread.scored(rows.select(*fields).distinct(), head)
    return scored.select(*fields, *(F.exp(F.get("logp", F.lit(k))).alias(f"p{k}") for k in CATEGORIES))


def _posterior(prior: float, linked: Column, linkage: float) -> Column:
    d = F.col("depth")
    factors = []
    for k in CATEGORIES:
        p0 = F.least(F.greatest(F.col(f"e{k}") / d, F.lit(1e-9)), F.lit(0.5))
        p1 = F.least(F.greatest(F.col(f"o{k}") / d, p0), F.lit(1 - 1e-9))
        factors.append(F.col(f"o{k}") * F.log(p1 / p0) + (d - F.col(f"o{k}")) * (F.log1p(-p1) - F.log1p(-p0)))
    x = math.log(prior / (1 - prior)) + F.greatest(*factors) + F.when(linked, linkage).otherwise(0.0)
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-500.0)), F.lit(500.0))))


def joint(rows: DataFrame, tokens: list[str], alphabet: tuple[int, ...], flank: tuple[int, int], links: DataFrame | None = None, prior: float = 1e-3, linkage: float = 5.0, threshold: float = 0.5, iterations: int = 3, penalty: Penalty = Penalty()) -> tuple[Head, DataFrame]:
    """(head, sites). rows: observations with contig and site. sites: (contig, site, depth, posterior) of those above the threshold.

    Each turn fits the head on the sites that aren't thought to vary and tests all sites anew; it ends when the masked
    sites stay the same. links: (contig, site) of sites whose alleles go together in reads.
    """
    top = rows.agg(F.max("pos_start")).first()[0] or 2
    head = Head("E", tokens, alphabet, flank, top)
    fields = head.fields()
    own = rows.select("contig", "site", *fields, "op")
    masked: DataFrame | None = None
    before = None
    for _ in range(iterations):
        kept = own if masked is None else own.join(masked.select("contig", "site"), ["contig", "site"], "left_anti")
        spread.fit(counted(kept, [*fields, "op"]), head, penalty)
        scores = _scores(head, own, fields)
        same = [own[f].eqNullSafe(scores[f]) for f in fields]
        scored = own.join(scores, same).select("contig", "site", category(own["op"]).alias("kind"), *(f"p{k}" for k in CATEGORIES))
        sums = [F.sum(f"p{k}").alias(f"e{k}") for k in CATEGORIES] + [F.sum((F.col("kind") == k).cast("double")).alias(f"o{k}") for k in CATEGORIES]
        by_site = scored.groupBy("contig", "site").agg(F.count(F.lit(1)).cast("double").alias("depth"), *sums)
        if links is not None:
            by_site = by_site.join(links.select("contig", "site").distinct().withColumn("linked", F.lit(True)), ["contig", "site"], "left")
        linked = F.coalesce("linked", F.lit(False)) if links is not None else F.lit(False)
        masked = by_site.select("contig", "site", "depth", _posterior(prior, linked, linkage).alias("posterior")).filter(F.col("posterior") > threshold)
        now = masked.agg(F.count(F.lit(1)), F.sum(F.xxhash64("contig", "site").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return head, masked
