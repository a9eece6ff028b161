"""Count tables: a DataFrame of covariate columns and their count `n`, with what the counts are of."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import schema


class TableError(ValueError):
    """A table that breaks the rules for its fields, unit or counts."""


def counted(df: DataFrame, fields: list[str], n: str | None = None) -> DataFrame:
    """Rows of df (or their column n) added up by fields; keys without a positive count go."""
    total = F.count(F.lit(1)) if n is None else F.sum(n)
    return df.groupBy(*fields).agg(total.alias("n")).filter("n > 0")


def errors(op: Column) -> Column:
    return op != "="


@dataclass(frozen=True)
class CountTable:
    """fields: df's columns beside n, in order. truth: whether labels of edits are known to be true."""

    df: DataFrame
    fields: tuple[str, ...]
    unit: str = "base"
    truth: bool = False
    meta: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(set(self.fields)) != len(self.fields) or not all(map(schema.known_field, self.fields)):
            raise TableError(f"fields must be known and differ: {self.fields}")
        if self.unit not in schema.UNITS:
            raise TableError(f"unknown unit {self.unit!r}")
        if not self.truth and {"op", "indel"} & set(self.fields):
            raise TableError("labels of edits need a table of truth")
        if missing := {*self.fields, "n"} - set(self.df.columns):
            raise TableError(f"columns are missing: {sorted(missing)}")

    def validate(self) -> CountTable:
        """One pass over the data, at a source's boundary: counts are at least 0 and labels legal."""
        bad = F.col("n").isNull() | (F.col("n") < 0)
        if "op" in self.fields:
            bad |= ~F.col("op").isin(*sorted(schema.OPS))
        if found := self.df.filter(bad).head(1):
            raise TableError(f"illegal row {found[0].asDict()}")
        return self

    def marginal(self, *fields: str) -> CountTable:
        return replace(self, df=counted(self.df, list(fields), "n"), fields=fields)

    def plus(self, other: CountTable) -> CountTable:
        """Counts of both added up."""
        both = self.df.select(*self.fields, "n").unionByName(other.df.select(*self.fields, "n"))
        return replace(self, df=counted(both, list(self.fields), "n"))

    def minus(self, other: CountTable) -> CountTable:
        """Counts less those of other, where that leaves any."""
        a, b = self.df.select(*self.fields, "n"), other.df.select(*self.fields, (-F.col("n")).alias("n"))
        return replace(self, df=counted(a.unionByName(b), list(self.fields), "n"))

    def with_key(self, name: str, value: Column | Any) -> CountTable:
        """The table with a key column set to a value, in place of one of that name or as the last; rows that become equal add up."""
        fields = (*(f for f in self.fields if f != name), name)
        own = self.df.withColumn(name, value if isinstance(value, Column) else F.lit(value))
        return replace(self, df=counted(own, list(fields), "n"), fields=fields)

    def substitutions(self, indels: bool = False) -> CountTable:
        """Matches and substitutions alone, unless indels are asked for."""
        return self if indels else replace(self, df=self.df.filter("op = '=' or op not like '%-%'"))

    def exposure(self, *by: str) -> DataFrame:
        """(by, n, errors)."""
        return self.df.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(errors(F.col("op")), F.col("n"))), F.lit(0)).alias("errors"))
