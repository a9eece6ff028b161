"""What tells the rows of a table apart that has ids of any type, null and repeated ones too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Two hashes of the text, which need other seeds to be independent, and one of the id.
ROW = ("h1", "h2", "h3")


def row_hashes(id_: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text), F.xxhash64(F.lit(3), id_)]


def typed(rows: DataFrame, kept: list[str], more: str) -> StructType:
    """A schema of columns of rows, with their types, and of more columns."""
    return StructType([*(rows.schema[n] for n in kept), *StructType.fromDDL(more).fields])


def added(df: DataFrame, column: str, more: str) -> tuple[list[str], StructType]:
    """Names of df's columns but one of the new names, which is replaced, and the schema with the new columns at its end."""
    fields = StructType.fromDDL(more).fields
    new = {f.name.lower() for f in fields} - {column.lower()}
    kept = [n for n in df.columns if n.lower() not in new]
    return kept, StructType([*(df.schema[n] for n in kept), *fields])
