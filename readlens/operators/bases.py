"""Reads as rows of bases, and the quality process: lags, windows, contexts and the profile of a read set.

reads: read_id, mate, seq, q (ARRAY<INT>, one of each base).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import gc_bin
from ..kernels import groups
from ..table import CountTable, counted


def subset(df: DataFrame, every_n: int = 1, offset: int = 0, limit: int | None = None, index: str = "idx") -> DataFrame:
    """Records offset, offset + every_n, ...; then the first `limit` of them. Never the head of a file alone."""
    if every_n < 1 or offset < 0:
        raise ValueError("every_n is at least 1 and offset at least 0")
    out = df.filter((F.col(index) >= offset) & ((F.col(index) - offset) % every_n == 0))
    return out if limit is None else out.orderBy(index).limit(limit)


def bases(reads: DataFrame, before: int = 0, after: int = 0, flank: tuple[int, int] = (0, 0), carry: tuple[str, ...] = ()) -> DataFrame:
    """One row of each base: read_id, mate, columns to carry, gc, pos_start and pos_end (1-based), base, context, q, q_m1.., q_p1..

    Reads whose sequence is null or empty have no bases; a null array of qualities gives null qualities.

    A read is made into as many rows first and each base's values looked up in the rows, by generated code: no structs of a
    read's bases are built. Lags need no window and no shuffle. Qualities beyond the read's ends are null.
    """
    left, right = flank
    seq, pos = F.upper("seq"), F.col("pos_start")
    own = reads.filter(F.length("seq") > 0).select(
        "read_id", "mate", *carry, gc_bin(seq).alias("gc"), F.col("q").alias("__q"), F.length(seq).alias("__size"),
        F.concat(F.lit("." * left), seq, F.lit("." * right)).alias("__around"), F.explode(F.sequence(F.lit(1), F.length(seq))).alias("pos_start"),
    )
    part = lambda start, n: F.substring("__around", start, F.lit(n))
    quality = [F.get("__q", pos + (o - 1)).alias(schema.shifted(o)) for o in (0, *range(-before, 0), *range(1, after + 1))]
    return own.select("read_id", "mate", *carry, "gc", "pos_start", (F.col("__size") - pos + 1).alias("pos_end"), part(pos + left, 1).alias("base"), part(pos, left + right + 1).alias("context"), *quality)


_MADE = {"pos_start": "int", "pos_end": "int", "base": "string", "context": "string", "op": "string", "site": "long"}
_QUALITY = re.compile(r"q(?:_([mp])([1-9]\d*))?\Z")


def base_counts(reads: DataFrame, fields: list[str], flank: tuple[int, int] = (0, 0)) -> DataFrame:
    """(fields, n): the rows of `bases` added up by some of their columns, many reads at once; what leaves a task is counts, not bases.

    Fields: pos_start, pos_end, base, context, q and the qualities around it, gc; columns of the reads; op, where the reads have a
    `template` of their length; site, where they have the place `start` of their first base. With a template, bases, contexts
    and gc are its own, and what isn't A, C, G or T in either is left out.
    """
    template = "template" in reads.columns
    text = F.upper("template" if template else "seq")
    asked = [int(m[2] or 0) * (-1 if m[1] == "m" else 1) if (m := _QUALITY.match(f)) else None for f in fields]
    carried = [f for f, o in zip(fields, asked) if o is None and f not in _MADE and f != "gc"]
    own = reads.filter(F.length(text) > 0).select(
        text.alias("__text"), *([F.upper("seq").alias("__called")] if template else []), *([F.col("start").cast("long").alias("__start")] if "site" in fields else []),
        *([F.col("q").cast("array<int>").alias("__q")] if any(o is not None for o in asked) else []), *([gc_bin(text).alias("gc")] if "gc" in fields else []), *carried,
    )
    kinds = [_MADE.get(f, "int") if f not in carried else own.schema[f].dataType.simpleString() for f in fields]
    left, right = flank

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        signs, size = groups.points(batch["__text"])
        first = np.cumsum(size) - size
        read = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(signs)) - first[read]
        if template:
            called, other = groups.points(batch["__called"])
            if (other != size).any():
                raise ValueError("a read and its template differ in length")
            acgt = np.frombuffer(b"ACGT", np.uint8)
            kept = np.flatnonzero(np.isin(signs, acgt) & np.isin(called, acgt))
        else:
            called, kept = signs, np.arange(len(signs))
        letters = np.unique(np.concatenate((np.flatnonzero(np.bincount(signs)), np.flatnonzero(np.bincount(called)), [ord(".")])))
        code = np.searchsorted(letters, np.arange(letters[-1] + 1))[signs]
        read, place = read[kept], place[kept]
        columns: list[np.ndarray] = []
        decode = []  # the number of columns that a field takes, and what makes it of them

        def add(values: list[np.ndarray], of) -> None:
            columns.extend(values)
            decode.append((len(values), of))

        def around(o: int) -> np.ndarray:
            there = (place + o >= 0) & (place + o < size[read])
            return np.where(there, code[np.where(there, kept + o, 0)], np.searchsorted(letters, ord(".")))

        spell = lambda *found: pa.array(["".join(map(chr, t)) for t in letters[np.stack(found, axis=1)].tolist()], pa.string())
        for f, o in zip(fields, asked):
            if o is not None:
                values, low = groups.values_at(batch["__q"], read, place + o)
                add([values], lambda x, low=low: pa.array((x + low).astype(np.int32), mask=x == 0))
            elif f == "pos_start":
                add([place + 1], lambda x: pa.array(x.astype(np.int32)))
            elif f == "pos_end":
                add([size[read] - place], lambda x: pa.array(x.astype(np.int32)))
            elif f == "base":
                add([code[kept]], spell)
            elif f == "context":
                add([around(o) for o in range(-left, right + 1)], spell)
            elif f == "op":
                to = np.searchsorted(letters, called[kept])
                same = to == code[kept]
                label = lambda a, b: pa.array(["=" if a == b else f"{chr(a)}>{chr(b)}" for a, b in zip(letters[a].tolist(), letters[b].tolist())], pa.string())
                add([np.where(same, 0, code[kept]), np.where(same, 0, to)], label)
            elif f == "site":
                site = batch["__start"].fill_null(0).to_numpy(zero_copy_only=False)[read] + place
                unknown = batch["__start"].is_null().to_numpy(zero_copy_only=False)[read]
                low = int(site.min()) if len(site) else 0
                add([np.where(unknown, 0, site - low + 1)], lambda x, low=low: pa.array(x + low - 1, mask=x == 0))
            else:
                numbers, values = groups.codes(batch[f])
                add([numbers[read]], lambda x, values=values: values.take(pa.array(x)))
        found, n = groups.grouped(columns)
        made, k = [], 0
        for used, of_columns in decode:
            made.append(of_columns(*found[k : k + used]))
            k += used
        return pa.RecordBatch.from_arrays([*made, pa.array(n)], names=[*fields, "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.chunks(batches, "__text"):
            yield of(batch)

    return counted(own.mapInArrow(run, ", ".join(f"`{f}` {k}" for f, k in zip([*fields, "n"], [*kinds, "long"]))), fields, "n")


def quality_table(reads: DataFrame, m: int = 1, flank: tuple[int, int] = (2, 2)) -> CountTable:
    """Rows of the quality head: m qualities before, positions from both ends, mate, context, q."""
    lags = [schema.shifted(-k) for k in range(m, 0, -1)]
    fields = (*lags, "pos_start", "pos_end", "mate", "context", "q")
    return CountTable(base_counts(reads, list(fields), flank), fields)


def profile(reads: DataFrame, order: int = 1, flank: tuple[int, int] = (2, 2)) -> dict[str, CountTable]:
    """Lengths, quality by position, quality transitions of an order (from the oldest on), quality by context."""
    rows = bases(reads, before=order, flank=flank)
    lags = tuple(schema.shifted(-k) for k in range(order, 0, -1))
    full = rows.filter(F.col("pos_start") > order)
    return {
        "length": CountTable(counted(reads.select(F.length("seq").alias("length")), ["length"]), ("length",), "read"),
        "position": CountTable(counted(rows, ["pos_start", "q"]), ("pos_start", "q")),
        "transition": CountTable(counted(full, [*lags, "q"]), (*lags, "q")),
        "context": CountTable(counted(rows, ["context", "q"]), ("context", "q")),
    }


def profile_axes(reads: DataFrame, by: tuple[str, ...] = (), flank: tuple[int, int] = (1, 1)) -> DataFrame:
    """(by, axis, value, q, n): qualities by position, by the quality before and by context, in one pass over the bases.

    Bases are added up by all covariates first, so the three groupings see few rows. A read's first base has no quality
    before it and is left out of that axis, as are bases without a quality of all.
    """
    fields = [*by, "pos_start", "q_m1", "context", "q"]
    cells = counted(bases(reads, before=1, flank=flank, carry=by).filter("q is not null"), fields)
    axis = {"position": F.col("pos_start").cast("string"), "transition": F.col("q_m1").cast("string"), "context": F.col("context")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), v.alias("value")) for k, v in axis.items())))
    return counted(cells.select(*by, each.alias("a"), "q", "n").select(*by, "a.axis", "a.value", "q", "n").filter("value is not null"), [*by, "axis", "value", "q"], "n")


def lag_moments(rows: DataFrame, x: str = "q_m1", y: str = "q") -> DataFrame:
    """n and the five sums of a lag's correlation, and the correlation (null where one side doesn't vary)."""
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sums = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    c = F.col
    spread = (c("n") * c("sxx") - c("sx") * c("sx")) * (c("n") * c("syy") - c("sy") * c("sy"))
    return sums.withColumn("r", F.when(spread > 0, (c("n") * c("sxy") - c("sx") * c("sy")) / F.sqrt(F.when(spread > 0, spread))))


def homopolymer_runs(rows: DataFrame, key: str = "read_id", at: str = "pos_start", base: str = "base") -> DataFrame:
    """(key, start, base, run) of every maximal run of one base."""
    order = Window.partitionBy(key).orderBy(at)
    marked = rows.withColumn("__new", (F.col(base) != F.lag(base).over(order)).cast("int"))
    runs = marked.withColumn("__run", F.sum(F.coalesce("__new", F.lit(0))).over(order))
    return runs.groupBy(key, "__run", base).agg(F.min(at).alias("start"), F.count(F.lit(1)).alias("run")).drop("__run")


def read_runs(reads: DataFrame) -> DataFrame:
    """(base, run, n): homopolymer runs of whole reads by length, found within each read, without a shuffle of bases."""
    runs = reads.select(F.explode(F.regexp_extract_all(F.upper("seq"), F.lit("(A+|C+|G+|T+)"), F.lit(1))).alias("s"))
    return counted(runs.select(F.substring("s", 1, 1).alias("base"), F.length("s").alias("run")), ["base", "run"])
