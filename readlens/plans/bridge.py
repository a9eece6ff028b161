"""Pseudo-reads from the driver's tables, made alike in Spark and in SQL. They test operators and mean nothing in biology.

Every letter of every whole text of `documents` becomes a base; a text's bases are cut into reads of WIDTH. Qualities,
errors and mates follow from position and read number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import revcomp

WIDTH = 100
QUALITIES = (2, 12, 23, 37)
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = ("ACGT" * 7)[:26] * 2

#: Views that oracles start from: raw, reads, bases and obs, as below.
SQL = f"""
WITH raw AS (
  SELECT doc_id, source, regexp_replace(translate(text, '{_LETTERS}', '{_BASES}'), '[^ACGT]', '', 'g') AS s FROM documents
), reads AS (
  SELECT doc_id, source, doc_id * 100000 + i AS read_id, i AS chunk, CAST((doc_id + i) % 2 + 1 AS INTEGER) AS mate, substr(s, i * {WIDTH} + 1, {WIDTH}) AS seq
  FROM (SELECT doc_id, source, s, unnest(range(0, (length(s) + {WIDTH - 1}) // {WIDTH})) AS i FROM raw)
), places AS (
  SELECT *, unnest(range(1, length(seq) + 1)) AS pos FROM reads
), bases AS (
  SELECT doc_id, source, read_id, chunk, mate, seq, CAST(pos AS INTEGER) AS pos_start, CAST(length(seq) - pos + 1 AS INTEGER) AS pos_end, substr(seq, pos, 1) AS base,
    [{', '.join(map(str, QUALITIES))}][CAST((ascii(substr(seq, pos, 1)) * 7 + pos * 3 + read_id) % 4 AS INTEGER) + 1] AS q
  FROM places
), obs AS (
  SELECT *, CASE WHEN (pos_start * 31 + read_id * 17) % 23 = 0 THEN base || '>' || translate(base, 'ACGT', 'CGTA') ELSE '=' END AS op,
    chunk * {WIDTH} + pos_start AS site,
    CASE WHEN (pos_start * 31 + read_id * 17) % 23 = 0 THEN translate(base, 'ACGT', 'CGTA') ELSE base END AS called
  FROM bases
)"""


#: Tasks a core that the reads are made in, at least.
TASKS = 4


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew where its rows come in fewer than TASKS tasks a core.

    Only tasks that have rows count: one of them reads a row group whole, in however many parts its file is cut.
    """
    wanted = TASKS * df.sparkSession.sparkContext.defaultParallelism
    busy = df.select(F.spark_partition_id().alias("task")).distinct().count()  # reads no column of a scan
    return df.repartition(wanted, *df.columns) if busy < wanted else df


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, read_id, chunk, mate, seq, q."""
    return cut(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")))


def cut(docs: DataFrame) -> DataFrame:
    """The reads of documents (doc_id, source, text). A text that is null or has no letter has none, and without a doc_id reads have no read_id and no qualities."""
    raw = docs.select("doc_id", "source", F.regexp_replace(F.translate("text", _LETTERS, _BASES), "[^ACGT]", "").alias("s"))
    cut = raw.select("doc_id", "source", F.posexplode(F.regexp_extract_all("s", F.lit(f".{{1,{WIDTH}}}"), F.lit(0))).alias("chunk", "seq"))
    numbered = cut.withColumn("read_id", F.col("doc_id") * 100000 + F.col("chunk"))
    rows = numbered.select("doc_id", "source", "read_id", "chunk", ((F.col("doc_id") + F.col("chunk")) % 2 + 1).cast("int").alias("mate"), "seq")
    return _by_base(rows, "seq", "q", "array<int>", _qualities)


_WRONG = np.arange(256, dtype=np.uint8)
_WRONG[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"CGTA", np.uint8)
_LEVELS = np.array(QUALITIES, np.int32)

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Array]


def _by_base(df: DataFrame, text: str, name: str, kind: str, kernel: Kernel) -> DataFrame:
    """df with a column that follows from read_id, place and base of each base of a column of ASCII; a batch of reads at once.

    Arrays of a batch take the place of functions that Spark would interpret base by base, and anew for each column that uses them.
    kernel: of all bases the byte, the 1-based place and the read_id (0 where null), of all reads the offsets and whether read_id is null.
    """
    columns = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[text].to_pylist()
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            offsets = np.concatenate(([0], np.cumsum(size)))
            place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + 1
            unknown = batch["read_id"].is_null().to_numpy(zero_copy_only=False)
            read = np.repeat(batch["read_id"].fill_null(0).to_numpy(), size)
            made = kernel(np.frombuffer("".join(texts).encode("ascii"), np.uint8), place, read, offsets.astype(np.int32), unknown)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*columns, name])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` {kind}")


def _qualities(base: np.ndarray, place: np.ndarray, read: np.ndarray, offsets: np.ndarray, unknown: np.ndarray) -> pa.Array:
    level = _LEVELS[(base.astype(np.int64) * 7 + place * 3 + read) % 4]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(level, mask=np.repeat(unknown, np.diff(offsets))))


def _planted(place: np.ndarray, read: np.ndarray, offsets: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Whether a base is one that a substitution is planted at."""
    return ((place * 31 + read * 17) % 23 == 0) & ~np.repeat(unknown, np.diff(offsets))


def _text(codes: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes, np.uint8)))


def called(df: DataFrame) -> DataFrame:
    """reads with `template`, the true bases, and `seq` with planted substitutions."""

    def own(base, place, read, offsets, unknown):
        return _text(np.where(_planted(place, read, offsets, unknown), _WRONG[base], base), offsets)

    return _by_base(df.withColumnRenamed("seq", "template"), "template", "seq", "string", own)


def called_low(df: DataFrame) -> DataFrame:
    """The reads of `called` with `low`, the read whose substitutions are those at the lowest quality alone. A batch at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch[c].to_pylist() for c in ("template", "seq")]
            template, seq = (np.frombuffer("".join(x).encode("ascii"), np.uint8) for x in texts)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts[0]]))).astype(np.int32)
            worst = batch["q"].flatten().fill_null(-1).to_numpy(zero_copy_only=False) == QUALITIES[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, _text(np.where(worst, seq, template), offsets)], names=[*batch.schema.names, "low"])

    made = called(df)
    return made.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", low string")


def strings(df: DataFrame) -> DataFrame:
    """(read_id, ops, q): the columns of `called` reads as strings, = match and X substitution."""

    def own(base, place, read, offsets, unknown):
        return _text(np.where(_planted(place, read, offsets, unknown), ord("X"), ord("=")), offsets)

    return _by_base(df, "seq", "ops", "string", own).select("read_id", "ops", "q")


def placed(df: DataFrame) -> DataFrame:
    """The reads of `called` with `contig`, one for each source, and `start`, the 0-based place of each chunk."""
    return called(df).withColumn("contig", F.col("source")).withColumn("start", (F.col("chunk") * WIDTH).cast("long"))


def _marked(df: DataFrame) -> DataFrame:
    """df with `quality`, the signs of its qualities that aren't null; a batch of reads at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch["q"].flatten()
            known = ~q.is_null().to_numpy(zero_copy_only=False)
            read = np.repeat(np.arange(batch.num_rows), batch["q"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            size = np.bincount(read[known], minlength=batch.num_rows)
            marks = q.fill_null(0).to_numpy(zero_copy_only=False)[known] + 33
            yield pa.RecordBatch.from_arrays([*batch.columns, _text(marks, np.concatenate(([0], np.cumsum(size))).astype(np.int32))], names=[*batch.schema.names, "quality"])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", quality string")


def alignments(df: DataFrame) -> DataFrame:
    """The reads of `called` as alignments: one contig for each source, each chunk at its own place, forward, without indels."""
    return placed(_marked(df)).select(
        "read_id", "contig", "start", F.lit(False).alias("reverse"), "template", F.col("seq").alias("sequence"), "quality", F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"), "mate",
    )


def pairs(df: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """All reads as mate pairs of seven tenths of their length each; the second mate has the substitutions of `called`. carry: further columns."""
    size = F.length("template")
    m = F.floor(size * 7 / 10).cast("int")
    return called(df).filter(m > 0).select(
        F.col("read_id").alias("pair_id"), F.substring("template", F.lit(1), m).alias("r1"), F.slice("q", F.lit(1), m).alias("q1"),
        revcomp(F.substring("seq", size - m + 1, m)).alias("r2"), F.reverse(F.slice("q", size - m + 1, m)).alias("q2"), *carry,
    )
