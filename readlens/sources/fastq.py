"""FASTQ and FASTA as DataFrames: a Python data source with one partition for each file, or for each part of a FASTQ file.

Strides are passed as options, because a data source can't be told of them by the planner. A part of a file doesn't know how
many records stand before it, so records of split files are counted first, in a pass of their own.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import PHRED_OFFSET
from . import splits


class FastqFormatError(ValueError):
    """A broken record; the message has the file and the line."""


def opened(path: str) -> io.BufferedReader:
    """The file's bytes, unzipped if they begin as gzip does, whatever its name."""
    file = open(path, "rb")
    zipped = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    return gzip.open(file) if zipped else file


def records(lines: Iterator[bytes], name: str = "") -> Iterator[tuple[str, str, str]]:
    """(name, bases, qualities as read) of each record. Blank lines between records are skipped."""
    number = 0
    for head in lines:
        number += 1
        head = head.rstrip()
        if not head:
            continue
        first = number
        rest = [next(lines, None) for _ in range(3)]
        number += 3
        if not head.startswith(b"@") or None in rest:
            raise FastqFormatError(f"{name}:{first}: no whole record starts here")
        seq, plus, quality = (x.rstrip(b"\r\n") for x in rest)
        if not plus.startswith(b"+") or len(seq) != len(quality):
            raise FastqFormatError(f"{name}:{first}: bases and qualities differ in number")
        if quality and not (33 <= min(quality) and max(quality) <= 126):
            raise FastqFormatError(f"{name}:{first + 3}: a quality is not a printable sign")
        yield head[1:].decode(), seq.decode(), quality.decode()


def fasta(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str]]:
    """(name, header, bases); lines that begin with ';' are comments."""
    header, parts = None, []
    for line in lines:
        text = line.decode().strip()
        if text.startswith(">"):
            if header is not None:
                yield (header.split() or [""])[0], header, "".join(parts)
            header, parts = text[1:], []
        elif text and not text.startswith(";"):
            parts.append(text)
    if header is not None:
        yield (header.split() or [""])[0], header, "".join(parts)


class _File(InputPartition):
    def __init__(self, order: int, path: str, part: tuple[int, int] | None = None) -> None:
        self.order, self.path, self.part = order, path, part


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.kind, self.every, self.offset = kind, int(options.get("every_n", 1)), int(options.get("offset", 0))
        self.split = int(options.get("split_bytes", 0))
        if not self.paths or self.every < 1 or self.offset < 0:
            raise ValueError("paths are needed, every_n is at least 1 and offset at least 0")

    def partitions(self) -> list[InputPartition]:
        if not self.split:
            return [_File(k, p) for k, p in enumerate(self.paths)]
        return [_File(k, p, part) for k, p in enumerate(self.paths) for part in splits.ranges(p, self.split)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.part:
            for k, row in enumerate(splits.records(partition.path, *partition.part)):
                yield (partition.order, partition.path, partition.part[0], k, *row)
            return
        with opened(partition.path) as file:
            found = records(iter(file), partition.path) if self.kind == "fastq" else fasta(iter(file))
            for k, row in enumerate(found):
                if k >= self.offset and (k - self.offset) % self.every == 0:
                    yield (partition.order, partition.path, *([0] if self.kind == "fastq" else []), k, *row)


class FastqSource(DataSource):
    """format("fastq"): options paths (comma-joined), every_n and offset within each file; or split_bytes, with which files are read in
    parts of about so many bytes: `part` is where one begins, and idx counts within it. Gzip files that aren't blocks stay whole."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file_order int, file string, part long, idx long, name string, seq string, qual string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, "fastq")


class FastaSource(DataSource):
    """format("fasta"): option paths (comma-joined)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "file_order int, file string, idx long, name string, header string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, "fasta")


def numbered(df: DataFrame, file: str) -> DataFrame:
    """df with idx counted within files, which a column names, instead of within their parts."""
    parts = df.groupBy(file, "part").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a part
    before, starts = {}, []
    for r in sorted(parts):
        starts.append((r[file], r["part"], before.get(r[file], 0)))
        before[r[file]] = starts[-1][2] + r["n"]
    known = df.sparkSession.createDataFrame(starts, f"{file} {df.schema[file].dataType.simpleString()}, part long, start long")
    return df.join(F.broadcast(known), [file, "part"]).withColumn("idx", F.col("idx") + F.col("start")).select(*df.columns)


def read_fastq(spark: SparkSession, paths: list[str], every_n: int = 1, offset: int = 0, limit: int | None = None, split_bytes: int | None = None) -> DataFrame:
    """file_order, file, idx, name, seq, qual and q (ARRAY<INT>). The stride runs within each file, the limit over all in order.

    With split_bytes, files are read in parts of about so many bytes, each a partition; rows are the same for any size.
    """
    spark.dataSource.register(FastqSource)
    source = spark.read.format("fastq").option("paths", ",".join(paths))
    if split_bytes:
        if every_n < 1 or offset < 0:
            raise ValueError("every_n is at least 1 and offset at least 0")
        df = numbered(source.option("split_bytes", split_bytes).load(), "file_order").filter((F.col("idx") >= offset) & ((F.col("idx") - offset) % every_n == 0))
    else:
        df = source.option("every_n", every_n).option("offset", offset).load()
    df = df.drop("part")
    if limit is not None:
        df = df.orderBy("file_order", "idx").limit(limit)
    values = F.transform(F.sequence(F.lit(1), F.length("qual")), lambda p: F.ascii(F.substring("qual", p, F.lit(1))) - PHRED_OFFSET)
    return df.withColumn("q", F.when(F.length("qual") > 0, values).otherwise(F.array().cast("array<int>")))


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("paths", ",".join(paths)).load()


def coverage(contigs: DataFrame) -> DataFrame:
    """contigs with the coverage that their header states as cov=, else 1."""
    return contigs.withColumn("coverage", F.coalesce(F.regexp_extract("header", r"\bcov=([0-9.eE+-]+)", 1).try_cast("double"), F.lit(1.0)))


def write_fastq(df: DataFrame, path: str, quality: bool = True, compression: str | None = None) -> None:
    """name, seq, qual [and cigar] as text; without quality the line is of stars."""
    name = F.concat(F.lit("@"), "name", F.concat(F.lit(" cigar:"), "cigar") if "cigar" in df.columns else F.lit(""))
    last = F.col("qual") if quality else F.repeat(F.lit("*"), F.length("seq"))
    writer = df.select(F.concat_ws("\n", name, "seq", F.lit("+"), last).alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)


def write_interleaved(pairs: DataFrame, path: str, only: int | None = None, compression: str | None = None) -> None:
    """Pairs (name, r1, qual1, r2, qual2) as text, both mates of each after another, named :m1 and :m2; or one mate alone.

    The suffix outlives aligners that cut /1 and /2 off a name; `sam.pair_flags` reads it.
    """
    if only not in (None, 1, 2):
        raise ValueError("a mate is 1 or 2")
    mates = [F.concat(F.lit("@"), "name", F.lit(f":m{k}\n"), f"r{k}", F.lit("\n+\n"), f"qual{k}") for k in ((1, 2) if only is None else (only,))]
    writer = pairs.select(F.concat_ws("\n", *mates).alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)


def write_subset(source: str, target: str, every_n: int = 1, offset: int = 0, limit: int | None = None) -> int:
    """A strided copy of one file, record for record; zipped if the target ends in .gz. Gives the number of records."""
    n = 0
    with opened(source) as file, (gzip.open(target, "wt") if target.endswith(".gz") else open(target, "w")) as out:
        for k, (name, seq, quality) in enumerate(records(iter(file), source)):
            if k < offset or (k - offset) % every_n:
                continue
            if n == limit:
                break
            out.write(f"@{name}\n{seq}\n+\n{quality}\n")
            n += 1
    return n
