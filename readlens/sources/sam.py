"""SAM text and BAM files as alignments of template and read, in the read's direction."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

from ..kernels.realign import end_to_end
from ..kernels.walk import revcomp
from . import splits
from .fastq import numbered, opened

# Flag bits of the format, and its letters for operations and bases in packed form.
PAIRED, UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = 0x1, 0x4, 0x10, 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
_CIGAR_LETTERS = "MIDNSHP=X"
_BASE_LETTERS = "=ACMGRSVTWYHKDBN"
_PART = re.compile(r"(\d+)([MIDNSHP=X])")
_SCHEMA = "file string, part long, idx long, name string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual string"


def sam_rows(lines: Iterable[bytes]) -> Iterator[tuple]:
    """(name, flag, contig, 0-based pos, mapq, cigar, seq, qual); stars are empty."""
    for line in lines:
        if line.startswith(b"@"):
            continue
        f = line.decode().rstrip("\r\n").split("\t")
        if len(f) < 11:
            raise ValueError(f"a SAM line has {len(f)} of 11 fields")
        empty = lambda x: "" if x == "*" else x
        yield f[0], int(f[1]), empty(f[2]), int(f[3]) - 1, int(f[4]), empty(f[5]), empty(f[9]), empty(f[10])


def _exactly(file, n: int) -> bytes:
    data = file.read(n)
    if len(data) != n:
        raise ValueError("the BAM file ends within a record")
    return data


def bam_header(file) -> tuple[list[str], list[int], int]:
    """Names and lengths of the contigs, and the header's unzipped size."""
    if _exactly(file, 4) != b"BAM\1":
        raise ValueError("no BAM file")
    text = struct.unpack("<i", _exactly(file, 4))[0]
    _exactly(file, text)
    size, names, lengths = 12 + text, [], []
    for _ in range(struct.unpack("<i", _exactly(file, 4))[0]):
        name = struct.unpack("<i", _exactly(file, 4))[0]
        names.append(_exactly(file, name)[:-1].decode())
        lengths.append(struct.unpack("<i", _exactly(file, 4))[0])
        size += 8 + name
    return names, lengths, size


def _bam_row(data: bytes, contigs: list[str]) -> tuple:
    """(name, flag, contig, 0-based pos, mapq, cigar, seq, qual) of a record."""
    ref, pos, name_size, mapq, _, ops, flag, size = struct.unpack_from("<iiBBHHHi", data)
    at = 32
    name = data[at : at + name_size - 1].decode()
    at += name_size
    cigar = "".join(f"{x >> 4}{_CIGAR_LETTERS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", data, at))
    at += 4 * ops
    packed = data[at : at + (size + 1) // 2]
    seq = "".join(_BASE_LETTERS[b >> 4] + _BASE_LETTERS[b & 15] for b in packed)[:size]
    at += len(packed)
    quality = data[at : at + size]
    return name, flag, contigs[ref] if ref >= 0 else "", pos, mapq, cigar, seq, "" if quality[:1] == b"\xff" else "".join(chr(q + 33) for q in quality)


def bam_rows(file) -> Iterator[tuple]:
    """Rows of a BAM file whose blocks have been unzipped (its blocks are members of one gzip stream)."""
    contigs, _, _ = bam_header(file)
    while head := file.read(4):
        yield _bam_row(_exactly(file, struct.unpack("<i", head)[0]), contigs)


def _is_bam(path: str) -> bool:
    with opened(path) as file:
        return hasattr(file, "peek") and file.peek(4)[:4] == b"BAM\1"


def part_rows(path: str, start: int, end: int) -> Iterator[tuple]:
    """The rows that a part of a file owns."""
    if not _is_bam(path):
        yield from sam_rows(splits.lines(path, start, end))
        return
    with opened(path) as file:
        contigs, lengths, size = bam_header(file)
    for data in splits.bam_records(path, start, end, size, lengths):
        yield _bam_row(data, contigs)


class _File(InputPartition):
    def __init__(self, path: str, part: tuple[int, int] | None = None) -> None:
        self.path, self.part = path, part


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.split = int(options.get("split_bytes", 0))

    def partitions(self) -> list[InputPartition]:
        if not self.split:
            return [_File(p) for p in self.paths]
        return [_File(p, part) for p in self.paths for part in splits.ranges(p, self.split)]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.part and splits.kind(partition.path) != "gzip":
            for k, row in enumerate(part_rows(partition.path, *partition.part)):
                yield (partition.path, partition.part[0], k, *row)
            return
        with opened(partition.path) as file:
            for k, row in enumerate(bam_rows(file) if _is_bam(partition.path) else sam_rows(file)):
                yield (partition.path, 0, k, *row)


class SamSource(DataSource):
    """format("alignments"): SAM or BAM by content; option paths (comma-joined), one partition for each file. With split_bytes, files are read
    in parts of about so many bytes: `part` is where one begins, and idx counts within it. Gzip files that aren't blocks stay whole."""

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_records(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    """Records with file and idx, their place in it. With split_bytes, files are read in parts, each a partition, and records are counted first."""
    spark.dataSource.register(SamSource)
    source = spark.read.format("alignments").option("paths", ",".join(paths))
    if not split_bytes:
        return source.load().drop("part")
    return numbered(source.option("split_bytes", split_bytes).load(), "file").drop("part")


def pair_flags(records: DataFrame) -> DataFrame:
    """Records whose names end in :m1 or :m2 with the flags of a pair's first or second mate, and without that suffix; others as they are."""
    mate = F.regexp_extract("name", r":m([12])$", 1)
    bits = F.when(mate == "1", PAIRED | FIRST).when(mate == "2", PAIRED | SECOND).otherwise(0)
    return records.withColumns({"flag": F.col("flag").bitwiseOR(bits), "name": F.regexp_replace("name", r":m[12]$", "")})


def reads_as_sequenced(records: DataFrame) -> DataFrame:
    """name, seq as stored and qual in the read's direction, of every primary record, mapped or not."""
    primary = records.filter(F.col("flag").bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0)
    return primary.select("name", "seq", F.when(F.col("flag").bitwiseAND(REVERSE) != 0, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def _aligned(row: dict, reference: str, unclip: bool) -> dict | None:
    """One record as an alignment, or None if it can't be used."""
    found = [(int(n), op) for n, op in _PART.findall(row["cigar"])]
    if not found or any(op in "NP" for _, op in found):
        return None
    found = [(n, op) for n, op in found if op != "H"]
    before = found.pop(0)[0] if found and found[0][1] == "S" else 0
    behind = found.pop()[0] if found and found[-1][1] == "S" else 0
    merged: list[list] = []
    for n, op in found:
        op = "M" if op in "=X" else op
        if merged and merged[-1][1] == op:
            merged[-1][0] += n
        else:
            merged.append([n, op])
    start = row["pos"]
    end = start + sum(n for n, op in merged if op != "I")
    seq, qual = row["seq"].upper(), row["qual"]
    if len(qual) != len(seq) or before + behind + sum(n for n, op in merged if op != "D") != len(seq) or end > len(reference) or end <= start:
        return None
    cigar = "".join(f"{n}{op}" for n, op in merged)
    if unclip and before + behind:
        whole = end_to_end(reference, start, end, seq, before, behind)
        if whole is not None:  # else a clipped end is none of the reference's, and the aligner's clip stays
            alignment, low = whole
            start, end, cigar, before, behind = low + alignment.start, low + alignment.end, alignment.cigar, 0, alignment.after
            merged = [[int(n), op] for n, op in _PART.findall(cigar)]
    template = reference[start:end].upper()
    body, quality = seq[before : len(seq) - behind], qual[before : len(seq) - behind]
    clips = [qual[:before], qual[len(seq) - behind :]]
    reverse = bool(row["flag"] & REVERSE)
    if reverse:
        template, body, quality = revcomp(template), revcomp(body), quality[::-1]
        merged.reverse()
        clips = [clips[1][::-1], clips[0][::-1]]
    if merged and merged[-1][1] == "I":  # nothing follows it that it could be an insertion before
        n = merged.pop()[0]
        clips[1] = quality[len(quality) - n :] + clips[1]
        body, quality = body[: len(body) - n], quality[: len(quality) - n]
    return {
        "contig": row["contig"], "start": start, "end": end, "reverse": reverse, "template": template, "sequence": body, "quality": quality,
        "cigar": "".join(f"{n}{op}" for n, op in merged), "clip_before": clips[0], "clip_after": clips[1], "mate": 2 if row["flag"] & SECOND else 1,
    }


#: A genome of so many bases goes to every executor whole; of a larger one, records are joined with the pieces that they lie on.
BROADCAST_BASES = 64 << 20
PIECE = 1 << 16
#: Bases around a record that realigning its clipped ends may look at.
MARGIN = 16


def _on_pieces(keyed: DataFrame, reference: DataFrame, piece: int) -> DataFrame:
    """Records with the piece of their contig that holds all that they span, `ref`, and where it begins, `low`.

    Pieces overlap by the longest span, so each record needs one. Where records crowd on a piece, the planner splits them.
    """
    counts = F.regexp_extract_all("cigar", F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    span = F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n.cast("long")) + 2 * (F.length("seq") + MARGIN)
    own = keyed.withColumns({"__span": span, "piece": F.floor(F.greatest(F.col("pos") - F.length("seq") - MARGIN, F.lit(0)) / piece)})
    longest = own.agg(F.max("__span")).first()[0] or 0
    starts = F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 1, F.lit(0)) / piece))).alias("piece")
    cut = reference.select(F.col("name").alias("contig"), "seq", starts).select("contig", "piece", F.substring("seq", (F.col("piece") * piece + 1).cast("int"), F.lit(int(piece + longest))).alias("ref"))
    return own.drop("__span").join(cut, ["contig", "piece"]).withColumn("low", F.col("piece") * piece).drop("piece")


def alignments(records: DataFrame, reference: DataFrame, min_mapq: int = 20, unclip: bool = False, broadcast_bases: int = BROADCAST_BASES, piece: int = PIECE) -> DataFrame:
    """Usable records with their template: mapped, primary, passed, no duplicate, MAPQ of min_mapq or more.

    reference: name and seq of the contigs; records on others are left out. Up to broadcast_bases it is sent to every executor,
    else cut into pieces that records are joined with. The cheap filters on flags come before the kernel, as the planner
    can't move them there.
    """
    bad = UNMAPPED | SECONDARY | FAILED | DUPLICATE | SUPPLEMENTARY
    usable = records.filter((F.col("flag").bitwiseAND(bad) == 0) & (F.col("mapq") >= min_mapq) & (F.col("cigar") != "") & (F.col("seq") != "") & (F.col("qual") != ""))
    keyed = usable.select(F.xxhash64("file", "idx").alias("read_id"), "flag", "contig", "pos", "cigar", "seq", "qual")
    text = pa.string()
    schema = pa.schema([("read_id", pa.int64()), ("contig", text), ("start", pa.int64()), ("end", pa.int64()), ("reverse", pa.bool_()), ("template", text), ("sequence", text), ("quality", text), ("cigar", text), ("clip_before", text), ("clip_after", text), ("mate", pa.int32())])

    bases = reference.agg(F.sum(F.length("seq"))).first()[0] or 0
    if bases > broadcast_bases:
        keyed, shared = _on_pieces(keyed, reference, piece), None
    else:
        shared = records.sparkSession.sparkContext.broadcast({r["name"]: r["seq"] for r in reference.select("name", "seq").collect()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, low = (shared.value.get(row["contig"]), 0) if shared else (row["ref"], row["low"])
                if text is not None and (made := _aligned(row | {"pos": row["pos"] - low}, text, unclip)):
                    rows.append(made | {"read_id": row["read_id"], "start": made["start"] + low, "end": made["end"] + low})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return keyed.mapInArrow(run, "read_id long, contig string, start long, end long, reverse boolean, template string, sequence string, quality string, cigar string, clip_before string, clip_after string, mate int")
