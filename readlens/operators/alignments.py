"""Alignments as rows: the walk kernel under Arrow, pileups, site masks and linked sites.

alignments: read_id, contig, start (0-based), reverse, template, sequence, quality (Phred+33), cigar, mate. Template and
read stand in the read's direction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..kernels import groups, plain, walk
from ..table import CountTable, counted

_COLUMNS = ("read_id", "contig", "start", "reverse", "template", "sequence", "quality", "cigar", "mate")
_OPTIONAL = {"clip_before": "", "clip_after": "", "strand": None, "masked": None}


def _reads(batch: pa.RecordBatch) -> Iterator[tuple[dict, walk.Read]]:
    for row in batch.to_pylist():
        own = {k: row.get(k) if row.get(k) is not None else v for k, v in _OPTIONAL.items()}
        yield row, walk.Read(row["template"], row["sequence"], row["quality"], row["cigar"], own["clip_before"], own["clip_after"], own["strand"], row["mate"], frozenset(own["masked"] or ()))


def _site(row: dict, t: int) -> int:
    """The contig's place of a template base."""
    return row["start"] + (len(row["template"]) - 1 - t if row["reverse"] else t)


def _input(df: DataFrame) -> DataFrame:
    return df.select(*_COLUMNS, *(c for c in _OPTIONAL if c in df.columns))


def observations(df: DataFrame, flank: tuple[int, int] = (2, 2), m: int = 1, per_event: bool = False) -> DataFrame:
    """One row of each draw: read_id, contig, site, t, q, q_m1, q_p1 .., context, pos_start, pos_end, mate, strand, gc, op.

    Reads of one M part are worked out as arrays, a batch at once; only reads with gaps are walked base by base.
    """
    around = [schema.shifted(o) for o in schema.window(m)[1:]]
    names = ["read_id", "contig", "site", "t", "q", *around, "context", "pos_start", "pos_end", "mate", "strand", "gc", "op"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int32()] * len(around), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    spark_kinds = ["long", "string", "long", "int", "int", *["int"] * len(around), "string", "int", "int", "int", "string", "int", "string"]

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of reads without gaps, as arrays."""
        n = batch.num_rows
        column = lambda c, default: [default if x is None else x for x in batch[c].to_pylist()] if c in batch.schema.names else [default] * n
        found = plain.observations({c: column(c, "") for c in ("template", "sequence", "quality", "clip_before", "clip_after")} | {"masked": column("masked", None)}, flank, m)
        read = pa.array(found["read"])
        start, size = batch["start"].to_numpy(), np.fromiter(map(len, batch["template"].to_pylist()), np.int64, n)
        t = found["t"].to_numpy().astype(np.int64)
        own = found["read"]
        site = start[own] + np.where(batch["reverse"].to_numpy(zero_copy_only=False)[own], size[own] - 1 - t, t)
        strand = pa.array([s or ("-" if k == 2 else "+") for s, k in zip(column("strand", None), column("mate", 1))], pa.string())
        columns = [batch["read_id"].take(read), batch["contig"].take(read), pa.array(site), found["t"], found["q"], *found["near"], found["context"], found["pos_start"], found["pos_end"], batch["mate"].take(read).cast(pa.int32()), strand.take(read), found["gc"], found["op"]]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = np.array([c == f"{len(s)}M" and len(s) == len(t) for c, s, t in zip(batch["cigar"].to_pylist(), batch["sequence"].to_pylist(), batch["template"].to_pylist())], bool)
            straight, gapped = batch.filter(pa.array(same)), batch.filter(pa.array(~same))
            for at in range(0, straight.num_rows, 500):
                yield whole(straight.slice(at, 500))
            for at in range(0, gapped.num_rows, 500):
                out = []
                for row, read in _reads(gapped.slice(at, 500)):
                    for t, q, near, *rest in walk.observations(read, flank, m, per_event):
                        out.append((row["read_id"], row["contig"], _site(row, t), t, q, *near, *rest))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(names), kinds)], names=names)

    return _input(df).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, spark_kinds)))


_OBSERVED = {"read_id": "long", "contig": "string", "site": "long", "t": "int", "context": "string", "pos_start": "int", "pos_end": "int", "mate": "int", "strand": "string", "gc": "int", "op": "string"}
_LABELS = pa.array(["=" if a == b else f"{a}>{b}" for a in "ACGT-" for b in "ACGT-"])


def _coded(points: np.ndarray) -> np.ndarray:
    return np.where(points < 256, _CODES[np.minimum(points, 255)], 4).astype(np.int64)


def _track(one: walk.Read, steps: list[tuple[str, int, int]]) -> np.ndarray | None:
    """Where `walk.track` takes the quality of each place from, among the qualities clipped before, the read's own and those clipped after."""
    own = np.full(len(one.template), -1)
    for op, t, r in steps:
        if op == "M":
            own[t] = r
    known = np.flatnonzero(own >= 0)
    if not len(known):
        return None
    own = own[known[np.minimum(np.searchsorted(known, np.arange(len(own))), len(known) - 1)]]
    before, after = len(one.clip_before), len(one.clip_after)
    return np.concatenate((np.arange(before), before + own, before + len(one.sequence) + np.arange(after)))


def _observed(batch: pa.RecordBatch, fields: list[str], flank: tuple[int, int], per_event: bool) -> pa.RecordBatch:
    """The batch's observations added up by fields. Reads of one CIGAR have the same draws, but for the bases that show, so each is walked once."""
    n = batch.num_rows
    names = ("template", "sequence", "quality", "cigar", "clip_before", "clip_after")
    texts = {c: [x or "" for x in batch[c].to_pylist()] if c in batch.schema.names else [""] * n for c in names}
    masked = batch["masked"].to_pylist() if "masked" in batch.schema.names else [None] * n
    (template, t0, t_size), (sequence, r0, r_size) = (_points(texts[c]) for c in ("template", "sequence"))
    quality, q0, q_size = _points([a + b + c for a, b, c in zip(texts["clip_before"], texts["quality"], texts["clip_after"])])
    by: dict[tuple[str, int, int], list[int]] = {}
    for k, (cigar, before, after) in enumerate(zip(texts["cigar"], texts["clip_before"], texts["clip_after"])):
        by.setdefault((cigar, len(before), len(after)), []).append(k)
    true, called = _coded(template), _coded(sequence)
    asked = {o: f for o in range(-MOST_AROUND, MOST_AROUND + 1) if (f := schema.shifted(o)) in fields}
    parts = []
    for (cigar, before, after), rows in by.items():
        one = walk.Read(*(texts[c][rows[0]] for c in names))
        own = np.array(rows)
        if not ((t_size[own] == len(one.template)) & (r_size[own] == len(one.sequence)) & (q_size[own] == before + len(one.quality) + after)).all():
            raise ValueError(f"{cigar} doesn't fit all of its reads")
        steps = list(walk.columns(one))
        track = _track(one, steps)
        if track is None:
            continue
        kept, last, gone = [], "", -2
        for k, (op, t, _) in enumerate(steps):
            again = op == "I" and last == "I" or op == "D" and gone == t - 1
            if t < len(one.template) and not (per_event and again):
                kept.append(k)
            gone, last = t if op == "D" else gone, op
        kinds, t, r = (np.array(x) for x in zip(*(steps[k] for k in kept)))
        a = true[t0[own][:, None] + t]
        b = np.where(kinds == "D", 4, called[r0[own][:, None] + np.minimum(r, len(one.sequence) - 1)])
        shown = (a < 4) & ((b < 4) | (kinds == "D"))
        for k, row in enumerate(rows):
            if masked[row]:
                shown[k] &= ~np.isin(t, masked[row])
        i, j = np.nonzero(shown)
        read, at = own[i], before + t[j]
        near = []
        for o in asked:
            there = (at + o >= 0) & (at + o < len(track))
            near.append(np.where(there, quality[q0[read] + track[np.where(there, at + o, 0)]].astype(np.int64) + 1, 0))
        parts.append((read, t[j], at, np.full(len(read), len(track)), np.where(kinds[j] == "I", 4, a[i, j]) * 5 + b[i, j], *near))
    read, t, at, size, op, *near = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.int64)] * (5 + len(asked))
    near = dict(zip(asked.values(), near))
    left, right = flank
    letters = np.unique(np.append(template, ord(".")))
    columns: list[np.ndarray] = []
    decode = []  # the number of columns that a field takes, and what makes it of them

    def add(values: list[np.ndarray], of) -> None:
        columns.extend(values)
        decode.append((len(values), of))

    def base(o: int) -> np.ndarray:
        there = (t + o >= 0) & (t + o < t_size[read])
        return np.searchsorted(letters, np.where(there, template[t0[read] + np.where(there, t + o, 0)], ord("."))) if len(t) else t

    def of_read(values: pa.Array) -> None:
        numbers, known = groups.codes(values)
        add([numbers[read]], lambda x: known.take(pa.array(x)))

    for f in fields:
        if f in near:
            add([near[f]], lambda x: pa.array((x - 34).astype(np.int32), mask=x == 0))
        elif f == "context":
            add([base(o) for o in range(-left, right + 1)], lambda *found: pa.array(["".join(map(chr, x)) for x in letters[np.stack(found, axis=1)].tolist()], pa.string()))
        elif f == "op":
            add([op], lambda x: _LABELS.take(pa.array(x)))
        elif f in ("t", "pos_start", "pos_end"):
            add([{"t": t, "pos_start": at + 1, "pos_end": size - at}[f]], lambda x: pa.array(x.astype(np.int32)))
        elif f == "site":
            start, reverse = batch["start"].to_numpy()[read], batch["reverse"].to_numpy(zero_copy_only=False).astype(bool)[read]
            site = start + np.where(reverse, t_size[read] - 1 - t, t)
            low = int(site.min()) if len(site) else 0
            add([site - low], lambda x, low=low: pa.array(x + low))
        elif f == "gc":
            share = np.bincount(np.repeat(np.arange(n), t_size)[(template == ord("G")) | (template == ord("C"))], minlength=n)
            of_read(pa.array((10 * np.minimum(9, 10 * share // np.maximum(1, t_size))).astype(np.int32)))
        elif f == "strand":
            given = batch["strand"].to_pylist() if "strand" in batch.schema.names else [None] * n
            of_read(pa.array([s or ("-" if k == 2 else "+") for s, k in zip(given, batch["mate"].to_pylist())], pa.string()))
        else:
            of_read(batch[f].cast(pa.int32()) if f == "mate" else batch[f])
    found, counts = groups.grouped(columns)
    made, k = [], 0
    for used, of_columns in decode:
        made.append(of_columns(*found[k : k + used]))
        k += used
    return pa.RecordBatch.from_arrays([*made, pa.array(counts)], names=[*fields, "n"])


#: How far from its base a quality can be asked for.
MOST_AROUND = 99


def observation_counts(df: DataFrame, fields: list[str], flank: tuple[int, int] = (2, 2), per_event: bool = False) -> DataFrame:
    """(fields, n): `observations` added up by some of their columns; what leaves a task is counts, not draws."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.chunks(batches, "template"):
            yield _observed(batch, fields, flank, per_event)

    return counted(_input(df).mapInArrow(run, ", ".join(f"`{f}` {_OBSERVED.get(f, 'int')}" for f in fields) + ", n long"), fields, "n")


def observation_table(df: DataFrame, flank: tuple[int, int] = (2, 2), m: int = 1, per_event: bool = False, extra: tuple[str, ...] = ()) -> CountTable:
    fields = ("q", *(schema.shifted(o) for o in schema.window(m)[1:]), "context", "pos_start", "pos_end", "mate", "strand", "gc", *extra, "op")
    return CountTable(observation_counts(df, list(fields), flank, per_event), fields, truth=True)


def indel_events(df: DataFrame) -> DataFrame:
    """(indel, indel_length, run, q, n)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [e for _, read in _reads(batch) for e in walk.indel_events(read)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, (pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["indel", "indel_length", "run", "q"])

    return counted(_input(df).mapInArrow(run, "indel string, indel_length int, run int, q int"), ["indel", "indel_length", "run", "q"])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where each begins, and their sizes."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.cumsum(size) - size, size


def _signs(points: np.ndarray) -> pa.Array:
    known, at = np.unique(points, return_inverse=True)
    return pa.array([chr(x) for x in known.tolist()], pa.string()).take(pa.array(at))


def _columns(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Columns of a batch's reads. Reads of one CIGAR have the same operations and places, so each is walked once."""
    texts = {c: [x or "" for x in batch[c].to_pylist()] for c in ("template", "sequence", "quality", "cigar")}
    (template, t0, t_size), (sequence, r0, r_size), (quality, _, q_size) = (_points(texts[c]) for c in ("template", "sequence", "quality"))
    by: dict[str, list[int]] = {}
    for k, cigar in enumerate(texts["cigar"]):
        by.setdefault(cigar, []).append(k)
    parts = []
    for cigar, rows in by.items():
        one = walk.Read(texts["template"][rows[0]], texts["sequence"][rows[0]], texts["quality"][rows[0]], cigar)
        own = np.array(rows)
        fits = (t_size[own] == t_size[own[0]]) & (r_size[own] == r_size[own[0]]) & (q_size[own] == r_size[own[0]])
        if not fits.all():
            raise ValueError(f"{cigar} doesn't fit all of its reads")
        steps = list(walk.columns(one))
        if not steps:
            continue
        if not one.sequence:
            raise ValueError(f"{cigar} has no read base")
        op, t, r = np.array([ord(x[0]) for x in steps]), np.array([x[1] for x in steps]), np.array([x[2] for x in steps])
        at = np.minimum(r, len(one.sequence) - 1)
        ref = np.where(op == ord("I"), ord("-"), template[np.minimum(t0[own][:, None] + t, max(len(template) - 1, 0))] if len(template) else ord("-"))
        alt = np.where(op == ord("D"), ord("-"), sequence[r0[own][:, None] + at])
        wide = lambda x: np.broadcast_to(x, (len(own), len(steps))).ravel()
        parts.append((wide(own[:, None]), wide(op), wide(at + 1), quality[r0[own][:, None] + at].ravel().astype(np.int64) - 33, ref.ravel(), alt.ravel()))
    read, op, pos, q, ref, alt = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 6
    read = pa.array(read.astype(np.int64))
    return pa.RecordBatch.from_arrays([batch["read_id"].take(read), batch["mate"].take(read).cast(pa.int32()), _signs(op), pa.array(pos.astype(np.int32)), pa.array(q.astype(np.int32)), _signs(ref), _signs(alt)], names=list(_COLUMN_SCHEMA))


_COLUMN_SCHEMA = {"read_id": "long", "mate": "int", "op": "string", "pos": "int", "q": "int", "ref": "string", "alt": "string"}


def columns(df: DataFrame) -> DataFrame:
    """One row of each alignment column: read_id, mate, op (M, I, D), pos, q, ref, alt. A deletion has the read base after it, or the last one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield _columns(batch.slice(at, 500))

    return _input(df).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in _COLUMN_SCHEMA.items()))


def column_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(fields, n): `columns` added up by some of them; what leaves a batch is one row of each different one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([_columns(batch)]).group_by(fields).aggregate([([], "count_all")])
            yield from found.select([*fields, "count_all"]).rename_columns([*fields, "n"]).combine_chunks().to_batches()

    kinds = ", ".join(f"{f} {_COLUMN_SCHEMA[f]}" for f in fields)
    return counted(_input(df).mapInArrow(run, f"{kinds}, n long"), fields, "n")


_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)
_ALLELES = pa.array(["A", "C", "G", "T"])


def _counted_plain(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Alleles of reads without gaps, added up: all bases of the rows in a few array passes."""
    signs, size = groups.points(batch["sequence"])
    read = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(signs)) - np.repeat(np.cumsum(size) - size, size)
    code = np.where(signs < 256, _CODES[np.minimum(signs, 255)], 4).astype(np.int64)
    reverse = batch["reverse"].to_numpy(zero_copy_only=False).astype(bool)[read]
    site = batch["start"].to_numpy()[read] + np.where(reverse, size[read] - 1 - place, place)
    contig, names = groups.codes(batch["contig"])
    low, known = int(site.min()), code < 4
    (contig, site, code), n = groups.grouped([contig[read][known], (site - low)[known], np.where(reverse, 3 - code, code)[known]])
    return pa.RecordBatch.from_arrays([names.take(pa.array(contig)), pa.array(site + low), _ALLELES.take(pa.array(code)), pa.array(n)], names=["contig", "site", "allele", "n"])


def _plain(batch: pa.RecordBatch) -> np.ndarray:
    """Which alignments are one run of M that fits its template, read and qualities, so that no walk is needed."""
    size = pc.utf8_length(batch["sequence"])
    fits = pc.equal(batch["cigar"], pc.binary_join_element_wise(size.cast(pa.string()), "M", ""))
    for other in ("template", "quality"):
        fits = pc.and_(fits, pc.equal(pc.utf8_length(batch[other]), size))
    return pc.and_(fits, pc.greater(size, 0)).fill_null(False).to_numpy(zero_copy_only=False)


def _walked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in groups.chunks(batches, "sequence"):
        plain = _plain(batch)
        if plain.any():
            yield _counted_plain(batch.filter(pa.array(plain)))
        found: Counter[tuple[str, int, str]] = Counter()
        for row, read in _reads(batch.filter(pa.array(~plain))):
            seen_gap = None
            for op, t, r in walk.columns(read):
                site = _site(row, t)
                if op == "I":
                    gap = site + 1 if row["reverse"] else site
                    if gap != seen_gap:
                        found[row["contig"], gap, "ins"] += 1
                    seen_gap = gap
                else:
                    base = "del" if op == "D" else walk.revcomp(read.sequence[r]) if row["reverse"] else read.sequence[r]
                    if base in ("A", "C", "G", "T", "del"):
                        found[row["contig"], site, base] += 1
        columns = [*zip(*found)] or [()] * 3
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string()))), pa.array(found.values(), pa.int64())], names=["contig", "site", "allele", "n"])


def pileup(df: DataFrame) -> DataFrame:
    """(contig, site, allele, n) in the contig's direction: A, C, G, T, del, and ins for an insertion before the site.

    Reads without gaps are added up as arrays, the others walked; what leaves a batch is one row an allele of a site.
    """
    return counted(_input(df).mapInArrow(_walked, "contig string, site long, allele string, n long"), ["contig", "site", "allele"], "n")


def sites(piled: DataFrame) -> DataFrame:
    """(contig, site, depth, top_alt): depth of the five alleles, and the count of the second of them."""
    each = [F.coalesce(F.sum(F.when(F.col("allele") == x, F.col("n"))), F.lit(0)).alias(x) for x in ("A", "C", "G", "T", "del", "ins")]
    own = piled.groupBy("contig", "site").agg(*each).withColumn("five", F.sort_array(F.array("A", "C", "G", "T", "del"), asc=False))
    depth = F.aggregate("five", F.lit(0).cast("long"), lambda a, x: a + x)
    return own.select("contig", "site", depth.alias("depth"), F.greatest(F.get("five", F.lit(1)), F.col("ins")).alias("top_alt")).filter("depth > 0")


def site_masks(at: DataFrame, freq: float = 0.1, least: int = 2) -> DataFrame:
    """(contig, site) where the second allele has `least` reads and a share of the depth."""
    return at.filter((F.col("top_alt") >= least) & (F.col("top_alt") >= freq * F.col("depth"))).select("contig", "site")


def contig_report(at: DataFrame, freq: float = 0.1, least: int = 2, min_depth: float = 5.0) -> DataFrame:
    """(contig, sites, mean_depth, masked, kept)."""
    masked = (F.col("top_alt") >= least) & (F.col("top_alt") >= freq * F.col("depth"))
    out = at.groupBy("contig").agg(F.count(F.lit(1)).alias("sites"), F.avg("depth").alias("mean_depth"), F.sum(masked.cast("long")).alias("masked"))
    return out.withColumn("kept", F.col("mean_depth") >= min_depth)


def unmasked(rows: DataFrame, masks: DataFrame, kept: DataFrame) -> DataFrame:
    """Observations of kept contigs at sites that aren't masked; after the walk this is an equi-join, no range join."""
    return rows.join(kept.select("contig"), "contig", "left_semi").join(masks, ["contig", "site"], "left_anti")


def linked(rows: DataFrame, min_pairs: int = 3) -> DataFrame:
    """(contig, site_a, allele_a, site_b, allele_b, n): substitutions that `min_pairs` reads have together.

    rows: observations with read_id, contig, site and allele of substitutions only. The join is within a read.
    """
    a = rows.select("read_id", "contig", F.col("site").alias("site_a"), F.col("allele").alias("allele_a"))
    b = rows.select("read_id", "contig", F.col("site").alias("site_b"), F.col("allele").alias("allele_b"))
    both = a.join(b, ["read_id", "contig"]).filter("site_a < site_b")
    return both.groupBy("contig", "site_a", "allele_a", "site_b", "allele_b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pairs)


_LINK = ("contig", "site_a", "allele_a", "site_b", "allele_b")


def linked_reads(reads: DataFrame, min_pairs: int = 3) -> DataFrame:
    """`linked` of reads without gaps: read_id, contig, start, template and seq, forward. What is shuffled is a row a read, not one
    a pair of sites; rows of one read_id and contig are one read.
    """
    own = reads.filter("read_id is not null and contig is not null and start is not null and length(template) > 0")
    own = own.select("read_id", "contig", "start", F.upper("template").alias("template"), F.upper("seq").alias("seq"))

    def edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.chunks(batches, "template"):
            (true, size), (called, other) = groups.points(batch["template"]), groups.points(batch["seq"])
            if (other != size).any():
                raise ValueError("a read and its template differ in length")
            true, called = (np.where(x < 256, _CODES[np.minimum(x, 255)], 4).astype(np.int64) for x in (true, called))
            at = np.flatnonzero((true < 4) & (called < 4) & (true != called))
            read = np.repeat(np.arange(len(size)), size)[at]
            site = batch["start"].to_numpy()[read] + at - (np.cumsum(size) - size)[read]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(read, minlength=len(size))))).astype(np.int32)
            edited = pa.ListArray.from_arrays(pa.array(offsets), pa.array(site * 4 + called[at]))
            made = pa.RecordBatch.from_arrays([batch["read_id"], batch["contig"], edited], names=["read_id", "contig", "edits"])
            yield made.filter(pa.array(np.diff(offsets) > 0))

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = np.repeat(np.arange(batch.num_rows), batch["edits"].value_lengths().to_numpy(zero_copy_only=False))
            edit = batch["edits"].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            low = int(edit.min() // 4 * 4) if len(edit) else 0
            (read, edit), times = groups.grouped([read, edit - low])  # in order of read and site
            left, step = [], 1
            while len(i := np.flatnonzero(read[:-step] == read[step:])):  # edits so many places apart in one read
                left.append((i[edit[i] // 4 < edit[i + step] // 4], step))
                step += 1
            a = np.concatenate([i for i, _ in left]) if left else np.zeros(0, np.int64)
            b = np.concatenate([i + k for i, k in left]) if left else a
            contig, names = groups.codes(batch["contig"])
            (contig, x, y, each), n = groups.grouped([contig[read[a]], edit[a], edit[b], times[a] * times[b]])
            columns = [names.take(pa.array(contig)), pa.array((x + low) // 4), _ALLELES.take(pa.array(x % 4)), pa.array((y + low) // 4), _ALLELES.take(pa.array(y % 4)), pa.array(n * each)]
            yield pa.RecordBatch.from_arrays(columns, names=[*_LINK, "n"])

    found = own.mapInArrow(edits, "read_id long, contig string, edits array<long>").groupBy("read_id", "contig").agg(F.flatten(F.collect_list("edits")).alias("edits"))
    both = found.filter(F.size("edits") > 1).select("contig", "edits").mapInArrow(pairs, "contig string, site_a long, allele_a string, site_b long, allele_b string, n long")
    return counted(both, list(_LINK), "n").filter(F.col("n") >= min_pairs)


def single_copy(at: DataFrame, min_depth: int = 5, ratio: float = 2.0) -> DataFrame:
    """(contig, site, low, copies): sites that are too shallow, or off the contig's median depth by more than a ratio."""
    median = at.groupBy("contig").agg(F.median("depth").alias("median"))
    flagged = at.join(median, "contig").select("contig", "site", (F.col("depth") < min_depth).alias("low"), ((F.col("depth") > ratio * F.col("median")) | (F.col("depth") < F.col("median") / ratio)).alias("copies"))
    return flagged.filter("low or copies")


def conservative(at: DataFrame, links: DataFrame, min_depth: int = 5, ratio: float = 2.0) -> DataFrame:
    """(contig, site, reason): sites to leave out, each with the first reason that holds: low, copies, linked."""
    alone = single_copy(at, min_depth, ratio)
    ends = links.select("contig", F.col("site_a").alias("site")).unionByName(links.select("contig", F.col("site_b").alias("site"))).distinct().withColumn("linked", F.lit(True))
    out = alone.join(ends, ["contig", "site"], "full")
    reason = F.when(F.col("low"), "low").when(F.col("copies"), "copies").otherwise("linked")
    return out.select("contig", "site", reason.alias("reason"))
