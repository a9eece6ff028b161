"""Tables that read simulators take: aggregated in Spark, formatted by whoever writes the file."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import groups, walk
from ..operators.alignments import _input, _reads
from ..operators.kmers import _windows
from ..table import counted


def art_profile(rows: DataFrame, top: int = 41) -> DataFrame:
    """(symbol, pos, q, cumulative): running counts of qualities by base and position, with `.` for all bases; qualities capped."""
    own = rows.select(F.col("base").alias("symbol"), F.col("pos_start").alias("pos"), F.least("q", F.lit(top)).alias("q"))
    every = counted(own, ["symbol", "pos", "q"])
    both = every.unionByName(counted(own.withColumn("symbol", F.lit(".")), ["symbol", "pos", "q"]))
    return both.select("symbol", "pos", "q", F.sum("n").over(Window.partitionBy("symbol", "pos").orderBy("q")).alias("cumulative"))


def art_text(profile: DataFrame) -> str:
    """The profile file: for each symbol and position a line of qualities and one of cumulative counts."""
    lines = []
    by = profile.groupBy("symbol", "pos").agg(F.sort_array(F.collect_list(F.struct("q", "cumulative"))).alias("c")).orderBy("symbol", "pos")
    for r in by.collect():
        lines += [f"{r.symbol}\t{r.pos - 1}\t" + "\t".join(str(x.q) for x in r.c), f"{r.symbol}\t{r.pos - 1}\t" + "\t".join(str(x.cumulative) for x in r.c)]
    return "\n".join(lines) + "\n"


def read_art(text: str) -> dict[int, dict[int, float]]:
    """position -> quality -> probability, of the `.` block of a profile file."""
    out: dict[int, dict[int, float]] = {}
    values: list[int] = []
    for line in text.splitlines():
        symbol, pos, *rest = line.split()
        if symbol != ".":
            continue
        if int(pos) not in out:
            values, out[int(pos)] = [int(x) for x in rest], {}
        else:
            counts = [0, *map(int, rest)]
            out[int(pos)] = {q: (b - a) / counts[-1] for q, a, b in zip(values, counts, counts[1:])}
    return out


def mean_quality_cdf(reads: DataFrame, bins: int = 4, top: int = 40) -> DataFrame:
    """(bin, pos, q, cdf): quality distribution by position for reads in bins of their mean quality, which is taken within the read.

    Places are added up within the tasks. A place without a quality counts for nothing, and neither does a read without any.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.chunks(batches, "q"):
            size = batch["q"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            read = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(read)) - (np.cumsum(size) - size)[read]
            values = batch["q"].flatten()
            known = ~values.is_null().to_numpy(zero_copy_only=False)
            q, read, pos = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[known], read[known], pos[known]
            mean = np.bincount(read, q, len(size)) / np.maximum(1, np.bincount(read, minlength=len(size)))
            low = int(q.min()) if len(q) else 0
            bin_ = np.floor(np.minimum(bins - 1, mean / (top / bins))).astype(np.int64)
            first = int(bin_.min())
            (b, p, q), n = groups.grouped([(bin_ - first)[read], pos, np.minimum(q, top) - min(low, top)])
            columns = [b + first, p + 1, q + min(low, top)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(n)], names=["bin", "pos", "q", "n"])

    n = counted(reads.filter(F.size("q") > 0).select(F.col("q").cast("array<int>").alias("q")).mapInArrow(run, "bin int, pos int, q int, n long"), ["bin", "pos", "q"], "n")
    order = Window.partitionBy("bin", "pos")
    return n.select("bin", "pos", "q", (F.sum("n").over(order.orderBy("q")) / F.sum("n").over(order)).alias("cdf"))


def kmer_alternatives(pairs: DataFrame, k: int = 7, keep: int = 25) -> DataFrame:
    """(kmer, alternative, n, rank): what k-mers of the template were read as, the `keep` most frequent ones with the same end bases.

    pairs: template and read of equal length (substitutions only). The cap is the format's.
    """
    both = F.arrays_zip(_windows(F.col("template"), k).alias("kmer"), _windows(F.col("seq"), k).alias("alternative"))
    each = pairs.select(F.explode(both).alias("x")).select("x.kmer", "x.alternative")
    ends = (F.substring("kmer", 1, 1) == F.substring("alternative", 1, 1)) & (F.substring("kmer", k, 1) == F.substring("alternative", k, 1))
    n = counted(each.filter(ends), ["kmer", "alternative"])
    order = Window.partitionBy("kmer").orderBy(F.desc("n"), "alternative")
    return n.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def chain(reads: DataFrame) -> DataFrame:
    """(state, following, n, share): transitions between a base's quality and the next one's, paired within the read."""
    each = reads.filter(F.size("q") > 1).select("q", F.explode(F.sequence(F.lit(1), F.size("q") - 1)).alias("i"))
    n = counted(each.select(F.get("q", F.col("i") - 1).alias("state"), F.get("q", F.col("i")).alias("following")), ["state", "following"])
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def difference_ratio(rows: DataFrame) -> DataFrame:
    """One row: substitutions, insertions and deletions as parts of all edits."""
    part = lambda c: F.try_divide(F.sum(F.when(c, F.col("n")).otherwise(0)), F.sum(F.when(F.col("op") != "=", F.col("n")).otherwise(0)))
    op = F.col("op")
    return rows.agg(part((op != "=") & ~op.contains("-")).alias("sub"), part(op.startswith("-")).alias("ins"), part(op.endswith("-")).alias("del"))


def remap(rows: DataFrame, top: int = 41) -> DataFrame:
    """(q, remapped): the quality that an observed error rate stands for, shrunk to the pooled one by its own weight of one error."""
    by = rows.groupBy("q").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("op") != "=", F.col("n")).otherwise(0)).alias("e"))
    pooled = F.sum("e").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
    rate = (F.col("e") + 1) / (F.col("n") + 1 / pooled)
    return by.select("q", F.least(F.lit(top), F.greatest(F.lit(1), F.round(-10 * F.log10(rate)))).cast("int").alias("remapped"))


# Tables over the column strings of alignments: = match, X substitution, I insertion, D deletion ------------------------


def column_strings(df: DataFrame) -> DataFrame:
    """(read_id, ops, q): each alignment's columns as a string, and the qualities of its read bases."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(row["read_id"], walk.gapped(read)[2], [ord(c) - 33 for c in read.quality]) for row, read in _reads(batch)]
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*own)) or [()] * 3, kinds)], names=["read_id", "ops", "q"])

    return _input(df).mapInArrow(run, "read_id long, ops string, q array<int>")


def qscore_model(strings: DataFrame, widest: int = 9, deletions: int = 6, least: int = 100, most: int = 10_000) -> DataFrame:
    """(cigar, q, n): qualities of the middle base of every odd window of read bases, by the window's columns.

    strings: ops and q of column_strings. Longer runs of deletions count as `deletions`. `overall` has every base. Windows of more
    than one column seen fewer than `least` times go, and of the rest the `most` frequent stay, by name among equals, and the three
    single columns in any case; these limits are the format's. Reads without bases add nothing.
    """
    own = strings.filter(F.length("ops") > 0).select("ops", F.col("q").cast("array<int>").alias("q"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups.chunks(batches, "ops"):
            signs, size = groups.points(batch["ops"])
            letters, code = np.unique(signs, return_inverse=True)
            at = np.flatnonzero(signs != ord("D"))
            row = np.repeat(np.arange(len(size)), size)[at]
            first = np.cumsum(np.bincount(row, minlength=len(size)))  # read bases up to each read's end
            gap = np.minimum(np.diff(at) - 1, deletions)
            for k in range(1, widest + 1, 2):
                j = np.flatnonzero(row[: max(0, len(row) - k + 1)] == row[k - 1 :])
                before = j - np.concatenate(([0], first))[row[j]]
                q, low = groups.values_at(batch["q"], row[j], before + k // 2)
                gaps = [i for i in range(k - 1) if gap[j + i].any()]
                columns, n = groups.grouped([q, *(code[at[j + i]] for i in range(k)), *(gap[j + i] for i in gaps)])
                number, shown, runs = columns[0], columns[1 : k + 1], dict(zip(gaps, columns[k + 1 :]))
                cigar = ["".join(chr(letters[shown[i][r]]) + "D" * int(runs[i][r] if i in runs else 0) for i in range(k)) for r in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(cigar, pa.string()), pa.array((number + low).astype(np.int32), mask=number == 0), pa.array(n)], names=["cigar", "q", "n"])

    n = counted(own.mapInArrow(run, "cigar string, q int, n long"), ["cigar", "q"], "n")
    single = F.length("cigar") == 1
    totals = n.groupBy("cigar").agg(F.sum("n").alias("total"))
    ranked = totals.filter(single | (F.col("total") >= least)).orderBy(F.desc("total"), "cigar").limit(most).select("cigar", F.lit(True).alias("kept"))
    names = F.when(single, F.array("cigar", F.lit("overall"))).otherwise(F.array("cigar"))
    kept = n.join(ranked, "cigar", "left").filter(single | F.col("kept"))
    return counted(kept.select(F.explode(names).alias("cigar"), "q", "n"), ["cigar", "q"], "n")


def identities(strings: DataFrame) -> DataFrame:
    """(read_id, identity): the share of matches among an alignment's columns; 0 where it has none."""
    same = F.length(F.regexp_replace("ops", "[^=]", ""))
    return strings.select("read_id", (same / F.greatest(F.length("ops"), F.lit(1))).alias("identity"))


def steps(tracks: DataFrame, states: str) -> DataFrame:
    """(state, following, n): each place of the reads' state arrays with the one before it, which is null at a read's start."""
    each = tracks.filter(F.size(states) > 0).select(states, F.explode(F.sequence(F.lit(1), F.size(states))).alias("i"))
    return counted(each.select(F.get(states, F.col("i") - 2).alias("state"), F.get(states, F.col("i") - 1).alias("following")), ["state", "following"])


def _chained(moves: DataFrame, states: DataFrame) -> DataFrame:
    """(kind, state, target, p): IP, shares of first states (no target), and TP, of those that follow; a state that nothing
    follows has the shares of all places. At most as many rows as pairs of states."""
    start = moves.filter("state is null").groupBy(F.col("following").alias("state")).agg(F.sum("n").alias("n"))
    first = start.select(F.lit("IP").alias("kind"), "state", F.lit(None).cast("int").alias("target"), (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("p"))
    seen = moves.filter("state is not null").groupBy("state", F.col("following").alias("target")).agg(F.sum("n").alias("n"))
    places = moves.groupBy(F.col("following").alias("target")).agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("target", "n")).alias("all"))
    unseen = states.join(seen, "state", "left_anti").select("state", F.explode(places.scalar()).alias("x")).select("state", "x.target", "x.n")
    share = F.col("n") / F.sum("n").over(Window.partitionBy("state"))
    return first.unionByName(seen.unionByName(unseen).select(F.lit("TP").alias("kind"), "state", "target", share.alias("p")))


def quality_hmm(reads: DataFrame, most: int = 50) -> DataFrame:
    """(kind, state, target, p): a chain whose states are runs of neighbouring qualities, at most `most` and of sizes that differ
    by one at most, the larger first. EP has the shares of a state's qualities (target). reads: q arrays."""
    moves = steps(reads, "q")
    values = moves.groupBy(F.col("following").alias("q")).agg(F.sum("n").alias("n"))  # no more rows than there are qualities
    total = F.count(F.lit(1)).over(Window.partitionBy())
    groups = F.least(total, F.lit(most))
    size, larger = F.floor(total / groups), total % groups
    rank = F.row_number().over(Window.orderBy("q")) - 1
    placed = values.select("q", "n", rank.alias("rank"), size.alias("size"), larger.alias("larger"))
    cut = F.col("larger") * (F.col("size") + 1)
    state = F.when(F.col("rank") < cut, F.floor(F.col("rank") / (F.col("size") + 1))).otherwise(F.col("larger") + F.floor((F.col("rank") - cut) / F.col("size")))
    of = placed.select("q", "n", state.cast("int").alias("s"))
    lower = of.select(F.col("q").alias("state"), F.col("s").alias("from"))
    upper = of.select(F.col("q").alias("following"), F.col("s").alias("to"))
    grouped = moves.join(lower, "state", "left").join(upper, "following").groupBy(F.col("from").alias("state"), F.col("to").alias("following")).agg(F.sum("n").alias("n"))
    emitted = of.select(F.lit("EP").alias("kind"), F.col("s").alias("state"), F.col("q").cast("int").alias("target"), (F.col("n") / F.sum("n").over(Window.partitionBy("s"))).alias("p"))
    return _chained(grouped, of.select(F.col("s").alias("state")).distinct()).unionByName(emitted)


def error_hmm(strings: DataFrame) -> DataFrame:
    """(kind, state, target, p): a chain of columns, 0 match, 1 substitution, 2 insertion, 3 deletion; each state emits itself."""
    # Columns are counted in twos as they are, a read's first behind a blank; only the few different ones become states.
    each = strings.filter(F.length("ops") > 0).select(F.concat(F.lit(" "), "ops").alias("ops"), F.explode(F.sequence(F.lit(1), F.length("ops"))).alias("i"))
    twos = counted(each.select(F.substring("ops", F.col("i"), F.lit(2)).alias("two")), ["two"])
    code = lambda i: F.instr(F.lit("=XID"), F.substring("two", i, 1)) - 1
    moves = twos.select(F.when(F.substring("two", 1, 1) != " ", code(1)).alias("state"), code(2).alias("following"), "n")
    own = strings.sparkSession.range(4).select(F.col("id").cast("int").alias("state"))
    return _chained(moves, own).unionByName(own.select(F.lit("EP").alias("kind"), "state", F.col("state").alias("target"), F.lit(1.0).alias("p")))


def hmm_text(model: DataFrame, levels: Iterable[int] = range(1, 101)) -> str:
    """The model's lines, whole rows with their zeros, once for each accuracy level."""
    rows = model.collect()  # no more than most * 94 + most * most rows
    n = 1 + max((r.state for r in rows), default=-1)
    width = {"EP": 1 + max((r.target for r in rows if r.kind == "EP"), default=-1), "TP": n}
    p = {(r.kind, r.state, r.target): r.p for r in rows}
    lines = [f"IP {i + 1} {p.get(('IP', i, None), 0.0):.6e}" for i in range(n)]
    for kind in ("EP", "TP"):
        lines += [f"{kind} {i + 1} " + " ".join(f"{p.get((kind, i, j), 0.0):.6e}" for j in range(width[kind])) for i in range(n)]
    return "".join(f"{level} {line}\n" for level in levels for line in lines)


def mate_tables(columns: DataFrame) -> DataFrame:
    """(kind, mate, pos, base, alt, p): what a template base is read as when substituted (sub, shares), and rates of an insertion
    behind a place per base of any kind there (ins), and of a deletion per such base there (del).

    columns: mate, op (M, I, D), pos, ref, alt and n, alignment columns added up. Bases other than A, C, G and T are left out.
    """
    known = F.col("base").isin(*"ACGT")
    at = columns.filter("op <> 'I'").groupBy("mate", "pos", F.col("ref").alias("base")).agg(F.sum("n").alias("there"))
    place = at.filter(known).groupBy("mate", "pos").agg(F.sum("there").alias("there"))
    none = F.lit(None).cast("string")
    sub = columns.filter("op = 'M' and ref <> alt").groupBy("mate", "pos", F.col("ref").alias("base"), "alt").agg(F.sum("n").alias("n")).filter(known & F.col("alt").isin(*"ACGT"))
    subs = sub.select(F.lit("sub").alias("kind"), "mate", "pos", "base", "alt", (F.col("n") / F.sum("n").over(Window.partitionBy("mate", "pos", "base"))).alias("p"))
    put = columns.filter("op = 'I'").groupBy("mate", F.greatest(F.col("pos") - 1, F.lit(1)).alias("pos"), F.col("alt").alias("base")).agg(F.sum("n").alias("n"))
    ins = put.filter(known).join(place, ["mate", "pos"]).select(F.lit("ins").alias("kind"), "mate", "pos", "base", none.alias("alt"), (F.col("n") / F.col("there")).alias("p"))
    gone = columns.filter("op = 'D'").groupBy("mate", "pos", F.col("ref").alias("base")).agg(F.sum("n").alias("n"))
    dels = gone.filter(known).join(at, ["mate", "pos", "base"]).select(F.lit("del").alias("kind"), "mate", "pos", "base", none.alias("alt"), (F.col("n") / F.col("there")).alias("p"))
    return subs.unionByName(ins).unionByName(dels)
