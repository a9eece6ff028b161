"""Column functions of sequences, positions and qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; only A, C, G and T are complemented."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def gc_bin(seq: Column) -> Column:
    """The lower bound of a sequence's ten per cent GC bin; 90 also holds 100, an empty sequence is in bin 0."""
    gc = F.length(F.regexp_replace(seq, "[^GCgc]", ""))
    return (10 * F.least(F.lit(9), F.floor(10 * gc / F.greatest(F.length(seq), F.lit(1))))).cast("int")


def context(seq: Column, pos: Column, left: int, right: int) -> Column:
    """Bases around 1-based pos, `.` beyond the ends."""
    return F.substring(F.concat(F.lit("." * left), seq, F.lit("." * right)), pos, F.lit(left + right + 1))


def parse_tile(name: Column) -> Column:
    """`lane_tile` of a read name of five or seven colon-separated parts; null unless both are digits."""
    parts = F.split(F.element_at(F.split(name, " "), 1), ":")
    at = F.when(F.size(parts) == 7, 4).when(F.size(parts) == 5, 2)
    lane, tile = F.get(parts, at - 1), F.get(parts, at)
    return F.when(lane.rlike(r"^\d+$") & tile.rlike(r"^\d+$"), F.concat_ws("_", lane, tile))


def phred(rate: Column) -> Column:
    return -10 * F.log10(rate)


def op_class(op: Column) -> Column:
    """match, ins, del or sub."""
    return F.when(op == "=", "match").when(op.startswith("-"), "ins").when(op.endswith("-"), "del").otherwise("sub")


def category(op: Column) -> Column:
    """Place of a label among schema.CATEGORIES."""
    to = F.element_at(F.split(op, ">"), -1)
    base = F.instr(F.lit("ACGT"), to)
    return F.when(op == "=", 0).when(op.startswith("-"), 4 + base).when(op.endswith("-"), 9).otherwise(base)


def one_edit(a: Column, b: Column, v: Column) -> Column:
    """Whether values of v bases differ by one substitution, or by one base put in or left out with the rest shifted."""
    head = lambda s, n: F.substring(s, F.lit(1), n)
    tail = lambda s, n: F.substring(s, n, v)
    places = F.sequence(F.lit(0), v - 1)

    def fits(i: Column) -> Column:
        same = head(a, i) == head(b, i)
        swap = tail(a, i + 2) == tail(b, i + 2)
        lost = F.substring(a, i + 2, v - i - 1) == F.substring(b, i + 1, v - i - 1)
        gained = F.substring(a, i + 1, v - i - 1) == F.substring(b, i + 2, v - i - 1)
        return same & (swap | lost | gained)

    return (a != b) & F.exists(places, fits)


def total_variation(a: Column, b: Column) -> Column:
    """Aggregate: half the summed distance of shares."""
    return F.sum(F.abs(a - b)) / 2


def edit_label(a: Column, b: Column, v: int) -> Column:
    """The edit that makes value a of value b, one edit away: a substitution, else the first place where a base was left out of
    b (the rest moved up, so a's last base is new) or put into it. Values of v bases."""
    base = lambda s, i: F.substring(s, i, F.lit(1))
    places = F.sequence(F.lit(1), F.lit(v))
    differ = F.filter(places, lambda i: base(a, i) != base(b, i))
    same = lambda i: F.substring(a, F.lit(1), i - 1) == F.substring(b, F.lit(1), i - 1)
    lost = F.filter(places, lambda i: same(i) & (F.substring(a, i, F.lit(v) - i) == F.substring(b, i + 1, F.lit(v) - i)))
    put_in = F.filter(places, lambda i: same(i) & (F.substring(a, i + 1, F.lit(v) - i) == F.substring(b, i, F.lit(v) - i)))
    at = lambda found: F.get(found, F.lit(0))
    return (
        F.when(F.size(differ) == 1, F.concat(base(b, at(differ)), F.lit(">"), base(a, at(differ))))
        .when(F.size(lost) > 0, F.concat(base(b, at(lost)), F.lit(">-")))
        .when(F.size(put_in) > 0, F.concat(F.lit("->"), base(a, at(put_in))))
    )


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def divergence(a: Column, b: Column) -> Column:
    """Aggregate: Kullback-Leibler divergence of shares a from b, in nats; shares of 0 in a add nothing, in b alone infinity."""
    return F.sum(F.when(a == 0, F.lit(0.0)).when(b == 0, F.lit(float("inf"))).otherwise(a * F.log(a / b)))


def gc_ten(lo: Column, hi: Column) -> Column:
    """The lower bound of the ten per cent bin that a GC bin [lo, hi) lies in; one that crosses a boundary raises."""
    own = F.floor(lo / 10)
    crossing = F.raise_error(F.concat(F.lit("GC bin crosses ten per cent at "), lo.cast("string"))).cast("int")
    return F.when(own == F.floor((hi - 1) / 10), (10 * own).cast("int")).otherwise(crossing)


def error_context(context: Column, op: Column, left: int) -> Column:
    """Previous base, centre, next base of an error whose context has `left` bases before the centre; an insertion's centre is
    `-`, and the base it stands before comes last."""
    around = F.substring(context, left, 3)
    return F.when(op.startswith("-"), F.concat(F.substring(context, left, 1), F.lit("-"), F.substring(context, left + 1, 1))).otherwise(around)


def truth_label(op: Column, template: Column, consensus: Column) -> Column:
    """What a read base is: error (not its molecule's), adapter (no consensus there), variant (the molecule's own) or match.
    Deletions have no read base: null."""
    return F.when(op.endswith("-"), None).when(op != "=", "error").when(consensus == ".", "adapter").when(F.upper(template) != consensus, "variant").otherwise("match")


def numbers_first(c: Column) -> list[Column]:
    """Sort keys that order texts that are numbers as numbers, before others by name."""
    return [c.try_cast("double").asc_nulls_last(), c.asc()]
