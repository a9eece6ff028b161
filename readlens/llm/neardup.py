"""Near-duplicate texts by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles (runs of five words). Two texts are linked if their alignment similarity,
LCS / (n + m - LCS) over the shingle sequences, is 0.8 or more; for texts without repeated shingles in common order that
is the Jaccard similarity, and one less it is a metric. Classes are the connected components of the links.

Sketch: for each of BANDS hash functions the PICKS smallest occurrence-labelled shingles, kept in text order. Equal
sketches of a band are a bucket. Equal texts are joined before, so buckets hold different texts only.

In a bucket all texts are compared with one centre. Those that aren't linked to it stay, together with the centre's own
texts where the triangle inequality leaves a link between the two possible. What stays (texts that share a passage, say)
is dealt anew by an exact filter: of two linked texts the rarest fifth of the shingles, in any one order of rarity, have
one in common. In the bucket of the rarest one that both have, what is rarer in either the other lacks, so the smaller of
the two has it among its rarest ninth. A text is a centre only in buckets where that holds of itself, and is compared only
with texts of other classes whose size and place leave enough in common: a passage that fills too little of every text to
link them makes no pair, however many texts share it. Before texts meet as pairs, parities of the numbers of their shingles in
each of 512 bins are compared: bins that differ are no more than the shingles that only one of the two has, so no link is
lost, and of texts that share much but too little hardly a pair is left. Centres go in three turns (one a bucket, some sixteen, all), classes
are joined between them, and no bucket is capped.

Keys that hold much of a table (a bucket of thousands of copies, say) are at most HOT in number; what belongs to them is
sent to every task that has their rows, which aren't shuffled then. All other joins are told to merge: the many small tables
of the turns would else be gathered by the driver, to be broadcast. Members meet the centres of a large bucket in runs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from ..session import Stages, unused
from .rows import ROW, row_hashes, typed

BANDS, PICKS = 24, 3
#: Texts with fewer shingles can't be linked to a different text: 3 of 4 are less than 0.8.
LEAST = 4
#: Counters of the table that orders shingles by rarity; shared counters only make some look more frequent.
COUNTERS = 1 << 20
#: A key is hot from this share of all rows on, so there are so many hot keys at most.
HOT = 1000
#: Members of a bucket, or texts compared with one centre, that meet in one run at least.
RUN = 200
#: Columns of 64 parities each, bins of a text's shingles.
PARITIES = [f"parity_{i}" for i in range(8)]
#: Centres that a bucket has by turn; the last turn has all that are left.
TURNS = (1, 16, None)
_FACTORS = textvec.mix(np.arange(101, 101 + BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _labelled(own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Shingles made distinct within their text: the n-th occurrence of one is labelled n."""
    same = textvec.mix(own + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(same, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = same[order[1:]] != same[order[:-1]]
    nth = np.empty(len(order), np.uint64)
    nth[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return textvec.mix(own + nth * np.uint64(0xA24BAED4963EE407))


def sketches(own: np.ndarray, offsets: np.ndarray, bands: int = BANDS, picks: int = PICKS) -> np.ndarray:
    """Order MinHash of each text, (texts, bands); of a text of fewer than `picks` shingles all are picked."""
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    labelled = _labelled(own, text)
    # Only values under a limit that some more of a text's fall under than are picked get sorted; a text with too few of them is sorted whole.
    some = 3 * picks + 7
    limit = np.where(counts > 2 * some, 2.0**64 * some / np.maximum(counts, 1), 1.8e19).astype(np.uint64)
    wanted = np.minimum(counts, picks)
    by_place = np.repeat(limit, counts)
    out = np.empty((len(counts), bands), np.int64)
    value = np.empty_like(labelled)
    padded = np.append(own, np.uint64(0))
    for band in range(bands):
        np.multiply(labelled, _FACTORS[band], out=value)
        low = np.flatnonzero(value < by_place)
        enough = np.bincount(text[low], minlength=len(counts)) >= wanted
        if not enough.all():
            rest = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in np.flatnonzero(~enough)])
            low = np.concatenate((low[enough[text[low]]], rest))
        low = low[np.lexsort((value[low], text[low]))]
        first = np.searchsorted(text[low], np.arange(len(counts)))
        nth = np.arange(picks)
        picked = low[np.minimum(first[:, None] + nth, len(low) - 1)]
        picked = np.sort(np.where(nth < wanted[:, None], picked, len(own)), axis=1)
        total = np.zeros(len(counts), np.uint64)
        for i in range(picks):
            total = textvec.mix(total * np.uint64(0xD6E8FEB86659FD93) + padded[picked[:, i]])
        out[:, band] = total.view(np.int64)
    return out


def _keys(texts: list[str], hashes: np.ndarray, offsets: np.ndarray) -> list[str]:
    """One key for all texts of the same words, and for all equal texts without words."""
    bounds = offsets.tolist()
    contents = (b"w" + hashes[a:b].tobytes() if b > a else b"t" + text.encode() for text, a, b in zip(texts, bounds, bounds[1:]))
    return [hashlib.blake2b(c, digest_size=16).hexdigest() for c in contents]


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys: list[str] = []
        sizes: list[int] = []
        made: list[list[int] | None] = []
        for chunk in textvec.chunks(batch.column("text").to_pylist()):
            hashes, _, _, offsets, _, _ = textvec.words(chunk)
            own, own_offsets = textvec.shingles(hashes, offsets)
            keys += _keys(chunk, hashes, offsets)
            counts = np.diff(own_offsets)
            sizes += counts.tolist()
            fit = counts >= LEAST
            rows = iter(sketches(own[np.repeat(fit, counts)], np.concatenate(([0], np.cumsum(counts[fit])))) if fit.any() else ())
            made += [next(rows) if f else None for f in fit.tolist()]
        columns = [*(batch.column(n) for n in ("id", *ROW)), pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(made, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", *ROW, "key", "size", "sketch"])


def _sequences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[bytes] = []
        for chunk in textvec.chunks(batch.column("text").to_pylist()):
            hashes, _, _, offsets, _, _ = textvec.words(chunk)
            own, own_offsets = textvec.shingles(hashes, offsets)
            made += [own[a:b].tobytes() for a, b in zip(own_offsets, own_offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "sequence"])


def _common(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose partners are at most band places apart, by rows of bits."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    window = (1 << 2 * band + 1) - 1
    row = full
    for i, x in enumerate(a):
        if near := places.get(x, 0) & (window << i >> band):
            hit = row & near
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Alignment similarity of two shingle sequences; what is under `least` may be given as any value under it."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[::-1][: k - head] != b[::-1][: k - head])
    tail = int(differ[0]) if len(differ) else k - head
    x, y = a[head : n - tail], b[head : m - tail]
    common = head + tail
    if len(x) and len(y):
        (ux, cx), (uy, cy) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
        _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        bound = common + int(np.minimum(cx[ix], cy[iy]).sum())
        if bound < least * (n + m - bound):
            return 0.0
        # A similarity of `least` leaves (1 - least) / (1 + least) of all shingles without a partner, so none is further apart.
        common += _common(x.tolist(), y.tolist(), int((1 - least) / (1 + least) * (n + m)) + 1)
    return common / (n + m - common)


def _verify(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            nodes, centers, made = [], [], []
            for node, center, sequence in zip(batch.column("node").to_pylist(), batch.column("center").to_pylist(), batch.column("sequence")):
                own = np.frombuffer(sequence.as_buffer(), np.uint64)
                if node is None:  # the centre itself comes before what is compared with it
                    head = own.copy()
                else:
                    nodes.append(node)
                    centers.append(center)
                    made.append(similarity(own, head, least))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(centers, pa.int64()), pa.array(made, pa.float64())], names=["node", "center", "similarity"])

    return run


def _labelled_texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for value in batch.column("sequence"):
        own = np.frombuffer(value.as_buffer(), np.uint64)
        yield _labelled(own, np.zeros(len(own), np.int64))


def _rarity(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for own in _labelled_texts(batch):
            np.add.at(total, (own % np.uint64(COUNTERS)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])


def parities(own: np.ndarray) -> np.ndarray:
    """Whether each of the bins of 64 times PARITIES has an odd number of a text's labelled shingles, 64 to a number."""
    bins = 64 * len(PARITIES)
    odd = np.bincount((own % np.uint64(bins)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _rarest(shared, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, sizes, odd = [], [], np.empty((batch.num_rows, len(PARITIES)), np.int64)
            for own in _labelled_texts(batch):
                count = shared.value[(own % np.uint64(COUNTERS)).astype(np.int64)]
                enough = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1
                odd[len(made)] = parities(own)
                made.append(own[np.lexsort((own, count))[:enough]].view(np.int64))
                sizes.append(len(own))
            columns = [batch.column("node"), pa.array(sizes, pa.int32()), *map(pa.array, np.ascontiguousarray(odd.T)), pa.array(made, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", *PARITIES, "rare"])

    return run


def joined(rows: DataFrame, facts: DataFrame, on: str, weight: str) -> DataFrame:
    """rows joined with facts, a written table with one row for each value of `on`, `weight` the number of its rows.

    Values with more than a HOT-th of all rows, fewer than HOT, go by broadcast, so no task gets all rows of one.
    """
    total, most = facts.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    bound = max(RUN, total // HOT)
    if most <= bound:
        return rows.join(facts.hint("merge"), on)
    hot = facts.filter(F.col(weight) > bound)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(facts.filter(F.col(weight) <= bound).hint("merge"), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def _buckets(rows: DataFrame, *more: Column) -> DataFrame:
    """For each bucket of two nodes or more how many it has, the least one, and an id that all buckets of the same nodes share."""
    either = [F.expr(f"bit_xor(xxhash64({seed}, node))").alias(f"x{seed}") for seed in (1, 2)]
    found = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("center"), *either, *more).filter("many > 1")
    return found.withColumn("same", F.xxhash64("many", "x1", "x2")).drop("x1", "x2")


def _compared(pairs: DataFrame, texts: DataFrame, least: float, stages: Stages, name: str) -> DataFrame:
    """(node, center, similarity) of distinct (node, center), a written table.

    A centre's sequence is shuffled once for each run of texts that are compared with it, and each of these once a pair.
    """
    pairs = stages.write(pairs, f"pairs-{name}")
    each = pairs.groupBy("center").agg(F.count(F.lit(1)).alias("n"))
    bound = max(RUN, pairs.count() // HOT)
    hot = each.filter(F.col("n") > bound).select("center", F.ceil(F.col("n") / bound).alias("runs"))
    own = pairs.join(F.broadcast(hot), "center", "left").select("node", "center", F.coalesce(F.pmod(F.xxhash64("node"), F.col("runs")), F.lit(0)).alias("run"))
    heads = own.select("center", "run").distinct().join(texts.withColumnRenamed("node", "center").hint("merge"), "center").withColumn("node", F.lit(None).cast("long"))
    both = heads.unionByName(own.join(texts.hint("merge"), "node")).repartition("center", "run").sortWithinPartitions("center", "run", F.col("node").asc_nulls_first())
    out = stages.write(both.select("node", "center", "sequence").mapInArrow(_verify(least), "node long, center long, similarity double"), f"known-{name}")
    stages.drop(pairs)
    return out


def _mixed(members: DataFrame, roots: DataFrame, stages: Stages, name: str, *more: Column) -> DataFrame:
    """members with root, many and more, of the buckets that hold two classes or more."""
    own = members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    facts = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("low"), F.max("root").alias("high"), *more).filter("low < high").drop("low", "high")
    return joined(own, stages.write(facts, f"mixed-{name}"), "bucket", "many")


def _roots(compared: DataFrame, texts: DataFrame, threshold: float, stages: Stages) -> DataFrame:
    """(node, root) of all linked nodes. compared: (bucket, node, center, many)."""
    least = 2 * threshold - 1  # a text this unlike the centre can't be linked to one that is linked to the centre
    known = _compared(compared.select("node", "center").distinct(), texts, least, stages, "0")
    roots = components(known.filter(F.col("similarity") >= threshold).select("node", "center"), stages, "roots-0")
    several = compared.filter("many > 2")
    apart = several.join(known.filter(F.col("similarity") < threshold).hint("merge"), ["node", "center"])
    nearest = apart.groupBy("bucket").agg(F.max("similarity").alias("nearest"), F.max("many").alias("n")).filter(F.col("nearest") >= least)
    # Of the centre's own texts those count that the triangle inequality lets be near one that is apart.
    around = joined(several, stages.write(nearest, "nearest"), "bucket", "n")
    linked = known.filter(F.col("similarity") >= threshold).withColumnsRenamed({"node": "n2", "center": "c2"})
    helpers = around.join(linked.hint("merge"), (F.col("node") == F.col("n2")) & (F.col("center") == F.col("c2")) & (F.col("similarity") <= F.col("nearest") + 1 - threshold))
    left = _mixed(apart.select("bucket", "node").unionByName(helpers.select("bucket", "node")), roots, stages, "0").select("node").distinct()
    rest = stages.write(texts.join(left.hint("merge"), "node"), "rest")
    stages.drop(texts)
    counts = np.zeros(COUNTERS, np.int32)
    found = rest.select("sequence").mapInArrow(_rarity, "counter long, n long").groupBy("counter").agg(F.sum("n").cast("int").alias("n")).toArrow()
    counts[found["counter"].to_numpy()] = found["n"].to_numpy()
    shared = rest.sparkSession.sparkContext.broadcast(counts)
    stages.tidy()
    share = threshold / (1 + threshold)  # of the two sizes together, what two linked texts have in common at least
    loose = F.col("size") - F.col("place") >= 2 * share * F.col("size") - 1e-9
    kinds = ", ".join(f"{n} long" for n in PARITIES)
    rare = rest.mapInArrow(_rarest(shared, threshold), f"node long, size int, {kinds}, rare array<long>").select("node", "size", *PARITIES, F.posexplode("rare").alias("place", "bucket"))
    buckets = stages.write(_buckets(rare, F.max(loose).alias("loose")).filter("loose").select("bucket", "many", "same"), "buckets")
    merged = joined(rare, buckets, "bucket", "many").groupBy(F.col("same").alias("bucket"), "node").agg(F.min("place").alias("place"), *(F.min(n).alias(n) for n in ("size", *PARITIES)))
    members = held = stages.write(merged.withColumn("loose", loose), "members-0")
    for turn, some in enumerate(TURNS, 1):
        first = F.min(F.when(F.col("loose"), F.struct("size", "node"))).alias("first")
        marked = _mixed(members, roots, stages, str(turn), first).filter("first is not null")
        chance = F.lit(True) if some is None else F.pmod(F.xxhash64("node", F.lit(turn)), F.col("many")) < some - 1
        marked = stages.write(marked.withColumn("central", F.col("loose") & ((F.col("node") == F.col("first.node")) | chance)).drop("first"), f"marked-{turn}")
        stages.drop(held)
        held = marked
        if marked.isEmpty():
            break
        runs = F.ceil(F.col("many") / RUN)
        centers = marked.filter("central").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1)).alias("run"), *(F.col(n).alias(f"center_{n}") for n in ("node", "root", "place", "size", *PARITIES)))
        left_over = F.least(F.col("size") - F.col("place"), F.col("center_size") - F.col("center_place"))
        both = F.col("size") + F.col("center_size")
        differ = reduce(add, (F.bit_count(F.col(n).bitwiseXOR(F.col(f"center_{n}"))) for n in PARITIES))
        enough = (left_over >= share * both - 1e-9) & (differ <= (1 - 2 * share) * both + 1e-9)
        pairs = marked.withColumn("run", F.pmod(F.xxhash64("node"), runs)).join(centers.hint("merge"), ["bucket", "run"]).filter("root != center_root and (node > center_node or not central)").filter(enough)
        pairs = pairs.select("node", F.col("center_node").alias("center")).distinct().join(known.select("node", "center").hint("merge"), ["node", "center"], "left_anti")
        fresh = _compared(pairs, rest, threshold, stages, str(turn))
        known = known.unionByName(fresh)
        new = fresh.filter(F.col("similarity") >= threshold).select("node", "center")
        if not new.isEmpty():
            old = roots
            roots = components(old.withColumnRenamed("root", "center").unionByName(new), stages, f"roots-{turn}")
            stages.drop(old)
        members = marked.filter("not central").select("bucket", "node", "place", "size", *PARITIES, "loose")
        stages.tidy()
    return roots


def components(links: DataFrame, stages: Stages, name: str = "components") -> DataFrame:
    """(node, root), a written table: the least node of each linked node's component. links: (node, center).

    Large-star and small-star turns until each node has one root and no root is a node.
    """
    edges = stages.write(links.select(F.greatest("node", "center").alias("node"), F.least("node", "center").alias("root")).distinct(), f"{name}-0")
    turn = 0
    while True:
        ends = edges.select("node", F.lit(1).cast("long").alias("n")).unionByName(edges.select(F.col("root").alias("node"), F.lit(1 << 40).alias("n")).distinct())
        if ends.groupBy("node").agg(F.sum("n").alias("n")).filter("n != 1 and n != 1099511627776").isEmpty():
            return edges
        turn += 1
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = stages.write(both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-{turn}-large")
        large = joined(both.filter("root > node"), least, "node", "n").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        large = stages.write(large, f"{name}-{turn}-edges")
        fewest = large.groupBy("node").agg(F.min("root").alias("m"))  # a node has no more roots here than it had neighbours below
        small = large.join(fewest.hint("merge"), "node").select(F.col("root").alias("node"), F.col("m").alias("root")).filter("node != root")
        moved = stages.write(small.unionByName(fewest.select("node", F.col("m").alias("root"))).distinct(), f"{name}-{turn}")
        stages.drop(edges, least, large)
        edges = moved


def _linked(df: DataFrame, threshold: float, id_col: str, text_col: str, stages: Stages) -> tuple[DataFrame, DataFrame]:
    """(sketched, nodes): a row for each row of df, and one for each different text with the class that it is of.

    sketched: id, hashes, key, size. nodes: key, rows, class_key, first; first is the class's row of the least id (nulls
    last), then hashes.
    """
    rows = df.select(df[id_col].alias("id"), *(c.alias(n) for c, n in zip(row_hashes(df[id_col], df[text_col]), ROW)), df[text_col].alias("text"))
    sketched = stages.write(rows.mapInArrow(_sketch, typed(rows, ["id", *ROW], "key string, size int, sketch array<long>")), "sketched")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", *ROW)).alias("first")
    nodes = sketched.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), first, F.max("sketch").alias("sketch"))
    nodes = stages.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.posexplode("sketch").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "node")
    buckets = stages.write(_buckets(banded), "shared")
    compared = joined(banded, buckets, "bucket", "many").filter("node != center").select(F.col("same").alias("bucket"), "node", "center", "many").distinct()
    compared = stages.write(compared, "compared")
    met = compared.select("node").unionByName(compared.select(F.col("center").alias("node"))).distinct()
    wanted = stages.write(met.join(nodes.select("node", *(f"first.{n}" for n in ROW)).hint("merge"), "node"), "wanted")
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = rows.join(F.broadcast(wanted) if few else wanted.hint("merge"), list(ROW)).dropDuplicates(list(ROW)).select("node", "text")
    texts = stages.write(found.mapInArrow(_sequences, "node long, sequence binary"), "texts")
    stages.tidy()
    roots = _roots(compared, texts, threshold, stages)
    linked = stages.write(nodes.join(roots.hint("merge"), "node").select("key", "root", "first").unionByName(nodes.join(roots.select(F.col("root").alias("node")).distinct().hint("merge"), "node").select("key", F.col("node").alias("root"), "first")), "linked")
    facts = stages.write(linked.groupBy("root").agg(F.min("key").alias("class_key"), F.min("first").alias("first"), F.count(F.lit(1)).alias("n")), "facts")
    of_linked = joined(linked.select("key", "root"), facts, "root", "n").select("key", "class_key", F.col("first").alias("class_first"))
    of_all = nodes.select("key", "rows", "first").join(of_linked.hint("merge"), "key", "left")
    return sketched, of_all.select("key", "rows", F.coalesce("class_key", "key").alias("class_key"), F.coalesce("class_first", "first").alias("first"))


def classes(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, class_key, n_shingles) of every row of df. Ids may be of any type that has an order.

    class_key is a digest that tells the classes apart. class_id is the least id of the class's rows; where an id stands
    on different texts, classes may share it. Texts of equal words are one text, as are equal texts without words; a null
    text is empty, and all empty texts are one class. A text of one to four words has one shingle, and like all of under
    four shingles is linked to equal ones only. Rows keep their number; a null id stays null and takes no part in the
    least, so a class of null ids alone has class_id null. An empty table gives an empty table.
    """
    stages = Stages(df.sparkSession, "neardup")
    sketched, nodes = _linked(df, threshold, id_col, text_col, stages)
    of_key = stages.write(nodes.select("key", "rows", "class_key", F.col("first.id").alias("class_id")), "of-key")
    return joined(sketched.select("id", "key", "size"), of_key, "key", "rows").select(F.col("id").alias("doc_id"), "class_id", "class_key", F.col("size").cast("long").alias("n_shingles"))


#: Compared texts up to this number have their row's hashes sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 50_000


def deduplicate(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, all its columns, with one row of each class of `classes`: of the least id, nulls last.

    Of rows with the same id and text any one stays. Rows of one id whose texts aren't linked all stay.
    """
    stages = Stages(df.sparkSession, "neardup")
    _, nodes = _linked(df, threshold, id_col, text_col, stages)
    names = unused(ROW, df.columns)
    kept = stages.write(nodes.filter("class_key = key").select(*(F.col(f"first.{n}").alias(own) for n, own in zip(ROW, names))), "kept")
    hashed = df.withColumns(dict(zip(names, row_hashes(df[id_col], df[text_col]))))
    return hashed.join(kept.hint("shuffle_merge"), names, "left_semi").dropDuplicates(names).drop(*names)
