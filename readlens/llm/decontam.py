"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of shingles, in doubling classes. For the class of at most u shingles every text is
cut into blocks of u shingles, and each two neighbouring blocks are a window: an item of the class that a text holds in
one piece lies in some window whole. Item and window share a minimum of one hash function with the chance of their
resemblance, which in such windows is 0.19 at least at a containment of 0.8; over HASHES functions less than 2 in a
million are missed. That bound needs FEWEST shingles, as windows of the smallest class are no smaller; texts are searched
for every shingle of items that have fewer, so none of those is missed. Blocks of a class are unions of those of the class below, so all classes cost little more than one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textvec
from ..session import Stages

HASHES = 64
SMALLEST = 16
#: Items of fewer shingles are looked up by each of them, and not by minima.
FEWEST = 8
#: Shingles of items that one pass over the documents searches; more items take more passes.
BLOCK_SHINGLES = 2_000_000
_BITS = 22
_FACTORS = textvec.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _keys(values: np.ndarray, function: np.ndarray) -> np.ndarray:
    """A minimum together with the number of its hash function."""
    return values ^ (function.astype(np.uint64) << np.uint64(57))


@dataclass
class Index:
    """Items of one pass: sorted keys of their minima by size class, their shingles, short items by number of words.

    few: sorted shingles of items that have too few for minima, and whose they are.
    """

    ids: list
    shingles: list[np.ndarray]
    levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    short: dict[int, tuple[np.ndarray, np.ndarray]]
    few: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(items: list[tuple[object, str]]) -> Index:
        out = Index([], [], {}, {}, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        held: dict[int, list[tuple[np.ndarray, int]]] = {}
        brief: dict[int, list[tuple[int, int]]] = {}
        few: list[tuple[int, int]] = []
        for id_, text in items:
            hashes, _, _, offsets, _, _ = textvec.words([text])
            own = np.unique(textvec.shingles(hashes, offsets)[0])
            if not len(own):
                continue
            k = len(out.ids)
            out.ids.append(id_)
            out.shingles.append(own)
            if len(hashes) < textvec.SHINGLE:
                gram = textvec.shingles(hashes, offsets, len(hashes))[0]
                brief.setdefault(len(hashes), []).append((int(gram[0]), k))
                continue
            if len(own) < FEWEST:
                few += [(int(h), k) for h in own]
                continue
            level = max(0, (len(own) - 1).bit_length() - SMALLEST.bit_length() + 1)
            minima = (own[None, :] * _FACTORS[:, None]).min(axis=1)
            held.setdefault(level, []).append((_keys(minima, np.arange(HASHES)), k))
        for level, rows in held.items():
            keys = np.concatenate([r for r, _ in rows])
            owner = np.repeat([k for _, k in rows], HASHES)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[keys & np.uint64((1 << _BITS) - 1)] = True
            out.levels[level] = (keys[order], owner[order], seen)
        for n, rows in brief.items():
            rows.sort()
            out.short[n] = (np.array([h for h, _ in rows], np.uint64), np.array([k for _, k in rows]))
        few.sort()
        out.few = (np.array([h for h, _ in few], np.uint64), np.array([k for _, k in few], np.int64))
        return out


def _matches(found: np.ndarray, keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in found, owner) of every equal pair; keys are sorted and may repeat."""
    low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
    n = high - low
    place = np.repeat(np.arange(len(found)), n)
    return place, owner[low[place] + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]


def _group_starts(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's rows cut into groups of size: first row of each group, and the number of groups of each text."""
    groups = -(-counts // size)
    first = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), groups)
    nth = np.arange(len(text)) - (np.cumsum(groups) - groups)[text]
    return first[text] + nth * size, groups


def _candidates(index: Index, own: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) that share a minimum in a window."""
    out: set[tuple[int, int]] = set()
    counts = np.diff(offsets)
    if not index.levels or not len(own):
        return out
    starts, groups = _group_starts(counts, SMALLEST)
    minima = np.empty((HASHES, len(starts)), np.uint64)
    scratch = np.empty_like(own)
    for i in range(HASHES):
        np.multiply(own, _FACTORS[i], out=scratch)
        np.minimum.reduceat(scratch, starts, out=minima[i])
    function = np.arange(HASHES)[:, None]
    for level in range(max(index.levels) + 1):
        if level:
            starts, groups = _group_starts(groups, 2)
            minima = np.minimum.reduceat(minima, starts, axis=1)
        if level not in index.levels:
            continue
        keys, owner, seen = index.levels[level]
        text = np.repeat(np.arange(len(groups)), groups)
        windows = minima.copy()
        joint = np.flatnonzero(text[1:] == text[:-1])
        windows[:, joint] = np.minimum(minima[:, joint], minima[:, joint + 1])
        tagged = _keys(windows, function)
        row, column = np.nonzero(seen[tagged & np.uint64((1 << _BITS) - 1)])
        place, item = _matches(tagged[row, column], keys, owner)
        out.update(zip(text[column[place]].tolist(), item.tolist()))
    return out


def hits(index: Index, texts: list[str], similarity: float) -> list[list[tuple[int, int]]]:
    """For each text the (item, shingles shared) whose containment in the whole text is similarity or more."""
    hashes, _, _, word_offsets, _, _ = textvec.words(texts)
    own, offsets = textvec.shingles(hashes, word_offsets)
    pairs = _candidates(index, own, offsets)
    keys, owner = index.few
    if len(keys):
        at = np.flatnonzero(np.isin(own, keys))
        place, item = _matches(own[at], keys, owner)
        pairs.update(zip((np.searchsorted(offsets, at[place], "right") - 1).tolist(), item.tolist()))
    for n, (keys, owner) in index.short.items():
        grams, gram_offsets = textvec.shingles(hashes, word_offsets, n)
        at = np.flatnonzero(np.isin(grams, keys))
        place, item = _matches(grams[at], keys, owner)
        text = np.searchsorted(gram_offsets, at[place], "right") - 1
        whole = np.diff(word_offsets)[text] >= n
        pairs.update(zip(text[whole].tolist(), item[whole].tolist()))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    held: dict[int, np.ndarray] = {}
    for text, item in sorted(pairs):
        wanted = index.shingles[item]
        if any(item in owner for _, owner in index.short.values()):
            out[text].append((item, 1))  # the words themselves were found
            continue
        if text not in held:
            held = {text: np.unique(own[offsets[text] : offsets[text + 1]])}
        there = held[text]
        at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
        shared = int((there[at] == wanted).sum())
        if shared >= similarity * len(wanted):
            out[text].append((item, shared))
    return out


def _passes(items: DataFrame, stages: Stages, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, each read to the driver in turn."""
    texts = items.select(items[id_col].alias("id"), items[text_col].alias("text")).filter("id is not null and text is not null").distinct()
    texts = stages.write(texts.withColumn("size", F.regexp_count("text", F.lit(r"[\p{L}\p{M}\p{N}]+"))), "items")
    total = texts.agg(F.sum("size")).first()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    for block in range(blocks):
        rows = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block) if blocks > 1 else texts
        yield [(r["id"], r["text"]) for r in rows.select("id", "text").collect()]


def search(df: DataFrame, items: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): every pair of a document and an item that it contains.

    An item's containment is the share of its distinct shingles (runs of five words) that the document has. An item of
    one to four words is contained where its words follow each other; one without words, or null, never is. Items with
    a null id are left out, equal items of one id count once. A null document is empty and has no pairs; repeated rows
    have their pairs each; no pair is left out.
    """
    spark = df.sparkSession
    stages = Stages(spark, "decontam")
    rows = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    item = T.StructField("item_id", items.schema[item_id_col].dataType)
    counts = T.StructType.fromDDL("n_item long, n_shared long, containment double").fields
    schema = T.StructType([rows.schema["doc_id"], item, *counts])
    kinds = [f.type for f in to_arrow_schema(schema)]
    found = spark.createDataFrame([], schema)
    for block in _passes(items, stages, item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(Index.of(block))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                made: list[tuple] = []
                done = 0
                for chunk in textvec.chunks(batch.column("text").to_pylist()):
                    for k, own in enumerate(hits(index, chunk, similarity), done):
                        made += [(ids[k], index.ids[i], len(index.shingles[i]), n, n / len(index.shingles[i])) for i, n in own]
                    done += len(chunk)
                columns = list(zip(*made)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "n_item", "n_shared", "containment"])

        found = found.unionByName(rows.mapInArrow(run, schema))
    return found


def remove(df: DataFrame, items: DataFrame, similarity: float = 0.8, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """df, all its columns, without the rows whose text contains an item in the sense of `search`. No shuffle."""
    spark = df.sparkSession
    for block in _passes(items, Stages(spark, "decontam"), item_id_col, item_text_col):
        shared = spark.sparkContext.broadcast(Index.of(block))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not own for chunk in textvec.chunks(batch.column(text_col).to_pylist()) for own in hits(shared.value, chunk, similarity)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
