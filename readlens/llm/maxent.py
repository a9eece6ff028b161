"""A hashed maximum-entropy language model: n-gram and skip features, class-factored softmax.

The probability of a word is that of its class given the words before it, times that of the word within its class. The
first factor is a softmax over classes of summed weights of hashed features; the second one of counts over all training
rows. Frequent words have classes of their own; the others are classed by their last signs. Counts come from every
training row, and so do class weights: rounds of gradient updates on a bounded sample give a start, from which each task
goes once over all of its training rows. What tasks learn side by side is averaged, row by row of the weight table.

Counts of all words don't fit one machine, so texts are scored with the counts of the most frequent ones (a bounded
table), and what other words add is joined by word and summed by text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stages
from .rows import typed

#: The token after each text. No word is empty, so it is the empty one.
END = b""


@dataclass(frozen=True)
class Params:
    """frequent: words whose counts every worker has. own: words with a class of their own, beside `classes` - own others.

    buckets: rows of the table of feature weights. sample: at most so many training rows, picked by a hash, start the
    class weights, in `parts` parts and `rounds` rounds; if there are more, a pass over all follows. Adding constant
    `add` smooths counts.
    """

    frequent: int = 250_000
    own: int = 11
    classes: int = 32
    buckets: int = 1 << 15
    sample: int = 4000
    parts: int = 6
    rounds: int = 3
    rate: float = 0.15
    add: float = 0.1


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then END."""
    return [*(text or "").encode().lower().split(), END]


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def block() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    held: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column("text"):
            held.update(tokens(text.as_py()))
            if len(held) > 200_000:
                yield block()
    if held:
        yield block()


def word_class(word: bytes, params: Params) -> int:
    """The class of a word that has none of its own."""
    return params.own + zlib.crc32(word[-3:]) % (params.classes - params.own)


@dataclass
class Vocabulary:
    """What workers know: codes of frequent words, and by code their class and count; counts of each class and of all."""

    params: Params
    codes: dict[bytes, int]
    classes: np.ndarray
    counts: np.ndarray
    class_counts: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    def base(self, n: np.ndarray | int) -> np.ndarray:
        add = self.params.add
        return np.log10((n + add) / (self.total + add * (self.distinct + 1)))

    def within(self, n: np.ndarray | int, kind: np.ndarray | int) -> np.ndarray:
        """log10 of a word's share of its class; one more word of each class stands for all unknown ones."""
        add = self.params.add
        return np.log10((n + add) / (self.class_counts[kind] + add * (self.class_words[kind] + 1)))

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(features' word numbers, classes, words that aren't frequent) of a text's tokens; rare words' numbers are negative hashes."""
        words = tokens(text)
        numbers = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int64, len(words))
        kinds = self.classes[numbers]
        at = np.flatnonzero(numbers < 0)
        rare = [words[k] for k in at.tolist()]
        if rare:
            kinds[at] = [word_class(w, self.params) for w in rare]
            numbers[at] = [-1 - zlib.crc32(w) for w in rare]
        return numbers, kinds, rare


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)


def features(numbers: np.ndarray, kinds: np.ndarray, lengths: np.ndarray, buckets: int) -> np.ndarray:
    """(tokens, 6) rows of the weight table: bias, last word, last two words, the word before the last, last two classes, class and word two apart."""
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.arange(len(numbers)) - first
    words = np.concatenate((np.zeros(2, np.int64), numbers)).view(np.uint64) * _MULTIPLIERS[0] + np.uint64(1)
    known = np.concatenate((np.zeros(2, np.int64), kinds + 1)).view(np.uint64)
    w1, w2 = np.where(place >= 1, words[1:-1], np.uint64(0)), np.where(place >= 2, words[:-2], np.uint64(0))
    c1, c2 = np.where(place >= 1, known[1:-1], np.uint64(0)), np.where(place >= 2, known[:-2], np.uint64(0))
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    mixed = [w1, w1 ^ (w2 * _MULTIPLIERS[1]), w2 + np.uint64(7), c1 * _MULTIPLIERS[2] + c2 * _MULTIPLIERS[3] + np.uint64(11), w2 ^ (c1 * _MULTIPLIERS[4])]
    out = np.zeros((len(numbers), 6), np.int64)
    for k, (m, by) in enumerate(zip(mixed, _MULTIPLIERS), 1):
        out[:, k] = ((m ^ (m >> np.uint64(29))) * by >> shift).view(np.int64)
    return out


def class_logits(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = table.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        out += table.take(rows[:, k], axis=0)
    return out


def log_classes(table: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of each token's class probability, in batches of sparse rows."""
    out = np.empty(len(kinds))
    for a in range(0, len(kinds), 4096):
        x = class_logits(table, rows[a : a + 4096])
        x -= x.max(axis=1, keepdims=True)
        own = x[np.arange(len(x)), kinds[a : a + 4096]]
        np.exp(x, out=x)
        out[a : a + 4096] = own - np.log(x.sum(axis=1))
    return out / math.log(10)


def updated(table: np.ndarray, squares: np.ndarray, rows: np.ndarray, kinds: np.ndarray, rate: float) -> None:
    """One gradient step of the log loss, with a step size for each row of the table (AdaGrad), in place."""
    x = class_logits(table, rows)
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    x[np.arange(len(x)), kinds] -= 1
    flat = rows.astype(np.uint16 if len(table) <= 1 << 16 else np.int64).ravel()
    order = np.argsort(flat, kind="stable")
    at = np.flatnonzero(np.diff(flat[order].astype(np.int64), prepend=-1))
    many = np.diff(at, append=len(flat))
    token = order // rows.shape[1]
    sums = x.take(token[at], axis=0)
    more = np.flatnonzero(many > 1)
    for nth in range(1, 9):  # most rows of the table are met a few times at most
        sums[more] += x.take(token[at[more] + nth], axis=0)
        more = more[many[more] > nth + 1]
    ones = np.ones(rows.size, x.dtype)
    for k, a, n in zip(more.tolist(), (at[more] + 9).tolist(), (many[more] - 9).tolist()):
        sums[k] += ones[:n] @ x.take(token[a : a + n], axis=0)
    touched = flat[order[at]].astype(np.int64)
    square = squares.take(touched) + np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
    squares[touched] = square
    sums *= (rate / np.sqrt(square + 1e-8))[:, None]
    table[touched] -= sums


def _learner(vocabulary, table: np.ndarray, squares: np.ndarray, params: Params):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = table.copy(), squares.copy()
        seen = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a in range(0, len(texts), 16):
                coded = [vocabulary.value.encode(t) for t in texts[a : a + 16]]
                numbers, kinds = (np.concatenate([c[i] for c in coded]) for i in (0, 1))
                rows = features(numbers, kinds, np.array([len(c[0]) for c in coded]), params.buckets)
                for b in range(0, len(kinds), 4096):
                    updated(own, sums, rows[b : b + 4096], kinds[b : b + 4096], params.rate)
                seen += len(kinds)
        moved = np.flatnonzero((own != table).any(axis=1))
        for a in range(0, len(moved) if seen else 0, 4096):
            at = moved[a : a + 4096]
            columns = [pa.array(at.astype(np.int32)), pa.array([seen] * len(at), pa.int64()), pa.array([(own[r] - table[r]).tobytes() for r in at], pa.binary()), pa.array((sums - squares)[at].astype(float))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "seen", "step", "square"])

    return run


def _averaged(params: Params):
    """Of all moves of a row, which are in one task, the mean weighted by tokens, and the sum of squares."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, seen, squares = np.zeros((params.buckets, params.classes)), np.zeros(params.buckets), np.zeros(params.buckets)
        for batch in batches:
            at, weight = batch.column("row").to_numpy(), batch.column("seen").to_numpy().astype(float)
            moves = np.frombuffer(b"".join(batch.column("step").to_pylist()), np.float32).reshape(len(at), -1)
            np.add.at(steps, at, moves * weight[:, None])
            np.add.at(seen, at, weight)
            np.add.at(squares, at, batch.column("square").to_numpy())
        at = np.flatnonzero(seen)
        means = (steps[at] / seen[at, None]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([m.tobytes() for m in means], pa.binary()), pa.array(squares[at])], names=["row", "step", "square"])

    return run


def _train(rows: DataFrame, vocabulary, params: Params, total_rows: int, stages: Stages) -> np.ndarray:
    """Class weights. Rounds on the parts of the sample, then, if that isn't all rows, one on the partitions of rows.

    A task holds one table, and so does the driver, whatever the number of rows and tasks.
    """
    table, squares = np.zeros((params.buckets, params.classes), np.float32), np.zeros(params.buckets, np.float32)
    scale = 1 << 30
    limit = min(scale, scale * params.sample // max(1, total_rows))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("lm")), F.lit(scale)) < limit).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(params.parts)))
    # The parts and their order come from ids and texts alone, so the start doesn't depend on the files.
    sample = stages.write(sample.select("part", "text"), "sample")
    sample = sample.repartition(params.parts, "part").sortWithinPartitions("part", F.xxhash64("text")).select("text")
    for part in [sample] * params.rounds + [rows.select("text")] * (limit < scale):
        moves = part.mapInArrow(_learner(vocabulary, table, squares, params), "row int, seen long, step binary, square double")
        moves = moves.repartition("row").mapInArrow(_averaged(params), "row int, step binary, square double").toArrow()
        if not len(moves):
            continue
        at = moves["row"].to_numpy()
        table[at] += np.frombuffer(b"".join(moves["step"].to_pylist()), np.float32).reshape(len(at), -1)
        squares[at] += moves["square"].to_numpy().astype(np.float32)
    return table


_SCORED = "held_out boolean, n_tokens long, known long, base double, model double, rare array<struct<word: binary, n: long, class: int>>"


def _scorer(vocabulary, weights):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = vocabulary.value, weights.value
        base, within = own.base(own.counts), own.within(own.counts, own.classes)
        for whole in batches:
            for part in range(0, whole.num_rows, 256):
                yield block(whole.slice(part, 256), own, table, base, within)

    def block(batch: pa.RecordBatch, own: Vocabulary, table: np.ndarray, base: np.ndarray, within: np.ndarray) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        sums: list[tuple] = []
        words: list[bytes] = []
        times: list[int] = []
        ends = [0]
        for a in range(0, len(texts), 64):
            coded = [own.encode(t) for t in texts[a : a + 64]]
            lengths = np.array([len(c[0]) for c in coded])
            numbers, kinds = (np.concatenate([c[i] for c in coded]) for i in (0, 1))
            starts = np.cumsum(lengths) - lengths
            rows = features(numbers, kinds, lengths, own.params.buckets)
            model = log_classes(table, rows, kinds)
            frequent = numbers >= 0
            code = np.where(frequent, numbers, 0)
            model += np.where(frequent, within[code], 0)
            sums += zip(lengths.tolist(), np.add.reduceat(frequent, starts, dtype=np.int64).tolist(), np.add.reduceat(np.where(frequent, base[code], 0), starts).tolist(), np.add.reduceat(model, starts).tolist())
            for _, _, rare in coded:
                once = Counter(rare)
                words += once
                times += once.values()
                ends.append(len(words))
        known = [pa.array(c, k) for c, k in zip(zip(*sums), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        parts = [pa.array(words, pa.binary()), pa.array(times, pa.int64()), pa.array([word_class(w, own.params) for w in words], pa.int32())]
        rare_words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["word", "n", "class"]))
        names = ["row_key", "doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"]
        return pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("doc_id"), batch.column("held_out"), *known, rare_words], names=names)

    return run


def score(df: DataFrame, held_out: Column, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from rows not held out.

    A null text is empty: its one token is the end. n_known counts tokens that training rows have; base_score is the
    log10 probability of the text by smoothed counts of single words, score that of the model. Rows keep their number;
    null and repeated ids are kept; a null id counts as held out. With nothing to learn from all counts are 0.
    """
    params = params or Params()
    spark = df.sparkSession
    stages = Stages(spark, "maxent")
    rows = df.select(df[id_col].alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), df[text_col].alias("text"))
    training = rows.filter("not held_out")
    counts = training.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stages.write(counts, "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(params.frequent).toArrow().to_pandas()
    words, n = [bytes(w) for w in top["word"]], top["n"].to_numpy(np.int64)
    kinds = np.array([k if k < params.own else word_class(w, params) for k, w in enumerate(words)], np.int64)
    own = set(words[: params.own])
    others = params.classes - params.own
    rest = counts.filter(~F.col("word").isin([F.lit(w) for w in own])) if own else counts
    by_class = {r["class"]: r for r in rest.withColumn("class", F.pmod(F.crc32(F.expr("substring(word, -3, 3)")), F.lit(others)) + params.own).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}
    class_counts, class_words = np.zeros(params.classes), np.zeros(params.classes)
    for k in range(params.classes):
        if k < len(own):
            class_counts[k], class_words[k] = n[k], 1
        elif k in by_class:
            class_counts[k], class_words[k] = by_class[k]["n"], by_class[k]["words"]
    known = Vocabulary(params, {w: k for k, w in enumerate(words)}, kinds if len(kinds) else np.zeros(1, np.int64), n if len(n) else np.zeros(1, np.int64), class_counts, class_words, int(total), int(distinct))
    vocabulary = spark.sparkContext.broadcast(known)
    ends = 0 if END not in known.codes else int(n[known.codes[END]])
    weights = spark.sparkContext.broadcast(_train(training, vocabulary, params, ends, stages))
    keyed = rows.withColumnRenamed("id", "doc_id").withColumn("row_key", F.monotonically_increasing_id())
    scored = stages.write(keyed.mapInArrow(_scorer(vocabulary, weights), typed(keyed, ["row_key", "doc_id"], _SCORED)), "scored")
    add, width = params.add, float(known.total + params.add * (known.distinct + 1))
    table = F.create_map(*(x for k in range(params.own, params.classes) for x in (F.lit(k), F.lit(float(class_counts[k] + add * (class_words[k] + 1))))))
    rare = scored.select("row_key", F.explode("rare").alias("r")).select("row_key", "r.*")
    found = rare.join(counts.withColumnRenamed("n", "count"), "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    more = found.groupBy("row_key").agg(
        F.sum(F.when(F.col("count") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((F.col("count") + add) / width)).alias("more_base"),
        F.sum(F.col("n") * F.log10((F.col("count") + add) / table[F.col("class")])).alias("more_model"),
    )
    out = scored.drop("rare").join(more, "row_key", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("known", "more_known").cast("long").alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("model", "more_model").alias("score"))
