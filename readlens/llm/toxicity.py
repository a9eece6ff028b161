"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier on its posteriors.

Voters are lexicons and patterns. One lexicon is given, the others are learned: words and beginnings of words that labelled
toxic texts have and clean ones hardly ever, dealt into many voters by kind and hash, so that no voter sees all of the
evidence. Patterns (capitals, marks, runs of a sign, shortness) may speak for either class. The label model has no labels:
from the votes of all texts that may be learned from, labelled or not, added up by pattern of votes, it estimates each
voter's rates in the two classes, and of the voters that go together the strongest tree of correlations, by expectation
maximisation. The classifier learns its posteriors from hashed words and beginnings of a sample, with an L1 penalty, and so
also knows signs that no voter has. The labels of the sample calibrate its scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import learn, textvec
from ..session import Stages
from .rows import typed

#: Lengths of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 5)
KINDS = 1 + len(BEGINNINGS)
#: The given lexicon: common insults, by no means all.
INSULTS = "idiot moron stupid fool loser scum trash pathetic dumb disgusting dummkopf trottel abschaum imbécile crétin ordure estúpido basura imbécil"
PATTERNS = 4


@dataclass(frozen=True)
class Params:
    """toxic, clean: at most so many labelled rows of each class are learned from, those of the least hashes of their ids;
    features of fewer than known_rows of them aren't used, and of the others the `width` that tell most.

    lexicons: learned voters of each kind of feature. A term is in so many toxic rows of the sample at least, and at most
    this share of the rows that have it are clean ones. ftrl's L1 penalty is for each row of the sample.
    """

    toxic: int = 4000
    clean: int = 6000
    known_rows: int = 3
    width: int = 1 << 15
    lexicons: int = 5
    least_rows: int = 6
    most_clean: float = 0.002
    rounds: int = 25
    ftrl: learn.Ftrl = field(default_factory=lambda: learn.Ftrl(alpha=1.0, l1=8e-4, l2=0.1, epochs=6))


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the sorted hashes of its words and beginnings, the kind in the two low bits, and which patterns it has."""
    cp, ends = textvec.codepoints(texts)
    hashes, starts, stops, offsets, values, _ = textvec.words(texts)
    up, down = textvec.powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    low = ~np.uint64(3)
    columns = [hashes & low]
    for kind, n in enumerate(BEGINNINGS, 1):
        reach = np.minimum(starts + n, stops)
        own = textvec.mix((total[reach] - total[starts]) * down[starts] + np.uint64(n))
        columns.append(np.where(stops - starts > n, own & low | np.uint64(kind), columns[0]))
    table = np.stack(columns, axis=1).view(np.int64)
    upper = np.concatenate(([0], np.cumsum((cp >= 65) & (cp <= 90))))
    marks = np.concatenate(([0], np.cumsum((cp == 33) | (cp == 63))))
    same = cp[1:] == cp[:-1]
    runs = np.zeros(len(cp) + 1, np.int64)
    if len(cp) > 3:
        np.cumsum(same[2:] & same[1:-1] & same[:-2], out=runs[4:])
    out = []
    first = 0
    for k, end in enumerate(ends.tolist()):
        a, b = offsets[k], offsets[k + 1]
        size = max(1, end - first)
        has = np.array([(upper[end] - upper[first]) / size > 0.3, (marks[end] - marks[first]) / size > 0.05, end - first > 3 and runs[end] > runs[first + 3], b - a < 30])
        out.append((np.unique(table[a:b]), has))
        first = end + 1
    return out


def insults() -> np.ndarray:
    """The given lexicon as sorted feature hashes."""
    hashes, *_ = textvec.words([INSULTS])
    return np.unique((hashes & ~np.uint64(3)).view(np.int64))


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, marks = [], []
        for chunk in textvec.chunks(batch.column("text").to_pylist()):
            made += features(chunk)
            marks += signatures(chunk).tolist()
        places = pa.array([r[0] for r in made], pa.list_(pa.int64()))
        patterns = pa.array([int(np.packbits(r[1], bitorder="little")[0]) for r in made], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), places, patterns, pa.array(marks, pa.list_(pa.int64()))], names=["id", "label", "places", "patterns", "marks"])


def signatures(texts: list[str]) -> np.ndarray:
    """(texts, 2): the least shingle of each text under two hashes; 0 of a text without words."""
    hashes, _, _, offsets, _, _ = textvec.words(texts)
    own, own_offsets = textvec.shingles(hashes, offsets)
    out = np.zeros((len(texts), 2), np.uint64)
    full = np.flatnonzero(np.diff(own_offsets))
    for i in range(2 if len(full) else 0):
        out[full, i] = np.minimum.reduceat(textvec.mix(own + np.uint64(i + 1)), own_offsets[full])
    return out.view(np.int64)


def unlike(marks: np.ndarray) -> np.ndarray:
    """Places of rows of which none is a likely copy of an earlier one: both signatures are new.

    Copies would make every word of theirs a sign of their label.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for k, row in enumerate(marks.tolist()):
        own = list(enumerate(row))
        if row[0] and not seen.intersection(own):
            out.append(k)
        seen.update(own)
    return np.array(out, np.int64)


@dataclass
class Voters:
    """Terms of the lexicons, sorted, and the number of the lexicon of each."""

    terms: np.ndarray
    lexicon: np.ndarray
    lexicons: int

    @staticmethod
    def of(terms: np.ndarray, params: Params) -> Voters:
        """The learned terms dealt into lexicons, and the given lexicon as the last one."""
        given = insults()
        own = np.setdiff1d(terms, given)
        hashes = own.view(np.uint64)
        dealt = (hashes & np.uint64(3)).astype(np.int64) * params.lexicons + (textvec.mix(hashes) % np.uint64(params.lexicons)).astype(np.int64)
        every, number = np.concatenate((own, given)), np.concatenate((dealt, np.full(len(given), KINDS * params.lexicons)))
        order = np.argsort(every)
        return Voters(every[order], number[order], KINDS * params.lexicons + 1)

    def mask(self, places: np.ndarray, patterns: int) -> int:
        """A bit for each voter: the lexicons that have a term of the text, then the patterns."""
        at = np.minimum(np.searchsorted(self.terms, places), len(self.terms) - 1)
        voting = np.unique(self.lexicon[at[self.terms[at] == places]])
        return int((1 << voting).sum()) | patterns << self.lexicons

    def table(self, masks: np.ndarray) -> np.ndarray:
        """(texts, voters) of whether a voter speaks."""
        return (masks[:, None] >> np.arange(self.lexicons + PATTERNS) & 1).astype(bool)


@dataclass
class LabelModel:
    """P(toxic), the tree of voters (parent of each, -1 of the first), and P(voter speaks | class, whether its parent does)."""

    prior: float
    parents: np.ndarray
    rates: np.ndarray

    def posterior(self, table: np.ndarray) -> np.ndarray:
        """Each row's chance of being toxic."""
        above = np.where(self.parents >= 0, table[:, np.maximum(self.parents, 0)], False).astype(int)
        odds = np.full(len(table), np.log(self.prior / (1 - self.prior)))
        for j in range(table.shape[1]):
            one, zero = self.rates[1, j, above[:, j]], self.rates[0, j, above[:, j]]
            odds += np.where(table[:, j], np.log(one / zero), np.log((1 - one) / (1 - zero)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _tree(table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Parents in the tree of the largest mutual information of two voters within the classes. weights: (2, rows)."""
    n = table.shape[1]
    shared = np.zeros((n, n))
    for own in weights:
        total = max(own.sum(), 1e-9)
        for a, x in ((0, ~table), (1, table)):
            for b, y in ((0, ~table), (1, table)):
                both = (x * own[:, None]).T @ y / total
                apart = np.outer(own @ x, own @ y) / total**2
                shared += total * np.where(both > 1e-12, both * np.log(np.maximum(both, 1e-12) / np.maximum(apart, 1e-12)), 0)
    parents, best, near = np.full(n, -1), np.full(n, -np.inf), np.zeros(n, int)
    left = set(range(1, n))
    last = 0
    while left:
        for j in left:
            if shared[last, j] > best[j]:
                best[j], near[j] = shared[last, j], last
        last = max(left, key=lambda j: (best[j], -j))
        parents[last] = near[last]
        left.remove(last)
    return parents


def label_model(table: np.ndarray, counts: np.ndarray, lexicons: int, rounds: int) -> LabelModel:
    """Fitted to the votes alone; `counts` texts voted like each row of `table`. The first `lexicons` voters are lexicons.

    Rounds start from the guess that a text is toxic if a lexicon speaks. The first third treats voters as independent
    within the classes; then the tree of their correlations is chosen, and its rates are fitted with the rest.
    """
    y = np.where(table[:, :lexicons].any(axis=1), 0.9, 0.02)
    parents = np.full(table.shape[1], -1)
    model = LabelModel(0.5, parents, np.zeros((2, table.shape[1], 2)))
    for turn in range(rounds):
        weights = np.stack(((1 - y) * counts, y * counts))
        if turn == rounds // 3:
            parents = _tree(table, weights)
        above = np.where(parents >= 0, table[:, np.maximum(parents, 0)], False)
        rates = np.empty((2, table.shape[1], 2))
        for c, own in enumerate(weights):
            plain = (own @ table + 0.5) / (own.sum() + 1)  # rates with little behind them lean on the voter's own
            for state, there in enumerate((~above, above)):
                rates[c, :, state] = ((own[:, None] * there * table).sum(axis=0) + 2 * plain) / ((own[:, None] * there).sum(axis=0) + 2)
        prior = float(np.clip(weights[1].sum() / max(weights.sum(), 1e-9), 1e-6, 1 - 1e-6))
        model = LabelModel(prior, parents, np.clip(rates, 1e-6, 1 - 1e-6))
        y = model.posterior(table)
    return model


def calibration(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(a, b) such that the labels' log loss under sigmoid(a * score + b) is least, with a slight pull to (1, 0); a is positive."""
    w = np.array([1.0, 0.0])
    x = np.stack((scores, np.ones_like(scores)), axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + (w - [1, 0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), gradient)
        w = w - np.clip(step, -1, 1)
        w[0] = max(w[0], 0.05)
    return float(w[0]), float(w[1])


@dataclass
class Model:
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, places: np.ndarray) -> float:
        at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1) if len(self.places) else places[:0]
        there = at[self.places[at] == places] if len(at) else at
        return float(1 / (1 + np.exp(-np.clip(self.weights[there].sum() + self.bias, -30, 30))))


def _masks(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.mask(row, int(np.packbits(has, bitorder="little")[0])) for chunk in textvec.chunks(batch.column("text").to_pylist()) for row, has in features(chunk)]
            masks, n = np.unique(np.array(made, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(masks), pa.array(n)], names=["mask", "n"])

    return run


def fitted(df: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], params: Params | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """The model alone; none without labels. What the driver gets is bounded by params, whatever the texts' number and length."""
    params = params or Params()
    stages = Stages(df.sparkSession, "toxicity")
    own = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    own = own.groupBy("id").agg(F.max("label").alias("label")).filter(~held_out(F.col("id")))
    least = lambda label, bound: own.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(bound)
    few = F.broadcast(least(0, params.clean).unionByName(least(1, params.toxic)))
    texts = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    picked = texts.join(few, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    sample = stages.write(picked.mapInArrow(_sampled, typed(picked, ["id", "label"], "places array<long>, patterns int, marks array<long>")), "sample")
    order = sample.select("id", "label", "marks").orderBy(F.xxhash64("id"), "id").toArrow()
    if not len(order):
        return None
    kept = unlike(np.array(order["marks"].to_pylist(), np.int64).reshape(len(order), -1))
    if not len(kept):
        return None
    spark = df.sparkSession
    chosen = F.broadcast(spark.createDataFrame(order.select(["id"]).take(pa.array(kept)).to_pandas(), sample.select("id").schema))
    sample = stages.write(sample.join(chosen, "id"), "kept")
    n_toxic = sum(order["label"].take(pa.array(kept)).to_pylist())
    n_clean = len(kept) - n_toxic
    each = sample.select("label", F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    each = each.filter(F.col("n") >= params.known_rows).withColumn("in_toxic", F.col("toxic") / max(1, n_toxic)).withColumn("in_clean", (F.col("n") - F.col("toxic")) / max(1, n_clean))
    each = stages.write(each, "features")
    telling = F.abs(F.col("in_toxic") - F.col("in_clean")) / F.sqrt(F.col("in_toxic") + F.col("in_clean"))
    known = np.sort(each.orderBy(F.desc(telling), "place").limit(params.width).select("place").toArrow()["place"].to_numpy())
    terms = each.filter((F.col("toxic") >= params.least_rows) & (F.col("in_clean") <= params.most_clean * F.col("in_toxic")))
    voters = Voters.of(terms.orderBy(F.desc("toxic"), "place").limit(params.width).select("place").toArrow()["place"].to_numpy(), params)
    shared = spark.sparkContext.broadcast(voters)
    open_ = texts.filter(~F.coalesce(held_out(F.col("id")), F.lit(True))).select("text")
    found = open_.mapInArrow(_masks(shared), "mask long, n long").groupBy("mask").agg(F.sum("n").alias("n")).toArrow()
    votes = label_model(voters.table(found["mask"].to_numpy()), found["n"].to_numpy().astype(float), voters.lexicons, params.rounds)

    columns = spark.sparkContext.broadcast(known)

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(r.values) for r in batch.column("places")]
            masks = [shared.value.mask(r, p) for r, p in zip(rows, batch.column("patterns").to_pylist())]
            at = [np.flatnonzero(np.isin(columns.value, r)).astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(masks, pa.int64()), pa.array(at, pa.list_(pa.int32()))], names=["id", "label", "mask", "at"])

    data = sample.mapInArrow(encoded, typed(sample, ["id", "label"], "mask long, at array<int>")).orderBy(F.xxhash64("id"), "id").toArrow()
    posterior = votes.posterior(voters.table(data["mask"].to_numpy()))
    rows = [(at := np.asarray(r.values), np.ones(len(at))) for r in data["at"]]
    how = replace(params.ftrl, l1=params.ftrl.l1 * len(rows))
    weights = learn.fit(rows, np.stack((1 - posterior, posterior), axis=1), len(known), how)
    linear = weights[1] - weights[0]
    scores = np.array([linear[at].sum() + linear[-1] for at, _ in rows])
    a, b = calibration(scores, data["label"].to_numpy().astype(float))
    places = np.flatnonzero(linear[:-1])
    return Model(known[places], a * linear[places], float(a * linear[-1] + b))


def score(df: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], params: Params | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of df, by a model of the rows that aren't held out.

    labels: id_col and label_col; null labels and ids teach nothing, and an id with several labels has the greatest. A
    null text is empty; an empty text gets the score of no evidence. Without labels all scores are 0.5. Rows keep their
    number; null and repeated ids, of any type, are kept; a null id counts as held out; of texts that repeat an id the
    least is learned from. held_out: from an id to whether it is.
    """
    model = fitted(df, labels, held_out, params, id_col, text_col, label_col) or Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(held_out(df[id_col]), F.lit(True)).alias("held_out"), df[text_col].alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([shared.value.score(row[0]) for chunk in textvec.chunks(batch.column("text").to_pylist()) for row in features(chunk)], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(made), pa.array((made >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, typed(rows, ["doc_id"], "held_out boolean, score double, predicted int"))


def remove(df: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], threshold: float = 0.5, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """df, all its columns, without the rows whose score in the sense of `score` is threshold or more. No shuffle of texts.

    Without labels nothing can be told, and all rows stay.
    """
    model = fitted(df, labels, held_out, params, id_col, text_col, label_col)
    if model is None:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [shared.value.score(row[0]) < threshold for chunk in textvec.chunks(batch.column(text_col).to_pylist()) for row in features(chunk)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return df.mapInArrow(run, df.schema)
