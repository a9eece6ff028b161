"""Language of a text: multinomial logistic regression on TF-IDF of hashed character n-grams, with calibrated probabilities.

Document frequencies come from all training rows; the classifier is fitted on a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import learn, textvec
from .rows import typed

ORDERS = (1, 2, 3)
WIDTH = 1 << 14
UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    """sample: at most so many labelled rows are learned from, evenly by language, picked by a hash; a quarter of them only calibrates."""

    sample: int = 4000
    ftrl: learn.Ftrl = field(default_factory=lambda: learn.Ftrl(alpha=0.3, l1=0.05, l2=0.05, epochs=3))


def gram_counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each text (places, counts) of its n-grams of letters, a run of other signs being one gap; None without letters."""
    cp, _ = textvec.codepoints(texts)
    values = np.where(textvec.categories()[cp] == ord("L"), textvec.word_values()[cp], np.uint64(0))
    text = np.cumsum(cp == textvec.END) - (cp == textvec.END)
    keep = np.ones(len(cp), bool)
    keep[1:] = (values[1:] != 0) | (values[:-1] != 0) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    letters = np.add.reduceat(values != 0, bounds[:-1])
    hashed = []
    for n in ORDERS:
        total = np.zeros(max(0, len(values) - n + 1), np.uint64)
        for i in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + values[i : len(values) - n + 1 + i]
        total *= np.uint64(0x9E3779B97F4A7C15)
        hashed.append((total >> np.uint64(50)).astype(np.int32))
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for k in range(len(texts)):
        a, b = bounds[k], bounds[k + 1]
        if not letters[k]:
            out.append(None)
            continue
        counts = sum(np.bincount(h[a : max(a, b - n + 1)], minlength=WIDTH) for n, h in zip(ORDERS, hashed))
        places = np.flatnonzero(counts)
        out.append((places, counts[places]))
    return out


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WIDTH + 1, np.int64)
    for batch in batches:
        for chunk in textvec.chunks(batch.column("text").to_pylist()):
            for row in gram_counts(chunk):
                if row:
                    total[row[0]] += 1
                    total[WIDTH] += 1
    places = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[places])], names=["place", "n"])


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [row for chunk in textvec.chunks(batch.column("text").to_pylist()) for row in gram_counts(chunk)]
        places = pa.array([None if r is None else r[0].astype(np.int32) for r in made], pa.list_(pa.int32()))
        counts = pa.array([None if r is None else r[1].astype(np.int32) for r in made], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("label"), places, counts], names=["label", "places", "counts"])


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, row: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        x = np.log1p(row[1]) * self.idf[row[0]]
        return row[0], x / max(float(np.linalg.norm(x)), 1e-12)

    def predict(self, row: tuple[np.ndarray, np.ndarray] | None) -> tuple[str, float]:
        if row is None or not self.languages:
            return UNKNOWN, 0.0
        p = learn.softmax(learn.logits(self.weights, self.vector(row)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(df: DataFrame, params: Params | None = None) -> Model:
    """df: (id, text, label), training rows only; rows without a label or without letters teach nothing."""
    params = params or Params()
    rows = df.filter("label is not null")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    languages = sorted(sizes)
    found = rows.select("text").mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(WIDTH + 1)
    for r in found:
        frequency[r["place"]] = r["n"]
    idf = np.log((1 + frequency[WIDTH]) / (1 + frequency[:WIDTH])) + 1
    if not languages:
        return Model([], idf, np.zeros((0, WIDTH + 1)))
    each = max(1, params.sample // len(languages))
    scale = 1 << 30
    limit = F.create_map(*(x for l, n in sizes.items() for x in (F.lit(l), F.lit(min(scale, int(scale * each / n))))))
    picked = rows.filter(F.pmod(F.xxhash64("id", F.length("text")), F.lit(scale)) < limit[F.col("label")])
    sample = picked.select("label", "text").mapInArrow(_vectors, "label string, places array<int>, counts array<int>").filter("places is not null").toArrow().to_pandas()
    model = Model(languages, idf, np.zeros((len(languages), WIDTH + 1)))
    vectors = [model.vector((np.asarray(p), np.asarray(c))) for p, c in zip(sample["places"], sample["counts"])]
    labels = np.array([languages.index(x) for x in sample["label"]], np.int64)
    aside = np.random.default_rng(params.ftrl.seed).random(len(labels)) < 0.25
    fit_rows = [v for v, a in zip(vectors, aside) if not a]
    model.weights = learn.fit(fit_rows, np.eye(len(languages))[labels[~aside]], WIDTH, params.ftrl)
    scores = np.array([learn.logits(model.weights, v) for v, a in zip(vectors, aside) if a])
    model.temperature = learn.temperature(scores, labels[aside])
    return model


def identify(df: DataFrame, held_out: Column, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a model of the rows that aren't held out.

    A null text, or one without a letter, is `und` with score 0, as is every text if there is nothing to learn from.
    Rows keep their number; null and repeated ids are kept; a null id counts as held out.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), df[label_col].alias("label"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    shared = df.sparkSession.sparkContext.broadcast(train(rows.filter("not held_out").select("id", "text", "label"), params))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            made = [model.predict(row) for chunk in textvec.chunks(batch.column("text").to_pylist()) for row in gram_counts(chunk)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = rows.select(F.col("id").alias("doc_id"), "held_out", "text")
    return rows.mapInArrow(run, typed(rows, ["doc_id"], "held_out boolean, lang_pred string, score double"))
