"""Toxicity by a classifier chain with out-of-fold predictions.

The label columns are predicted in a fixed order by linear (logistic) models; each model sees the
text's features and the probabilities of the categories before it. While training, those
probabilities come from models that haven't seen the row: rows are dealt into folds by their text, so
copies share a fold, and each fold is predicted by a model of the other folds, their choice of
features and their scaling included. The final models,
trained on all rows with the out-of-fold probabilities of the earlier categories, are applied to the
documents one category after the other.

Features are the presence of words and of word beginnings (4 to 6 letters, which carry inflected
forms), chosen per category by a chi-squared statistic, and a few measures of the whole text. Training takes a
bounded sample: at most ``SAMPLE`` labelled documents, the first by the hash of doc_id. The threshold
of the last category is the one at which the out-of-fold predictions have the best F1. Everything
else covers every document's whole text.

Cases: a null or empty text has no words; labels with a null, without a document, or repeated for a
doc_id (the least label counts) are left out; a category with one class only, or no labels at all, gives
its smoothed base rate (0 without labels); repeated rows get equal scores; an empty table gives no
rows. Extra columns are carried by ``reject`` and not read by ``score``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.io import written

#: Labelled documents to train on, features per category, folds, and the threshold where none can be chosen.
SAMPLE, FEATURES, FOLDS, THRESHOLD = 8000, 160, 3, 0.5

#: The least chi-squared statistic of a feature, and the least number of sampled documents that hold it.
LEAST_CHI2, LEAST_DOCS = 20.0, 4

ORDER = ("quality", "toxic")

BEGINNINGS = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")

DENSE = 6


def features(text: str | None) -> tuple[set[str], list[float]]:
    """Words and, behind a hyphen, word beginnings; and measures of the whole text."""
    text = text or ""
    found = _WORD.findall(text.lower())
    words = set(found)
    out = set(words)
    for n in BEGINNINGS:
        out.update({w[:n] + "-" for w in words if len(w) > n})
    n, k = max(len(text), 1), max(len(found), 1)
    letters = sum(map(len, found))
    spaces = text.count(" ") + text.count("\n")
    return out, [np.log1p(len(text)), letters / n, spaces / n, len(words) / k, letters / k, text.count("\n") / k]


@dataclass
class Chain:
    """Linear models in order; column 0 is the intercept, then features, measures, earlier categories."""

    order: tuple[str, ...]
    vocabulary: dict[str, int] = field(default_factory=dict)
    centre: np.ndarray = field(default_factory=lambda: np.zeros(DENSE))
    scale: np.ndarray = field(default_factory=lambda: np.ones(DENSE))
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = THRESHOLD  # of the last category
    out_of_fold: np.ndarray | None = None  # of the training rows, for held-out figures

    def predict(self, text: str | None) -> list[float]:
        words, dense = features(text)
        on = [self.vocabulary[w] for w in words & self.vocabulary.keys()]
        measures = np.clip((np.array(dense) - self.centre) / self.scale, -5, 5)
        out: list[float] = []
        for w in self.weights:
            if not len(w):
                out.append(0.0)
                continue
            m = 1 + len(self.vocabulary)
            z = w[0] + sum(w[1 + i] for i in on) + measures @ w[m : m + DENSE] + np.array(out) @ w[m + DENSE :]
            out.append(float(1 / (1 + np.exp(-np.clip(z, -40, 40)))))
        return out


def fit_linear(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 200) -> np.ndarray:
    """Logistic regression by accelerated gradient steps over columns scaled to one size; the intercept is free."""
    if not len(y):
        return np.zeros(0)
    base = (y.sum() + 0.5) / (len(y) + 1)
    w = np.zeros(x.shape[1], np.float32)
    w[0] = np.log(base / (1 - base))
    if y.min() == y.max():
        return w
    size = np.sqrt(np.einsum("ij,ij->j", x, x) / len(y)) + np.float32(1e-3)
    x = x / size
    v = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(15):  # the largest eigenvalue bounds the step
        v = x.T @ (x @ (v / np.linalg.norm(v)))
    step = np.float32(3.0 / (float(np.linalg.norm(v)) / len(y) + penalty / len(y)))
    shrink = np.full(x.shape[1], penalty / len(y), np.float32)
    shrink[0] = 0
    at, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        new = at - step * (x.T @ (p - y) / np.float32(len(y)) + shrink * at)
        then = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        at = new + np.float32((momentum - 1) / then) * (new - w)
        w, momentum = new, then
    return w / size


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the thresholds at which out-of-fold predictions reach their best F1."""
    if not y.any() or y.all():
        return THRESHOLD
    grid = np.linspace(0.02, 0.98, 97)
    hits = np.array([((p >= t) & (y == 1)).sum() for t in grid])
    f1 = 2 * hits / (np.array([(p >= t).sum() for t in grid]) + y.sum())
    return float(np.median(grid[f1 >= f1.max() - 1e-9]))


def sampled(docs: DataFrame, labels: DataFrame, order: tuple[str, ...], sample: int) -> DataFrame:
    """The training rows with their features, one per labelled doc_id and at most ``sample``, so their ids may be broadcast.

    Of rows that repeat a doc_id the one with the least hash of its text counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in order)).dropna()
    known = known.groupBy("doc_id").agg(F.min(F.struct(*order)).alias("y")).select("doc_id", "y.*")
    known = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", *order).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", *order, F.col("t.text").alias("text"))
    schema = "fold int, dense array<double>, words array<string>, " + ", ".join(f"`{c}` int" for c in order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = part.column("text").to_pylist()
                made = [features(t) for t in texts]
                columns = [
                    pa.array([crc32((t or "").encode("utf-8", "surrogatepass")) % FOLDS for t in texts], pa.int32()),
                    pa.array([d for _, d in made], pa.list_(pa.float64())),
                    pa.array([list(w) for w, _ in made], pa.list_(pa.string())),
                    *(part.column(c) for c in order),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["fold", "dense", "words", *order])

    return written(rows.mapInArrow(run, schema), "features")


def choose(rows: DataFrame, order: tuple[str, ...], most: int) -> list[str]:
    """The features that tell each category's classes apart best, at most ``most`` per category."""
    total = rows.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in order)).first()
    seen = rows.select(*order, F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in order))
    out: set[str] = set()
    for c in order:
        n, k = float(total.n), float(total[c] or 0)
        if not 0 < k < n:
            continue
        here, both = F.col("n").cast("double"), F.col(c).cast("double")
        odds = n * (both * (n - here - k + both) - (here - both) * (k - both)) ** 2
        chi2 = odds / (here * (n - here) * k * (n - k))
        best = seen.filter((F.col("n") >= LEAST_DOCS) & (F.col("n") < total.n)).select("word", chi2.alias("chi2")).filter(F.col("chi2") >= LEAST_CHI2)
        out |= {r.word for r in best.orderBy(F.desc("chi2"), "word").limit(most).collect()}
    return sorted(out)


@dataclass
class Design:
    """What turns a training row into a model's columns: a vocabulary, and the measures' centre and scale."""

    vocabulary: dict[str, int]
    centre: np.ndarray
    scale: np.ndarray

    def rows(self, words: list[list[str]], dense: np.ndarray) -> np.ndarray:
        x = np.zeros((len(words), 1 + len(self.vocabulary) + DENSE), np.float32)
        x[:, 0] = 1
        for i, own in enumerate(words):
            x[i, [1 + self.vocabulary[w] for w in own if w in self.vocabulary]] = 1
        x[:, 1 + len(self.vocabulary) :] = np.clip((dense - self.centre) / self.scale, -5, 5)
        return x


def designed(words: list[str], dense: np.ndarray) -> Design:
    centre, scale = (dense.mean(0), np.maximum(dense.std(0), 1e-6)) if len(dense) else (np.zeros(DENSE), np.ones(DENSE))
    return Design({w: i for i, w in enumerate(words)}, centre, scale)


def train(docs: DataFrame, labels: DataFrame, order: tuple[str, ...] = ORDER, sample: int = SAMPLE, most: int = FEATURES) -> Chain:
    """The chain, fitted on the driver from the sampled rows' chosen features.

    A fold's rows take no part in the model that predicts them: features are chosen, and measures
    centred and scaled, by the other folds' rows only.
    """
    rows = sampled(docs, labels, order, sample)
    words = choose(rows, order, most)
    without = [choose(rows.filter(F.col("fold") != k), order, most) for k in range(FOLDS)]
    wanted = sorted({w for chosen in (words, *without) for w in chosen})
    kept = F.array_intersect("words", F.array(*map(F.lit, wanted))) if wanted else F.expr("array()").cast("array<string>")
    held = rows.select("fold", "dense", kept.alias("words"), *order).collect()
    chain = Chain(order)
    if not held:
        chain.weights = [np.zeros(0) for _ in order]
        return chain
    own, dense, fold = [r.words for r in held], np.array([r.dense for r in held]), np.array([r.fold for r in held])
    whole = designed(words, dense)
    chain.vocabulary, chain.centre, chain.scale = whole.vocabulary, whole.centre, whole.scale
    x = whole.rows(own, dense)
    folds = [designed(chosen, dense[fold != k]).rows(own, dense) for k, chosen in enumerate(without)]
    earlier = np.zeros((len(held), 0), np.float32)
    for c in order:
        y = np.array([r[c] for r in held], np.float32)
        p = np.zeros((len(held), 1), np.float32)
        for k, each in enumerate(folds):
            out = fold == k
            if out.any():
                each = np.hstack([each, earlier])
                w = fit_linear(each[~out], y[~out])
                p[out, 0] = 1 / (1 + np.exp(-np.clip(each[out] @ w, -40, 40))) if len(w) else y.mean()
        chain.weights.append(fit_linear(np.hstack([x, earlier]), y))
        earlier = np.hstack([earlier, p])
    chain.out_of_fold = earlier
    chain.threshold = best_threshold(earlier[:, -1], y)
    return chain


def score(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """doc_id, the probability of each category, and whether the last one reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES words and weights per category
    threshold = chain.threshold if threshold is None else threshold
    names = [f"p_{c}" for c in chain.order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.array([model.value.predict(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(names))
            columns = [batch.column("doc_id"), *map(pa.array, p.T), pa.array(p[:, -1] >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, chain.order[-1]])

    schema = "doc_id long, " + ", ".join(f"`{n}` double" for n in names) + f", `{chain.order[-1]}` boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def reject(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """The documents whose last category stays below the threshold, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    threshold = chain.threshold if threshold is None else threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [model.value.predict(t)[-1] < threshold for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
