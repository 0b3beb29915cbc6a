"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear (logistic) models over word features; each
model also sees the probabilities of the earlier categories. In training these are out-of-fold:
every text's earlier probability comes from a model that has not seen it, so that later models do
not lean on overfitted inputs. In scoring they come from models fitted on all training texts. The
out-of-fold probabilities of the last category give the default threshold: it leaves the share
``SPARED`` of the negative training texts alone.

Features of a text are its distinct words and their first four and five characters, hashed into
``DIMENSIONS``; presence, not frequency, counts. A feature in fewer than ``MIN_TEXTS`` training texts
is left out. Each text is scaled to unit length: its pull on the weights does not grow with its
number of words. Within a fit a feature counts by how far its shares of the positive and of the
negative texts are apart, so the many words of a long text do not swamp the few that tell.

The chain is fitted on a bounded, documented sample: at most ``max_labelled`` labelled texts, those
of least id hash.

Defined results: a null label is the negative class; a null or empty text has no features and the
probability of the intercept; without labels, or with one class only, the probability is that
class's share (0 without labels); of repeated labels for an id each counts, of repeated documents of
a labelled id the least text is learned from; a null ``doc_id`` is scored and not learned from; whole texts are read; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.columns import documents
from sparquill.llm.hashing import U, mix

DIMENSIONS = 1 << 18
MIN_TEXTS = 5
MAX_LABELLED = 8000
FOLDS = 5
STEPS = 100
PENALTY = 1e-5
SPARED = 0.998  # share of the negative training texts that the default threshold leaves alone
CACHE_WORDS = 300_000

# ASCII other than letters, taken as spaces.
_BREAK = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))

_features: dict[bytes, tuple[int, ...]] = {}


def _hashed(parts: list[bytes]) -> tuple[int, ...]:
    import zlib

    return tuple((zlib.crc32(p) * 0x9E3779B1 >> 7) % DIMENSIONS for p in parts)


def features(text: str) -> np.ndarray:
    """Sorted distinct feature indexes of a text."""
    found: set[int] = set()
    for w in set(text.lower().encode().translate(_BREAK).split()):
        hit = _features.get(w)
        if hit is None:
            if len(_features) >= CACHE_WORDS:
                _features.clear()
            stem = w.decode()
            hit = _features[w] = _hashed([b"w" + w, *(f"{k}{stem[:k]}".encode() for k in (4, 5) if len(stem) >= k)])
        found.update(hit)
    return np.fromiter(sorted(found), np.int64, len(found))


class Sparse:
    """Rows of present features, scaled to unit length, with dense extra columns."""

    def __init__(self, rows: list[np.ndarray], extra: np.ndarray, width: int):
        sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.scale = 1 / np.sqrt(np.maximum(sizes, 1))
        self.extra, self.width, self.n = extra, width, len(rows)
        self.filled = np.flatnonzero(sizes)
        self.first = (np.cumsum(sizes) - sizes)[self.filled]
        order = np.argsort(self.at, kind="stable")
        self.row = np.repeat(np.arange(len(rows)), sizes)[order]  # by feature
        self.used, self.first_of = np.unique(self.at[order], return_index=True)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Scores; ``w`` holds the features' weights, then the extra columns', then the intercept."""
        out = self.extra @ w[self.width : -1] + w[-1]
        if len(self.at):
            out[self.filled] += self.scale[self.filled] * np.add.reduceat(w[self.at], self.first)
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        if len(self.at):
            out[self.used] = np.add.reduceat((g * self.scale)[self.row], self.first_of)
        return np.concatenate((out, self.extra.T @ g, [g.sum()]))


    def telling(self, y: np.ndarray) -> np.ndarray:
        """How far apart a feature's shares of the positive and of the negative rows are: the size of their log ratio, each count plus one."""
        out = np.zeros(self.width)
        if len(self.at):
            positive = np.add.reduceat(y[self.row], self.first_of)
            negative = np.diff(self.first_of, append=len(self.row)) - positive
            out[self.used] = np.abs(np.log((positive + 1) / (y.sum() + 2)) - np.log((negative + 1) / (self.n - y.sum() + 2)))
        return out


def logistic(x: Sparse, y: np.ndarray, steps: int = STEPS, rate: float = 1.0, penalty: float = PENALTY) -> np.ndarray:
    """Weights of a penalised logistic model, by full-batch Adagrad; features count by how telling they are."""
    w, past = np.zeros(x.width + x.extra.shape[1] + 1), 1e-8
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 1e-6
    w[-1] = np.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return w
    size = np.append(x.telling(y), np.ones(x.extra.shape[1] + 1))
    for _ in range(steps):
        g = size * x.back((probability(x.dot(size * w)) - y) / x.n) + penalty * np.append(w[:-1], 0)
        past = past + g * g
        w -= rate * g / np.sqrt(past)
    return size * w


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Fits:
    """The models of one category after the other, over the features that enough rows have."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS):
        seen = np.bincount(np.concatenate(rows), minlength=DIMENSIONS) if rows else np.zeros(DIMENSIONS)
        kept = np.flatnonzero(seen >= MIN_TEXTS)
        self.place = np.full(DIMENSIONS, -1, np.int32)
        self.place[kept] = np.arange(len(kept))
        self.rows, self.labels, self.width, self.folds = [p[p >= 0] for p in (self.place[r] for r in rows)], labels, len(kept), folds
        self.fold = np.arange(len(rows)) % folds

    def some(self, of: np.ndarray, earlier: np.ndarray) -> Sparse:
        return Sparse([self.rows[i] for i in of], earlier[of], self.width)

    def model(self, j: int, left_out: int, earlier: np.ndarray) -> np.ndarray:
        """Weights for category ``j`` from all rows but those of fold ``left_out`` (no fold: -1)."""
        inside = np.flatnonzero(self.fold != left_out)
        return logistic(self.some(inside, earlier), self.labels[inside, j])

    def every(self, j: int, earlier: np.ndarray) -> list[np.ndarray]:
        """The models of category ``j``: without each fold in turn, then from all rows."""
        return [self.model(j, f, earlier) for f in (*range(self.folds), -1)]


class SparkFits(Fits):
    """The same, each model in a task of its own."""

    def __init__(self, spark: SparkSession, rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS):
        super().__init__(rows, labels, folds)
        plain = Fits.__new__(Fits)
        vars(plain).update(vars(self))
        self.spark, self.shared = spark, spark.sparkContext.broadcast(plain)  # max_labelled texts at most

    def every(self, j: int, earlier: np.ndarray) -> list[np.ndarray]:
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    w = shared.value.model(j, k if k < shared.value.folds else -1, earlier)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([w.tobytes()])], names=["k", "w"])

        n = self.folds + 1
        return [np.frombuffer(r.w, np.float64) for r in sorted(self.spark.range(n, numPartitions=n).mapInArrow(run, "k long, w binary").collect(), key=lambda r: r.k)]


def fit_chain(fits: Fits) -> dict:
    """Models of the columns of the labels in order, the out-of-fold probabilities, and the default threshold."""
    n, k = fits.labels.shape
    earlier, models = np.zeros((n, 0)), []
    for j in range(k):
        *without, whole = fits.every(j, earlier)
        out = np.zeros(n)
        for f, w in enumerate(without):
            outside = np.flatnonzero(fits.fold == f)
            out[outside] = probability(fits.some(outside, earlier).dot(w))
        models.append(whole)
        earlier = np.column_stack((earlier, out))
    negative = earlier[fits.labels[:, -1] == 0, -1]
    threshold = float(np.quantile(negative, SPARED)) if 0 < len(negative) < n else 0.5
    return {"place": fits.place, "width": fits.width, "models": models, "threshold": threshold, "out_of_fold": earlier}


def chain_probabilities(rows: list[np.ndarray], chain: dict) -> np.ndarray:
    """Probabilities of all categories, one column each."""
    rows = [p[p >= 0] for p in (chain["place"][r] for r in rows)]
    earlier = np.zeros((len(rows), 0))
    for w in chain["models"]:
        earlier = np.column_stack((earlier, probability(Sparse(rows, earlier, chain["width"]).dot(w))))
    return earlier


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], max_labelled: int = MAX_LABELLED) -> dict:
    """A chain over ``categories`` (name: SQL condition on a row of ``labels``), fitted on at most ``max_labelled`` texts."""
    marked = labels.select(F.col("doc_id").cast("long").alias("label_id"), *(F.coalesce(F.expr(c).cast("int"), F.lit(0)).alias(f"y{i}") for i, c in enumerate(categories.values())))
    sample = marked.filter("label_id IS NOT NULL").orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    # One text an id, so that no more texts than labels are gathered, however often an id is repeated.
    ids = sample.select("label_id").distinct()
    one = documents(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id"), "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    joined = one.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.int32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[3:]], names=["doc_id", "f", *names])

    names = [f"y{i}" for i in range(len(categories))]
    got = joined.select("doc_id", "text", "label_id", *names).mapInArrow(run, "doc_id long, f binary, " + ", ".join(f"{c} int" for c in names)).collect()
    got.sort(key=lambda r: (int(mix(np.array([r.doc_id], np.int64).view(U))[0]), r.f))
    chain = fit_chain(SparkFits(docs.sparkSession, [np.frombuffer(r.f, np.int32) for r in got], np.array([[r[c] for c in names] for r in got], float).reshape(len(got), len(names))))
    return chain | {"categories": list(categories)}


def toxicity(docs: DataFrame, chain: dict, threshold: float | None = None, rows: int = 256) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` for each category, and ``flagged``: the last one exceeds ``threshold`` (the chain's own by default)."""
    threshold = chain["threshold"] if threshold is None else threshold
    chain = {k: v for k, v in chain.items() if k != "out_of_fold"}
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # its size is a parameter
    names = [f"p_{c}" for c in chain["categories"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                p = chain_probabilities([features(t) for t in batch.column(1)[at : at + rows].to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + rows], *(pa.array(c) for c in p.T), pa.array(p[:, -1] > threshold)], names=["doc_id", *names, "flagged"])

    return documents(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names) + ", flagged boolean")
