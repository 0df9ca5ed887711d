"""Quality classifier: Bradley-Terry pairwise ranking, thresholded by a score quantile.

A document's features are byte frequencies and a few measures of repetition. Preference pairs (a document
labelled 1 over one labelled 0) give weights by logistic loss on the difference of features. On the
labelled rows the cut is put at the score quantile that separates the labels best, and scores become
probabilities by a logistic curve that passes through ``threshold`` at that cut.

It is fitted on at most ``max_labelled`` labelled rows, the first by a hash of doc_id; all else covers
all rows, and scoring is a projection without a shuffle.

Defined cases: null text counts as empty, and empty texts get a score like any other; conflicting labels
of a doc_id count as 0; labels without a document or value are left out; with labels of one kind every
score is that label's share, with none 0.5; an empty table gives an empty result; further columns of
whatever name are neither read nor changed.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import release_memory, text_of

_BYTES = 97  # printable ASCII each, and all other bytes together
DIMENSION = _BYTES + 10


def features(text: str) -> np.ndarray:
    """Byte frequencies (square roots), then measures of length, words and repetition."""
    raw = text.encode("utf-8", "replace")
    out = np.zeros(DIMENSION)
    if not raw:
        return out
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:95] = seen[32:127]
    out[95], out[96] = seen[:32].sum() + seen[127], seen[128:].sum()
    out[:_BYTES] = np.sqrt(out[:_BYTES] / len(raw))
    words = raw.split()
    n = len(words)
    letters = seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()
    out[_BYTES] = np.log1p(n) / 10
    out[_BYTES + 1] = 1.0
    if n:
        out[_BYTES + 2] = len(set(words)) / n
        out[_BYTES + 3] = sum(map(bytes.__eq__, words, words[1:])) / n
        out[_BYTES + 4] = sum(not w[-1:].isalnum() and not w[-2:-1].isalnum() and w[-1] < 128 for w in words) / n
        out[_BYTES + 5] = sum(len(w) for w in words) / n / 20
        out[_BYTES + 9] = len(set(zip(words, words[1:], words[2:]))) / n
    out[_BYTES + 6] = letters / len(raw)
    out[_BYTES + 7] = seen[65:91].sum() / max(1, letters)
    out[_BYTES + 8] = min(2.0, len(zlib.compress(raw, 1)) / len(raw))
    return out


@dataclass(frozen=True)
class Model:
    """score(x) = sigmoid(slope * (weights . x - cut) + logit(threshold)); constant when not fitted."""

    weights: tuple
    cut: float
    slope: float
    threshold: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.slope * (x @ np.array(self.weights) - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, pairs: int = 20000, ridge: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights that maximise the likelihood of sampled preferences, by Newton's method."""
    rng = np.random.default_rng(seed)
    d = better[rng.integers(0, len(better), pairs)] - worse[rng.integers(0, len(worse), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))  # of the wrong order
        gradient = d.T @ p / len(d) - ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, threshold: float) -> Model:
    if len(set(y.tolist())) < 2:
        return Model((), 0.0, 0.0, threshold, float(y.mean()) if len(y) else 0.5)
    w = bradley_terry(x[y == 1], x[y == 0])
    s = x @ w
    # The quantile, of a grid over the labelled rows, with the best balanced accuracy; mid-way in a gap.
    grid = np.unique(np.quantile(s, np.linspace(0, 1, 1001), method="higher"))
    up, down = np.sort(s[y == 1]), np.sort(s[y == 0])
    good = (len(up) - np.searchsorted(up, grid)) / len(up) + np.searchsorted(down, grid) / len(down)
    at = grid[np.argmax(good)]
    below = s[s < at]
    cut = float((at + below.max()) / 2) if len(below) else float(at)
    z, slope = s - cut, 1.0
    bias = np.log(threshold / (1 - threshold))
    for _ in range(50):  # one-dimensional Platt scaling with the curve fixed at the cut
        p = 1 / (1 + np.exp(-np.clip(slope * z + bias, -35, 35)))
        step = ((y - p) @ z - 1e-2 * slope) / ((p * (1 - p)) @ (z * z) + 1e-2)
        slope = max(1e-3, slope + float(np.clip(step, -2, 2)))
    return Model(tuple(w.tolist()), cut, slope, threshold)


def is_held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, max_labelled: int = 8000) -> Model:
    """Fits on at most max_labelled rows that are not held out."""
    known = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y")).where("_id IS NOT NULL AND _y IN (0, 1)")
    known = known.where(~is_held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    rows = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("_text")).join(F.broadcast(known), "_id")  # max_labelled ids
    rows = rows.select("_id", "_y", measured("_text").alias("_x"))
    got = rows.toPandas().sort_values("_id")
    x = np.stack(got["_x"].to_list()) if len(got) else np.zeros((0, DIMENSION))
    return fit(x, got["_y"].to_numpy(dtype=float), threshold)


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [model.score(np.stack([features(t.as_py()) for t in texts.slice(i, 256)])) for i in range(0, len(texts), 256)]
        release_memory()
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return scored(text)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, id_col, text_col, **options)
    rows = docs.select(docs[id_col].alias("doc_id"), score_column(model, text_of(docs, text_col)).alias("score"))
    return rows.select("doc_id", F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= model.threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    model = learn(docs, labels, id_col, text_col, **options)
    return docs.where(score_column(model, text_of(docs, text_col)) >= model.threshold)
