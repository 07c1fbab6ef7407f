"""A regularised quadratic discriminant over transformed document statistics.

One pass over the whole texts yields features (logarithms of sizes, roots of rates). Class means and covariances
come from sums over all labelled rows, which are added per task and class before the shuffle. A class's covariance
is shrunk towards the pooled one by TO_POOLED and then towards a multiple of the identity by TO_IDENTITY. Scores
are the posterior probability of label 1 from Mahalanobis log densities; the Cholesky factors are inverted once
and travel with the model.

Defined results: null and empty texts have features of all zeros and get a score like any other; if a class has
no rows, every score is the share of label 1 (0.5 without any labels); null labels are not learned from; repeated
rows score alike; extra columns are never read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, utf8_views
from .quality_rules import COUNTS, count_text

TO_POOLED, TO_IDENTITY = 0.2, 0.02
#: Scores from here on predict label 1.
ACCEPT = 0.7
#: Quotients of the byte counts below by the number of words, besides those of the rule counts.
MARKS = {"digit": b"0123456789", "stop": b".", "comma": b",", "line": b"\n", "bar": b"|", "mark": b"#*$%&<>", "shout": b"!?", "link": b"/@_=+"}
FEATURES = ("words", "chars", "length", "symbol", "upper", "dup", "repeat", "stutter", "per_line", *MARKS)

_MARK = np.zeros((256, len(MARKS)))
for _i, _bytes in enumerate(MARKS.values()):
    _MARK[list(_bytes), _i] = 1


def features(text: np.ndarray | None) -> np.ndarray:
    """FEATURES of one text."""
    c = dict(zip(COUNTS, count_text(text), strict=True))
    words, chars, lines = max(c["n_words"], 1), max(c["word_chars"], 1), max(c["n_lines"], 1)
    marks = np.bincount(text, minlength=256) @ _MARK if text is not None and len(text) else np.zeros(len(MARKS))
    rates = [c["n_symbols"] / chars, c["n_upper"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_stutter"] / words]
    head = [np.log1p(c["n_words"]), np.log1p(c["word_chars"]), np.log1p(c["word_chars"] / words), *np.sqrt(rates), np.log1p(c["n_words"] / lines)]
    return np.concatenate([head, np.sqrt(marks / words)])


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>)"""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = pa.array([features(t) for t in utf8_views(batch.column("text"))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), batches, f"doc_id {kind}, x array<double>")


@dataclass
class Discriminant:
    prior: float  # of label 1
    mean: np.ndarray | None = None  # (class, feature)
    whiten: np.ndarray | None = None  # inverted Cholesky factors, (class, feature, feature)
    log_det: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), self.prior)
        log_density = np.stack([-0.5 * (((x - self.mean[c]) @ self.whiten[c].T) ** 2).sum(axis=1) - 0.5 * self.log_det[c] for c in (0, 1)])
        margin = log_density[1] - log_density[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def moments(labelled: DataFrame) -> DataFrame:
    """labelled (x, label) -> (label, at, total): sums of 1, x and the products x[i] * x[j], i <= j, per class."""
    p = len(FEATURES)
    upper = np.triu_indices(p)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + p + len(upper[0])))
        for batch in stream:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[label == c]
                sums[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
        size = sums.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], size), pa.int32()), pa.array(np.tile(np.arange(size), 2), pa.int32()), pa.array(sums.ravel())], names=["label", "at", "total"])

    return map_arrow(labelled.select("x", F.col("label").cast("int").alias("label")), batches, "label int, at int, total double").groupBy("label", "at").agg(F.sum("total").alias("total"))


def fit(labelled: DataFrame) -> Discriminant:
    """labelled: (x, label 0 or 1). The driver gets two classes' moments."""
    p = len(FEATURES)
    upper = np.triu_indices(p)
    sums = np.zeros((2, 1 + p + len(upper[0])))
    for r in moments(labelled.filter(F.col("label").isin(0, 1))).collect():
        sums[r["label"], r["at"]] = r["total"]
    n = sums[:, 0]
    if not n.sum():
        return Discriminant(0.5)
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()))
    mean = sums[:, 1 : 1 + p] / n[:, None]
    scatter = np.zeros((2, p, p))
    for c in (0, 1):
        second = np.zeros((p, p))
        second[upper] = sums[c, 1 + p :]
        second = second + np.triu(second, 1).T
        scatter[c] = second - n[c] * np.outer(mean[c], mean[c])
    pooled = scatter.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    unit = np.outer(scale, scale)
    whiten, log_det = np.zeros((2, p, p)), np.zeros(2)
    for c in (0, 1):
        own = (1 - TO_POOLED) * scatter[c] / n[c] / unit + TO_POOLED * pooled / unit
        shrunk = (1 - TO_IDENTITY) * own + TO_IDENTITY * np.trace(own) / p * np.eye(p) + 1e-9 * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        whiten[c] = np.linalg.inv(factor) / scale[None, :]
        log_det[c] = 2 * np.log(np.diag(factor)).sum() + 2 * np.log(scale).sum()
    return Discriminant(float(n[1] / n.sum()), mean, whiten, log_det)


def score(featured: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, x) -> (doc_id, score, predicted)"""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = featured.schema["doc_id"].dataType.simpleString()
    return map_arrow(featured.select("doc_id", "x"), batches, f"doc_id {kind}, score double, predicted int")
