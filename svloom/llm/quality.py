"""Document quality by a regularised quadratic discriminant.

Documents become a vector of transformed statistics (smoothed log odds and logarithms, so that short texts
stay near the middle). Each class has a mean and a covariance, shrunk towards the pooled covariance and its
diagonal; the score is the logistic of the difference of the two log densities, from Mahalanobis distances
by inverse Cholesky factors that are computed once and sent with the task.

Class counts, sums and cross products are summed over all labelled training rows on the executors; the
driver gets one row for each class and entry of the moment matrix.

Defined cases: null and empty texts have the statistics of an empty text and a score; without labelled
training rows the score is 0.5, with one class alone it is 1 or 0 by that class; null labels are ignored;
rows that repeat are scored row by row, and a doc_id labelled several times counts as often; a null doc_id
is scored and never held out; an empty table gives an empty result; further columns are ignored by the
scores and kept by keep_good, whatever their names.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import Workspace, small, text_hash

THRESHOLD = 0.3
SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.10, 0.05, 1e-3

_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LOWER = ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_SPACE = (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13))
_STOP = np.isin(_ASCII, [ord(c) for c in ".,;:'\"-()?"])
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _STOP)
_KINDS = np.stack([_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SYMBOL], 1).astype(np.float64)

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper_odds", "digit_odds", "symbol_odds", "stop_odds", "space_odds",
    "repeat_odds", "pair_odds", "vocabulary", "bar_odds", "line_words", "entropy", "shout_odds",
)


def _odds(count: float, total: float, prior: float, strength: float = 20.0) -> float:
    """Log odds of a share, drawn to prior where total is small."""
    p = (count + strength * prior) / (total + strength)
    return math.log(p / (1.0 - p)) if 0.0 < p < 1.0 else (12.0 if p >= 1.0 else -12.0)


def statistics(payload: bytes) -> list[float]:
    """The vector of one text, from its UTF-8 bytes."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(np.float64)
    upper, lower, digit, space, stop, symbol = (counts @ _KINDS).tolist()
    n, words = float(len(payload)), payload.split()
    w = len(words)
    solid = counts[counts > 0] / max(n, 1.0)
    repeats = sum(map(operator.eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    vocabulary = len(set(words))
    return [
        math.log1p(n),
        math.log1p(w),
        math.log((n - space + 20.0) / (w + 4.0)),
        _odds(upper, upper + lower, 0.04, 80.0),
        _odds(digit, n, 0.005),
        _odds(symbol, n, 0.003),
        _odds(stop, n, 0.03),
        _odds(space, n, 0.16),
        _odds(repeats, w, 0.01),
        _odds(max(0, w - 1 - pairs), w, 0.03),
        math.log((vocabulary + 5.0) / (w + 5.0)) / math.log(w + 10.0),
        _odds(words.count(b"|"), w, 0.005),
        math.log((w + 10.0) / (counts[10] + 1.0 + 10.0 / 60.0)),
        float(-(solid * np.log(solid)).sum()) if n else 3.0,
        _odds(counts[33], n, 0.002),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and features for every row of docs; the features are of the text alone."""

    def compute(batches):
        for batch in batches:
            rows = np.array([statistics(t.as_py() or b"") for t in batch.column(1).cast(pa.binary())], np.float64).reshape(-1, len(STATISTICS))
            offsets = pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], names=["doc_id", "text_hash", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash")).mapInArrow(compute, f"doc_id {kind}, text_hash long, features array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = (x - mean) @ factor.T
            logs.append(offset - 0.5 * (z * z).sum(1))
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def moments(labelled: DataFrame) -> dict[int, np.ndarray]:
    """label to the sums of (1, x)(1, x)' over labelled (label, features): partial sums in each task, then by entry."""
    d = len(STATISTICS) + 1

    def partial(batches):
        total = np.zeros((2, d, d))
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, d - 1)
            x, y = np.hstack([np.ones((len(x), 1)), x]), np.array(batch.column(0).to_pylist())
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel())], names=["entry", "value"])

    rows = labelled.mapInArrow(partial, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(2 * d * d)
    for entry, value in rows:
        out[entry] = value
    return dict(enumerate(out.reshape(2, d, d)))


def fit(labelled: DataFrame, shrink_pooled: float = SHRINK_POOLED, shrink_diagonal: float = SHRINK_DIAGONAL) -> Discriminant:
    sums = moments(labelled)
    counts = [sums[k][0, 0] for k in (0, 1)]
    if min(counts) < 1:
        return Discriminant([], [], [], 0.5 if not max(counts) else float(counts[1] > 0))
    means = [sums[k][0, 1:] / counts[k] for k in (0, 1)]
    covs = [sums[k][1:, 1:] / counts[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / sum(counts)
    factors, offsets = [], []
    for k in (0, 1):
        cov = (1 - shrink_pooled) * covs[k] + shrink_pooled * pooled
        cov = (1 - shrink_diagonal) * cov + shrink_diagonal * np.diag(np.diag(cov)) + RIDGE * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        offsets.append(math.log(counts[k] / sum(counts)) - float(np.log(np.diag(lower)).sum()))
    return Discriminant(means, factors, offsets)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, space: Workspace | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, text_hash for every row of docs; labels (doc_id, quality) teach where not held out."""
    space = space or Workspace(docs.sparkSession, "quality")
    features = space.save(document_statistics(docs).withColumn("held_out", held_out(F.col("doc_id"))), "features")
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label"))
    labelled = features.filter(~F.col("held_out")).join(known, F.col("doc_id") == F.col("__id")).select("label", "features")
    model = fit(labelled)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(model.score(x))], names=["doc_id", "held_out", "text_hash", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = features.select("doc_id", "features", "held_out", "text_hash").mapInArrow(score, f"doc_id {kind}, held_out boolean, text_hash long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected; a row is known by its doc_id and its text's hash."""
    with Workspace(docs.sparkSession, "quality") as space:
        scored = score_documents(docs, labels, threshold, space)
        bad = scored.filter("predicted = 0").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
        bad = small(Workspace(docs.sparkSession, "rejected").save(bad, "rejected"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]) & (text_hash(docs["text"]) == bad["__hash"]), "left_anti")
