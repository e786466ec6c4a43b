"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear scorer by the non-negative unbiased risk

    prior * E_p[loss(+f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)]),

with the logistic loss. When the second term falls below zero, its gradient is turned round, as the method asks. The class
prior is the share of ones among all labelled training rows; where only ones are labelled, it is estimated from a
classifier of labelled against unlabelled texts. Features are counts of byte pairs in hashed buckets and of byte kinds, so
whole texts are read and nothing but text decides. Training takes documented, bounded samples in the order of a hash of the
ids; scoring takes every row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common, spans

BUCKETS = 512
_KINDS = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:'\"-()")):
    _KINDS[np.frombuffer(_bytes, np.uint8)] = _k + 1
_KINDS[128:] = 7
_PAIR = (spans.mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
WIDTH = BUCKETS + 8


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: square roots of the shares of byte pairs by bucket and of byte kinds; zeros for an empty text."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, WIDTH), np.float32)
    if len(data):
        pairs = _PAIR[(data[:-1].astype(np.int64) << 8) | data[1:]]
        inside = rows[:-1] == rows[1:]
        out[:, :BUCKETS] = np.bincount(rows[:-1][inside] * BUCKETS + pairs[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, BUCKETS:] = np.bincount(rows * 8 + _KINDS[data], minlength=n * 8).reshape(n, 8)
    return np.sqrt(out / np.maximum(np.diff(offsets), 1)[:, None], dtype=np.float32)


@dataclass
class Scorer:
    """A linear scorer of standardised features; ``prior`` is the class prior that it was trained with."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        f = ((x - self.mean) * self.scale).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(f, -500, 500)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _descend(x: np.ndarray, slope, steps: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam over all rows; ``slope`` gives the derivative of the risk by each row's value."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        d = slope(x @ w[:-1].astype(np.float32) + w[-1])
        g = np.append((d.astype(np.float32) @ x) + decay * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _estimated_prior(x: np.ndarray, n: int, steps: int, rate: float) -> float:
    """The class prior from ``n`` positive and the other, unlabelled rows.

    A classifier of positive against unlabelled rows gives g with odds of n * p(x | 1) to m * p(x); where only class 1 lies,
    that is n / (m * prior). It is read off on each half of the positives by a classifier of the other half.
    """
    rows, found = np.arange(len(x)), []
    for half in (0, 1):
        use = rows % 2 == half
        target = (rows[use] < n).astype(float)
        w, b = _descend(x[use], lambda f: (_sigmoid(f) - target) / len(target), steps, rate, 0.1)  # noqa: B023
        f = x[~use & (rows < n)] @ w.astype(np.float32) + b
        if len(f):
            found.append(float(n / (len(x) - n) / np.exp(np.clip(np.median(f), -20, 20))))
    return float(np.mean(found)) if found else 0.5


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 300, rate: float = 0.03, decay: float = 1e-4) -> Scorer:
    """Minimise the non-negative risk; a prior of None is estimated from the two samples."""
    n, m = len(positive), len(unlabelled)
    if not n or not m:  # nothing to learn from: everything is as likely as the prior
        p = min(max(0.5 if prior is None else prior, 1e-3), 1 - 1e-3)
        return Scorer(np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), np.zeros(WIDTH), float(np.log(p / (1 - p))), p)
    x = np.concatenate([positive, unlabelled])
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    scale = np.where(deviation > 1e-6, 1 / np.maximum(deviation, 1e-6), 0).astype(np.float32)
    x = (x - mean) * scale
    if prior is None:
        prior = _estimated_prior(x, n, steps, rate)
    prior = min(max(prior, 0.01), 0.99)

    def slope(f):
        p, u = f[:n], f[n:]
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        sign = 1.0 if negative >= 0 else -1.0
        up = -_sigmoid(-p) * prior / n * (negative >= 0)  # the positive part rests while the other is turned round
        return np.concatenate([up - sign * prior / n * _sigmoid(p), sign / m * _sigmoid(u)])

    w, b = _descend(x, slope, steps, rate, decay)
    return Scorer(mean, scale, w, b, prior)


def _sample(docs: DataFrame, ids: DataFrame, rows: int, column: str) -> np.ndarray:
    """Features of the ``rows`` documents that come first by a hash of their ids."""
    some = ids.where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)  # a documented bound on what the driver gets
    texts = docs.join(F.broadcast(some), "id", "left_semi").select("text")

    def run(batches):
        common.release()
        for batch in batches:
            for part in common.text_runs(batch, "text"):
                x = features(*common.text_bytes(part.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    found = texts.mapInArrow(run, "x binary").toArrow()["x"].to_pylist()
    return np.frombuffer(b"".join(sorted(found)), np.float32).reshape(-1, WIDTH).copy()


def fit(docs: DataFrame, labels: DataFrame, training: Column | None = None, column: str = "text", id_column: str = "doc_id", label_column: str = "quality",
        positives: int = 6000, unlabelled: int = 12000, prior: float | None = None) -> Scorer:
    """A scorer from at most ``positives`` texts labelled 1 and ``unlabelled`` texts of any kind, both among ``training`` rows.

    ``training`` is a condition on ``id`` (all rows without it). Null labels, labels of unknown ids and null ids are not used.
    """
    use = F.lit(True) if training is None else training
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("text")).where(use)
    marks = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").alias("label")).where(use)
    counts = {r[0]: r[1] for r in marks.where("label in (0, 1)").groupBy("label").count().collect()}
    if prior is None and counts.get(0) and counts.get(1):
        prior = counts[1] / (counts[0] + counts[1])
    p = _sample(texts, marks.where("label = 1").select("id"), positives, column)
    u = _sample(texts, texts.select("id"), unlabelled, column)
    return train(p, u, prior)


def score(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, column: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``); null and empty texts are scored too.

    Scores are rounded to nine digits, so that they do not depend on how rows are batched. Columns named like the outputs
    are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(part):
        s = np.round(shared.value.score(features(*common.text_bytes(part.column(part.schema.get_field_index(column))))), 9)
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    source = docs.withColumn(column, F.col(f"`{column}`").cast("string"))
    return common.append(source, column, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], work)
