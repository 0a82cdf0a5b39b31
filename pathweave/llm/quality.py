"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows that ``labels`` marks as good; the unlabelled set is web text of the same
fold, good and bad together. A small network is fitted by the non-negative unbiased risk: the risk
of the positives taken as positive, weighted by the class prior, plus the part of the unlabelled
risk that the prior does not explain, kept from going below zero. The prior is estimated from how the
scores of the two sets compare; marks of 0 are used for nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, sampled, text_chunks
from .doc_stats import FEATURES, measure


def _inputs(x: np.ndarray) -> np.ndarray:
    """Square roots spread small shares out; the plain values stay beside them."""
    return np.concatenate([x, np.sqrt(np.clip(x, 0, None))], 1)


@dataclass
class QualityModel:
    """Scores features: standardise, one hidden layer of tanh, a logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((_inputs(x) - self.mean) / self.scale, -6, 6)
        a, b, c, d = self.weights
        return np.tanh(z @ a + b) @ c + d[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk_slopes(fp: np.ndarray, fu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk and its slopes in the margins of positives and unlabelled rows.

    With logistic loss: ``prior * mean l(fp)  +  max(0, mean l(-fu) - prior * mean l(-fp))``. Where the
    second part is below zero, the step goes up in it instead, as the method prescribes.
    """
    negative = _softplus(fu).mean() - prior * _softplus(fp).mean()
    risk = prior * _softplus(-fp).mean() + max(0.0, negative)
    up, down = _sigmoid(fu) / len(fu), prior * _sigmoid(fp) / len(fp)
    if negative < 0:
        return risk, down, -up
    return risk, -prior * _sigmoid(-fp) / len(fp) - down, up


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled scores, by the bin that bounds it best from above.

    Any set of high scores has at least ``prior`` times the positives' mass in the unlabelled set, so
    the least ratio over thresholds, with a margin for sampling error, is an estimate.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.quantile(p, np.linspace(0.02, 0.8, 40))
    above = lambda s, c: 1 - np.searchsorted(s, c, side="left") / len(s)
    slack = lambda n: np.sqrt(np.log(20) / (2 * n))
    bounds = [(above(u, c) + slack(len(u)) + slack(len(p))) / above(p, c) for c in cuts]
    best = cuts[int(np.argmin(bounds))]
    return float(np.clip(above(u, best) / above(p, best), 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 12, steps: int = 500, rate: float = 0.02, decay: float = 1e-4, seed: int = 5) -> QualityModel:
    """Fit the network by Adam on whole-sample steps."""
    both = _inputs(np.concatenate([positive, unlabelled]))
    mean, scale = both.mean(0), both.std(0) + 1e-3
    standard = lambda x: np.clip((_inputs(x) - mean) / scale, -6, 6)
    p, u = standard(positive), standard(unlabelled)
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 0.3, (p.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), np.zeros(1)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for t in range(1, steps + 1):
        hp, hu = np.tanh(p @ w[0] + w[1]), np.tanh(u @ w[0] + w[1])
        _, gp, gu = risk_slopes(hp @ w[2] + w[3][0], hu @ w[2] + w[3][0], prior)
        bp, bu = np.outer(gp, w[2]) * (1 - hp * hp), np.outer(gu, w[2]) * (1 - hu * hu)
        slopes = [p.T @ bp + u.T @ bu + decay * w[0], bp.sum(0) + bu.sum(0), hp.T @ gp + hu.T @ gu + decay * w[2], np.array([gp.sum() + gu.sum()])]
        for i, g in enumerate(slopes):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(mean, scale, w, prior)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_chunks(batch):
            _, x = measure(texts)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("mark"), values], ["mark", "x"])


def marked_features(docs: DataFrame, labels: DataFrame, max_positives: int, max_unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Marks (1, 0, or -1 for unlabelled) and features of a bounded sample of rows outside the held-out fold.

    Both bounds are on the expected number of rows; rows are chosen by a hash of their id, with no
    regard to anything else.
    """
    marks = labels.select(F.col("doc_id"), F.col("quality").alias("mark")).where(~held_out() & F.col("mark").isin(0, 1)).groupBy("doc_id").agg(F.max("mark").alias("mark"))
    rows = docs.select("doc_id", "text").where(~held_out() & F.col("text").isNotNull())
    n = rows.count()
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, len(FEATURES)))
    n_marks = max(1, marks.count())
    labelled = sampled(rows, "doc_id", max_positives / n_marks, 3).join(sampled(marks, "doc_id", max_positives / n_marks, 3), "doc_id").select("mark", "text")
    unlabelled = sampled(rows, "doc_id", max_unlabelled / n, 4).select(F.lit(-1).alias("mark"), "text")
    got = labelled.unionByName(unlabelled).mapInArrow(_features, "mark int, x array<double>").toArrow()
    marks_ = got.column("mark").to_numpy().astype(np.int64)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if len(marks_) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*x.T[::-1], marks_])  # the order rows arrive in must not matter
    return marks_[order], x[order]


def fit(docs: DataFrame, labels: DataFrame, max_positives: int = 15_000, max_unlabelled: int = 15_000) -> QualityModel:
    """Fit on at most about ``max_positives`` rows marked good and ``max_unlabelled`` of all rows.

    A row that is marked good and bad counts as good. Without a positive or an unlabelled row the model scores everything at the prior, 0.5.
    """
    mark, x = marked_features(docs, labels.where("quality = 1"), max_positives, max_unlabelled)
    p, u = x[mark == 1], x[mark == -1]
    if len(p) == 0 or len(u) == 0:
        k = 2 * len(FEATURES)
        return QualityModel(np.zeros(k), np.ones(k), [np.zeros((k, 1)), np.zeros(1), np.zeros(1), np.zeros(1)], 0.5)
    prior = estimated_prior(p, u)
    return train(p, u, prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from features: each half of both sets is scored by a model of the other half."""
    margins: list[list[np.ndarray]] = [[], []]
    for k in (0, 1):
        model = train(positive[k::2], unlabelled[k::2], 0.5, steps=200) if len(positive) > 1 and len(unlabelled) > 1 else train(positive, unlabelled, 0.5, steps=200)
        margins[0].append(model.margin(positive[1 - k :: 2]))
        margins[1].append(model.margin(unlabelled[1 - k :: 2]))
    return estimate_prior(np.concatenate(margins[0]), np.concatenate(margins[1]))


def score(docs: DataFrame, model: QualityModel, keep: list[str] | None = None, at: float = 0.7) -> DataFrame:
    """Add ``score`` and ``predicted`` to the columns ``keep`` of ``docs``; every whole text is scored.

    Null texts score as empty ones; the score of an empty text is what the model gives a text without
    words. A score of exactly ``at`` is predicted good. Repeated rows get equal scores, an empty table an
    empty result. Columns of the same names are replaced, other extra columns pass through.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "predicted int"])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                s = shared.value.score(measure(texts)[1])
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(s), pa.array((s >= at).astype(np.int32))], [*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)
