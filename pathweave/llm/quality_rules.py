"""Quality rules: exact base counts, and boosted trees over document statistics.

The trees are grown on histograms of binned statistics with logistic loss; a split on a statistic
with a stated direction is taken only if it keeps the model monotonic in it, and the children's
values are bounded by the middle of the two for all that grows below. The finished trees lie one
after the other in flat numpy arrays, and all rows walk all trees level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks
from .doc_stats import BASE, FEATURES, measure
from .quality import marked_features

#: Direction of the badness of a text in a statistic: more of these never makes a text better.
RISING = {"symbol_share", "word_symbols", "upper_share", "shout_share", "dup_line_share", "repeat_word_share", "stutter_share", "capital_words"}


@dataclass
class FlatTrees:
    """Node arrays: ``feature`` is -1 at a leaf, ``left`` and ``right`` are places in the same arrays."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of all trees' leaves for each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(f < 0, at, go)
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, directions: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0, least: float = 2.0) -> FlatTrees:
    """Fit ``y`` (0 or 1) by boosted trees; ``directions`` has 1, -1 or 0 for each column of ``x``.

    Without rows of both classes the result has no tree and its margin is the smoothed class share.
    """
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    start = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        margin = np.full(n, start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(len(nodes))
            nodes.append([-1, 0, -1, -1, 0])
            step = np.zeros(n)
            open_ = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
            while open_:
                at, rows, low, high, level = open_.pop()
                gs, hs = g[rows], h[rows]
                value = float(np.clip(-gs.sum() / (hs.sum() + ridge), low, high))
                nodes[at][4] = value * rate
                step[rows] = value * rate
                if level == depth or len(rows) < 4:
                    continue
                best = (1e-6, -1, 0, 0.0, 0.0)
                for j in range(k):
                    size = len(edges[j]) + 1
                    if size < 2:
                        continue
                    b = binned[rows, j]
                    gl, hl = np.cumsum(np.bincount(b, gs, size))[:-1], np.cumsum(np.bincount(b, hs, size))[:-1]
                    gr, hr = gs.sum() - gl, hs.sum() - hl
                    vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                    loss = lambda v, gg, hh: -(gg * v + 0.5 * (hh + ridge) * v * v)
                    gain = loss(vl, gl, hl) + loss(vr, gr, hr) - loss(value, gs.sum(), hs.sum())
                    gain[(hl < least * 0.05) | (hr < least * 0.05) | ((vr - vl) * directions[j] < 0)] = -np.inf
                    c = int(gain.argmax())
                    if gain[c] > best[0]:
                        best = (float(gain[c]), j, c, float(vl[c]), float(vr[c]))
                _, j, c, vl, vr = best
                if j < 0:
                    continue
                middle = (vl + vr) / 2
                inside = binned[rows, j] <= c
                nodes[at][:4] = [j, float(edges[j][c]), len(nodes), len(nodes) + 1]
                nodes += [[-1, 0, -1, -1, 0], [-1, 0, -1, -1, 0]]
                bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(int(directions[j]), ((low, high), (low, high)))
                open_.append((len(nodes) - 2, rows[inside], *bounds[0], level + 1))
                open_.append((len(nodes) - 1, rows[~inside], *bounds[1], level + 1))
            margin += step
    table = np.array(nodes, float).reshape(-1, 5)
    return FlatTrees(table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4], np.array(roots, int), depth, start)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> FlatTrees:
    """Trees for the chance that a text is marked bad, from at most about ``max_rows`` marked rows.

    Rows of the fold that is held out are not learned from here either.
    """
    mark, x = marked_features(docs, labels, max_rows, 0)
    directions = np.array([1 if f in RISING else 0 for f in FEATURES])
    return grow(x[mark >= 0], (mark[mark >= 0] == 0).astype(float), directions)


def apply_rules(docs: DataFrame, trees: FlatTrees, keep: list[str] | None = None, min_words: int = 50, max_repeat_percent: int = 50, max_bad: float = 0.5) -> DataFrame:
    """Add the base counts, ``base_failed``, ``bad_score`` and ``kept`` to the columns ``keep``.

    A null text has no words, hence fails the base rules, as an empty one does. Every row is judged on
    its whole text by itself, so repeated rows get equal verdicts; an empty table gives an empty result.
    A badness of exactly ``max_bad`` is not kept. Columns of the same names are replaced.
    """
    names = [*BASE, "base_failed", "bad_score", "kept"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # at most trees * 2 ** (depth + 1) nodes
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{b} long" for b in BASE] + ["base_failed boolean", "bad_score double", "kept boolean"])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if "text" in keep else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_chunks(batch):
                base, x = measure(texts)
                failed = (base["n_words"] < min_words) | (100 * base["n_repeat_words"] > max_repeat_percent * base["n_words"])
                bad = shared.value.probability(x)
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(base[b].astype(np.int64)) for b in BASE], pa.array(failed), pa.array(bad), pa.array(~failed & (bad < max_bad))], [*keep, *names])

    return source.mapInArrow(run, schema)
