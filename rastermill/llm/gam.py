"""Quality classifier: a generalised additive model with pairwise interactions.

Features are cut into quantile bins. Boosting goes round the features in turn; each visit fits a shallow tree on one
feature's bins to the gradient of the log loss and adds its leaves, times a small rate, to that feature's lookup table.
Then the pairs of features that the residual gains most from get two-dimensional tables in the same way. A score is
the logistic of a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_rest, map_text
from .textstats import feature_matrix
from .training import labelled_features

BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, RIDGE = 48, 8, 6, 120, 0.15, 1.0


def _gain(g, h):
    return g * g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0: none."""
    if len(g) < 2:
        return 0.0, 0
    left, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(left, lh) + _gain(g.sum() - left, h.sum() - lh) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gains))
    return (float(gains[k]), k + 1) if gains[k] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of depth two."""
    out = np.zeros(len(g))
    k = _cut(g, h)[1]
    for lo, hi in ((0, k), (k, len(g))):
        m = lo + _cut(g[lo:hi], h[lo:hi])[1]
        for a, b in ((lo, m), (m, hi)):
            if b > a:
                out[a:b] = -g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _tree2(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values by cell, and gain, of a tree that cuts one axis and then the other on each side; the better order."""
    best = (np.zeros_like(g), 0.0)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for k in range(1, a.shape[0]):  # every first cut: one that gains nothing alone may gain with the second
            out, gain = np.zeros_like(a), -_gain(g.sum(), h.sum())
            for rows in (slice(0, k), slice(k, None)):
                ga, ha = a[rows].sum(0), b[rows].sum(0)
                m = _cut(ga, ha)[1]
                for cols in (slice(0, m), slice(m, None)):
                    s, t = ga[cols].sum(), ha[cols].sum()
                    out[rows, cols] = -s / (t + RIDGE)
                    gain += _gain(s, t)
            if gain > best[1] + 1e-9:
                best = (out.T if turn else out, float(gain))
    return best


@dataclass
class Gam:
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Gam:
        if not len(x):
            return cls()
        rate = (y.sum() + 1) / (len(y) + 2)
        out = cls(float(np.log(rate / (1 - rate))))
        if y.min() == y.max():
            return out
        quantiles = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
        out.edges = [quantiles(v, BINS) for v in x.T]
        bins = [np.searchsorted(e, v, "right") for e, v in zip(out.edges, x.T)]
        out.tables = [np.zeros(len(e) + 1) for e in out.edges]
        logit = np.full(len(y), out.start)

        def slope():
            p = 1 / (1 + np.exp(-logit))
            return p - y, p * (1 - p)

        for _ in range(rounds):
            for f, (b, t) in enumerate(zip(bins, out.tables)):
                if len(t) < 2:
                    continue
                g, h = slope()
                step = RATE * _tree(np.bincount(b, g, len(t)), np.bincount(b, h, len(t)))
                out.tables[f] = t + step
                logit = logit + step[b]
        out.coarse = [quantiles(v, PAIR_BINS) for v in x.T]
        low = [np.searchsorted(e, v, "right") for e, v in zip(out.coarse, x.T)]
        n = PAIR_BINS

        def cells(i, j, w):
            return np.bincount(low[i] * n + low[j], w, n * n).reshape(n, n)

        g, h = slope()
        gains = sorted(((_tree2(cells(i, j, g), cells(i, j, h))[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
        out.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
        out.pair_tables = [np.zeros((n, n)) for _ in out.pairs]
        for _ in range(rounds // 4):
            for k, (i, j) in enumerate(out.pairs):
                g, h = slope()
                step = RATE * _tree2(cells(i, j, g), cells(i, j, h))[0]
                out.pair_tables[k] = out.pair_tables[k] + step
                logit = logit + step[low[i], low[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        logit = np.full(len(x), self.start)
        for e, t, v in zip(self.edges, self.tables, x.T):
            logit += t[np.searchsorted(e, v, "right")]
        if self.pairs:
            low = [np.searchsorted(e, v, "right") for e, v in zip(self.coarse, x.T)]
            for (i, j), t in zip(self.pairs, self.pair_tables):
                logit += t[low[i], low[j]]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(crc_rest(id_col, 3) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Gam:
    """A model from at most training.SAMPLE_ROWS labelled rows that are not held out. Without such rows: even odds for all."""
    _, x, y = labelled_features(docs, labels.where(~held_out(id_col)), label, lambda texts: feature_matrix(texts)[1], id_col=id_col, text_col=text_col)
    return Gam.fit(x, y)


def classify(docs: DataFrame, model: Gam, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    A null text counts as empty and is scored as such; an empty table gives an empty one. The whole text counts, and nothing but the text, so repeated rows
    get equal scores; columns of keep named score or predicted are replaced.
    """

    def make():
        return lambda texts: [model.score(feature_matrix(texts)[1])]

    return map_text(docs, make, [T.StructField("score", T.DoubleType())], keep, text_col).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
