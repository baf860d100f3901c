"""Small decision trees: gradient boosting on rows at hand, random forests on all rows of a table, and their form as SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Equal parts of a feature's range whose rows are counted; most bins of a feature, whose borders are borders of parts; least rows of a leaf.
PARTS, BINS, LEAST = 4096, 64, 2
#: Rows that a task handles at once.
SLICE = 4096
#: Parts of the scores' range that are summed in the driver.
SCORES = 4096


@dataclass
class Tree:
    """Flat arrays: feature (-1: leaf), cut (below goes left), left child (right is the next), value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    @classmethod
    def grow(cls, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0, least: int = 4, rng: np.random.Generator | None = None, some: int = 0) -> Tree:
        """Best cuts by the gain of -G/(H + ridge) leaves; with rng, each node looks at `some` random features only."""
        feature, cut, left, value = [], [], [], []

        def node() -> int:
            for a, v in ((feature, -1), (cut, 0.0), (left, -1), (value, 0.0)):
                a.append(v)
            return len(feature) - 1

        todo = [(node(), np.arange(len(x)), depth)]
        while todo:
            at, rows, d = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[at] = float(-gs / (hs + ridge))
            if d == 0 or len(rows) < 2 * least:
                continue
            best = (1e-9, -1, 0.0)
            features = rng.choice(x.shape[1], some, replace=False) if rng is not None else range(x.shape[1])
            for f in sorted(features):
                v = x[rows, f]
                order = np.argsort(v, kind="stable")
                v = v[order]
                gl, hl = np.cumsum(g[rows][order])[:-1], np.cumsum(h[rows][order])[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                n = np.arange(1, len(v))
                gain[(v[1:] == v[:-1]) | (n < least) | (len(v) - n < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float((v[k] + v[k + 1]) / 2))
            if best[1] >= 0:
                feature[at], cut[at], left[at] = best[1], best[2], node()
                node()
                low = x[rows, best[1]] < best[2]
                todo += [(left[at], rows[low], d - 1), (left[at] + 1, rows[~low], d - 1)]
        return cls(np.array(feature), np.array(cut), np.array(left), np.array(value))

    def predict(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while (self.feature[at] >= 0).any():
            f = self.feature[at]
            at = np.where(f >= 0, self.left[at] + (x[rows, np.maximum(f, 0)] >= self.cut[at]), at)
        return self.value[at]

    def sql(self, names: list[str], at: int = 0) -> str:
        if self.feature[at] < 0:
            return f"{float(self.value[at])!r}D"
        low, high = (self.sql(names, int(self.left[at]) + k) for k in (0, 1))
        return f"IF({names[self.feature[at]]} < {float(self.cut[at])!r}D, {low}, {high})"


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float) -> tuple[float, list[Tree]]:
    """(start, trees) of a logistic gradient boosting; a row's logit is start plus its leaves."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    logit, out = np.full(len(y), start), []
    if not len(y) or y.min() == y.max():
        return start, out
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        t = Tree.grow(x, p - y, p * (1 - p), depth)
        t.value *= rate
        logit = logit + t.predict(x)
        out.append(t)
    return start, out


def bag(h: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees): how often each row counts in each tree. Poisson with mean 1, from the row's 64-bit hash alone."""
    z = h.view(np.uint64)[:, None] + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    upto = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 16)]))
    return np.searchsorted(upto, (z >> np.uint64(11)) / float(1 << 53), "right")


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))


def _sums(rows: DataFrame, size: int, count: Callable[[pa.RecordBatch], list[np.ndarray]], many: int) -> list[np.ndarray]:
    """`many` arrays of `size` whole numbers, which count makes of each batch, summed over all rows; tasks send what is not zero."""

    def run(batches):
        total = [np.zeros(size, np.int64) for _ in range(many)]
        for batch in slices(batches):
            for t, c in zip(total, count(batch)):
                t += c.astype(np.int64)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(t[at]) for t in total]], names=["at", *[f"n{k}" for k in range(many)]])

    names = [f"n{k}" for k in range(many)]
    got = rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["at", *names])).groupBy("at").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = [np.zeros(size, np.int64) for _ in names]
    for o, c in zip(out, names):
        o[got["at"].to_numpy()] = got[c].to_numpy()
    return out


def bin_edges(rows: DataFrame, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Borders of each feature's bins, about equally many rows in each: between parts of its range that have rows, all rows counted."""
    wide = np.where(high > low, high - low, 1.0)

    def count(batch):
        at = np.clip(((matrix(batch) - low) / wide * PARTS).astype(np.int64), 0, PARTS - 1)
        return [np.bincount((at + np.arange(len(low)) * PARTS).reshape(-1), minlength=len(low) * PARTS)]

    edges = []
    for k, n in enumerate(_sums(rows, len(low) * PARTS, count, 1)[0].reshape(-1, PARTS)):
        full = np.flatnonzero(n)
        upto = np.cumsum(n[full])[:-1]
        if len(upto) >= BINS:
            chosen = np.unique(np.minimum(np.searchsorted(upto, n.sum() * np.arange(1, BINS) / BINS), len(upto) - 1))
        else:
            chosen = np.arange(len(upto))
        edges.append(low[k] + wide[k] * (full[chosen] + 1 + full[chosen + 1]) / 2 / PARTS)
    return edges


def forest(rows: DataFrame, trees: int, depth: int, seed: int = 5) -> list[Tree]:
    """Trees from all rows (h, y, x): each has bootstrap weights by the row's hash h, each node sees a few random features.

    A leaf's value is its share of ones. A level of all trees is one pass: tasks send counts by node, feature and bin, of which there are at most
    trees * 2 ** depth * features seen * BINS / 2, however many rows there are. No rows make no trees.
    """
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return []
    box = rows.agg(*[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(width) for name, f in (("low", F.min), ("high", F.max))]).first()
    edges = bin_edges(rows, *[np.array([box[f"{name}{k}"] for k in range(width)]) for name in ("low", "high")])
    rng, some = np.random.default_rng(seed), max(1, round(width**0.5))
    picks = np.sort(np.argsort(rng.random((trees, 1 << depth, width)), axis=2)[:, :, :some], axis=2)
    feature, place = np.full((trees, 2 << depth), -1), np.zeros((trees, 2 << depth), np.int64)
    n, ones = np.zeros((trees, 2 << depth), np.int64), np.zeros((trees, 2 << depth), np.int64)
    live = np.ones((trees, 1), bool)
    for d in range(depth):
        if not live.any():
            break
        number = np.where(live, np.cumsum(live).reshape(live.shape) - 1, -1)
        count = _level(d, feature, place, number, picks[:, 1 << d : 2 << d], edges)
        got = [c.reshape(-1, some, BINS) for c in _sums(rows, int(live.sum()) * some * BINS, count, 2)]
        t, h = np.nonzero(live)
        h = h + (1 << d)
        if d == 0:
            n[t, h], ones[t, h] = (c[:, 0].sum(axis=1) for c in got)
        hl, gl = (np.cumsum(c, axis=2)[:, :, :-1] for c in got)
        hs, gs = n[t, h][:, None, None], ones[t, h][:, None, None]
        ok = (hl >= LEAST) & (hs - hl >= LEAST)
        gain = np.where(ok, gl**2 / np.maximum(hl, 1) + (gs - gl) ** 2 / np.maximum(hs - hl, 1) - gs**2 / np.maximum(hs, 1), -1.0).reshape(len(t), -1)
        best = gain.argmax(axis=1)
        goes = np.flatnonzero(gain[np.arange(len(t)), best] > 1e-9)
        t, h, best = t[goes], h[goes], best[goes]
        feature[t, h], place[t, h] = picks[t, h, best // (BINS - 1)], best % (BINS - 1)
        for total, left in ((n, hl), (ones, gl)):
            total[t, 2 * h] = left.reshape(len(left), -1)[goes, best]
            total[t, 2 * h + 1] = total[t, h] - total[t, 2 * h]
        below = slice(2 << d, 4 << d)
        live = (n[:, below] >= 2 * LEAST) & (ones[:, below] > 0) & (ones[:, below] < n[:, below])
    return [_flat(feature[t], place[t], edges, ones[t] / np.maximum(n[t], 1)) for t in range(trees)]


def _level(d: int, feature: np.ndarray, place: np.ndarray, number: np.ndarray, picks: np.ndarray, edges: list[np.ndarray]) -> Callable:
    """Weights and ones of a batch's rows by live node of level d, feature seen there and bin."""
    trees, some = picks.shape[0], picks.shape[2]
    size = (int(number.max()) + 1) * some * BINS
    tree = np.arange(trees)
    feature, place = feature[:, : 1 << d].astype(np.int16), place[:, : 1 << d].astype(np.int16)

    def count(batch):
        x, y, weight = matrix(batch), batch.column("y").to_numpy(zero_copy_only=False), bag(batch.column("h").to_numpy(), trees)
        bins = np.stack([np.searchsorted(e, v, "right") for e, v in zip(edges, x.T)], axis=1)
        row = np.arange(len(x))[:, None]
        at = np.ones((len(x), trees), np.int64)
        for k in range(d):  # rows that a leaf above holds stay behind
            f = feature[tree, np.minimum(at, (1 << d) - 1)]
            at = np.where((at >= 1 << k) & (f >= 0), 2 * at + (bins[row, np.maximum(f, 0)] > place[tree, np.minimum(at, (1 << d) - 1)]), at)
        here = np.where(at >= 1 << d, number[tree, np.maximum(at - (1 << d), 0)], -1)
        r, t = np.nonzero((here >= 0) & (weight > 0))
        node, w = here[r, t], weight[r, t]
        seen = picks[t, at[r, t] - (1 << d)]
        key = ((node[:, None] * some + np.arange(some)) * BINS + bins[r[:, None], seen]).reshape(-1)
        return [np.bincount(key, v.repeat(some), size) for v in (w, w * y[r])]

    return count


def _flat(feature: np.ndarray, place: np.ndarray, edges: list[np.ndarray], value: np.ndarray) -> Tree:
    """A tree of numbered places, where h has the children 2 * h and 2 * h + 1, as flat arrays."""
    order, left = [1], []
    for h in order:
        left.append(len(order) if feature[h] >= 0 else 0)
        if feature[h] >= 0:
            order += [2 * h, 2 * h + 1]
    cuts = [edges[feature[h]][place[h]] if feature[h] >= 0 else 0.0 for h in order]
    return Tree(feature[order], np.array(cuts), np.array(left), value[order])


def out_of_bag(trees: list[Tree], h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The mean of the trees that a row has not grown; nan where there is none."""
    out = bag(h, len(trees)) == 0
    total = sum((np.where(o, t.predict(x), 0.0) for o, t in zip(out.T, trees)), np.zeros(len(x)))
    return np.where(out.any(axis=1), total / np.maximum(out.sum(axis=1), 1), np.nan)


def precise_cut_of(scored: DataFrame, precision: float) -> float:
    """precise_cut with halfway, over a table (s, y) of any size: sums by part of the range come to the driver, running sums within parts stay with Spark."""
    by = scored.groupBy("s").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("hit")).withColumn("part", F.floor(F.col("s") * SCORES))
    parts = by.groupBy("part").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.max("s").alias("top")).orderBy(F.desc("part")).collect()
    if not parts:
        return float("inf")
    n, hit = (np.cumsum([0, *[r[c] for r in parts]]) for c in ("n", "hit"))
    heads = [(r["part"], int(n[k]), int(hit[k]), parts[k + 1]["top"] if k + 1 < len(parts) else None) for k, r in enumerate(parts)]
    rows = by.join(F.broadcast(scored.sparkSession.createDataFrame(heads, "part long, n0 long, hit0 long, below double")), "part")  # broadcast: SCORES + 1 rows at most
    down = Window.partitionBy("part").orderBy(F.desc("s"))
    upto = lambda c: F.sum(c).over(down) + F.col(f"{c}0")
    last = rows.select("s", F.coalesce(F.lead("s").over(down), "below").alias("below"), (upto("hit") / upto("n")).alias("share")).where(F.col("share") >= precision)
    got = last.agg(F.min(F.struct("s", "below")).alias("m")).first()["m"]
    return float("inf") if got is None else float(got["s"] if got["below"] is None else (got["s"] + got["below"]) / 2)


def precise_cut(scores: np.ndarray, y: np.ndarray, precision: float, halfway: bool = False) -> float:
    """The lowest score at and above which at least `precision` of the rows are ones; infinite if there is none.

    With halfway the cut lies in the middle between that score and the next lower one.
    """
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order])
    share = hit / np.arange(1, len(s) + 1)
    last = np.append(s[1:] != s[:-1], True) if len(s) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & last)
    if not len(good):
        return float("inf")
    k = good[-1]
    return float((s[k] + s[k + 1]) / 2 if halfway and k + 1 < len(s) else s[k])
