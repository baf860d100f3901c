"""Quality rules: exact rule counts, and an isolation forest over the statistics that they make.

Each tree draws random splits in the box that all labelled rows span and follows the rows of good quality down
it; a document that leaves them after few splits is anomalous. The threshold on the mean path length comes from
labelled rows that the trees have not seen. All labelled rows count: tasks send sums, not rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_text
from .textstats import FEATURES, feature_matrix
from .training import labelled_rows

#: POINTS: the rows whose mean path a path is compared to.
TREES, POINTS, DEPTH = 128, 256, 12
#: Rows that a task follows down all trees at once.
SLICE = 4096
#: Least share of good labelled rows that the threshold must keep.
KEEP_GOOD = 0.99


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n points: what a leaf of n points adds to its depth."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Splits:
    """Trees of random splits in a box, down to `depth`: node h of a tree has the children 2 * h and 2 * h + 1, the root is 1."""

    feature: np.ndarray
    cut: np.ndarray
    depth: int
    live: bool

    @classmethod
    def draw(cls, low: np.ndarray, high: np.ndarray, seed: int = 7, trees: int = TREES, depth: int = DEPTH) -> Splits:
        rng, live = np.random.default_rng(seed), np.flatnonzero(high > low)
        out = cls(np.zeros((trees, 1 << depth), np.int64), np.zeros((trees, 1 << depth)), depth, bool(len(live)))
        lo, hi = np.tile(low, (trees, 1)), np.tile(high, (trees, 1))
        for d in range(depth if len(live) else 0):
            at = np.arange(len(lo))
            f = rng.choice(live, len(lo))
            cut = rng.uniform(lo[at, f], hi[at, f])
            out.feature[:, 1 << d : 2 << d], out.cut[:, 1 << d : 2 << d] = f.reshape(trees, -1), cut.reshape(trees, -1)
            lo, hi = lo.repeat(2, axis=0), hi.repeat(2, axis=0)
            hi[2 * at, f], lo[2 * at + 1, f] = cut, cut
        return out

    def ends(self, x: np.ndarray) -> np.ndarray:
        """The last node of each row in each tree, as tree * 2 ** (depth + 1) + node."""
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.feature))
        at = np.ones((len(x), len(trees)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (x[rows, self.feature[trees, at]] >= self.cut[trees, at])
        return trees * (2 << self.depth) + at


@dataclass
class IsolationForest:
    """Trees as flat arrays: split feature (-1: leaf), split value, left child (right is the next), path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    threshold: float = 1.0

    @classmethod
    def of_counts(cls, drawn: Splits, counts: np.ndarray) -> IsolationForest:
        """Trees that stop where one row is left: counts (trees, 2 ** (depth + 1)) has the rows at each node of drawn."""
        trees, depth = len(drawn.feature), drawn.depth
        t, h = np.arange(trees), np.ones(trees, np.int64)
        feature, value, left, path, made = [], [], [], [], 0
        for d in range(depth + 1):
            n = counts[t, h]
            goes = (n > 1) & (d < depth) & drawn.live
            made += len(t)
            first = np.full(len(t), -1, np.int64)
            first[goes] = made + 2 * np.arange(goes.sum())
            inner = np.where(goes, h, 0)
            feature.append(np.where(goes, drawn.feature[t, inner], -1))
            value.append(np.where(goes, drawn.cut[t, inner], 0.0))
            left.append(first)
            path.append(np.where(goes, 0.0, d + mean_path(n)))
            t, h = t[goes].repeat(2), (2 * h[goes][:, None] + np.arange(2)).reshape(-1)
        return cls(*[np.concatenate(a) for a in (feature, value, left, path)], np.arange(trees))

    def score(self, x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        """2 ** -(mean path length / usual length) for each row: near 1 for rows that are isolated at once."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(depth):
            f = self.feature[at]
            go = f >= 0
            if not go.any():
                break
            at = np.where(go, self.left[at] + (x[rows, np.maximum(f, 0)] >= self.value[at]), at)
        return 2.0 ** (-self.path[at].mean(axis=1) / float(mean_path(POINTS)))


def threshold(scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The cut on the score with the most bad rows above it less the share of good ones, among those that keep keep_good of the good."""
    if not len(scores):
        return 1.0
    cuts = np.unique(scores)
    cuts = np.concatenate(((cuts[1:] + cuts[:-1]) / 2, [1.0]))
    kept = np.array([(scores[good] < c).mean() if good.any() else 1.0 for c in cuts])
    caught = np.array([(scores[~good] >= c).mean() if (~good).any() else 0.0 for c in cuts])
    value = np.where(kept >= keep_good, caught + kept, -1.0)
    best = np.flatnonzero(value == value.max())
    return float(cuts[best[-1]])


#: Parts of the scores' range that are summed in the driver; cuts within a part are compared by Spark.
PARTS = 4096


def cut_of(scored: DataFrame, keep_good: float = KEEP_GOOD) -> float:
    """threshold over a table (s, good) of any size: sums by part of the range come to the driver, running sums within parts stay with Spark."""
    by = checkpoint(scored.groupBy("s").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")).withColumn("part", F.floor(F.col("s") * PARTS)))
    parts = by.groupBy("part").agg(F.sum("g").alias("g"), F.sum("b").alias("b"), F.min("s").alias("s")).orderBy("part").collect()
    if not parts:
        return 1.0
    good, bad = (np.cumsum([0, *[r[c] for r in parts]]) for c in "gb")
    heads = [(r["part"], int(good[k]), int(bad[k]), parts[k + 1]["s"] if k + 1 < len(parts) else None) for k, r in enumerate(parts)]
    rows = by.join(F.broadcast(scored.sparkSession.createDataFrame(heads, "part long, g0 long, b0 long, s1 double")), "part")  # broadcast: PARTS + 1 rows at most
    order = Window.partitionBy("part").orderBy("s")
    upto = lambda c: F.col(f"{c}0") + F.sum(c).over(order) - F.when(F.col("s") >= 1, F.col(c)).otherwise(0)
    rows = rows.select("s", F.coalesce(F.lead("s").over(order), "s1").alias("next"), upto("g").alias("g"), upto("b").alias("b"))
    middle = (F.col("s") + F.col("next")) / 2
    cut = F.when(F.col("next").isNull(), 1.0).when(middle > F.col("s"), middle).otherwise(F.col("next"))
    kept = F.col("g") / F.lit(int(good[-1])) if good[-1] else F.lit(1.0)
    caught = (F.lit(int(bad[-1])) - F.col("b")) / F.lit(int(bad[-1])) if bad[-1] else F.lit(0.0)
    value = F.when(kept >= keep_good, caught + kept).otherwise(-1.0)
    return float(rows.agg(F.max(F.struct(value.alias("v"), cut.alias("cut")))["cut"]).first()[0])


def for_cut(id_col: str) -> Column:
    """The third of the labelled rows that sets the threshold, by a hash of the id."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("cut")), F.lit(3)) == 2


def _matrix(batch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> IsolationForest | None:
    """A forest from all labelled rows (label 1: good): about two thirds of them grow it, the others set its threshold.

    The box is that of all rows that grow it, and every good one of them is followed down each tree; tasks send sums by last node, of which
    there are trees * 2 ** depth at most. The threshold compares all cuts between scores of the others. A few good rows make a forest too;
    without any among those that grow it there is none, and without rows to set it the threshold keeps all.
    """
    rows = labelled_rows(docs, labels, label, lambda texts: feature_matrix(texts)[1], id_col, text_col)
    grow, rest = rows.where(~for_cut("__id")), rows.where(for_cut("__id"))
    n = len(FEATURES)
    box = grow.agg(F.count_if(F.col("y") > 0).alias("good"), *[f(F.col("x")[k]).alias(f"{name}{k}") for k in range(n) for name, f in (("low", F.min), ("high", F.max))]).first()
    if not box["good"]:
        return None
    drawn = Splits.draw(*[np.array([box[f"{name}{k}"] for k in range(n)]) for name in ("low", "high")])
    width = 2 << drawn.depth

    def follow(batches):
        total = np.zeros(TREES * width, np.int64)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            total += np.bincount(drawn.ends(_matrix(batch)).reshape(-1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    ends = grow.where("y > 0").select("x").mapInArrow(follow, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(TREES * width, np.int64)
    counts[ends["at"].to_numpy()] = ends["n"].to_numpy()
    counts = counts.reshape(TREES, width)
    for d in range(drawn.depth, 0, -1):
        counts[:, 1 << d - 1 : 1 << d] = counts[:, 1 << d : 2 << d].reshape(TREES, -1, 2).sum(axis=2)
    forest = IsolationForest.of_counts(drawn, counts)

    def judge(batches):
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(forest.score(_matrix(batch))), pc.greater(batch.column("y"), 0.0)], names=["s", "good"])

    forest.threshold = cut_of(rest.select("x", "y").mapInArrow(judge, "s double, good boolean"))
    return forest


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def quality_rules(docs: DataFrame, forest: IsolationForest | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns keep with the rule counts, base_failed, anomaly (0 to 1) and kept.

    A null text counts as empty: no words, so it fails the base. Without a forest the base decides alone. Very long
    texts are read whole; an empty table gives an empty one. Rows are judged one by one, so repeated rows and ids get equal results; columns of keep that
    have the name of a result are replaced.
    """

    def make():
        def run(texts):
            base, x = feature_matrix(texts)
            return [*base.T, forest.score(x) if forest else np.zeros(len(x))]

        return run

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = map_text(docs, make, [*[T.StructField(n, T.LongType()) for n in names], T.StructField("anomaly", T.DoubleType())], keep, text_col)
    cut = forest.threshold if forest else 1.0
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return got.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < F.lit(cut)))
