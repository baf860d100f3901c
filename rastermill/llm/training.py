"""Training rows: all labelled ones as a table, or a bounded number picked by the smallest hashes; features made by Spark where the texts lie."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, map_text, smallest_hash

#: Most labelled rows that a model is fitted on.
SAMPLE_ROWS = 6000


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, matrix: Callable[[list], np.ndarray], rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, X, y) for at most `rows` rows of labels with a non-null id and label whose document is there, by id.

    The rows are those whose id has the smallest hash, so the sample is the same at each run. Of labels that repeat an id
    the largest counts, of documents that do the least row of features. At most `rows` feature rows come to the driver.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    picked = smallest_hash(known.groupBy(id_col).agg(F.max(label).cast("double").alias("y")), id_col, rows, known.count()).select(F.col(id_col).alias("__id"), "y")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).join(F.broadcast(picked), "__id")  # broadcast: at most `rows` pairs of numbers

    def make():
        return lambda batch: [list(matrix(batch))]

    got = map_text(texts, make, [T.StructField("x", T.ArrayType(T.DoubleType()))], ["__id", "y"], "__t").groupBy("__id", "y").agg(F.min("x").alias("x"))
    kept = sorted(got.collect(), key=lambda r: r["__id"])
    return np.array([r["__id"] for r in kept]), np.array([r["x"] for r in kept], float), np.array([r["y"] for r in kept], float)


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, matrix: Callable[[list], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, y, x) of every row of labels with a non-null id and label whose document is there, in the shared folder.

    Repeated ids are treated as in labelled_features. Features are made before the join, so that no text is shuffled.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("double").alias("y"))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).where("__id IS NOT NULL")

    def make():
        return lambda batch: [list(matrix(batch))]

    made = map_text(texts, make, [T.StructField("x", T.ArrayType(T.DoubleType()))], ["__id"], "__t")
    return checkpoint(made.join(known, "__id").groupBy("__id", "y").agg(F.min("x").alias("x")))
