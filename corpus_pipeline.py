"""From raw documents to packed sequences: the stages in their order, each over all that its predecessor kept.

Each stage takes null, empty and very long texts, repeated rows and ids, and columns of any further names, and gives an empty table for an
empty one. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import decontaminate, gam, packing, pii, simhash
from rastermill.llm.common import by_position, remove, shared_dir, table
from rastermill.llm.entry import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of poor quality go; the labels table trains it, held-out rows aside.

    Null and empty texts are scored like any other; repeated rows are judged alike, a score of 0.5 stays.
    """
    own, (key, text) = by_position(docs, "doc_id", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(key), "quality")
    model = gam.fit(own, labels, key, text)
    return gam.classify(own, model, own.columns, text).where("predicted = 1").drop("score", "predicted").toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies (five-word shingles, similarity 0.8 or more): that of the smallest doc_id.

    Null and wordless texts are one group; of repeated rows one stays; rows with a null doc_id stay. See simhash.one_of_each.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of documents; documents that mostly consist of them go. Null, empty and clean texts stay as they are."""
    return decontaminate.decontaminate(docs, decontaminate.automata(table(spark, sf_dir, "benchmark")))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets. All rows stay; null texts stay null; n_chars is counted anew."""
    return pii.redact(docs, pii.fit(docs))


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold all tokens of all documents; null and empty texts are the end mark alone."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality classifier", quality), ("simhash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("pii redaction", redaction), ("packing", packing_)]

#: Trained models, automata and tokenizers have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again, and go when the next one's are there."""
    docs = table(spark, sf_dir, "documents")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            remove(spark, f"{home}/{k - 1}")
    return docs
