"""The queries of the numbered operators, by name: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, gam, isolation, langid, licenses, minhash, oracle, packing, periodic, pii, secretscan, simhash, tokencount
from .common import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, ["doc_id"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = isolation.fit(docs, table(spark, sf_dir, "labels"))
    return isolation.quality_rules(docs, forest, ["doc_id"])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = gam.fit(docs, table(spark, sf_dir, "labels"))
    return gam.classify(docs, model, ["doc_id"]).select("doc_id", gam.held_out().alias("held_out"), "score", "predicted")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.personal_data(docs, pii.fit(docs), ["doc_id"])


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path: each ten ids are a project, with directories by source and language. Every tenth id is its project's LICENSE, whose statement, if it has one, the others inherit."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(1).cast("long"))
    project = F.call_function("div", number, F.lit(10)).cast("string")
    path = F.when(number % 10 == 0, F.concat_ws("/", project, F.lit("LICENSE"))).otherwise(F.concat_ws("/", project, part("source"), part("lang"), part("doc_id")))
    docs = table(spark, sf_dir, "documents").withColumn("path", path)
    return licenses.scan(docs, licenses.standard_templates(spark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs), ["doc_id"]).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = decontaminate.automata(table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination(table(spark, sf_dir, "documents"), blocks, ["doc_id"])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secretscan.scan(docs, secretscan.fit(docs), ["doc_id"])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text in ten gets a tail that repeats; then the runs of all texts."""
    found = periodic.periodic_runs(periodic.repeated(table(spark, sf_dir, "documents")), ["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    longest = F.element_at(F.array_sort("runs", lambda a, b: F.when(a["length"] != b["length"], F.signum((b["length"] - a["length"]).cast("double")).cast("int")).otherwise(F.when((a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"])), -1).otherwise(1))), 1)
    own = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, longest).alias("r"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return own.select("doc_id", "n_runs", "r.start", "r.length", "r.period", F.expr("1000 * r.length div r.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversations.repaired_conversations(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


_QUERIES = (op1_token_counts, op2_quality_rules, op3_quality_classifier, op4_pii, op5_license_scan, op6_language_id, op7_decontamination, op8_secret_scan, op9_simhash, op10_packing, op11_periodic_runs, op12_minhash, op13_conversation_repair)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """Only what SQL has the means for: the rest needs trained models, tokenizers or hashes that SQL lacks."""
    return dict(oracle.SQL)
