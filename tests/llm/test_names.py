"""Operators over texts take tables whose other columns have any names, those of working columns and odd ones among them."""

import pytest
from pyspark.sql import functions as F

from rastermill.llm import decontaminate, gam, isolation, langid, licenses, secretscan, tokencount
from rastermill.llm.entry import TOKENIZER
from rastermill.llm.langid import sample_bound, sure_part

ODD = ["__text", "__t", "__x", "__path", "__rule", "__id", "__lang", "c0", "n0", "t", "path", "x", "rule", "a.b", "c`d", "start_", "said", "of", "bound"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return df.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in ODD])


def same(made, docs):
    rows = made.select("doc_id", *[made[f"`{c.replace('`', '``')}`"] for c in ODD]).collect()
    assert rows and all(r[k] == f"{c}:{r['doc_id']}" for r in rows for k, c in enumerate(ODD, 1))


def test_every_name_stays(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    keep = ["doc_id", *ODD]
    same(tokencount.token_counts(docs, TOKENIZER, keep), docs)
    same(isolation.quality_rules(docs, isolation.fit(docs, labels), keep), docs)
    same(gam.classify(docs, gam.fit(docs, labels), keep), docs)
    same(langid.identify(docs, langid.fit(docs), keep), docs)
    same(decontaminate.contamination(docs, decontaminate.automata(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")), keep), docs)
    some = docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" token = 'q8Zr2LmX0vT5yB7n' ")))
    same(secretscan.scan(some, secretscan.fit(some), keep), docs)


def test_licences_beside_odd_names(spark, docs):
    assert licenses.scan(docs.drop("path").withColumn("path", F.lit("a/b")), licenses.standard_templates(spark)).count() == docs.count()


def test_very_long_texts_are_counted_whole(spark):
    text = "unbelievable words " * 40_000
    df = spark.createDataFrame([(1, text), (2, "unbelievable words ")], "doc_id long, text string")
    got = {r.doc_id: r for r in tokencount.token_counts(df, TOKENIZER, ["doc_id"]).collect()}
    one, many = ([v for k, v in got[i].asDict().items() if k != "doc_id" and isinstance(v, int)] for i in (2, 1))
    assert len(one) == len(many) and all(b > 30_000 * a for a, b in zip(one, many) if a)


def test_bound_of_a_sample_at_any_size():
    for n in (1, 8000, 8001, 10**7, 10**10, 10**14):
        bound = sample_bound(n, 8000)
        share = (bound + (1 << 63)) / (1 << 64)
        assert -(1 << 63) <= bound < 1 << 63 and abs(share * n / min(n, 8000) - 1) < 1e-3
    assert sure_part(1) == 1 and sure_part(2) > 0.99 and 0.4 < sure_part(51) < 0.6 and 0 < sure_part(8000) < 1e-3
    assert all(sure_part(k) > sure_part(k + 1) for k in range(1, 300))
