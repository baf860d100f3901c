"""The pipeline's stages one by one over a corpus, each against what it is to do."""

import re

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from rastermill.llm import decontaminate, gam
from tests.llm.test_neardup import similar_groups
from tests.llm.test_personal_data import PLAIN, passes
from tests.llm.test_tokens import check_pieces

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{D}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, D).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
        assert df.where(F.length("text") != F.col("n_chars")).count() == 0


def test_quality(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert all(before[i] == t for i, t in after.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q and i in before]
    bad = [i for i, q in labels.items() if not q and i in before]
    assert sum(i in after for i in good) > 0.99 * len(good) and sum(i in after for i in bad) < 0.05 * len(bad)
    model = gam.fit(stages[0], spark.read.parquet(f"{D}/labels.parquet"))
    kept = {r.doc_id for r in gam.classify(stages[0], model, ["doc_id"]).where("predicted = 1").collect()}
    assert kept == {*after}


def test_near_dedup(stages):
    before, after = texts(stages[1]), texts(stages[2])
    assert after == {i: before[i] for i in similar_groups(list(before.items())).values()}


def test_decontamination(spark, stages):
    before, after = texts(stages[2]), texts(stages[3])
    blocks = decontaminate.automata(spark.read.parquet(f"{D}/benchmark.parquet"))
    hit = {r.doc_id: r.n_hit / r.n_words for r in decontaminate.contamination(stages[2], blocks, ["doc_id"]).where("contaminated").collect()}
    assert hit and {*before} - {*after} == {i for i, share in hit.items() if share > decontaminate.MOST_COVERED}
    assert all(after[i] == t for i, t in before.items() if i not in hit)
    assert decontaminate.contamination(stages[3], blocks, ["doc_id"]).where("contaminated").count() == 0


def test_redaction(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert {*before} == {*after}
    for i, t in before.items():
        found = [m.group() for k, p in PLAIN.items() for m in re.finditer(p, t) if passes(k, m.group())]
        assert not found or all(f not in after[i] for f in found)
        if after[i] == t:
            assert not found


def test_packing(spark, stages):
    docs = texts(stages[4])
    check_pieces(stages[5].collect(), docs, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    keys = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, cp.run(spark, D).select(keys).collect())) == sorted(map(tuple, stages[5].select(keys).collect()))


NAMES = ["score", "predicted", "__new", "__gone", "__text", "__spans", "__exact", "__email", "__n", "__keep", "id", "th", "key", "new", "gone", "x", "y", "c0", "c1", "c6", "meta.lang", "a b", "start", "length", "n_words"]


def test_any_column_name_empty_tables_and_repeated_ids(spark):
    prose = [r.text for r in spark.read.parquet(f"{D}/documents.parquet").join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").where("quality = 1").orderBy("doc_id").limit(3).collect()]
    rows = [(1, prose[0]), (1, prose[1]), (1, prose[1]), (None, None), (2, None), (3, ""), (4, prose[2] + " write to a@b.cd today")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(NAMES)])
    for df in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, df, D)
            assert k == 4 or out.schema.simpleString() == docs.schema.simpleString()
            got = out.collect()
            if df is not docs:
                assert got == []
            elif k == 1:  # unlike texts of one id stay, repeated rows and empty texts but one do not
                assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(1, prose[0]), (1, prose[1]), (None, None), (2, None), rows[-1]], key=repr)
            elif k in (2, 3):
                assert len(got) == len(rows)
