"""Benchmark passages against brute force over all windows; cleaning until nothing is left."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rastermill.llm import decontaminate, entry

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(text, items):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(10, len(v))
        for a in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == a:
                    hit |= {*range(i, i + n)}
                    found.add(name)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def run(spark, docs, items, **k):
    blocks = decontaminate.automata(spark.createDataFrame(items, "item_id string, text string"), **k)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(df, blocks, ["doc_id", "n_hit"]).collect()}


@pytest.mark.parametrize("block_words", [200_000, 30])
def test_random_texts(spark, block_words):
    rng = random.Random(7)
    vocabulary = [*"abcde", "é", "中"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(str(k), text(rng.choice([0, 1, 2, 9, 10, 11, 14, 30]))) for k in range(14)] + [("n", None), ("e", ""), ("7", text(12)), ("rep", "a a a a a a a a a a a a")]
    items = [x for x in items if len(words(x[1])) != 1] + [("one", "zz")]
    docs = [text(rng.choice([0, 5, 40, 120])) for _ in range(40)]
    docs += [f"{d} {it} {d}" for d, (_, it) in zip(docs, items)] + ["A-a,A a!a A a a a a a a", "x zz. y", None, "", " ,;"]
    assert run(spark, docs, items, block_words=block_words) == {i: expected(d, items) for i, d in enumerate(docs)}


def test_no_items(spark):
    assert run(spark, ["a b", None], []) == {i: expected(d, []) for i, d in enumerate(["a b", None])}


def test_long_text(spark):
    item = [("i", " ".join(f"q{k}" for k in range(25)))]
    doc = " ".join(f"w{k % 5000}" for k in range(60000)) + " " + item[0][1]
    assert run(spark, [doc], item)[0] == (60025, 25, 1, hashlib.sha256(b"i").hexdigest(), True)


def test_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in entry.op7_decontamination(spark, sf).collect()}
    assert len(got) == len(docs) and any(v[-1] for v in got.values())
    fast = {i: d for i, d in docs.items() if len(d or "") < 3000 or got[i][-1]}
    assert {i: got[i] for i in fast} == {i: expected(d, items) for i, d in fast.items()}


def test_cleaning(spark):
    item = " ".join("abcdefghijklmno")
    blocks = decontaminate.automata(spark.createDataFrame([("1", item)], "item_id string, text string"))
    before, after = "Some Words, before (this) one and more and yet more of them:", "then after. Éh, more comes here and there."
    docs = [(1, f"{before} {item} {after}"), (2, item), (3, f"{before}{after}"), (4, None), (5, f"{before} a b c d e {item} f g h i j {after}"), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text")).withColumn("contaminated", F.lit("kept"))
    got = decontaminate.decontaminate(df, blocks)
    assert got.schema.simpleString() == df.schema.simpleString()
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].text == f"{before} {after}" and rows[1].n_chars == len(rows[1].text)
    assert 2 not in rows and rows[3].text == docs[2][1] and rows[4].text is None and rows[6].text == ""
    assert decontaminate.contamination(got, blocks, ["doc_id"]).where("contaminated").count() == 0
