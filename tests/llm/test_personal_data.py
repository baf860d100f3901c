"""Personal data: exact findings by the plain patterns, and what the trees add."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from rastermill.llm import entry, pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
KINDS = list(PLAIN)


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return kind == "email" or kind == "ip" and all(int(p) <= 255 for p in s.split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15


def exact(text):
    found = sorted((m.start(), KINDS.index(k), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text or "") if passes(k, m.group()))
    listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
    return [*[sum(k == n for _, k, _ in found) for n in range(4)], hashlib.sha256(listed.encode()).hexdigest()], listed


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want, listed = exact(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256] == want, (r.doc_id, listed)
        assert {*listed.split(",")} - {""} <= {*r.spans.split(",")}


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


EDGE = [
    None, "", " ", "a@b.c_d@e.f x@y", "\U0001f600 é a.b+c@d-e.fr, f@g.h.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112",
    "+1 (743) 555-3824 +49 30 1234567. +123 +1234567890123456 +1)(2-3 4 5 6 7 8 9 0", "+12345678901@x.yy 4111111111111111.1.1.1", "9" * 30000, "1 " * 20000, "a" * 50000, "a" * 20000 + "@" + "b." * 9000 + "c", "+" * 3000 + "12345678901",
    "1." * 20000, "a@b " * 5000, "a@b.c " * 400, "@." * 9000, "line\nx@y.z\n+1 222 333 4444\r\n1.1.1.1",
]


def test_exact_findings_on_edge_cases(spark, model):
    df = spark.createDataFrame(list(enumerate(EDGE)), "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("t", F.lit("x"))
    got = pii.personal_data(df, model, ["doc_id", "spans", "t"])
    assert got.columns.count("spans") == 1
    check(got.collect(), dict(enumerate(EDGE)))
    assert pii.personal_data(df.limit(0), model, ["doc_id"]).count() == 0
    assert pii.fit(df.limit(0)).trees == []


def test_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(entry.op4_pii(spark, sf).collect(), texts)


def test_the_trees_add_respelt_spans_and_leave_plain_numbers(spark, model):
    texts = ["write to bob (at) example (dot) com today", "call (743) 555-3824 now", "order 4785380592391138 of 2024", "in 1999 and 2,500 of 1234567", "plain words only"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.spans for r in pii.personal_data(df, model, ["doc_id"]).orderBy("doc_id").collect()]
    assert got[0].startswith("email:9:") and got[1].startswith("phone:5:") and got[2:] == ["", "", ""]


def test_redaction(spark, model):
    texts = ["é a@b.cd, +1 (743) 555-3824!", None, "nothing", "+4111111111111111 x 1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("__note", F.lit("kept"))
    got = pii.redact(df, model)
    assert got.schema.simpleString() == df.schema.simpleString()
    rows = [(r.text, r.n_chars) for r in got.orderBy("doc_id").collect()]
    assert rows[0] == ("é [EMAIL], [PHONE]!", 19) and rows[1] == (None, None) and rows[2] == ("nothing", 7)
    assert "1.2.3.4" not in rows[3][0] and "4111" not in rows[3][0]


def test_no_python_on_the_main_path(spark, model):
    df = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = pii.personal_data(df, model, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_several_numbers_on_a_line_and_spelt_out_marks(spark, model):
    row = "tel 743-555-3824 743-555-9876 743-555-2223"
    texts = [row, "(743) 555-3824 (743) 555-9876 (743) 555-2223", "write to bob at example dot com today", "write to bob {at} example {dot} com today", "1 " * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text"))
    got = [r.text for r in pii.redact(df, model).orderBy("doc_id").collect()]
    for t in got[:2]:
        assert not re.search("[0-9]{4}", t), t
    assert got[2] == got[3] == "write to [EMAIL] today" and got[4] == texts[4]


def test_very_many_matches_in_one_text(spark, model):
    n = 8000
    texts = [" ".join(f"a{k}@b.cd" for k in range(n)), "\n".join(f"10.{k % 200}.{k // 200}.7" for k in range(n)), " ".join(str(1000000 + k * 7) for k in range(n)), "; ".join(f"+1 (743) 555-{k:04d}" for k in range(n)), "\n".join(["4111 1111 1111 1111"] * n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(pii.personal_data(df, model, ["doc_id"]).collect(), dict(enumerate(texts)))
    got = {r.doc_id: r.text for r in pii.redact(df, model).collect()}
    assert got[0] == " ".join(["[EMAIL]"] * n) and got[1] == "\n".join(["[IP]"] * n) and got[3] == "; ".join(["[PHONE]"] * n) and got[4] == "\n".join(["[CARD]"] * n)


def test_spans_do_not_overlap_added_ones(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in pii.personal_data(rows, model, ["doc_id", "text"]).collect():
        exact_ones = {*exact(r.text)[1].split(",")} - {""}
        spans = [(int(s.split(":")[1]), int(s.split(":")[2])) for s in r.spans.split(",") if s]
        for s in {*r.spans.split(",")} - {""} - exact_ones:
            a, b = map(int, s.split(":")[1:])
            assert sum(x < b and a < y for x, y in spans) == 1


def test_any_column_name(spark, model):
    names = ["__email", "__text", "__spans", "__exact", "__proposed", "__new", "__redacted", "__source", "meta.lang", "c0", "c1", "a b"]
    df = spark.createDataFrame([(1, "x a@b.cd"), (None, None)], "doc_id long, text string").select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    got = pii.redact(df, model)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "x [EMAIL]", *range(len(names))), (None, None, *range(len(names)))], key=repr)
    got = pii.personal_data(df, model, ["doc_id", *names])
    assert got.columns[: len(names) + 1] == ["doc_id", *names] and got.where("n_email = 1").count() == 1


def test_dense_short_numbers(spark):
    """A table of single digits: each has two proposals, not twenty-three, and the cost grows with the text."""
    import time

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = pii.fit(docs)
    took = {}
    for size in (20_000, 100_000):
        df = spark.createDataFrame([(1, " ".join("1234567890"[k % 10] for k in range(size // 2))), (2, "call 555-123-4567 or +1 415 555 2671")], "doc_id long, text string")
        start = time.perf_counter()
        got = {r.doc_id: r for r in pii.personal_data(df, model, ["doc_id"]).collect()}
        took[size] = time.perf_counter() - start
        assert got[2].n_phone == 1 and got[1].n_phone == 0
    assert took[100_000] < 10 * max(took[20_000], 1)
