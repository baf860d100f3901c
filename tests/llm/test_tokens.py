"""Token counts against piece-by-piece matching; packing as an exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rastermill.llm import entry, packing, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "Hello, World!! it's 2024", "THE ééé ÀÉ ª ² ½ x", "中文 текст Σας ΣΑΣ İstanbul", "<|endoftext|> a<|startoftext|>b", "a b c\x1cd\x85e", "don't we'll 'S x'Ve", "🙂🙂 a🙂b", "###$$$ a,b;c:d. ...!?", "word " * 9000, "x" * 5000, "� ́a", "ǅ ß ŉ ΐ"]


@pytest.fixture(scope="module")
def vocabulary():
    return {*tokencount.pieces(PATH)}


@pytest.fixture(scope="module")
def automaton():
    return tokencount.LongestMatch(tokencount.pieces(PATH))


def greedy(word, vocabulary):
    left, n = (*word, tokencount.END), 0
    while left and left != (tokencount.END,):
        size = next((k for k in range(len(left), 0, -1) if left[:k] in vocabulary), 1)
        left, n = left[size:], n + 1
    return n


def test_small_vocabularies_by_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        pieces = {tuple(rng.choice(b"ab") for _ in range(rng.randint(1, 6))) + (tokencount.END,) * rng.randint(0, 1) for _ in range(12)}
        m = tokencount.LongestMatch(sorted(pieces))
        for _ in range(40):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30)))
            assert m.count(w) == greedy(w, pieces | {(b,) for b in range(256)})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="thestringoféß中,.x", max_size=40))
def test_counts_by_brute_force(vocabulary, automaton, word):
    assert automaton.count(word.encode()) == greedy(word.encode(), vocabulary)


def count(text, vocabulary):
    return sum(greedy(w.encode(), vocabulary) for w in regex.findall(tokencount.WORD, (text or "").lower()))


def test_counts_of_texts(spark, vocabulary):
    texts = [t for t in TEXTS if not t or len(t) < 20000 and "\x85" not in t]
    df = spark.createDataFrame([*enumerate(texts), (99, "again"), (99, "again")], "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = tokencount.token_counts(df, PATH, ["doc_id", "n_tokens"])
    rows = {(r.doc_id, r.n_tokens) for r in got.collect()}
    assert rows == {*((i, count(t, vocabulary)) for i, t in enumerate(texts)), (99, count("again", vocabulary))} and got.count() == len(texts) + 2
    assert tokencount.token_counts(df.limit(0), PATH, ["doc_id"]).count() == 0


def test_counts_of_documents(spark, sf, vocabulary):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = entry.op1_token_counts(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows[::7]:
        assert r.n_tokens == count(texts[r.doc_id], vocabulary)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check_pieces(rows, texts, tokenizer, limit=2048):
    """Each id in one piece, sequences full from 0 without a gap; returns the sequences' lengths."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert {*by_doc} == {*texts}
    for i, pieces in by_doc.items():
        ids, at = ids_of(tokenizer, texts[i]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
    return [sum(p.length for p in v) for v in by_sequence.values()]


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    e = packing.Encoder(PATH)
    for t, (ids, stops) in zip(TEXTS * 2, e([t.encode() if t is not None else None for t in TEXTS * 2])):
        assert ids == ids_of(tokenizer, t)[:-1].tobytes(), t
        assert (stops <= len(ids) // 4).all()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_on_any_text(tokenizer, text):
    assert packing.encoder(PATH)([text.encode("utf-8", "replace")])[0][0] == ids_of(tokenizer, text.encode("utf-8", "replace").decode())[:-1].tobytes()


def test_pieces_of_documents(spark, sf, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lengths = check_pieces(entry.op10_packing(spark, sf).collect(), texts, tokenizer)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert padding < 0.02 * sum(lengths)


def test_pieces_of_edge_cases(spark, tokenizer):
    texts = dict(enumerate(TEXTS))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(3)
    check_pieces(packing.pack(df, PATH, block=3000).collect(), texts, tokenizer)
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string"), PATH).collect()
    assert sorted((r.doc_id or 0, r.start, r.length) for r in twice) == [(0, 0, 2), (1, 0, 3), (1, 0, 3)]


def cost(lengths, penalties, limit):
    return sum((0 if n in packing.POWERS or n == limit else limit - n) + p + packing.SEQUENCE_COST for n, p in zip(lengths, penalties))


def test_cuts_are_the_cheapest():
    rng = random.Random(11)
    for _ in range(300):
        limit = 32
        where = np.cumsum([rng.randint(1, 30) for _ in range(rng.randint(1, 9))])
        pen = np.array([rng.choice([0.0, 2.0, 12.0]) for _ in where])
        cuts = packing.cheapest_cuts(where, pen, limit)
        assert cuts[-1] == where[-1] and set(cuts) <= set(where.tolist())
        of = dict(zip(where.tolist(), pen.tolist()))
        mine = cost(np.diff([0, *cuts]).tolist(), [of[c] for c in cuts], limit)
        best = {0: 0.0}
        for j in where.tolist():
            best[j] = min(best[i] + cost([j - i], [of[j]], limit) for i in best if j - i <= limit)
        assert mine == pytest.approx(best[int(where[-1])])
