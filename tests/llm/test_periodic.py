"""Lyndon arrays and runs against their definitions, and the query against row-by-row Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.llm import entry, periodic


def lyndon(s):
    """The next smaller suffix, by comparing all."""
    return [next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s)) - i for i in range(len(s))]


def brute(a, least=6, exponent=4):
    """Runs by trying every period at every place."""
    n, out = len(a), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if a[i] != a[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and a[j] == a[j + q]:
                j += 1
            size = j - i + q
            smaller = any(all(a[i + k] == a[i + k + d] for k in range(size - d)) for d in range(1, q))
            if size >= max(least, exponent * q) and not smaller:
                out.append((i, size, q))
            i = j
    return sorted(out)


def by_periods(a, least=6, exponent=4):
    """Runs by one comparison of the text with itself for each period; those whose period is a multiple of another run's there go."""
    out = []
    for q in range(1, len(a) // exponent + 1):
        same = a[:-q] == a[q:]
        if same.sum() < max(least - q, (exponent - 1) * q):
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).astype(np.int8))).reshape(-1, 2).tolist()
        for s, e in edge:
            if e - s + q >= max(least, exponent * q) and not any(x <= s and e + q <= x + n and q % p == 0 for x, n, p in out):
                out.append((s, e - s + q, q))
    return sorted(out)


def drawn(rng):
    out = []
    for _ in range(rng.randint(0, 4)):
        part = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(1, 5))]
        out += part * rng.randint(1, 7) + part[: rng.randint(0, len(part))] + [rng.randrange(6) for _ in range(rng.randint(0, 3))]
    return out


def test_lyndon_arrays():
    rng = random.Random(3)
    for _ in range(2000):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        assert periodic.lyndon_array(s) == lyndon(s)
    assert periodic.lyndon_array([0] * 50_000) == [1] * 50_000
    assert periodic.lyndon_array(list(range(50_000))) == list(range(50_000, 0, -1))


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (6, 3), (1000, 2)])
def test_runs(least, exponent):
    rng = random.Random(least)
    for _ in range(1500):
        a = drawn(rng)
        assert periodic.runs(np.array(a, np.int32), least, exponent) == brute(a, least, exponent) == by_periods(np.array(a, np.int32), least, exponent)


@pytest.mark.parametrize("rounds", [0, 1])
def test_fewer_rounds_of_parting_lose_nothing(monkeypatch, rounds):
    rng, real = random.Random(rounds), periodic._stretches
    for _ in range(500):
        a = drawn(rng)
        monkeypatch.setattr(periodic, "_stretches", lambda *x: real(*x, rounds=rounds))
        assert periodic.runs(np.array(a, np.int32)) == brute(a)


def digest(found):
    return hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()


def expected(doc_id, text, damage=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if damage and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    number = {}
    found = by_periods(np.array([number.setdefault(w, len(number)) for w in words], np.int32))
    dropped = {k for s, size, p in found for k in range(s + p, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    of = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *of, digest(found), hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest())


def test_query(spark, sf):
    want = sorted((r.doc_id, *expected(r.doc_id, r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = entry.op11_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == want
    assert any(r[1] for r in want)


def test_edge_cases(spark):
    texts = [None, "", " \t\n", "a a a a a a", "a a a a a", "x" * 300_000, "la " * 100_000, "a b c d e f g h " * 9, "é é é é é é \x85", "a\x0ba\x0ca\ra\na a"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "b b b b b b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wide = df.select("*", *[F.lit(7).alias(c) for c in ("runs", "n_words", "collapsed", "c0", "__text", "a.b", "c`d")])
    got = periodic.periodic_runs(wide, ["doc_id", "a.b", "c`d", "runs"]).collect()
    assert got[0].__fields__ == ["doc_id", "a.b", "c`d", "n_words", "runs", "collapsed"]
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["collapsed"]): [tuple(x) for x in r["runs"]] for r in got}
    assert by[3, "a"] == [(0, 6, 1)] and by[4, "a a a a a"] == [] and by[6, "la"] == [(0, 100_000, 1)] and by[7, "a b c d e f g h"] == [(0, 72, 8)]
    assert by[8, "é \x85"] == [(0, 6, 1)] and by[9, "a"] == [(0, 6, 1)] and by[None, "b c"] == [(0, 6, 1)]
    assert by[0, ""] == by[1, ""] == by[2, ""] == []
    assert periodic.periodic_runs(df.limit(0), ["doc_id"]).count() == 0
    again = periodic.repeated(wide).collect()
    assert {r["text"] for r in again if r["doc_id"] is None} == {"b b b b b b c"} and len(again) == len(rows)


def test_repeated_tail(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))) for k in range(400)]
    got = {r.doc_id: r.text for r in periodic.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        got_one = periodic.runs(np.array([ord(w) for w in got[k].split()], np.int32))
        assert digest(got_one) == expected(k, t)[5]
