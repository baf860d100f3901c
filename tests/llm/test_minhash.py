"""MinHash near-duplicates against all pairs of whole sets and a union-find."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.llm import entry, minhash

from .test_neardup import components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({k: " " for k in range(9, 14)}).split(" ") if w]
    n = min(4, len(words))
    return frozenset(" ".join(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset()


def brute(rows):
    """Sorted (id, set size, component, kept) of rows (id, text)."""
    sets = [shingles(t) for _, t in rows]
    kinds = sorted({s for s in sets if s}, key=sorted)
    place = {s: k for k, s in enumerate(kinds)}
    holds = {}
    for k, s in enumerate(kinds):
        for x in s:
            holds.setdefault(x, []).append(k)
    met = {p for own in holds.values() for p in itertools.combinations(own, 2)}
    of = components(range(len(kinds)), [(a, b) for a, b in met if 100 * len(kinds[a] & kinds[b]) >= 80 * len(kinds[a] | kinds[b])])
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[of[place[s]]] = min(i, least.get(of[place[s]], i))
    got = [(i, len(s), least.get(of[place[s]]) if s else i) for (i, _), s in zip(rows, sets)]
    return sorted([(i, n, c, i == c) for i, n, c in got], key=repr)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def near_copies(rng, groups, most, words=120):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(1, words))]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                k = rng.randrange(len(copy))
                copy[k : k + rng.randint(0, 1)] = [f"new{rng.randrange(50)}"]
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_two_permutations_estimate_similarity():
    rng = np.random.default_rng(1)
    off = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (400, 60, 60))
        c = minhash.coordinates([np.unique(np.concatenate((both, a))), np.zeros(0, np.uint64), np.unique(np.concatenate((both, b)))], 160)
        off.append((c[0] == c[2]).mean() - 400 / 520)
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.06


def test_coordinates_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (5000, 0, 3, 1, 700)]
    want = minhash.coordinates(sets, 12)
    monkeypatch.setattr(minhash, "BLOCK", 64)
    assert (minhash.coordinates(sets, 12) == want).all()
    places = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    room = np.empty_like(places)
    assert len(np.unique(minhash._shifted(places, 5, room, room.copy()))) == len(places)


def test_odd_sketch_is_a_bound():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 3000, rng.integers(1, 2500)).astype(np.uint64) << np.uint64(20)) for _ in "ab")
        differ = sum(int(x).bit_count() for x in (minhash.odd_sketch(a) ^ minhash.odd_sketch(b)).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    rows = near_copies(random.Random(seed), 25, 24)
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_one_large_group_about_the_limit(spark):
    """Copies of one text, many of them below the limit with each other: only the text joins them."""
    rng = random.Random(7)
    base = [f"b{k}" for k in range(300)]
    rows = []
    for k in range(250):
        copy = list(base)
        for at in rng.sample(range(20), rng.randint(4, 10)):
            copy[at * 15] = f"x{rng.randrange(10_000)}"
        rows.append((k, " ".join(copy)))
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    rows.append((900, " ".join(base)))
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.op12_minhash(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert found(got) == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"v{k % 5000}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "é É one two"), (8, long), (9, long + " more"), (None, "one"), (None, "lonely words"), (4, "one"), (10, "A b C d e"), (11, "a B c D E")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wide = df.select("*", *[F.lit(1).alias(c) for c in ("id", "th", "cid", "sig", "k1", "said", "a.b", "c`d")])
    got = found(minhash.near_duplicates(wide))
    want = [(i, n, c, True if i is None and c is None else kept) for i, n, c, kept in brute(rows)]
    assert got == sorted(want, key=repr)
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert found(minhash.near_duplicates(df.where("doc_id <= 3"))) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
