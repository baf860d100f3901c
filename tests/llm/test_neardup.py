"""SimHash near-duplicates against all pairs, and components against a union-find."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from rastermill.llm import entry, graph, shingles, simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + n]).encode(), seed=42).intdigest() for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        ra, rb = sorted((root(a), root(b)))
        up[rb] = ra
    return {n: root(n) for n in nodes}


def expected(rows):
    fps = [(i, fingerprint(t)) for i, t in rows]
    distinct = sorted({f for _, f in fps})
    of = components(distinct, [(a, b) for a, b in itertools.combinations(distinct, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in fps:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    return sorted(((i, f"{f:016x}", least.get(of[f])) for i, f in fps), key=repr)


def found(df):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()), key=repr)


def test_every_four_shared_bytes_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any({*t} <= {*four} for t in simhash.TRIPLES) for four in itertools.combinations(range(8), 4))


@pytest.mark.parametrize("long_posting", [128, 2, 0])
def test_links_equal_all_pairs(spark, long_posting):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for s in seeds for _ in range(12)} | {*seeds}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = sorted(tuple(sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1))) for r in simhash.links(df, long_posting=long_posting).collect())
    assert got == sorted(p for p in itertools.combinations(sorted(fps), 2) if (p[0] ^ p[1]).bit_count() <= 4)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    random.Random(1).shuffle(chain)
    links = [*chain, *[(100, 100 + i) for i in range(1, 20)], (200, 200), (7, 7), (301, 300), (300, 301), (None, 5)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert got == components({n for x in real for n in x}, real)
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = expected([(r.doc_id, r.text) for r in docs.collect()])
    assert found(simhash.near_duplicates(docs)) == want
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in entry.op9_simhash(spark, sf).collect()), key=repr)
    assert got == want


LONG = " ".join(f"w{i % 977}" for i in range(40000))
EDGE = [(5, None), (4, ""), (3, " \n\t"), (2, "one two"), (2, "one two"), (9, "ONE two"), (None, "one two"), (None, "alone here"), (1, LONG), (8, LONG + " end"), (7, "éÉ  x a b c"), (6, "a b c d e f g h")]


def test_edge_cases(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    assert found(simhash.near_duplicates(df)) == expected(EDGE)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def similar_groups(rows):
    """The smallest id of the group of each row, by the similarity of all pairs of sets of five-word shingles; ids differ."""
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] == sets[b] or min(len(sets[a]), len(sets[b])) * 5 >= 4 * max(len(sets[a]), len(sets[b])) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return components({*sets}, near)


def test_similar_texts_of_many_differing_bits(spark):
    rng = random.Random(8)
    rows = [(0, None), (1, " "), (2, "one two"), (3, "ONE two"), (4, "one three")]
    for _ in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(40, 160))]
        for edits in (0, 1, 1, 2, 3, 5):
            w = base[:]
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join([*w, *["a very common line of words"] * rng.randrange(2)])))
    rows += [(len(rows) + k, " ".join([*[f"c{j}" for j in range(60)][: 60 - k], *[f"d{k}.{j}" for j in range(k)]])) for k in range(15)]  # a chain
    want = {*similar_groups(rows).values()}
    assert len(want) < len({c for _, _, c in expected(rows)})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == sorted(want)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = simhash.one_of_each(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sorted(r.doc_id for r in got.collect()) == sorted({*similar_groups(texts).values()})


def test_dense_group_about_the_limit(spark):
    """Copies of one text with none to six edits: most are near some others but not all, and share most of their prefixes."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(140):
        w = base[: rng.choice([150, 150, 150, 130, 120])]
        for _ in range(rng.choice([1, 2, 2, 3, 3, 4, 5, 6])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(12)}"
        rows.append((k, " ".join(w)))
    want = {*similar_groups(rows).values()}
    assert 5 < len(want) < 120
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


CLASHES = ["id", "th", "key", "n", "fp", "first", "c0", "c1", "__n", "__keep", "nth", "said", "meta.lang", "a b", "least", "rows"]


def test_one_row_of_each_group(spark):
    long = " ".join(f"w{i % 977}" for i in range(40000))
    rows = [
        (5, None, "z"), (4, "", "z"), (3, " \n\t", "z"), (2, "one two", "z"), (2, "ONE two", "y"), (9, "ONE two", "z"), (None, "one two", "z"), (None, "one two", "z"), (1, long, "z"), (8, long + " end", "z"),
        (7, "éÉ  x a b c", "z"), (6, "a b c d e f g h", "q"), (6, "a b c d e f g h", "p"), (6, "wholly other words under the same id", "z"), (11, "wholly other words under the same id", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    df = df.select("doc_id", "text", "note", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    got = simhash.one_of_each(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    kept = sorted(((r.doc_id, (r.text or "")[:12], r.note) for r in got.collect()), key=repr)
    two = min((2, "one two", "z"), (2, "ONE two", "y"), key=lambda r: spark.range(1).select(F.xxhash64(F.lit(r[1]))).first()[0])
    six = next(r for r in kept if r[0] == 6 and r[1].startswith("a b"))
    assert kept == sorted([(3, " \n\t", "z"), two, (None, "one two", "z"), (None, "one two", "z"), (1, long[:12], "z"), (7, "éÉ  x a b c", "z"), six, (6, "wholly other", "z")], key=repr)
    assert simhash.one_of_each(df.limit(0)).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # joins that shuffle give the same rows
    assert sorted(((r.doc_id, (r.text or "")[:12], r.note) for r in simhash.one_of_each(df).collect()), key=repr) == kept
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fingerprint_of_the_definition():
    for t in [None, "", "a", "a b c d e f g a b c d", "É é x Y", LONG]:
        assert shingles.fingerprint(shingles.hashes(t.encode() if t else None, 4)) == fingerprint(t)


def test_postings_are_shuffled_once(spark):
    df = spark.createDataFrame([(k * 7919,) for k in range(100)], "fp long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = simhash.links(df)
    got.collect()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
