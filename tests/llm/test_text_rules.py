"""Rule counts, forest, classifier and language filters: exact counts by brute force, held-out accuracy, edge cases."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.llm import entry, gam, isolation, langid, textstats

WORD = re.compile("[^\x20\x09-\x0d]+")
EDGE = [(1, None), (2, ""), (3, " \n\n"), (4, "a b c a b c\nx\nx\n \n \n"), (4, "a b c a b c\nx\nx\n \n \n"), (5, "#$ |<>&*% éé \U0001f600"), (6, "w " * 30000), (None, "same same same same")]


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len({*lines}), len(covered)


def check_base(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n, *_, rep = want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


def test_rules_on_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check_base(entry.op2_quality_rules(spark, sf).collect(), texts)


def test_forest_tells_bad_from_good(spark):
    d = "/root/testdata/sf0.01"
    rows = entry.op2_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = {r[0]: r[1] for r in rows}
    assert share[1] > 0.97 and share[0] < 0.1


def test_rules_on_edge_cases(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("anomaly", F.lit("clash")).withColumn("n_words", F.lit("clash"))
    got = isolation.quality_rules(df, None, df.columns[:1] + ["anomaly"])
    assert got.columns.count("anomaly") == 1 and got.schema["anomaly"].dataType.simpleString() == "double"
    check_base([r for r in got.collect() if r.doc_id != 4], {i: t for i, t in EDGE if i != 4})
    assert got.where("doc_id = 4").distinct().count() == 1
    assert isolation.quality_rules(df.limit(0), None, ["doc_id"]).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert isolation.fit(df, no_labels) is None


def test_repeats_with_many_ids():
    ids = np.array([0, (1 << 40), 7, 0, (1 << 40), 7, 9])
    assert textstats.repeated_words(ids) == 6
    assert textstats.repeated_words(np.array([1, 1, 1, 1])) == 4 and textstats.repeated_words(np.array([], int)) == 0


def test_threshold_keeps_the_good():
    scores, good = np.array([0.1, 0.2, 0.3, 0.8, 0.9, 0.25]), np.array([1, 1, 1, 0, 0, 0], bool)
    assert 0.3 < isolation.threshold(scores, good, 1.0) < 0.8
    assert isolation.threshold(np.zeros(0), np.zeros(0, bool)) == 1.0


def test_classifier_on_rows_it_never_saw(spark):
    d = "/root/testdata/sf0.01"
    rows = entry.op3_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    seen = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in seen]) > 0.97


def test_classifier_learns_from_open_rows_only(spark):
    docs = spark.createDataFrame([(i, "good words here " * (i % 5 + 1) if i % 2 else "$$$ ||| ###" * (i % 4 + 1)) for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (gam.classify(docs, gam.fit(docs, x), ["doc_id"]).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b and all(r.predicted == r.doc_id % 2 for r in a)


def test_classifier_edge_cases(spark):
    df = spark.createDataFrame(EDGE, "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = gam.classify(df, gam.fit(df, none), ["doc_id", "score"]).collect()
    assert len(got) == len(EDGE) and all(r.score == 0.5 and r.predicted == 1 for r in got)
    known = next(i for i in range(1, 7) if zlib.crc32(str(i).encode()) % 3 != 1)
    one = spark.createDataFrame([(known, 0), (known, 0), (None, 1), (2 if known != 2 else 1, None), (99, 1)], "doc_id long, quality int")
    assert all(r.score < 0.5 for r in gam.classify(df, gam.fit(df, one), ["doc_id"]).collect())
    assert gam.classify(df.limit(0), gam.Gam(), ["doc_id"]).count() == 0


def test_a_pair_table_learns_what_no_single_feature_tells():
    x = np.random.default_rng(0).integers(0, 2, (800, 3)).astype(float)
    y = (x[:, 0] != x[:, 1]).astype(float)
    model = gam.Gam.fit(x, y)
    assert model.pairs[0] == (0, 1) and ((model.score(x) >= 0.5) == y).all()


def test_language_on_rows_it_never_saw(spark):
    d = "/root/testdata/sf0.01"
    rows = entry.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.97


def test_language_edge_cases(spark):
    docs = [(i, ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * 3, "en" if i % 2 else "fr") for i in range(40)]
    filters = langid.fit(spark.createDataFrame([*docs, (100, None, "en"), (101, "x y", None)], "doc_id long, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 !? ²"), (4, "中文"), (5, "THE CAT"), (6, "la table " * 20000), (6, "la table"), (None, "the mat")]
    got = {(r.doc_id, (r.lang_pred, r.score > 0)) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("zz")), filters, ["doc_id", "lang"]).collect()}
    assert got == {(1, ("und", False)), (2, ("und", False)), (3, ("und", False)), (4, (filters.langs[filters.common], False)), (5, ("en", True)), (6, ("fr", True)), (None, ("en", True))}
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.LanguageFilters.predict(empty, [b"abc", None]) == (["und", "und"], [0.0, 0.0])


def test_more_languages_than_bits_in_a_word():
    grams = {f"l{k:03d}": langid.gram_counts([bytes([97 + k % 26, 97 + k // 26, 97 + (k * 7) % 26]) * 2])[1] for k in range(130)}
    filters = langid.LanguageFilters.build(grams, None)
    assert len(filters.planes) == 3
    for k in (0, 63, 64, 129):
        assert filters.predict([bytes([97 + k % 26, 97 + k // 26, 97 + (k * 7) % 26]) * 2])[0] == [f"l{k:03d}"]


@pytest.mark.parametrize("text", ["ab", "été x", "a-b"])
def test_as_many_grams_as_letters_twice(text):
    assert langid.gram_counts([text.encode()])[2].sum() == 2 * sum(c.isalpha() for c in text)


def test_blocks_change_no_count():
    texts = ["Été à la plage, ΟΔΟΣ x " * 7, None, "ab", "", "z" * 40, "\U0001f600 ünï"]
    raw = [t.encode() if t is not None else None for t in texts]
    whole = langid.gram_counts(raw)
    brute = {}
    for r, t in enumerate(texts):
        s = (t or "").lower()
        for k, c in enumerate(s):
            if c.isalpha():
                near = [s[j] if 0 <= j < len(s) and s[j].isalpha() else "" for j in (k - 2, k - 1, k, k + 1)]
                near[0] = near[0] if near[1] else ""
                for g in (tuple(near[1:]), tuple(near)):
                    brute[r, g] = brute.get((r, g), 0) + 1
    assert sorted(whole[2].tolist()) == sorted(brute.values()) and np.bincount(whole[0]).tolist() == np.bincount([r for r, _ in brute]).tolist()
    for block in (1, 2, 3, 10, 64):
        assert all((a == b).all() for a, b in zip(whole, langid.gram_counts(raw, block)))


def test_a_language_of_one_document(spark):
    finnish = "tämä on lyhyt suomenkielinen teksti joka kertoo metsästä ja järvestä"
    docs = [(i, f"the cat number {i} sat on the mat and looked at the {'dog bird fish'.split()[i % 3]}", "en") for i in range(200)]
    open_id = next(i for i in range(1000, 1010) if zlib.crc32(str(i).encode()) % 4 != 2)
    filters = langid.fit(spark.createDataFrame([*docs, (open_id, finnish, "fi")], "doc_id long, text string, lang string"))
    langs, scores = filters.predict([finnish.encode(), "kertoo järvestä".encode(), b"the cat looked at the dog", "żółw źdźbło".encode()])
    assert langs[:3] == ["fi", "fi", "en"] and min(scores[:3]) > 0.5 and scores[3] < 0.2


def test_few_good_rows_make_a_forest(spark):
    docs = spark.createDataFrame([(i, "good words here " * 20 + str(i) if i < 7 else "$$$ ||| ###" * (i % 4 + 1)) for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") < 7).cast("int").alias("quality"))
    assert isolation.fit(docs, labels) is not None
    assert isolation.fit(docs, labels.where("quality = 0")) is None


def test_repeated_ids_and_samples(spark):
    from rastermill.llm import common, training

    docs = spark.createDataFrame([(i % 5, f"text {i} " * (i % 7 + 1)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] * 3, "doc_id long, quality int")
    matrix = lambda texts: textstats.feature_matrix(texts)[1]
    a, b = (training.labelled_features(d, labels, "quality", matrix) for d in (docs, docs.repartition(7)))
    assert a[0].tolist() == [0, 1, 2, 3, 4] and (a[1] == b[1]).all() and a[2].tolist() == [0, 1, 0, 1, 0]
    rows = spark.range(1_000_000)
    rare = rows.where("id % 5000 = 0").select("id")
    got = common.smallest_hash(rare, "id", 150, 1_000_000, 64)
    assert sorted(r[0] for r in got.collect()) == sorted(r[0] for r in common.smallest_hash(rare, "id", 150).collect()) and got.count() == 150


def trees_by_hand(model, x):
    """The mean path of each row, one step at a time."""
    out = []
    for row in x:
        paths = []
        for at in model.roots:
            while model.feature[at] >= 0:
                at = model.left[at] + (0 if row[model.feature[at]] < model.value[at] else 1)
            paths.append(model.path[at])
        out.append(2.0 ** (-np.mean(paths) / float(isolation.mean_path(isolation.POINTS))))
    return np.array(out)


def test_verdicts_by_walking_each_tree(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    forest = isolation.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = isolation.quality_rules(docs, forest, ["doc_id"]).collect()
    want = trees_by_hand(forest, textstats.feature_matrix([(texts[r.doc_id] or "").encode() for r in rows])[1])
    assert np.allclose([r.anomaly for r in rows], want) and [r.kept for r in rows] == [not r.base_failed and w < forest.threshold for r, w in zip(rows, want)]


def test_scores_by_adding_table_entries(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = gam.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in gam.classify(docs, model, ["doc_id"]).collect():
        x = textstats.measure((texts[r.doc_id] or "").encode())[1]
        logit = model.start + sum(t[sum(c <= v for c in e)] for e, t, v in zip(model.edges, model.tables, x))
        low = [sum(c <= v for c in e) for e, v in zip(model.coarse, x)]
        logit += sum(t[low[i], low[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-9


def test_all_labelled_rows_make_the_forest_and_its_threshold(spark):
    docs = spark.range(7000).selectExpr("id AS doc_id", "concat(repeat(concat('w', id % 13, ' '), 3 + id % 50), if(id % 9 = 0, repeat('$# ', id % 40), ''), if(id = 6999, repeat('X ', 30000), '')) AS text")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 9 <> 0 AS INT) AS quality")
    forest = isolation.fit(docs, labels)
    rows = docs.join(labels, "doc_id").withColumn("cut", isolation.for_cut("doc_id")).collect()
    x, good, cut = textstats.feature_matrix([r.text.encode() for r in rows])[1], np.array([r.quality > 0 for r in rows]), np.array([r.cut for r in rows])
    assert forest.threshold == isolation.threshold(forest.score(x[cut]), good[cut])
    lost = []
    for root in forest.roots[:3]:
        todo = [(root, x[good & ~cut], 0)]
        while todo:
            at, own, d = todo.pop()
            if forest.feature[at] < 0:
                lost.append(abs(forest.path[at] - d - isolation.mean_path(len(own))))
                continue
            low = own[:, forest.feature[at]] < forest.value[at]
            todo += [(forest.left[at], own[low], d + 1), (forest.left[at] + 1, own[~low], d + 1)]
    assert max(lost) < 1e-9


@pytest.mark.parametrize("seed", range(3))
def test_cut_over_a_table_is_the_threshold(spark, seed):
    rng = np.random.default_rng(seed)
    s, good = rng.integers(1, [40, 4000, 1 << 20][seed], 900) / [39, 3999, 1 << 21][seed], rng.random(900) < [0.9, 0.995, 1.0][seed]
    s = np.where(good, s / 2, s)
    got = isolation.cut_of(spark.createDataFrame([(float(a), bool(g)) for a, g in zip(s, good)], "s double, good boolean"))
    assert got == isolation.threshold(s, good)
