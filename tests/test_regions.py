"""Regions over layers, decoding by tiles, squares of any size, waves of overlapping squares, exhaustive search, prefix codes, runs by rate."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rastermill.operators import cells, codes, evaluate, layers, regions, residual, search, strokes, waves
from rastermill.sources import netpbm, storage

from .test_operators import raster, values

CELL = ["image_id", "channel", "row", "col"]
BOOK = [-40, -10, 0, 10, 40]
KIND = "image_id long, stroke_id long, channel int, row int, col int, size int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def noisy(spark, h, w, channels=3, seed=1):
    rng = random.Random(seed)
    return raster(spark, h, w, lambda c, i, j: (i * 9 + j * 5 + c * 40 + rng.randrange(60)) % 256, channels=channels)


def test_region_layers_are_decoded_and_never_raise_the_error(spark):
    p = noisy(spark, 21, 27)
    flat = cells.fill_canvas(p, residual.start_color(p))
    made, cost = regions.encode_regions(p, flat, [8, 6, 2], BOOK, 21, 27, 3, 2)
    got = layers.decode_layers(flat, made, [8, 6, 2], BOOK, (21, 27, 3))
    left = residual.residual(p, got).agg(F.sum(F.col("diff") * F.col("diff"))).first()[0]
    by_layer = cost.orderBy("layer").collect()
    first = residual.residual(p, flat).agg(F.sum(F.col("diff") * F.col("diff"))).first()[0]
    assert first >= by_layer[0].sse >= by_layer[1].sse >= by_layer[2].sse == left
    assert all(r.regions <= 6 and r.bits == 3 * r.codes + 3 * r.regions + 6 for r in by_layer)
    assert made.groupBy("layer").agg(F.count("*").alias("n")).orderBy("layer").select("n").collect() == cost.orderBy("layer").select(F.col("codes").alias("n")).collect()


def test_all_regions_equal_all_layers(spark):
    p = noisy(spark, 16, 16)
    flat = cells.fill_canvas(p, residual.start_color(p))
    made, cost = regions.encode_regions(p, flat, [8, 4], BOOK, 16, 16, 2, 4, "Default")
    whole = {(r.layer, r.sse) for r in layers.encode_layers(p, flat, [8, 4], BOOK).collect()}
    assert {(r.layer, r.sse) for r in cost.collect()} == whole
    drop = made.groupBy("channel", "layer", "qr", "qc").count()
    assert drop.where("count > 1").isEmpty()  # borders of regions lie on those of quarters here


def test_a_layer_joins_regions_without_a_shuffle_of_cells(spark):
    p = noisy(spark, 8, 8)
    start = regions._tiled(p, p, 8, 8, 2)
    assert "Exchange" not in plan(regions._errors(start))
    some = start.select(*regions.REGION).distinct().hint("shuffle_hash").withColumn("last", F.lit(-1))
    assert "Exchange" not in plan(start.join(some, regions.REGION))


def test_ragged_and_sparse_rasters_are_decoded(spark):
    p = noisy(spark, 7, 11, 1).where("(row * 11 + col) % 13 <> 5")
    flat = p.withColumn("value", F.lit(100))
    done = layers.encode_cells(p, flat, [8, 4, 2], BOOK)
    again = layers.decode_layers(flat, layers.layer_codes(done, [8, 4, 2]).where("NOT (layer = 2 AND qr = 0)"), [8, 4, 2], BOOK)
    skipped = done.withColumn("canvas", F.col("canvas"))
    want = values(skipped.select(*CELL, F.col("canvas").alias("value")).where("row > 0"), "row", "col")
    # codes of layer_codes come from each quarter's first cell; where a sparse raster lacks it, the quarter has no code
    held = {(r.layer, r.qr, r.qc) for r in layers.layer_codes(done, [8, 4, 2]).collect()}
    got = values(again, "row", "col")
    full = [k for k in want if all((layer, k[0] // h, k[1] // h) in held for layer, h in enumerate((4, 2, 1)))]
    assert full and all(got[k] == want[k] for k in full)


def test_bucketed_tables_are_joined_without_a_shuffle(spark):
    p = noisy(spark, 16, 16)
    flat = cells.fill_canvas(p, residual.start_color(p))
    made = layers.layer_codes(layers.encode_cells(p, flat, [8, 4, 2], BOOK), [8, 4, 2])
    keys = ["image_id", "channel", "tr", "tc"]
    start = storage.write_bucketed(layers.canvas_tiles(flat, [8, 4, 2]), "t_canvas", keys, 4)
    held = storage.write_bucketed(layers.code_tiles(made, [8, 4, 2], BOOK), "t_codes", keys, 4)
    got = layers.decode_tiles(start.hint("merge"), held, [8, 4, 2])
    assert "Exchange" not in plan(got)
    assert residual.diff_cells(got, layers.decode_layers(flat, made, [8, 4, 2], BOOK)).count() == 0


def test_large_squares_make_few_rows_and_the_same_pairs(spark):
    rng = random.Random(3)
    rows = [(1, k, 0, rng.randint(-300, 3000), rng.randint(-300, 3000), rng.choice([1, 2, 3, 15, 16, 17, 40, 300, 4096])) for k in range(120)]
    s = spark.createDataFrame(rows, KIND)
    tiles = strokes._tiles(s.withColumn("grid", strokes._level()))
    assert tiles.groupBy("stroke_id").count().agg(F.max("count")).first()[0] <= 4
    meet = lambda a, b: a[3] < b[3] + b[5] and b[3] < a[3] + a[5] and a[4] < b[4] + b[5] and b[4] < a[4] + a[5]
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if meet(a, b)}
    got = [(r.first, r.second) for r in strokes.overlapping_strokes(s).collect()]
    assert len(got) == len(want) and {*got} == want
    p = raster(spark, 40, 30, lambda *_: 0)
    covered = {(k, i, j, 2 * (i >= r + n // 2) + (j >= c + n // 2)) for _, k, _, r, c, n in rows for i in range(max(0, r), min(40, r + n)) for j in range(max(0, c), min(30, c + n))}
    found = [(r.stroke_id, r.row, r.col, r.quarter) for r in strokes.footprint(s, p).collect()]
    assert len(found) == len(covered) and {*found} == covered
    assert strokes.footprint(s.limit(0), p).count() == 0 == strokes.overlapping_strokes(s.limit(0)).count()


def sequential(target, canvas, squares, book):
    """Codes and canvas of squares fitted one after the other; cells as {(row, col): value}."""
    canvas, out = dict(canvas), {}
    for _, k, _, r, c, n in sorted(squares, key=lambda s: s[1]):
        for q in range(4):
            own = [p for p in canvas if r <= p[0] < r + n and c <= p[1] < c + n and 2 * (p[0] >= r + n // 2) + (p[1] >= c + n // 2) == q]
            if own:
                total = sum(target[p] - canvas[p] for p in own)
                idx = min(range(len(book)), key=lambda i: (abs(book[i] * len(own) - total), i))
                out[k, q] = idx
                canvas |= {p: max(0, min(255, canvas[p] + book[idx])) for p in own}
    return out, canvas


def test_waves_equal_one_square_after_the_other(spark):
    rng = random.Random(8)
    squares = [(1, 3 * k, 0, rng.randint(-2, 11), rng.randint(-2, 13), rng.randint(1, 7)) for k in range(25)]
    p, flat = noisy(spark, 12, 14, 1), raster(spark, 12, 14, lambda *_: 120)
    made, done = waves.fit_strokes(p, flat, spark.createDataFrame(squares, KIND), BOOK)
    want, canvas = sequential(values(p, "row", "col"), values(flat, "row", "col"), squares, BOOK)
    assert {(r.stroke_id, r.quarter): r.idx for r in made.collect()} == want and values(done, "row", "col") == canvas
    levels = {r.stroke_id: r.level for r in waves.stroke_levels(spark.createDataFrame(squares, KIND)).collect()}
    meet = lambda a, b: a[3] < b[3] + b[5] and b[3] < a[3] + a[5] and a[4] < b[4] + b[5] and b[4] < a[4] + a[5]
    for s in squares:
        assert levels[s[1]] == max([levels[o[1]] + 1 for o in squares if o[1] < s[1] and meet(o, s)], default=0)
    none = spark.createDataFrame([], KIND)
    made, done = waves.fit_strokes(p, flat, none, BOOK)
    assert made.count() == 0 and values(done, "row", "col") == values(flat, "row", "col")


def test_search_equals_brute_force_and_greedy(spark):
    p = noisy(spark, 13, 15, 2).where("NOT (row = 6 AND col = 6)")
    res = residual.residual(p, p.withColumn("value", F.lit(110)))
    diff = {(r.channel, r.row, r.col): r["diff"] for r in res.collect()}
    want = {}
    for size, ch, r, c in itertools.product((2, 6), (0, 1), range(13), range(15)):
        quarters = [[diff.get((ch, r + i, c + j)) for i in range(a, a + size // 2) for j in range(b, b + size // 2)] for a in (0, size // 2) for b in (0, size // 2)]
        if all(None not in q for q in quarters):
            want[ch, r, c, size] = sum(max(2 * m * sum(q) - len(q) * m * m for m in BOOK) for q in quarters)
    gains = storage.checkpoint(search.square_gains(res, [2, 6], BOOK))
    assert {(r.channel, r.row, r.col, r.size): r.gain for r in gains.collect()} == want
    best = {(r.channel, r.size): (r.row, r.col, r.gain) for r in search.best_squares(gains).collect()}
    assert best == {(ch, s): min(((r, c, g) for (h, r, c, z), g in want.items() if (h, z) == (ch, s)), key=lambda x: (-x[2], x[0], x[1])) for ch in (0, 1) for s in (2, 6)}
    greedy = []
    for ch, r, c, s in sorted((k for k, g in want.items() if g > 0), key=lambda k: (-want[k], k[1], k[2], k[3])):
        if not any(h == ch and r < y + z and y < r + s and c < x + z and x < c + s for h, y, x, z in greedy):
            greedy.append((ch, r, c, s))
    got = [(r.channel, r.row, r.col, r["size"]) for r in search.disjoint_squares(gains, [2, 6], 13, 15).collect()]
    assert sorted(got) == sorted(greedy)
    assert search.disjoint_squares(gains.limit(0), [2, 6], 13, 15).count() == 0
    with pytest.raises(ValueError):
        search.square_gains(res, [3], BOOK)


def test_prefix_codes(spark):
    rng = random.Random(2)
    rows = [(i, c, rng.choice([1, 1, 2, 3, 50, 700])) for i in range(30) for c in range(1 + i % 9)]
    got = codes.prefix_lengths(spark.createDataFrame(rows, "image_id long, code int, n long")).collect()
    for i in range(30):
        own = {r.code: (r.n, r.length, r.word) for r in got if r.image_id == i}
        assert {c: n for c, (n, _, _) in own.items()} == {c: n for k, c, n in rows if k == i}
        words = [w for _, _, w in own.values()]
        assert all(len(w) == length for _, length, w in own.values()) and not any(a != b and b.startswith(a) for a in words for b in words)
        total, bits = sum(n for n, _, _ in own.values()), sum(n * length for n, length, _ in own.values())
        entropy = -sum(n * math.log2(n / total) for n, _, _ in own.values())
        assert len({*words}) == len(words) and entropy - 1e-9 <= bits <= entropy + total
        heap = sorted(n for n, _, _ in own.values())
        cost = heap[0] if len(heap) == 1 else 0
        while len(heap) > 1:
            a, b, *heap = heap
            cost += a + b
            heap = sorted([*heap, a + b])
        assert bits == cost


def test_runs_from_histograms_equal_cells(spark):
    p = noisy(spark, 9, 10)
    made = evaluate.uniform_runs(evaluate.value_histogram(p), spark.createDataFrame([(q, s) for q, s in ((1, 100), (2, 10), (3, 1), (4, 255), (5, 256), (6, 7))], "quality int, step int"))
    got = {r.quality: (r.bits, r.mse) for r in made.collect()}
    for q, s in ((2, 10), (6, 7), (1, 100)):
        one = evaluate.uniform_quantise(p, s).first()
        assert got[q] == (one.bits, one.mse)
    assert got[3] == (9 * 10 * 3 * 8, 0)
    with pytest.raises(ValueError):
        evaluate.few_rows(spark.range(5), 4)


def test_matched_rate_pairs_no_runs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randrange(6), float(rng.randrange(8)), rng.randrange(5), 1) for i in range(40) for _ in range(rng.randint(0, 7))]
    rows = [*{(r[0], r[1], r[2]): r for r in rows}.values()]
    df = spark.createDataFrame(rows, "image_id long, codec string, quality int, rate double, mse int, bits int")
    got = evaluate.matched_rate(df, F.expr("codec = 'a'"), F.expr("codec = 'b'"))
    assert plan(got).count("Exchange hashpartitioning") == 1
    want = set()
    for a in rows:
        near = sorted((abs(a[3] - b[3]), b[3], b[2], b[4]) for b in rows if a[1] == "a" and b[1] == "b" and a[0] == b[0])
        if near:
            want.add((a[0], a[2], a[3], a[4], near[0][2], near[0][1], near[0][3]))
    assert {tuple(r) for r in got.collect()} == want


def test_pixmaps_in_bands(spark, tmp_path):
    p = noisy(spark, 19, 23).unionByName(noisy(spark, 19, 23).withColumn("image_id", F.lit(2).cast("long")).where("row <> 4"))
    netpbm.write_pixmaps(p, str(tmp_path / "in"), 19, 23)
    netpbm.write_pixmaps(noisy(spark, 5, 3, 1).withColumn("image_id", F.lit(9).cast("long")), str(tmp_path / "in"), 5, 3, 1)
    (tmp_path / "in" / "x.txt").write_text("no picture")
    (tmp_path / "in" / "y.ppm").write_bytes(b"P6\n# a comment\n2 1\n255\n\x01\x02\x03\x04\x05\x06")
    (tmp_path / "in" / "z.ppm").write_bytes(b"P6 nonsense")
    want = values(p, "image_id", "channel", "row", "col") | {(2, c, 4, k): 0 for c in range(3) for k in range(23)} | values(noisy(spark, 5, 3, 1).withColumn("image_id", F.lit(9)), "image_id", "channel", "row", "col")
    for band in (10, 69, 70, 500, 1 << 20):
        got = netpbm.scan_pixmaps(spark, str(tmp_path / "in"), band)
        own = values(got.where("image_id < 10"), "image_id", "channel", "row", "col")
        assert own == want and got.where("image_id < 10").count() == len(want)
        assert values(got.where("origin LIKE '%/y.ppm'"), "channel", "row", "col") == {(c, 0, k): 3 * k + c + 1 for c in range(3) for k in range(2)}
    small = netpbm.scan_pixmaps(spark, str(tmp_path / "in")).where("height < 10 AND width > 2")
    assert {r.image_id for r in small.select("image_id").distinct().collect()} == {9}
    assert small.count() == 15


def test_small_and_large_channels_are_fitted_alike(spark, monkeypatch):
    rng = random.Random(11)
    squares = [(i, 2 * k, ch, rng.randint(-3, 14), rng.randint(-3, 17), rng.randint(1, 9)) for i in (1, 2) for ch in (0, 1) for k in range(20 - 5 * ch)] + [(1, 99, 0, -40, 300, 7), (9, 1, 0, 0, 0, 4), (8, 1, 0, 0, 0, 400)]
    p = raster(spark, 17, 19, lambda c, i, j: (i * 9 + j * 5 + c * 40 + rng.randrange(60)) % 256, channels=3).where("NOT (row = 6 AND col > 5)")
    p = p.unionByName(p.withColumn("image_id", F.lit(2).cast(p.schema["image_id"].dataType)).withColumn("value", F.col("value") * 7 % 256)).where("NOT (image_id = 2 AND row > 9)")
    colours, table = residual.start_color(p), spark.createDataFrame(squares, KIND)
    read = lambda got: [sorted(map(tuple, x.collect())) for x in got]
    monkeypatch.setattr(waves, "CELLS", 1)
    small = waves.fit_strokes(p, colours, table, BOOK)
    assert [d.dtypes for d in small] == [d.dtypes for d in waves.fit_strokes(p, cells.fill_canvas(p, colours), table, BOOK)]
    mixed = read(small)
    monkeypatch.setattr(waves, "SIDE", 1 << 12)
    monkeypatch.setattr(waves, "CELLS", 1 << 20)
    rows = waves.fit_strokes(p, colours, table, BOOK)
    assert read(rows) == mixed == read(waves.fit_strokes(p, cells.fill_canvas(p, colours), table, BOOK))
    assert all("due" not in plan(d) for d in rows)  # no folders of waves


def test_layers_of_regions_leave_no_lists_of_cells(spark, monkeypatch):
    p = noisy(spark, 21, 27).where("(row * 27 + col) % 31 <> 7")
    colours = residual.start_color(p)
    got = [regions.encode_regions(p, c, [6, 8, 2], BOOK, 21, 27, 3, 2) for c in (colours, cells.fill_canvas(p, colours))]
    assert "target" in regions._tiled(p, colours, 21, 27, 3).columns
    monkeypatch.setattr(regions, "CELLS", 1)
    got.append(regions.encode_regions(p, colours, [6, 8, 2], BOOK, 21, 27, 3, 2))
    a, b, c = ([sorted(map(tuple, d.collect())) for d in pair] for pair in got)
    assert a == b == c and {r[3] for r in a[0]} == {0, 1, 2}


def test_search_goes_by_blocks_without_windows(spark, sf, monkeypatch):
    from rastermill.plans import queries

    assert "Window" not in plan(queries.best_squares(spark, sf))
    p = noisy(spark, 21, 27, 2).where("NOT (row = 6 AND col = 6)").withColumn("row", F.col("row") - 3)
    res = residual.residual(p, p.withColumn("value", F.lit(110)))
    whole = search.square_gains(res, [2, 6], BOOK)
    read = lambda df: sorted(map(tuple, df.collect()))
    want, best = read(whole), read(search.best_squares(whole))
    monkeypatch.setattr(search, "SIDE", 8)
    monkeypatch.setattr(search, "CELLS", 1)
    assert read(search.square_gains(res, [2, 6], BOOK)) == want and len({w[2] for w in want}) == 20
    assert read(search.best_squares(search.square_gains(res, [2, 6], BOOK, True))) == best
