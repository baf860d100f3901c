"""Plans and files that must not grow faster than the tables."""

import os

import pytest

from rastermill.functions import params
from rastermill.operators import cells, layers, residual, resample, search, strokes
from rastermill.plans import fixtures as fx
from rastermill.plans import queries
from rastermill.sources import netpbm, storage


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_curve_sample_broadcasts_no_curve(spark):
    rows = [(i, 1 + i % 9, 9, 3, 0.5, 0.5, 0.5) for i in range(40)]
    p = spark.createDataFrame(rows, "image_id long, stroke_count int, start int, end int, cutoff double, softness double, progress double")
    got = params.curve_sample(params.decay_sizes(p), 5)
    assert "Broadcast" not in plan(got)
    assert sorted((r.image_id, r["sample"], r.stroke_id) for r in got.collect()) == sorted((i, k, k * (n - 1) // 4) for i, n, *_ in rows for k in range(5))


def test_small_pictures_share_partitions(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.pgm").write_bytes(b"P5\n3 4\n255\n" + bytes((i + k) % 256 for k in range(12)))
    got = netpbm.scan_pixmaps(spark, str(tmp_path), 5)
    assert got.rdd.getNumPartitions() == 1
    assert {(r.image_id, r.row, r.col): r.value for r in got.collect()} == {(i, k // 3, k % 3): (i + k) % 256 for i in range(300) for k in range(12)}
    parts = netpbm._Reader({"path": str(tmp_path), "bandbytes": str(1 << 22)}).partitions()
    assert sorted(o for p in parts for o, _, _ in p.ranges) == sorted(str(f) for f in tmp_path.iterdir())


def test_large_pictures_span_partitions(tmp_path):
    (tmp_path / "1.pgm").write_bytes(b"P5\n1000 20000\n255\n" + bytes(20_000_000))
    reader = netpbm._Reader({"path": str(tmp_path), "bandbytes": "1000000"})
    parts = reader.partitions()
    assert len(parts) == 3
    rows = [sorted({r for b in reader.read(p) for r in (b.column(5)[0].as_py(), b.column(5)[-1].as_py())}) for p in parts]
    assert rows[0][0] == 0 and rows[-1][-1] == 19999 and all(b[0] == a[-1] + 1 for a, b in zip(rows, rows[1:]))


def test_values_that_are_no_byte_are_not_written(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 0, 0, 256)], "image_id long, channel int, row int, col int, value int")
    with pytest.raises(Exception, match="no byte"):
        netpbm.write_pixmaps(cells, str(tmp_path), 1, 1, 1)


def shuffles_of_cells(df) -> int:
    """Exchanges in the plan above the one that deals packed images."""
    return plan(df).count("Exchange hashpartitioning(") - plan(df).count("REPARTITION_BY_NUM") * 2


def test_rasters_are_those_of_the_sql(spark, tmp_path):
    rows = [(s, o, p, 3.0, 0.05, 0.02) for s in (None, 1, 2) for o, p in ((5, 7), (29, 39), (5, None), (None, 1), (-3, 4), (4, -3))] + [(3, None, None, 1.0, 0.1, 0.1), (4, 1, 1, None, None, None), (4, 2, 2, 1e9, 0.0, 0.0)]
    table = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_tax double")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    mine, theirs = fx.rasters(spark, str(tmp_path)), fx.frame(spark, str(tmp_path), fx.PX_LI)
    assert mine.dtypes == theirs.dtypes
    assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty() and mine.count() == 5 * 3 * fx.H * fx.W


def test_cells_of_rasters_are_not_shuffled(spark, sf):
    p = queries.px(spark, sf)
    for df in (resample.resample(p, fx.H, fx.W, 10, 40), residual.start_color(p), queries.res(spark, sf), queries.canvas(spark, sf)):
        assert shuffles_of_cells(df) == 0


def test_a_canvas_may_be_colours(spark):
    p = spark.createDataFrame([(i, c, r, k, (i * 7 + c * 5 + r * 3 + k * 11) % 256) for i in (1, 2) for c in range(3) for r in range(5) for k in range(6)], "image_id long, channel int, row int, col int, value int")
    some = residual.start_color(p).where("NOT (image_id = 2 AND channel = 1)")
    whole = cells.fill_canvas(p, some)
    assert whole.count() == 150
    for f in (lambda canvas: residual.residual(p, canvas), lambda canvas: layers.encode_layers(p, canvas, [4, 2], [-9, 0, 9])):
        a, b = f(whole), f(some)
        assert a.dtypes == b.dtypes and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_disjoint_squares_over_bands_leave_their_result_alone(spark):
    rows = [(1, 0, r, c, s, (r * 37 + c * 61 + s * 17) % 23 - 3) for r in range(240, 280) for c in range(4) for s in (2, 4)]
    gains = spark.createDataFrame(rows, "image_id long, channel int, row int, col int, size int, gain long")
    before = set(os.listdir(storage.shared_dir(spark)))
    got = {(r.row, r.col, r["size"]) for r in search.disjoint_squares(gains, [2, 4], 600, 8).collect()}
    want, used = set(), set()
    for _, _, r, c, s, g in sorted(rows, key=lambda x: (-x[5], x[2], x[3], x[4])):
        own = {(r + i, c + k) for i in range(s) for k in range(s)}
        if g > 0 and not own & used:
            used |= own
            want.add((r, c, s))
    assert got == want
    made = [d for d in set(os.listdir(storage.shared_dir(spark))) - before if d.startswith("steps-")]
    kept = sum(spark.read.parquet(f"{storage.shared_dir(spark)}/{d}/{k}").count() for d in made for k in os.listdir(f"{storage.shared_dir(spark)}/{d}"))
    assert len(made) == 1 and kept == len(want)


def test_layers_of_rasters_are_neither_sorted_nor_shuffled(spark, sf):
    p = queries.px(spark, sf)
    tiles = layers.encode_tiles(p, residual.start_color(p), [8, 4, 2], [-9, 0, 9])
    assert shuffles_of_cells(tiles) == 0 and "Window" not in plan(tiles) and "Sort " not in plan(tiles)


@pytest.mark.parametrize("sizes", [[8, 4, 2], [6, 4], [32, 2]])
def test_tiles_of_any_side_code_and_decode_in_parts(spark, sizes, monkeypatch):
    monkeypatch.setattr(layers, "CELLS", 300)
    p = spark.createDataFrame([(i, c, r, k, (i * 7 + c * 5 + r * 37 + k * 91) % 256) for i in (1, 2) for c in range(2) for r in range(13) for k in range(10) if (r * 10 + k) % 17 != 4], "image_id long, channel int, row int, col int, value int")
    book, values = [-40, 5, 0, -5, 40], {(r.image_id, r.channel, r.row, r.col): r.value for r in p.collect()}
    colours = residual.start_color(p)
    now = {(r.image_id, r.channel): r.colour for r in colours.collect()}
    canvas, want = {k: now[k[:2]] for k in values}, {k: [] for k in values}
    for size in sizes:
        half, quarters = size // 2, {}
        for k in values:
            quarters.setdefault((*k[:2], k[2] // half, k[3] // half), []).append(k)
        for own in quarters.values():
            s = sum(values[k] - canvas[k] for k in own)
            idx = min(range(5), key=lambda j: (abs(book[j] * len(own) - s), j))
            for k in own:
                want[k].append(idx)
                canvas[k] = max(0, min(255, canvas[k] + book[idx]))
    done = layers.encode_cells(p, colours, sizes, book)
    assert {(r.image_id, r.channel, r.row, r.col): (r.target, r.canvas, [r[f"c{j}"] for j in range(len(sizes))]) for r in done.collect()} == {k: (values[k], canvas[k], want[k]) for k in values}
    tiles, start = layers.tile_codes(layers.encode_tiles(p, colours, sizes, book), sizes, book), layers.canvas_tiles(cells.fill_canvas(p, colours), sizes)
    rows = layers.code_tiles(layers.layer_codes(done, sizes), sizes, book)
    a, b = (sorted(map(tuple, layers.decode_tiles(start, t, sizes).collect())) for t in (tiles, rows))
    assert a == b and len(a) == len(values)


def test_sweep_and_selected_codes_leave_no_lists_of_cells(spark, sf):
    p = queries.px(spark, sf)
    configs = spark.createDataFrame(fx.CONFIGS, "config_id int, size int, book array<int>")
    for df in (layers.config_sweep(p, residual.start_color(p), configs), layers.encode_selected(p, residual.start_color(p), 4, [-9, 0, 9], fx.H, fx.W, 2)):
        assert "struct(target" not in plan(df)
    whole = queries.canvas(spark, sf)
    for f in (lambda c: layers.config_sweep(p, c, configs), lambda c: layers.encode_selected(p, c, 6, [-9, 0, 9], fx.H, fx.W, 3, "Smart")):
        a, b = f(whole), f(residual.start_color(p))
        assert a.dtypes == b.dtypes and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_replay_writes_and_shuffles_tiles(spark, sf):
    p, tiles = queries.px(spark, sf), []
    got = strokes.replay_strokes(queries.canvas(spark, sf), queries.some_strokes(spark, sf), fx.BOOK)
    assert "__at" in plan(got) and "steps" not in plan(got)
    made = storage.Steps.put
    storage.Steps.put = lambda self, df: tiles.append(df.columns) or made(self, df)
    try:
        rows = queries.replay_equals_fit(spark, sf)
    finally:
        storage.Steps.put = made
    assert tiles and all("tr" in t and "row" not in t for t in tiles)
    assert sorted(map(tuple, rows.collect())) == sorted((r[0], r[1], 0) for r in p.groupBy("image_id").count().collect())


def test_disjoint_squares_of_small_rasters_take_one_pass(spark, sf, monkeypatch):
    monkeypatch.setattr(storage.Steps, "put", lambda *_: pytest.fail("a round"))
    got = queries.disjoint_squares(spark, sf)
    assert shuffles_of_cells(got) == shuffles_of_cells(queries.best_squares(spark, sf)) - 1 and "Window" not in plan(got)
    gains = queries._gains(spark, sf)
    assert "Window" not in plan(search.disjoint_squares(gains, queries.SEARCH, fx.H, fx.W))


def test_disjoint_squares_are_the_same_by_any_blocks(spark, monkeypatch):
    # noise, and beside it one value, whose squares all gain the same and wait for each other from block to block
    value = lambda c, i, j: 7 if c and j > 20 else (i * i * 31 + j * 17 + i * j * 7) % 41 - 12
    res = spark.createDataFrame([(None if c else 5, c, i, j, value(c, i, j)) for c in (0, 1) for i in range(-4, 61) for j in range(53) if (i, j) != (30, 9)], "image_id long, channel int, row int, col int, diff int")
    gains = storage.checkpoint(search.square_gains(res, [6, 2], [-10, 5, 20]))
    want = []
    for c in (0, 1):
        used = set()
        for r in sorted((r for r in gains.collect() if r.channel == c and r.gain > 0 and 0 <= r.row < 57 and r.col < 53), key=lambda r: (-r.gain, r.row, r.col, r["size"])):
            own = {(r.row + i, r.col + j) for i in range(r["size"]) for j in range(r["size"])}
            if not own & used:
                used |= own
                want.append(tuple(r))
    read = lambda df: sorted(map(tuple, df.collect()), key=repr)
    found = lambda: read(search.disjoint_squares(search.square_gains(res, [6, 2], [-10, 5, 20], raster=(57, 53)), [6, 2], 57, 53))
    assert found() == read(search.disjoint_squares(gains.unionByName(gains), [6, 2], 57, 53)) == sorted(want, key=repr)
    monkeypatch.setattr(search, "SIDE", 8)
    assert found() == sorted(want, key=repr)
    monkeypatch.setattr(search, "PICK", 8)
    assert found() == read(search.disjoint_squares(gains, [6, 2], 57, 53)) == sorted(want, key=repr)


def test_disjoint_squares_of_any_gains(spark):
    rows = [(1, 0, 0, 0, 2, 1 << 62), (1, 0, 1, 1, 4, (1 << 62) + 1), (1, 0, 8, 8, 2, 3), (1, 0, 8, 8, 4, 3), (1, 0, 9, 2, 2, 0), (1, 0, 40, 2, 2, 9), (1, 0, 2, 30, 3, 9), (1, 0, 3, 12, 2, None), (None, None, 4, 4, 2, 1)]
    gains = spark.createDataFrame(rows, "image_id long, channel int, row int, col int, size int, gain long")
    want = {(1, 0, 1, 1, 4, (1 << 62) + 1), (1, 0, 8, 8, 2, 3), (None, None, 4, 4, 2, 1)}
    for h in (40, 300):  # one block or more
        got = search.disjoint_squares(gains, [4, 2], h, 16).collect()
        assert {tuple(r) for r in got} == want | ({rows[5]} if h > 40 else set()) and len(got) == len(want) + (h > 40)
