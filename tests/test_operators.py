"""Edge cases by hand, and agreements between operators."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from rastermill.functions import params, sql
from rastermill.functions.expr import halvings, nearest_code, quadrant_code, quadrant_text
from rastermill.operators import cells, codes, evaluate, layers, quadrant, resample, residual, schedule, strokes
from rastermill.sources import images, storage
from rastermill.streaming import progress

CELLS = "image_id long, channel int, row int, col int, value int"


def raster(spark, h, w, f, image=1, channels=1):
    return spark.createDataFrame([(image, c, i, j, f(c, i, j)) for c in range(channels) for i in range(h) for j in range(w)], CELLS)


def values(df, *keys):
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}


def test_nearest_code_ties_take_the_lowest_place(spark):
    df = spark.createDataFrame([(-5, 1), (-10, 2), (5, 2), (1000, 1)], "total long, n long")
    got = [r[0] for r in df.select(nearest_code(F.col("total"), F.col("n"), [-10, 0, 5, 20])).collect()]
    assert got == [0, 0, 1, 3]
    assert [r[0] for r in df.select(nearest_code(F.col("total"), F.col("n"), [5, 0, -5, 0])).collect()] == [2, 2, 0, 0]


def test_odd_square_has_the_larger_lower_right_quarters(spark):
    s = spark.createDataFrame([(1, 0, 0, 1, 1, 3)], "image_id long, stroke_id int, channel int, row int, col int, size int")
    got = strokes.footprint(s, raster(spark, 5, 6, lambda *_: 0)).groupBy("quarter").count().collect()
    assert {r["quarter"]: r["count"] for r in got} == {0: 1, 1: 2, 2: 2, 3: 4}


def test_replay_holds_each_step(spark):
    s = spark.createDataFrame([(1, 0, 0, 0, 0, 2, [3] * 4), (1, 1, 0, 0, 0, 2, [0] * 4)], "image_id long, stroke_id int, channel int, row int, col int, size int, idx array<int>")
    got = values(strokes.replay_strokes(raster(spark, 2, 3, lambda *_: 250), s, [-10, 0, 5, 20]), "row", "col")
    assert got == {(r, c): 245 if c < 2 else 250 for r in range(2) for c in range(3)}


def test_replay_by_tiles_equals_a_replay_by_cells(spark):
    import random

    draw, book = random.Random(5), [-10, 0, 5, 20]
    of = lambda i, c, r, k: (i * 31 + c * 17 + r * 41 + k * 7) % 256
    now = {(i, c, r, k): of(i, c, r, k) for i in (1, 2) for c in range(2) for r in range(-3, 21) for k in range(27) if (r + k) % 9}
    made = [(i, draw.randrange(60), c, draw.randrange(-9, 20), draw.randrange(-9, 26), draw.choice([1, 2, 3, 4, 7, 16, 17, 40, 1 << 20]), [draw.randrange(4) for _ in range(4)]) for i in (1, 3) for c in range(3) for _ in range(60)]
    made += [(2, k, 1, 0, 0, 0, [3] * 4) for k in range(3)] + [(2, 9, 0, 2, 2, 4, [-1, 2, 2, 4])]
    for key, start in now.items():
        i, c, r, k = key
        steps = []
        for image, n, channel, row, col, size, idx in made:
            if (image, channel) == (i, c) and row <= r < row + size and col <= k < col + size:
                code = idx[2 * (r >= row + size // 2) + (k >= col + size // 2)]
                steps += [(n, book[code])] if 0 <= code < 4 and book[code] else []
        for _, m in sorted(steps):
            start = max(0, min(255, start + m))
        now[key] = start
    canvas = spark.createDataFrame([(*key, of(*key)) for key in now], "image_id long, channel int, row int, col int, value int")
    squares = spark.createDataFrame(made, "image_id long, stroke_id int, channel int, row int, col int, size int, idx array<int>")
    assert values(strokes.replay_strokes(canvas, squares, book), "image_id", "channel", "row", "col") == now
    assert values(strokes.replay_strokes(canvas, squares.limit(0), book), "image_id", "channel", "row", "col") == {key: of(*key) for key in now}


def test_squares_of_tiles_and_their_differences(spark):
    p = raster(spark, 19, 13, lambda c, i, j: (i * 37 + j * 91 + c * 5) % 256, channels=2)
    for canvas in (residual.start_color(p), cells.fill_canvas(p.where("row < 15"), residual.start_color(p))):
        done = layers.fit_tiles(layers.pair_tiles(p, canvas, 8), [4], [-40, -10, 0, 10, 40], 8)
        one = layers.as_strokes(layers.layer_codes(layers.encode_cells(p, canvas, [4], [-40, -10, 0, 10, 40]), [4]).drop("layer"), 4)
        a, b = (sorted(map(tuple, s.select("image_id", "channel", "stroke_id", "row", "col", "size", "idx").collect())) for s in (one, layers.tile_strokes(done, 4, 8)))
        assert a == b and a
        start = layers.start_tiles(layers.pair_tiles(p, canvas, 8))
        again = strokes.replay_tiles(start, one, [-40, -10, 0, 10, 40])
        fitted = done.withColumnRenamed("canvas", "value")
        n = 19 * 13 * 2 if "colour" in canvas.columns else 15 * 13 * 2
        assert [tuple(r) for r in residual.diff_tiles(fitted, again).collect()] == [(1, n, 0)]
        flat = lambda t: layers.tile_cells(t.select("image_id", "channel", "tr", "tc", "value"), "value", 8)
        for t in (start, again.where("tr < 1")):
            assert [tuple(r) for r in residual.diff_tiles(fitted, t).collect()] == [(1, n, residual.diff_cells(flat(fitted), flat(t)).count())]


def test_rect_stats_equal_the_footprint(spark):
    p = raster(spark, 7, 9, lambda _, i, j: (i * 31 + j * 17) % 256)
    s = spark.createDataFrame([(1, k, 0, k - 2, 2 * k - 3, 1 + k % 5) for k in range(9)], "image_id long, stroke_id int, channel int, row int, col int, size int")
    a = {(r.stroke_id, r.quarter): (r.n, r.total) for r in strokes.rect_stats(s, p, 7, 9).collect()}
    cell = ["image_id", "channel", "row", "col"]
    b = {(r.stroke_id, r.quarter): (r.n, r.total) for r in strokes.footprint(s, p).join(p, cell).groupBy("stroke_id", "quarter").agg(F.count("*").alias("n"), F.sum("value").alias("total")).collect()}
    assert a == b


def test_layers_never_raise_the_error_when_zero_is_a_code(spark):
    p = raster(spark, 10, 14, lambda c, i, j: (i * 37 + j * 91 + c * 5) % 256, channels=3)
    flat = cells.fill_canvas(p, residual.start_color(p))
    first = residual.residual(p, flat).agg(F.sum(F.col("diff") * F.col("diff"))).first()[0]
    got = [r.sse for r in layers.encode_layers(p, flat, [8, 4, 2], [-40, -10, 0, 10, 40]).orderBy("layer").collect()]
    assert first >= got[0] >= got[1] >= got[2]
    done = layers.encode_cells(p, flat, [8, 4, 2], [-40, -10, 0, 10, 40])
    again = layers.decode_layers(flat, layers.layer_codes(done, [8, 4, 2]), [8, 4, 2], [-40, -10, 0, 10, 40])
    assert residual.diff_cells(done.select("image_id", "channel", "row", "col", F.col("canvas").alias("value")), again).count() == 0


def test_layers_do_not_shuffle_again(spark):
    p = raster(spark, 8, 8, lambda *_: 1)
    plan = layers.encode_cells(p, p, [8, 4, 2], [0, 1])._jdf.queryExecution().executedPlan().toString()
    one = layers.encode_cells(p, p, [8], [0, 1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == one.count("Exchange hashpartitioning")


def test_quadrants(spark):
    assert halvings(5, 2) == [1, 2, 3]
    p = raster(spark, 5, 3, lambda *_: 1)
    got = {(r.row, r.col): r.quad for r in quadrant.quadrant_key(p, 5, 3, 3).collect()}
    assert got[(0, 0)] == "000" and got[(1, 0)] == "001" and got[(4, 2)] == "111" and got[(2, 0)] == "100"
    assert {r.quad for r in quadrant.quadrant_key(p, 5, 3, 0).collect()} == {""}
    assert p.select(quadrant_text(quadrant_code(F.col("row"), F.col("col"), 1, 3, 2), 2)).count() == 15
    res = residual.residual(p, raster(spark, 5, 3, lambda *_: 0))
    worst = quadrant.worst_quadrant(quadrant.quadrant_error(res, 5, 3, 1, "Max")).first()
    assert (worst.code, worst.err) == (0, 1)  # a tie


def test_channel_selector_strategies(spark):
    e = spark.createDataFrame([(1, 0, 10), (1, 1, 25), (1, 2, 10), (2, 0, 9), (2, 1, 9), (2, 2, 4), (3, 0, 1), (3, 1, 1), (3, 2, 1)], "image_id long, channel int, sum_err long")
    of = lambda s: {r.image_id: r.selector for r in quadrant.channel_selector(e, s).collect()}
    assert of("Smart") == {1: [1, 1, 1], 2: [0, 0, 1], 3: [0, 1, 2]}
    assert of("Strict")[3] == [0, 0, 0] and of("Balanced")[1] == [1, 1, 0] and of("Default")[1] == [0, 1, 2] == of("123")[2]


def test_start_colors(spark):
    p = raster(spark, 1, 4, lambda c, i, j: [1, 2, 4, 8][j] + c, channels=3)
    of = lambda *a, **k: [r.colour for r in residual.start_color(p, *a, **k).orderBy("channel").collect()]
    assert of() == of("nonsense") == [3, 4, 5] and of("Median") == of("True Median") == [3, 4, 5]
    assert of("White") == [255] * 3 and of("White", ycbcr=True) == [255, 128, 128] and of("Custom", custom=(1, 2, 3)) == [1, 2, 3]
    assert all(0 <= c <= 255 for c in of("Random", seed=3)) and of("Random", seed=3) == of("Random", seed=3)


def test_schedule_boundaries(spark):
    s = spark.createDataFrame([(1, i, 0) for i in range(12)], "image_id long, stroke_id int, channel int")
    got = schedule.stroke_schedule(s, 9, 4, 5, 3).orderBy("stroke_id").collect()
    assert [r.stroke_id for r in got if r.quad_switch] == [3, 7, 11] and [r.segment for r in got[2:8]] == [None, 0, 0, 0, 0, 1]
    assert [r.stroke_id for r in got if r.cycle_switch] == [5, 8, 11]
    assert schedule.auto_interval(10, 60) == 1


def test_progress_with_a_long_interval(spark):
    log = spark.createDataFrame([(1, i, 2) for i in range(5)], "image_id long, stroke_id long, bits long")
    got = sorted((r.i, r.strokes, r.bits, r.final) for r in schedule.progress_curve(log, 100).collect())
    assert got == [(0, 1, 2, False), (4, 5, 10, True)]


def test_decay_sizes(spark):
    p = spark.createDataFrame([(1, 1, 9, 3, 0.5, 0.5, 0.5), (2, 3, 9, 3, 0.0, 0.5, 0.5), (3, 3, 9, 3, 3.0, 0.5, 0.5), (4, 3, 9, 3, 1.0, 0.0, 0.0)], "image_id long, stroke_count int, start int, end int, cutoff double, softness double, progress double")
    got = {}
    for r in params.decay_sizes(p).orderBy("image_id", "stroke_id").collect():
        got.setdefault(r.image_id, []).append(r.size)
    assert got == {1: [8], 2: [3, 3, 3], 3: [9, 9, 9], 4: [8, 6, 2]}


def test_codebooks(spark):
    def book(lo, hi, bits, mode):
        res = spark.createDataFrame([(1, 0, lo), (1, 0, hi)], "image_id long, channel int, diff int")
        return codes.codebook(res, bits, mode).first()["book"]

    assert book(-10, 20, 3, "Uniform") == [-10, -6, -2, 2, 7, 11, 15, 20]
    assert book(4, 5, 3, "Uniform") == [4] and book(0, 4, 3, "Uniform") == [0, 1, 2, 3]
    assert book(-9, 9, 2, "Stable_Uniform") == [-3, 0, 3, 9]  # -9 and 9 tie: the first goes
    assert book(-9, 10, 2, "Stable_Uniform") == [-9, -3, 0, 3]
    drawn = book(-50, 50, 3, "Random")
    assert drawn == sorted({*drawn}) and len(drawn) == 8 and drawn[0] >= -50 and drawn[-1] < 50


@pytest.mark.parametrize("signed", [False, True])
def test_codes_come_back(spark, signed):
    nums = [(1, i, (i * 7) % 30 - (15 if signed else 0)) for i in range(11)] + [(2, 0, 0)]
    df = spark.createDataFrame(nums, "image_id long, pos int, code int")
    packed = codes.pack_codes(df, ["image_id"], ["pos"], "code", 6, signed)
    assert all(len(r.bits) % 8 == 0 and not r.overflow for r in packed.collect())
    assert {(r.image_id, r.pos, r.code) for r in codes.unpack_codes(packed, ["image_id"], 6, signed).collect()} == {*nums}
    wide = codes.pack_codes(df.withColumn("code", F.lit(64)), ["image_id"], ["pos"], "code", 6, signed)
    assert all(r.overflow for r in wide.collect())


def test_upsample_covers_every_cell_once(spark):
    for n, size in ((3, 8), (5, 5), (1, 4), (7, 3)):
        got = values(resample.upsample_nearest(raster(spark, n, n, lambda _, i, j: i * n + j), n, n, size, size), "row", "col")
        assert got == {(r, c): (r * n // size) * n + c * n // size for r in range(size) for c in range(size)}


@pytest.mark.parametrize("kernel", ["bilinear", "bicubic", "lanczos"])
def test_kernels_keep_a_flat_raster(spark, kernel):
    for size, new in ((8, 3), (5, 11), (1, 4)):
        table = resample.weights(size, new, kernel)
        assert all(sum(w for _, o, w in table if o == k) == resample.ONE for k in range(new))
    assert set(values(resample.resample(raster(spark, 6, 5, lambda *_: 77), 6, 5, 4, 9, kernel), "row", "col").values()) == {77}


def test_cells_to_arrays_and_back(spark):
    df = spark.createDataFrame([(1, list(range(24)))], "image_id long, a array<int>")
    for layout in ("hwc", "chw"):
        c = cells.explode_cells(df, "a", 2, 3, 4, layout)
        assert c.count() == 24
    assert cells.assemble_cells(cells.explode_cells(df, "a", 2, 3, 4)).first()["values"] == list(range(24))


def test_lossless_first_point_has_no_earlier_best(spark):
    runs = spark.createDataFrame([(1, "u", 1, 10, 0), (1, "u", 10, 20, 5), (1, "u", 19, 40, 0)], "image_id long, codec string, quality int, bits long, mse long")
    got = [r.shown for r in evaluate.lossless_carry(evaluate.efficiency(runs, F.lit(100))).orderBy("quality").collect()]
    assert got == [None, 1.0, 1.0]


def test_images_are_read_as_red_green_blue(spark, tmp_path):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = [[(10, 20, 30), (1, 2, 3)], [(255, 0, 7), (9, 8, 200)], [(0, 0, 0), (4, 5, 6)]]
    raw = b"".join(b"\0" + bytes(v for p in r for v in p) for r in rows)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "b.txt").write_text("no image")
    got = values(images.scan_images(spark, str(tmp_path)), "row", "col", "channel")
    assert got == {(r, c, k): rows[r][c][k] for r in range(3) for c in range(2) for k in range(3)}


def test_one_image_is_read_from_its_shard(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 2) for i in range(40)], "image_id long, code int")
    storage.write_codes(df, str(tmp_path / "c"), shards=4)
    one = storage.read_codes(spark, str(tmp_path / "c"), 7, shards=4)
    assert [(r.image_id, r.code) for r in one.collect()] == [(7, 14)]
    assert "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().executedPlan().toString()


def test_streamed_replay_equals_the_batch_and_tells_late_strokes(spark, tmp_path):
    kind = "image_id long, stroke_id long, channel int, row int, col int, size int, idx int"
    on_time = [(1, k, 0, (k * 5) % 12, (k * 7) % 20, 4, k % 4) for k in range(30)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(on_time[:20], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    book = [-10, 0, 5, 20]
    stream = lambda: progress.stream_replay(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), book)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def catch_up():
        stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", progress._ROCKSDB)
    catch_up()
    spark.createDataFrame([*on_time[20:], (1, 3, 0, 0, 0, 4, 3)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    catch_up()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(out)
    assert [r.stroke_id for r in got.where("late").select("stroke_id").distinct().collect()] == [3]
    last = {(r.row, r.col): r.value for r in got.where("not late").groupBy("row", "col").agg(F.max_by("value", "stroke_id").alias("value")).collect()}
    squares = spark.createDataFrame(on_time, kind).withColumn("idx", F.array("idx", "idx", "idx", "idx"))
    flat = raster(spark, 16, 32, lambda *_: 0)
    batch = values(strokes.replay_strokes(flat, squares, book), "row", "col")
    assert {k: last.get(k, 0) for k in batch} == batch


def test_sql_functions(spark):
    assert "clip_add" in sql.register(spark)
    got = spark.sql("SELECT clip_add(250, 20), code_bits(5), code_bits(1), nearest_code(-5, 1, array(-10, 0, 5)), pack_signed(-3, 5), pack_signed(0, 5)").first()
    assert tuple(got) == (255, 3, 0, 0, "00011", "10000")


def test_params_of_an_image_leave_others_alone(spark):
    kind = "image_id long, width int, height int, rate_init int, thumbnail boolean, stroke_count int, cutoff double, softness double, progress double, size_start double, size_end double, warmup double"
    rows = [(1, 599, 1000, 16, True, 20000, *[None] * 6), (2, 600, 600, 32, True, 20001, *[None] * 6), (3, 16, 16, 16, False, None, 0.9, None, None, None, 0.5, None)]
    got = {r.image_id: r for r in params.auto_params(spark.createDataFrame(rows, kind)).collect()}
    assert (got[1].downsample_rate, got[1].cutoff, got[1].warmup, got[1].size_start, got[1].size_end) == (1.0, 0.7, 0.7, 0.1, 0.03)
    assert got[2].downsample_rate == 1.2 and got[2].cutoff != 0.7 and got[2].cycle_start == 18000
    assert (got[3].stroke_count, got[3].cutoff, got[3].size_end_px) == (20000 + int(0.0015 * 3216**2), 0.9, 9)
