"""Residual codes in layers of disjoint squares, coarse to fine, and their decoding.

Strokes that overlap must be fitted one after the other; layers of squares that don't overlap give every square its own cells, so
that a whole layer is one aggregation. All layers run within rows of the smallest tile that the quarters of all layers nest in: a row
has all cells of each quarter, layers neither sort nor shuffle, and one large raster spans many tasks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import CELL, KC, K, book_value, clip_add, code_bits, halvings, idiv, nearest_code, quadrant_code
from ..sources.storage import checkpoint
from .cells import coloured
from .evaluate import few_rows
from .quadrant import channel_selector, worst_quadrant
from .residual import residual


def _tile(sizes: list[int]) -> int:
    """Side of the smallest tile that the quarters of all sizes nest in."""
    return math.lcm(*[max(1, s // 2) for s in sizes])


#: Most cells of a tile that are gathered as columns of one aggregate; larger tiles are gathered as lists.
NARROW = 64
#: Cells that numpy handles at once, or one tile.
CELLS = 1 << 18


def _dense(cells: DataFrame, values: list[str], tile: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(image_id, channel, tr, tc, more, values): each of values as an array of tile * tile entries by place, null where there is no cell.

    Cells that lie in partitions by image are not shuffled for it.
    """
    n = tile * tile
    within = lambda c: F.pmod(F.col(c), F.lit(tile))
    corner = lambda c: idiv(F.col(c) - within(c), tile).cast("long")
    placed = cells.select(*KC, corner("row").alias("tr"), corner("col").alias("tc"), (within("row") * tile + within("col")).cast("int").alias("__at"), *more, *values)
    by = [*KC, "tr", "tc", *more]
    if n <= NARROW:
        wide = placed.groupBy(*by).agg(*[F.max(F.when(F.col("__at") == k, F.col(v))).alias(f"__{v}{k}") for v in values for k in range(n)])
        return wide.select(*by, *[F.array(*[F.col(f"__{v}{k}") for k in range(n)]).alias(v) for v in values])
    held = placed.groupBy(*by, "__at").agg(*[F.max(v).alias(v) for v in values]).groupBy(*by).agg(F.collect_list(F.struct("__at", *values)).alias("all"))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.col("all.__at")), lambda k: F.struct(k.alias("__at"), *[F.lit(None).cast("int").alias(v) for v in values]))
    return held.select(*by, F.array_sort(F.concat("all", rest)).alias("all")).select(*by, *[F.col(f"all.{v}").alias(v) for v in values])


def _tiles_of(target: DataFrame, canvas: DataFrame, tile: int) -> DataFrame:
    """(image_id, channel, tr, tc, target, canvas): both by tiles, as arrays by place. canvas is one colour where canvas is given as colours.

    Cells of target that are in partitions by image already are not shuffled with colours; else target, or both, are shuffled once.
    """
    want = target.select(*CELL, F.col("value").cast("int").alias("target"))
    if "colour" in canvas.columns:
        return coloured(_dense(want, ["target"], tile), canvas).select(*KC, "tr", "tc", "target", F.array("colour").alias("canvas"))
    none = F.lit(None).cast("int")
    return _dense(want.withColumn("canvas", none).unionByName(canvas.select(*CELL, none.alias("target"), F.col("value").cast("int").alias("canvas"))), ["target", "canvas"], tile)


def _encoder(sizes: list[int], book: list[int], tile: int, costs: bool):
    """Codes of all layers of many tiles at once, as a function from Arrow batches of _tiles_of to Arrow batches."""
    halves, step = [max(1, s // 2) for s in sizes], max(1, CELLS // (tile * tile))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        moves = np.array(book, np.int64)
        some = lambda x, has: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x[0].size), pa.int32()), pa.array(x.reshape(-1), pa.int32(), mask=~has.reshape(-1)))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            rows = batch.num_rows

            def read(name):
                flat = batch.column(name).flatten()
                x = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                has = flat.is_valid().to_numpy(zero_copy_only=False)
                shape = (rows, tile, tile) if len(x) == rows * tile * tile else (rows, 1, 1)
                return np.broadcast_to(x.reshape(shape), (rows, tile, tile)), np.broadcast_to(has.reshape(shape), (rows, tile, tile))

            (t, has), (c, also) = read("target"), read("canvas")
            has = has & also
            codes, left, heads = [], [], []
            for half in halves:
                across = tile // half
                blocks = lambda x: x.reshape(rows, across, half, across, half).sum(axis=(2, 4))
                n, s = blocks(has.astype(np.int64)), blocks(np.where(has, t - c, 0))
                best, idx = None, np.zeros(n.shape, np.int64)
                for k, m in enumerate(moves):
                    away = np.abs(m * n - s)
                    idx = idx if best is None else np.where(away < best, k, idx)
                    best = away if best is None else np.minimum(away, best)
                c = np.clip(c + moves[idx].repeat(half, axis=1).repeat(half, axis=2), 0, 255)
                first = has[:, ::half, ::half]
                if costs:
                    left.append((np.where(has, t - c, 0) ** 2).sum(axis=(1, 2)))
                    heads.append(first.sum(axis=(1, 2)))
                else:
                    codes.append(some(idx, n > 0))
            keys = [batch.column(k) for k in ("image_id", "channel", "tr", "tc")]
            if costs:
                yield pa.RecordBatch.from_arrays([keys[0], *[pa.array(x, pa.int64()) for x in (*heads, *left)]], names=["image_id", *[f"n{k}" for k in range(len(halves))], *[f"s{k}" for k in range(len(halves))]])
            else:
                yield pa.RecordBatch.from_arrays([*keys, some(t, has), some(c, has), *codes], names=["image_id", "channel", "tr", "tc", "target", "canvas", *[f"c{k}" for k in range(len(halves))]])

    return run


def encode_tiles(target: DataFrame, canvas: DataFrame, sizes: list[int], book: list[int]) -> DataFrame:
    """(image_id, channel, tr, tc, target, canvas, c0, c1, ...): tiles after all layers; cells by place, the codes of each layer by quarter.

    A cell or quarter that is not there is null. All layers are coded in numpy within a tile's row, so that nothing is sorted or shuffled for them.
    """
    return fit_tiles(_tiles_of(target, canvas, _tile(sizes)), sizes, book, _tile(sizes))


def pair_tiles(target: DataFrame, canvas: DataFrame, tile: int) -> DataFrame:
    """(image_id, channel, tr, tc, target, canvas): both by tiles of side `tile`; canvas is one colour where canvas is given as colours."""
    return _tiles_of(target, canvas, tile)


def start_tiles(pairs: DataFrame) -> DataFrame:
    """(image_id, channel, tr, tc, value): the canvas of pair_tiles as arrays by place, at the cells that target has too."""
    own = F.get("canvas", F.lit(0))
    value = F.when(F.size("canvas") < F.size("target"), F.transform("target", lambda t: F.when(t.isNotNull(), own))).otherwise(F.zip_with("target", "canvas", lambda t, c: F.when(t.isNotNull(), c)))
    return pairs.select(*KC, "tr", "tc", value.alias("value"))


def fit_tiles(pairs: DataFrame, sizes: list[int], book: list[int], tile: int) -> DataFrame:
    """encode_tiles of pair_tiles; the quarters of all sizes nest in tiles of side `tile`."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in (*KC, "tr", "tc")], "target array<int>", "canvas array<int>", *[f"c{k} array<int>" for k in range(len(sizes))]])
    return pairs.mapInArrow(_encoder(sizes, book, tile, False), schema)


def tile_strokes(fitted: DataFrame, size: int, tile: int, layer: int = 0) -> DataFrame:
    """as_strokes of a layer of fit_tiles, from each tile's row by itself: `size` is even and divides `tile`, so that squares nest in tiles."""
    if size % 2 or tile % size:
        raise ValueError(f"squares of side {size} in tiles of side {tile}")
    across = tile // (size // 2)
    at = lambda c, k: F.col(c) * (tile // size) + k

    def square(i: int, j: int) -> Column:
        quarters = [(2 * i + q // 2) * across + 2 * j + q % 2 for q in range(4)]
        idx = F.array(*[F.coalesce(F.get(f"c{layer}", F.lit(q)), F.lit(-1)) for q in quarters])
        return F.struct((at("tr", i) * (1 << 31) + at("tc", j)).alias("stroke_id"), (at("tr", i) * size).cast("int").alias("row"), (at("tc", j) * size).cast("int").alias("col"), F.lit(size).alias("size"), idx.alias("idx"))

    all_ = F.array(*[square(i, j) for i in range(tile // size) for j in range(tile // size)])
    return fitted.select(*KC, F.inline(all_)).where(F.exists("idx", lambda x: x >= 0)).select("image_id", "stroke_id", "channel", "row", "col", "size", "idx")


def tile_cells(tiles: DataFrame, value: str, tile: int, *more: Column) -> DataFrame:
    """(cell, value, more) of the tiles' cells; more may use `pos`, a cell's place within its tile."""
    each = tiles.select("*", F.posexplode(value).alias("pos", "__v")).where("__v IS NOT NULL")
    at = lambda c, k: (F.col(c) * tile + k).cast("int")
    return each.select(*KC, at("tr", idiv(F.col("pos"), tile)).alias("row"), at("tc", F.col("pos") % tile).alias("col"), F.col("__v").alias(value), *more)


def encode_cells(target: DataFrame, canvas: DataFrame, sizes: list[int], book: list[int]) -> DataFrame:
    """(cell, target, canvas, c0, c1, ...): the canvas after all layers, and each cell's code in each layer."""
    tile = _tile(sizes)
    halves = [max(1, s // 2) for s in sizes]
    quarter = lambda half: (idiv(idiv(F.col("pos"), tile), half) * (tile // half) + idiv(F.col("pos") % tile, half)).cast("int")
    return tile_cells(encode_tiles(target, canvas, sizes, book), "target", tile, F.get("canvas", F.col("pos")).alias("canvas"), *[F.get(f"c{k}", quarter(h)).alias(f"c{k}") for k, h in enumerate(halves)])


def tile_codes(tiles: DataFrame, sizes: list[int], book: list[int]) -> DataFrame:
    """code_tiles of encode_tiles: equal to code_tiles(layer_codes(encode_cells(...))), without a row for each quarter."""
    tile = _tile(sizes)

    def layer(k: int, half: int) -> Column:
        across = tile // half
        head = F.array(*[F.lit((q // across) * half * tile + (q % across) * half) for q in range(across * across)])
        by = F.transform(f"c{k}", lambda c, q: F.when(F.get("canvas", F.get(head, q)).isNotNull(), book_value(book, c)))
        return F.struct(F.sequence(F.lit(0), F.lit(across * across - 1)).alias("at"), by.alias("by")).alias(f"l{k}")

    return tiles.select(*KC, "tr", "tc", *[layer(k, max(1, s // 2)) for k, s in enumerate(sizes)])


def layer_codes(encoded: DataFrame, sizes: list[int]) -> DataFrame:
    """(image_id, channel, layer, qr, qc, idx): one row for each quarter of each layer."""
    entries = F.array(*[F.struct(F.lit(k).alias("layer"), idiv(F.col("row"), max(1, s // 2)).cast("int").alias("qr"), idiv(F.col("col"), max(1, s // 2)).cast("int").alias("qc"), F.col(f"c{k}").alias("idx")) for k, s in enumerate(sizes)])
    first = lambda at, s: F.col(at) % max(1, s // 2) == 0
    own = F.filter(entries, lambda e: reduce(lambda a, b: a | b, [(e["layer"] == k) & first("row", s) & first("col", s) for k, s in enumerate(sizes)]))
    return encoded.select(*KC, F.inline(own))


def fit_layer(target: DataFrame, canvas: DataFrame, size: int, book: list[int]) -> tuple[DataFrame, DataFrame]:
    """(codes, canvas) of one layer of squares of side `size`: codes as in layer_codes, canvas as cells."""
    done = encode_cells(target, canvas, [size], book)
    return layer_codes(done, [size]).drop("layer"), done.select(*CELL, F.col("canvas").alias("value"))


def as_strokes(codes: DataFrame, size: int) -> DataFrame:
    """The squares of a layer's codes, as strokes with idx; quarters that lie outside the raster have code -1."""
    tile = codes.groupBy(*KC, idiv(F.col("qr"), 2).cast("int").alias("tr"), idiv(F.col("qc"), 2).cast("int").alias("tc"))
    at = [F.max(F.when((F.col("qr") % 2 == q // 2) & (F.col("qc") % 2 == q % 2), F.col("idx"))) for q in range(4)]
    idx = tile.agg(F.array(*[F.coalesce(a, F.lit(-1)) for a in at]).alias("idx"))
    return idx.select("image_id", (F.col("tr").cast("long") * (1 << 31) + F.col("tc")).alias("stroke_id"), "channel", (F.col("tr") * size).alias("row"), (F.col("tc") * size).alias("col"), F.lit(size).alias("size"), "idx")


def encode_layers(target: DataFrame, canvas: DataFrame, sizes: list[int], book: list[int]) -> DataFrame:
    """(image_id, layer, codes, bits, sse): what each layer costs, and the squared error that is left after it.

    All layers' errors come from the one pass that encodes them.
    """
    tiles = _tiles_of(target, canvas, _tile(sizes))
    costs = [f"{c}{k}" for c in "ns" for k in range(len(sizes))]
    schema = ", ".join([f"image_id {tiles.schema['image_id'].dataType.simpleString()}", *[f"{c} long" for c in costs]])
    sums = tiles.mapInArrow(_encoder(sizes, book, _tile(sizes), True), schema).groupBy(*K).agg(*[F.sum(c).alias(c) for c in costs])
    layers = F.inline(F.array(*[F.struct(F.lit(k).alias("layer"), F.col(f"n{k}").alias("codes"), (F.col(f"n{k}") * code_bits(len(book))).alias("bits"), F.col(f"s{k}").alias("sse")) for k in range(len(sizes))]))
    return sums.select("image_id", layers)


def code_tiles(codes: DataFrame, sizes: list[int], book: list[int]) -> DataFrame:
    """(image_id, channel, tr, tc, l0, l1, ...): all codes of a tile in one row, tiles being those that the quarters of all layers nest in.

    Each layer has arrays at (numbers of quarters, ascending) and by (what their cells are moved by). codes may have the region, as
    `code`; quarters of different regions then have numbers of their own.
    """
    tile = _tile(sizes)
    region = F.col("code") if "code" in codes.columns else F.lit(0)
    half = F.element_at(F.array(*[F.lit(max(1, s // 2)) for s in sizes]), F.col("layer") + 1)
    corner = lambda q: F.col(q).cast("long") * half
    number = idiv(corner("qr") % tile, half) * idiv(F.lit(tile), half) + idiv(corner("qc") % tile, half) + region * idiv(F.lit(tile), half) * idiv(F.lit(tile), half)
    placed = codes.select(*KC, idiv(corner("qr"), tile).alias("tr"), idiv(corner("qc"), tile).alias("tc"), F.struct(F.col("layer").cast("int").alias("layer"), number.cast("int").alias("at"), book_value(book, F.col("idx")).alias("by")).alias("c"))
    tiles = placed.groupBy(*KC, "tr", "tc").agg(F.array_sort(F.collect_list("c")).alias("all"))
    own = lambda k: F.filter("all", lambda c: c["layer"] == k)
    return tiles.select(*KC, "tr", "tc", *[own(k).alias(f"l{k}") for k in range(len(sizes))]).select(*KC, "tr", "tc", *[F.struct(F.col(f"l{k}.at").alias("at"), F.col(f"l{k}.by").alias("by")).alias(f"l{k}") for k in range(len(sizes))])


def canvas_of(canvas: DataFrame, tile: int) -> DataFrame:
    """(image_id, channel, tr, tc, value): a canvas by tiles of side `tile`, as arrays by place; cells without a value are left out."""
    return _dense(canvas.select(*CELL, F.col("value").cast("int").alias("value")), ["value"], tile)


def canvas_tiles(canvas: DataFrame, sizes: list[int]) -> DataFrame:
    """canvas_of by the tiles of code_tiles."""
    return canvas_of(canvas, _tile(sizes))


def _decoder(sizes: list[int], tile: int, regions: tuple[int, int, int] | None):
    """Cells of many tiles moved by all layers' codes, as a function from Arrow batches of joined tiles to Arrow batches."""
    halves = [max(1, s // 2) for s in sizes]
    h, w, depth = regions or (0, 0, 0)
    rows_at, cols_at = halvings(h, (depth + 1) // 2), halvings(w, depth // 2)
    places, step = list(range(tile * tile)), max(1, CELLS // (tile * tile))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at = np.array(places)
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            rows = batch.num_rows
            flat = batch.column("value").flatten()
            has = flat.is_valid().to_numpy(zero_copy_only=False)
            value = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, -1)
            region = np.zeros((1, 1), np.int64)
            if depth:
                corner = lambda c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False)).astype(np.int64)[:, None] * tile
                r = np.searchsorted(rows_at, corner("tr") + at // tile, "right")
                c = np.searchsorted(cols_at, corner("tc") + at % tile, "right")
                region = np.zeros((rows, len(at)), np.int64)
                for k in range(depth):
                    x, left = (r, (depth + 1) // 2 - 1 - k // 2) if k % 2 == 0 else (c, depth // 2 - 1 - k // 2)
                    region = region * 2 + ((x >> left) & 1)
            for k, half in enumerate(halves):
                across = tile // half
                many = across * across << depth
                number = (at // tile // half) * across + at % tile // half + region * across * across
                mine = (np.arange(rows)[:, None] * many + number).reshape(-1)
                by = batch.column(f"b{k}")
                owner, move = pc.list_parent_indices(by).to_numpy(zero_copy_only=False), by.flatten()
                keys = owner * many + pc.list_flatten(batch.column(f"a{k}")).to_numpy(zero_copy_only=False).astype(np.int64)
                there = move.is_valid().to_numpy(zero_copy_only=False)
                move = pc.fill_null(move, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                if len(keys) == rows * many and (keys == np.arange(len(keys))).all():
                    hit, m = there[mine], move[mine]
                else:
                    keys, move = keys[there], move[there]
                    if not len(keys):
                        continue
                    order = np.lexsort((move, keys))
                    keys, move = keys[order], move[order]
                    near = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    hit, m = keys[near] == mine, move[near]
                old = value.reshape(-1)
                value = np.where(hit, np.clip(old + m, 0, 255), old)
            flat = value.reshape(-1)
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(at)), pa.int32()), pa.array(flat, pa.int32(), mask=~has))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("image_id", "channel", "tr", "tc")], held], names=["image_id", "channel", "tr", "tc", "value"])

    return run


def decode_tiles(canvas: DataFrame, codes: DataFrame, sizes: list[int], regions: tuple[int, int, int] | None = None) -> DataFrame:
    """The canvas after all layers' codes, from canvas_tiles and code_tiles: one row a tile on each side, cells moved inside it.

    Nothing is multiplied by layers. Tables in buckets by image, channel and tile (storage.write_bucketed) join without a shuffle.
    regions: (h, w, depth) where codes have regions.
    """
    both = canvas.join(codes, [*KC, "tr", "tc"], "left").select(*KC, "tr", "tc", "value", *[F.coalesce(F.col(f"l{k}.{x}"), F.array().cast("array<int>")).alias(f"{y}{k}") for k in range(len(sizes)) for x, y in (("at", "a"), ("by", "b"))])
    schema = ", ".join([*[f"{c} {both.schema[c].dataType.simpleString()}" for c in (*KC, "tr", "tc")], "value array<int>"])
    return tile_cells(both.mapInArrow(_decoder(sizes, _tile(sizes), regions), schema), "value", _tile(sizes))


def decode_layers(canvas: DataFrame, codes: DataFrame, sizes: list[int], book: list[int], regions: tuple[int, int, int] | None = None) -> DataFrame:
    """The canvas after all layers' codes; cells that no code meets stay."""
    return decode_tiles(canvas_tiles(canvas, sizes), code_tiles(codes, sizes, book), sizes, regions)


def encode_selected(target: DataFrame, canvas: DataFrame, size: int, book: list[int], h: int, w: int, depth: int, strategy: str = "Strict") -> DataFrame:
    """(image_id, codes, bits, sse) of one layer that moves only the worst region of each selected channel.

    Regions are those of `depth` halvings, channels those of channel_selector; a channel costs its region's `depth` bits
    and three channel numbers of two bits an image, each quarter in the region its code. sse is over all cells of the raster.
    """
    half = max(1, size // 2)
    coded = lambda df, name: df.select(*CELL, F.col("value").cast("int").alias(name), quadrant_code(F.col("row"), F.col("col"), h, w, depth).alias("code"))
    if "colour" in canvas.columns:
        both = coloured(_dense(coded(target, "target"), ["target"], half, ("code",)), canvas).withColumn("canvas", F.array_repeat(F.col("colour"), half * half))
    else:
        none = F.lit(None).cast("int")
        both = _dense(coded(target, "target").withColumn("canvas", none).unionByName(coded(canvas, "canvas").withColumn("target", none)), ["target", "canvas"], half, ("code",))
    off = lambda m: F.zip_with("target", "canvas", lambda t, c: F.when(c.isNotNull(), (t - (c if m is None else clip_add(c, m))).cast("long")))
    total = lambda f, diffs: F.aggregate(diffs, F.lit(0).cast("long"), lambda a, d: a + F.coalesce(f(d), F.lit(0)))
    square = lambda d: d * d
    # a quarter within its region: its cells, and what they are off by; read twice
    quarters = checkpoint(both.select(*KC, "code", "target", "canvas", off(None).alias("off")).select(*KC, "code", "target", "canvas", total(lambda d: F.when(d.isNotNull(), 1), F.col("off")).alias("n"), total(lambda d: d, F.col("off")).alias("s"), total(F.abs, F.col("off")).alias("err"), total(square, F.col("off")).alias("sse")).where("n > 0"))
    errors = checkpoint(quarters.groupBy(*KC, "code").agg(F.sum("err").alias("err"), F.sum("sse").alias("sse")))
    by_channel = errors.groupBy(*KC).agg(F.sum("err").alias("sum_err"))
    chosen = channel_selector(by_channel, strategy).select("image_id", F.explode(F.array_distinct("selector")).alias("channel"))
    worst = worst_quadrant(errors).join(chosen, KC).select(*KC, "code")
    moved = quarters.join(worst, [*KC, "code"], "left_semi").withColumn("m", book_value(book, nearest_code(F.col("s"), F.col("n"), book).cast("int")))
    spent = moved.groupBy(*KC).agg(F.count("*").alias("codes"), F.sum(total(square, off(F.col("m"))) - F.col("sse")).alias("change"))
    spent = spent.groupBy(*K).agg(F.sum("codes").alias("codes"), F.sum(F.col("codes") * code_bits(len(book)) + depth).alias("bits"), F.sum("change").alias("change"))
    left = errors.groupBy(*K).agg(F.sum("sse").alias("sse")).join(spent, K, "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    return left.select("image_id", none("codes").cast("long").alias("codes"), (none("bits") + 6).cast("long").alias("bits"), (F.col("sse") + none("change")).alias("sse"))


def _sweeper(configs: list[tuple[int, list[int]]], tile: int):
    """One layer of many tiles under each (half, book) of configs, as a function from Arrow batches of _tiles_of to Arrow batches."""
    step = max(1, CELLS // (tile * tile))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            rows = batch.num_rows

            def read(name):
                flat = batch.column(name).flatten()
                shape = (rows, tile, tile) if len(flat) == rows * tile * tile else (rows, 1, 1)
                x, has = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64), flat.is_valid().to_numpy(zero_copy_only=False)
                return np.broadcast_to(x.reshape(shape), (rows, tile, tile)), np.broadcast_to(has.reshape(shape), (rows, tile, tile))

            (t, has), (c, also) = read("target"), read("canvas")
            has = has & also
            diff = np.where(has, t - c, 0)
            # rows of one image follow each other: their sums leave together
            codes = pc.dictionary_encode(batch.column("image_id"), null_encoding="encode")
            image = codes.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(image, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(image[order]) > 0])
            images = batch.column("image_id").take(pa.array(order[starts]))
            sums = lambda x: pa.array(np.add.reduceat(x[order], starts), pa.int64())
            held = {}
            for k, (half, book) in enumerate(configs):
                across = tile // half
                blocks = lambda x: x.reshape(rows, across, half, across, half).sum(axis=(2, 4))
                if half not in held:
                    held[half] = blocks(has.astype(np.int64)), blocks(diff)
                n, s = held[half]
                moves = np.array(book, np.int64)
                best, idx = None, np.zeros(n.shape, np.int64)
                for j, m in enumerate(moves):
                    away = np.abs(m * n - s)
                    idx = idx if best is None else np.where(away < best, j, idx)
                    best = away if best is None else np.minimum(away, best)
                new = np.clip(c + moves[idx].repeat(half, axis=1).repeat(half, axis=2), 0, 255)
                left = (np.where(has, t - new, 0) ** 2).sum(axis=(1, 2))
                yield pa.RecordBatch.from_arrays([images, pa.array(np.full(len(starts), k), pa.int32()), sums((n > 0).sum(axis=(1, 2))), sums(left)], names=["image_id", "k", "codes", "sse"])

    return run


def config_sweep(target: DataFrame, canvas: DataFrame, configs: DataFrame) -> DataFrame:
    """(image_id, config_id, codes, bits, sse) of one layer under each row (config_id, size, book) of configs.

    The rasters are paired once, in rows of the tiles that the quarters of all sizes nest in; a tile is coded under every configuration in
    numpy, and leaves as sums. How many books and sizes there are does not change the plan's shape.
    """
    rows = few_rows(configs.select("config_id", "size", "book"))
    halves = [max(1, r["size"] // 2) for r in rows]
    tile = math.lcm(*halves)
    tiles = _tiles_of(target, canvas, tile)
    sweep = _sweeper([(h, list(r["book"])) for h, r in zip(halves, rows)], tile)
    sums = tiles.mapInArrow(sweep, f"image_id {tiles.schema['image_id'].dataType.simpleString()}, k int, codes long, sse long")
    config = F.get(F.array(*[F.struct(F.lit(r["config_id"]).alias("config_id"), F.lit(code_bits(len(r["book"]))).cast("long").alias("width")) for r in rows]), F.col("k"))
    each = sums.select("image_id", config.alias("c"), "codes", "sse").where("codes > 0")
    return each.groupBy("image_id", F.col("c.config_id").alias("config_id")).agg(F.sum("codes").alias("codes"), F.sum(F.col("codes") * F.col("c.width")).alias("bits"), F.sum("sse").alias("sse"))


def param_sweep(target: DataFrame, canvas: DataFrame, books: dict[int, list[int]], size: int) -> DataFrame:
    """(image_id, book_id, codes, bits, sse) of one layer under each codebook; the rasters are paired and partitioned once."""
    half = max(1, size // 2)
    quarters = residual(target, canvas).groupBy(*KC, idiv(F.col("row"), half).alias("qr"), idiv(F.col("col"), half).alias("qc")).agg(F.sum("diff").alias("s"), F.count("diff").alias("n"), F.collect_list(F.struct("target", "canvas")).alias("cells"))
    each = quarters.select("image_id", F.explode(F.array(*[F.struct(F.lit(k).alias("book_id"), F.lit(code_bits(len(b))).alias("width"), book_value(b, nearest_code(F.col("s"), F.col("n"), b).cast("int")).alias("m")) for k, b in books.items()])).alias("x"), "cells")
    left = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.pow(c["target"] - clip_add(c["canvas"], F.col("x")["m"]), F.lit(2)).cast("long"))
    return each.select("image_id", "x.book_id", "x.width", left.alias("e")).groupBy("image_id", "book_id").agg(F.count("*").alias("codes"), F.sum("width").cast("long").alias("bits"), F.sum("e").alias("sse"))
