"""Residual codes of several layers in the worst regions of selected channels only.

The raster is read once, into rows of small tiles that lie in one region each; layers are coded in numpy over many tiles. From then on a table of errors by region, the finest
level of the pyramid, tells what to code next: each layer picks its channels and regions from it, moves the cells of these regions, and
puts their new errors into it. What a layer costs grows with the cells that it moves, not with the raster.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import CELL, KC, K, code_bits, idiv, quadrant_code
from ..sources.storage import Steps, checkpoint, write_bucketed
from .cells import coloured
from .layers import _dense
from .quadrant import channel_selector, top_k_quadrants

REGION = [*KC, "code"]
#: Least side of the tiles that hold a region's cells.
TILE = 4
#: Cells that numpy handles at once, or one tile.
CELLS = 1 << 18


def _tiled(target: DataFrame, canvas: DataFrame, h: int, w: int, depth: int, tile: int = TILE) -> DataFrame:
    """(region, tr, tc, target, canvas, n, err, sse) by tiles of each region, cells as arrays by place, in a table in buckets by region, which joins by region without a shuffle.

    canvas is one colour where canvas is given as colours; then cells in partitions by image are not shuffled, only their tiles are.
    """
    parts = int(target.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = lambda df: df.withColumn("code", quadrant_code(F.col("row"), F.col("col"), h, w, depth))
    want = target.select(*CELL, F.col("value").cast("int").alias("target"))
    if "colour" in canvas.columns:
        tiles = coloured(_dense(inside(want), ["target"], tile, ("code",)), canvas).withColumn("canvas", F.array("colour"))
    else:
        none = F.lit(None).cast("int")
        both = want.withColumn("canvas", none).unionByName(canvas.select(*CELL, none.alias("target"), F.col("value").cast("int").alias("canvas")))
        tiles = _dense(inside(both), ["target", "canvas"], tile, ("code",))
    tiles = tiles.select(*REGION, "tr", "tc", "target", "canvas")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tiles.schema)
    tiles = tiles.mapInArrow(_layer(0, [], tile), f"{kinds}, n long, err long, sse long").where("n > 0")
    return write_bucketed(tiles, f"regions_{uuid.uuid4().hex}", REGION, parts)


def _arrays(batch, tile: int):
    """target, canvas and where both are, of a batch of tiles: (rows, tile, tile) each."""
    import numpy as np
    import pyarrow.compute as pc

    def read(name):
        flat = batch.column(name).flatten()
        shape = (batch.num_rows, tile, tile) if len(flat) == batch.num_rows * tile * tile else (batch.num_rows, 1, 1)
        x, has = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64), flat.is_valid().to_numpy(zero_copy_only=False)
        return (np.broadcast_to(a.reshape(shape), (batch.num_rows, tile, tile)) for a in (x, has))

    (t, has), (c, also) = read("target"), read("canvas")
    return t, c, has & also


def _layer(half: int, book: list[int], tile: int):
    """One layer of many tiles at once, as a function from Arrow batches of _tiled to Arrow batches; half 0: only the errors of the tiles as they are, added."""
    step = max(1, CELLS // (tile * tile))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        moves = np.array(book, np.int64)
        some = lambda x, has: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x[0].size), pa.int32()), pa.array(x.reshape(-1), pa.int32(), mask=~has.reshape(-1)))
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            rows = batch.num_rows
            t, c, has = _arrays(batch, tile)
            names = [*REGION, "tr", "tc", "target", "canvas"]
            keys = [batch.column(k) for k in names]
            if half:
                across = tile // half
                blocks = lambda x: x.reshape(rows, across, half, across, half).sum(axis=(2, 4))
                n, s = blocks(has.astype(np.int64)), blocks(np.where(has, t - c, 0))
                idx = np.abs(moves * n[..., None] - s[..., None]).argmin(axis=3)
                c = np.clip(c + moves[idx].repeat(half, axis=1).repeat(half, axis=2), 0, 255)
                keys[-2:] = [some(t, has), some(c, has), some(idx, n > 0), pa.array((n > 0).sum(axis=(1, 2)), pa.int64())]
                names += ["idx", "codes"]
            off = np.where(has, t - c, 0)
            sums = [has.sum(axis=(1, 2)), np.abs(off).sum(axis=(1, 2)), (off * off).sum(axis=(1, 2))]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x, pa.int64()) for x in sums]], names=[*names, "n", "err", "sse"])

    return run


def _errors(tiles: DataFrame) -> DataFrame:
    """(region, n, err, sse) of regions with cells."""
    return tiles.groupBy(*REGION).agg(*[F.sum(x).alias(x) for x in ("n", "err", "sse")])


def chosen_regions(pyramid: DataFrame, k: int, strategy: str) -> DataFrame:
    """(region, last) of the k worst regions of each selected channel; pyramid: (region, err, last)."""
    by_channel = pyramid.groupBy(*KC).agg(F.sum("err").alias("sum_err"))
    channels = channel_selector(by_channel, strategy).select("image_id", F.explode(F.array_distinct("selector")).alias("channel"))
    return top_k_quadrants(pyramid.join(channels, KC), k).select(*REGION, "last")


def encode_regions(target: DataFrame, canvas: DataFrame, sizes: list[int], book: list[int], h: int, w: int, depth: int, k: int = 1, strategy: str = "Smart") -> tuple[DataFrame, DataFrame]:
    """(codes, layers): codes (image_id, channel, code, layer, qr, qc, idx), which decode_layers reads; layers (image_id, layer, codes, regions, bits, sse).

    Each layer codes quarters of squares of its size in the k worst of the regions that `depth` halvings give, of the channels that the
    strategy selects. A region costs its `depth` bits, the selection two bits for each of three channels, a quarter its code; a
    quarter that a region's border cuts has a code in each region. Ties go to the lower channel and region.
    """
    halves = [max(1, s // 2) for s in sizes]
    tile = math.lcm(*halves)
    tile *= -(-TILE // tile)
    start = _tiled(target, canvas, h, w, depth, tile)
    pyramid = checkpoint(_errors(start).withColumn("last", F.lit(-1)))
    steps = Steps(target.sparkSession)
    versions, codes, layers = [start], [], []
    held = ["tr", "tc", "target", "canvas"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in start.select(*REGION, "tr", "tc").schema)
    schema = f"{kinds}, target array<int>, canvas array<int>, idx array<int>, codes long, n long, err long, sse long"
    for layer, half in enumerate(halves):
        chosen = checkpoint(chosen_regions(pyramid, k, strategy))
        now = reduce(DataFrame.unionByName, [v.select(*REGION, *held).join(chosen.where(F.col("last") == age - 1).drop("last"), REGION) for age, v in enumerate(versions)])
        done = steps.put(now.mapInArrow(_layer(half, book, tile), schema).where("n > 0"))
        versions.append(done)
        across, place = tile // half, F.col("pos")
        quarters = done.select(*REGION, "tr", "tc", F.posexplode("idx").alias("pos", "idx")).where("idx IS NOT NULL")
        at = lambda t, p: (F.col(t) * across + p).cast("int")
        codes.append(quarters.select(*REGION, F.lit(layer).alias("layer"), at("tr", idiv(place, across)).alias("qr"), at("tc", place % across).alias("qc"), "idx"))
        by_region = checkpoint(done.groupBy(*REGION).agg(F.sum("err").alias("e"), F.sum("sse").alias("s"), F.sum("codes").alias("codes")))
        new = by_region.select(*REGION, "e", "s", F.lit(layer).alias("l"))
        pyramid = checkpoint(pyramid.join(new, REGION, "left").select(*REGION, "n", F.coalesce("e", "err").alias("err"), F.coalesce("s", "sse").alias("sse"), F.coalesce("l", "last").alias("last")))
        spent = by_region.groupBy(*K).agg(F.sum("codes").alias("codes"), F.count("*").alias("regions"))
        left = pyramid.groupBy(*K).agg(F.sum("sse").alias("sse"))
        bits = F.col("codes") * code_bits(len(book)) + F.col("regions") * depth + 6
        layers.append(spent.join(left, K).select("image_id", F.lit(layer).alias("layer"), "codes", "regions", bits.alias("bits"), "sse"))
    return reduce(DataFrame.unionByName, codes), reduce(DataFrame.unionByName, layers)
