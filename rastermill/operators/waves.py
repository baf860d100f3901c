"""Fit of squares that overlap, in the order of their numbers: small channels in one row each, large ones as waves of squares that don't overlap.

A square's codes depend on the cells that earlier squares have moved. Its level is the longest chain of overlaps that ends in it; squares of
one level share no cell, so that a level is fitted at once. A cell knows the squares that cover it, in their order; after each level
the cells that were moved are written to wait, with their values, in the folder of the level of the next square on their list. The
work is the sum of all footprints: cells that a level does not cover are not read for it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import CELL, KC, book_value, clip_add, nearest_code
from ..sources.storage import Steps, checkpoint, shared_dir
from .layers import _tiles_of, tile_cells
from .strokes import footprint, overlapping_strokes

STROKE = [*KC, "stroke_id"]


def stroke_levels(strokes: DataFrame) -> DataFrame:
    """strokes' keys with level: 0 for squares that overlap no earlier one, else one more than the highest of those.

    Longest paths by rounds over the overlaps, as many as there are levels: a round passes on the levels that the last one raised.
    """
    edges = checkpoint(overlapping_strokes(strokes))
    levels = checkpoint(strokes.select(*STROKE, F.lit(0).alias("level")))
    raised = levels
    while True:
        reached = edges.join(raised.withColumnRenamed("stroke_id", "first"), [*KC, "first"]).groupBy(*KC, F.col("second").alias("stroke_id")).agg((F.max("level") + 1).alias("new"))
        both = checkpoint(levels.join(reached, STROKE, "left").select(*STROKE, F.coalesce(F.greatest("level", "new"), "level").alias("level"), (F.col("new") > F.col("level")).alias("up")))
        levels, raised = both.drop("up"), both.where("up").drop("up")
        if raised.isEmpty():
            return levels


#: Side of the largest channel, squares included, that is fitted in one row.
SIDE = 256
#: Side of the tiles that channels are packed in.
TILE = 8
#: Cells that numpy handles at once, or one channel.
CELLS = 1 << 20


def _fitter(book: list[int], codes: bool):
    """All squares of many channels in their order, as a function from Arrow batches (image_id, channel, tiles, squares) to those of codes or of tiles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        moves = np.array(book, np.int64)
        number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)

        def members(column):
            return number(pc.list_parent_indices(column)), column.flatten()

        def fit(batch):
            rows = batch.num_rows
            owner, tiles = members(batch.column("tiles"))
            mine, squares = members(batch.column("squares"))
            tr, tc = number(tiles.field("tr")), number(tiles.field("tc"))
            r, c, size = (number(squares.field(x)) for x in ("row", "col", "size"))
            least, most = np.full((2, rows), 1 << 60), np.full((2, rows), -(1 << 60))
            for k, (own, at) in enumerate(((tr, r), (tc, c))):
                np.minimum.at(least[k], owner, own)
                np.maximum.at(most[k], owner, own + 1)
                np.minimum.at(least[k], mine, at // TILE)
                np.maximum.at(most[k], mine, (at + size + TILE - 1) // TILE)
            high, wide = (most - least).max(axis=1)
            step = max(1, CELLS // int(high * wide * TILE * TILE))
            if rows > step:
                for k in range(0, rows, step):
                    yield from fit(batch.slice(k, step))
                return
            place = (owner, tr - least[0][owner], slice(None), tc - least[1][owner])
            packed = lambda: np.zeros((rows, high, TILE, wide, TILE), np.int64)

            def read(name):
                flat = tiles.field(name).flatten()
                shape = (len(owner), TILE, TILE) if len(flat) == len(owner) * TILE * TILE else (len(owner), 1, 1)
                return number(pc.fill_null(flat, 0)).reshape(shape), flat.is_valid().to_numpy(zero_copy_only=False).reshape(shape)

            (t, there), (v, also) = read("target"), read("canvas")
            there = np.broadcast_to(there & also, (len(owner), TILE, TILE))
            want, value, has, over = packed(), packed(), packed(), packed()
            want[place], value[place], has[place] = t, v, there
            flat = lambda x: x.reshape(rows, high * TILE, wide * TILE)
            want, now, held, over = flat(want), flat(value), flat(has), flat(over)
            r, c = r - least[0][mine] * TILE, c - least[1][mine] * TILE
            nth = np.arange(len(mine)) - np.searchsorted(mine, mine)
            idx, some, level = np.zeros((len(mine), 4), np.int64), np.zeros((len(mine), 4), bool), np.zeros(len(mine), np.int64)
            order = np.lexsort((size, nth))
            for own in np.split(order, np.flatnonzero(np.diff(nth[order]) | np.diff(size[order])) + 1) if len(order) else []:
                z = int(size[own[0]])
                half, along = z // 2, np.arange(z)
                at = (mine[own][:, None, None], (r[own][:, None] + along)[:, :, None], (c[own][:, None] + along)[:, None, :])
                old, here = now[at], held[at]
                off = (want[at] - old) * here
                level[own] = over[at].max(axis=(1, 2))
                over[at] = level[own][:, None, None] + 1
                for q in range(4):
                    part = (slice(None), slice(half, z) if q >= 2 else slice(0, half), slice(half, z) if q % 2 else slice(0, half))
                    n, s = here[part].sum(axis=(1, 2)), off[part].sum(axis=(1, 2))
                    best = np.abs(moves * n[:, None] - s[:, None]).argmin(axis=1)
                    idx[own, q], some[own, q] = best, n > 0
                    old[part] = np.where(here[part] > 0, np.clip(old[part] + moves[best][:, None, None], 0, 255), old[part])
                now[at] = old
            if codes:
                k, q = np.nonzero(some)
                key = [batch.column(x).take(pa.array(mine[k])) for x in KC]
                yield pa.RecordBatch.from_arrays([*key, squares.field("stroke_id").take(pa.array(k)), pa.array(q, pa.int32()), pa.array(level[k], pa.int32()), pa.array(idx[k, q], pa.int32())], names=[*STROKE, "quarter", "level", "idx"])
            else:
                done = value[place].reshape(-1)  # `now` is a view of value
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(done) + 1, TILE * TILE), pa.int32()), pa.array(done, pa.int32(), mask=~there.reshape(-1)))
                key = [batch.column(x).take(pa.array(owner)) for x in KC]
                yield pa.RecordBatch.from_arrays([*key, tiles.field("tr"), tiles.field("tc"), cells], names=[*KC, "tr", "tc", "value"])

        for batch in batches:
            if batch.num_rows:
                yield from fit(batch)

    return run


def fit_strokes(target: DataFrame, canvas: DataFrame, strokes: DataFrame, book: list[int]) -> tuple[DataFrame, DataFrame]:
    """(codes, canvas) after all squares in the order of stroke_id, each fitted to what the earlier ones left.

    codes: (image_id, channel, stroke_id, quarter, level, idx) for each quarter with a cell; canvas: all cells. Stroke numbers are unique
    within an image and channel; cells are those that target and canvas both have. canvas may be colours (image_id, channel, colour).

    A channel whose cells and squares lie within SIDE x SIDE places is one row of tiles and squares, whose squares are fitted in it one after the
    other, in numpy over many channels at once; such channels are fitted anew for each of the two results that is read. Larger channels go
    by waves of cells over many tasks. The packed tiles stay in the shared folder, as the results read them.
    """
    steps = Steps(strokes.sparkSession)
    tiles = steps.put(_tiles_of(target, canvas, TILE))
    squares = strokes.where("size > 0").select(*STROKE, "row", "col", "size")
    span = lambda lo, hi, unit: [F.min(F.floor(lo / unit)).alias("lo"), F.max(F.ceil(hi / unit)).alias("hi")]
    c = F.col
    axes = [tiles.groupBy(*KC).agg(*span(c(x), c(x) + 1, 1)).unionByName(squares.groupBy(*KC).agg(*span(c(y), c(y) + c("size"), TILE))).groupBy(*KC).agg((F.max("hi") - F.min("lo")).alias("n")).where(c("n") * TILE > SIDE) for x, y in (("tr", "row"), ("tc", "col"))]
    large = checkpoint(axes[0].unionByName(axes[1]).select(*KC).distinct())
    split = not large.isEmpty()
    small = lambda df: df.join(large, KC, "left_anti") if split else df
    held = small(tiles).groupBy(*KC).agg(F.collect_list(F.struct("tr", "tc", "target", "canvas")).alias("tiles"))
    own = small(squares).groupBy(*KC).agg(F.sort_array(F.collect_list(F.struct("stroke_id", "row", "col", "size"))).alias("squares"))
    both = held.join(own, KC, "left")
    both = both.withColumn("squares", F.coalesce("squares", F.array().cast(both.schema["squares"].dataType)))
    kinds = {f.name: f.dataType.simpleString() for d in (strokes, tiles) for f in d.schema}
    key = f"image_id {kinds['image_id']}, channel {kinds['channel']}"
    codes = both.where(F.size("squares") > 0).mapInArrow(_fitter(book, True), f"{key}, stroke_id {kinds['stroke_id']}, quarter int, level int, idx int")
    done = tile_cells(both.mapInArrow(_fitter(book, False), f"{key}, tr long, tc long, value array<int>"), "value", TILE)
    if not split:
        return codes, done
    start = tile_cells(tiles.join(large, KC, "left_semi"), "target", TILE, F.get("canvas", F.when(F.size("canvas") > 1, F.col("pos")).otherwise(0)).alias("value")).where("value IS NOT NULL")
    more, rest = _by_waves(start, strokes.join(large, KC, "left_semi"), book)
    return codes.unionByName(more), done.unionByName(rest)


def _by_waves(start: DataFrame, strokes: DataFrame, book: list[int]) -> tuple[DataFrame, DataFrame]:
    """fit_strokes with a wave for each level, whatever the size of a channel. start: (cell, value, target)."""
    levels = stroke_levels(strokes)
    placed = strokes.select(*STROKE, "row", "col", "size").join(levels, STROKE)
    lists = footprint(placed, start).groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("stroke_id", "quarter", "level"))).alias("todo"))
    home = f"{shared_dir(strokes.sparkSession)}/waves-{uuid.uuid4().hex}"
    due = F.get("todo", F.col("next"))
    dealt = lambda df: df.select(*CELL, "value", "target", "todo", "next", F.coalesce(due["level"], F.lit(-1)).alias("due"))
    put = lambda df: dealt(df).write.mode("append").partitionBy("due").parquet(home)
    first = start.join(lists, CELL, "left").withColumn("next", F.lit(0))
    put(first)
    kinds = dealt(first).schema
    waiting = lambda level: start.sparkSession.read.schema(kinds).parquet(home).where(F.col("due") == level).drop("due")
    codes = []
    deepest = levels.agg(F.max("level")).first()[0]
    for level in range(0 if deepest is None else deepest + 1):
        now = waiting(level).select("*", due["stroke_id"].alias("stroke_id"), due["quarter"].alias("quarter"))
        sums = now.groupBy(*STROKE, "quarter").agg(F.sum(F.col("target") - F.col("value")).alias("s"), F.count("*").alias("n"))
        fitted = checkpoint(sums.select(*STROKE, "quarter", F.lit(level).alias("level"), nearest_code(F.col("s"), F.col("n"), book).cast("int").alias("idx")))
        codes.append(fitted)
        step = book_value(book, F.col("idx"))
        put(now.join(fitted.drop("level"), [*STROKE, "quarter"]).select(*CELL, clip_add(F.col("value"), step).cast("int").alias("value"), "target", "todo", (F.col("next") + 1).alias("next")))
    none = levels.select(*STROKE, F.lit(0).alias("quarter"), "level", F.lit(0).alias("idx")).limit(0)
    return reduce(DataFrame.unionByName, codes, none), waiting(-1).select(*CELL, "value")
