"""Squares of cells: what they cover, sums over their quarters, fits, overlaps, and ordered replay.

strokes: image_id, stroke_id, channel, row, col, size (and idx, an array of four codes). A square has four quarters, 0..3 for
top left, top right, bottom left, bottom right; its half is size div 2, so odd squares have the larger lower and right
quarters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import CELL, KC, nearest_code
from .layers import CELLS, canvas_of, tile_cells

#: Bits of the smallest tile's side, and of the side of the tiles that a canvas is replayed in.
LEAST, REPLAY = 4, 3


def sample_origins(bounds: DataFrame, seed: int = 0) -> DataFrame:
    """bounds (image_id, stroke_id, r0, c0, r1, c1) with row and col: places within the bounds that depend on the row's keys alone."""
    draw = lambda a, b, lo, hi: F.col(lo) + F.pmod(F.col("image_id") * a + F.col("stroke_id") * b + F.lit(seed * 2654435 + 12345), F.col(hi) - F.col(lo))
    return bounds.withColumns({"row": draw(7919, 104729, "r0", "r1").cast("int"), "col": draw(6271, 15485863, "c0", "c1").cast("int")})


def valid_strokes(strokes: DataFrame, h: int, w: int) -> DataFrame:
    """Squares with a cell inside the raster; the rest cover nothing."""
    c = F.col
    return strokes.where((c("size") > 0) & (c("row") < h) & (c("col") < w) & (c("row") + c("size") > 0) & (c("col") + c("size") > 0))


def _level() -> Column:
    """Bits of the side of a square's grid: the least power of two that holds the square, 2 ** LEAST or more."""
    return F.greatest(F.lit(LEAST), F.length(F.bin(F.col("size") - 1)))


def _levels(strokes: DataFrame) -> list[int]:
    """The grids that squares of strokes have: 60 numbers at most, whatever the table."""
    return sorted(r["g"] for r in strokes.where("size > 0").select(_level().alias("g")).distinct().collect())


def _tile(at: Column, grid: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), grid)).cast("long")


def _tiles(strokes: DataFrame) -> DataFrame:
    """strokes (with grid) once for each tile of the grid that they touch: four at most in their own grid and in coarser ones."""
    span = lambda at: F.explode(F.sequence(_tile(F.col(at), F.col("grid")), _tile(F.col(at) + F.col("size") - 1, F.col("grid"))))
    return strokes.where("size > 0").select("*", span("row").alias("tr")).select("*", span("col").alias("tc"))


def footprint(strokes: DataFrame, cells: DataFrame) -> DataFrame:
    """(image_id, stroke_id, channel, row, col, quarter, and strokes' other columns) for each cell that a square covers.

    Squares lie in grids by size: each touches four tiles of its own grid at most, however large it is, and a cell lies in one
    tile of each grid that any square has. The join is on the tile, so that squares meet the cells around them only.
    """
    squares = _tiles(strokes.withColumn("grid", _level())).withColumnsRenamed({"row": "srow", "col": "scol"})
    grids = F.explode(F.array(*[F.lit(g) for g in _levels(strokes)]).cast("array<int>")).alias("grid")
    placed = cells.select(*CELL, grids).withColumns({"tr": _tile(F.col("row"), F.col("grid")), "tc": _tile(F.col("col"), F.col("grid"))})
    c = F.col
    inside = (c("row") >= c("srow")) & (c("row") < c("srow") + c("size")) & (c("col") >= c("scol")) & (c("col") < c("scol") + c("size"))
    met = placed.join(squares, [*KC, "grid", "tr", "tc"]).where(inside)
    half = F.floor(c("size") / 2)
    quarter = 2 * (c("row") >= c("srow") + half).cast("int") + (c("col") >= c("scol") + half).cast("int")
    rest = [x for x in strokes.columns if x not in (*KC, "stroke_id", "row", "col", "size")]
    return met.select("image_id", "stroke_id", "channel", "row", "col", quarter.alias("quarter"), *rest)


def summed_area(cells: DataFrame, value: str = "value") -> DataFrame:
    """(cell, total): sums over all cells up to and with each, by row and then by column.

    The windows are single rows and columns, so that one large raster spans many tasks, for a second shuffle.
    """
    along = lambda by, order: Window.partitionBy(*KC, by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cells.select(*CELL, F.sum(value).over(along("row", "col")).alias("part"))
    return rows.select(*CELL, F.sum("part").over(along("col", "row")).alias("total"))


def rect_stats(strokes: DataFrame, cells: DataFrame, h: int, w: int, value: str = "value") -> DataFrame:
    """(image_id, stroke_id, channel, quarter, n, total) for each quarter with cells: four corners of the summed area table each.

    The work is four rows a quarter however large the squares are; equal to footprint with count and sum.
    """
    c = F.col
    half = F.floor(c("size") / 2).cast("int")
    cut = lambda x, most: F.greatest(F.lit(0), F.least(F.lit(most), x))

    def box(q: int) -> Column:
        r0, r1 = (c("row") + half, c("row") + c("size")) if q >= 2 else (c("row"), c("row") + half)
        c0, c1 = (c("col") + half, c("col") + c("size")) if q % 2 else (c("col"), c("col") + half)
        return F.struct(F.lit(q).alias("quarter"), cut(r0, h).alias("r0"), cut(r1, h).alias("r1"), cut(c0, w).alias("c0"), cut(c1, w).alias("c1"))

    quarters = strokes.select(*KC, "stroke_id", F.inline(F.array(*[box(q) for q in range(4)])))
    quarters = quarters.withColumn("n", (c("r1") - c("r0")) * (c("c1") - c("c0"))).where((c("r1") > c("r0")) & (c("c1") > c("c0")))
    corner = lambda r, k, sign: F.struct((c(r) - 1).alias("row"), (c(k) - 1).alias("col"), F.lit(sign).alias("sign"))
    corners = quarters.select(*KC, "stroke_id", "quarter", "n", F.inline(F.array(corner("r1", "c1", 1), corner("r0", "c1", -1), corner("r1", "c0", -1), corner("r0", "c0", 1))))
    sums = corners.join(summed_area(cells, value), CELL, "left")
    return sums.groupBy(*KC, "stroke_id", "quarter", "n").agg(F.sum(c("sign") * F.coalesce("total", F.lit(0))).alias("total")).select("image_id", "stroke_id", "channel", "quarter", "n", "total")


def stroke_fit(strokes: DataFrame, res: DataFrame, book: list[int], h: int, w: int) -> DataFrame:
    """rect_stats with idx: the code nearest to the mean difference of each quarter, on a canvas that stays as it is."""
    stats = rect_stats(strokes, res, h, w, "diff")
    return stats.withColumn("idx", nearest_code(F.col("total"), F.col("n"), book).cast("int"))


def score_candidates(strokes: DataFrame, res: DataFrame, book: list[int], h: int, w: int) -> DataFrame:
    """(image_id, stroke_id, channel, quarter, idx, gain): the code that lowers the squared error most, and by how much.

    Adding m to n cells whose differences sum to s changes the error by n * m * m - 2 * m * s; clipping is left aside.
    """
    change = F.array(*[F.struct((F.col("n") * m * m - 2 * m * F.col("total")).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(book)])
    best = F.array_min(change)
    return rect_stats(strokes, res, h, w, "diff").select("image_id", "stroke_id", "channel", "quarter", best["i"].alias("idx"), (-best["d"]).alias("gain"))


def overlapping_strokes(strokes: DataFrame) -> DataFrame:
    """(image_id, channel, first, second) for pairs of squares of one channel that share a cell, the earlier one first.

    Two squares meet in the grid of the larger one, of which each touches four tiles at most; a pair comes from one tile only,
    that of the upper left cell of what they share.
    """
    own = strokes.select(*KC, "stroke_id", "row", "col", "size", _level().alias("own"))
    grids = F.array(*[F.lit(g) for g in _levels(strokes)]).cast("array<int>")
    guests = _tiles(own.select("*", F.explode(F.filter(grids, lambda g: g >= F.col("own"))).alias("grid")))
    hosts = _tiles(own.withColumn("grid", F.col("own")))
    side = lambda t, p: t.select(*KC, "grid", "tr", "tc", *[F.col(x).alias(f"{p}_{x}") for x in ("stroke_id", "row", "col", "size", "own")])
    c = F.col
    both = side(hosts, "a").join(side(guests, "b"), [*KC, "grid", "tr", "tc"]).where((c("a_stroke_id") < c("b_stroke_id")) | ((c("a_stroke_id") > c("b_stroke_id")) & (c("b_own") < c("a_own"))))
    meet = lambda x: (c(f"a_{x}") < c(f"b_{x}") + c("b_size")) & (c(f"b_{x}") < c(f"a_{x}") + c("a_size"))
    here = (_tile(F.greatest("a_row", "b_row"), c("grid")) == c("tr")) & (_tile(F.greatest("a_col", "b_col"), c("grid")) == c("tc"))
    return both.where(meet("row") & meet("col") & here).select(*KC, F.least("a_stroke_id", "b_stroke_id").alias("first"), F.greatest("a_stroke_id", "b_stroke_id").alias("second"))


def covering_strokes(strokes: DataFrame, cells: DataFrame, covered: bool = True) -> DataFrame:
    """The strokes with (or without) a cell that they cover: a semi (or anti) join."""
    seen = footprint(strokes, cells).select("image_id", "stroke_id", "channel").distinct()
    return strokes.join(seen, ["image_id", "stroke_id", "channel"], "left_semi" if covered else "left_anti")


def _met(tiles: DataFrame, strokes: DataFrame) -> DataFrame:
    """(image_id, channel, tr, tc, and strokes' columns): each square at each tile of replay_tiles that it touches.

    Squares of the smallest grid touch nine tiles at most and are dealt straight to them. A larger one meets the tiles that are there in its own
    grid, of which it touches four: a square much larger than the raster costs no more than the raster's tiles.
    """
    squares = strokes.where("size > 0").select(*KC, "stroke_id", "row", "col", "size", "idx", _level().alias("level"))
    own = ["stroke_id", "row", "col", "size", "idx"]
    met = _tiles(squares.where(F.col("level") == LEAST).withColumn("grid", F.lit(REPLAY))).select(*KC, "tr", "tc", *own)
    large = [g for g in _levels(strokes) if g > LEAST]
    if large:
        keys = tiles.select(*KC, F.col("tr").alias("__r"), F.col("tc").alias("__c"), F.explode(F.array(*[F.lit(g) for g in large])).alias("grid"))
        up = lambda c: F.expr(f"shiftright({c}, grid - {REPLAY})")
        far = keys.withColumns({"tr": up("__r"), "tc": up("__c")}).join(_tiles(squares.where(F.col("level") > LEAST).withColumnRenamed("level", "grid")), [*KC, "grid", "tr", "tc"])
        side = 1 << REPLAY
        inside = lambda t, x: (F.col(x) < (F.col(t) + 1) * side) & (F.col(x) + F.col("size") > F.col(t) * side)
        met = met.unionByName(far.where(inside("__r", "row") & inside("__c", "col")).select(*KC, F.col("__r").alias("tr"), F.col("__c").alias("tc"), *own))
    return met


def _replayer(book: list[int]):
    """Tiles moved by their squares, as a function from Arrow batches (tile, value, ids, some) to Arrow batches (tile, value)."""
    side = 1 << REPLAY
    step = CELLS // (side * side)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        moves, place = np.array([*book, 0], np.int64), np.arange(side)
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            rows = batch.num_rows
            flat = batch.column("value").flatten()
            has = flat.is_valid().to_numpy(zero_copy_only=False)
            value = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, side, side)
            owner = pc.list_parent_indices(batch.column("some")).to_numpy(zero_copy_only=False).astype(np.int64)
            some = batch.column("some").flatten()
            field = lambda c: some.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
            # quarters, in the order of their squares within each tile; those of squares with one stroke_id by how far they move
            corner = lambda t: np.asarray(batch.column(t).to_numpy(zero_copy_only=False)).astype(np.int64)[owner] * side
            r, c, size = field("row") - corner("tr"), field("col") - corner("tc"), field("size")
            ids = pc.dictionary_encode(batch.column("ids").flatten(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            rank = np.cumsum(np.diff(ids, prepend=ids[:1]) != 0)
            q = np.arange(4)
            code = np.stack([some.field(f"i{k}").to_numpy(zero_copy_only=False).astype(np.int64) for k in q], axis=1)
            move = moves[np.where((code >= 0) & (code < len(book)), code, len(book))]
            half, rest = size // 2, size - size // 2
            r0 = np.stack([r + half * (k // 2) for k in q], axis=1)
            c0 = np.stack([c + half * (k % 2) for k in q], axis=1)
            r1 = r0 + np.stack([rest if k // 2 else half for k in q], axis=1)
            c1 = c0 + np.stack([rest if k % 2 else half for k in q], axis=1)
            at = np.flatnonzero(((move != 0) & (r0 < side) & (r1 > 0) & (c0 < side) & (c1 > 0)).reshape(-1))
            whose, m, rank = owner.repeat(4)[at], move.reshape(-1)[at], rank.repeat(4)[at]
            order = np.lexsort((m, rank, whose))
            r0, r1, c0, c1 = (x.reshape(-1)[at][order] for x in (r0, r1, c0, c1))
            whose, m = whose[order], m[order]
            # the k-th quarter of all tiles at once, tiles with most quarters first
            many = np.bincount(whose, minlength=rows)
            first = np.cumsum(many) - many
            by_many = np.argsort(-many, kind="stable")
            left = np.sort(many)
            for k in range(int(many.max(initial=0))):
                own = by_many[: rows - np.searchsorted(left, k, "right")]
                n = first[own] + k
                tall = (place >= r0[n, None]) & (place < r1[n, None])
                wide = (place >= c0[n, None]) & (place < c1[n, None])
                old = value[own]
                value[own] = np.where(tall[:, :, None] & wide[:, None, :], np.clip(old + m[n, None, None], 0, 255), old)
            held = pa.ListArray.from_arrays(pa.array(np.arange(0, value.size + 1, side * side), pa.int32()), pa.array(value.reshape(-1), pa.int32(), mask=~has))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("image_id", "channel", "tr", "tc")], held], names=["image_id", "channel", "tr", "tc", "value"])

    return run


def replay_tiles(tiles: DataFrame, strokes: DataFrame, book: list[int]) -> DataFrame:
    """replay_strokes of a canvas by tiles of side 2 ** REPLAY, (image_id, channel, tr, tc, value) with the cells as arrays by place.

    A tile and the squares that touch it are one row on each side of one join; cells are moved in numpy, many tiles at once.
    """
    keys = [*KC, "tr", "tc"]
    whole = F.array_sort(F.collect_list(F.struct("stroke_id", "row", "col", "size", "idx")))
    lists = _met(tiles, strokes).groupBy(*keys).agg(whole.alias("some"))
    code = lambda x, k: F.coalesce(F.get(x["idx"], F.lit(k)).cast("int"), F.lit(-1)).alias(f"i{k}")
    squares = F.transform("some", lambda x: F.struct(*[x[c].cast("long").alias(c) for c in ("row", "col", "size")], *[code(x, k) for k in range(4)]))
    both = tiles.select(*keys, "value").join(lists.select(*keys, F.col("some.stroke_id").alias("ids"), squares.alias("some")), keys, "left")
    schema = ", ".join([*[f"{c} {both.schema[c].dataType.simpleString()}" for c in keys], "value array<int>"])
    return both.mapInArrow(_replayer(book), schema)


def replay_strokes(canvas: DataFrame, strokes: DataFrame, book: list[int]) -> DataFrame:
    """The canvas after all strokes in the order of stroke_id; codes outside the book move nothing.

    Each step is held to 0..255, so steps don't add up; a cell depends on its own steps only, which makes the replay
    a fold by cell, and tiles of cells one row each. Cells that no stroke changes stay; cells without a value are left out.
    """
    return tile_cells(replay_tiles(canvas_of(canvas, 1 << REPLAY), strokes, book), "value", 1 << REPLAY)
