"""Exhaustive search for squares: every place, size and code, and from them a maximal set that shares no cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import CELL, KC
from ..sources.storage import Steps


#: Side of the blocks that cells are searched in, and of the tiles that these are packed in.
SIDE, TILE = 64, 8
#: Side of the blocks that disjoint squares are chosen in.
PICK = 256
#: Cells that numpy handles at once, or one block; those that squares are chosen in at once, as they are gone over many times.
CELLS, FEW = 1 << 19, 1 << 15


def _side(sizes: list[int]) -> int:
    return max(SIDE, -(-2 * max(sizes) // TILE) * TILE)


def _chooser(sizes: list[int]):
    """A function that chooses among squares of these sizes, ascending, in many blocks; it goes to tasks as a whole.

    Of (gain, may, known) it makes (taken, open): the best of all that they meet are taken, and again without those that these meet. gain, taken, open: by size,
    block, row and column; a gain of 0 is no square. may: where squares are seen with all that they meet; others are not taken. known: squares taken before.
    A square beats all that it meets if it is the best over each of its cells, so that two maxima over squares of cells do. These go over all blocks
    as one line: below and beside the places lie as many empty ones as the largest square reaches over.
    """

    def choose(gain, may=None, known=None):
        import numpy as np

        n, blocks, h, w = gain.shape
        high, wide, places = h + sizes[-1] - 1, w + sizes[-1] - 1, n * h * w
        taken, left = np.zeros(gain.shape, bool), np.zeros(gain.shape, bool)
        tie = places - 1 - np.arange(places).reshape(h, w, n).transpose(2, 0, 1)[:, None]

        def most(line, many, ahead):
            """The greatest of each place and the many - 1 before or after it, along columns and rows."""
            for stride in (1, wide):
                width = 1
                while width < many:
                    step = min(width, many - width)
                    to, by = line.copy(), step * stride
                    if ahead:
                        np.maximum(line[:-by], line[by:], out=to[:-by])
                    else:
                        np.maximum(line[by:], line[:-by], out=to[by:])
                    line, width = to, width + step
            return line

        def over_cells(squares):
            line = np.zeros_like(squares[0])
            for z in reversed(range(n)):
                line = most(np.maximum(line, squares[z]), sizes[z] - (sizes[z - 1] if z else 1) + 1, False)
            return line

        def over_squares(line):
            for z in range(n):
                line = most(line, sizes[z] - (sizes[z - 1] if z else 1) + 1, True)
                yield z, line

        step = max(1, FEW // (high * wide))
        for k in range(0, blocks, step):
            own = gain[:, k : k + step]
            rank, rows = own, own.shape[1]
            if own.max(initial=0) >= (1 << 62) // places:
                rank = np.unique(own, return_inverse=True)[1].reshape(own.shape) + 1

            def line(x, kind):
                out = np.zeros((n, rows, high, wide), kind)
                out[:, :, :h, :w] = x
                return out.reshape(n, -1)

            key, made = line(np.where(own > 0, rank * places + tie, 0), np.int64), np.zeros((n, rows * high * wide), bool)
            free = None if may is None else line(may[:, k : k + step], bool)
            new = None if known is None else line(known[:, k : k + step], bool)
            while True:
                if new is not None:
                    for z, hit in over_squares(over_cells(new)):
                        key[z][hit] = 0
                new = np.zeros_like(made)
                for z, first in over_squares(over_cells(key)):
                    new[z] = (first == key[z]) & (first > 0)
                if free is not None:
                    new &= free
                if not new.any():
                    break
                made |= new
            short = lambda x: x.reshape(n, rows, high, wide)[:, :, :h, :w]  # noqa: E731, B023
            taken[:, k : k + step], left[:, k : k + step] = short(made), short(key > 0)
        return taken, left

    return choose


def _searcher(sizes: list[int], book: list[int], side: int, best: bool, raster: tuple[int, int] | None):
    """Gains of all squares that start in many blocks, as a function from Arrow batches (image_id, channel, br, bc, tiles) to Arrow batches."""
    choose = _chooser(sizes)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        moves = np.array(book, np.int64)
        number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)

        def search(batch):
            rows = batch.num_rows
            owner, tiles = number(pc.list_parent_indices(batch.column("tiles"))), batch.column("tiles").flatten()
            origin = [number(batch.column(x)) * (side // TILE) for x in ("br", "bc")]
            tr, tc = number(tiles.field("tr")) - origin[0][owner], number(tiles.field("tc")) - origin[1][owner]
            high, wide = int(tr.max()) + 1, int(tc.max()) + 1
            step = max(1, CELLS // (high * wide * TILE * TILE))
            if rows > step:
                for k in range(0, rows, step):
                    yield from search(batch.slice(k, step))
                return
            diff, has = np.zeros((2, rows, high, TILE, wide, TILE), np.int64)
            flat = tiles.field("diff").flatten()
            place = (owner, tr, slice(None), tc)
            diff[place] = number(pc.fill_null(flat, 0)).reshape(-1, TILE, TILE)
            has[place] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, TILE, TILE)
            area = [np.pad(x.reshape(rows, high * TILE, wide * TILE), ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2) for x in (diff, has)]

            def found(k, r, c, size, *more):
                key = [batch.column(x).take(pa.array(k)) for x in KC]
                where = [pa.array(x + o[k] * TILE, pa.int32()) for x, o in ((r, origin[0]), (c, origin[1]))]
                return pa.RecordBatch.from_arrays([*key, *where, pa.array(np.full(len(k), size), pa.int32()), *map(pa.array, more)], names=[*CELL, "size", "gain", "taken"][: 5 + len(more)])

            if raster:
                h, w = min(side, high * TILE), min(side, wide * TILE)
                gains = np.zeros((len(sizes), rows, h, w), np.int64)
            for z, size in enumerate(sizes):
                half = size // 2
                if size > min(high, wide) * TILE:
                    continue
                s, n = (a[:, half:, half:] - a[:, :-half, half:] - a[:, half:, :-half] + a[:, :-half, :-half] for a in area)
                g = np.full(s.shape, -(1 << 60))
                for m in moves:
                    np.maximum(g, 2 * m * s - n * m * m, out=g)
                four = lambda x: x[:, :-half, :-half] + x[:, half:, :-half] + x[:, :-half, half:] + x[:, half:, half:]
                gain, ok = four(g)[:, :side, :side], four(n)[:, :side, :side] == size * size
                if raster:
                    gains[z, :, : gain.shape[1], : gain.shape[2]] = np.where(ok, np.maximum(gain, 0), 0)
                    continue
                if best:
                    held = np.where(ok, gain, -(1 << 62)).reshape(rows, -1)
                    k = np.flatnonzero(ok.reshape(rows, -1).any(axis=1))
                    at = held[k].argmax(axis=1)  # the first of a block's rows on ties
                    r, c, gain = at // gain.shape[2], at % gain.shape[2], held[k, at]
                else:
                    k, r, c = np.nonzero(ok)
                    gain = gain[k, r, c]
                yield found(k, r, c, size, gain)
            if raster:
                inside, free = [], []
                for o, many, end in zip(origin, (h, w), raster):
                    first, at = o[:, None] * TILE, np.arange(many)
                    inside.append((first + at >= 0) & (first + at < end))
                    # seen with all that start before and after it and meet it
                    before = (at >= sizes[-1] - 1) | (first <= 0)
                    free.append(np.stack([before & ((at + size <= side) | (first + side >= end)) for size in sizes]))
                gains *= inside[0][:, :, None] & inside[1][:, None, :]
                taken, left = choose(gains, free[0][:, :, :, None] & free[1][:, :, None, :])
                z, k, r, c = np.nonzero(taken | left)
                yield found(k, r, c, np.array(sizes)[z], gains[z, k, r, c], taken[z, k, r, c])

        for batch in batches:
            if batch.num_rows:
                yield from search(batch)

    return run


def square_gains(res: DataFrame, sizes: list[int], book: list[int], best: bool = False, raster: tuple[int, int] | None = None) -> DataFrame:
    """(image_id, channel, row, col, size, gain) for the square of each even size at each place where all its cells are.

    gain: by how much the squared error falls when each quarter takes its best code, clipping left aside. best: only the greatest of each
    block and size, the upper left one on ties, which is all that best_squares needs. raster: (h, w) of the rasters; only squares that start there and gain,
    without those that a block finds to meet a square of the disjoint set, and with taken: true for those of the set, false where another block's
    squares decide; this is all that disjoint_squares needs. Cells are packed in tiles and those in blocks, with the
    tiles beyond that squares reach to: sums of quarters are taken in numpy over many blocks at once, and one large raster spans many tasks. Cells in
    partitions by image are not shuffled. Each cell is there once.
    """
    if any(s < 2 or s % 2 for s in sizes):
        raise ValueError("sizes are even")
    side = _side(sizes)
    per, reach = side // TILE, -(-(max(sizes) - 1) // TILE)
    # tiles below a raster's first one: negative rows and columns have blocks of their own
    down = lambda c: F.floor(F.col(c) / TILE).cast("long")
    by = [*KC, "tr", "tc"]
    at = (F.pmod(F.col("row"), F.lit(TILE)) * TILE + F.pmod(F.col("col"), F.lit(TILE))).cast("int")
    wide = res.select(*KC, down("row").alias("tr"), down("col").alias("tc"), at.alias("__at"), "diff").groupBy(*by).agg(*[F.max(F.when(F.col("__at") == k, F.col("diff"))).alias(f"d{k}") for k in range(TILE * TILE)])
    tiles = wide.select(*by, F.array(*[f"d{k}" for k in range(TILE * TILE)]).alias("diff"))
    own = lambda c: F.floor(F.col(c) / per).cast("long")
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / per).cast("long"), own(c)))
    dealt = tiles.select("*", span("tr").alias("br")).select("*", span("tc").alias("bc"))
    blocks = dealt.groupBy(*KC, "br", "bc").agg(F.collect_list(F.struct("tr", "tc", "diff")).alias("tiles"), F.bool_or((own("tr") == F.col("br")) & (own("tc") == F.col("bc"))).alias("mine")).where("mine").drop("mine")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in res.select(*KC).schema)
    return blocks.mapInArrow(_searcher(sorted({*sizes}), book, side, best, raster), f"{kinds}, row int, col int, size int, gain long{', taken boolean' if raster else ''}")


def best_squares(gains: DataFrame) -> DataFrame:
    """The square with the greatest gain for each image, channel and size; the upper left one on ties. gains: all squares, or the best of each block."""
    order = F.struct("gain", -F.col("row"), -F.col("col"))
    return gains.groupBy(*KC, "size").agg(F.max_by(F.struct("row", "col", "gain"), order).alias("b")).select(*KC, "size", "b.*")


def _picker(sizes: list[int], side: list[int], over: list[int]):
    """Squares taken or left in many blocks, as a function from Arrow batches (image_id, channel, br, bc, squares) to Arrow batches.

    side: a block's rows and columns; over: by how much squares of others come with it on each side.
    """
    high, wide = (s + 2 * o for s, o in zip(side, over))
    choose = _chooser(sizes)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
        step = max(1, CELLS // (high * wide * len(sizes)))
        may = np.zeros((len(sizes), 1, high, wide), bool)
        may[:, :, over[0] : over[0] + side[0], over[1] : over[1] + side[1]] = True
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            owner, squares = number(pc.list_parent_indices(batch.column("squares"))), batch.column("squares").flatten()
            origin = [number(batch.column(b)) * s - o for b, s, o in zip(("br", "bc"), side, over)]
            place = (np.searchsorted(sizes, number(squares.field("size"))), owner, number(squares.field("row")) - origin[0][owner], number(squares.field("col")) - origin[1][owner])
            before = number(squares.field("taken")) > 0
            gain = np.zeros((len(sizes), batch.num_rows, high, wide), np.int64)
            known = np.zeros(gain.shape, bool)
            known[tuple(x[before] for x in place)] = True
            np.maximum.at(gain, tuple(x[~before] for x in place), number(squares.field("gain"))[~before])
            taken, left = choose(gain, np.broadcast_to(may, gain.shape), known)
            z, k, r, c = np.nonzero((taken | left) & may)
            key = [batch.column(x).take(pa.array(k)) for x in KC]
            where = [pa.array(x + o[k], pa.int32()) for x, o in ((r, origin[0]), (c, origin[1]))]
            yield pa.RecordBatch.from_arrays([*key, *where, pa.array(np.array(sizes)[z], pa.int32()), pa.array(gain[z, k, r, c]), pa.array(taken[z, k, r, c])], names=[*CELL, "size", "gain", "taken"])

    return run


def _picked(squares: DataFrame, sizes: list[int], h: int, w: int) -> DataFrame:
    """squares (with taken) that their blocks take or leave undecided, without those taken before. A block sees all squares that meet its own."""
    most = max(PICK, 4 * sizes[-1])
    side, over = [min(most, n) for n in (h, w)], [sizes[-1] - 1 if n > most else 0 for n in (h, w)]

    def near(c: str, n: int, side: int, over: int):
        to = lambda at: F.floor(at / side).cast("int")
        return F.explode(F.sequence(to(F.greatest(F.lit(0), F.col(c) - over)), to(F.least(F.lit(n - 1), F.col(c) + over))))

    dealt = squares.select("*", near("row", h, side[0], over[0]).alias("br")).select("*", near("col", w, side[1], over[1]).alias("bc"))
    blocks = dealt.groupBy(*KC, "br", "bc").agg(F.collect_list(F.struct("row", "col", "size", "gain", "taken")).alias("squares"), F.bool_or(~F.col("taken")).alias("some")).where("some").drop("some")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in squares.select(*KC).schema)
    return blocks.mapInArrow(_picker(sizes, side, over), f"{kinds}, row int, col int, size int, gain long, taken boolean")


def disjoint_squares(gains: DataFrame, sizes: list[int], h: int, w: int) -> DataFrame:
    """(image_id, channel, row, col, size, gain) of squares that share no cell, to which none of a positive gain can be added.

    This is the set that taking the best square left, one by one, gives; ties by row, column and size. gains: all squares, or those that square_gains leaves
    for rasters of h x w. Squares are chosen by blocks in numpy: one that gains more than all squares left that it meets is taken, and those go, until no
    more can be. A raster within one block is done with that, in one pass. Of larger ones, squares that hang on other blocks' go on to
    a next round, with what was taken: each block sees the squares around it that meet its own. Squares are never paired. A round writes what it
    takes and what is open to the shared folder, and what was open before goes.
    """
    sizes, names = sorted({*sizes}), [*CELL, "size", "gain"]
    marked = "taken" in gains.columns
    if marked and max(h, w) <= _side(sizes):
        return gains.where("taken").select(*names)
    place = F.col("row").between(0, h - 1) & F.col("col").between(0, w - 1)
    left = gains.where(place & (F.col("gain") > 0) & F.col("size").isin(sizes)).select(*names, (F.col("taken") if marked else F.lit(False)).alias("taken"))
    if not marked and max(h, w) <= max(PICK, 4 * sizes[-1]):
        return _picked(left, sizes, h, w).select(*names)
    steps, done = Steps(gains.sparkSession), []
    if marked:
        left = steps.put(left)
        done.append(steps.put(left.where("taken").select(*names)))
    while True:
        made = steps.put(_picked(left, sizes, h, w))
        if done:
            steps.remove(left)
        done.append(steps.put(made.where("taken").select(*names)))
        left = made
        if left.where("NOT taken").isEmpty():
            steps.remove(left)
            return reduce(DataFrame.unionByName, done)
