"""Rasters at other resolutions: box means, nearest cells, and kernels as tables of whole-number weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import KC, clip, idiv

#: Weights of an output cell sum to this.
ONE = 1 << 16


def downsample_box(cells: DataFrame, h: int, w: int, n_h: int, n_w: int) -> DataFrame:
    """Floored means over the cells that fall into each of n_h x n_w boxes."""
    box = cells.groupBy(*KC, idiv(F.col("row") * n_h, h).cast("int").alias("r"), idiv(F.col("col") * n_w, w).cast("int").alias("c"))
    return box.agg(idiv(F.sum("value"), F.count("value")).cast("int").alias("value")).select(*KC, F.col("r").alias("row"), F.col("c").alias("col"), "value")


def upsample_nearest(cells: DataFrame, n_h: int, n_w: int, h: int, w: int) -> DataFrame:
    """h x w rasters whose cell (r, c) is cell (r * n_h div h, c * n_w div w): each cell explodes into its block, without a join."""

    def axis(c: str, n: int, size: int):
        first, after = (F.floor((F.col(c) + k) * size / n - F.lit(1 / (2 * n))) + 1 for k in (0, 1))  # the least whole numbers from c * size / n and (c + 1) * size / n on
        return F.when(first < after, F.sequence(first, after - 1)).cast("array<int>")

    rows = cells.select(*KC, "col", "value", F.explode(axis("row", n_h, h)).alias("row"))
    return rows.select(*KC, "row", F.explode(axis("col", n_w, w)).alias("c"), "value").select(*KC, "row", F.col("c").alias("col"), "value")


def _kernel(name: str):
    def cubic(x: float) -> float:
        x = abs(x)
        return (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0

    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    return {"bilinear": (lambda x: max(0.0, 1 - abs(x)), 1), "bicubic": (cubic, 2), "lanczos": (lambda x: sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0, 3)}[name]


def weights(size: int, new: int, kernel: str = "bicubic") -> list[tuple[int, int, int]]:
    """(input, output, weight) for one axis; an output's weights sum to ONE, inputs beyond the edge count as the edge.

    The table has at most new * (2 * reach * scale + 2) rows, whatever the number of rasters.
    """
    f, reach = _kernel(kernel)
    scale = max(1.0, size / new)
    out = []
    for o in range(new):
        centre = (o + 0.5) * size / new - 0.5
        taps: dict[int, float] = {}
        for i in range(math.floor(centre - reach * scale), math.ceil(centre + reach * scale) + 1):
            at = min(size - 1, max(0, i))
            taps[at] = taps.get(at, 0.0) + f((i - centre) / scale)
        total = sum(taps.values())
        whole = {i: math.floor(v / total * ONE + 0.5) for i, v in taps.items()}
        whole[max(whole, key=lambda i: (whole[i], -i))] += ONE - sum(whole.values())
        out += [(i, o, v) for i, v in sorted(whole.items()) if v]
    return out


def resample(cells: DataFrame, h: int, w: int, n_h: int, n_w: int, kernel: str = "bicubic") -> DataFrame:
    """n_h x n_w rasters by a separable kernel: columns first, then rows, rounded and held to 0..255 once at the end."""
    spark = cells.sparkSession
    table = lambda size, new: F.broadcast(spark.createDataFrame(weights(size, new, kernel), "i int, o int, weight long"))  # noqa: E731  bounded by the axes, not by the data
    across = cells.join(table(w, n_w), F.col("col") == F.col("i")).groupBy(*KC, "row", F.col("o").alias("c")).agg(F.sum(F.col("value") * F.col("weight")).alias("s"))
    down = across.join(table(h, n_h), F.col("row") == F.col("i")).groupBy(*KC, F.col("o").alias("r"), "c").agg(F.sum(F.col("s") * F.col("weight")).alias("s"))
    return down.select(*KC, F.col("r").alias("row"), F.col("c").alias("col"), clip(idiv(F.greatest(F.lit(0), F.col("s") + (ONE * ONE // 2)), ONE * ONE)).cast("int").alias("value"))
