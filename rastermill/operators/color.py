"""Colour conversion in whole numbers: coefficients times a million, held to the range, then truncated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M = 1_000_000


def _wide(cells: DataFrame) -> DataFrame:
    picked = [F.max(F.when(F.col("channel") == c, F.col("value"))).cast("long").alias(f"c{c}") for c in range(3)]
    return cells.groupBy("image_id", "row", "col").agg(*picked)


def _long(wide: DataFrame, planes: list[Column]) -> DataFrame:
    held = [F.floor(F.greatest(F.lit(0), F.least(F.lit(255 * _M), p)) / _M).cast("int") for p in planes]
    out = wide.select("image_id", "row", "col", F.posexplode(F.array(*held)).alias("channel", "value"))
    return out.select("image_id", "channel", "row", "col", "value")


def rgb_to_ycbcr(cells: DataFrame) -> DataFrame:
    """Cells of red, green, blue to luma and two colour differences around 128."""
    r, g, b = F.col("c0"), F.col("c1"), F.col("c2")
    return _long(_wide(cells), [299000 * r + 587000 * g + 114000 * b, -168736 * r - 331264 * g + 500000 * b + 128 * _M, 500000 * r - 418688 * g - 81312 * b + 128 * _M])


def ycbcr_to_rgb(cells: DataFrame) -> DataFrame:
    """The inverse, held to 0..255 before it is truncated."""
    y, cb, cr = F.col("c0") * _M, F.col("c1") - 128, F.col("c2") - 128
    return _long(_wide(cells), [y + 1402000 * cr, y - 344136 * cb - 714136 * cr, y + 1772000 * cb])
