"""Pairs of rasters of one shape: differences, start colours, errors by channel and by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import CELL, KC, K, idiv
from .cells import coloured


def residual(target: DataFrame, canvas: DataFrame) -> DataFrame:
    """Cells with target, canvas, diff (target - canvas) and err (its size), by an equi-join on the whole cell.

    canvas may be colours (image_id, channel, colour) instead, for a canvas of target's shape in them: then no cells are paired.
    """
    a = target.withColumnRenamed("value", "target")
    if "colour" in canvas.columns:
        both = coloured(a, canvas).withColumnRenamed("colour", "canvas")
    else:
        both = a.join(canvas.withColumnRenamed("value", "canvas"), CELL)
    return both.select(*CELL, "target", "canvas", (F.col("target") - F.col("canvas")).alias("diff"), F.abs(F.col("target") - F.col("canvas")).alias("err"))


_FIXED = {"Black": ((0, 0, 0), (0, 128, 128)), "White": ((255, 255, 255), (255, 128, 128))}


def start_color(cells: DataFrame, mode: str = "Average", ycbcr: bool = False, custom: tuple[int, int, int] | None = None, seed: int = 0) -> DataFrame:
    """(image_id, channel, colour). Average (also Mean and any unknown mode): the truncated mean. Median, True Median: the truncated median.

    Black, White, Custom: constants. Random: a colour from a hash of seed, image and channel.
    """
    groups = cells.groupBy(*KC)
    if mode in ("Median", "True Median"):
        return groups.agg(F.floor(F.median("value")).cast("int").alias("colour"))
    if mode in _FIXED or mode == "Custom":
        colour = custom if mode == "Custom" else _FIXED[mode][ycbcr]
        return cells.select(*KC).distinct().withColumn("colour", F.element_at(F.array(*[F.lit(c) for c in colour]), F.col("channel") + 1))
    if mode == "Random":
        return cells.select(*KC).distinct().withColumn("colour", F.pmod(F.xxhash64(*KC, F.lit(seed)), F.lit(256)).cast("int"))
    return groups.agg(idiv(F.sum("value"), F.count("value")).cast("int").alias("colour"))


def channel_error(res: DataFrame) -> DataFrame:
    """Sum, maximum, minimum and median of the error of each channel, in one pass."""
    return res.groupBy(*KC).agg(F.sum("err").alias("sum_err"), F.max("err").alias("max_err"), F.min("err").alias("min_err"), F.median("err").alias("median_err"))


def _mse() -> Column:
    return idiv(F.sum(F.col("diff").cast("long") * F.col("diff")), F.count("diff"))


def channel_mse(res: DataFrame) -> DataFrame:
    """(image_id, mse0, mse1, mse2, avg_mse): truncated means of squares; the average is of the truncated values, truncated."""
    mse = res.groupBy(*KC).agg(_mse().alias("mse"))
    wide = mse.groupBy(*K).agg(*[F.max(F.when(F.col("channel") == c, F.col("mse"))).alias(f"mse{c}") for c in range(3)], idiv(F.sum("mse"), F.count("mse")).alias("avg_mse"))
    return wide


def pooled_mse(res: DataFrame) -> DataFrame:
    """(image_id, mse) over all cells of all channels, truncated once."""
    return res.groupBy(*K).agg(_mse().alias("mse"))


def diff_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells in which two tables differ, missing ones included: (cell, left, right)."""
    one, two = a.withColumnRenamed("value", "left"), b.withColumnRenamed("value", "right")
    return one.join(two, CELL, "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def diff_tiles(a: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, cells, off) of two tables of tiles (image_id, channel, tr, tc, value): cells of a, and those that diff_cells would give; tiles are compared as rows."""
    keys = [*KC, "tr", "tc"]
    both = a.select(*keys, F.col("value").alias("left")).join(b.select(*keys, F.col("value").alias("right")), keys, "full_outer")
    there = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0)).cast("long")
    differ = F.size(F.filter(F.zip_with("left", "right", lambda x, y: ~x.eqNullSafe(y)), lambda x: x)).cast("long")
    off = F.when(F.col("left") == F.col("right"), F.lit(0).cast("long")).when(F.col("left").isNull(), there("right")).when(F.col("right").isNull(), there("left")).otherwise(differ)
    return both.groupBy(*K).agg(F.sum(F.when(F.col("left").isNotNull(), there("left")).otherwise(0)).alias("cells"), F.sum(off).alias("off"))
