"""Arrays to cells and back, and complete grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import CELL, KC, K, idiv


def explode_cells(df: DataFrame, array_col: str, h: int, w: int, channels: int, layout: str = "hwc") -> DataFrame:
    """A row for each entry of each row's array: image_id, channel, row, col, value. Entries beyond h * w * channels are left out."""
    out = df.select("image_id", F.posexplode(array_col).alias("pos", "value")).where(F.col("pos") < h * w * channels)
    pos = F.col("pos")
    if layout == "hwc":
        channel, row, col = pos % channels, idiv(pos, w * channels), idiv(pos, channels) % w
    elif layout == "chw":
        channel, row, col = idiv(pos, h * w), idiv(pos, w) % h, pos % w
    else:
        raise ValueError(f"layout {layout!r}")
    return out.select("image_id", channel.cast("int").alias("channel"), row.cast("int").alias("row"), col.cast("int").alias("col"), "value")


def assemble_cells(cells: DataFrame) -> DataFrame:
    """(image_id, values): each image's values, rows first, channels last. A raster must fit in a row."""
    entry = F.struct("row", "col", "channel", "value")
    return cells.groupBy(*K).agg(F.array_sort(F.collect_list(entry)).alias("v")).select("image_id", F.transform("v", lambda x: x["value"]).alias("values"))


def grid(images: DataFrame, h: int, w: int, channels: int = 3) -> DataFrame:
    """All cells of each image; the axes are sequences of known length, so no row meets another."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return images.select("image_id", axis(channels).alias("channel")).select("*", axis(h).alias("row")).select("*", axis(w).alias("col"))


def densify(sparse: DataFrame, h: int, w: int, fill: Column | None = None, channels: int = 3) -> DataFrame:
    """Complete rasters: cells that are missing get `fill` (0)."""
    full = grid(sparse.select("image_id").distinct(), h, w, channels)
    return full.join(sparse, CELL, "left").select(*CELL, F.coalesce("value", fill if fill is not None else F.lit(0)).cast("int").alias("value"))


def coloured(cells: DataFrame, colours: DataFrame) -> DataFrame:
    """cells of images and channels that colours (image_id, channel, colour; each once) has, with colour.

    An image's colours are one row, so that cells in partitions by image meet them without a shuffle; cells are not sorted.
    """
    own = colours.where("channel IS NOT NULL").groupBy(*K).agg(F.map_from_entries(F.collect_list(F.struct(F.col("channel").cast("int").alias("channel"), F.struct(F.col("colour").cast("int").alias("c")).alias("c")))).alias("__own"))
    met = cells.join(own.hint("shuffle_hash"), K).withColumn("__c", F.try_element_at("__own", F.col("channel").cast("int")))
    return met.where("__c IS NOT NULL").withColumn("colour", F.col("__c.c")).drop("__own", "__c")


def fill_canvas(cells: DataFrame, colours: DataFrame) -> DataFrame:
    """A canvas of cells' shape in one colour for each image and channel: colours has (image_id, channel, colour)."""
    return coloured(cells.select(*CELL), colours).select(*CELL, F.col("colour").alias("value"))
