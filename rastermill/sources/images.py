"""Folders of image files as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, origin, height, width, channel, row, col, value) for each image below path; files that are no images are left out.

    Channels are red, green, blue; the image reader's bytes are blue, green, red (and alpha, which is left out), row by row.
    Grey images give one channel. image_id is a hash of the file's place.
    """
    df = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    n, w = F.col("nChannels"), F.col("width")
    lines = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda r: F.substring(F.col("data"), r * w * n + 1, w * n))
    some = df.where("height > 0 AND width > 0").select(F.xxhash64("origin").alias("image_id"), "origin", "height", "width", n, F.posexplode(lines).alias("row", "line"))  # a row of the image is a row here
    spread = some.select("image_id", "origin", "height", "width", n, "row", "line", F.explode(F.sequence(F.lit(0), w * n - 1)).alias("pos"))
    byte = F.conv(F.hex(F.expr("substring(line, pos + 1, 1)")), 16, 10).cast("int")
    plane = F.col("pos") % n
    out = spread.where(plane < 3).select("image_id", "origin", "height", "width", F.when(n == 1, 0).otherwise(2 - plane).cast("int").alias("channel"), "row", F.floor(F.col("pos") / n).cast("int").alias("col"), byte.alias("value"))
    return out
