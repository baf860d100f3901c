"""Rate and distortion of runs: image_id, codec, quality, bits, mse (and rate, efficiency once added)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.expr import CELL, KC, idiv


def efficiency(runs: DataFrame, original_bits: Column) -> DataFrame:
    """runs with rate (original bits by bits) and efficiency (rate by mse; infinite without error)."""
    rate = original_bits / F.col("bits")
    return runs.withColumn("rate", rate).withColumn("efficiency", F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(F.col("rate") / F.col("mse")))


def uniform_quantise(cells: DataFrame, step: int) -> DataFrame:
    """(image_id, bits, mse): values by the middle of their step, at the bits that the number of steps needs."""
    near = F.least(F.lit(255), idiv(F.col("value"), step) * step + step // 2)
    levels = 255 // step + 1
    e = F.col("e").cast("long")
    return cells.select(*CELL, (F.col("value") - near).alias("e")).groupBy("image_id").agg(F.sum(F.lit((levels - 1).bit_length())).alias("bits"), idiv(F.sum(e * e), F.count("e")).alias("mse"))


def value_histogram(cells: DataFrame) -> DataFrame:
    """(image_id, value, n, below, first, second): cells of each value, and running counts, sums and sums of squares up to and with it.

    At most 256 rows an image, added up before the shuffle. With the running moments any range of values has its error about any
    point from two rows, so that no quality reads a cell again.
    """
    counted = cells.groupBy("image_id", F.col("value").cast("int").alias("value")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("image_id").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value").cast("long")
    return counted.select("image_id", "value", "n", F.sum("n").over(up).alias("below"), F.sum(F.col("n") * v).over(up).alias("first"), F.sum(F.col("n") * v * v).over(up).alias("second"))


def few_rows(configs: DataFrame, most: int = 1000) -> list[Row]:
    """The rows of a table of configurations, which are to be written into a plan; more than `most` are an error."""
    rows = configs.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} configurations")
    return rows


def uniform_runs(histogram: DataFrame, configs: DataFrame) -> DataFrame:
    """(image_id, codec, quality, bits, mse) of uniform quantisation for each row (quality, step) of configs, from value_histogram.

    A step's bin has the difference of the running moments of its last value and of the one before the bin: both are looked up in an
    image's own 256-place arrays. Images meet the configurations, not their cells.
    """
    held = histogram.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("value", "below", "first", "second"))).alias("h"))
    pick = lambda f: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(F.aggregate("h", F.lit(None).cast("long"), lambda a, x: F.when(x["value"] <= v, x[f]).otherwise(a)), F.lit(0).cast("long")))
    dense = held.select("image_id", *[F.when(F.size("h") == 256, F.col(f"h.{f}")).otherwise(pick(f)).alias(f) for f in ("below", "first", "second")])
    points = F.inline(F.array(*[F.struct(F.lit(r["quality"]).alias("quality"), F.lit(r["step"]).alias("step")) for r in few_rows(configs.select("quality", F.col("step").cast("int").alias("step")))]))
    each = dense.select("*", points)
    step = F.col("step")
    bins = F.sequence(F.lit(0), idiv(F.lit(255), step).cast("int"))

    def error(acc: Column, b: Column) -> Column:
        lo, hi = b * step, F.least(F.lit(255), b * step + step - 1)
        near = F.least(F.lit(255), b * step + idiv(step, 2)).cast("long")
        of = lambda f: F.element_at(f, (hi + 1).cast("int")) - F.when(lo > 0, F.element_at(f, F.greatest(lo, F.lit(1)).cast("int"))).otherwise(0)
        return acc + of("second") - 2 * near * of("first") + near * near * of("below")

    total = F.aggregate(bins, F.lit(0).cast("long"), error)
    cells = F.element_at("below", 256)
    width = F.length(F.bin(idiv(F.lit(255), step)))
    return each.select("image_id", F.lit("uniform").alias("codec"), "quality", (cells * width).alias("bits"), idiv(total, cells).alias("mse"))


def tile_runs(cells: DataFrame, sides: list[int], width: int = 8) -> DataFrame:
    """(image_id, codec, quality, bits, mse) of each tile's truncated mean at `width` bits, for tiles of each side; quality is the side.

    Count, sum and sum of squares of the finest tiles add up to those of all sides that they nest in: cells are read once for sides that
    are multiples of one of them.
    """
    finest = math.gcd(*sides)
    v = F.col("value").cast("long")
    at = lambda c: idiv(F.col(c), finest).cast("int").alias(c)
    small = cells.groupBy(*KC, at("row"), at("col")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    up = small.select("*", F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"))
    over = lambda c: idiv(F.col(c) * finest, F.col("side")).alias(c)
    tiles = up.groupBy(*KC, "side", over("row"), over("col")).agg(*[F.sum(c).alias(c) for c in "nsq"])
    mean = idiv(F.col("s"), F.col("n"))
    sse = F.col("q") - 2 * mean * F.col("s") + F.col("n") * mean * mean
    return tiles.groupBy("image_id", F.col("side").alias("quality")).agg((F.count("*") * width).alias("bits"), idiv(F.sum(sse), F.sum("n")).alias("mse")).select("image_id", F.lit("tile").alias("codec"), "quality", "bits", "mse")


def _sides(runs: DataFrame, a: Column, b: Column) -> DataFrame:
    pick = lambda where, p: runs.where(where).select("image_id", *[F.col(c).alias(f"{p}_{c}") for c in ("quality", "bits", "mse", "rate", "efficiency")])
    return pick(a, "a").join(pick(b, "b"), "image_id")


def paired_comparison(runs: DataFrame, a: Column, b: Column) -> DataFrame:
    """Runs that meet a beside runs of the same image that meet b, with winner: `a` only if strictly more efficient."""
    return _sides(runs, a, b).withColumn("winner", F.when(F.col("a_efficiency") > F.col("b_efficiency"), "a").otherwise("b"))


def matched_rate(runs: DataFrame, a: Column, b: Column) -> DataFrame:
    """For each run that meets a, the run of the same image that meets b with the closest rate; the lower rate, then the lower quality, on ties.

    An as-of join in both directions: both kinds of runs of an image are put in the order of their rates, once up and once down, and each a
    looks at the last b before it. Runs are never paired; one exchange serves both orders.
    """
    kind = lambda where, is_a: runs.where(where).select("image_id", "rate", F.lit(is_a).alias("is_a"), "quality", "mse")
    both = kind(a, True).unionByName(kind(b, False))
    mine = F.when(~F.col("is_a"), F.struct("rate", (-F.col("quality")).alias("low"), "mse"))
    up = Window.partitionBy("image_id").orderBy("rate", "is_a").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("image_id").orderBy(F.desc("rate"), "is_a").rowsBetween(Window.unboundedPreceding, 0)
    after = F.when(~F.col("is_a"), F.struct((-F.col("rate")).alias("less"), (-F.col("quality")).alias("low"), "mse"))
    seen = both.withColumns({"before": F.max(mine).over(up)}).withColumn("after", F.max(after).over(down)).where("is_a AND (before IS NOT NULL OR after IS NOT NULL)")
    left = F.col("after").isNull() | (F.col("rate") - F.col("before.rate") <= -F.col("after.less") - F.col("rate"))
    near = F.when(F.col("before").isNotNull() & left, F.struct((-F.col("before.low")).alias("b_quality"), F.col("before.rate").alias("b_rate"), F.col("before.mse").alias("b_mse"))).otherwise(F.struct((-F.col("after.low")).alias("b_quality"), (-F.col("after.less")).alias("b_rate"), F.col("after.mse").alias("b_mse")))
    return seen.select("image_id", F.col("quality").alias("a_quality"), F.col("rate").alias("a_rate"), F.col("mse").alias("a_mse"), near.alias("near")).select("image_id", "a_quality", "a_rate", "a_mse", "near.*")


def lossless_carry(runs: DataFrame) -> DataFrame:
    """runs with shown: the efficiency, but for points without error the best of the sweep's earlier points, null if there are none."""
    before = Window.partitionBy("image_id", "codec").orderBy("quality").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(F.col("mse") > 0, F.col("efficiency"))).over(before)
    return runs.withColumn("shown", F.when(F.col("mse") == 0, best).otherwise(F.col("efficiency")))


def quality_sweep(runs: DataFrame, codec: str, against: Column) -> DataFrame:
    """The sweep of one codec at qualities 1, 10, ..., 100 beside the constant line of the run that meets `against`."""
    points = lossless_carry(runs.where((F.col("codec") == codec) & F.col("quality").isin(*range(1, 101, 9))))
    line = runs.where(against).groupBy("image_id").agg(F.max("efficiency").alias("line"))
    return points.join(line, "image_id").select("image_id", "quality", "bits", "mse", "shown", "line")


def win_rate(compared: DataFrame, size_class: Column) -> DataFrame:
    """(size_class, runs, wins): how often a beats b in each class."""
    return compared.groupBy(size_class.alias("size_class")).agg(F.count("*").alias("runs"), F.sum((F.col("winner") == "a").cast("long")).alias("wins"))
