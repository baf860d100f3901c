"""Regions by alternate halving, their errors at one or all depths, and the worst of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KC, K, quadrant_code, quadrant_text

_CRITERIA = {"Sum": F.sum, "Max": F.max, "Min": F.min}


def quadrant_key(cells: DataFrame, h: int, w: int, depth: int) -> DataFrame:
    """cells with quad, the region's bits, rows first."""
    return cells.withColumn("quad", quadrant_text(quadrant_code(F.col("row"), F.col("col"), h, w, depth), depth))


def quadrant_error(res: DataFrame, h: int, w: int, depth: int, criterion: str = "Sum") -> DataFrame:
    """(image_id, channel, code, err): Sum, Max or Min of the error in each region that has cells; an unknown criterion is Sum."""
    code = quadrant_code(F.col("row"), F.col("col"), h, w, depth)
    return res.groupBy(*KC, code.alias("code")).agg(_CRITERIA.get(criterion, F.sum)("err").cast("long").alias("err"))


def quadrant_pyramid(res: DataFrame, h: int, w: int, most: int, criterion: str = "Sum") -> DataFrame:
    """(image_id, channel, depth, quad, err) for all depths up to `most`: cells are read once, the finest regions add up to the rest."""
    finest = quadrant_error(res, h, w, most, criterion)
    up = finest.select(*KC, "err", quadrant_text(F.col("code"), most).alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("depth"))
    return up.select(*KC, "depth", F.expr("substring(bits, 1, depth)").alias("quad"), "err").groupBy(*KC, "depth", "quad").agg(_CRITERIA.get(criterion, F.sum)("err").alias("err"))


def top_k_quadrants(errors: DataFrame, k: int) -> DataFrame:
    """The k worst regions of each image and channel, the lower code first on ties."""
    order = Window.partitionBy(*KC).orderBy(F.desc("err"), "code")
    return errors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def worst_quadrant(errors: DataFrame) -> DataFrame:
    """(image_id, channel, code, err) of the worst region, the lower code on ties; partial maxima are shuffled, not regions."""
    return errors.groupBy(*KC).agg(F.max_by("code", F.struct("err", -F.col("code"))).alias("code"), F.max("err").alias("err"))


def rank_channels(errors: DataFrame, by: str = "sum_err") -> DataFrame:
    """errors with place: 1 for the channel with the largest error, the lower channel first on ties."""
    return errors.withColumn("place", F.row_number().over(Window.partitionBy(*K).orderBy(F.desc(by), "channel")))


def channel_selector(errors: DataFrame, strategy: str = "Smart", by: str = "sum_err") -> DataFrame:
    """(image_id, selector): the three channels that strokes take in turn.

    Strict: the worst, thrice. Balanced: the worst twice, then the second. Smart: Strict where the worst exceeds twice
    the second, Balanced where the second exceeds twice the third, else 0, 1, 2. Anything else: 0, 1, 2.
    """
    ranked = rank_channels(errors, by)
    at = lambda c, p: F.max(F.when(F.col("place") == p, F.col(c)))
    wide = ranked.groupBy(*K).agg(*[at("channel", p).alias(f"c{p}") for p in (1, 2, 3)], *[at(by, p).alias(f"e{p}") for p in (1, 2, 3)])
    default = F.array(F.lit(0), F.lit(1), F.lit(2))
    strict, balanced = F.array("c1", "c1", "c1"), F.array("c1", "c1", "c2")
    chosen = {"Strict": strict, "Balanced": balanced, "Smart": F.when(F.col("e1") > 2 * F.col("e2"), strict).when(F.col("e2") > 2 * F.col("e3"), balanced).otherwise(default)}
    return wide.select("image_id", chosen.get(strategy, default).alias("selector"))
