"""Which strokes choose a region or channels anew, what stays in force, and progress along the strokes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import KC, K


def stroke_schedule(strokes: DataFrame, warmup: int, per_quadrant: int, cycle_start: int, per_cycle: int) -> DataFrame:
    """strokes (image_id, stroke_id, channel) with k, quad_switch, segment, cycle_switch, slot.

    k counts a channel's strokes from 0. From k = warmup div 3 on, every per_quadrant-th of them chooses a region; segment
    numbers these choices and is null before. From stroke cycle_start on, every per_cycle-th stroke of the image chooses
    channels; the choice holds from the next stroke on. slot is the place in the channel selector.
    """
    nth = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("stroke_id")) - 1
    df = strokes.select("image_id", "stroke_id", "channel", nth(K).alias("i")).withColumn("k", nth(KC))  # in this order one shuffle serves both
    first = warmup // 3
    k, i = F.col("k"), F.col("i")
    on = k >= first
    return df.select("image_id", "stroke_id", "channel", "k", (on & ((k - first) % per_quadrant == 0)).alias("quad_switch"), F.when(on, F.floor((k - first) / per_quadrant)).alias("segment"), ((i >= cycle_start) & ((i - cycle_start) % per_cycle == 0)).alias("cycle_switch"), (i % 3).alias("slot"))


def hold_quadrant(schedule: DataFrame, selections: DataFrame) -> DataFrame:
    """schedule with quad: the region of the channel's latest choice at or before each stroke, null before the first.

    selections: (image_id, stroke_id, channel, quad) for the strokes that choose.
    """
    chosen = schedule.join(selections, ["image_id", "stroke_id", "channel"], "left")
    sofar = Window.partitionBy(*KC).orderBy("stroke_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chosen.withColumn("quad", F.last(F.when(F.col("quad_switch"), F.col("quad")), ignorenulls=True).over(sofar))


def progress_curve(log: DataFrame, interval: int) -> DataFrame:
    """(image_id, i, strokes, bits, final): running totals after strokes 0, interval, 2 * interval, ... and after the last."""
    order = Window.partitionBy(*K).orderBy("stroke_id")
    running = log.select("image_id", (F.row_number().over(order) - 1).alias("i"), F.sum("bits").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("bits"), F.lead("stroke_id").over(order).isNull().alias("last"))
    shots = running.where(F.col("i") % interval == 0).select("image_id", "i", (F.col("i") + 1).alias("strokes"), "bits", F.lit(False).alias("final"))
    return shots.unionByName(running.where("last").select("image_id", "i", (F.col("i") + 1).alias("strokes"), "bits", F.lit(True).alias("final")))


def auto_interval(strokes: int, fps: int) -> int:
    return max(1, strokes // (fps * 4))
