"""Streams of strokes: count windows, event-time windows with a watermark, and replay with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.expr import CELL
from ..sources.storage import shared_dir


def stream_progress(strokes: DataFrame, interval: int) -> DataFrame:
    """(image_id, part, strokes, bits): sums over each `interval` of stroke numbers; the same on a batch and on a stream."""
    part = F.floor(F.col("stroke_id") / interval)
    return strokes.groupBy("image_id", part.alias("part")).agg(F.count("*").alias("strokes"), F.sum("bits").alias("bits"))


def stream_rate(strokes: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, strokes, bits) for each window of event time; rows later than the watermark are dropped."""
    return strokes.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("strokes"), F.sum("bits").alias("bits")).select(F.col("w.start").alias("start"), "strokes", "bits")


_OUT = "image_id long, channel int, row int, col int, stroke_id long, value int, late boolean"
_STATE = T.StructType([T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("last", T.LongType())])
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Replay(StatefulProcessor):
    """The canvas of one block of cells: its values and the last stroke applied to it, which are written back once a batch."""

    def __init__(self, side: int, book: list[int]) -> None:
        self.side, self.book = side, book

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("canvas", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        image, channel, tr, tc = key
        side = self.side
        cells, last = self.held.get() if self.held.exists() else ([0] * (side * side), -1)
        canvas, touched, late = np.array(cells, np.int32).reshape(side, side), np.full((side, side), -1, np.int64), []
        strokes = pd.concat(list(rows)).sort_values("stroke_id")
        for n, row, col, size, idx in zip(*[strokes[c] for c in ("stroke_id", "row", "col", "size", "idx")]):
            if n <= last:
                late.append((image, channel, row, col, n, None, True))
                continue
            last = n
            r, c = row - tr * side, col - tc * side
            box = np.s_[max(r, 0) : max(r + size, 0), max(c, 0) : max(c + size, 0)]
            canvas[box] = np.clip(canvas[box] + self.book[idx], 0, 255)
            touched[box] = n
        self.held.update((canvas.ravel().tolist(), int(last)))
        at = np.argwhere(touched >= 0)
        moved = [(image, channel, tr * side + r, tc * side + c, touched[r, c], int(canvas[r, c]), False) for r, c in at.tolist()]
        yield pd.DataFrame(moved + late, columns=["image_id", "channel", "row", "col", "stroke_id", "value", "late"]).astype({"value": "Int32"})

    def close(self) -> None:
        pass


def stream_replay(strokes: DataFrame, book: list[int], side: int = 16) -> DataFrame:
    """Changes of cells as strokes (image_id, stroke_id, channel, row, col, size, idx) stream in; the canvas starts black.

    (image_id, channel, row, col, stroke_id, value, late): a row for each cell that a batch changed, with its value after the batch and the
    last stroke that moved it; and for each stroke that came too late a row with its own row and col, and no value.
    State is a block of side x side cells and the last stroke applied to it, held by RocksDB. Steps are held to 0..255 and so must keep
    their order: within a batch strokes are sorted, and one that is not newer than its block's last is late there, not applied.
    """
    span = lambda at: F.explode(F.sequence(F.floor(F.col(at) / side).cast("int"), F.floor((F.col(at) + F.col("size") - 1) / side).cast("int")))
    placed = strokes.select("image_id", "stroke_id", "channel", "row", "col", "size", "idx", span("row").alias("tr")).select("*", span("col").alias("tc"))
    return placed.groupBy("image_id", "channel", "tr", "tc").transformWithStateInPandas(_Replay(side, book), _OUT, "Append", "None")


def replay_to_tables(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes, late) of stream_replay once it has caught up with its source: two tables, written apart as `late` parts them."""
    spark: SparkSession = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKSDB)
    try:
        out = run_to_table(stream, "append", ["late"])
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return out.where("NOT late").drop("late"), out.where("late").drop("late", "value").distinct()


def last_canvas(changes: DataFrame) -> DataFrame:
    """(cell, value) after all changes; cells that no stroke moved are not there."""
    return changes.groupBy(*CELL).agg(F.max_by("value", "stroke_id").alias("value"))


def run_to_table(stream: DataFrame, mode: str, parts: list[str] | None = None) -> DataFrame:
    """All of a stream's result once it has caught up with its source: written to the shared folder by the executors, and read."""
    spark: SparkSession = stream.sparkSession
    home = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").partitionBy(*(parts or [])).parquet(f"{home}/out/{'all' if mode == 'complete' else n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{home}/out").parquet(f"{home}/out/*") if parts else spark.read.schema(stream.schema).parquet(f"{home}/out/*")
