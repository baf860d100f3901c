"""Binary pixmaps (P6) and greymaps (P5) as a data source: files are read in bands of rows, and written one by each image.

A band is a range of a file's bytes, so that one large picture spans many tasks and the driver opens no file; a partition is one band of a large
picture, or as many small ones as make up _PART bytes, each file counted _OPEN bytes more. Names are looked at before
any file is opened; height and width are in the header, behind which a band that they rule out stops.
"""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

SCHEMA = "image_id long, origin string, height int, width int, channel int, row int, col int, value int"
_HEADER = re.compile(rb"P([56])\s(?:\s|#[^\n]*\n)*(\d+)\s+(\d+)\s+(\d+)\s")
#: Bytes of a partition where bands are smaller, and what opening a file counts.
_PART, _OPEN = 8 << 20, 16 << 10
_PASSES = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b)}


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def image_key(origin: str) -> int:
    """The number that stands for a file: its own where its name is one, else 63 bits of a hash of its place."""
    stem = posixpath.basename(origin).split(".")[0]
    return int(stem) if stem.isdigit() and len(stem) < 19 else int.from_bytes(hashlib.blake2b(origin.encode(), digest_size=8).digest(), "big") >> 1


@dataclass
class Bands(InputPartition):
    """Ranges (origin, start, end): bands of one file that follow each other are one range, cut again where it is read."""

    ranges: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.pattern, self.band = options["path"], options.get("pattern", "*.p[gp]m"), int(options.get("bandbytes", 8 << 20))
        self.by_name: list = []
        self.by_header: list = []

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if type(f) in _PASSES and len(f.attribute) == 1 else None
            if column == "origin":
                self.by_name.append((type(f), f.value))
            elif column in ("height", "width") and type(f) is not StringStartsWith:
                self.by_header.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Bands]:
        where, root = _place(self.path)
        out, now, held = [], [], 0
        for f in where.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and all(_PASSES[kind](f.path, value) for kind, value in self.by_name):
                for at in range(0, f.size, self.band):
                    end = min(at + self.band, f.size)
                    if now and now[-1][0] == f.path:
                        now[-1] = (f.path, now[-1][1], end)
                    else:
                        now.append((f.path, at, end))
                        held += _OPEN
                    held += end - at
                    if held >= _PART:
                        out.append(Bands(now))
                        now, held = [], 0
        return [*out, Bands(now)] if now else out

    def read(self, bands: Bands) -> Iterator[pa.RecordBatch]:
        for origin, start, end in bands.ranges:
            yield from self._rows(origin, start, end)

    def _rows(self, origin: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
        """Cells of the rows whose first byte lies in the range, band by band."""
        where, _ = _place(self.path)
        with where.open_input_file(origin) as f:
            head = _HEADER.match(f.read(min(f.size(), 4096)))
            if not head or int(head[4]) > 255:
                return
            width, height, planes = int(head[2]), int(head[3]), 3 if head[1] == b"6" else 1
            size = {"height": height, "width": width}
            if not width or not all(_PASSES[kind](size[c], value) for c, kind, value in self.by_header):
                return
            line, base = width * planes, head.end()
            row = lambda at: 0 if at == 0 else min(height, max(0, -(-(at - base) // line)))  # the first one that starts there or later
            step = max(1, (1 << 18) // line)
            for top, last in ((top, last) for at in range(start, end, self.band) for last in [row(min(at + self.band, end))] for top in range(row(at), last, step)):
                rows = min(step, last - top)
                f.seek(base + top * line)
                data = np.frombuffer(f.read(rows * line), np.uint8)
                if len(data) < rows * line:
                    return  # a file that was cut off
                n = len(data)
                r, rest = np.divmod(np.arange(n), line)
                const = lambda v, kind: pa.array(np.full(n, v), kind)
                columns = [const(image_key(origin), pa.int64()), pa.DictionaryArray.from_arrays(np.zeros(n, np.int32), [origin]).cast(pa.string()), const(height, pa.int32()), const(width, pa.int32()), pa.array(rest % planes, pa.int32()), pa.array(top + r, pa.int32()), pa.array(rest // planes, pa.int32()), pa.array(data, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "origin", "height", "width", "channel", "row", "col", "value"])


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceWriter):
    """Rows (image_id, height, width, planes, row, line) in the order of image and row: a file for each image, under another name until it is whole."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        where, root = _place(self.path)
        where.create_dir(root, recursive=True)
        done, now, out = [], None, None
        for image, height, width, planes, _, line in rows:
            if image != now:
                if out:
                    out.close()
                now = image
                done.append(f"{root}/{image}.{'ppm' if planes == 3 else 'pgm'}")
                out = where.open_output_stream(f"{done[-1]}.part")
                out.write(f"P{6 if planes == 3 else 5}\n{width} {height}\n255\n".encode())
            out.write(bytes(line))
        if out:
            out.close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        where, _ = _place(self.path)
        for m in messages:
            for f in m.files if m else []:
                where.move(f"{f}.part", f)

    def abort(self, messages: list) -> None:
        where, _ = _place(self.path)
        for m in messages:
            for f in m.files if m else []:
                where.delete_file(f"{f}.part")


class Netpbm(DataSource):
    """Options: path; pattern of names; bandbytes, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "netpbm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known; filters reach it where Spark lets Python sources take them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Netpbm)


def scan_pixmaps(spark: SparkSession, path: str, band_bytes: int = 8 << 20) -> DataFrame:
    """(image_id, origin, height, width, channel, row, col, value) of the pixmaps below path, in bands of about band_bytes; other files are left out."""
    register(spark)
    return spark.read.format("netpbm").option("path", path).option("bandbytes", band_bytes).load()


def write_pixmaps(cells: DataFrame, path: str, h: int, w: int, planes: int = 3) -> None:
    """A file <image_id>.ppm (.pgm for one plane) of h x w for each image of cells (cell, value), black where a cell is missing.

    Rows of an image come to one task one after the other, as a file has one writer; none holds a whole image.
    """
    register(cells.sparkSession)
    lines = cells.where((F.col("row") >= 0) & (F.col("row") < h) & (F.col("col") >= 0) & (F.col("col") < w) & F.col("channel").between(0, planes - 1))
    place = F.col("col") * planes + F.col("channel")
    held = lines.groupBy("image_id", "row").agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int"), F.col("value").cast("int")))).alias("m"))
    every = cells.select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("row")).join(held, ["image_id", "row"], "left")
    byte = lambda v: F.when(v.between(0, 255), F.lpad(F.hex(v), 2, "0")).otherwise(F.raise_error(F.concat(F.lit("no byte: "), v.cast("string"))))
    line = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(w * planes - 1)), lambda k: byte(F.coalesce(F.try_element_at("m", k), F.lit(0)))), ""))
    out = every.select("image_id", F.lit(h).alias("height"), F.lit(w).alias("width"), F.lit(planes).alias("planes"), "row", line.alias("line"))
    out.repartition("image_id").sortWithinPartitions("image_id", "row").write.format("netpbm").option("path", path).mode("append").save()
