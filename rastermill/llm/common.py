"""What the operators share: tables, the shared folder, Arrow batches of text, bounded samples."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..sources import storage

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Text handled at once inside a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which is then Spark's checkpoint folder too."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or storage.shared_dir(spark)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there: what follows survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Files of a shuffle go when the query that wrote them ends. For work in many checkpointed steps, of which none reads an earlier one's shuffles."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)  # other versions of Spark may not have it
    if before is None:
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that Spark wrote, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that a piece of work writes to the shared folder and reads again, packed closer than checkpoints; they go when the work ends, or fails."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.home, self.made = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        df.write.parquet(f"{self.home}/{self.made}")
        return self.spark.read.schema(df.schema).parquet(f"{self.home}/{self.made}")

    def __exit__(self, *_) -> None:
        remove(self.spark, self.home)


def by_position(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, ..., so that no name clashes with a working column or needs quoting; new names of `columns`."""
    names = df.columns
    return df.toDF(*[f"c{k}" for k in range(len(names))]), [f"c{names.index(c)}" for c in columns]


def smallest_hash(df: DataFrame, key: str, n: int, total: int | None = None, spare: int = 4) -> DataFrame:
    """A sample of at most n rows, the same at each run: those whose key has the smallest hash.

    total: how many rows there may be. With it, rows below a bound on the hash are looked at first, so that each task sends
    a few rows to the driver rather than n; the bound is raised until n rows lie below it, so the sample does not depend on it.
    """
    h = F.xxhash64(F.col(key), F.lit("sample"))
    share = spare * n / total if total else 1.0
    while share < 1:
        got = checkpoint(df.where(h < int(-(1 << 63) + (1 << 64) * share)).orderBy(h, F.col(key)).limit(n))
        if got.count() == n:
            return got
        share *= 32
    return df.orderBy(h, F.col(key)).limit(n)


def crc_rest(key: str, n: int):
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about SLICE_BYTES of text each, one row at least."""
    first, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield batch.slice(first)


def map_text(df: DataFrame, make: Callable[[], Callable], fields: list[T.StructField], keep: list[str], text: str = "text", explode: bool = False) -> DataFrame:
    """Columns keep of df with fields appended; keep may hold the text column.

    make() runs once in each task and gives a function from a list of texts (bytes, None for null) to a list of value
    lists, one for each of fields, in the order of the texts. With explode the function gives (rows, values): rows are
    positions of the texts, as often as wished, and only these come out. Only the columns keep and text leave the scan. Columns go by
    position, so that names may be any; those of keep that have the name of a field are replaced.
    """

    spark = df.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)  # Python workers find this package wherever the driver started
    new = {f.name for f in fields}
    keep = [c for c in keep if c not in new]
    own = text in keep
    placed, at_of = by_position(df, *keep, text)
    src = placed.select(*at_of[: len(keep)], *([] if own else [F.col(at_of[-1]).cast("string").alias("t")]))
    at = keep.index(text) if own else len(keep)
    schema = T.StructType([*src.schema.fields[: len(keep)], *[T.StructField(f"n{k}", f.dataType) for k, f in enumerate(fields)]])
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in fields]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in _slices(batch, at):
                texts = part.column(at).cast(pa.large_binary() if pa.types.is_large_string(part.column(at).type) else pa.binary()).to_pylist()
                columns = part.columns[:width]
                if explode:
                    rows, values = fn(texts)
                    columns = [c.take(pa.array(rows, pa.int64())) for c in columns]
                else:
                    values = fn(texts)
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v, kind) for v, kind in zip(values, kinds)]], names=names)

    return src.mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])
