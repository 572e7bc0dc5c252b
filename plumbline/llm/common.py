"""What the corpus operators share: tables in the cluster's shared folder, and row packing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one gets its own; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file:///tmp/checkpoints/plumbline"


class Scratch:
    """Tables that one call writes to the shared folder, which cuts lineage and survives lost executors.

    drop() removes tables that nothing reads any more, and what finished jobs shuffled, keep() all but those that a lazy
    result still reads; the rest go when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at: dict[int, str] = {}

    def save(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Writes df and reads it back; by: a column whose values get folders of their own, for drop_part()."""
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path, partitionBy=by)
        self._fs(path).deleteOnExit(self._path(path))
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        self._keep = [*getattr(self, "_keep", []), out]
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.at.pop(id(t), None):
                self._fs(path).delete(self._path(path), True)
        self._free()

    def keep(self, *tables: DataFrame) -> None:
        """Removes all tables but these."""
        self.drop(*[t for t in getattr(self, "_keep", []) if not any(t is k for k in tables)])

    def drop_part(self, table: DataFrame, by: str, value: object) -> None:
        """Removes the rows of one value of the column that a table was saved by."""
        path = f"{self.at[id(table)]}/{by}={value}"
        self._fs(path).delete(self._path(path), True)
        self._free()

    def _free(self) -> None:
        """Lets go of what finished jobs shuffled.

        Spark deletes the shuffle files of plans that nobody holds, but only as the driver's JVM collects its garbage,
        which it seldom does while executors work; they would pile up to the size of the input. The JVM hears of what
        Python no longer holds within a second, so it is asked after two, while the next job runs.
        """

        def collect() -> None:
            with contextlib.suppress(Exception):  # the session may have ended
                self.spark._jvm.System.gc()

        gc.collect()
        later = threading.Timer(2.0, collect)
        later.daemon = True
        later.start()

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct _row, so that an operator's own names can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def arrow_type(kind: DataType) -> pa.DataType:
    """The Arrow type of a column of this type, as it comes out of a table."""
    return to_arrow_type(kind)


def release() -> None:
    """Gives memory that a task has freed back to the system. Workers live on after their task, and would else keep the
    most that any task of theirs took, beside what the executor's JVM takes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices without copies, so that a worker turns few texts at a time into Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    release()


def held_out(doc_id: Column, modulus: int, remainder: int = 2) -> Column:
    """crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def power_of_two(n: int) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def partitions(spark: SparkSession, size: float, each: float) -> int:
    """Tasks for so much work at so much a task; never fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / each) + 1)
