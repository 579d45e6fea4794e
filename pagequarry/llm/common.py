"""Small helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests, a laptop) a folder of the
    warehouse is set and used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2_000, size: int = 4 << 20) -> None:
    """Arrow batches of at most so many rows and about so many bytes, so that a Python worker holds little of long texts at once.

    These are settings of the session; they change no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the system; workers live on between tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library: it keeps what it has
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder as Parquet and read again.

    It cuts the lineage with a file that outlives any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "snappy").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def deleted(*tables: DataFrame) -> None:
    """Remove the files of written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_slices(column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[pa.Array]:
    """Consecutive slices of a string array, each of about most_bytes at most (one row at least)."""
    import numpy as np

    if len(column) == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield column.slice(start, stop - start)
        start = stop


class Recent:
    """A map of strings bounded in bytes.

    Entries asked for or put since the last turn are young.  When the young ones
    fill half of the room, the old ones go and the young ones become old, so what
    is frequent stays.  Very long entries aren't kept.
    """

    #: About what an entry takes besides its text and value.
    ENTRY = 170
    LONGEST = 2_048

    def __init__(self, most_bytes: int):
        self.half = most_bytes // 2
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.held = 0

    def many(self, keys: list[str]) -> list:
        """The values of keys, None where one isn't known."""
        out = list(map(self.young.get, keys))
        if self.old:
            get = self.old.get
            for i, value in enumerate(out):
                if value is None and (value := get(keys[i])) is not None:
                    out[i] = value
                    self.put(keys[i], value, 8)
        return out

    def put(self, key: str, value, size: int) -> None:
        """size: bytes of the value."""
        if len(key) + size > self.LONGEST:
            return
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value
        self.held += self.ENTRY + len(key) + size


def broadcast_bytes(spark: SparkSession, value: bytes, most: int = 64 << 20):
    """A broadcast of a value whose size is checked before."""
    if len(value) > most:
        raise ValueError(f"{len(value)} bytes are too many to broadcast; the bound is {most}")
    return spark.sparkContext.broadcast(value)
