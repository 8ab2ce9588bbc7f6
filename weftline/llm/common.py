"""What several text operators share: lower-casing, tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="weftline-")
    return f"file://{_own}"


_own: str | None = None


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class Staged:
    """Tables written to the shared folder to cut lineage, so that a lost executor costs no recomputation.

    ``drop`` removes those no longer read; the rest goes when Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        atexit.register(self.drop_all)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/weftline-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                _remove(self.spark, path)

    def drop_all(self) -> None:
        self.drop(*list(self.paths))


def pieces(batch: pa.RecordBatch, limit: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``limit`` bytes (or one row), so that what is made of them stays small."""
    rows = max(1, min(batch.num_rows, batch.num_rows * limit // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def trimmed(run: Callable) -> Callable:
    """A function over batches that gives freed memory back to the system when its partition ends.

    Python workers serve one task after another and would keep the most that any of them took.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL(None).malloc_trim(0)

    return each


#: Bytes of the input's files for each partition of an exchange, and a size from which Spark means that it doesn't know one.
PART_BYTES, UNKNOWN = 128 << 20, 1 << 60


def shuffle_width(spark: SparkSession, rows: DataFrame | None = None) -> int:
    """Partitions for an exchange of ``rows``: the session's number, or more where what they are read from asks for it."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is None:
        return least
    leaves, size = rows._jdf.queryExecution().optimizedPlan().collectLeaves().iterator(), 0
    while leaves.hasNext():  # the sizes of files; estimates of what is made of them can be far off
        own = int(str(leaves.next().stats().sizeInBytes()))
        size += own if own < UNKNOWN else 0
    return max(least, -(-size // PART_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
