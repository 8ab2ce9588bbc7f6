"""Tables between the rounds of iterative operators, written to the shared folder so that lineage and plans stay short."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode without the setting."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = f"file://{tempfile.mkdtemp(prefix='weftline-')}"
    return _own


def own_path(spark: SparkSession, what: str = "round") -> str:
    """A path of its own in the shared folder; what is written there goes when Python ends."""
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; the files go when Python ends."""
    spark = df.sparkSession
    path = own_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone at exit
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def numbered(rows: DataFrame, order: str, name: str, after: Column | None = None) -> DataFrame:
    """``rows`` with a number from 1 (or from one above ``after``) by ``order``, made in many tasks.

    Rows are range-partitioned and numbered within their partition; a partition's offset is the sum of the sizes before it,
    a table of one row for each partition. Rows of equal order are numbered in any order.
    """
    placed = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    number = F.col("_before") + F.col("_at") + 1 + (F.coalesce(after, F.lit(0)) if after is not None else F.lit(0))
    return placed.join(before, "_part").withColumn(name, number).drop("_part", "_at", "_before")


def numbered_within(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with a number from 1 within each key by ``order``, a key of very many rows spread over several tasks.

    Rows are range-partitioned by key and order. A row's number is its place among its key's in its partition and the sum of
    that key's sizes in the partitions before, a table of one row for each key and partition that it reaches. Rows of equal
    order are numbered in any order.
    """
    sorts = [F.col(k).asc() for k in keys] + order
    placed = rows.repartitionByRange(*sorts).sortWithinPartitions(*sorts) if sorts else rows
    placed = written(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_part")
    starts = sizes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_part", (F.sum("_n").over(along) - F.col("_n") - F.col("_first") + 1).alias("_start"))
    same = placed["_part"] == starts["_part"]
    for i, k in enumerate(keys):
        same &= placed[k].eqNullSafe(starts[f"_key{i}"])
    return placed.join(starts, same).withColumn(name, placed["_at"] + F.col("_start")).select(*rows.columns, name)


def listed(rows: DataFrame, by: list[str], value: str, most: int = 1000) -> DataFrame:
    """(by..., value): the values of rows that are equal in ``by``, as lists; where they are more than ``most``, as several of about so many.

    Joins and distances are then computed once for a pair of lists, and rows come from them as they are read.
    """
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    sizes = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.ceil(F.col("_n") / most).alias("_lists"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    dealt = rows.join(sizes, same, "left").withColumn("_list", F.pmod(F.xxhash64(value), F.coalesce("_lists", F.lit(1))))
    return dealt.groupBy(*by, "_list").agg(F.collect_list(value).alias(value)).drop("_list")


class Rounds:
    """Tables of an iterative operator by name: what a new one of a name was made from is removed once it is written.

    The last ones stay until Python ends, as results are read from them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = own_path(self.spark, name)
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                _remove(self.spark, self.paths.pop(name))
