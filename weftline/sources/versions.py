"""Trees of records that change as a whole: a new version is written beside the old one and takes its place in one step.

    root/v=1/...        rows of a version, as JSON lines under a folder for each part of their key
    root/manifests/1    one JSON line: the version, its rows, where it came from
    root/current/n      an empty file for every version that was put in place; the largest n is the one that readers take

Until ``publish`` has made its file, readers see the old version, whole; a failure before leaves at most a version that nobody
reads, which the next attempt replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import curation
from weftline.operators.lineage import written
from weftline.sources.sinks import spread


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def current(spark: SparkSession, root: str) -> int | None:
    """The version in place, None without any."""
    fs, target = _fs(spark, f"{root}/current")
    if not fs.exists(target):
        return None
    return max((int(f.getPath().getName()) for f in fs.listStatus(target)), default=None)


def read_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of the version in place; no rows before the first."""
    now = current(spark, root)
    return spark.createDataFrame([], schema) if now is None else spark.read.json(f"{root}/v={now}", schema=schema)


def prepare(rows: DataFrame, root: str, levels: list[str], heavy: int = 1_000_000) -> int:
    """First phase: write ``rows`` as the version after the one in place, with its manifest; gives its number.

    Rows are dealt out by their levels, those of a value with very many over several tasks, at most ``heavy`` rows each.
    """
    spark = rows.sparkSession
    version = (current(spark, root) or 0) + 1
    rows = written(rows)
    spread(rows, levels, heavy).write.partitionBy(*levels).mode("overwrite").json(f"{root}/v={version}")
    told = rows.agg(F.count("*").alias("rows")).select(F.lit(version).alias("version"), "rows", F.lit(version - 1).alias("before"))
    told.write.mode("overwrite").json(f"{root}/manifests/{version}")
    return version


def publish(spark: SparkSession, root: str, version: int) -> None:
    """Second phase: put a prepared version in place, once what it holds agrees with its manifest. Again does nothing."""
    told = spark.read.schema("version int, rows long").json(f"{root}/manifests/{version}").first()
    found = spark.read.text(f"{root}/v={version}").count()
    if told is None or told["rows"] != found:
        raise ValueError(f"version {version}: {found} rows, not those of its manifest")
    if version <= (current(spark, root) or 0):
        return
    fs, target = _fs(spark, f"{root}/current/{version}")
    if not fs.createNewFile(target) and not fs.exists(target):
        raise OSError(f"version {version} can't be put in place")


def canonical(routes: DataFrame, areas: DataFrame) -> DataFrame:
    """Routes (id, name, area_id, sector, ...) under hierarchical keys: country, region, crag, and file, with the sector filled in.

    The key's first three parts are those of ``area_prefix`` of the route's area (an unknown area: unknown/unsorted/unknown),
    the file is the name's slug; of several with one name in a crag all but that of the smallest id end in ``-<id>``. A sector
    that is there stays, else it is that of the area.
    """
    from weftline.functions.text import slug

    prefixes = curation.area_prefix(areas)
    # Areas and keys grow with the input: merged, as what their files take on the disk says little of their rows.
    placed = routes.hint("merge").join(prefixes.select(F.col("id").alias("area_id"), "prefix", F.col("sector").alias("_sector")), "area_id", "left")
    part = lambda i, other: F.coalesce(F.get(F.split("prefix", "/"), F.lit(i)), F.lit(other))
    keyed = placed.select(
        *[placed[c] for c in routes.columns if c != "sector"], F.coalesce(F.nullif(F.trim("sector"), F.lit("")), "_sector").alias("sector"),
        part(0, "unknown").alias("country"), part(1, "unsorted").alias("region"), part(2, "unknown").alias("crag"), F.coalesce(slug(F.col("name")), F.lit("route")).alias("_slug"),
    )
    key = ["country", "region", "crag", "_slug"]
    first = keyed.groupBy(*key).agg(F.min("id").alias("_first"))
    name: Column = F.when(F.col("id") == F.col("_first"), F.col("_slug")).otherwise(F.concat_ws("-", "_slug", F.col("id").cast("string")))
    return keyed.hint("merge").join(first, key).withColumn("file", F.concat(name, F.lit(".json"))).drop("_slug", "_first")


def relocate(spark: SparkSession, source: DataFrame, areas: DataFrame, root: str) -> int:
    """Both phases for a table of routes under their canonical keys; gives the version that is in place then."""
    version = prepare(canonical(source, areas), root, ["country", "region", "crag"])
    publish(spark, root, version)
    return version
