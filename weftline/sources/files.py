"""Readers of sheets, registries, document trees and landed payloads; every schema is given, none is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.geo import ewkb_point

TRIPS = (
    "trips array<struct<slug: string, name: string, title: string, status: string, start: string, end: string, flex_days: int, sheet_merge: boolean, dir: string, "
    "travellers: array<struct<key: string, name: string, homes: array<struct<city: string, lat: double, lon: double>>, airports: array<string>>>>>"
)
FORECAST = (
    "venue string, timezone string, utc_offset_seconds int, "
    "daily struct<time: array<string>, weathercode: array<int>, temperature_2m_max: array<double>, precipitation_sum: array<double>, precipitation_probability_max: array<double>, "
    "wind_gusts_10m_max: array<double>, winddirection_10m_dominant: array<double>, sunshine_duration: array<double>, daylight_duration: array<double>>, "
    "hourly struct<time: array<string>, dewpoint_2m: array<double>, relative_humidity_2m: array<double>, precipitation: array<double>, temperature_2m: array<double>, precipitation_probability: array<double>>"
)
OPTIONS = "search struct<best_flights: array<struct<price: double, flights: array<struct<airline: string, departure_airport: struct<id: string, time: string>, arrival_airport: struct<id: string, time: string>>>>>, other_flights: array<struct<price: double, flights: array<struct<airline: string, departure_airport: struct<id: string, time: string>, arrival_airport: struct<id: string, time: string>>>>>>"


def sheet(spark: SparkSession, path: str, names: list[str], skip: int = 2) -> DataFrame:
    """A CSV sheet by column position: ``row`` is its true number from 1, the first rows go, and so do rows whose first cell is blank.

    Cells may hold line breaks and rows may be ragged (missing cells are ''). A sheet is one small file, read in one task,
    which is what makes the numbers true.
    """
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    read = spark.read.csv(path, schema=schema, header=False, multiLine=True, escape='"', mode="PERMISSIVE")
    numbered = read.coalesce(1).withColumn("row", F.monotonically_increasing_id() + 1)
    cells = [F.trim(F.coalesce(f"c{i}", F.lit(""))).alias(n) for i, n in enumerate(names)]
    return numbered.where((F.col("row") > skip) & (F.trim(F.coalesce("c0", F.lit(""))) != "")).select(F.col("row").cast("int").alias("row"), *cells)


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The trips of a registry, one row each, with their place in it."""
    read = spark.read.json(path, schema=TRIPS, multiLine=True)
    return read.select(F.posexplode("trips").alias("ord", "t")).select("ord", "t.*")


def documents(spark: SparkSession, root: str, schema: str, media: str = "media") -> DataFrame:
    """JSON documents below a folder: not those at its top, none under a media folder, and only from three folders down or under ``routes``.

    ``path`` is relative to the root; files that don't parse are left out.
    """
    read = spark.read.json(root, schema=f"{schema}, _bad string", multiLine=True, recursiveFileLookup=True, pathGlobFilter="*.json", columnNameOfCorruptRecord="_bad")
    inner = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/+", "/")
    clean = "/" + root.split(":", 1)[-1].strip("/") + "/"
    path = F.regexp_replace(inner, "^" + clean.replace(".", r"\."), "")
    parts = F.split("path", "/")
    fits = (F.size(parts) > 1) & ~F.array_contains(parts, media) & ((F.size(parts) >= 4) | (F.get(parts, F.lit(0)) == "routes"))
    return read.withColumn("path", path).where(fits & F.col("_bad").isNull()).drop("_bad")


def forecast(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=FORECAST)


def member_payload(raw: DataFrame, column: str = "daily") -> DataFrame:
    """A JSON text of parallel series under any names to (venue, time, members): the names that aren't ``time`` are a map."""
    parsed = F.from_json(column, "map<string,string>")
    series = F.map_filter(parsed, lambda k, _: k != "time")
    return raw.select(
        "venue",
        F.from_json(parsed["time"], "array<string>").alias("time"),
        F.transform_values(series, lambda _, v: F.from_json(v, "array<double>")).alias("members"),
    )


def flight_options(searches: DataFrame) -> DataFrame:
    """Best and other offers of landed searches, in that order; offers without a price or a leg don't count."""
    every = F.concat(F.coalesce("search.best_flights", F.array()), F.coalesce("search.other_flights", F.array()))
    each = searches.select("venue", "traveller", F.posexplode(every).alias("ord", "o")).where(F.col("o.price").isNotNull() & (F.size("o.flights") > 0))
    legs = F.col("o.flights")
    return each.select(
        "venue",
        "traveller",
        F.bround("o.price").cast("int").alias("price"),
        F.coalesce(legs[0]["airline"], F.lit("?")).alias("airline"),
        legs[0]["departure_airport"]["id"].alias("from"),
        F.element_at(legs, -1)["arrival_airport"]["id"].alias("to"),
        F.substring(legs[0]["departure_airport"]["time"], -5, 5).alias("dep"),
        F.substring(F.element_at(legs, -1)["arrival_airport"]["time"], -5, 5).alias("arr"),
        (F.size(legs) - 1).alias("stops"),
        "ord",
    )


def report_rows(lines: DataFrame) -> DataFrame:
    """``| rank | name | score |`` lines of written reports back to rows; other lines are left out."""
    pattern = r"^\|\s*(\d+)\s*\|\s*\**([^|*]+?)\**\s*\|\s*(-?\d+)\s*\|"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.where(F.col("value").rlike(pattern)).select(part(1).cast("int").alias("rank"), F.trim(part(2)).alias("name"), part(3).cast("int").alias("score"))


def fresh(cache: DataFrame, now: Column, hours: float, written: str = "generated_at") -> DataFrame:
    """Cache rows not older than some hours; older ones are as good as none."""
    return cache.where(F.col(written) >= now - F.make_interval(secs=F.lit(hours * 3600)))


def of_version(cache: DataFrame, suffix: str, key: str = "key") -> DataFrame:
    return cache.where(F.col(key).endswith(suffix))


def points(rows: DataFrame, column: str) -> DataFrame:
    """Rows with ``lat`` and ``lon`` decoded from extended WKB hex."""
    lat, lon = ewkb_point(F.col(column))
    return rows.withColumns({"lat": lat, "lon": lon})
