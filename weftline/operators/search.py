"""Faceted search over routes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.geo import DEGREE_KM, haversine

MOST = 20


@dataclass
class Facets:
    """What a search asks for; everything may be left out. ``tags``: by array column, words that must all be there."""

    equal: dict[str, str] = field(default_factory=dict)
    tags: dict[str, list[str]] = field(default_factory=dict)
    month: int | None = None
    grade_to: int | None = None
    pitches_from: int | None = None
    near: tuple[float, float, float] | None = None
    limit: int | None = None


def check_words(words: dict[str, list[str]], vocabulary: DataFrame) -> None:
    """Raise for words that the vocabulary (family, code) doesn't have; a vocabulary is small by nature."""
    known: dict[str, set[str]] = {}
    for r in vocabulary.where(F.col("family").isin(list(words))).collect():
        known.setdefault(r["family"], set()).add(r["code"])
    for family, asked in words.items():
        if odd := sorted(set(asked) - known.get(family, set())):
            raise ValueError(f"{family}: {', '.join(odd)} not in {sorted(known.get(family, set()))}")


def with_month(found: DataFrame, climate: DataFrame | None, month: int | None) -> DataFrame:
    """Each row (id) with its month's ``month_rainy_days`` and ``month_temp_high``; null without a month or a climate."""
    if climate is None or month is None:
        return found.withColumns({"month_rainy_days": F.lit(None).cast("double"), "month_temp_high": F.lit(None).cast("double")})
    of = climate.where(F.col("month") == month).select(F.col("route_id").alias("id"), F.col("rainy_days").alias("month_rainy_days"), F.col("temp_high").alias("month_temp_high"))
    return found.join(of, "id", "left")


def search(routes: DataFrame, facets: Facets, climate: DataFrame | None = None) -> DataFrame:
    """Published routes that fit all facets: by distance (if asked), grade and stars, nulls last, at most MOST.

    A grade cap drops routes without a grade; a month keeps routes without seasons. ``distance_km`` has one decimal and
    orders as shown. With a month, ``climate`` (route_id, month, rainy_days, temp_high) is joined; without, its columns
    are null. Every predicate is on columns of the scan, and the order is taken by a top-k, not a full sort.
    """
    found = routes.where("status = 'publish'")
    for column, value in facets.equal.items():
        found = found.where(F.col(column) == value)
    for column, words in facets.tags.items():
        for word in words:
            found = found.where(F.array_contains(column, word))
    if facets.month is not None:
        found = found.where(F.col("best_season").isNull() | F.array_contains("best_season", facets.month))
    if facets.grade_to is not None:
        found = found.where(F.col("data_grade") <= facets.grade_to)
    if facets.pitches_from is not None:
        found = found.where(F.col("pitches_count") >= facets.pitches_from)
    order = [F.col("data_grade").asc_nulls_last(), F.col("stars").desc_nulls_last(), F.col("id").asc()]
    distance = F.lit(None).cast("double")
    if facets.near is not None:
        lat, lon, km = facets.near
        # The box goes to the scan; the exact distance decides.
        found = found.where(F.col("lat").between(lat - km / DEGREE_KM, lat + km / DEGREE_KM))
        exact = haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
        found = found.where(exact <= km)
        distance = F.round(exact, 1)
        order = [F.col("distance_km").asc_nulls_last(), *order]
    found = found.withColumn("distance_km", distance)
    found = with_month(found, climate, facets.month)
    return found.orderBy(*order).limit(min(facets.limit or 10, MOST))


def vocabularies(tables: dict[str, DataFrame], fixed: dict[str, list[str]], code: str = "code") -> DataFrame:
    """(family, pos, code): the codes of each vocabulary table in order, each once, and fixed lists as they stand."""
    out = None
    for family, rows in tables.items():
        codes = rows.where(F.col(code).isNotNull()).agg(F.array_sort(F.collect_set(code)).alias("codes"))  # a vocabulary is small by nature
        some = codes.select(F.lit(family).alias("family"), F.posexplode("codes").alias("pos", "code"))
        out = some if out is None else out.unionByName(some)
    for family, words in fixed.items():
        some = next(iter(tables.values())).sparkSession.range(1).select(F.lit(family).alias("family"), F.posexplode(F.array(*map(F.lit, words))).alias("pos", "code"))
        out = some if out is None else out.unionByName(some)
    return out
