"""Flight cells of venues and travellers: who looks up a price, in what order, within a quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flight_cells(requests: DataFrame, cache: DataFrame, answers: DataFrame, quota: int) -> tuple[DataFrame, DataFrame]:
    """(cells, spent) of requests (ord, venue, traveller, mode, origin, to, dates) in the order of ``ord``, which must have no ties.

    Who lives there or drives needs no price. Those who fly take the price of their route and dates (key: origin, to, dates)
    from ``cache`` (key..., price); else the search for the key is made once, by its first request, as long as fewer than
    ``quota`` searches have brought a price: ``answers`` (key..., price or null) says what each would bring. A search that brings
    none costs nothing. Without a price the cell is a link. ``spent`` are the keys that were paid for, at most ``quota``, to go
    into the cache. Cells: ord, venue, traveller, cell, price.
    """
    key = ["origin", "to", "dates"]
    flies = requests.where("mode = 'fly' AND origin IS NOT NULL AND to IS NOT NULL")
    known = cache.where("price IS NOT NULL").groupBy(*key).agg(F.min("price").alias("_cached"))
    first = flies.join(known, key, "left_anti").groupBy(*key).agg(F.min("ord").alias("_first"))
    brought = answers.where("price IS NOT NULL").groupBy(*key).agg(F.min("price").alias("_found"))
    spent = first.join(brought, key).orderBy("_first").limit(quota).select(*key, F.col("_found").alias("price"))
    paid = spent.withColumnRenamed("price", "_paid")
    priced = flies.select("ord", *key).join(known, key, "left").join(paid, key, "left").select("ord", F.coalesce("_cached", "_paid").alias("price"))
    mode = F.when(F.col("mode").isin("local", "drive"), F.col("mode")).when(F.col("mode") == "fly", F.when(F.col("price").isNotNull(), "priced").otherwise("link")).otherwise("unknown")
    return requests.join(priced, "ord", "left").select("ord", "venue", "traveller", mode.alias("cell"), "price"), spent
