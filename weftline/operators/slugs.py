"""Names for areas that no two share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import slug
from weftline.operators.lineage import Rounds


def unique_slugs(areas: DataFrame, order: list[Column]) -> DataFrame:
    """(id, slug) for areas (id, name, parent_name): as if they chose one after the other in ``order`` (without ties).

    Each takes the first free of: its name's slug, that and ``--`` and the parent's slug (if it has a parent), then the slug with
    ``--2``, ``--3`` and so on. All choose at once here: of those that want a slug the first keeps it, the others turn to their
    next choice, and so can take it from one that comes later, until nobody moves. That ends in the same choice. Of areas of one
    slug that are down to numbers, the k-th can't get one below k + 1, so these don't try them one by one. Each round is written
    to the shared folder.
    """
    rounds = Rounds(areas.sparkSession)
    at = F.row_number().over(Window.partitionBy("base").orderBy("_order"))
    rows = areas.select("id", F.coalesce(slug(F.col("name")), F.lit("")).alias("base"), F.when(F.col("parent_name").isNotNull() & (F.col("parent_name") != ""), F.coalesce(slug(F.col("parent_name")), F.lit(""))).alias("up"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("_order"))
    # choice: 0 the slug, 1 with the parent's, n >= 2 with the number n
    state = rounds.put(rows.withColumn("choice", F.lit(0).cast("long")), "slugs0")
    wanted = F.when(F.col("choice") == 0, F.col("base")).when(F.col("choice") == 1, F.concat_ws("--", "base", "up")).otherwise(F.concat_ws("--", F.col("base"), F.col("choice").cast("string")))
    turn = 0
    while True:
        turn += 1
        asked = state.withColumn("wanted", wanted)
        first = asked.groupBy("wanted").agg(F.min("_order").alias("_best"))
        judged = asked.join(first, "wanted").withColumn("lost", F.col("_order") != F.col("_best"))
        following = F.when(F.col("choice") >= 1, F.greatest(F.col("choice") + 1, F.lit(2))).when(F.col("up").isNotNull(), 1).otherwise(2)
        moved = judged.withColumn("choice", F.when(F.col("lost"), following).otherwise(F.col("choice")))
        down = moved.where("choice >= 2").withColumn("_k", at + 1)
        down = down.withColumn("choice", F.greatest("choice", "_k").cast("long")).drop("_k")
        state = rounds.put(moved.where("choice < 2").unionByName(down).withColumn("choice", F.col("choice").cast("long")), f"slugs{turn}")
        rounds.drop(f"slugs{turn - 1}")
        if state.where("lost").isEmpty():
            return state.select("id", F.col("wanted").alias("slug"))
        state = state.drop("wanted", "lost", "_best")
