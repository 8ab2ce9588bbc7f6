"""A walk down a tree of pages that leaves out subtrees elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import Rounds


def pruned_walk(pages: DataFrame, roots: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Pages reached from ``roots`` (url), level by level: (url, depth, kept), ``kept`` for the places that lie in ``box``.

    ``pages``: url, south, west, north, east (the subtree's box, or nulls), lat, lon, n_routes, next (array of urls). A page
    whose own box misses ``box`` (south, west, north, east) is reached but neither kept nor followed. A page with routes is a
    place: it is kept if its point lies in ``box``, or if it has no coordinate at all, and it isn't followed. Other pages are
    followed. A page is reached once, at its smallest depth, so circles end; urls without a page are left out, and of pages
    that repeat a url one is taken. The depth is only bounded by the tree: each level is written to the shared folder.
    """
    south, west, north, east = map(F.lit, box)
    elsewhere = (F.col("north") < south) | (north < F.col("south")) | (F.col("east") < west) | (east < F.col("west"))
    has_box = F.col("south").isNotNull() & F.col("west").isNotNull() & F.col("north").isNotNull() & F.col("east").isNotNull()
    pruned = has_box & elsewhere
    inside = F.coalesce(F.col("lat").between(south, north) & F.col("lon").between(west, east), F.lit(False))
    nowhere: Column = F.col("lat").isNull() & F.col("lon").isNull()
    is_place = F.col("n_routes") > 0
    known = pages.dropDuplicates(["url"]).select(
        "url",
        (~pruned & is_place & (inside | nowhere)).alias("kept"),
        F.when(~pruned & ~F.coalesce(is_place, F.lit(False)), F.coalesce("next", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("follow"),
    )
    rounds = Rounds(pages.sparkSession)
    known = rounds.put(known.withColumn("kept", F.coalesce("kept", F.lit(False))), "pages")
    level = rounds.put(roots.select("url").distinct().join(known, "url"), "level0")
    reached, depth = level.select("url", F.lit(0).alias("depth"), "kept"), 0
    reached = rounds.put(reached, "reached0")
    while not level.isEmpty():
        depth += 1
        below = level.select(F.explode("follow").alias("url")).distinct().join(reached, "url", "left_anti")
        level = rounds.put(below.join(known, "url"), f"level{depth}")
        reached = rounds.put(reached.union(level.select("url", F.lit(depth).alias("depth"), "kept")), f"reached{depth}")
        rounds.drop(f"level{depth - 1}", f"reached{depth - 1}")
    return reached
