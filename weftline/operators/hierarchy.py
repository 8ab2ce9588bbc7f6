"""Trees of areas: paths, inherited values, nearest ancestors.

Chains are followed by doubling: after k rounds every area knows its next 2**k ancestors, so a chain of a million levels takes
twenty joins. Each round is written to the shared folder; there is no limit on the depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.lineage import Rounds


def _rounds(areas: DataFrame) -> int:
    """Rounds after which every chain without a cycle has ended."""
    return areas.count().bit_length() + 1


def rooted(areas: DataFrame) -> DataFrame:
    """(id) of the areas whose chain ends at a root: neither in or under a cycle nor under a missing parent."""
    kept = Rounds(areas.sparkSession)
    jump = kept.put(areas.select("id", F.col("parent_id").alias("up"), F.lit(True).alias("proper")), "rooted")
    for _ in range(_rounds(areas)):
        if jump.where("up IS NOT NULL").isEmpty():
            break
        to = jump.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("proper").alias("_proper"), F.lit(True).alias("_there"))
        moved = jump.where("up IS NOT NULL").hint("merge").join(to, "up", "left").select("id", F.col("_up").alias("up"), (F.col("proper") & F.coalesce("_proper", F.lit(False)) & F.col("_there").isNotNull()).alias("proper"))
        jump = kept.put(jump.where("up IS NULL").unionByName(moved), "rooted")
    return jump.where("up IS NULL AND proper").select("id")


def resolve(areas: DataFrame, inherited: list[str], keep_detached: bool = False) -> DataFrame:
    """(id, parent_id, name, values...) to path_tokens, depth, and each value from the nearest ancestor that has it.

    Areas in or under a cycle or under a missing parent are left out, or with ``keep_detached`` stand for themselves. Ids
    must not repeat.
    """
    kept = Rounds(areas.sparkSession)
    proper = kept.put(areas.hint("merge").join(rooted(areas), "id", "left_semi"), "proper")
    effective = [f"eff_{c}" for c in inherited]
    state = proper.select("id", "parent_id", "name", F.array("name").alias("path_tokens"), F.lit(0).alias("depth"), *[F.col(c).alias(e) for c, e in zip(inherited, effective)], F.col("parent_id").alias("up"))
    for _ in range(_rounds(proper)):
        if state.where("up IS NOT NULL").isEmpty():
            break
        to = state.select(F.col("id").alias("up"), F.col("path_tokens").alias("_path"), F.col("depth").alias("_depth"), *[F.col(e).alias(f"_{e}") for e in effective], F.col("up").alias("_up"))
        moved = state.where("up IS NOT NULL").hint("merge").join(to, "up").select(
            "id", "parent_id", "name", F.concat("_path", "path_tokens").alias("path_tokens"), (F.col("depth") + F.col("_depth") + 1).alias("depth"), *[F.coalesce(e, f"_{e}").alias(e) for e in effective], F.col("_up").alias("up")
        )
        state = kept.put(state.where("up IS NULL").unionByName(moved), "resolved")
    found = state.drop("up")
    if keep_detached:
        lone = areas.join(found.select("id"), "id", "left_anti")
        found = found.unionByName(lone.select("id", "parent_id", "name", F.array("name").alias("path_tokens"), F.lit(0).alias("depth"), *[F.col(c).alias(e) for c, e in zip(inherited, effective)]))
    return found


def ancestors(areas: DataFrame) -> DataFrame:
    """(id, ancestor, distance) with each area its own ancestor at 0; a parent that is missing counts as an ancestor, too.

    In and under a cycle every ancestor stands once, at its smallest distance.
    """
    ids = areas.select("id")
    missing = areas.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().join(ids, "id", "left_anti")
    jump = areas.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up"))
    kept = Rounds(areas.sparkSession)
    pairs = ids.unionByName(missing).select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    for k in range(_rounds(areas)):
        if jump.isEmpty():
            break
        beyond = pairs.select(F.col("id").alias("up"), "ancestor", (F.col("distance") + (1 << k)).alias("distance"))
        pairs = kept.put(pairs.unionByName(jump.hint("merge").join(beyond, "up").select("id", "ancestor", "distance")), "pairs")
        jump = kept.put(jump.hint("merge").join(jump.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up")), "jump")
    if not jump.isEmpty():  # only a cycle has an ancestor so far away
        pairs = pairs.groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))
    return pairs.join(missing, "id", "left_anti")


def fold_up(areas: DataFrame, own: dict[str, Column], merge: dict[str, Callable[[Column, Column, Column], Column]]) -> DataFrame:
    """(id, values..., circular): each value put together along the area's chain, from the area itself to its root.

    ``merge`` gets a value for the lower part of a chain, one for the part right above it, and the number of areas in the
    lower one. Each round doubles these parts, so there are as many rows as areas, however deep the tree is. A missing parent
    ends a chain. ``circular`` marks areas in or under a cycle: theirs are put together over at least as many steps as there
    are areas. Ids must not repeat.
    """
    names = list(own)
    kept = Rounds(areas.sparkSession)
    state = kept.put(areas.select("id", F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("step"), *[c.alias(n) for n, c in own.items()]), "folded")
    for _ in range(_rounds(areas)):
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("step").alias("_step"), F.lit(True).alias("_there"), *[F.col(n).alias(f"_{n}") for n in names])
        joined = state.where("up IS NOT NULL").hint("merge").join(above, "up", "left")  # both grow with the tree: none is to go through the driver
        put = [F.when(F.col("_there"), merge[n](F.col(n), F.col(f"_{n}"), F.col("step"))).otherwise(F.col(n)).alias(n) for n in names]
        moved = joined.select("id", F.col("_up").alias("up"), (F.col("step") + F.coalesce("_step", F.lit(0))).alias("step"), *put)
        state = kept.put(state.where("up IS NULL").unionByName(moved), "folded")
    return state.select("id", *names, F.col("up").isNotNull().alias("circular"))


def nearest_with(areas: DataFrame, columns: list[str]) -> DataFrame:
    """Each area's values from the nearest area up its chain that has all of them, and whether they are its own."""
    has = F.lit(True)
    for c in columns:
        has &= F.col(c).isNotNull()
    own = F.when(has, F.struct(F.lit(0).cast("long").alias("distance"), *columns))
    farther = lambda b, step: F.struct((b["distance"] + step).alias("distance"), *[b[c].alias(c) for c in columns])
    found = fold_up(areas, {"best": own}, {"best": lambda a, b, step: F.coalesce(a, F.when(b.isNotNull(), farther(b, step)))})
    return found.where("best IS NOT NULL").select("id", *[F.col(f"best.{c}").alias(c) for c in columns], (F.col("best.distance") > 0).alias("approx"))


def published_areas(areas: DataFrame, routes: DataFrame) -> DataFrame:
    """Areas that have a published route anywhere below them, ids that are only someone's parent included.

    A mark goes up by doubling: after k rounds it has reached 2**k levels, with one row an area.
    """
    live = routes.where("status = 'publish'").select(F.col("area_id").alias("id")).distinct()
    kept = Rounds(areas.sparkSession)
    marked = kept.put(areas.select("id").join(live, "id", "left_semi"), "marked")
    jump = kept.put(areas.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("up")), "jump")
    for _ in range(_rounds(areas)):
        if jump.isEmpty():
            break
        marked = kept.put(marked.unionByName(jump.hint("merge").join(marked, "id").select(F.col("up").alias("id"))).distinct(), "marked")
        jump = kept.put(jump.hint("merge").join(jump.select(F.col("id").alias("up"), F.col("up").alias("_up")), "up").select("id", F.col("_up").alias("up")), "jump")
    return marked
