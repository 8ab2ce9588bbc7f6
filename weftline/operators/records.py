"""Records from several sources: rules, safe upserts, replacement, clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import norm_name, similarity, strip_tags
from weftline.operators.lineage import listed, written
from weftline.operators.proximity import within_km


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], preserve: list[str] = (), guard: Column | None = None, sticky: dict[str, Column] | None = None) -> DataFrame:
    """The table after an upsert, as a full outer join.

    Incoming values win, but in ``preserve`` columns only if not null; rows for which ``guard`` (over ``cur``) is false stay
    as they are; ``sticky`` gives columns that neither side alone decides, as expressions over ``cur`` and ``new``.
    """
    cur, new = current.withColumn("_has", F.lit(True)).alias("cur"), incoming.withColumn("_has", F.lit(True)).alias("new")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"cur.{k}").eqNullSafe(F.col(f"new.{k}"))
    # The first key as a plain equality keeps this an equi-join; nulls there meet through eqNullSafe, an equality as well.
    joined = cur.join(new, same, "full_outer")
    old, fresh = F.col("cur._has").isNotNull(), F.col("new._has").isNotNull()
    update = fresh & old & (F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True))
    out = []
    for c in current.columns:
        if c in keys:
            value = F.when(old, F.col(f"cur.{c}")).otherwise(F.col(f"new.{c}"))
        elif c not in incoming.columns:
            value = F.col(f"cur.{c}")
        else:
            taken = F.coalesce(F.col(f"new.{c}"), F.col(f"cur.{c}")) if c in preserve else F.col(f"new.{c}")
            taken = (sticky or {}).get(c, taken)
            value = F.when(update, taken).when(old, F.col(f"cur.{c}")).otherwise(F.col(f"new.{c}"))
        out.append(value.alias(c))
    return joined.select(*out)


def replace_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children of every parent that comes in are replaced as a whole."""
    return children.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming)


def missing_parents(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose reference leads nowhere; null references don't count."""
    return rows.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def usage(vocabulary: DataFrame, used: DataFrame, code: str = "code") -> DataFrame:
    """How often each word of a vocabulary is used, unused ones included."""
    counts = used.groupBy(code).agg(F.count("*").alias("_n"))
    return vocabulary.join(counts, code, "left").withColumn("uses", F.coalesce("_n", F.lit(0))).drop("_n")


def problems(rows: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, problem) for every rule that a row breaks; a rule that is null counts as kept."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()]))
    return rows.select(id_col, F.explode(broken).alias("problem"))


def keep_first(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The first row of each key by input order (dropDuplicates would keep any)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))).where("_n = 1").drop("_n")


def name_pairs(rows: DataFrame, key: str, name: str, other: str, salts: int = 32) -> DataFrame:
    """(a, b), smaller first: all pairs of keys of rows that have one name and differ in ``other``; rows with a null have none.

    Lists of the keys of one name and ``other`` meet, dealt out so that a name of very many rows is the work of many tasks.
    Pairs of lists, not of keys, are shuffled once more: that spreads them evenly, and what a task holds at a time are the pairs of
    two short lists, not of a list and all others of its name. The pairs' number is the result's.
    """
    lists = listed(rows.where(F.col(name).isNotNull() & F.col(other).isNotNull()).select(key, name, other), [name, other], key, 250)
    width = 8 * rows.sparkSession.sparkContext.defaultParallelism
    one = lists.select(F.col(name).alias("n"), F.col(other).alias("o"), F.col(key).alias("a"), F.pmod(F.xxhash64(F.col(key)), F.lit(salts)).alias("salt"))
    two = lists.select(F.col(name).alias("n"), F.col(other).alias("p"), F.col(key).alias("b")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = one.repartition(width, "n", "salt").hint("merge").join(two.repartition(width, "n", "salt"), ["n", "salt"]).where("o < p").select("a", "b").repartition(width)
    each = met.select(F.explode("a").alias("x"), "b").select("x", F.explode("b").alias("y")).where("x <> y")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def merged_entities(members: DataFrame, group: str, ordinal: str) -> DataFrame:
    """(group, name, lat, lon, rock, disciplines, description, source, grade) to one row for each group.

    The longest name and description (the first of equals), the first value of each attribute that is there, latitude and
    longitude apart, all disciplines, and each source's last grade. Everything is an aggregate: no member list is built
    except of distinct words and sources.
    """
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(ordinal)))
    longest = lambda c: F.max_by(c, F.struct(F.length(c).alias("n"), (-F.col(ordinal)).alias("o")))
    per_source = members.groupBy(group, "source").agg(F.max_by("grade", ordinal).alias("grade"))
    grades = per_source.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("source", "grade"))).alias("grade_by_source"))
    merged = members.groupBy(group).agg(
        longest("name").alias("name"),
        first("lat").alias("lat"),
        first("lon").alias("lon"),
        first("rock").alias("rock"),
        longest("description").alias("description"),
        F.count("*").alias("refs"),
    )
    words = members.select(group, F.explode("disciplines").alias("w")).distinct().groupBy(group).agg(F.array_sort(F.collect_list("w")).alias("disciplines"))
    return merged.join(words, group, "left").join(grades, group, "left")


def place_pairs(places: DataFrame, near_m: float = 1000, close_m: float = 500, least: float = 0.55) -> DataFrame:
    """(a, b, verdict) for pairs of places of different sources: ``same`` or ``ambiguous``.

    Same: equal normal names and less than ``near_m`` apart or at an unknown distance. Ambiguous: less than ``close_m`` apart and
    names at least ``least`` alike, but not equal. Names meet by an equi-join, neighbours through grid cells; similarity is
    computed for neighbours alone.
    """
    named = places.withColumn("norm", norm_name(F.col("name")))
    some = named.select("id", "source", "norm", "lat", "lon")
    met = within_km(some, some, near_m / 1000, 0.05, also=["norm"]).where(f"id < b_id AND source <> b_source AND km * 1000 < {near_m}").select(F.col("id").alias("a"), F.col("b_id").alias("b"))
    lost = named.where("lat IS NULL OR lon IS NULL").select("id", "source", "norm").alias("m")
    other = named.select("id", "source", "norm", (F.col("lat").isNull() | F.col("lon").isNull()).alias("lost")).alias("o")
    once = (F.col("m.norm") == F.col("o.norm")) & (F.col("m.source") != F.col("o.source")) & (~F.col("o.lost") | (F.col("m.id") < F.col("o.id")))
    unknown = lost.join(other, once).where("m.id <> o.id").select(F.least("m.id", "o.id").alias("a"), F.greatest("m.id", "o.id").alias("b"))
    near = within_km(named, named, close_m / 1000, 0.05).where("id < b_id AND source <> b_source AND norm <> b_norm AND km * 1000 < " + str(close_m))
    alike = near.withColumn("sim", similarity("norm", "b_norm")).where((F.col("sim") >= least) & (F.col("sim") < 1))
    same = met.unionByName(unknown)
    return same.select("a", "b", F.lit("same").alias("verdict")).unionByName(alike.select(F.col("id").alias("a"), F.col("b_id").alias("b"), F.lit("ambiguous").alias("verdict")))


def entity_links(places: DataFrame, near_m: float = 1000) -> DataFrame:
    """(a, b) links whose components are those of ``place_pairs``' same places, in proportion to the places.

    Places of one name, source and point are one spot; spots meet through grid cells and names, and a spot's places link to one of
    them where it has a neighbour. A place without coordinates is the same as all of other sources with its name: so each name
    links its places to two such of different sources (or, where all are of one, the places without coordinates to one of
    another source).
    """
    named = places.select("id", "source", norm_name(F.col("name")).alias("norm"), "lat", "lon")
    spot = ["norm", "source", "lat", "lon"]
    spots = named.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy(*spot).agg(F.min("id").alias("id"))
    near = within_km(spots, spots, near_m / 1000, 0.05, also=["norm"]).where(f"id < b_id AND source <> b_source AND km * 1000 < {near_m}").select(F.col("id").alias("a"), F.col("b_id").alias("b"))
    near = written(near)
    linked = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "first")
    own = named.join(spots.withColumnRenamed("id", "first"), spot).join(linked, "first", "left_semi").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))

    lost = F.col("lat").isNull() | F.col("lon").isNull()
    first = named.where(lost).groupBy("norm").agg(F.min(F.struct("id", "source")).alias("m0"))
    marked = named.withColumn("lost", lost).join(first, "norm")
    apart = F.col("source") != F.col("m0.source")
    second = marked.where(apart).groupBy("norm").agg(F.min(F.when(F.col("lost"), F.col("id"))).alias("m1"), F.min("id").alias("x0"))
    told = marked.join(second, "norm", "left")
    to = F.when(apart, F.col("m0.id")).otherwise(F.coalesce("m1", F.when(F.col("lost"), F.col("x0"))))
    blind = told.select(F.col("id").alias("a"), to.alias("b")).where("b IS NOT NULL AND a <> b")
    return near.unionByName(own).unionByName(blind)


def same_routes(routes: DataFrame, km: float = 2.0) -> DataFrame:
    """(id, source, external_id): for each route the references of routes of its name on other crags nearer than ``km``.

    ``routes``: id, name, crag, lat, lon (the crag's), refs (array of structs with source and external_id). Only routes whose
    set of sources differs count, and of theirs only references to sources that the route itself lacks. Without coordinates a
    route has none. Each reference comes once. Routes of one name, crag, point and set of sources are of one kind: kinds meet, and
    rows are made last, from lists of a kind's routes and the references that it is told of. A kind of very many routes has several
    lists, each told apart: a task holds no more rows at a time than one list and one reference make. Names are normalised once each
    for a kind, not for a route.
    """
    rows = routes.where("lat IS NOT NULL AND lon IS NOT NULL")
    rows = rows.select("id", "name", "crag", "lat", "lon", "refs", F.array_sort(F.array_distinct("refs.source")).alias("sources"))
    spelt, alike = ["name", "crag", "lat", "lon", "sources"], ["norm", "crag", "lat", "lon", "sources"]
    spellings = rows.select(*spelt).distinct().withColumn("norm", norm_name(F.col("name"))).withColumn("_at", F.monotonically_increasing_id())
    spellings = written(spellings.withColumn("kind", F.min("_at").over(Window.partitionBy(*alike))).drop("_at"))
    kinds = spellings.select(*alike, "kind").distinct()
    members = written(rows.join(spellings.select(*spelt, "kind"), spelt).select("id", "kind", "refs"))
    of = written(members.groupBy("id").agg(F.collect_set("kind").alias("kinds")))
    lists = listed(of.where("size(kinds) = 1").select("id", F.col("kinds")[0].alias("kind")), ["kind"], "id")
    lists = written(lists.withColumn("list", F.monotonically_increasing_id()))
    several = of.where("size(kinds) > 1").select("id", F.explode("kinds").alias("kind")).select("id", "kind", (-F.col("kind") - 1).alias("list"))
    asks = lists.select("kind", "list").unionByName(several.select("kind", "list").distinct())
    near = within_km(kinds, kinds, km, also=["norm"]).where((F.col("crag") != F.col("b_crag")) & (F.col("km") < km) & (F.col("sources") != F.col("b_sources")))
    offered = members.select(F.col("kind").alias("b_kind"), F.inline("refs")).select("b_kind", "source", "external_id").distinct()
    told = near.select("kind", "sources", "b_kind").join(asks, "kind").join(offered, "b_kind").where(~F.array_contains("sources", F.col("source")))
    # Both sides lie by list alone: neither the repeats of a list's references nor the rows that come of them are shuffled.
    width = max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = told.select("list", "source", "external_id").repartition(width, "list").distinct()
    lone = told.hint("merge").join(lists.select("list", F.col("id").alias("ids")).repartition(width, "list"), "list").select(F.explode("ids").alias("id"), "source", "external_id")
    return lone.unionByName(several.join(told, "list").select("id", "source", "external_id").distinct())


def route_detail(routes: DataFrame, areas: DataFrame) -> DataFrame:
    """Routes with their lists in the order in which they are shown, and their area's path and inherited values.

    Tags and hazard codes by name, parkings by place (none: 0) and id, pitches and references by number, guidebooks by title,
    months in order; nulls count as 0 or empty. ``areas``: id, path_tokens, eff_rock, eff_aspect.
    """
    by = lambda c, key: F.array_sort(F.coalesce(F.col(c), F.array()), lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))
    number = lambda x, f: F.coalesce(x[f], F.lit(0))
    above = areas.select(F.col("id").alias("area_id"), "path_tokens", "eff_rock", "eff_aspect")
    shown = {
        "disciplines": F.array_sort(F.coalesce("disciplines", F.array())),
        "hazards": F.array_sort(F.coalesce(F.transform("hazards", lambda h: h["code"]), F.array())),
        "parkings": by("parkings", lambda x: F.struct(number(x, "ord"), number(x, "id"))),
        "pitches": by("pitches", lambda x: number(x, "number")),
        "guidebooks": by("guidebooks", lambda x: F.coalesce(x["title"], F.lit(""))),
        "months": F.array_sort(F.coalesce("months", F.array())),
    }
    return routes.join(above, "area_id", "left").select(*[shown.get(c, F.col(c)).alias(c) for c in routes.columns], "path_tokens", "eff_rock", "eff_aspect")


def neighbourhood(areas: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ids of ``chosen`` (id) areas and of all areas right under one of them."""
    own = areas.join(chosen.select("id"), "id", "left_semi").select("id")
    below = areas.join(chosen.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")
    return own.union(below).distinct()


def with_lookups(rows: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows with a column ``name`` from each table (key, value), by the exact key in the given column; null where it has none.

    Of several values of a key the smallest counts, so no row comes twice.
    """
    for name, (known, column) in tables.items():
        once = known.groupBy(F.col("key").alias(f"_{name}")).agg(F.min("value").alias(name))
        rows = rows.join(once, F.col(column) == F.col(f"_{name}"), "left").drop(f"_{name}")
    return rows


def travellers(registered: DataFrame, configured: DataFrame) -> DataFrame:
    """(trip, key, name, airports): the registry's travellers, or for trips without any those of the flight configuration.

    Configured keys that begin with ``_`` are notes, not travellers; their names are the keys with a capital.
    """
    made_up = configured.where(~F.col("key").startswith("_")).select("trip", "key", F.initcap("key").alias("name"), "airports")
    return registered.select("trip", "key", "name", "airports").unionByName(made_up.join(registered.select("trip").distinct(), "trip", "left_anti"))


def feed_snapshot(feed: DataFrame, base: list[str], flags: dict[str, str], prose: list[str]) -> DataFrame:
    """Base columns as they are, the words of the flags that are set as an array ``hazards``, prose without markup."""
    hazards = F.array_compact(F.array(*[F.when(F.col(c), F.lit(word)) for c, word in flags.items()]))
    return feed.select(*base, hazards.alias("hazards"), *[strip_tags(F.col(c)).alias(c) for c in prose])
