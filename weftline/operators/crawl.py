"""What a crawl's answers do to areas, routes and the work list; seeds for it; topos; validation by a declared schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.lineage import numbered

#: Words of a discipline that pass the gate, least pitches, and least length of those whose pitches aren't known. Fixed values.
LONG_STYLES, PITCHES, LENGTH = ("trad", "alpine", "aid"), 2, 60


def long_routes(pitches: Column, length: Column, style: Column) -> Column:
    """Multi-pitch trad or alpine: two pitches or 60 metres, and a style among those that count."""
    return ((F.coalesce(pitches, F.lit(0)) >= PITCHES) | (F.coalesce(length, F.lit(0)) >= LENGTH)) & F.coalesce(F.lower(style).isin(*LONG_STYLES), F.lit(False))


def insert_pages(pages: DataFrame, items: DataFrame, areas: DataFrame, frontier: DataFrame) -> dict[str, DataFrame]:
    """Answers of a crawl as new rows: areas, routes, raw records and work items, and which items are done.

    ``items``: id, source, external_id, area_id, path. ``pages``: item (an item's external_id), name, routes (array of structs
    with source_id, name, grade, length_m, pitches, style, stars, url, sector), children (array of structs with url, name);
    ``areas``: id, parent_id, name; ``frontier``: source, external_id. A page with children gives work items alone, with their
    names added to the path. Otherwise routes that pass ``long_routes`` go under their sector (a missing one is made once under
    the item's area, without a sector's name they go under the area itself), with the grade split at its first blank, and each
    gives a work item of kind ``route`` that is fetched already. Items that the frontier has, and repeated ones, are left out.
    """
    read = pages.join(items.withColumnRenamed("external_id", "item").withColumnRenamed("id", "parent_item"), "item")
    leaf = F.size(F.coalesce("children", F.array())) == 0
    each = read.where(leaf).select("parent_item", "source", "area_id", "path", F.explode("routes").alias("r"))
    kept = each.where(long_routes(F.col("r.pitches"), F.col("r.length_m"), F.col("r.style")))
    sector = F.nullif(F.trim("r.sector"), F.lit(""))
    fields = [f"r.{c}" for c in ("source_id", "name", "grade", "length_m", "pitches", "style", "stars", "url")]
    kept = kept.select("parent_item", "source", "area_id", "path", sector.alias("sector"), *fields, F.to_json("r").alias("record"))

    wanted = kept.where("sector IS NOT NULL").select(F.col("area_id").alias("parent_id"), kept["sector"].alias("name")).distinct()
    there = areas.select("id", "parent_id", "name").where("parent_id IS NOT NULL")
    missing = wanted.join(there, ["parent_id", "name"], "left_anti")
    made = numbered(missing.withColumn("_order", F.struct("parent_id", "name")), "_order", "id", areas.agg(F.max("id")).scalar()).drop("_order")
    under = there.groupBy("parent_id", "name").agg(F.min("id").alias("id")).unionByName(made)
    placed = kept.join(under.select(F.col("parent_id").alias("area_id"), F.col("name").alias("sector"), F.col("id").alias("sector_id")), ["area_id", "sector"], "left")

    routes = placed.select(
        "source", F.col("source_id").alias("external_id"), F.coalesce("sector_id", "area_id").alias("area_id"), "name",
        F.nullif(F.substring_index("grade", " ", 1), F.lit("")).alias("trad_grade"),
        F.when(F.contains("grade", F.lit(" ")), F.nullif(F.expr("substring(grade, instr(grade, ' ') + 1)"), F.lit(""))).alias("tech_grade"),
        "length_m", "pitches", "stars", "url", "record", "parent_item",
    )
    first = Window.partitionBy("source", "external_id").orderBy("parent_item", "record")
    routes = routes.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")

    child = read.where(~leaf).select("source", "parent_item", "area_id", "path", F.explode("children").alias("c"))
    below = child.select("source", F.col("c.url").alias("external_id"), F.lit("area").alias("kind"), "parent_item", F.concat_ws(" > ", "path", "c.name").alias("path"), F.lit("pending").alias("fetch"), F.lit("not_applicable").alias("tag"))
    found = routes.select("source", "external_id", F.lit("route").alias("kind"), "parent_item", F.lit(None).cast("string").alias("path"), F.lit("done").alias("fetch"), F.lit("pending").alias("tag"))
    once = Window.partitionBy("source", "external_id").orderBy("parent_item", "path")
    work = below.unionByName(found).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return {
        "areas": made.select("id", "parent_id", "name"),
        "routes": routes.drop("record", "parent_item"),
        "raw": routes.select("source", "external_id", "record"),
        "work": work.join(frontier.select("source", "external_id"), ["source", "external_id"], "left_anti"),
        "done": read.select(F.col("parent_item").alias("id")).distinct(),
    }


def best_matches(places: DataFrame, candidates: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """For each place (id, name, country) the candidate (uuid, name, country, climbs) that it most likely is: id, uuid, climbs.

    A candidate counts if it has climbs, lies in the place's country (whose aliases are resolved) and its name has every word of
    the place's. An equal name goes before all others, then most climbs, then the smallest uuid. Places and candidates meet by
    the country and the place's rarest word among the candidates' names, so that a common word makes no pairs of its own.
    Places without a word or without a candidate are left out. Places of one name and country ask once, and of the candidates of
    one name and country the first answers for all: pairs are made of different names alone.
    """
    low = lambda c: F.lower(F.trim(c))
    words = lambda c: F.array_distinct(F.filter(F.split(F.col(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    given = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[F.col("country")] if aliases else F.lit(None)
    sought = places.select("id", low(F.col("name")).alias("_name"), F.coalesce(given, "country").alias("_country"))
    wanted = sought.select("_name", "_country").distinct().withColumn("_words", words("_name"))
    first = F.struct((-F.col("climbs")).alias("fewer"), "uuid")
    offered = candidates.where("climbs > 0").groupBy(low(F.col("name")).alias("_offered"), F.col("country").alias("_country")).agg(F.min(first).alias("_first"), F.min_by("climbs", first).alias("climbs"))
    offered = offered.withColumn("_has", words("_offered")).withColumn("_word", F.explode("_has"))
    often = offered.groupBy("_country", "_word").agg(F.count("*").alias("_n"))
    name = ["_name", "_country"]
    each = wanted.withColumn("_word", F.explode("_words")).join(often, ["_country", "_word"])  # a word that no candidate has: no match
    rarest = each.groupBy(*name).agg(F.min_by("_word", F.struct("_n", "_word")).alias("_word"))
    met = wanted.join(rarest, name).join(offered, ["_country", "_word"]).where(F.size(F.array_except("_words", "_has")) == 0)
    order = F.struct((F.col("_offered") != F.col("_name")).alias("other"), "_first.fewer", "_first.uuid")
    best = met.groupBy(*name).agg(F.min(order).alias("b"), F.min_by("climbs", order).alias("climbs"))
    return sought.join(best, name).groupBy("id").agg(F.min("b").alias("b"), F.min_by("climbs", "b").alias("climbs")).select("id", "b.uuid", "climbs")


def seed(frontier: DataFrame, matches: DataFrame, source: str) -> DataFrame:
    """The work list (source, external_id, path) with an item for each match (uuid, path) that it lacks; repeated ones count once.

    Idempotent: seeding again, or seeding what another run has seeded, adds nothing.
    """
    new = matches.groupBy(F.lit(source).alias("source"), F.col("uuid").alias("external_id")).agg(F.min("path").alias("path"))
    return frontier.unionByName(new.join(frontier, ["source", "external_id"], "left_anti"))


# A declared schema and what breaks it


@dataclass(frozen=True)
class Rule:
    """What a column (a path into structs, or an array's elements) must be.

    ``one_of``: a list of words, or the name of a vocabulary; ``refers``: a table's key; ``when``: the rule holds only there.
    """

    column: str
    required: bool = False
    one_of: str | tuple[str, ...] | None = None
    least: float | None = None
    most: float | None = None
    not_blank: bool = False
    items: bool = False
    field: str | None = None
    refers: str | None = None
    when: str | None = None
    equals: str | None = None


@dataclass(frozen=True)
class RecordSchema:
    rules: tuple[Rule, ...]
    #: Items of an array that need evidence if their word is among a vocabulary's critical ones: (array, word, evidence, vocabulary).
    evidence: tuple[tuple[str, str, str, str], ...] = ()
    vocabularies: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _words(schema: RecordSchema, of: str | tuple[str, ...]) -> tuple[str, ...]:
    return schema.vocabularies[of] if isinstance(of, str) else of


def _unknown(values: Column, words: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: F.coalesce(~x.isin(*words), F.lit(True)))))


def _bare(array: str, word: str, evidence: str, critical: tuple[str, ...]) -> Column:
    """The critical words of an array's items without evidence."""
    bare = F.filter(array, lambda h: h[word].isin(*critical) & (F.trim(F.coalesce(h[evidence], F.lit(""))) == ""))
    return F.array_sort(F.array_distinct(bare[word]))


def broken_rules(schema: RecordSchema) -> Column:
    """One column with all problems of a row as texts, in the order of the rules; references aside, everything is one scan."""
    out = []
    for rule in schema.rules:
        value, found = F.col(rule.column), []
        if rule.required:
            found.append((value.isNull(), F.lit("is missing")))
        if rule.not_blank:
            found.append((F.trim(value) == "", F.lit("is blank")))
        if rule.equals is not None:
            found.append((value.cast("string") != rule.equals, F.lit(f"is not {rule.equals}")))
        if rule.least is not None:
            found.append((value < rule.least, F.lit(f"is under {rule.least:g}")))
        if rule.most is not None:
            found.append((value > rule.most, F.lit(f"is over {rule.most:g}")))
        if rule.one_of is not None:
            words = _words(schema, rule.one_of)
            if rule.items:
                off = _unknown(value if rule.field is None else value[rule.field], words)
                found.append((F.size(off) > 0, F.concat(F.lit("unknown "), F.array_join(off, ", ", "nothing"))))
            else:
                found.append((~value.isin(*words), F.concat(F.lit("unknown "), value.cast("string"))))
        holds = F.expr(rule.when) if rule.when else F.lit(True)
        out += [F.when(F.coalesce(holds & bad, F.lit(False)), F.concat(F.lit(f"{rule.column}: "), said)) for bad, said in found]
    for array, word, evidence, vocabulary in schema.evidence:
        bare = _bare(array, word, evidence, schema.vocabularies[vocabulary])
        out.append(F.when(F.coalesce(F.size(bare) > 0, F.lit(False)), F.concat(F.lit(f"{array}: no evidence for "), F.array_join(bare, ", "))))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def invalid_records(rows: DataFrame, id_col: str, schema: RecordSchema, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(id, problem) for everything that a row breaks, a reference to a row that ``tables`` (name: one key column) lacks included.

    Null references don't count (say ``required`` where they should). Rows without a problem don't come.
    """
    own = rows.select(F.col(id_col).alias("id"), F.explode(broken_rules(schema)).alias("problem"))
    for rule in schema.rules:
        if rule.refers:
            (known,) = tables[rule.refers].columns
            asked = rows.where(F.expr(rule.when) if rule.when else F.lit(True)).where(F.col(rule.column).isNotNull())
            asked = asked.select(F.col(id_col).alias("id"), F.col(rule.column).alias("_key"))
            lost = asked.join(tables[rule.refers].select(F.col(known).alias("_key")), "_key", "left_anti")
            own = own.unionByName(lost.select("id", F.concat(F.lit(f"{rule.column}: no {rule.refers} "), F.col("_key").cast("string")).alias("problem")))
    return own


# Topos


def topo_export(topos: DataFrame, media: DataFrame, areas: DataFrame, lines: DataFrame, routes: DataFrame) -> DataFrame:
    """One row for each topo with its picture, its area's name and its lines in the order of the routes' names, by names alone.

    Topos without a picture are left out; lines whose route is gone, too. A topo's lines stand in one row (a picture has few).
    """
    named = routes.select(F.col("id").alias("route_id"), F.col("name").alias("route_name"), F.col("area_id").alias("_area"))
    named = named.join(areas.select(F.col("id").alias("_area"), F.col("name").alias("route_area")), "_area", "left").drop("_area")
    drawn = lines.join(named, "route_id").select("topo_id", F.struct("route_name", "route_area", "line", "pitches", "descent", "source_id").alias("l"))
    listed = drawn.groupBy("topo_id").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    shown = topos.join(media.withColumnRenamed("id", "media_id"), "media_id").join(areas.select(F.col("id").alias("area_id"), F.col("name").alias("area_name")), "area_id", "left")
    return shown.join(listed, shown["id"] == listed["topo_id"], "left").select(
        "title", "status", "belay_size", "area_name", "uri", "kind", "width_px", "height_px", F.col("taken_at").cast("string").alias("taken_at"),
        F.coalesce("lines", F.array().cast(listed.schema["lines"].dataType)).alias("lines"),
    )
