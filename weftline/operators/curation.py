"""Rules and rewrites of curated records: grades, tags, trips, references, keys and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.text import similarity
from weftline.operators import hierarchy
from weftline.operators.lineage import Rounds, numbered, written

# Grade syntax by system.
GRADES = {
    "BAS": r"^(M|D|VD|HVD|MS|S|HS|MVS|VS|HVS|E\d{1,2})(\s\d[abc])?$",
    "FS": r"^f?\d[abc]\+?$",
    "YDS": r"^5\.\d{1,2}[abcd]?[+-]?$",
    "UIAA": r"^(I{1,3}|IV|V|VI{0,3}|VII|VIII|IX|X|XI|XII)[+-]?$",
    "V": r"^V(B|\d{1,2})\+?$",
    "Font": r"^\d[ABCabc]\+?$",
    "EW": r"^\d{1,2}$",
    "WI": r"^WI\d\+?$",
    "AI": r"^AI\d\+?$",
    "M": r"^M\d{1,2}\+?$",
    "A": r"^A[0-5]\+?$",
    "C": r"^C[0-5]\+?$",
    "ALP": r"^(F|PD|AD|D|TD|ED[1-4]?)[+-]?$",
    "SCO": r"^(I{1,3}|IV|V|VI|VII|VIII|IX|X|XI)\s*,?\s*\d{1,2}$",
}
# Steepness words.
INCLINES = ["Slab", "Slab & Vertical", "Vertical", "Slab, Vertical & Overhanging", "Vertical & Overhanging", "Overhanging"]
# Spelled-out grades, and grades from easy to hard.
SPELLED = {"VDiff": "VD", "V Diff": "VD", "Diff": "D", "Mod": "M", "Moderate": "M", "Severe": "S", "Hard Severe": "HS", "Very Severe": "VS", "Hard Very Severe": "HVS"}
LADDER = ["M", "D", "VD", "S", "HS", "VS", "HVS", "E1", "E2", "E3", "E4", "E5", "E6", "E7"]
#: Statuses of a trip. Fixed values.
STATUSES = ["live", "planned", "ended"]


def grade_problem(system: Column, grade: Column) -> Column:
    """What is wrong with a grade in its system, null if nothing. Systems without a syntax take any grade."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    plain = F.translate(F.trim(grade), "−", "-")
    found = F.when(empty(grade), "no grade").when(empty(system), "no system")
    for name, pattern in GRADES.items():
        found = found.when((system == name) & ~plain.rlike(pattern), "not a grade of the system")
    return found


def ladder_place(grade: Column) -> Column:
    """A grade's place from 1 on the ladder, however it is spelled; null if it isn't there."""
    spelled = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    bare = F.trim(grade)
    return F.nullif(F.array_position(F.array(*map(F.lit, LADDER)), F.coalesce(spelled[bare], bare)), F.lit(0))


def ladder_range(place: Column) -> Column:
    """Aggregate: ``lo–hi`` over places on the ladder, one grade if they are equal, '' without any."""
    named = F.array(*map(F.lit, LADDER))
    lo, hi = (F.get(named, (f(place) - 1).cast("int")) for f in (F.min, F.max))
    return F.when(F.count(place) == 0, "").when(F.min(place) == F.max(place), lo).otherwise(F.concat(lo, F.lit("–"), hi))


def incline(value: Column) -> Column:
    fixed = F.trim(F.replace(value, F.lit("Slsb"), F.lit("Slab")))
    return F.when(fixed.isin(INCLINES), fixed)


def band(value: Column, table: dict[str, int], default: int) -> Column:
    """The number of the first key, in the table's order, that occurs in a text."""
    low, found = F.lower(F.coalesce(value, F.lit(""))), None
    for key, number in table.items():
        found = (F.when if found is None else found.when)(F.contains(low, F.lit(key)), number)
    return F.lit(default) if found is None else found.otherwise(default)


def repaired_tags(tags: Column, allowed: list[str]) -> tuple[Column, Column]:
    """(tags of the vocabulary, tags dropped), both in their order."""
    known = F.array(*map(F.lit, allowed))
    return F.filter(tags, lambda t: F.coalesce(F.array_contains(known, t), F.lit(False))), F.filter(tags, lambda t: ~F.coalesce(F.array_contains(known, t), F.lit(False)))


def supported_hazards(hazards: Column, body: Column, allowed: list[str]) -> Column:
    """(code, evidence) pairs of the vocabulary whose evidence stands in the text, whatever its case."""
    known, low = F.array(*map(F.lit, allowed)), F.lower(F.coalesce(body, F.lit("")))
    return F.filter(hazards, lambda h: F.array_contains(known, h["code"]) & (F.trim(h["evidence"]) != "") & F.contains(low, F.lower(F.trim(h["evidence"]))))


def trip_rules() -> dict[str, Column]:
    """What a trip (slug, name, status, start, end, travellers, flex_days) must keep, by the problem's name."""
    slugged = r"^[a-z0-9]+(-[a-z0-9]+)*$"
    return {
        "slug": F.coalesce(F.col("slug").rlike(slugged), F.lit(False)),
        "name": F.trim(F.coalesce("name", F.lit(""))) != "",
        "status": F.coalesce(F.col("status").isin(STATUSES), F.lit(False)),
        "dates": F.coalesce(F.col("start") <= F.col("end"), F.lit(False)),
        "travellers": F.coalesce(F.size("travellers") > 0, F.lit(False)),
        "repeated_traveller": F.size(F.array_distinct("travellers")) == F.size("travellers"),
        "flex_days": F.coalesce("flex_days", F.lit(0)).between(0, 3),
    }


def guidebook_ids(known: DataFrame, new: DataFrame) -> DataFrame:
    """(ord, isbn, title) rows to the ids of the books that they mean: by isbn, else by title, else a new one by order.

    ``known`` has id, isbn, title. Of several books with one isbn or title the smallest id counts; rows without a title
    are left out. New rows that name the same book share its id.
    """
    key = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = new.select("ord", key("isbn").alias("isbn"), key("title").alias("title")).where("title IS NOT NULL")
    by_isbn = known.where(key("isbn").isNotNull()).groupBy(key("isbn").alias("isbn")).agg(F.min("id").alias("of_isbn"))
    by_title = known.where(key("title").isNotNull()).groupBy(key("title").alias("title")).agg(F.min("id").alias("of_title"))
    found = rows.join(by_isbn, "isbn", "left").join(by_title, "title", "left").select("ord", "isbn", "title", F.coalesce("of_isbn", "of_title").alias("id"))
    fresh = found.where("id IS NULL").groupBy(F.coalesce("isbn", "title").alias("book")).agg(F.min("ord").alias("at"))
    top = known.agg(F.max("id")).scalar()
    new_ids = numbered(fresh, "at", "new_id", top).select("book", "new_id")
    return found.join(new_ids, F.coalesce("isbn", "title") == F.col("book"), "left").select("ord", F.coalesce("id", "new_id").alias("id"), F.col("id").isNull().alias("is_new"))


def add_references(current: DataFrame, new: DataFrame) -> DataFrame:
    """(route, source, external) to (route, source, external, verdict): ``added``, or ``taken`` if another route has the page.

    A route has one reference for each source, so what is added replaces the one before.
    """
    other = current.select("source", "external", F.col("route").alias("owner"))
    met = new.join(other, ["source", "external"], "left").groupBy("route", "source", "external").agg(F.coalesce(F.bool_or(F.col("owner") != F.col("route")), F.lit(False)).alias("taken"))
    return met.select("route", "source", "external", F.when(F.col("taken"), "taken").otherwise("added").alias("verdict"))


def after_references(current: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The references once those added have replaced their source's on the route."""
    added = verdicts.where("verdict = 'added'").select("route", "source", "external")
    return current.select("route", "source", "external").join(added, ["route", "source"], "left_anti").unionByName(added)


def renamed(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Lines (with ``name``) that point at an old name point at the new one; ``names`` has old, new, each old one once."""
    return lines.join(names, F.col("name") == F.col("old"), "left").withColumn("name", F.coalesce("new", "name")).drop("old", "new")


def without_lines_of(lines: DataFrame, gone: DataFrame) -> DataFrame:
    """Lines (name, area) but those of removed routes: same name, and the same area or none."""
    g = gone.select(F.col("name").alias("g_name"), F.col("area").alias("g_area"))
    return lines.join(g, (F.col("name") == F.col("g_name")) & (F.col("area").isNull() | F.col("area").eqNullSafe(F.col("g_area"))), "left_anti")


def removable(vocabulary: DataFrame, used: DataFrame, asked: DataFrame, code: str = "code") -> DataFrame:
    """(code, removed) of words asked to go: only those that exist and nothing uses."""
    free = vocabulary.join(used, code, "left_anti").select(code, F.lit(True).alias("removed"))
    return asked.select(code).distinct().join(free, code, "left").select(code, F.coalesce("removed", F.lit(False)).alias("removed"))


def add_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that come in and aren't there yet; a null key equals a null key."""
    c = current.select([F.col(k).alias(f"c_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"c_{k}"))
    return incoming.select(keys).distinct().join(c, same, "left_anti")


def key_parts(rows: DataFrame, canonical: list[str]) -> DataFrame:
    """country, region, geo_country, geo_region to the parts of a record's key and notes on how they were found.

    A region's path is cut to its first part. What is missing comes from where the coordinates lie; a region there that is
    itself a canonical country becomes the country. A stated country outside the vocabulary gives way to the geocoded one,
    and a stated region that disagrees with the coordinates stays, with a note.
    """
    known = F.array(*map(F.lit, canonical))
    slugged = lambda c: text.slug(F.coalesce(c, F.lit("")))
    is_country = lambda c: F.array_contains(known, slugged(c))
    differ = lambda a, b: slugged(a) != slugged(b)
    region = F.substring_index("region", " / ", 1)
    home = F.col("geo_region").isNotNull() & is_country(F.col("geo_region"))
    foreign = F.col("country").isNotNull() & F.col("geo_country").isNotNull() & ~is_country(F.col("country")) & differ(F.col("country"), F.col("geo_country"))
    country = F.when(F.col("country").isNull(), F.when(home, F.col("geo_region")).otherwise(F.col("geo_country"))).when(foreign & F.col("region").isNotNull(), F.col("geo_country")).otherwise(F.col("country"))
    both = F.col("country").isNotNull() & F.col("region").isNotNull() & F.col("geo_region").isNotNull()
    notes = F.array_compact(
        F.array(
            F.when(F.contains("region", F.lit(" / ")), "region path cut"),
            F.when(F.col("country").isNull() & country.isNotNull(), "country from coordinates"),
            F.when(F.col("region").isNull() & F.col("geo_region").isNotNull() & ~(F.col("country").isNull() & home), "region from coordinates"),
            F.when(foreign & F.col("region").isNotNull(), "country localized"),
            F.when(both & differ(region, F.col("geo_region")) & differ(country, F.col("geo_region")), "CONFLICT"),
        )
    )
    found = F.coalesce(region, F.when(~(F.col("country").isNull() & home), F.col("geo_region")))
    return rows.withColumns({"key_country": country, "key_region": found, "notes": notes})


def area_prefix(areas: DataFrame) -> DataFrame:
    """(id, parent_id, kind, name) of areas to each one's key ``country/region/crag`` and the sector's name.

    The crag is the topmost node below the region, whatever its label; without one the region stands for it. Chains are put
    together by doubling; areas in or under a cycle have each area of it once, at its smallest distance.
    """
    below = F.col("kind").isin("sector", "crag")
    of = lambda some: F.when(some, F.col("name"))
    lower, upper = (lambda a, b, _: F.coalesce(a, b)), (lambda a, b, _: F.coalesce(b, a))
    own = {"country": of(F.col("kind") == "country"), "region": of(F.col("kind") == "region"), "crag": of(below), "lowest": of(below), "n": F.coalesce(below, F.lit(False)).cast("long")}
    folded = hierarchy.fold_up(areas, own, {"country": lower, "region": lower, "crag": upper, "lowest": lower, "n": lambda a, b, _: a + b})
    found = folded.where("NOT circular").drop("circular")
    loops = written(folded.where("circular").select("id"))
    if not loops.isEmpty():
        ring = areas.join(loops, "id", "left_semi").select("id", "parent_id")
        chain = hierarchy.ancestors(ring).join(areas.select(F.col("id").alias("ancestor"), "name", "kind"), "ancestor")
        first = lambda kind: F.min_by("name", F.when(F.col("kind") == kind, F.col("distance")))
        found = found.unionByName(chain.groupBy("id").agg(
            first("country").alias("country"), first("region").alias("region"), F.max_by("name", F.when(below, F.col("distance"))).alias("crag"),
            F.min_by("name", F.when(below, F.col("distance"))).alias("lowest"), F.count_if(below).alias("n"),
        ))
    part = lambda c, default: F.coalesce(text.slug(c), F.lit(default))
    prefix = F.concat_ws("/", part(F.col("country"), "unknown"), part(F.col("region"), "unsorted"), part(F.coalesce("crag", "region"), "unknown"))
    return found.select("id", prefix.alias("prefix"), F.when(F.col("n") > 1, F.col("lowest")).alias("sector"))


def fuzzy_matches(sheet: DataFrame, venues: DataFrame, least: float = 0.8) -> DataFrame:
    """(row, name) and (venue, name) to each venue's first row all of whose words resemble some word of the venue's name.

    Words resemble each other from a similarity of ``least`` (0.8 or more) on. Such words are equal, share two neighbouring
    letters, or are two letters and the same with one between them; so an equi-join on these, the first and last of three
    letters among them, proposes every pair of different words, and each is compared once. Rows of one name count as their
    first, and venues of one name ask once.
    """
    if least < 0.8:
        raise ValueError("least: at least 0.8, as shared letters propose the pairs")
    words = lambda df, key: df.select(F.col(key), F.explode(text.tokens(F.col("name"))).alias("word"))
    s, v = words(sheet.groupBy("name").agg(F.min("row").alias("row")), "row"), words(venues.select("name").distinct(), "name")
    pieces = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: w.substr(i, F.lit(2))))
    ends = lambda w: F.when(F.length(w) == 3, F.array(F.concat(w.substr(1, 1), w.substr(3, 1)))).otherwise(F.array().cast("array<string>"))
    keyed = lambda df, name: df.select(F.col("word").alias(name)).distinct().withColumn("piece", F.explode(F.array_union(pieces(F.col(name)), ends(F.col(name)))))
    close = keyed(s, "a").join(keyed(v, "b"), "piece").select("a", "b").distinct().where(similarity(F.col("a"), F.col("b")) >= least)
    hits = s.join(close, F.col("word") == F.col("a")).select("row", "a", "b").join(v, F.col("b") == F.col("word")).groupBy("row", "name").agg(F.count_distinct("a").alias("n"))
    sizes = s.groupBy("row").agg(F.count("*").alias("all"))
    named = hits.join(sizes, "row").where("n = all").groupBy("name").agg(F.min("row").alias("row"))
    return venues.select("venue", "name").join(named, "name").groupBy("venue").agg(F.min("row").alias("row"))


def frontier(seeds: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(id, round) of everything reachable from the seeds over (parent, child) in some rounds, each id once.

    Each round is written to the shared folder and read by the next, so that neither its plan nor its work grows with the rounds.
    """
    kept = Rounds(seeds.sparkSession)
    done = last = kept.put(seeds.select("id").distinct().withColumn("round", F.lit(0)), "done0")
    for k in range(1, rounds + 1):
        found = last.join(edges, F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct()
        last = kept.put(found.join(done, "id", "left_anti").withColumn("round", F.lit(k)), f"last{k}")
        if last.isEmpty():
            break
        done = kept.put(done.unionByName(last), f"done{k}")
        kept.drop(f"done{k - 2}", f"last{k - 1}")
    return done
