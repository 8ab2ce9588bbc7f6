"""Tags that a model suggests, checked and written back; searches for each place; lines drawn on pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a style of protection and a belay may be. Fixed values.
STYLES, BELAYS = ["gear", "bolted", "mixed", "none"], ["gear", "bolted", "mixed"]
HUMAN = "skipped: human-tagged row"


def describe(raw: DataFrame) -> DataFrame:
    """(source, id, name, grade, description) of raw records (source, record: JSON text): each source has its own fields.

    One states two grades, which are joined, and prose; the other a grade within a struct and no prose, so there is none. Records of
    other sources are left out.
    """
    field = lambda p: F.nullif(F.get_json_object("record", f"$.{p}"), F.lit(""))
    two = F.nullif(F.concat_ws(" ", field("adjectival_grade"), field("tech_grade")), F.lit(""))
    grade = F.when(F.col("source") == "logbook", two).otherwise(field("gradeAtom.grade"))
    return raw.where(F.col("source").isin("logbook", "tree")).select("source", field("id").alias("id"), field("name").alias("name"), grade.alias("grade"), F.when(F.col("source") == "logbook", field("description")).alias("description"))


def checked_tags(tags: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """Tags with what is off the vocabulary repaired, and ``flagged``: the model's own doubts, then every repair, in order.

    ``tags``: id, protection, protection_style, belays, incline, hazards (array of structs with code and evidence), character
    and feature (arrays), flagged (array). An unknown protection becomes UNSPECIFIED, other unknown words null; hazards need a
    known code and evidence; unknown characters and features go. ``vocabulary``: protection, incline, hazards, character, feature.
    """
    known = lambda c, words: F.coalesce(F.col(c).isin(*words), F.lit(False))
    good = {
        "protection": known("protection", vocabulary["protection"]),
        "protection_style": F.col("protection_style").isNull() | known("protection_style", STYLES),
        "belays": F.col("belays").isNull() | known("belays", BELAYS),
        "incline": F.col("incline").isNull() | known("incline", vocabulary["incline"]),
    }
    proven = lambda h: F.coalesce(h["code"].isin(*vocabulary["hazards"]) & (h["evidence"] != ""), F.lit(False))
    listed = lambda c: F.coalesce(F.col(c), F.array())
    inside = lambda words: lambda x: F.coalesce(x.isin(*words), F.lit(False))
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), F.coalesce(v, F.lit("None"))))
    off = lambda c: F.filter(listed(c), lambda x: ~inside(vocabulary[c])(x))
    flags = F.concat(
        listed("flagged"),
        F.array_compact(F.array(*[F.when(~ok, name) for name, ok in good.items()])),
        named("hazard", F.transform(F.filter(listed("hazards"), lambda h: ~proven(h)), lambda h: h["code"])),
        named("character", off("character")),
        named("feature", off("feature")),
    )
    return tags.select(
        "id", F.when(good["protection"], F.col("protection")).otherwise("UNSPECIFIED").alias("protection"),
        *[F.when(good[c], F.col(c)).alias(c) for c in ("protection_style", "belays", "incline")],
        F.filter(listed("hazards"), proven).alias("hazards"),
        *[F.filter(listed(c), inside(vocabulary[c])).alias(c) for c in ("character", "feature")], flags.alias("flagged"),
    )


def write_back(routes: DataFrame, hazards: DataFrame, checked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(routes after, hazards after, answers) of checked tags: a route that a human tagged stays as it is, and is told so.

    ``routes``: id, protection, protection_style, belays, incline, tagged_by and any other columns; ``hazards``: id, code,
    evidence, of which those that are there stay. Answers: id and the flags as one text, for tags of routes that exist or not.
    """
    human = routes.select("id", (F.col("tagged_by") == "human").alias("_human"))
    told = checked.join(human, "id", "left")
    free = told.where("NOT coalesce(_human, true)")  # a route that isn't there takes nothing
    fields = ["protection", "protection_style", "belays", "incline"]
    new = free.select("id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new"))
    after = routes.join(new, "id", "left").select(*[
        F.when(F.col("_new"), F.lit("llm") if c == "tagged_by" else F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in (*fields, "tagged_by") else F.col(c) for c in routes.columns
    ])
    found = free.select("id", F.posexplode("hazards").alias("n", "h")).groupBy("id", F.col("h.code").alias("code")).agg(F.min_by("h.evidence", "n").alias("evidence"))
    added = hazards.unionByName(found.join(hazards.select("id", "code"), ["id", "code"], "left_anti"))
    flags = F.when(F.coalesce("_human", F.lit(True)), F.array_append("flagged", F.lit(HUMAN))).otherwise(F.col("flagged"))
    return after, added, told.select("id", F.array_join(flags, ", ").alias("flags"))


# Searches


def place_countries(places: DataFrame, exact: DataFrame, sheet: DataFrame, norm) -> DataFrame:
    """(place, country) by a place's exact name, else its normal name in a sheet, else a row of the sheet whose words are all among the
    place's or the other way round: the first such row by its order.

    ``places``: place; ``exact``: name, country; ``sheet``: ord, area, country; ``norm`` gives a text's normal form. Rows meet
    places by a shared word, the row's or the place's rarest, so a common word makes no pairs of its own.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    asked = places.select("place", norm(F.col("place")).alias("n")).distinct().withColumn("w", words(F.col("n")))
    rows = sheet.select("ord", norm(F.col("area")).alias("area"), "country").groupBy("area").agg(F.max_by("country", "ord").alias("country"), F.min("ord").alias("ord")).withColumn("aw", words(F.col("area"))).where("size(aw) > 0")
    often = rows.select(F.explode("aw").alias("word")).union(asked.select(F.explode("w"))).groupBy("word").agg(F.count("*").alias("df"))

    def rarest(of: DataFrame, column: str, key: str) -> DataFrame:
        best = of.select(key, F.explode(column).alias("word")).join(often, "word").groupBy(key).agg(F.min_by("word", F.struct("df", "word")).alias("word"))
        return of.join(best, key)

    every = lambda of, column: of.withColumn("word", F.explode(column))
    within = F.size(F.array_except("aw", "w")) == 0
    around = F.size(F.array_except("w", "aw")) == 0
    keep = ["place", "ord", "country"]
    one = rarest(rows, "aw", "area").join(every(asked, "w"), "word").where(within).select(*keep)
    two = rarest(asked, "w", "place").join(every(rows, "aw"), "word").where(around).select(*keep)
    loose = one.union(two).groupBy("place").agg(F.min_by("country", "ord").alias("loose"))
    same = asked.join(rows.select(F.col("area").alias("n"), F.col("country").alias("listed")), "n", "left").select("place", "listed")
    told = exact.groupBy(F.col("name").alias("place")).agg(F.max("country").alias("told"))
    joined = same.join(told, "place", "left").join(loose, "place", "left")
    return joined.select("place", F.coalesce("told", "listed", "loose", F.lit("")).alias("country"))


def search_plan(places: DataFrame, home: list[str], locales: dict[str, tuple[str, str, str, str]], forums: str) -> DataFrame:
    """(place, pos, tag, query, domain) of the searches for each place (place, name, country): a broad one for each, one of the forums at
    home or where the country isn't known, and one in the country's language where that is known.

    ``locales``: lower-case country to (domain, country code, language, word for the sport).
    """
    low = F.lower(F.trim(F.coalesce("country", F.lit(""))))
    quoted = F.concat(F.lit('"'), F.col("name"), F.lit('"'))
    of = lambda i: F.create_map(*[F.lit(x) for c, v in locales.items() for x in (c, v[i])])[low]
    one = lambda tag, query, domain: F.struct(F.lit(tag).alias("tag"), query.alias("query"), domain.alias("domain"))
    uk = F.lit("google.co.uk")
    second = F.when(low.isin("", *home), one("forums", F.concat(quoted, F.lit(f" climbing {forums}")), uk)).when(of(0).isNotNull(), one("local", F.concat(quoted, F.lit(" "), of(3)), of(0)))
    plan = F.array_compact(F.array(one("broad", F.concat(quoted, F.lit(" climbing")), uk), second))
    return places.select("place", F.posexplode(plan).alias("pos", "q")).select("place", (F.col("pos") + 1).alias("pos"), "q.*")


# Lines on pictures


def put_lines(lines: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines after, answers) of requests (request, topo, route, points: array of x and y) that draw or remove (no points) a line.

    A line needs two points or more, all between 0 and 1; they are rounded to five places. The latest good request for a topo
    and route holds. Answers: request and why it was refused, null if it wasn't.
    """
    off = F.exists("points", lambda p: F.coalesce((F.size(p) != 2) | F.exists(p, lambda v: F.coalesce((v < 0) | (v > 1), F.lit(True))), F.lit(True)))
    problem = F.when(F.size("points") == 1, "a line needs at least two points").when(F.col("points").isNotNull() & off, "points must lie within the picture")
    answers = requests.select("request", "topo", "route", "points", problem.alias("problem"))
    last = answers.where("problem IS NULL").groupBy("topo", "route").agg(F.max_by("points", "request").alias("_points"), F.lit(True).alias("_asked"))
    joined = lines.join(last, ["topo", "route"], "full_outer")
    points = F.transform("_points", lambda p: F.transform(p, lambda v: F.round(v, 5)))
    now = F.when(F.col("_asked"), F.when(F.size("_points") > 0, points)).otherwise(F.col("points"))
    return joined.select("topo", "route", now.alias("points")).where("points IS NOT NULL"), answers.select("request", "problem")


def import_topos(found: DataFrame, refs: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new media, new lines) of pictures found at a source (external_id, uri, width, height, points in pixels).

    The route is the one that ``refs`` (external_id, route) names; pictures of unknown routes, of pictures that ``media`` (uri)
    has, and without a size are left out. Points are scaled to the picture, held within it, and rounded to five places; a line
    needs two of them. Of pictures that repeat a uri the first by external id counts.
    """
    known = found.join(refs, "external_id").join(media.select("uri"), "uri", "left_anti").where("width > 0 AND height > 0")
    first = Window.partitionBy("uri").orderBy("external_id", "route")
    once = known.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    scaled: Column = F.transform("points", lambda p: F.array(*[F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p[i] / F.col(side))), 5) for i, side in enumerate(("width", "height"))]))
    return once.select("uri", "width", "height"), once.select("uri", "route", scaled.alias("points")).where("size(points) >= 2")
