"""Requests of curators against routes and vocabularies: what each is answered, and the tables after all accepted ones.

Requests are numbered; where the outcome of one depends on others (a later value of a field, a name taken first), the smaller
number goes first. Nothing is applied row by row: rules give each request its problem, accepted ones meet the table in joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.lineage import numbered


def _first_problem(*rules: tuple[Column, str | Column]) -> Column:
    """The text of the first rule that is broken; null if none is. A null rule counts as kept."""
    out = None
    for broken, said in rules:
        out = F.when(F.coalesce(broken, F.lit(False)), said) if out is None else out.when(F.coalesce(broken, F.lit(False)), said)
    return out


def answer_patches(routes: DataFrame, requests: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(request, id, problem) of patches (request, id, body: map of texts) by the first rule that each breaks.

    ``kinds``: the fields that may be patched, as ``text``, ``int`` or ``bool``; ``lat`` and ``lon`` come as a pair, too. An
    unknown route, a body without such a field, a value that isn't a whole number where one is needed (null clears it), a
    coordinate that is missing, no number or out of range.
    """
    keys = F.map_keys("body")
    fields = F.filter(keys, lambda k: k.isin(*kinds))
    coords = F.exists(keys, lambda k: k.isin("lat", "lon"))
    numbers = [f for f, kind in kinds.items() if kind == "int"]
    wrong = F.array_sort(F.filter(fields, lambda k: k.isin(*numbers) & F.col("body")[k].isNotNull() & F.trim(F.col("body")[k]).try_cast("int").isNull()))
    lat, lon = (F.col("body")[c].try_cast("double") for c in ("lat", "lon"))
    known = routes.select("id", F.lit(True).alias("_there"))
    problem = _first_problem(
        (F.col("_there").isNull(), "no such route"),
        ((F.size(fields) == 0) & ~coords, "nothing to patch"),
        (F.size(wrong) > 0, F.concat(F.replace(F.get(wrong, F.lit(0)), F.lit("_"), F.lit(" ")), F.lit(" must be a whole number"))),
        (coords & (lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon)), "lat and lon must both be numbers"),
        (coords & ~(lat.between(-90, 90) & lon.between(-180, 180)), "lat/lon out of range"),
    )
    return requests.join(known, "id", "left").select("request", "id", problem.alias("problem"), "body")


def apply_patches(routes: DataFrame, answered: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``routes`` after the patches without a problem: of several values for a field the one of the latest request holds."""
    each = answered.where("problem IS NULL").select("id", "request", F.explode("body").alias("field", "value")).where(F.col("field").isin(*kinds, "lat", "lon"))
    last = each.groupBy("id", "field").agg(F.max(F.struct("request", "value")).alias("m"))
    held = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("m.value").alias("v")))).alias("_new"))  # one for each field
    typed = {"text": lambda v: v, "int": lambda v: F.trim(v).try_cast("int"), "bool": lambda v: F.lower(v).isin("true", "yes", "1"), "double": lambda v: v.try_cast("double")}
    out = []
    for c in routes.columns:
        kind = kinds.get(c, "double" if c in ("lat", "lon") else None)
        value = F.col("_new")[c]
        out.append(F.when(F.array_contains(F.map_keys("_new"), c), typed[kind](value)).otherwise(F.col(c)).alias(c) if kind else F.col(c))
    return routes.join(held, "id", "left").select(*out)


def create_routes(routes: DataFrame, areas: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, problem, id, name, area_id) of new routes (request, name, area_id): a draft with the next id, or why not.

    It needs a name and an area that exists, and no route of that name (whatever its case) in the area, be it of an earlier
    request. Ids go on from the largest, in the order of the requests.
    """
    asked = requests.select("request", F.trim(F.coalesce("name", F.lit(""))).alias("name"), "area_id").withColumn("_low", F.lower("name"))
    known = areas.select(F.col("id").alias("area_id"), F.lit(True).alias("_area"))
    taken = routes.select("area_id", F.lower("name").alias("_low"), F.lit(True).alias("_taken")).distinct()
    joined = asked.join(known, "area_id", "left").join(taken, ["area_id", "_low"], "left")
    problem = _first_problem((F.col("name") == "", "a new climb needs a name"), (F.col("_area").isNull(), "no such area"), (F.col("_taken"), "a route with that name exists in this area"))
    judged = joined.withColumn("problem", problem)
    first = judged.where("problem IS NULL").groupBy("area_id", "_low").agg(F.min("request").alias("_first"))
    judged = judged.join(first, ["area_id", "_low"], "left").withColumn("problem", F.when(F.col("problem").isNull() & (F.col("request") != F.col("_first")), "a route with that name exists in this area").otherwise(F.col("problem")))
    given = numbered(judged.where("problem IS NULL").select("request"), "request", "id", routes.agg(F.max("id")).scalar())
    return judged.join(given, "request", "left").select("request", "problem", "id", "name", "area_id")


def change_status(routes: DataFrame, requests: DataFrame, grade_problem: Column) -> tuple[DataFrame, DataFrame]:
    """(answers, routes after) for requests (request, id, what): publish, draft, quarantined, delete or fieldcheck.

    One request a route at a time: of several for a route the earliest is taken, the others are told to ask again. Publishing
    needs a grade without a problem (``grade_problem`` over the route, null if fine) and no open field check, and makes the
    route the curator's. A published route can't be deleted. ``fieldcheck`` turns the flag over. Routes: id, status, tagged_by,
    needs_field_check and any other columns.
    """
    turn = Window.partitionBy("id").orderBy("request")
    asked = requests.withColumn("_turn", F.row_number().over(turn))
    known = routes.select("id", "status", F.coalesce("needs_field_check", F.lit(False)).alias("_check"), grade_problem.alias("_grade"), F.lit(True).alias("_there"))
    what = F.col("what")
    problem = _first_problem(
        (F.col("_there").isNull(), "no such route"),
        (F.col("_turn") > 1, "another request came first"),
        (~what.isin("publish", "draft", "quarantined", "delete", "fieldcheck"), "status must be draft or quarantined"),
        ((what == "publish") & F.col("_grade").isNotNull(), F.concat(F.lit("grade check: "), F.col("_grade"))),
        ((what == "publish") & F.col("_check"), "needs field check"),
        ((what == "delete") & (F.col("status") == "publish"), "unpublish first"),
    )
    answers = asked.join(known, "id", "left").select("request", "id", "what", problem.alias("problem"))
    done = answers.where("problem IS NULL").select("id", F.col("what").alias("_what"))
    joined = routes.join(done, "id", "left").where("_what IS NULL OR _what <> 'delete'")
    now = {
        "status": F.when(F.col("_what").isin("publish", "draft", "quarantined"), F.col("_what")).otherwise(F.col("status")),
        "tagged_by": F.when(F.col("_what") == "publish", "human").otherwise(F.col("tagged_by")),
        "needs_field_check": F.when(F.col("_what") == "fieldcheck", ~F.coalesce("needs_field_check", F.lit(False))).otherwise(F.col("needs_field_check")),
    }
    return answers, joined.select(*[now.get(c, F.col(c)).alias(c) for c in routes.columns])


def change_vocabulary(words: DataFrame, uses: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, words after) for requests (request, family, code, what: add, edit or delete, meaning, kind).

    ``words``: family, code, meaning, kind; ``uses``: family, code, one row for each use. A new code is one token of at most 40
    characters without quotes, angle brackets, backslashes or semicolons, has a meaning, for a hazard a kind (route or
    objective), and isn't there yet. An edit needs something to change and a word that is there. Words in use can't be deleted.
    Of several requests for a word the earliest is taken.
    """
    key = ["family", "code"]
    asked = requests.withColumn("code", F.trim(F.coalesce("code", F.lit("")))).withColumn("_turn", F.row_number().over(Window.partitionBy(*key).orderBy("request")))
    there = words.select(*key, F.lit(True).alias("_there"))
    families = words.select("family").distinct().withColumn("_family", F.lit(True))
    used = uses.groupBy(*key).agg(F.count("*").alias("_uses"))
    joined = asked.join(there, key, "left").join(families, "family", "left").join(used, key, "left")
    what, bare = F.col("what"), F.trim(F.coalesce("meaning", F.lit(""))) == ""
    add, edit, delete = what == "add", what == "edit", what == "delete"
    problem = _first_problem(
        (F.col("_family").isNull(), "unknown family"),
        (F.col("_turn") > 1, "another request came first"),
        (add & ((F.col("code") == "") | (F.length("code") > 40) | F.col("code").rlike(r"""[\s'"<>\\;`]""")), "code must be one token"),
        (add & (F.col("family") == "hazard") & ~F.coalesce(F.col("kind").isin("route", "objective"), F.lit(False)), "hazard needs kind"),
        (add & bare, "a new value needs a meaning"),
        (add & F.col("_there"), "already exists"),
        (edit & F.col("meaning").isNull() & F.col("kind").isNull(), "nothing editable"),
        ((edit | delete) & F.col("_there").isNull(), "not in family"),
        (delete & (F.col("_uses") > 0), F.concat(F.lit("used by "), F.col("_uses").cast("string"))),
        (~(add | edit | delete), "unknown request"),
    )
    answers = joined.select("request", *key, "what", "meaning", "kind", problem.alias("problem"))
    done = answers.where("problem IS NULL").select(*key, F.col("what").alias("_what"), F.col("meaning").alias("_meaning"), F.col("kind").alias("_kind"))
    kept = words.join(done, key, "left").where("_what IS NULL OR _what <> 'delete'").select(*key, F.coalesce("_meaning", "meaning").alias("meaning"), F.coalesce("_kind", "kind").alias("kind"))
    made = done.where("_what = 'add'").select(*key, F.col("_meaning").alias("meaning"), F.col("_kind").alias("kind"))
    return answers.select("request", *key, "what", "problem"), kept.unionByName(made)
