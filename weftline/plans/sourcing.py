"""Landed payloads of sources, tags written back, searches for places, lines on pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import flights, writeback
from weftline.operators.search import vocabularies
from weftline.plans.choices import _KM
from weftline.plans.common import Plans, load
from weftline.sources import adapters, payloads

PLANS = Plans()


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Route sources


def _areas(spark, sf_dir):
    """Each customer as an area answer, with its orders as climbs; every 40th isn't JSON."""
    n, k = F.col("c_custkey"), F.col("o_orderkey")
    grades = F.create_map(F.lit("yds"), F.when(k % 3 == 0, "V5").when(k % 3 == 1, "5.9").otherwise(""), F.lit("french"), F.when(k % 2 == 0, "6a"))
    climb = F.struct(
        k.cast("string").alias("uuid"), _text("c", k).alias("name"), F.when(k % 4 == 0, -1).otherwise((k % 50).cast("int")).alias("length"), (k % 7 - 1).cast("int").alias("boltsCount"), F.when(k % 5 == 0, "pg13").otherwise("none").alias("safety"),
        grades.alias("grades"), F.create_map(F.lit("trad"), k % 2 == 0, F.lit("sport"), k % 3 == 0, F.lit("odd"), F.lit(True)).alias("type"),
    )
    # As many tasks as there are cores to read the answers: orders are few bytes, what is made of them is many.
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(8 * spark.sparkContext.defaultParallelism, "o_custkey")
    climbs = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_json(F.collect_list(climb)).alias("climbs"))
    customer = load(spark, sf_dir, "customer").join(climbs, "c_custkey", "left")
    child = _text('{"uuid": "u', n, '", "areaName": "below", "totalClimbs": ', n % 3, "}")
    payload = _text('{"uuid": "', n, '", "areaName": "A', n, '", "gradeContext": ', F.when(n % 3 == 0, '"FR"').when(n % 3 == 1, '"xx"').otherwise("null"), ', "pathTokens": ["Land", "Middle", "Low", "A"], "metadata": {"lat": 1.5, "lng": ', n % 90, '}, "children": [', child, '], "climbs": ', F.coalesce("climbs", F.lit("null")), "}")
    return customer.select(n.alias("item"), F.when(n % 40 == 0, "<html>").otherwise(payload).alias("payload"))


@PLANS.plan(
    "src_17_graph_routes",
    """SELECT o_custkey AS item, CAST(o_orderkey AS VARCHAR) AS source_id, 'Land' AS country, 'Middle / Low' AS region, CAST(o_custkey % 90 AS DOUBLE) AS lon, g AS grade, CASE WHEN g IS NULL THEN NULL WHEN o_custkey % 3 = 0 THEN 'french' WHEN starts_with(g, 'V') THEN 'vscale' ELSE 'yds' END AS grade_system,
    CAST(CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 50 > 0 THEN o_orderkey % 50 END AS INT) AS length_m, CAST(CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 7 - 1 END AS INT) AS bolts, CASE WHEN o_orderkey % 5 = 0 THEN 'PG-13' END AS protection,
    concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'trad' END, CASE WHEN o_orderkey % 3 = 0 THEN 'sport' END) AS disciplines
    FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '6a' END ELSE CASE o_orderkey % 3 WHEN 0 THEN 'V5' WHEN 1 THEN '5.9' END END AS g FROM orders) WHERE o_custkey % 40 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer)""",
)
def graph_routes(spark, sf_dir):
    places, _ = payloads.graph_areas(_areas(spark, sf_dir))
    each = places.where("rejected IS NULL").select("item", "country", "region", "lon", F.explode("routes").alias("r"))
    return each.select("item", "r.source_id", "country", "region", "lon", "r.grade", "r.grade_system", "r.length_m", "r.bolts", "r.protection", F.array_join("r.disciplines", ",").alias("disciplines"))


@PLANS.plan("src_17_graph_next", "SELECT c_custkey AS parent, 'u' || c_custkey AS id FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 40 <> 0")
def graph_next(spark, sf_dir):
    return payloads.graph_areas(_areas(spark, sf_dir))[1].select("parent", "id")


@PLANS.plan(
    "src_18_search_results",
    """SELECT c_custkey % 50 AS item, 's' || c_custkey AS id, 'Marc''s & ' || c_custkey AS name, CASE c_custkey % 5 WHEN 0 THEN 'gritstone' WHEN 1 THEN 'schist' WHEN 2 THEN 'limestone' END AS rock, CAST(NULL AS VARCHAR) AS rejected FROM customer
    WHERE c_custkey % 50 NOT IN (7, 8) AND c_custkey % 60 BETWEEN 10 AND 40 UNION ALL SELECT DISTINCT c_custkey % 50, NULL, NULL, NULL, CASE c_custkey % 50 WHEN 7 THEN 'not a JSON object' ELSE 'no success' END FROM customer WHERE c_custkey % 50 IN (7, 8)""",
)
def search_results(spark, sf_dir):
    """Answers in a viewer's page, escaped twice, trimmed to the box; a blocked one and one without success are told."""
    n = F.col("c_custkey")
    rock = F.when(n % 5 == 0, "Grit (hard)").when(n % 5 == 1, "mica schist").when(n % 5 == 2, " Limestone").otherwise("UNKNOWN")
    result = _text('{"slug": "s', n, '", "name": "Marc&amp;#039;s &amp;amp; ', n, '", "osy": ', n % 60, ', "osx": 5, "rocktype_name": "', rock, '"}')
    answers = load(spark, sf_dir, "customer").groupBy((n % 50).alias("item")).agg(F.array_join(F.collect_list(result), ", ").alias("all"))
    page = F.when(F.col("item") == 7, "Just a moment").when(F.col("item") == 8, '{"success": false}').otherwise(_text("<html><pre style=x>", '{"success": true, "results": [', F.col("all"), "]}</pre></html>"))
    return payloads.search_results(answers.select("item", page.alias("payload")), (10.0, 0.0, 40.0, 20.0)).select("item", "id", "name", "rock", "rejected")


@PLANS.plan(
    "src_23_waypoints",
    """SELECT o_custkey AS item, CASE o_custkey % 3 WHEN 0 THEN 'Eng ' WHEN 1 THEN 'Fra ' ELSE 'Cat ' END || o_custkey AS place, CASE WHEN o_custkey % 2 = 0 THEN 'limestone' END AS rock, CAST(o_orderkey AS VARCHAR) AS source_id, '?' AS name,
    CASE o_orderkey % 3 WHEN 0 THEN '6b' WHEN 1 THEN 'TD' END AS grade, concat_ws(',', CASE WHEN o_orderkey % 2 = 0 THEN 'ice' END, 'alpine', CASE WHEN o_orderkey % 5 = 0 THEN 'multi-pitch' END) AS disciplines, true AS there FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
)
def waypoint_routes(spark, sf_dir):
    k, n = F.col("o_orderkey"), F.col("c_custkey")
    route = _text('{"document_id": ', k, ', "rock_free_rating": ', F.when(k % 3 == 0, '"6b"').otherwise("null"), ', "global_rating": ', F.when(k % 3 == 1, '"TD"').otherwise('""'), ', "activities": [', F.when(k % 2 == 0, '"ice_climbing", ').otherwise(""), '"mountain_climbing"], "climbing_outdoor_type": "', F.when(k % 5 == 0, "multi").otherwise("single"), '"}')
    routes = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.collect_list(route), ", ").alias("all"))
    title = lambda lang, name: _text('{"lang": "', lang, '", "title": "', name, " ", n, '"}')
    locales = F.when(n % 3 == 0, _text(title("fr", "Fra"), ", ", title("en", "Eng"))).when(n % 3 == 1, _text('{"lang": "en", "title": ""}, ', title("fr", "Fra"))).otherwise(title("ca", "Cat"))
    x, y = F.format_string("%.3f", F.lit(20037508.342789244) * (n % 90) / 180), F.lit("5621521.486")
    payload = _text('{"waypoint": {"document_id": ', n, ', "rock_types": ["odd"', F.when(n % 2 == 0, ', " Calcaire"').otherwise(""), '], "geometry": {"geom": "{\\"coordinates\\": [', x, ", ", y, ']}"}, "locales": [', locales, ']}, "routes": [', F.col("all"), "]}")
    found = payloads.waypoints(load(spark, sf_dir, "customer").join(routes, "c_custkey").select(n.alias("item"), payload.alias("payload")))
    there = (F.abs(F.col("lon") - F.col("item") % 90) < 1e-6) & (F.abs(F.col("lat") - 45) < 0.1)
    each = found.select("item", F.col("name").alias("place"), "rock", there.alias("there"), F.explode("routes").alias("r"))
    return each.select("item", "place", "rock", "r.source_id", "r.name", "r.grade", F.array_join("r.disciplines", ",").alias("disciplines"), "there")


# Weather, tides, lodging


@PLANS.plan("src_07_archive", "SELECT o_custkey AS venue, CAST(o_orderkey AS VARCHAR) AS time, o_totalprice AS tmax, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice + 1 END AS rain, CAST(NULL AS DOUBLE) AS cloud FROM orders")
def archive(spark, sf_dir):
    days = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    daily = F.struct(F.transform("d", lambda x: x["o_orderkey"].cast("string")).alias("time"), F.col("d.o_totalprice").alias("temperature_2m_max"), F.transform("d", lambda x: F.when(x["o_orderkey"] % 3 != 0, x["o_totalprice"] + 1)).alias("precipitation_sum"))
    landed = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("venue")).agg(days.alias("d")).select("venue", F.to_json(F.struct(daily.alias("daily")), {"ignoreNullFields": "false"}).alias("payload"))
    return payloads.archive_days(landed).select("venue", "time", F.col("temperature_2m_max").alias("tmax"), F.col("precipitation_sum").alias("rain"), F.col("cloud_cover_mean").alias("cloud"))


@PLANS.plan("src_10_tides", "SELECT user_id AS venue, CAST(event_id AS VARCHAR) AS time, value AS metres FROM events WHERE value IS NOT NULL AND event_id % 4 <> 0")
def tides(spark, sf_dir):
    hours = F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))))
    hourly = F.struct(F.transform("d", lambda x: x["event_id"].cast("string")).alias("time"), F.col("d.v").alias("sea_level_height_msl"))
    landed = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("venue")).agg(hours.alias("d")).select("venue", F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"}).alias("payload"))
    return payloads.tide_hours(landed)


@PLANS.plan(
    "src_12_lodgings",
    f"""WITH e AS (SELECT o_custkey AS venue, o_orderkey AS k, 50 + (o_orderkey % 300)::DOUBLE / 1000 AS la, 5.0 AS lo, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders JOIN customer ON c_custkey = o_custkey),
    d AS (SELECT *, round({_KM('50.0', '5.0', 'la', 'lo')}, 1) AS km FROM e WHERE k % 5 <> 0 AND k % 7 <> 0)
    SELECT venue, 'Inn ' || k AS name, CASE WHEN k % 2 = 0 THEN 'hotel' ELSE 'camp_site' END AS kind, km, CASE k % 3 WHEN 0 THEN 'w' WHEN 1 THEN 'c' ELSE '' END AS web, CAST(row_number() OVER (PARTITION BY venue ORDER BY km, ord) AS INT) AS pos FROM d WHERE km <= 15""",
)
def lodging(spark, sf_dir):
    k = F.col("o_orderkey")
    lat = 50 + (k % 300).cast("double") / 1000
    point = F.struct(lat.alias("lat"), F.lit(5.0).alias("lon"))
    name = F.when(k % 7 != 0, _text(" Inn ", k)).otherwise(" ")
    kind = F.when(k % 5 == 0, "museum").when(k % 2 == 0, "hotel").otherwise("camp_site")
    tags = F.map_filter(F.create_map(F.lit("name"), name, F.lit("tourism"), kind, F.lit("website"), F.when(k % 3 == 0, "w"), F.lit("contact:website"), F.when(k % 3 == 1, "c")), lambda _, v: v.isNotNull())
    element = F.struct(k.alias("id"), F.when(k % 4 != 0, lat).alias("lat"), F.when(k % 4 != 0, 5.0).alias("lon"), F.when(k % 4 == 0, point).alias("center"), tags.alias("tags"))
    landed = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("venue")).agg(F.collect_list(F.struct(k, element.alias("e"))).alias("l"))
    ordered = F.transform(F.array_sort("l", lambda a, b: F.when(a["o_orderkey"] < b["o_orderkey"], -1).otherwise(1)), lambda x: x["e"])
    venues = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("venue"), F.lit(50.0).alias("lat"), F.lit(5.0).alias("lon"))
    return payloads.lodgings(landed.select("venue", F.to_json(F.struct(ordered.alias("elements"))).alias("payload")), venues)


# Tags written back


VOCABULARY = {"protection": ["G", "PG", "R"], "incline": ["slab", "wall"], "hazards": ["loose", "tidal"], "character": ["crack"], "feature": ["arete", "roof"]}


def _tags(spark, sf_dir):
    n = F.col("p_partkey")
    hazard = lambda code, evidence: F.struct(F.lit(code).alias("code"), F.lit(evidence).cast("string").alias("evidence"))
    tags = load(spark, sf_dir, "part").where("p_partkey % 7 <> 6").select(
        F.when(n % 29 == 0, n + 10_000_000).otherwise(n).alias("id"), F.when(n % 4 == 0, "G").when(n % 4 == 1, "Z").alias("protection"), F.when(n % 3 == 0, "odd").when(n % 3 == 1, "gear").alias("protection_style"),
        F.when(n % 5 == 0, "none").alias("belays"), F.when(n % 2 == 0, "slab").otherwise("steep").alias("incline"), F.array(hazard("loose", "seen"), hazard("tidal", ""), hazard("bees", "x")).alias("hazards"),
        F.array(F.lit("crack"), F.lit("jam")).alias("character"), F.when(n % 2 == 0, F.array(F.lit("roof"))).alias("feature"), F.when(n % 10 == 0, F.array(F.lit("grade"))).alias("flagged"),
    )
    routes = load(spark, sf_dir, "part").select(n.alias("id"), F.lit("R").alias("protection"), F.lit("mixed").alias("protection_style"), F.lit("gear").alias("belays"), F.lit("wall").alias("incline"), F.when(n % 11 == 0, "human").otherwise("source").alias("tagged_by"))
    hazards = load(spark, sf_dir, "part").where("p_partkey % 13 = 0").select(n.alias("id"), F.lit("loose").alias("code"), F.lit("old").alias("evidence"))
    return writeback.write_back(routes, hazards, writeback.checked_tags(tags, VOCABULARY))


_TAGGED = "t AS (SELECT p_partkey AS n, CASE WHEN p_partkey % 29 = 0 THEN p_partkey + 10000000 ELSE p_partkey END AS id FROM part WHERE p_partkey % 7 <> 6), w AS (SELECT * FROM t WHERE id = n AND n % 11 <> 0)"


@PLANS.plan("pj_19_tagged_routes", f"""WITH {_TAGGED} SELECT p_partkey AS id, CASE WHEN w.id IS NULL THEN 'R' WHEN n % 4 = 0 THEN 'G' ELSE 'UNSPECIFIED' END AS protection, CASE WHEN w.id IS NULL THEN 'mixed' WHEN n % 3 = 1 THEN 'gear' END AS protection_style, CASE WHEN w.id IS NULL THEN 'gear' END AS belays,
CASE WHEN w.id IS NULL THEN 'wall' WHEN n % 2 = 0 THEN 'slab' END AS incline, CASE WHEN p_partkey % 11 = 0 THEN 'human' WHEN w.id IS NULL THEN 'source' ELSE 'llm' END AS tagged_by FROM part LEFT JOIN w ON w.id = p_partkey""")
def tagged_routes(spark, sf_dir):
    return _tags(spark, sf_dir)[0]


@PLANS.plan("pj_19_tagged_hazards", f"WITH {_TAGGED} SELECT p_partkey AS id, 'loose' AS code, 'old' AS evidence FROM part WHERE p_partkey % 13 = 0 UNION ALL SELECT id, 'loose', 'seen' FROM w WHERE n % 13 <> 0")
def tagged_hazards(spark, sf_dir):
    return _tags(spark, sf_dir)[1]


@PLANS.plan("pj_19_tag_flags", f"""WITH {_TAGGED} SELECT id, concat_ws(', ', CASE WHEN n % 10 = 0 THEN 'grade' END, CASE WHEN n % 4 <> 0 THEN 'protection' END, CASE WHEN n % 3 = 0 THEN 'protection_style' END, CASE WHEN n % 5 = 0 THEN 'belays' END, CASE WHEN n % 2 = 1 THEN 'incline' END,
'hazard:tidal, hazard:bees, character:jam', CASE WHEN n % 11 = 0 OR id <> n THEN 'skipped: human-tagged row' END) AS flags FROM t""")
def tag_flags(spark, sf_dir):
    return _tags(spark, sf_dir)[2]


@PLANS.plan("pj_19_described", "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'logbook' ELSE 'tree' END AS source, CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'HVS' ELSE 'HVS 5a' END ELSE 'VS 4c' END AS grade, CASE WHEN p_partkey % 2 = 0 THEN 'prose' END AS description FROM part WHERE p_partkey % 9 <> 0")
def described(spark, sf_dir):
    n = F.col("p_partkey")
    one = _text('{"id": ', n, ', "name": "', F.col("p_name"), '", "adjectival_grade": "HVS", "tech_grade": "', F.when(F.col("p_size") % 3 == 0, "").otherwise("5a"), '", "description": "prose"}')
    two = _text('{"id": ', n, ', "name": "', F.col("p_name"), '", "gradeAtom": {"grade": "VS 4c"}, "description": "hidden"}')
    source = F.when(n % 9 == 0, "other").when(n % 2 == 0, "logbook").otherwise("tree")
    return writeback.describe(load(spark, sf_dir, "part").select(source.alias("source"), F.when(n % 2 == 0, one).otherwise(two).alias("record")))


# Searches, lines


LOCALES = {"italia": ("google.it", "it", "it", "arrampicata"), "france": ("google.fr", "fr", "fr", "escalade")}


@PLANS.plan(
    "pj_22_search_plan",
    """WITH p AS (SELECT c_custkey, 'West Rock' || c_custkey % 40 || ' (East)' AS place FROM customer WHERE c_custkey < 1000000), s AS (SELECT s_suppkey AS ord, CASE s_suppkey % 3 WHEN 0 THEN 'rock' || s_suppkey WHEN 1 THEN 'EAST west rock' || s_suppkey % 40 ELSE 'Far rock' || s_suppkey || ' lost' END AS area, CASE s_suppkey % 4 WHEN 0 THEN ' Italia' WHEN 1 THEN 'UK' WHEN 2 THEN 'France' ELSE 'Chile' END AS country FROM supplier WHERE s_suppkey < 30),
    c AS (SELECT DISTINCT place, 'rock' || substr(split_part(place, ' ', 2), 5) AS w FROM p), m AS (SELECT place, first(country ORDER BY ord) AS country FROM c JOIN s ON list_has_all(['west', w, 'east'], string_split(lower(area), ' ')) OR list_has_all(string_split(lower(area), ' '), ['west', w, 'east']) GROUP BY place),
    l AS (SELECT c.place, lower(trim(coalesce(m.country, ''))) AS low FROM c LEFT JOIN m USING (place))
    SELECT place, 1 AS pos, 'broad' AS tag, '"East" climbing' AS query, 'google.co.uk' AS domain FROM l UNION ALL SELECT place, 2, CASE WHEN low IN ('', 'uk') THEN 'forums' ELSE 'local' END, CASE low WHEN 'italia' THEN '"East" arrampicata' WHEN 'france' THEN '"East" escalade' ELSE '"East" climbing site:f' END,
    CASE low WHEN 'italia' THEN 'google.it' WHEN 'france' THEN 'google.fr' ELSE 'google.co.uk' END FROM l WHERE low <> 'chile'""",
)
def searches(spark, sf_dir):
    """A place's country by the words that it shares with a sheet's row, then the searches for it."""
    n, s = F.col("c_custkey"), F.col("s_suppkey")
    places = load(spark, sf_dir, "customer").select(_text("West Rock", n % 40, " (East)").alias("place")).distinct()
    area = F.when(s % 3 == 0, _text("rock", s)).when(s % 3 == 1, _text("EAST west rock", s % 40)).otherwise(_text("Far rock", s, " lost"))
    country = F.element_at(F.array(*map(F.lit, [" Italia", "UK", "France", "Chile"])), (s % 4 + 1).cast("int"))
    sheet = load(spark, sf_dir, "supplier").where("s_suppkey < 30").select(s.alias("ord"), area.alias("area"), country.alias("country"))
    found = writeback.place_countries(places, sheet.select(F.lit("nowhere").alias("name"), "country"), sheet, text.norm_name)
    return writeback.search_plan(found.withColumn("name", text.search_name(F.col("place"))), ["uk", "ireland"], LOCALES, "site:f")


def _lines(spark, sf_dir):
    n = F.col("l_orderkey")
    point = lambda a, b: F.array(F.lit(a).cast("double") if not hasattr(a, "cast") else a.cast("double"), F.lit(b).cast("double"))
    x = (n % 100) / 99
    points = F.when(n % 5 == 0, F.array(point(x, 0.5))).when(n % 5 == 1, F.array(point(x, 0.5), point(1.5, 0))).when(n % 5 == 2, F.lit(None).cast("array<array<double>>")).otherwise(F.array(point(x, 0.5), point(x, 1)))
    requests = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(n.alias("request"), (n % 300).alias("topo"), (F.col("l_partkey") % 7).alias("route"), points.alias("points"))
    there = load(spark, sf_dir, "part").select((F.col("p_partkey") % 300).alias("topo"), (F.floor(F.col("p_partkey") / 300) % 7).alias("route"), F.array(point(0, 0), point(1, 1)).alias("points")).dropDuplicates(["topo", "route"])
    return writeback.put_lines(there, requests)


@PLANS.plan(
    "pj_20_lines",
    """WITH t AS (SELECT DISTINCT p_partkey % 300 AS topo, p_partkey // 300 % 7 AS route FROM part), q AS (SELECT l_orderkey AS n, l_orderkey % 300 AS topo, l_partkey % 7 AS route FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 5 NOT IN (0, 1)),
    g AS (SELECT topo, route, max(n) AS n FROM q GROUP BY ALL) SELECT coalesce(t.topo, g.topo) AS topo, coalesce(t.route, g.route) AS route, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE round((n % 100)::DOUBLE / 99, 5) + 0.0 END AS x, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS y FROM t FULL JOIN g USING (topo, route) WHERE n IS NULL OR n % 5 <> 2""",
)
def lines(spark, sf_dir):
    first = F.get("points", F.lit(0))
    return _lines(spark, sf_dir)[0].select("topo", "route", (first[0] + 0.0).alias("x"), first[1].alias("y"))


@PLANS.plan("pj_20_line_answers", "SELECT l_orderkey AS request, CASE l_orderkey % 5 WHEN 0 THEN 'a line needs at least two points' WHEN 1 THEN 'points must lie within the picture' END AS problem FROM lineitem WHERE l_linenumber = 1")
def line_answers(spark, sf_dir):
    return _lines(spark, sf_dir)[1]


@PLANS.plan(
    "pj_29_imported_lines",
    """WITH f AS (SELECT l_orderkey AS k, 'e' || l_partkey AS ext, 'u' || l_orderkey AS uri, l_partkey AS route FROM lineitem WHERE l_partkey % 3 <> 0 AND l_orderkey % 4 <> 0 AND l_orderkey % 9 <> 0)
    SELECT uri, route, round(least(1.0::DOUBLE, (k % 700)::DOUBLE / 630), 5) + 0.0 AS x, 1.0::DOUBLE AS y FROM f QUALIFY row_number() OVER (PARTITION BY uri ORDER BY ext, route) = 1""",
)
def imported(spark, sf_dir):
    """Pictures by external ids; those that are there, of unknown routes, or without a size are left out."""
    n = F.col("l_orderkey")
    points = F.array(F.array((n % 700).cast("double"), F.lit(480.0)), F.array(F.lit(-5.0), F.lit(0.0)))
    found = load(spark, sf_dir, "lineitem").select(_text("e", F.col("l_partkey")).alias("external_id"), _text("u", n).alias("uri"), F.when(n % 9 != 0, 630).alias("width"), F.lit(480).alias("height"), points.alias("points"))
    refs = load(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(_text("e", F.col("p_partkey")).alias("external_id"), F.col("p_partkey").alias("route"))
    media = load(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(_text("u", F.col("o_orderkey")).alias("uri"))
    first = F.get("points", F.lit(0))
    return writeback.import_topos(found, refs, media)[1].select("uri", "route", (first[0] + 0.0).alias("x"), first[1].alias("y"))


# Places without routes, vocabularies, prices


@PLANS.plan(
    "src_21_place_cards",
    """SELECT page_id, 'Crag ' || page_id AS name, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 80 AS DOUBLE) + 0.5 END AS lat, CASE WHEN page_id % 4 = 0 THEN 'limestone' WHEN page_id % 4 = 1 THEN 'sandstone' END AS rock,
    'A long first paragraph that tells how to get to place number ' || page_id || ' & on.' || chr(10) || chr(10) || 'Another long paragraph, after a short one, that says when sun comes.' AS description FROM pages""",
)
def place_cards(spark, sf_dir):
    """Long paragraphs once, not scripts, cookies or short ones; a rock by its source's name."""
    n = F.col("page_id")
    first = _text("A long <b>first</b> paragraph that tells how to get to place number ", n, " &amp; on.")
    map_ = F.when(n % 3 != 0, _text('<a href="http://maps.google.com/maps?q=', n % 80, '.5,10.25">map</a>')).otherwise("")
    stone = F.when(n % 4 == 0, "Roccia calcare e tufo<br>").when(n % 4 == 1, "roccia Arenaria<").when(n % 4 == 2, "Roccia strana<").otherwise("")
    page = _text("<p>", first, "</p><p>short</p>", map_, stone, "<p>Cookie notices are long, too, but they say nothing about the place at all.</p><p>Another long paragraph, <script>var x = 'hidden';</script>after a short one, that says when sun comes.<p>", first, "</p>")
    items = load(spark, sf_dir, "pages").select(F.lit("crag").alias("kind"), n.cast("string").alias("id"), n.cast("string").alias("url"), _text("Crag ", n).alias("name"), page.alias("payload"))
    return adapters.parsed(items, "place_card").select(F.col("item").cast("long").alias("page_id"), "name", "lat", "rock", "description")


@PLANS.plan("src_14_enums", "SELECT 'rock' AS family, CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS pos, p_type AS code FROM (SELECT DISTINCT p_type FROM part) UNION ALL SELECT 'feature', CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT), p_brand FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 'aspect', CAST(i - 1 AS INT), ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][i] FROM range(1, 9) AS t(i)")
def enums(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    return vocabularies({"rock": part.select(F.col("p_type").alias("code")), "feature": part.select(F.col("p_brand").alias("code"))}, {"aspect": ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]})


def _flights(spark, sf_dir):
    k = F.col("o_orderkey")
    mode = F.when(k % 5 == 0, "drive").when(k % 5 == 1, "local").when(k % 5 == 2, "boat").otherwise("fly")
    keys = [_text("A", k % 7).alias("origin"), _text("B", F.col("o_custkey") % 200).alias("to"), F.lit("d").alias("dates")]
    requests = load(spark, sf_dir, "orders").select(k.alias("ord"), F.col("o_custkey").alias("venue"), F.lit("ann").alias("traveller"), mode.alias("mode"), *keys)
    every = requests.select("origin", "to", "dates").distinct().withColumn("n", F.substring("to", 2, 9).cast("int") + F.substring("origin", 2, 1).cast("int"))
    cache = every.where("n % 6 = 0").select("origin", "to", "dates", F.lit(100).alias("price"))
    answers = every.select("origin", "to", "dates", F.when(F.col("n") % 4 != 0, F.col("n")).alias("price"))
    return flights.flight_cells(requests, cache, answers, 300)


@PLANS.plan(
    "pj_09_flight_cells",
    """WITH q AS (SELECT o_orderkey AS ord, o_custkey AS venue, o_orderkey % 5 AS m, o_orderkey % 7 AS a, o_custkey % 200 AS b, o_custkey % 200 + o_orderkey % 7 AS n FROM orders),
    f AS (SELECT a, b, n, min(ord) AS first FROM q WHERE m > 2 AND n % 6 <> 0 AND n % 4 <> 0 GROUP BY ALL ORDER BY first LIMIT 300),
    p AS (SELECT q.*, CASE WHEN m > 2 THEN CASE WHEN q.n % 6 = 0 THEN 100 ELSE f.n END END AS price FROM q LEFT JOIN f ON f.a = q.a AND f.b = q.b)
    SELECT ord, venue, CASE m WHEN 0 THEN 'drive' WHEN 1 THEN 'local' WHEN 2 THEN 'unknown' ELSE CASE WHEN price IS NULL THEN 'link' ELSE 'priced' END END AS cell, CAST(price AS INT) AS price FROM p""",
)
def flight_cells(spark, sf_dir):
    """Prices from the cache, then from searches in order as long as the quota lasts; later requests share an earlier one's price."""
    return _flights(spark, sf_dir)[0].select("ord", "venue", "cell", "price")


LENSES = {"news": '"{seed}" climbing news', "access": '"{seed}" access OR closed', "pdf": '"{seed}" filetype:pdf'}


def _answers(spark, sf_dir):
    """Each supplier's searches with its part's pages as results: the links are those of the pages."""
    seeds = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("seed"))
    queries = payloads.search_queries(seeds, LENSES)
    n = F.col("page_id")
    date = F.when(n % 6 == 0, _text(n % 20, " days ago")).when(n % 6 == 1, "2 weeks ago").when(n % 6 == 2, "1 month ago").when(n % 6 == 3, "Jul 5, 2026").when(n % 6 == 4, "5 hours ago").otherwise("soon")
    result = F.struct((n % 9 + 1).cast("int").alias("position"), F.when(n % 4 != 0, _text("T", n)).alias("title"), F.when(n % 10 != 0, F.col("url")).alias("link"), F.when(n % 7 != 6, date).alias("date"))
    pages = load(spark, sf_dir, "pages").groupBy((n % 100).alias("k")).agg(F.to_json(F.struct(F.collect_list(result).alias("organic_results"))).alias("payload"))
    return queries.join(seeds, "seed").join(pages, "k", "left").select("seed", "lens", "query", F.when(F.col("lens") == "pdf", F.lit("{}")).otherwise(F.coalesce("payload", F.lit("no answer"))).alias("payload")), queries


_FOUND = "f AS (SELECT s_name AS seed, page_id, url FROM supplier JOIN pages ON page_id % 100 = s_suppkey WHERE page_id % 10 <> 0 AND url <> '')"


@PLANS.plan(
    "src_28_mentions",
    f"""WITH {_FOUND} SELECT seed, lens, page_id % 9 + 1 AS position, CASE WHEN page_id % 4 <> 0 THEN 'T' || page_id ELSE '' END AS title, url, regexp_extract(url, '^[^/?#]*//([^/?#]*)', 1) AS site,
    CASE WHEN page_id % 7 = 6 THEN NULL ELSE CASE page_id % 6 WHEN 0 THEN DATE '2026-07-20' - CAST(page_id % 20 AS INT) WHEN 1 THEN DATE '2026-07-06' WHEN 2 THEN DATE '2026-06-20' WHEN 3 THEN DATE '2026-07-05' WHEN 4 THEN DATE '2026-07-20' END END AS published_at FROM f, (VALUES ('news'), ('access')) AS t(lens)""",
)
def mention_docs(spark, sf_dir):
    docs = payloads.mention_docs(_answers(spark, sf_dir)[0], F.lit("2026-07-20").cast("date"))
    return docs.select("seed", "lens", F.col("position").cast("long").alias("position"), "title", "url", "site", "published_at")


@PLANS.plan("src_28_search_counts", f"""WITH {_FOUND} SELECT s_name AS seed, lens, '"' || s_name || '"' || CASE lens WHEN 'news' THEN ' climbing news' WHEN 'access' THEN ' access OR closed' ELSE ' filetype:pdf' END AS query, CASE WHEN lens = 'pdf' THEN 0 ELSE (SELECT count(*) FROM f WHERE f.seed = s_name) END AS docs FROM supplier, (VALUES ('news'), ('access'), ('pdf')) AS t(lens)""")
def search_counts(spark, sf_dir):
    answers, queries = _answers(spark, sf_dir)
    return payloads.doc_counts(payloads.mention_docs(answers, F.lit("2026-07-20").cast("date")), queries)


@PLANS.plan("src_13_route_database", "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS DOUBLE) + 0.5 AS lat, CASE WHEN p_partkey % 4 <> 0 THEN -6.25::DOUBLE END AS lon, CASE WHEN p_size % 3 <> 0 THEN 'E' || p_size END AS grade, CAST(p_size AS INT) AS length_m FROM part")
def route_database(spark, sf_dir):
    n = F.col("p_partkey")
    climb = F.struct(n.alias("id"), F.col("p_name").alias("climbName"), _text(F.col("p_size"), ".5,", F.when(n % 4 != 0, "-6.25").otherwise("")).alias("geoLocation"), F.when(F.col("p_size") % 3 != 0, _text("E", F.col("p_size"))).otherwise("").alias("originalGrade"), F.col("p_size").alias("length"))
    landed = load(spark, sf_dir, "part").groupBy(F.col("p_brand")).agg(F.to_json(F.struct(F.collect_list(climb).alias("climbs"))).alias("payload"))
    return payloads.route_database(landed.select("payload").unionByName(spark.range(1).select(F.lit("{}").alias("payload")))).select("id", "name", "lat", "lon", "grade", "length_m")
