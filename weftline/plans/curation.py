"""Curated records, names, dates, sets and orders over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import dates, daylight, geo, text
from weftline.operators import curation, hierarchy, records
from weftline.plans.choices import _ASCII, _KM, AREAS, ROUTES, VENUES
from weftline.plans.common import Plans, load, six
from weftline.plans.rollups import cte, made, rounded
from weftline.sources import files, sinks

PLANS = Plans()
_V, _R, _A = cte("v", "customer", VENUES), cte("r", "part", ROUTES), cte("a", "part", AREAS)
_Z = lambda e: f"round(CAST({e} AS DOUBLE), 6) + 0.0"
_TREE = f"WITH RECURSIVE {_A}, up(id, ancestor, k) AS (SELECT id, id, 0 FROM a UNION ALL SELECT up.id, a.parent_id, k + 1 FROM up JOIN a ON a.id = up.ancestor WHERE a.parent_id IS NOT NULL)"


# Aggregations


@PLANS.plan("ag_24_run_counts", "SELECT event_type AS source, count(DISTINCT user_id) AS crags, count(*) AS routes FROM events GROUP BY event_type")
def run_counts(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count_distinct("user_id").alias("crags"), F.count("*").alias("routes"))


@PLANS.plan("ag_26_mention_counts", "SELECT page_id % 20 AS place, count(*) AS total, count(*) FILTER (page_id % 4 <> 0 AND page_id % 30 <= 14) AS dated, count(DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1))) AS domains FROM pages GROUP BY 1")
def mention_counts(spark, sf_dir):
    recent = (F.col("page_id") % 4 != 0) & (F.col("page_id") % 30 <= 14)
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return load(spark, sf_dir, "pages").groupBy((F.col("page_id") % 20).alias("place")).agg(F.count("*").alias("total"), F.count_if(recent).alias("dated"), F.count_distinct(host).alias("domains"))


@PLANS.plan("ag_27_curators", "SELECT c_nationkey AS curator, array_to_string(array_agg(DISTINCT c_mktsegment ORDER BY c_mktsegment), ',') AS sports FROM customer GROUP BY c_nationkey")
def curators(spark, sf_dir):
    return load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("curator")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("sports"))


# Predicates and rules


@PLANS.plan("fil_04_unknown_words", "SELECT DISTINCT p_brand AS word, (SELECT string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) FROM part WHERE p_size = 7) AS allowed FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 7)")
def unknown_words(spark, sf_dir):
    parts = load(spark, sf_dir, "part").select("p_brand", "p_size")
    known = parts.where("p_size = 7")
    allowed = known.agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("allowed"))
    return parts.select(F.col("p_brand").alias("word")).distinct().join(known, F.col("word") == F.col("p_brand"), "left_anti").join(allowed, F.lit(True), "left")


_TRIPS = {
    "slug": "CASE WHEN o_orderkey % 11 = 0 THEN 'Bad Slug' ELSE 'trip-' || o_orderkey END",
    "name": "CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'Trip' END",
    "status": "CASE o_orderkey % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'planned' WHEN 2 THEN 'ended' END",
    "n": "o_orderkey",
    "travellers": "CAST(o_orderkey % 3 AS INT)",
    "flex_days": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS INT) END",
}
_TRIP_SQL = {
    "slug": "o_orderkey % 11 = 0",
    "name": "o_orderkey % 13 = 0",
    "status": "o_orderkey % 4 = 3",
    "dates": "o_orderkey % 7 = 0",
    "travellers": "o_orderkey % 3 = 0",
    "repeated_traveller": "o_orderkey % 3 = 2",
    "flex_days": "o_orderkey % 5 <> 0 AND o_orderkey % 6 > 3",
}


@PLANS.plan("fil_10_trip_problems", " UNION ALL ".join(f"SELECT o_orderkey AS n, '{n}' AS problem FROM orders WHERE {e}" for n, e in _TRIP_SQL.items()))
def trip_problems(spark, sf_dir):
    trips = made(spark, sf_dir, "orders", _TRIPS).withColumns(
        {"start": F.lit("2026-07-10").cast("date"), "end": F.date_add(F.lit("2026-07-10").cast("date"), F.when(F.col("n") % 7 == 0, -1).otherwise(5)), "travellers": F.array_repeat(F.lit("ann"), F.col("travellers"))}
    )
    return records.problems(trips, "n", curation.trip_rules())


_GRADE = {"id": "p_partkey", "system": "CASE p_partkey % 4 WHEN 0 THEN 'FS' WHEN 1 THEN 'A' WHEN 2 THEN 'YDS' END", "grade": "CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN 'A' || p_size % 8 ELSE p_size % 10 || 'a' END"}


@PLANS.plan(
    "fil_11_grade_syntax",
    f"""WITH {cte('g', 'part', _GRADE)} SELECT id, CASE WHEN grade = '' THEN 'no grade' WHEN system IS NULL THEN 'no system'
    WHEN system = 'FS' AND NOT regexp_matches(grade, '^f?[0-9][abc][+]?$') OR system = 'A' AND NOT regexp_matches(grade, '^A[0-5][+]?$') OR system = 'YDS' THEN 'not a grade of the system' END AS problem FROM g""",
)
def grade_syntax(spark, sf_dir):
    return made(spark, sf_dir, "part", _GRADE).select("id", curation.grade_problem(F.col("system"), F.col("grade")).alias("problem"))


@PLANS.plan("fil_14_incline", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Slab' WHEN 1 THEN 'Slab & Vertical' WHEN 2 THEN 'Overhanging' END AS incline FROM part")
def inclines(spark, sf_dir):
    told = F.element_at(F.array(*map(F.lit, ["Slsb", " Slsb & Vertical", "Overhanging ", "steep"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", curation.incline(told).alias("incline"))


_TAGS = ["red", "green", "blue"]


@PLANS.plan("fil_16_tag_repair", f"SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x IN {tuple(_TAGS)}), ',') AS kept, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x NOT IN {tuple(_TAGS)}), ',') AS dropped, p_partkey % 2 = 0 AS supported FROM part")
def tag_repair(spark, sf_dir):
    kept, dropped = curation.repaired_tags(F.split("p_name", " "), _TAGS)
    claim = F.array(F.struct(F.lit("loose").alias("code"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise("nowhere told").alias("evidence")))
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(kept, ",").alias("kept"), F.array_join(dropped, ",").alias("dropped"), (F.size(curation.supported_hazards(claim, F.col("p_name"), ["loose"])) > 0).alias("supported"))


@PLANS.plan("fil_18_claimable", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 10")
def claimable(spark, sf_dir):
    """The claim takes ten items: the limit is the operator."""
    return load(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") > 1000)).orderBy("o_orderkey").limit(10).select("o_orderkey")


@PLANS.plan("fil_19_band", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 90 WHEN contains(lower(p_name), 'small') THEN 40 ELSE 65 END AS band FROM part")
def bands(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", curation.band(F.col("p_name"), {"red": 90, "small": 40}, 65).alias("band"))


# Functions

_TURN = lambda e: f"({e}) - floor(({e}) / 360) * 360"
_DAY = {"id": "o_orderkey", "lat": "CAST(o_orderkey % 141 - 70 AS DOUBLE)", "lon": "CAST(o_orderkey * 7 % 360 - 180 AS DOUBLE)", "d": "CAST(o_orderdate AS DATE)"}
_SUN = f"""WITH {cte('o', 'orders', _DAY)},
a AS (SELECT *, datediff('day', DATE '1970-01-01', d) - (10957.0::DOUBLE - 0.0008::DOUBLE) - lon / 360 AS noon FROM o),
b AS (SELECT *, {_TURN('357.5291::DOUBLE + 0.98560028::DOUBLE * noon')} AS m FROM a),
c AS (SELECT *, 1.9148::DOUBLE * sin(radians(m)) + 0.02::DOUBLE * sin(radians(2 * m)) + 0.0003::DOUBLE * sin(radians(3 * m)) AS centre FROM b),
e AS (SELECT *, {_TURN('m + centre + 282.9372::DOUBLE')} AS l FROM c),
f AS (SELECT *, sin(radians(l)) * sin(radians(23.4397::DOUBLE)) AS tilt FROM e),
g AS (SELECT *, (sin(radians(-0.833::DOUBLE)) - sin(radians(lat)) * tilt) / (cos(radians(lat)) * cos(asin(tilt))) AS arc FROM f)
SELECT id, round(CASE WHEN arc < -1 THEN 24 WHEN arc > 1 THEN 0 ELSE degrees(acos(CASE WHEN arc BETWEEN -1 AND 1 THEN arc END)) / 360 * 48 END, 4) + 0.0 AS hours, arc BETWEEN -1 AND 1 AS rises FROM g"""


@PLANS.plan("fn_25_daylight", _SUN)
def sun(spark, sf_dir):
    found = made(spark, sf_dir, "orders", _DAY).withColumn("sun", daylight.sun_times(F.col("lat"), F.col("lon"), F.col("d")))
    return found.select("id", (F.round("sun.hours", 4) + 0.0).alias("hours"), F.col("sun.sunrise").isNotNull().alias("rises"))


@PLANS.plan("fn_31_box_cover", f"WITH {_V} SELECT id, CAST(ceil(greatest({_KM('(lat + 1)', '(lon + 1)', '(lat + 2)', '(lon + 2)')}, {_KM('(lat + 1)', '(lon + 1)', 'lat', 'lon')})) AS BIGINT) AS km FROM v WHERE lat IS NOT NULL")
def cover(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES).where("lat IS NOT NULL")
    return v.select("id", geo.covering_radius_km(F.col("lat"), F.col("lon"), F.col("lat") + 2, F.col("lon") + 2).cast("long").alias("km"))


@PLANS.plan("jn_06_radius", f"WITH {_R} SELECT id, round({_KM('lat', 'lon', '10.0', '20.0')}, 1) AS km FROM r WHERE {_KM('lat', 'lon', '10.0', '20.0')} <= 2000")
def radius(spark, sf_dir):
    """Distances are on the sphere; against a spheroid they are off by up to half a percent."""
    routes = made(spark, sf_dir, "part", ROUTES)
    km = geo.haversine(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return routes.where(F.col("lat").between(10 - 2000 / geo.DEGREE_KM, 10 + 2000 / geo.DEGREE_KM)).where(km <= 2000).select("id", F.round(km, 1).alias("km"))


@PLANS.plan("fn_35_scaled_points", "SELECT p_partkey, round(p_size / 64.0::DOUBLE, 5) AS x, round(p_size / 128.0::DOUBLE, 5) AS y FROM part")
def scaled(spark, sf_dir):
    point = F.get(geo.scaled_points(F.array(F.array("p_size", "p_size")), F.lit(64.0), F.lit(128.0)), 0)
    return load(spark, sf_dir, "part").select("p_partkey", point[0].alias("x"), point[1].alias("y"))


_VERTEX = "WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 7 AS DOUBLE) AS a, CAST(o_orderkey % 11 AS DOUBLE) AS b, CAST(o_orderkey % 5 AS DOUBLE) AS c FROM orders)"


@PLANS.plan("fn_36_vertex", f"{_VERTEX} SELECT o_orderkey, {_Z('CASE WHEN a - 2 * b + c <> 0 THEN (a - c) / (2 * (a - 2 * b + c)) ELSE 0 END')} AS off, {_Z('CASE WHEN a - 2 * b + c <> 0 THEN b - (c - a) * (c - a) / (8 * (a - 2 * b + c)) ELSE b END')} AS height FROM o")
def vertex(spark, sf_dir):
    a, b, c = ((F.col("o_orderkey") % n).cast("double") for n in (7, 11, 5))
    off, height = geo.vertex(a, b, c)
    return rounded(load(spark, sf_dir, "orders").select("o_orderkey", off.alias("off"), height.alias("height")))


@PLANS.plan("fn_42_similarity", None)
def similar(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", six(text.similarity(F.col("p_name"), F.col("p_type"))).alias("ratio"))


@PLANS.plan("fn_44_route_slug", f"WITH {_R} SELECT id, CASE WHEN status = 'publish' THEN regexp_replace(regexp_replace(lower(trim(rock || ' / ' || name)), '[ /]+', '-', 'g'), '[?#%]', '', 'g') END AS slug FROM r")
def route_slugs(spark, sf_dir):
    return made(spark, sf_dir, "part", ROUTES).select("id", text.route_slug(F.concat_ws(" / ", "rock", "name"), F.col("status")).alias("slug"))


@PLANS.plan("fn_45_plain_text", "SELECT p_partkey, p_name || chr(10) || p_brand || ' x' AS plain FROM part")
def plain(spark, sf_dir):
    marked = F.concat(F.lit("<p> "), "p_name", F.lit("</p><b class='x'>"), "p_brand", F.lit("</b> \t x "))
    return load(spark, sf_dir, "part").select("p_partkey", text.strip_tags(marked).alias("plain"))


@PLANS.plan("fn_46_pitches", "SELECT p_partkey, n AS number, p_size + n AS length_m, '5' || chr(96 + n) AS grade, p_brand AS words FROM part, (VALUES (1), (2)) AS t(n)")
def pitches(spark, sf_dir):
    mark = lambda n: F.concat(F.lit(f"[P{n}: "), (F.col("p_size") + n).cast("string"), F.lit(f"m, 5{chr(96 + n)}] "), "p_brand", F.lit(" "))
    return load(spark, sf_dir, "part").select("p_partkey", F.inline(text.pitches(F.concat(mark(1), mark(2))))).select("p_partkey", "number", "length_m", "grade", "words")


@PLANS.plan("fn_47_grade_and_length", "SELECT p_partkey, 'E' || p_size % 9 || ' 5a' AS grade, p_size AS length_m FROM part")
def told_grade(spark, sf_dir):
    told = F.concat("p_name", F.lit(" E"), (F.col("p_size") % 9).cast("string"), F.lit(" 5a, "), F.col("p_size").cast("string"), F.lit(" m"))
    return load(spark, sf_dir, "part").select("p_partkey", F.regexp_substr(told, F.lit(r"\bE[0-9]+(?: [3-7][abc]\+?)?")).alias("grade"), F.regexp_extract(told, r"\b([0-9]{1,3})\s*m\b", 1).try_cast("int").alias("length_m"))


@PLANS.plan("fn_48_reference", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN CASE c_custkey % 3 WHEN 0 THEN 'ukc' ELSE 'mp' END END AS source, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey AS VARCHAR) END AS ref FROM customer")
def reference(spark, sf_dir):
    ref = F.concat(F.element_at(F.array(*map(F.lit, ["UKC-", "mp-", "other-"])), (F.col("c_custkey") % 3 + 1).cast("int")), F.col("c_custkey").cast("string"))
    found = load(spark, sf_dir, "customer").select("c_custkey", text.reference_source(ref, ("ukc", "mp")).alias("r"))
    return found.select("c_custkey", F.col("r.source").alias("source"), F.col("r.id").alias("ref"))


@PLANS.plan("fn_49_site_kind", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'social' WHEN 1 THEN 'forum' ELSE 'web' END AS kind FROM customer")
def site_kind(spark, sf_dir):
    link = F.element_at(F.array(*map(F.lit, ["https://www.social.test/a", "http://forum.x.test/?q=1", "https://y.test/social.test"])), (F.col("c_custkey") % 3 + 1).cast("int"))
    return load(spark, sf_dir, "customer").select("c_custkey", text.site_kind(link, ("social.test",), ("talk.test",)).alias("kind"))


@PLANS.plan("fn_50_region_slug", "SELECT n_nationkey, " + _ASCII.format("n_name") + " AS slug FROM nation")
def region_slug(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", text.region_slug(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "Co. ").otherwise("County "), "n_name")).alias("slug"))


@PLANS.plan("fn_52_ladder", "SELECT p_size, CASE WHEN min(p_partkey % 14) = max(p_partkey % 14) THEN g[min(p_partkey % 14) + 1] ELSE g[min(p_partkey % 14) + 1] || '–' || g[max(p_partkey % 14) + 1] END AS range FROM part, (SELECT " + str(curation.LADDER) + " AS g) GROUP BY p_size, g")
def ladder(spark, sf_dir):
    grade = F.element_at(F.array(*[F.lit({"VD": " VDiff", "S": "Severe "}.get(g, g)) for g in curation.LADDER]), (F.col("p_partkey") % 14 + 1).cast("int"))
    return load(spark, sf_dir, "part").withColumn("place", curation.ladder_place(grade)).groupBy("p_size").agg(curation.ladder_range(F.col("place")).alias("range"))


@PLANS.plan("fn_53_search_name", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS name FROM part")
def search_name(spark, sf_dir):
    told = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.concat("p_type", F.lit(", NI ")))
    return load(spark, sf_dir, "part").select("p_partkey", text.search_name(told).alias("name"))


@PLANS.plan("fn_56_redacted", "SELECT c_custkey, 'https://x.test/?q=1&api_key=***&z=' || c_custkey AS link FROM customer")
def redacted(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", text.redact(F.concat(F.lit("https://x.test/?q=1&api_key="), "c_name", F.lit("&z="), F.col("c_custkey").cast("string"))).alias("link"))


@PLANS.plan("fn_57_unfenced", "SELECT c_custkey, c_name AS body FROM customer")
def unfenced(spark, sf_dir):
    told = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("so:\n```json\n"), "c_name", F.lit("\n```\n"))).otherwise(F.concat(F.lit(" "), "c_name"))
    return load(spark, sf_dir, "customer").select("c_custkey", text.unfence(told).alias("body"))


@PLANS.plan("fn_60_month_days", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + n, '%m-%d') AS md FROM orders, (VALUES (0), (1), (2)) AS t(n)")
def month_days(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.explode(dates.month_days(d, F.date_add(d, 2))).alias("md"))


@PLANS.plan("fn_61_graph_window", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - 2 AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + 7 AS DATE) AS b, CAST(6 AS INT) AS days FROM orders")
def graph_window(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    a, b = dates.graph_window(d, F.date_add(d, 5))
    return load(spark, sf_dir, "orders").select("o_orderkey", a.alias("a"), b.alias("b"), dates.trip_days(d, F.date_add(d, 5)).alias("days"))


@PLANS.plan("fn_63_days_ago", "SELECT c_custkey, CAST(CASE c_custkey % 3 WHEN 0 THEN c_custkey % 9 * 7 WHEN 1 THEN c_custkey % 9 * 30 ELSE 9 END AS INT) AS age FROM customer")
def ages(spark, sf_dir):
    n = (F.col("c_custkey") % 9).cast("string")
    told = F.when(F.col("c_custkey") % 3 == 0, F.concat(n, F.lit(" weeks ago"))).when(F.col("c_custkey") % 3 == 1, F.concat(n, F.lit(" mesi fa"))).otherwise("2026-07-01")
    return load(spark, sf_dir, "customer").select("c_custkey", dates.days_ago(told, F.lit("2026-07-10").cast("date")).alias("age"))


@PLANS.plan("fn_66_horizon", "SELECT o_custkey, CAST(max(CAST(o_orderdate AS DATE)) - 15 AS DATE) AS today FROM orders GROUP BY o_custkey")
def horizon(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(dates.horizon_today(F.max(F.col("o_orderdate").cast("date"))).alias("today"))


@PLANS.plan("fn_67_utc_offset", f"WITH {_V} SELECT id, CASE WHEN nation = 3 THEN 1 ELSE CAST(round_even(lon / 15, 0) AS INT) END AS offset_h FROM v")
def utc(spark, sf_dir):
    country = F.when(F.col("nation") == 3, " Italy ").otherwise("elsewhere")
    return made(spark, sf_dir, "customer", VENUES).select("id", dates.utc_offset(country, F.col("lon"), {"italy": 1}).alias("offset_h"))


# Hierarchies and graphs

_KINDS = "CASE id % 4 WHEN 0 THEN 'sector' WHEN 1 THEN 'country' WHEN 2 THEN 'crag' ELSE 'region' END"


@PLANS.plan("gr_02_effective_rock", f"{_TREE}, g AS (SELECT up.id, up.k, b.rock, row_number() OVER (PARTITION BY up.id ORDER BY k) AS n FROM up JOIN a b ON b.id = up.ancestor WHERE b.rock IS NOT NULL) SELECT id, rock, k > 0 AS approx FROM g WHERE n = 1")
def effective(spark, sf_dir):
    return hierarchy.nearest_with(made(spark, sf_dir, "part", AREAS), ["rock"])


@PLANS.plan("gr_04_verdicts", "SELECT p_partkey AS pair, coalesce(l.same, FALSE) AS merged FROM part LEFT JOIN (SELECT l_partkey, bool_and(l_quantity > 3) AS same FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) l ON l_partkey = p_partkey")
def verdicts(spark, sf_dir):
    told = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("pair")).agg(F.bool_and(F.col("l_quantity") > 3).alias("same"))
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair")).join(told, "pair", "left").select("pair", F.coalesce("same", F.lit(False)).alias("merged"))


@PLANS.plan("gr_05_frontier", f"WITH RECURSIVE {_A}, t AS (SELECT id, 0 AS round FROM a WHERE parent_id IS NULL UNION ALL SELECT a.id, round + 1 FROM a JOIN t ON a.parent_id = t.id WHERE round < 3) SELECT id, round FROM t")
def reached(spark, sf_dir):
    areas = made(spark, sf_dir, "part", AREAS)
    return curation.frontier(areas.where("parent_id IS NULL"), areas.select(F.col("parent_id").alias("parent"), F.col("id").alias("child")), 3)


_SLUG = lambda e: _ASCII.format(e)


@PLANS.plan(
    "gr_06_area_prefix",
    f"""{_TREE}, c AS (SELECT up.id, up.k, b.name, {_KINDS.replace('id %', 'b.id %')} AS kind FROM up JOIN a b ON b.id = up.ancestor),
    g AS (SELECT id, arg_min(name, k) FILTER (kind = 'country') AS country, arg_min(name, k) FILTER (kind = 'region') AS region, arg_max(name, k) FILTER (kind IN ('sector', 'crag')) AS crag,
    arg_min(name, k) FILTER (kind IN ('sector', 'crag')) AS lowest, count(*) FILTER (kind IN ('sector', 'crag')) AS n FROM c GROUP BY id)
    SELECT id, coalesce({_SLUG('country')}, 'unknown') || '/' || coalesce({_SLUG('region')}, 'unsorted') || '/' || coalesce({_SLUG('coalesce(crag, region)')}, 'unknown') AS prefix, CASE WHEN n > 1 THEN lowest END AS sector FROM g""",
)
def prefixes(spark, sf_dir):
    areas = made(spark, sf_dir, "part", AREAS)
    return curation.area_prefix(areas.select("id", "parent_id", "name", F.expr(_KINDS).alias("kind")))


_PARTS = {"id": "c_custkey", "country": "CASE WHEN c_custkey % 3 <> 0 THEN 'Italia' END", "region": "CASE WHEN c_custkey % 2 = 0 THEN 'Lazio / Roma' END", "geo_country": "CASE WHEN c_custkey % 5 <> 0 THEN 'Italy' END", "geo_region": "CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 7 = 0 THEN 'Scotland' ELSE 'Lazio' END END"}


@PLANS.plan(
    "gr_07_key_parts",
    f"""WITH {cte('p', 'customer', _PARTS)} SELECT id, CASE WHEN country IS NULL THEN CASE WHEN geo_region = 'Scotland' THEN 'Scotland' ELSE geo_country END WHEN geo_country IS NOT NULL AND region IS NOT NULL THEN 'Italy' ELSE country END AS key_country,
    coalesce(CASE WHEN region IS NOT NULL THEN 'Lazio' END, CASE WHEN NOT (country IS NULL AND coalesce(geo_region = 'Scotland', FALSE)) THEN geo_region END) AS key_region,
    coalesce(country IS NOT NULL AND region IS NOT NULL AND geo_region = 'Scotland', FALSE) AS conflict FROM p""",
)
def key_parts(spark, sf_dir):
    found = curation.key_parts(made(spark, sf_dir, "customer", _PARTS), ["scotland", "italy"])
    return found.select("id", "key_country", "key_region", F.array_contains("notes", "CONFLICT").alias("conflict"))


# Joins


@PLANS.plan("jn_04_dimension", "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 0) n ON n_nationkey = c_nationkey")
def dimension(spark, sf_dir):
    n = load(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return load(spark, sf_dir, "customer").join(n, "c_nationkey", "left").select("c_custkey", "nation")


@PLANS.plan("jn_11_fuzzy_names", None)
def fuzzy(spark, sf_dir):
    """Nation names with a letter doubled against the nations themselves."""
    n = load(spark, sf_dir, "nation")
    sheet = n.select(F.col("n_nationkey").alias("row"), F.concat(F.substring("n_name", 1, 1), "n_name").alias("name"))
    return curation.fuzzy_matches(sheet, n.select(F.col("n_nationkey").alias("venue"), F.col("n_name").alias("name")))


@PLANS.plan("jn_11_fuzzy_parts", None)
def fuzzy_parts(spark, sf_dir):
    """Part names that lack their second letter against all parts."""
    p = load(spark, sf_dir, "part")
    sheet = p.select(F.col("p_partkey").alias("row"), F.concat(F.substring("p_name", 1, 1), F.expr("substring(p_name, 3)")).alias("name"))
    return curation.fuzzy_matches(sheet, p.select(F.col("p_partkey").alias("venue"), F.col("p_name").alias("name")))


@PLANS.plan("jn_21_external_id", "SELECT l_orderkey, l_linenumber, p_partkey AS route FROM lineitem JOIN part ON 'mp-' || p_partkey = 'mp-' || l_partkey")
def external(spark, sf_dir):
    routes = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("mp-"), F.col("p_partkey").cast("string")).alias("ext"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("mp-"), F.col("l_partkey").cast("string")).alias("ext"))
    return lines.join(routes, "ext").select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("route"))


@PLANS.plan("jn_22_ladder_lookup", "SELECT l_orderkey, l_linenumber, CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 END AS INT) AS grade FROM lineitem")
def ladder_lookup(spark, sf_dir):
    scale = spark.sql("SELECT * FROM VALUES ('A', 1), ('N', 2) AS t(l_returnflag, grade)")
    return load(spark, sf_dir, "lineitem").join(scale, "l_returnflag", "left").select("l_orderkey", "l_linenumber", "grade")


@PLANS.plan("jn_23_topos", "SELECT l_orderkey, l_linenumber, o_orderdate, c_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON c_custkey = o_custkey")
def topos(spark, sf_dir):
    media = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    areas = load(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(media, "l_orderkey").join(areas, "o_custkey", "left").select("l_orderkey", "l_linenumber", "o_orderdate", "c_name")


@PLANS.plan("jn_24_neighbourhood", f"WITH {_A} SELECT id FROM a WHERE id = 5 OR parent_id = 5")
def neighbourhood(spark, sf_dir):
    return made(spark, sf_dir, "part", AREAS).where("id = 5 OR parent_id = 5").select("id")


@PLANS.plan("jn_31_bridge", "SELECT DISTINCT l_orderkey AS route, s_name AS book FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def bridge(spark, sf_dir):
    books = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("book"))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct().join(books, "l_suppkey").select(F.col("l_orderkey").alias("route"), "book").distinct()


# Mutations


@PLANS.plan("dm_02_plain_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 1 THEN 'new' ELSE c_name END AS name FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 3 <> 1")
def plain_upsert(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return records.upsert(c.where("id % 4 <> 0"), c.where("id % 3 <> 1").withColumn("name", F.lit("new")), ["id"])


@PLANS.plan("dm_04_add_missing", "SELECT DISTINCT nullif(p_size % 5, 0) AS parent, p_brand AS name FROM part WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 7 = 0 AND q.p_brand = part.p_brand AND nullif(q.p_size % 5, 0) IS NOT DISTINCT FROM nullif(part.p_size % 5, 0))")
def add_missing(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.nullif(F.col("p_size") % 5, F.lit(0)).alias("parent"), F.col("p_brand").alias("name"), "p_partkey")
    return curation.add_missing(rows.where("p_partkey % 7 = 0"), rows, ["parent", "name"])


@PLANS.plan("dm_06_publishable", f"WITH {_R} SELECT id, data_grade IS NOT NULL AND stars IS NOT NULL AND id % 3 = 0 AS allowed FROM r WHERE status = 'draft'")
def publishable(spark, sf_dir):
    ready = F.col("data_grade").isNotNull() & F.col("stars").isNotNull() & (F.col("id") % 3 == 0)
    return made(spark, sf_dir, "part", ROUTES).where("status = 'draft'").select("id", ready.alias("allowed"))


@PLANS.plan(
    "dm_07_guidebooks",
    """WITH k AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'i' || s_suppkey END AS isbn, 'Title ' || s_suppkey % 40 AS title FROM supplier),
    n AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN 'i' || c_custkey END AS isbn, 'Title ' || c_custkey % 60 AS title FROM customer),
    f AS (SELECT n.*, coalesce((SELECT min(id) FROM k WHERE k.isbn = n.isbn), (SELECT min(id) FROM k WHERE k.title = n.title)) AS id FROM n),
    g AS (SELECT coalesce(isbn, title) AS book, row_number() OVER (ORDER BY min(ord)) + (SELECT max(id) FROM k) AS new_id FROM f WHERE id IS NULL GROUP BY 1)
    SELECT ord, coalesce(f.id, new_id) AS id, f.id IS NULL AS is_new FROM f LEFT JOIN g ON book = coalesce(isbn, title)""",
)
def guidebooks(spark, sf_dir):
    known = load(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN 'i' || s_suppkey END AS isbn", "'Title ' || s_suppkey % 40 AS title")
    new = load(spark, sf_dir, "customer").selectExpr("c_custkey AS ord", "CASE WHEN c_custkey % 3 = 0 THEN 'i' || c_custkey END AS isbn", "'Title ' || c_custkey % 60 AS title")
    return curation.guidebook_ids(known, new)


@PLANS.plan("dm_08_removable", "SELECT DISTINCT p_brand AS code, p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 5) AS removed FROM part")
def removable(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), "p_size")
    return curation.removable(p.select("code").distinct(), p.where("p_size < 5").select("code"), p)


@PLANS.plan("dm_10_renamed", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS name FROM customer")
def renamed(spark, sf_dir):
    names = spark.sql("SELECT 'BUILDING' AS old, 'HOUSES' AS new")
    return curation.renamed(load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("name")), names)


# Sets, windows and orders


@PLANS.plan("st_01_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def union_all(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return n.unionByName(load(spark, sf_dir, "region").select(F.col("r_name").alias("name"))).unionByName(n)


@PLANS.plan("st_04_set_union", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || string_split(lower(p_type), ' '))), ',') AS words FROM part")
def set_union(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.split(F.lower("p_type"), " "))), ",").alias("words"))


@PLANS.plan("st_06_set_inequality", "SELECT p_partkey, list_sort(string_split(p_name, ' ')) <> list_sort([split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)]) AS differ FROM part")
def set_inequality(spark, sf_dir):
    words = F.split("p_name", " ")
    return load(spark, sf_dir, "part").select("p_partkey", (F.array_sort(words) != F.array_sort(F.array(F.coalesce(F.get(words, 1), F.lit("")), F.get(words, 0)))).alias("differ"))


@PLANS.plan("st_07_union_missing", "SELECT c_custkey AS id, 'a' AS src FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, 'b' FROM orders WHERE o_custkey % 3 <> 0")
def union_missing(spark, sf_dir):
    a = load(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("a").alias("src"))
    b = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().withColumn("src", F.lit("b"))
    return a.unionByName(b.join(a.select("id"), "id", "left_anti").where("id % 3 <> 0"))


@PLANS.plan("wn_04_day_before", "WITH d AS (SELECT o_custkey AS v, CAST(o_orderdate AS DATE) AS d, sum(o_orderkey % 9) AS mm FROM orders GROUP BY ALL) SELECT a.v, a.d, CAST(coalesce(b.mm, 0) AS BIGINT) AS before FROM d a LEFT JOIN d b ON a.v = b.v AND b.d = a.d - 1")
def day_before(spark, sf_dir):
    days = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("v"), F.col("o_orderdate").cast("date").alias("d")).agg(F.sum(F.col("o_orderkey") % 9).alias("mm"))
    # By calendar, so a gap isn't bridged: the frame is exactly the day before.
    number = F.datediff("d", F.lit("1970-01-01").cast("date"))
    along = Window.partitionBy("v").orderBy(number).rangeBetween(-1, -1)
    return days.select("v", "d", F.coalesce(F.sum("mm").over(along), F.lit(0)).alias("before"))


@PLANS.plan("wn_09_collision_suffix", "SELECT p_partkey, lower(p_brand) || CASE WHEN k > 1 THEN '-' || p_partkey ELSE '' END AS slug FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k FROM part)")
def collision_suffix(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lower("p_brand"), F.when(k > 1, F.concat(F.lit("-"), F.col("p_partkey").cast("string"))).otherwise("")).alias("slug"))


@PLANS.plan("so_07_path_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_brand, p_type, p_name, p_partkey) AS pos FROM part")
def path_order(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_size").orderBy(F.array("p_brand", "p_type"), "p_name", "p_partkey")).alias("pos"))


@PLANS.plan("so_10_best_trip", "SELECT c_nationkey AS trip, arg_max(c_custkey, (c_acctbal, -c_custkey)) AS best FROM customer GROUP BY c_nationkey")
def best_trip(spark, sf_dir):
    return load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("trip")).agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("best"))


@PLANS.plan("so_11_trip_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F', o_orderdate, o_orderkey) AS pos FROM orders")
def trip_order(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "F").asc(), "o_orderdate", "o_orderkey")).alias("pos"))


# Projections, sources and sinks


@PLANS.plan("pj_03_export", f"WITH {_V} SELECT 'mp-' || id AS id, round(lat, 4) + 0.0 AS lat, CASE WHEN score >= 0 THEN CAST(score AS INT) END AS score FROM v")
def export(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES)
    return v.select(F.concat(F.lit("mp-"), F.col("id").cast("string")).alias("id"), (F.round("lat", 4) + 0.0).alias("lat"), F.when(F.col("score") >= 0, F.col("score").cast("int")).alias("score"))


@PLANS.plan("pj_07_banner", f"WITH {_V} SELECT nation, max(travel) FILTER (score >= 0) AS covered, arg_min(fit, id) FILTER (fit IS NOT NULL) AS horizon FROM v GROUP BY nation")
def banner(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES)
    return v.groupBy("nation").agg(F.max(F.when(F.col("score") >= 0, F.col("travel"))).alias("covered"), F.min_by("fit", F.when(F.col("fit").isNotNull(), F.col("id"))).alias("horizon"))


@PLANS.plan("pj_09_flight_cell", f"WITH {_V} SELECT id, CASE WHEN id % 4 = 0 THEN 'local' WHEN id % 4 = 1 THEN 'drive' WHEN travel IS NOT NULL THEN 'fly ' || CAST(CAST(travel AS INT) AS VARCHAR) ELSE 'unknown' END AS cell FROM v")
def flight_cell(spark, sf_dir):
    cell = F.when(F.col("id") % 4 == 0, "local").when(F.col("id") % 4 == 1, "drive").when(F.col("travel").isNotNull(), F.concat(F.lit("fly "), F.col("travel").cast("int").cast("string"))).otherwise("unknown")
    return made(spark, sf_dir, "customer", VENUES).select("id", cell.alias("cell"))


@PLANS.plan("pj_12_name_lookup", "SELECT p_partkey, coalesce(a.s_suppkey, b.s_suppkey) AS found FROM (SELECT p_partkey, 'Supplier#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || CASE WHEN p_partkey % 2 = 0 THEN ' (x)' ELSE '' END AS name FROM part) p LEFT JOIN supplier a ON a.s_name = p.name LEFT JOIN supplier b ON b.s_name = trim(split_part(p.name, '(', 1))")
def name_lookup(spark, sf_dir):
    name = F.concat(F.lit("Supplier#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.when(F.col("p_partkey") % 2 == 0, " (x)").otherwise(""))
    asked = load(spark, sf_dir, "part").select("p_partkey", name.alias("name"), text.short_name(name).alias("short"))
    known = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    exact, loose = known.toDF("of_name", "name"), known.toDF("of_short", "short")
    return asked.join(exact, "name", "left").join(loose, "short", "left").select("p_partkey", F.coalesce("of_name", "of_short").alias("found"))


@PLANS.plan("pj_17_reference_guard", "SELECT c_custkey AS route, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey % 500 AND s_suppkey % 50 <> c_custkey) THEN 'taken' ELSE 'added' END AS verdict FROM customer")
def reference_guard(spark, sf_dir):
    current = load(spark, sf_dir, "supplier").selectExpr("s_suppkey % 50 AS route", "'ukc' AS source", "s_suppkey AS external")
    new = load(spark, sf_dir, "customer").selectExpr("c_custkey AS route", "'ukc' AS source", "c_custkey % 500 AS external")
    return curation.add_references(current, new).select("route", "verdict")


@PLANS.plan("pj_18_line_cascade", "SELECT p_partkey FROM part WHERE NOT (p_brand IN ('Brand#11', 'Brand#12') AND (p_size % 10 = 0 OR p_size % 10 = 3))")
def line_cascade(spark, sf_dir):
    lines = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), F.nullif(F.col("p_size") % 10, F.lit(0)).alias("area"))
    gone = spark.sql("SELECT * FROM VALUES ('Brand#11', 3), ('Brand#12', 3) AS t(name, area)")
    return curation.without_lines_of(lines, gone).select("p_partkey")


@PLANS.plan("pj_27_quota_tone", f"WITH {_V} SELECT id, CASE WHEN travel IS NULL THEN 'unknown' WHEN travel / 100 > 0.5 THEN 'go' WHEN travel / 100 >= 0.2::DOUBLE THEN 'amber' ELSE 'wet' END AS tone FROM v")
def quota_tone(spark, sf_dir):
    left = F.col("travel") / 100
    return made(spark, sf_dir, "customer", VENUES).select("id", F.when(left.isNull(), "unknown").when(left > 0.5, "go").when(left >= 0.2, "amber").otherwise("wet").alias("tone"))


@PLANS.plan("src_15_inline_values", "SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', NULL)) AS t(code, n)")
def inline_values(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2), ('c', NULL) AS t(code, n)")


@PLANS.plan("src_29_fresh_cache", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 18 HOUR")
def fresh(spark, sf_dir):
    cache = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("generated_at"))
    return files.fresh(cache, F.lit("2024-01-10 00:00:00").cast("timestamp"), 18).select("event_id")


@PLANS.plan("src_30_cache_version", "SELECT event_id FROM events WHERE event_id % 4 = 3")
def version(spark, sf_dir):
    cache = load(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k|v"), (F.col("event_id") % 4).cast("string")).alias("key"))
    return files.of_version(cache, "|v3").select("event_id")


@PLANS.plan("snk_12_capped_history", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k <= 5")
def capped(spark, sf_dir):
    """Each key's latest five: the cap is the operator."""
    orders = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return sinks.capped_history(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), ["o_custkey"], F.col("o_orderkey"), 5).select("o_custkey", "o_orderkey")


@PLANS.plan("so_12_priced_set", f"WITH {_V}, a AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, id) AS k FROM v), b AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score + CASE WHEN k <= 10 THEN coalesce(travel, 0) ELSE 0 END DESC, id) AS rank FROM a) SELECT id, nation, k <= 10 AS priced, rank FROM b")
def priced_set(spark, sf_dir):
    """The leaders of a first ranking get prices, and these rank anew."""
    v = made(spark, sf_dir, "customer", VENUES)
    first = v.withColumn("k", F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("score"), "id")))
    total = F.col("score") + F.when(F.col("k") <= 10, F.coalesce("travel", F.lit(0.0))).otherwise(0.0)
    return first.select("id", "nation", (F.col("k") <= 10).alias("priced"), F.row_number().over(Window.partitionBy("nation").orderBy(total.desc(), "id")).alias("rank"))


@PLANS.plan("pj_26_rock_usage", f"WITH {_R}, {_A} SELECT w.code, coalesce(n.uses, 0) AS uses FROM (SELECT DISTINCT p_type AS code FROM part) w LEFT JOIN (SELECT rock AS code, count(*) AS uses FROM a WHERE rock IS NOT NULL GROUP BY rock) n ON n.code = w.code")
def rock_usage(spark, sf_dir):
    words = load(spark, sf_dir, "part").select(F.col("p_type").alias("code")).distinct()
    return records.usage(words, made(spark, sf_dir, "part", AREAS).where("rock IS NOT NULL").select(F.col("rock").alias("code")))
