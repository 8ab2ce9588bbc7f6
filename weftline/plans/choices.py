"""Ranking, prices, proximity, hierarchies, search and records over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import dates, geo, text
from weftline.operators import hierarchy, proximity, ranking, records
from weftline.operators.lineage import listed
from weftline.operators.search import Facets, search
from weftline.plans.common import Plans, load, six
from weftline.plans.rollups import cte, made, rounded

PLANS = Plans()
_Z = lambda e: f"round(CAST({e} AS DOUBLE), 6) + 0.0"
_EVEN = lambda e: f"round_even({e}, 0) + 0.0"

VENUES = {
    "id": "c_custkey",
    "name": "c_name",
    "lat": "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(c_custkey * 7919 % 120000 AS DOUBLE) / 1000 - 60 END",
    "lon": "CAST(c_custkey * 104729 % 360000 AS DOUBLE) / 1000 - 180",
    "score": "CASE WHEN c_custkey % 37 = 0 THEN -1 ELSE CAST(c_custkey * 31 % 101 AS DOUBLE) END",
    "travel": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS DOUBLE) END",
    "fit": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey * 3 % 101 AS DOUBLE) END",
    "nation": "c_nationkey",
    "segment": "c_mktsegment",
}
ROUTES = {
    "id": "p_partkey",
    "area_id": "p_size",
    "name": "p_name",
    "status": "CASE WHEN p_partkey % 4 = 0 THEN 'draft' ELSE 'publish' END",
    "rock": "p_brand",
    "data_grade": "CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_partkey % 7 + 1 AS INT) END",
    "stars": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_partkey % 4 AS INT) END",
    "pitches_count": "CAST(p_size % 9 AS INT)",
    "lat": "CAST(p_partkey * 7919 % 120000 AS DOUBLE) / 1000 - 60",
    "lon": "CAST(p_partkey * 104729 % 360000 AS DOUBLE) / 1000 - 180",
    "tidal": "p_partkey % 3 = 0",
}
AREAS = {
    "id": "p_partkey",
    "parent_id": "CASE WHEN p_partkey <= 3 THEN NULL ELSE CAST(floor(p_partkey / 3) AS BIGINT) END",
    "name": "p_brand",
    "rock": "CASE WHEN p_partkey % 4 = 0 OR p_partkey <= 2 THEN p_type END",
    "aspect": "CASE WHEN p_partkey % 10 = 0 THEN 'N' END",
    "lat": "CASE WHEN p_partkey % 6 = 1 THEN CAST(p_size AS DOUBLE) END",
    "lon": "CASE WHEN p_partkey % 6 = 1 THEN CAST(p_size * 2 AS DOUBLE) END",
}
OPTIONS = {
    "venue": "l_suppkey",
    "traveller": "l_linestatus",
    "price": "CAST(l_partkey % 300 AS INT)",
    "stops": "CAST(l_linenumber % 3 AS INT)",
    "`from`": "l_returnflag",
    "dep": "CAST(l_linenumber AS STRING)",
    "ord": "l_orderkey * 10 + l_linenumber",
}
_V, _R, _A = cte("v", "customer", VENUES), cte("r", "part", ROUTES), cte("a", "part", AREAS)
_F = cte("f", "lineitem", OPTIONS).replace("`from`", '"from"').replace("AS STRING", "AS VARCHAR")
_H = lambda a, b, c, d: f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
_KM = lambda *p: f"2 * 6371.0 * asin(sqrt(least(1.0, {_H(*p)}) + 0 * {_H(*p)}))"
_RANK = "row_number() OVER (PARTITION BY nation ORDER BY score < 0, CASE WHEN score >= 0 THEN score END DESC NULLS LAST, CASE WHEN score >= 0 THEN id % 3 END NULLS LAST, id)"


@PLANS.plan("ag_10_weighted_mean", f"WITH {_V} SELECT id, CASE WHEN travel IS NULL AND fit IS NULL THEN NULL ELSE {_EVEN('(coalesce(travel * 2, 0) + coalesce(fit * 1, 0)) / ((travel IS NOT NULL)::INT * 2 + (fit IS NOT NULL)::INT)')} END AS mean FROM v")
def weighted(spark, sf_dir):
    return made(spark, sf_dir, "customer", VENUES).select("id", (ranking.weighted_mean([(F.col("travel"), 2.0), (F.col("fit"), 1.0)]) + 0.0).alias("mean"))


@PLANS.plan(
    "ag_11_composite",
    f"WITH {_V} SELECT id, CASE WHEN score < 0 THEN -1 ELSE {_EVEN('(0.65::DOUBLE * score + coalesce(0.15::DOUBLE * travel, 0) + coalesce(0.20::DOUBLE * fit, 0)) / (0.65::DOUBLE + CASE WHEN travel IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN fit IS NULL THEN 0 ELSE 0.20::DOUBLE END)')} END AS total FROM v",
)
def composite(spark, sf_dir):
    return made(spark, sf_dir, "customer", VENUES).select("id", (ranking.composite(F.col("score"), F.col("travel"), F.col("fit")) + 0.0).alias("total"))


@PLANS.plan("ag_12_travel_distance", f"WITH {_V}, s AS (SELECT s_nationkey AS nation, CAST(s_suppkey * 7919 % 120000 AS DOUBLE) / 1000 - 60 AS la, CAST(s_suppkey * 104729 % 360000 AS DOUBLE) / 1000 - 180 AS lo FROM supplier) SELECT id, {_Z('min(' + _KM('lat', 'lon', 'la', 'lo') + ')')} AS km FROM v JOIN s USING (nation) WHERE lat IS NOT NULL GROUP BY id")
def travel_distance(spark, sf_dir):
    homes = load(spark, sf_dir, "supplier").selectExpr("s_nationkey AS nation", "CAST(s_suppkey * 7919 % 120000 AS DOUBLE) / 1000 - 60 AS la", "CAST(s_suppkey * 104729 % 360000 AS DOUBLE) / 1000 - 180 AS lo")
    venues = made(spark, sf_dir, "customer", VENUES).where("lat IS NOT NULL")
    return rounded(proximity.nearest_distance(venues, homes.select("nation", F.col("la").alias("lat"), F.col("lo").alias("lon")), "id", ["nation"], 500.0))


@PLANS.plan("ag_13_travel_cost", f"WITH {_F} SELECT venue, greatest(0, least(100, {_EVEN('100 - avg(price) / 4')})) + 0.0 AS cost FROM f GROUP BY venue")
def travel_cost(spark, sf_dir):
    options = made(spark, sf_dir, "lineitem", OPTIONS)
    return options.groupBy("venue").agg((F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(100 - F.avg("price") / 4))) + 0.0).alias("cost"))


@PLANS.plan("ag_14_status_counts", f"WITH {_R} SELECT status, count(*) AS n, count(*) FILTER (tidal) AS n_tidal FROM r GROUP BY status")
def status_counts(spark, sf_dir):
    return made(spark, sf_dir, "part", ROUTES).groupBy("status").agg(F.count("*").alias("n"), F.count_if("tidal").alias("n_tidal"))


@PLANS.plan("ag_15_ordered_lists", f"WITH {_R} SELECT area_id, array_to_string(array_agg(DISTINCT rock ORDER BY rock), ',') AS rocks FROM r WHERE status = 'publish' GROUP BY area_id")
def ordered_lists(spark, sf_dir):
    return made(spark, sf_dir, "part", ROUTES).where("status = 'publish'").groupBy("area_id").agg(F.array_join(F.array_sort(F.collect_set("rock")), ",").alias("rocks"))


@PLANS.plan("ag_16_usage", f"WITH {_R}, w AS (SELECT DISTINCT rock AS code FROM r), u AS (SELECT rock, count(*) AS n FROM r WHERE status = 'draft' GROUP BY rock) SELECT code, coalesce(n, 0) AS uses FROM w LEFT JOIN u ON rock = code")
def usage(spark, sf_dir):
    routes = made(spark, sf_dir, "part", ROUTES)
    return records.usage(routes.select(F.col("rock").alias("code")).distinct(), routes.where("status = 'draft'").select(F.col("rock").alias("code")))


@PLANS.plan("ag_17_counts", f"WITH {_R} SELECT count(*) AS n, count(data_grade) AS graded, count(stars) AS starred, (SELECT count(*) FROM customer) AS venues FROM r")
def counts(spark, sf_dir):
    found = made(spark, sf_dir, "part", ROUTES).agg(F.count("*").alias("n"), F.count("data_grade").alias("graded"), F.count("stars").alias("starred"))
    return found.withColumn("venues", F.lit(load(spark, sf_dir, "customer").count()))


_TREE = f"WITH RECURSIVE {_A}, up(id, ancestor, k) AS (SELECT id, id, 0 FROM a UNION ALL SELECT up.id, a.parent_id, k + 1 FROM up JOIN a ON a.id = up.ancestor WHERE a.parent_id IS NOT NULL)"


@PLANS.plan("ag_18_published_areas", f"{_TREE} SELECT DISTINCT ancestor AS id FROM up WHERE up.id IN (SELECT p_size FROM part WHERE p_partkey % 4 <> 0)")
@PLANS.plan("ag_18_published_areas_all", f"{_TREE} SELECT DISTINCT ancestor AS id FROM up WHERE up.id IN (SELECT p_size FROM part WHERE p_partkey % 4 <> 0)")
def published_all(spark, sf_dir):
    return hierarchy.published_areas(made(spark, sf_dir, "part", AREAS), made(spark, sf_dir, "part", ROUTES))


@PLANS.plan(
    "ag_19_merged_entities",
    """WITH m AS (SELECT c_nationkey AS grp, c_custkey AS ord, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS lat, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS lon, c_mktsegment AS description FROM customer)
    SELECT grp, arg_max(name, (length(name), -ord)) AS name, arg_min(lat, ord) FILTER (lat IS NOT NULL) AS lat, arg_min(lon, ord) FILTER (lon IS NOT NULL) AS lon,
    arg_max(description, (length(description), -ord)) AS description, count(*) AS refs, array_to_string(array_agg(DISTINCT description ORDER BY description), ',') AS disciplines FROM m GROUP BY grp""",
)
def merged(spark, sf_dir):
    members = load(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS grp", "c_custkey AS ord", "c_name AS name", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS lat", "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS lon",
        "CAST(NULL AS STRING) AS rock", "array(c_mktsegment) AS disciplines", "c_mktsegment AS description", "CAST(c_custkey % 4 AS STRING) AS source", "c_name AS grade",
    )
    return records.merged_entities(members, "grp", "ord").select("grp", "name", "lat", "lon", "description", "refs", F.array_join("disciplines", ",").alias("disciplines"))


@PLANS.plan("ag_20_frequent_links", "SELECT l_partkey AS link, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def frequent(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("link")).agg(F.count("*").alias("n")).where("n > 1")


@PLANS.plan("ag_21_grade_range", f"WITH {_R} SELECT area_id, min(data_grade) AS lo, max(data_grade) AS hi FROM r GROUP BY area_id")
def grade_range(spark, sf_dir):
    return made(spark, sf_dir, "part", ROUTES).groupBy("area_id").agg(F.min("data_grade").alias("lo"), F.max("data_grade").alias("hi"))


@PLANS.plan("ag_22_upper_median", f"WITH {_R} SELECT area_id, list_sort(list(pitches_count))[len(list(pitches_count)) // 2 + 1] AS median FROM r GROUP BY area_id")
def median(spark, sf_dir):
    return made(spark, sf_dir, "part", ROUTES).groupBy("area_id").agg(ranking.upper_median("pitches_count").cast("int").alias("median"))


@PLANS.plan("ag_23_area_facts", f"WITH {_R} SELECT area_id, max(pitches_count) AS most, arg_max(name, (pitches_count, -id)) AS tallest, count(DISTINCT rock) AS rocks FROM r GROUP BY area_id")
def facts(spark, sf_dir):
    return made(spark, sf_dir, "part", ROUTES).groupBy("area_id").agg(F.max("pitches_count").alias("most"), F.max_by("name", F.struct("pitches_count", -F.col("id"))).alias("tallest"), F.count_distinct("rock").alias("rocks"))


@PLANS.plan("ag_25_cohorts", f"WITH {_V} SELECT segment, {_Z('avg(score) FILTER (travel >= 45)')} AS wet, {_Z('avg(score) FILTER (travel <= 20)')} AS dry FROM v GROUP BY segment")
def cohorts(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES)
    return rounded(v.groupBy("segment").agg(F.avg(F.when(F.col("travel") >= 45, F.col("score"))).alias("wet"), F.avg(F.when(F.col("travel") <= 20, F.col("score"))).alias("dry")))


@PLANS.plan("ag_29_keep_first", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1")
def first(spark, sf_dir):
    return records.keep_first(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@PLANS.plan("wn_01_rank", f"WITH {_V} SELECT nation, id, {_RANK} AS rank FROM v")
def rank(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES).withColumn("priority", F.col("id") % 3)
    return ranking.best_first(v, "score", "priority", "id", ["nation"]).select("nation", "id", "rank")


_HISTORY = "h AS (SELECT CAST(o_orderdate AS DATE) AS run_date, o_custkey AS name, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY min(o_totalprice), o_custkey) AS rank FROM orders GROUP BY ALL)"


@PLANS.plan(
    "wn_02_rank_movement",
    f"""WITH {_HISTORY.replace(' GROUP BY ALL', ' GROUP BY CAST(o_orderdate AS DATE), o_custkey')}, d AS (SELECT run_date, lag(run_date) OVER (ORDER BY run_date) AS prev FROM (SELECT DISTINCT run_date FROM h))
    SELECT h.run_date, h.rank, h.name, p.rank - h.rank AS rank_delta, d.prev IS NOT NULL AND p.rank IS NULL AS rank_new
    FROM h JOIN d ON h.run_date = d.run_date LEFT JOIN h p ON p.run_date = d.prev AND p.name = h.name""",
)
def rank_movement(spark, sf_dir):
    day = load(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("run_date"), F.col("o_custkey").alias("name")).agg(F.min("o_totalprice").alias("p"))
    history = day.withColumn("rank", F.row_number().over(Window.partitionBy("run_date").orderBy("p", "name"))).drop("p")
    return ranking.movement(history)


@PLANS.plan(
    "wn_05_top_picks",
    f"""WITH {_F}, g AS (SELECT *, row_number() OVER (PARTITION BY venue, traveller ORDER BY price, ord) AS k FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY price, ord) AS n FROM g WHERE k <= CASE traveller WHEN 'O' THEN 3 ELSE 1000000 END)
    SELECT venue, traveller, price, ord FROM t WHERE n <= 8""",
)
def picks(spark, sf_dir):
    rows = made(spark, sf_dir, "lineitem", OPTIONS)
    return ranking.capped_picks(rows, ["venue"], [F.col("price").asc(), F.col("ord").asc()], "traveller", {"O": 3}, 8).select("venue", "traveller", "price", "ord")


@PLANS.plan("wn_06_variant_movement", f"WITH {_V}, x AS (SELECT id, nation, row_number() OVER (PARTITION BY nation ORDER BY score DESC, id) AS a, row_number() OVER (PARTITION BY nation ORDER BY coalesce(fit, -1) DESC, id) AS b FROM v) SELECT id, nation, a - b AS moved FROM x")
def variants(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES)
    by = lambda c: F.row_number().over(Window.partitionBy("nation").orderBy(c.desc(), "id"))
    return v.select("id", "nation", (by(F.col("score")) - by(F.coalesce("fit", F.lit(-1.0)))).alias("moved"))


@PLANS.plan("wn_08_slug_numbers", "SELECT p_partkey, lower(p_brand) || CASE WHEN k = 1 THEN '' ELSE '--' || k END AS slug FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part)")
def slug_numbers(spark, sf_dir):
    parts = load(spark, sf_dir, "part")
    return parts.select("p_partkey", F.concat(F.lower("p_brand"), ranking.collision_numbers(parts, ["p_brand"], [F.col("p_partkey").asc()])).alias("slug"))


@PLANS.plan(
    "wn_10_runs",
    """WITH x AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS m FROM events)
    SELECT user_id, event_type, min(n) AS first, max(n) AS last, count(*) AS n FROM x GROUP BY user_id, event_type, n - m""",
)
def runs(spark, sf_dir):
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return ranking.islands(events, ["user_id"], [F.col("event_id").asc()], "event_type").drop("run")


@PLANS.plan(
    "so_03_best_flights",
    f"""WITH {_F}, o AS (SELECT *, row_number() OVER (PARTITION BY venue, traveller, "from", dep, price ORDER BY price + 40 * stops, ord) AS k FROM f), b AS (SELECT *, row_number() OVER (PARTITION BY venue, traveller ORDER BY price + 40 * stops, ord) AS pos FROM o WHERE k = 1)
    SELECT venue, traveller, price, stops, ord, pos FROM b WHERE pos <= 3""",
)
def flights(spark, sf_dir):
    return ranking.best_flights(made(spark, sf_dir, "lineitem", OPTIONS)).select("venue", "traveller", "price", "stops", "ord", "pos")


@PLANS.plan(
    "so_04_flex_saving",
    f"""WITH {_F}, b AS (SELECT venue, traveller, avg(price) AS base FROM f GROUP BY ALL), m AS (SELECT venue, traveller, min(price) AS price FROM f GROUP BY ALL)
    SELECT venue, traveller, price, {_Z('base - price')} AS saving FROM m JOIN b USING (venue, traveller) WHERE price < base""",
)
def flex(spark, sf_dir):
    options = made(spark, sf_dir, "lineitem", OPTIONS)
    base = options.groupBy("venue", "traveller").agg(F.avg("price").alias("price"))
    return rounded(ranking.flex_saving(options.withColumn("shift", F.col("stops")), base).select("venue", "traveller", "price", "saving"))


@PLANS.plan("so_06_longest", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY o_custkey")
def longest(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@PLANS.plan(
    "jn_02_inheritance",
    f"""WITH RECURSIVE {_A}, t AS (SELECT id, parent_id, name AS path, 0 AS depth, rock AS eff_rock, aspect AS eff_aspect FROM a WHERE parent_id IS NULL
    UNION ALL SELECT a.id, a.parent_id, t.path || '>' || a.name, depth + 1, coalesce(a.rock, eff_rock), coalesce(a.aspect, eff_aspect) FROM a JOIN t ON a.parent_id = t.id)
    SELECT id, path, depth, eff_rock, eff_aspect FROM t""",
)
def inheritance(spark, sf_dir):
    found = hierarchy.resolve(made(spark, sf_dir, "part", AREAS), ["rock", "aspect"])
    return found.select("id", F.array_join("path_tokens", ">").alias("path"), "depth", "eff_rock", "eff_aspect")


@PLANS.plan("gr_01_ancestors", f"{_TREE} SELECT id, ancestor, k AS distance FROM up")
def ancestor_rows(spark, sf_dir):
    return hierarchy.ancestors(made(spark, sf_dir, "part", AREAS))


@PLANS.plan(
    "jn_26_nearest_coordinates",
    f"{_TREE}, g AS (SELECT up.id, up.k, b.lat, b.lon, row_number() OVER (PARTITION BY up.id ORDER BY k) AS n FROM up JOIN a b ON b.id = up.ancestor WHERE b.lat IS NOT NULL AND b.lon IS NOT NULL) SELECT id, lat, lon, k > 0 AS approx FROM g WHERE n = 1",
)
def nearest_coordinates(spark, sf_dir):
    return hierarchy.nearest_with(made(spark, sf_dir, "part", AREAS), ["lat", "lon"])


@PLANS.plan("jn_07_within_km", f"WITH {_V}, {_R} SELECT v.id AS venue, r.id AS route, {_Z(_KM('v.lat', 'v.lon', 'r.lat', 'r.lon'))} AS km FROM v JOIN r ON {_KM('v.lat', 'v.lon', 'r.lat', 'r.lon')} <= 150")
def within(spark, sf_dir):
    # Each pair of points is measured once; rows come from the points' lists last.
    points = lambda table, columns: listed(made(spark, sf_dir, table, columns).where("lat IS NOT NULL AND lon IS NOT NULL").select("id", "lat", "lon"), ["lat", "lon"], "id")
    pairs = proximity.within_km(points("customer", VENUES), points("part", ROUTES), 150).select("id", "b_id", six(F.col("km")).alias("km"))
    return pairs.select(F.explode("id").alias("venue"), "b_id", "km").select("venue", F.explode("b_id").alias("route"), "km")


_NEAR = f"p AS (SELECT v.id AS venue, r.id AS route, r.tidal, {_KM('v.lat', 'v.lon', 'r.lat', 'r.lon')} AS km FROM v JOIN r ON {_KM('v.lat', 'v.lon', 'r.lat', 'r.lon')} <= 300), n AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY round_even(km, 0), route) AS pos FROM p)"


@PLANS.plan("jn_08_nearest_cards", f"WITH {_V}, {_R}, {_NEAR} SELECT venue, route, pos FROM n WHERE pos <= 6")
def cards(spark, sf_dir):
    return _nearest(spark, sf_dir).select(F.col("id").alias("venue"), F.col("b_id").alias("route"), "pos")


def _nearest(spark, sf_dir):
    return proximity.nearest_within(made(spark, sf_dir, "customer", VENUES), made(spark, sf_dir, "part", ROUTES).select("id", "lat", "lon", "tidal"), "id", "id", 300)


@PLANS.plan("jn_09_tidal", f"WITH {_V}, {_R}, {_NEAR} SELECT venue, bool_or(tidal) AS tidal FROM n WHERE pos <= 6 GROUP BY venue")
def tidal(spark, sf_dir):
    return _nearest(spark, sf_dir).groupBy(F.col("id").alias("venue")).agg(F.bool_or("b_tidal").alias("tidal"))


@PLANS.plan("jn_15_last_before", "SELECT o_orderkey, e.ts AS last_ts FROM orders ASOF LEFT JOIN (SELECT user_id, ts FROM events) e ON o_custkey = e.user_id AND o_orderdate + INTERVAL 10950 DAY > e.ts")
@PLANS.plan("jn_15_last_before_all", "SELECT o_orderkey, e.ts AS last_ts FROM orders ASOF LEFT JOIN (SELECT user_id, ts FROM events) e ON o_custkey = e.user_id AND o_orderdate + INTERVAL 10950 DAY > e.ts")
def last_before_all(spark, sf_dir):
    return _last_before(spark, sf_dir, load(spark, sf_dir, "orders"))


def _last_before(spark, sf_dir, orders):
    orders = orders.select("o_orderkey", "o_custkey", F.expr("o_orderdate + INTERVAL 10950 DAYS").alias("at"))
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), F.col("ts").alias("at"))
    # As-of join without pairs: both sides in one ordered sequence for each key, the last event carried forward.
    both = orders.select("o_custkey", "at", "o_orderkey", F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("ts")).unionByName(
        events.select("o_custkey", "at", F.lit(None).cast("long").alias("o_orderkey"), F.lit(1).alias("kind"), F.col("at").alias("ts"))
    )
    along = Window.partitionBy("o_custkey").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("last_ts", F.last("ts", ignorenulls=True).over(along)).where("kind = 0").select("o_orderkey", "last_ts")


@PLANS.plan("jn_28_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 1000 NOT IN (SELECT p_partkey FROM part WHERE p_size > 5)")
def orphans(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1000).alias("p"))
    return records.missing_parents(lines, load(spark, sf_dir, "part").where("p_size > 5"), "p", "p_partkey").select("l_orderkey", "l_linenumber")


@PLANS.plan("jn_29_delete_by_set", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def delete_by_set(spark, sf_dir):
    gone = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return load(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey")


@PLANS.plan(
    "dm_01_guarded_upsert",
    """WITH cur AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS tagged, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS geom, CASE WHEN c_custkey % 5 = 0 THEN 'quarantined' ELSE 'draft' END AS status FROM customer WHERE c_custkey % 4 <> 0),
    new AS (SELECT c_custkey AS id, 'new ' || c_name AS name, 'source' AS tagged, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE -c_acctbal END AS geom, 'draft' AS status FROM customer WHERE c_custkey % 3 <> 1)
    SELECT coalesce(cur.id, new.id) AS id, CASE WHEN cur.id IS NULL OR (new.id IS NOT NULL AND cur.tagged <> 'BUILDING') THEN new.name ELSE cur.name END AS name,
    CASE WHEN cur.id IS NULL OR (new.id IS NOT NULL AND cur.tagged <> 'BUILDING') THEN new.tagged ELSE cur.tagged END AS tagged,
    CASE WHEN cur.id IS NULL THEN new.geom WHEN new.id IS NOT NULL AND cur.tagged <> 'BUILDING' THEN coalesce(new.geom, cur.geom) ELSE cur.geom END AS geom,
    CASE WHEN cur.id IS NULL THEN new.status WHEN new.id IS NOT NULL AND cur.tagged <> 'BUILDING' THEN CASE WHEN cur.status = 'quarantined' AND new.status = 'draft' THEN cur.status ELSE new.status END ELSE cur.status END AS status
    FROM cur FULL JOIN new ON cur.id = new.id""",
)
def upsert(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    current = c.where("c_custkey % 4 <> 0").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS tagged", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS geom", "CASE WHEN c_custkey % 5 = 0 THEN 'quarantined' ELSE 'draft' END AS status")
    new = c.where("c_custkey % 3 <> 1").selectExpr("c_custkey AS id", "concat('new ', c_name) AS name", "'source' AS tagged", "CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE -c_acctbal END AS geom", "'draft' AS status")
    held = F.when((F.col("cur.status") == "quarantined") & (F.col("new.status") == "draft"), F.col("cur.status")).otherwise(F.col("new.status"))
    return records.upsert(current, new, ["id"], ["geom"], F.col("cur.tagged") != "BUILDING", {"status": held})


@PLANS.plan("dm_03_replace_children", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 99 FROM orders WHERE o_orderkey % 3 = 0")
def children(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    new = load(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(99).alias("l_linenumber"))
    return records.replace_children(lines, new, "l_orderkey")


_RULES = {"grade": "data_grade BETWEEN 1 AND 6", "stars": "stars <= 2", "published": "NOT (status = 'publish' AND pitches_count = 0)"}


@PLANS.plan("fil_17_problems", f"WITH {_R} " + " UNION ALL ".join(f"SELECT id, '{n}' AS problem FROM r WHERE NOT coalesce({e}, TRUE)" for n, e in _RULES.items()))
def problems(spark, sf_dir):
    return records.problems(made(spark, sf_dir, "part", ROUTES), "id", {n: F.expr(e) for n, e in _RULES.items()})


@PLANS.plan(
    "fil_01_search",
    f"""WITH {_R} SELECT id, data_grade, stars, round({_KM('lat', 'lon', '10.0', '20.0')}, 1) AS distance_km FROM r WHERE status = 'publish' AND pitches_count >= 2 AND data_grade <= 5 AND {_KM('lat', 'lon', '10.0', '20.0')} <= 3000
    ORDER BY distance_km, data_grade, stars DESC NULLS LAST, id LIMIT 20""",
)
def faceted(spark, sf_dir):
    routes = made(spark, sf_dir, "part", ROUTES)
    return search(routes, Facets(pitches_from=2, grade_to=5, near=(10.0, 20.0, 3000.0), limit=50)).select("id", "data_grade", "stars", "distance_km")


@PLANS.plan("so_01_search_order", f"WITH {_R} SELECT id, data_grade, stars FROM r WHERE status = 'publish' AND rock = 'Brand#11' ORDER BY data_grade NULLS LAST, stars DESC NULLS LAST, id LIMIT 10")
def search_order(spark, sf_dir):
    return search(made(spark, sf_dir, "part", ROUTES), Facets(equal={"rock": "Brand#11"})).select("id", "data_grade", "stars")


@PLANS.plan("fn_30_haversine", f"WITH {_V} SELECT id, {_Z(_KM('lat', 'lon', '54.6', '-5.9'))} AS km FROM v")
def distance(spark, sf_dir):
    return rounded(made(spark, sf_dir, "customer", VENUES).select("id", geo.haversine(F.col("lat"), F.col("lon"), F.lit(54.6), F.lit(-5.9)).alias("km")))


@PLANS.plan("fn_32_mercator", f"WITH {_V} SELECT id, {_Z('radians(lon) * 6378137')} AS x, {_Z('ln(tan(radians(lat) / 2 + pi() / 4)) * 6378137')} AS y, {_Z('lat')} AS lat, {_Z('lon')} AS lon FROM v WHERE lat IS NOT NULL")
def mercator(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES).where("lat IS NOT NULL")
    x, y = geo.to_mercator(F.col("lat"), F.col("lon"))
    back = geo.from_mercator(F.col("x"), F.col("y"))
    return rounded(v.select("id", x.alias("x"), y.alias("y")).select("id", "x", "y", back[0].alias("lat"), back[1].alias("lon")))


@PLANS.plan("fil_07_box", f"WITH {_V} SELECT id, coalesce(lat BETWEEN -10 AND 40 AND lon BETWEEN 0 AND 90, FALSE) AS inside FROM v")
def box(spark, sf_dir):
    return made(spark, sf_dir, "customer", VENUES).select("id", geo.in_box(F.col("lat"), F.col("lon"), -10, 0, 40, 90).alias("inside"))


@PLANS.plan("fn_33_cells", f"WITH {_V} SELECT CAST(round_even(lat / 10, 0) AS BIGINT) AS cell, count(*) AS n FROM v GROUP BY 1")
def cells(spark, sf_dir):
    return made(spark, sf_dir, "customer", VENUES).groupBy(geo.cell(F.col("lat"), 10).alias("cell")).agg(F.count("*").alias("n"))


_ASCII = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@PLANS.plan("fn_40_slug", "SELECT p_partkey, " + _ASCII.format("p_name") + " AS slug FROM part")
def slugs(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@PLANS.plan("fn_41_norm_name", "SELECT p_partkey, trim(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part")
def norm(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.norm_name(F.concat_ws(" ", "p_type", "p_brand")).alias("norm"))


@PLANS.plan("fn_43_short_name", "SELECT p_partkey, trim(split_part(split_part(p_brand || ' (' || p_type || '), x', '(', 1), ',', 1)) AS short FROM part")
def short(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.short_name(F.concat("p_brand", F.lit(" ("), "p_type", F.lit("), x"))).alias("short"))


@PLANS.plan("fn_51_first_number", "SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '[0-9]+'), '') AS INT) AS n, coalesce(TRY_CAST(nullif(regexp_extract(p_type, '[0-9]'), '') AS INT), 9) AS digit FROM part")
def first_number(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.first_number(F.col("p_brand")).alias("n"), text.first_digit(F.col("p_type")).alias("digit"))


@PLANS.plan("fn_55_item_key", "SELECT p_partkey, substr(sha1('part:' || p_name), 1, 16) AS key, substr(sha1(p_name), 1, 10) AS hash FROM part")
def keys(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.item_key(F.lit("part"), F.col("p_name")).alias("key"), text.text_hash(F.col("p_name")).alias("hash"))


@PLANS.plan("fn_62_period", "SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 10 THEN 'early' WHEN day(o_orderdate) <= 20 THEN 'mid' ELSE 'late' END || ' ' || monthname(o_orderdate) AS period FROM orders")
def period(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", dates.period_label(F.col("o_orderdate")).alias("period"))


@PLANS.plan("fn_64_flex_shifts", "SELECT o_orderkey, s AS shift FROM orders, (VALUES (-2), (-1), (1), (2)) AS v(s) WHERE CAST(o_orderdate AS DATE) + s > DATE '1995-06-17'")
def shifts(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.explode(dates.flex_shifts(F.col("o_orderdate").cast("date"), 2, F.to_date(F.lit("1995-06-17")))).alias("shift"))


@PLANS.plan("fn_65_full_months", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) - INTERVAL 12 MONTH AS DATE) AS first, CAST(date_trunc('month', o_orderdate) - INTERVAL 1 DAY AS DATE) AS last FROM orders")
def months(spark, sf_dir):
    a, b = dates.last_full_months(F.col("o_orderdate").cast("date"))
    return load(spark, sf_dir, "orders").select("o_orderkey", a.alias("first"), b.alias("last"))


@PLANS.plan("fn_68_compact_date", "SELECT o_orderkey, strftime(o_orderdate, '%y%m%d') AS ymd FROM orders")
def compact(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", dates.compact(F.col("o_orderdate")).alias("ymd"))
