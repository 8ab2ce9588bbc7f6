"""Predicates, vocabularies, look-ups, set operations and projections over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import conditions, text
from weftline.operators import mentions, ranking
from weftline.operators.graph import connected
from weftline.operators.lineage import numbered
from weftline.operators.records import entity_links, name_pairs, place_pairs
from weftline.operators.search import with_month
from weftline.plans.choices import _KM as KM_SQL
from weftline.plans.choices import ROUTES, VENUES
from weftline.plans.common import Plans, load
from weftline.plans.rollups import cte, made, rounded
from weftline.streaming import queues

PLANS = Plans()
_V, _R = cte("v", "customer", VENUES), cte("r", "part", ROUTES)
_Z = lambda e: f"round(CAST({e} AS DOUBLE), 6) + 0.0"


@PLANS.plan("fil_02_season", f"WITH {_R} SELECT id FROM r WHERE stars IS NULL OR list_contains([stars, stars + 3], 5)")
def season(spark, sf_dir):
    routes = made(spark, sf_dir, "part", ROUTES).withColumn("best_season", F.when(F.col("stars").isNotNull(), F.array(F.col("stars"), F.col("stars") + 3)))
    return routes.where(F.col("best_season").isNull() | F.array_contains("best_season", 5)).select("id")


@PLANS.plan("fil_03_grade_cap", f"WITH {_R} SELECT id, data_grade FROM r WHERE data_grade <= 4")
def grade_cap(spark, sf_dir):
    return made(spark, sf_dir, "part", ROUTES).where("data_grade <= 4").select("id", "data_grade")


@PLANS.plan("fil_06_multi_pitch", "SELECT p_partkey FROM part WHERE (coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 4 END, 0) >= 2 OR p_size * 2 >= 60) AND lower(p_brand) IN ('brand#11', 'brand#12', 'brand#21')")
def multi_pitch(spark, sf_dir):
    pitches = F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 4)
    return load(spark, sf_dir, "part").where(((F.coalesce(pitches, F.lit(0)) >= 2) | (F.col("p_size") * 2 >= 60)) & F.lower("p_brand").isin("brand#11", "brand#12", "brand#21")).select("p_partkey")


@PLANS.plan(
    "fil_08_relevance",
    """WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN regexp_replace(host, '^www\\.', '') IN ('m.thre.example.com') OR ends_with(host, '.net') THEN FALSE WHEN contains(host, 'm.') AND starts_with(host, 'm.') THEN contains(path, '/en/')
    WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN TRUE ELSE FALSE END AS keep FROM p""",
)
def relevance(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    marked = F.when(host.startswith("m."), F.concat(F.lit("mobile."), host)).otherwise(host)
    keep = mentions.relevant(marked, F.col("url"), F.lit(""), F.lit("nowhere"), ["m.thre.example.com"], [".net"], {"mobile.": ["/en/"]}, ["example.org"], ["climb"])
    return load(spark, sf_dir, "pages").select("page_id", keep.alias("keep"))


@PLANS.plan("fil_09_queue_filter", f"WITH {_R} SELECT id FROM r WHERE status = 'draft' AND (contains(lower(name), 'a') OR contains(lower(rock || ' ' || name), '#1'))")
def queue_filter(spark, sf_dir):
    path = F.concat_ws(" ", F.array("rock", "name"))
    return made(spark, sf_dir, "part", ROUTES).where((F.col("status") == "draft") & (F.contains(F.lower("name"), F.lit("a")) | F.contains(F.lower(path), F.lit("#1")))).select("id")


@PLANS.plan("fil_12_typed_values", "SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, '^.*#', '') AS INT) AS n, TRY_CAST(p_brand AS INT) AS none FROM part")
def typed(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.typed_int(F.regexp_replace("p_brand", "^.*#", "")).alias("n"), text.typed_int(F.col("p_brand")).alias("none"))


_ALIASES, _KNOWN = {"brand#11": "granite", "brand#12": "gneiss"}, ["granite", "gneiss", "brand#13"]


@PLANS.plan("fil_13_canonical_rock", "SELECT p_partkey, CASE lower(p_brand) WHEN 'brand#11' THEN 'granite' WHEN 'brand#12' THEN 'gneiss' WHEN 'brand#13' THEN 'brand#13' END AS rock FROM part")
def rock(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.canonical(F.concat("p_brand", F.lit(" (a note)")), _ALIASES, _KNOWN).alias("rock"))


@PLANS.plan("fil_15_truthy", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) = '1' AS flag FROM lineitem")
def truthy(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.truthy(F.col("l_linenumber")).alias("flag"))


@PLANS.plan("fil_20_provenance", "SELECT o_orderkey, CASE WHEN k <= 7 THEN 'forecast' WHEN k <= 15 THEN 'lowconf' WHEN k <= 45 THEN 'outlook' ELSE 'typical' END AS tier FROM (SELECT o_orderkey, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS k FROM orders)")
def provenance(spark, sf_dir):
    ahead = F.datediff(F.col("o_orderdate").cast("date"), F.to_date(F.lit("1995-01-01")))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(ahead <= 7, "forecast").when(ahead <= 15, "lowconf").when(ahead <= 45, "outlook").otherwise("typical").alias("tier"))


@PLANS.plan("fn_18_bands", "SELECT p_partkey, CASE WHEN contains(lower(p_type), 'standard') THEN 100 WHEN contains(lower(p_type), 'brass') THEN 85 ELSE 60 END AS score FROM part")
def bands(spark, sf_dir):
    low = F.lower("p_type")
    return load(spark, sf_dir, "part").select("p_partkey", F.when(low.contains("standard"), 100).when(low.contains("brass"), 85).otherwise(60).alias("score"))


@PLANS.plan("fn_20_venue_fit", f"WITH {_V} SELECT id, round_even((60 + coalesce(fit, 0) + greatest(0, 100 - 25 * greatest(0, id % 9 - 5)) + 50 + least(50, 10 * (id % 7)) + coalesce(travel, 0)) / CAST(3 + (fit IS NOT NULL)::INT + (travel IS NOT NULL)::INT AS DOUBLE), 0) + 0.0 AS total FROM v")
def venue_fit(spark, sf_dir):
    trip = conditions.clamp(100 - conditions.over(F.col("id") % 9, 5) * 25)
    coverage = F.least(F.col("id") % 7 * 10, F.lit(50)) + 50
    pairs = [(F.lit(60.0), 1.0), (F.col("fit"), 1.0), (trip, 1.0), (coverage, 1.0), (F.col("travel"), 1.0)]
    return made(spark, sf_dir, "customer", VENUES).select("id", (ranking.weighted_mean(pairs) + 0.0).alias("total"))


@PLANS.plan("jn_01_route_area", f"WITH {_R} SELECT r.id, n_name AS area FROM r JOIN nation ON n_nationkey = r.area_id")
def route_area(spark, sf_dir):
    areas = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area_id"), F.col("n_name").alias("area"))
    return made(spark, sf_dir, "part", ROUTES).join(areas, "area_id").select("id", "area")


@PLANS.plan("jn_03_has_all", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A')")
def has_all(spark, sf_dir):
    # One pass over the tags: a group has all words if it has as many different ones as are asked for.
    tags = load(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_returnflag").alias("n")).where("n = 2")
    return load(spark, sf_dir, "orders").select("o_orderkey").join(tags, "o_orderkey", "left_semi")


@PLANS.plan("jn_05_no_month", f"WITH {_R} SELECT r.id, o_totalprice AS rainy FROM r LEFT JOIN orders ON FALSE")
def no_month(spark, sf_dir):
    return with_month(made(spark, sf_dir, "part", ROUTES), None, None).select("id", F.col("month_rainy_days").alias("rainy"))


@PLANS.plan("jn_05_month", f"WITH {_R}, c AS (SELECT o_custkey AS route_id, CAST(count(*) AS DOUBLE) AS rainy, max(o_totalprice) AS high FROM orders WHERE month(o_orderdate) = 7 GROUP BY o_custkey) SELECT r.id, rainy, high FROM r LEFT JOIN c ON route_id = r.id")
def month(spark, sf_dir):
    climate = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("route_id"), F.month("o_orderdate").alias("month")).agg(F.count("*").cast("double").alias("rainy_days"), F.max("o_totalprice").alias("temp_high"))
    return with_month(made(spark, sf_dir, "part", ROUTES), climate, 7).select("id", F.col("month_rainy_days").alias("rainy"), F.col("month_temp_high").alias("high"))


@PLANS.plan("jn_10_chain", "SELECT c_custkey, coalesce(s_name, n_name) AS name FROM customer LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) ON s_suppkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE coalesce(s_name, n_name) IS NOT NULL UNION ALL SELECT -s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0")
def chain(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    curated = s.where("c_custkey % 3 = 0")
    found = load(spark, sf_dir, "customer").join(curated, "c_custkey", "left").join(n, "c_nationkey", "left")
    named = found.select("c_custkey", F.coalesce("s_name", "n_name").alias("name")).where("name IS NOT NULL")
    return named.unionByName(s.where("c_custkey % 3 <> 0").select((-F.col("c_custkey")).alias("c_custkey"), F.col("s_name").alias("name")))


@PLANS.plan("jn_16_last_price", "SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END, l.price) AS price FROM part LEFT JOIN (SELECT l_partkey, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS price FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey")
def last_price(spark, sf_dir):
    last = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max_by("l_extendedprice", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("last"))
    parts = load(spark, sf_dir, "part").join(last, "p_partkey", "left")
    return parts.select("p_partkey", F.coalesce(F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")), "last").alias("price"))


@PLANS.plan("jn_18_same_name", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand")
def same_name(spark, sf_dir):
    return name_pairs(load(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand")


@PLANS.plan("jn_20_seed_class", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey) THEN 'in-corpus' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'scraped-only' ELSE 'not-ingested' END AS class FROM customer")
def seed_class(spark, sf_dir):
    known = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.lit(True).alias("known"))
    scraped = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("scraped", F.lit(True))
    found = load(spark, sf_dir, "customer").select("c_custkey").join(known, "c_custkey", "left").join(scraped, "c_custkey", "left")
    return found.select("c_custkey", F.when(F.col("known"), "in-corpus").when(F.col("scraped"), "scraped-only").otherwise("not-ingested").alias("class"))


@PLANS.plan("jn_25_by_name_then_area", "SELECT l.o_orderkey, max(p_partkey) AS route FROM (SELECT o_orderkey, 'Brand#' || (11 + o_orderkey % 15) AS name, o_custkey % 50 AS area FROM orders) l LEFT JOIN part p ON p_brand = l.name AND (p_size = l.area OR (SELECT count(*) FROM part q WHERE q.p_brand = l.name) = 1) GROUP BY l.o_orderkey")
def by_name(spark, sf_dir):
    lines = load(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 15 + 11).cast("string")).alias("name"), (F.col("o_custkey") % 50).alias("area"))
    parts = load(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_size").alias("area"), "p_partkey")
    exact = parts.groupBy("name", "area").agg(F.max("p_partkey").alias("route"))
    lone = parts.groupBy("name").agg(F.count("*").alias("n"), F.max("p_partkey").alias("only")).where("n = 1").select("name", "only")
    return lines.join(exact, ["name", "area"], "left").join(lone, "name", "left").select("o_orderkey", F.coalesce("only", "route").alias("route"))


@PLANS.plan("jn_27_best_match", "SELECT n_nationkey, arg_max(c_custkey, (CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END, c_acctbal, -c_custkey)) AS best FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def best_match(spark, sf_dir):
    order = F.struct(F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0), "c_acctbal", -F.col("c_custkey"))
    nations = load(spark, sf_dir, "nation").select("n_nationkey")
    best = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.max_by("c_custkey", order).alias("best"))
    return nations.join(best, "n_nationkey")


@PLANS.plan("jn_30_update_in", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'changed' ELSE c_mktsegment END AS segment FROM customer")
def update_in(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "changed").otherwise(F.col("c_mktsegment")).alias("segment"))


@PLANS.plan("so_05_mention_order", "SELECT page_id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id % 30 END, page_id) AS pos FROM pages")
def mention_order(spark, sf_dir):
    age = F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 30)
    kind = F.when(F.col("page_id") % 3 == 0, "forum").otherwise("web")
    order = mentions.mention_order(F.lit("x.com"), kind, age, ["good.org"])
    return load(spark, sf_dir, "pages").select("page_id", F.row_number().over(Window.partitionBy(F.col("page_id") % 10).orderBy(*order, "page_id")).alias("pos"))


@PLANS.plan("so_09_tag_order", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type))[1:2], ',') AS tags FROM events GROUP BY user_id")
def tag_order(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 2), ",").alias("tags"))


@PLANS.plan("st_02_concatenate", "SELECT s_name AS name, 0 AS part FROM supplier UNION ALL SELECT c_name, 1 FROM customer")
def concatenate(spark, sf_dir):
    a = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit(0).alias("part"))
    return a.unionByName(load(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.lit(1).alias("part")))


@PLANS.plan("st_03_difference", "SELECT DISTINCT p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_brand = part.p_brand AND q.p_size = 7)")
def difference(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_brand", "p_size")
    return p.select("p_brand").distinct().join(p.where("p_size = 7"), "p_brand", "left_anti")


@PLANS.plan("st_05_token_subset", "SELECT p_partkey, len(list_filter(string_split(lower(p_name), ' '), lambda x: x NOT IN ('red', 'green', 'blue', 'small', 'large'))) = 0 AS subset FROM part")
def subset(spark, sf_dir):
    words = F.split(F.lower("p_name"), " ")
    return load(spark, sf_dir, "part").select("p_partkey", (F.size(F.array_except(words, F.array(*map(F.lit, ["red", "green", "blue", "small", "large"])))) == 0).alias("subset"))


@PLANS.plan("pj_01_character", f"WITH {_V} SELECT id, {_Z('coalesce(fit, 0) + CASE segment WHEN ' + chr(39) + 'BUILDING' + chr(39) + ' THEN 4 ELSE 1 END * 0.7')} AS felt FROM v")
def character(spark, sf_dir):
    aspect = F.when(F.col("segment") == "BUILDING", "S")
    return rounded(made(spark, sf_dir, "customer", VENUES).select("id", conditions.felt_temperature(F.coalesce("fit", F.lit(0.0)), aspect, F.lit(None).cast("double")).alias("felt")))


@PLANS.plan("pj_05_flags", "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag = 'R' THEN 'tidal' END, CASE WHEN l_linestatus = 'F' THEN 'loose' END, CASE WHEN l_linenumber > 3 THEN 'boat' END) AS flags FROM lineitem")
def flags(spark, sf_dir):
    named = {"tidal": F.col("l_returnflag") == "R", "loose": F.col("l_linestatus") == "F", "boat": F.col("l_linenumber") > 3}
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in named.items()])), ",").alias("flags"))


@PLANS.plan("pj_06_list_line", f"WITH {_V} SELECT nation, CASE WHEN count(*) = count(travel) AND sum(travel) > 0 THEN sum(travel) END AS total, {_Z('avg(coalesce(travel, fit, score))')} AS t FROM v GROUP BY nation")
def list_line(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES)
    whole = (F.count_if(F.col("travel").isNull()) == 0) & (F.sum("travel") > 0)
    return rounded(v.groupBy("nation").agg(F.when(whole, F.sum("travel")).alias("total"), F.avg(F.coalesce("travel", "fit", "score")).alias("t")))


@PLANS.plan("pj_11_winners", f"WITH {_V}, k AS (SELECT nation, id, row_number() OVER (PARTITION BY nation ORDER BY score < 0, id) AS pos FROM v) SELECT nation, id, pos FROM k WHERE pos <= 3")
def winners(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES)
    return v.withColumn("pos", F.row_number().over(Window.partitionBy("nation").orderBy((F.col("score") < 0).asc(), "id"))).where("pos <= 3").select("nation", "id", "pos")


@PLANS.plan("pj_14_points", f"WITH {_V} SELECT id, lat, CASE WHEN lat IS NOT NULL THEN lon END AS lon FROM v")
def points(spark, sf_dir):
    from weftline.functions.geo import parse_point

    told = F.concat(F.coalesce(F.col("lat").cast("string"), F.lit("?")), F.lit(","), F.col("lon").cast("string"))
    lat, lon = parse_point(told)
    return made(spark, sf_dir, "customer", VENUES).select("id", lat.alias("lat"), lon.alias("lon"))


@PLANS.plan("pj_16_link_health", """WITH c AS (SELECT user_id AS url, CAST(ts AS DATE) AS day, CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 503 ELSE 200 END AS status, event_id FROM events),
one AS (SELECT url, day, arg_max(status, event_id) AS status FROM c GROUP BY url, day), l AS (SELECT url, arg_max(status, day) AS status, max(day) AS day, max(day) FILTER (status = 200) AS good FROM one GROUP BY url)
SELECT l.url, l.status, l.day, l.status = 404 OR (l.status >= 400 AND (SELECT count(*) FROM one WHERE one.url = l.url AND one.status IN (500, 503) AND (l.good IS NULL OR one.day > l.good)) >= 2) AS dead FROM l""")
def health(spark, sf_dir):
    status = F.when(F.col("event_id") % 5 == 0, 404).when(F.col("event_id") % 5 == 1, 500).when(F.col("event_id") % 5 == 2, 503).otherwise(200)
    daily = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("url"), F.col("ts").cast("date").alias("day")).agg(F.max_by(status, "event_id").alias("status"))
    return mentions.link_health(daily).select("url", "status", "day", "dead")


@PLANS.plan("pj_21_next_ids", "SELECT o_orderkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def next_ids(spark, sf_dir):
    top = load(spark, sf_dir, "customer").agg(F.max("c_custkey")).scalar()
    return numbered(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "id", top)


@PLANS.plan("dm_05_queue_state", """WITH n AS (SELECT max(ts) AS now FROM events),
g AS (SELECT user_id AS id, count(*) FILTER (event_type = 'click') AS attempts, coalesce(bool_or(event_type = 'purchase' AND value > 80), false) AS done,
max(ts) FILTER (event_type = 'click') AS claimed, max(ts) FILTER (event_type = 'error') AS failed FROM events WHERE user_id % 3 <> 0 OR event_type <> 'click' GROUP BY user_id)
SELECT id, attempts, CASE WHEN done THEN 'done' WHEN claimed > now - INTERVAL 30 MINUTE AND coalesce(failed < claimed, true) THEN 'claimed'
WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status FROM g, n""")
def queue_state(spark, sf_dir):
    """As of the last event, so that the latest claims are still held."""
    e = load(spark, sf_dir, "events")
    what = F.when(F.col("event_type") == "click", "claim").when((F.col("event_type") == "purchase") & (F.col("value") > 80), "done").when(F.col("event_type") == "error", "error").otherwise("seen")
    log = e.where("user_id % 3 <> 0 OR event_type <> 'click'").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), what.alias("what"))
    now = e.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return queues.queue_state(e.select(F.col("user_id").alias("id")).distinct(), log, now).select("id", "attempts", "status")


@PLANS.plan("dm_11_keep_evidence", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'new' END, CASE WHEN p_partkey % 2 = 0 THEN p_type END) AS evidence FROM part WHERE p_partkey % 5 <> 0")
def evidence(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    prior = p.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("before"))
    new = p.where("p_partkey % 5 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 != 0, "new").alias("now"))
    return new.join(prior, "p_partkey", "left").select("p_partkey", F.coalesce("now", "before").alias("evidence"))


@PLANS.plan("streaming_windowed_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed(spark, sf_dir):
    return queues.windowed_counts(load(spark, sf_dir, "events")).withColumns({"start": F.col("start").cast("timestamp_ntz"), "total": F.round("total", 6)})


#: Places in rows of four of one name, 0.7 km from each to the next: the ends are one entity only by way of those between.
PLACES = {
    "id": "c_custkey",
    "name": "concat('Rock ', CAST(floor(c_custkey / 4) AS STRING))",
    "source": "CAST(c_custkey % 2 AS STRING)",
    "lat": "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE CAST(floor(c_custkey / 4) * 7919 % 120000 AS DOUBLE) / 1000 - 60 + c_custkey % 4 * CAST(0.0063 AS DOUBLE) END",
    "lon": "CAST(floor(c_custkey / 4) * 104729 % 360000 AS DOUBLE) / 1000 - 180",
}


_P = cte("p", "customer", PLACES)
_DIRECT = f"e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.name = b.name AND a.source <> b.source AND a.id <> b.id AND (a.lat IS NULL OR b.lat IS NULL OR {KM_SQL('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 1.0))"


@PLANS.plan("gr_03_entity_groups", f"WITH RECURSIVE {_P}, {_DIRECT}, w(node, root) AS (SELECT id, id FROM p UNION SELECT w.node, e.b FROM w JOIN e ON w.root = e.a) SELECT node, min(root) AS root FROM w GROUP BY node")
def entity_groups(spark, sf_dir):
    """Places of several sources that are the same, directly or by way of others, are one entity: components of JN-17's pairs."""
    places = made(spark, sf_dir, "customer", PLACES)
    return connected(entity_links(places).unionByName(places.select(F.col("id").alias("a"), F.col("id").alias("b"))))


@PLANS.plan("jn_17_place_pairs", f"WITH {_P}, {_DIRECT} SELECT a, b, 'same' AS verdict FROM e WHERE a < b")
def same_places(spark, sf_dir):
    return place_pairs(made(spark, sf_dir, "customer", PLACES)).where("verdict = 'same'")
