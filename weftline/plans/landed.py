"""Files that land and files that are written: each query writes its files to the shared folder and reads them again."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import mentions, ranking, records
from weftline.operators.lineage import own_path
from weftline.operators.search import Facets, search
from weftline.plans.choices import _R, OPTIONS, ROUTES, VENUES, _F, _V
from weftline.plans.common import Plans, load, six
from weftline.plans.rollups import made
from weftline.sources import files, sinks
from weftline.streaming import queues

PLANS = Plans()
#: Words that texts of the documents may name. Fixed values.
PLACES = ["time", "water", "people", "the first", "in the", "la ville", "der stadt", "new york"]


def _sheet(spark, sf_dir) -> str:
    """The nations as a sheet: two header rows (one with a line break), quoted cells, a blank first cell, ragged rows."""
    rows = load(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("rows"))

    def line(r):
        first = F.when(r["n_nationkey"] % 6 == 5, F.lit(" ")).otherwise(F.concat(F.lit('" '), r["n_name"], F.lit(', land"')))
        more = F.when(r["n_nationkey"] % 2 == 0, F.concat(F.lit(',"two\nlines ""'), r["n_regionkey"].cast("string"), F.lit('"""'))).otherwise("")
        return F.concat(first, F.lit(","), r["n_regionkey"].cast("string"), more)

    path = own_path(spark, "sheet")
    rows.select(F.concat(F.lit('"head\nline",b,c\nsecond,,\n'), F.array_join(F.transform("rows", line), "\n")).alias("value")).write.text(path)
    return path


@PLANS.plan("src_01_sheet", "SELECT CAST(n_nationkey + 3 AS INT) AS row, n_name || ', land' AS area FROM nation WHERE n_nationkey % 6 <> 5")
def sheet(spark, sf_dir):
    return files.sheet(spark, _sheet(spark, sf_dir), ["area"])


@PLANS.plan(
    "src_02_full_sheet",
    """SELECT CAST(n_nationkey + 3 AS INT) AS row, n_name || ', land' AS area, CAST(n_regionkey AS VARCHAR) AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'two' || chr(10) || 'lines "' || n_regionkey || '"' ELSE '' END AS note, '' AS more
    FROM nation WHERE n_nationkey % 6 <> 5""",
)
def full_sheet(spark, sf_dir):
    return files.sheet(spark, _sheet(spark, sf_dir), ["area", "region", "note", "more"])


@PLANS.plan("src_03_registry", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS ord, lower(n_name) AS slug, CAST(n_nationkey % 4 AS INT) AS flex_days, CAST(n_nationkey % 3 AS INT) AS n_travellers FROM nation")
def registry(spark, sf_dir):
    traveller = lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("key"))
    several = F.transform(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), F.col("n_nationkey") % 3), traveller)
    trip = F.struct("n_nationkey", F.lower("n_name").alias("slug"), (F.col("n_nationkey") % 4).alias("flex_days"), several.alias("travellers"))
    path = own_path(spark, "registry")
    load(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(trip)).alias("trips")).write.json(path)
    return files.registry(spark, path).select("ord", "slug", "flex_days", F.size("travellers").alias("n_travellers"))


@PLANS.plan("src_04_tree", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 5 IN (1, 2)")
def tree(spark, sf_dir):
    """Only documents three folders down or under ``routes`` count; those at the top, one folder down or under media don't."""
    root = own_path(spark, "tree")
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    for rest, below in enumerate(["", "/it/alps/crag", "/routes", "/media/it/alps", "/it"]):
        nations.where(F.col("id") % 5 == rest).repartition("id").write.option("maxRecordsPerFile", 1).mode("append").json(root + below)
    return files.documents(spark, root, "id bigint").select(F.col("id").cast("int"))


@PLANS.plan("src_06_forecast", "SELECT CAST(o_custkey AS VARCHAR) AS venue, CAST(o_orderkey AS VARCHAR) AS time, o_totalprice AS temp_max, 'UTC' AS timezone FROM orders")
def forecast(spark, sf_dir):
    days = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    daily = F.struct(F.transform("d", lambda x: x["o_orderkey"].cast("string")).alias("time"), F.col("d.o_totalprice").alias("temperature_2m_max"))
    path = own_path(spark, "forecast")
    load(spark, sf_dir, "orders").groupBy("o_custkey").agg(days.alias("d")).select(F.col("o_custkey").cast("string").alias("venue"), F.lit("UTC").alias("timezone"), daily.alias("daily")).write.json(path)
    each = files.forecast(spark, path).select("venue", "timezone", F.inline(F.arrays_zip("daily.time", "daily.temperature_2m_max")))
    return each.select("venue", "time", F.col("temperature_2m_max").alias("temp_max"), "timezone")


def _members(spark, sf_dir, n):
    """A landed payload of parallel series for each user: the events' hours and n members."""
    hours = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    more = lambda i: lambda x: x["value"] + i
    series = [F.transform("d", more(i)).alias(f"member{i:02d}") for i in range(n)]
    payload = F.to_json(F.struct(F.transform("d", lambda x: x["event_id"].cast("string")).alias("time"), *series))
    path = own_path(spark, "members")
    load(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(hours.alias("d")).select(F.col("user_id").alias("venue"), payload.alias("daily")).write.json(path)
    return files.member_payload(spark.read.json(path, schema="venue bigint, daily string"))


@PLANS.plan("src_08_seasonal", "SELECT user_id AS venue, CAST(event_id AS VARCHAR) AS time, round(value + 0.5, 6) + 0.0 AS mean FROM events WHERE value IS NOT NULL")
def seasonal(spark, sf_dir):
    """The mean of two members for each day."""
    each = _members(spark, sf_dir, 2).select("venue", "time", F.map_values("members").alias("m")).select("venue", F.inline(F.arrays_zip(F.col("time").alias("time"), F.get("m", F.lit(0)).alias("x"), F.get("m", F.lit(1)).alias("y"))))
    return each.select("venue", "time", six((F.col("x") + F.col("y")) / 2).alias("mean"))


@PLANS.plan("src_09_ensemble", "SELECT user_id AS venue, 'member0' || k AS member, count(*) AS n, round(max(value + k), 6) + 0.0 AS most FROM events, range(3) AS t(k) WHERE value IS NOT NULL GROUP BY ALL")
def ensemble(spark, sf_dir):
    each = _members(spark, sf_dir, 3).select("venue", F.explode("members").alias("member", "series"))
    return each.select("venue", "member", F.size("series").cast("long").alias("n"), six(F.array_max("series")).alias("most"))


@PLANS.plan(
    "src_11_flight_options",
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) - 1 AS ord FROM orders)
    SELECT o_custkey AS venue, CAST(o_orderkey % 500 AS INT) AS price, CASE WHEN o_orderkey % 4 = 0 THEN '?' ELSE o_orderpriority END AS airline, 'AAA' AS "from", CASE WHEN o_orderkey % 2 = 1 THEN 'CCC' ELSE 'BBB' END AS "to", CAST(o_orderkey % 2 AS INT) AS stops, CAST(ord AS INT) AS ord FROM o WHERE o_orderkey % 9 <> 0""",
)
def flight_options(spark, sf_dir):
    end = lambda name: F.struct(F.lit(name).alias("id"), F.lit("2026-07-01 08:30").alias("time"))
    leg = lambda a, b, line: F.struct(line.alias("airline"), end(a).alias("departure_airport"), end(b).alias("arrival_airport"))
    line = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))
    legs = F.array_compact(F.array(leg("AAA", "BBB", line), F.when(F.col("o_orderkey") % 2 == 1, leg("BBB", "CCC", line))))
    offer = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 500).cast("double") + 0.25).alias("price"), legs.alias("flights"))
    listed = lambda some: F.array_sort(F.collect_list(F.when(some, offer)))
    best = F.col("o_orderstatus") == "F"
    path = own_path(spark, "searches")
    found = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("venue")).agg(listed(best).alias("best_flights"), listed(~best).alias("other_flights"))
    found.select("venue", F.lit("ann").alias("traveller"), F.struct("best_flights", "other_flights").alias("search")).write.json(path)
    return files.flight_options(spark.read.json(path, schema=f"venue bigint, traveller string, {files.OPTIONS}")).select("venue", "price", "airline", "from", "to", "stops", "ord")


_COUNTED = "SELECT n_nationkey, n_name, CAST(count(c_custkey) AS INT) AS score FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name"
_RANKED = f"SELECT *, CAST(row_number() OVER (ORDER BY score DESC, n_nationkey) AS INT) AS rank FROM ({_COUNTED})"


def _report(spark, sf_dir):
    """The nations by customers, with how they moved, as the lines of a report; a report is small by nature."""
    n = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").cast("int").alias("score"))
    rows = load(spark, sf_dir, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_nationkey", F.col("n_name").alias("name"), F.coalesce("score", F.lit(0)).alias("score"), F.lit("all").alias("within"))
    ranked = ranking.best_first(rows, "score", "n_nationkey", "n_nationkey", ["within"])
    key = F.col("n_nationkey")
    return sinks.report_lines(ranked.withColumns({"rank_new": key % 5 == 0, "rank_delta": F.when(key % 5 != 1, (key - 12).cast("int"))}))


@PLANS.plan("snk_07_report", f"""SELECT '| ' || rank || ' | ' || n_name || ' | ' || score || ' | ' || CASE WHEN n_nationkey % 5 = 0 THEN 'new' WHEN n_nationkey % 5 = 1 THEN '' WHEN n_nationkey > 12 THEN '+' || (n_nationkey - 12) ELSE CAST(n_nationkey - 12 AS VARCHAR) END || ' |' AS value FROM ({_RANKED})""")
def report(spark, sf_dir):
    path = own_path(spark, "report")
    _report(spark, sf_dir).write.text(path)
    return spark.read.text(path)


@PLANS.plan("src_26_report_rows", f"SELECT rank, n_name AS name, score FROM ({_RANKED})")
def report_rows(spark, sf_dir):
    path = own_path(spark, "report")
    _report(spark, sf_dir).unionByName(spark.sql("SELECT * FROM VALUES ('# Report'), ('| # | name | score |'), ('|---|---|---|') AS t(value)")).write.text(path)
    return files.report_rows(spark.read.text(path))


@PLANS.plan("src_27_points", "SELECT c_custkey AS id, 1 + CAST(c_custkey % 1048576 AS DOUBLE) / 1048576 AS lat, -1 - CAST(c_custkey % 1048576 AS DOUBLE) / 1048576 AS lon FROM customer")
def points(spark, sf_dir):
    """Points written as extended WKB: the fraction of a double between 1 and 2 is the customer's key."""
    fraction = (F.col("c_custkey") % (1 << 20)) * (1 << 32)
    little = lambda bits: F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(bits), 16, "0"), F.lit("(..)"), 1)), "")
    lat, lon = fraction + F.lit(0x3FF0000000000000), fraction + F.lit(0xBFF0000000000000 - (1 << 64))
    coded = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("0101000020E6100000"), little(lon), little(lat)).alias("location"))
    return files.points(coded, "location").select("id", "lat", "lon")


@PLANS.plan("snk_02_export", "SELECT c_custkey AS id, c_name AS name, count(o_orderkey) AS n_routes, count(*) FILTER (o_orderstatus = 'F') AS n_published, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)), '') AS routes FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def export(spark, sf_dir):
    areas = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    routes = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("area_id"), F.col("o_orderkey").cast("string").alias("name"), F.when(F.col("o_orderstatus") == "F", "publish").otherwise("draft").alias("status"))
    path = own_path(spark, "export")
    sinks.nested_export(areas, routes).select(F.col("document").alias("value")).write.text(path)
    read = spark.read.json(path, schema="id bigint, name string, routes array<struct<name: string, status: string>>, n_routes bigint, n_published bigint")
    return read.select("id", "name", F.coalesce("n_routes", F.lit(0)).alias("n_routes"), F.coalesce("n_published", F.lit(0)).alias("n_published"), F.array_join("routes.name", ",").alias("routes"))


@PLANS.plan("snk_03_documents", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def written_tree(spark, sf_dir):
    path = own_path(spark, "routes")
    sinks.write_tree(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), path, ["p_type", "p_brand"])
    return spark.read.json(path, schema="p_partkey bigint, p_name string, p_type string, p_brand string")


@PLANS.plan("snk_04_taxonomy", "SELECT 'INSERT INTO brand (code, meaning, sort_order) VALUES (''' || p_brand || ''', ''' || replace('it''s ' || p_brand, '''', '''''') || ''', ' || min(p_partkey) || ') ON CONFLICT (code) DO UPDATE SET meaning = EXCLUDED.meaning, sort_order = EXCLUDED.sort_order;' AS value FROM part GROUP BY p_brand")
def taxonomy(spark, sf_dir):
    words = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg(F.min("p_partkey").alias("sort_order"))
    path = own_path(spark, "taxonomy")
    sinks.taxonomy_sql(words.withColumn("meaning", F.concat(F.lit("it's "), F.col("code"))), "brand").write.text(path)
    return spark.read.text(path)


@PLANS.plan("snk_06_keyed", "SELECT p_type, p_brand, count(*) FILTER (p_size >= 10) AS n_kept, count(*) FILTER (p_size < 10) AS n_flagged, count(*) FILTER (p_size >= 10) AS n_read FROM part GROUP BY ALL")
def keyed(spark, sf_dir):
    """The report beside what a reader finds in the tree of kept rows."""
    path = own_path(spark, "keyed")
    sinks.write_keyed(load(spark, sf_dir, "part"), path, ["p_type", "p_brand"], F.col("p_size") < 10)
    told = spark.read.json(f"{path}/report", schema="p_type string, p_brand string, n_kept bigint, n_flagged bigint")
    read = spark.read.json(f"{path}/kept", schema="p_partkey bigint, p_type string, p_brand string").groupBy("p_type", "p_brand").agg(F.count("*").alias("n_read"))
    return told.join(read, ["p_type", "p_brand"], "left").withColumn("n_read", F.coalesce("n_read", F.lit(0)))


@PLANS.plan("snk_10_days", "SELECT CAST(ts AS DATE) AS run_date, event_type, count(*) + CASE WHEN day(ts) % 5 = 0 THEN 1000 ELSE 0 END AS n FROM events GROUP BY CAST(ts AS DATE), event_type, day(ts)")
def days(spark, sf_dir):
    """A second run replaces every fifth date and leaves the others alone."""
    path = own_path(spark, "days")
    counts = load(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("run_date"), "event_type").agg(F.count("*").alias("n"))
    sinks.write_days(counts, path)
    sinks.write_days(counts.where(F.day("run_date") % 5 == 0).withColumn("n", F.col("n") + 1000), path)
    return spark.read.schema("event_type string, n bigint, run_date date").parquet(path)


@PLANS.plan("fil_05_limit", f"WITH {_R} SELECT id, stars FROM r WHERE status = 'publish' ORDER BY data_grade NULLS LAST, stars DESC NULLS LAST, id LIMIT 20")
def limit(spark, sf_dir):
    """More than the most that a search gives is asked for: the limit is the operator."""
    return search(made(spark, sf_dir, "part", ROUTES), Facets(limit=500)).select("id", "stars")


@PLANS.plan("so_02_best_first", f"WITH {_V} SELECT id, nation, CAST(row_number() OVER (PARTITION BY nation ORDER BY score < 0, CASE WHEN score >= 0 THEN score END DESC, CASE WHEN score >= 0 THEN id % 3 END, id) AS INT) AS rank FROM v")
def best_first(spark, sf_dir):
    v = made(spark, sf_dir, "customer", VENUES).withColumn("priority", F.col("id") % 3)
    return ranking.best_first(v, "score", "priority", "id", ["nation"]).select("id", "nation", "rank")


@PLANS.plan("so_08_claim", "SELECT o_orderkey AS id FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' AND coalesce(n, 0) < 3 ORDER BY id LIMIT 50")
def claimed(spark, sf_dir):
    """A line is a claim from long ago and a finished order is done; the next 50 are the operator."""
    log = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("claim").alias("what"))
    done = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("2024-01-02 00:00:00").cast("timestamp").alias("ts"), F.lit("done").alias("what"))
    items = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return queues.claim(queues.queue_state(items, log.unionByName(done), "2024-06-01 00:00:00"), 50).select("id")


@PLANS.plan(
    "jn_19_named_places",
    """WITH d AS (SELECT doc_id AS doc, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS words FROM documents)
    SELECT DISTINCT doc, place FROM d, (VALUES """ + ", ".join(f"('{p}')" for p in PLACES) + """) AS t(place) WHERE contains(words, ' ' || place || ' ')""",
)
def named(spark, sf_dir):
    places = spark.createDataFrame([(p, p) for p in PLACES], "place string, name string")
    return mentions.named_places(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"), places)


@PLANS.plan(
    "pj_10_flex_line",
    f"""WITH {_F}, b AS (SELECT venue, traveller, max(price) AS base FROM f GROUP BY ALL), m AS (SELECT venue, traveller, arg_min(stops, (price, ord)) AS shift, min(price) AS price FROM f GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY traveller ORDER BY base - price DESC, venue) AS k FROM m JOIN b USING (venue, traveller) WHERE price < base)
    SELECT traveller, traveller || ': +' || shift || ' days to ' || venue || ' saves ' || (base - price) AS line FROM s WHERE k = 1""",
)
def flex_line(spark, sf_dir):
    options = made(spark, sf_dir, "lineitem", OPTIONS)
    base = options.groupBy("venue", "traveller").agg(F.max("price").alias("price"))
    return ranking.flex_line(ranking.flex_saving(options.withColumn("shift", F.col("stops")), base))


@PLANS.plan("pj_08_travellers", "SELECT c_custkey AS trip, 'k' || c_custkey AS key, c_name AS name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, 'f' || (o_orderkey % 4), 'F' || (o_orderkey % 4) FROM orders WHERE o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0")
def travellers(spark, sf_dir):
    registered = load(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("trip"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"), F.lit("AAA").alias("airports"))
    key = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "_f").otherwise("f"), (F.col("o_orderkey") % 4).cast("string"))
    configured = load(spark, sf_dir, "orders").where("o_custkey % 3 <> 0 OR o_custkey % 6 = 0").select(F.col("o_custkey").alias("trip"), key.alias("key"), F.lit("BBB").alias("airports")).distinct()
    return records.travellers(registered, configured).select("trip", "key", "name")


@PLANS.plan("pj_13_name_lookups", "SELECT p_partkey AS id, g.value AS guidebook, e.value AS link FROM part LEFT JOIN (SELECT p_name AS key, min(p_type) AS value FROM part WHERE p_size > 25 GROUP BY p_name) g ON g.key = p_name LEFT JOIN (SELECT p_brand AS key, min(p_name) AS value FROM part WHERE p_size = 3 GROUP BY p_brand) e ON e.key = p_brand")
def name_lookups(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    books = part.where("p_size > 25").select(F.col("p_name").alias("key"), F.col("p_type").alias("value"))
    links = part.where("p_size = 3").select(F.col("p_brand").alias("key"), F.col("p_name").alias("value"))
    return records.with_lookups(part, {"guidebook": (books, "p_name"), "link": (links, "p_brand")}).select(F.col("p_partkey").alias("id"), "guidebook", "link")


@PLANS.plan("pj_25_table_rows", "SELECT l_orderkey, l_linenumber, o_orderstatus AS display, c_name AS sector FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' LEFT JOIN customer ON c_custkey = l_partkey")
def table_rows(spark, sf_dir):
    """Rows of a table with what the page shows of them and the name of their sector, both by id."""
    shown = load(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    sectors = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return records.with_lookups(load(spark, sf_dir, "lineitem"), {"display": (shown, "l_orderkey"), "sector": (sectors, "l_partkey")}).select("l_orderkey", "l_linenumber", "display", "sector")


@PLANS.plan("pj_31_feed_snapshot", "SELECT p_partkey, p_name, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'abseil' END, CASE WHEN p_size % 3 = 0 THEN 'tidal' END, CASE WHEN p_size IS NULL THEN 'loose' END], lambda x: x IS NOT NULL), ',') AS hazards FROM part")
def feed_snapshot(spark, sf_dir):
    feed = load(spark, sf_dir, "part").withColumns({"abseil": F.col("p_size") % 2 == 0, "tidal": F.col("p_size") % 3 == 0, "loose": F.col("p_size").isNull()}).withColumn("p_name", F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b>")))
    return records.feed_snapshot(feed, ["p_partkey"], {"abseil": "abseil", "tidal": "tidal", "loose": "loose"}, ["p_name"]).select("p_partkey", "p_name", F.array_join("hazards", ",").alias("hazards"))


@PLANS.plan("snk_11_resume", "SELECT o_orderkey AS id, o_orderkey % 2 AS half, 1 AS n FROM orders")
def resume(spark, sf_dir):
    """Items land in two halves, some of the first again with the second; the second run goes on from the first one's checkpoint.

    Each id is handled once, in the batch in which it came first.
    """
    landed, target, checkpoint = (own_path(spark, what) for what in ("items", "handled", "progress"))
    items = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).alias("half"))
    for half in (0, 1):
        again = items.where((F.col("half") == 0) & (F.col("id") % 3 == 0)).withColumn("half", F.lit(9)) if half else items.limit(0)
        items.where(F.col("half") == half).unionByName(again).write.mode("append").json(landed)
        queues.follow_queue(spark, landed, "id bigint, half bigint", target, checkpoint, lambda batch: batch).awaitTermination()
    return spark.read.parquet(target).groupBy("id", "half").agg(F.count("*").cast("int").alias("n"))
