"""Landed pages of route sources, the crawl's walk, leases and hand-over, and what its answers do to the catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import geo, markup
from weftline.operators import crawl, dashboard, walk
from weftline.operators.lineage import own_path
from weftline.plans.choices import _TREE, _V, AREAS, VENUES
from weftline.plans.common import Plans, load
from weftline.plans.curation import _KINDS, _SLUG
from weftline.plans.rollups import made
from weftline.sources import adapters, versions
from weftline.streaming import leases, queues

PLANS = Plans()


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _landed(spark, pages, source: str, what: str, broken: Column | None = None):
    """Items (kind, id, url, name, payload) written as JSON lines, some broken, and read through the data source."""
    path = own_path(spark, what)
    line = F.to_json(F.struct("kind", "id", "url", "name", "payload"))
    value = line if broken is None else F.when(broken, F.substring(line, 1, 25)).otherwise(line)
    pages.select(value.alias("value")).write.text(path)
    spark.dataSource.register(adapters.LandedSource)
    return spark.read.format("landed_source").option("source", source).load(path)


# Pages with a table of routes: the whole page as it is, with a table put before its end.


def _table_pages(spark, sf_dir):
    n = F.col("page_id")
    row = lambda k, grade, note: _text('<tr class=r><td><a href="https://crags.example/vie/', n * 10 + k, '/x">Route ', n, f" no {k}</a></td><td>{grade}</td><td>", note, "</td><td>*</td><td>-</td></tr>")
    table = _text("<table><tr><th>name</th><th>grade</th></tr>", row(1, "6b+ (5)", _text("by the <b>stream</b> ", n)), row(2, "?", F.lit("7a slab &amp; roof")), "<tr><td>no link</td></tr></table>")
    page = F.when(n % 13 == 0, F.col("html")).otherwise(F.concat("html", table))
    return load(spark, sf_dir, "pages").select(F.lit("crag").alias("kind"), n.cast("string").alias("id"), _text("https://crags.example/falesie/", n).alias("url"), F.when(n % 17 != 0, _text("Crag ", n)).alias("name"), page.alias("payload"), "page_id")


@PLANS.plan(
    "src_16_landed_source",
    """SELECT CASE WHEN page_id % 11 = 0 THEN NULL ELSE 'https://crags.example/falesie/' || page_id END AS item, CASE WHEN page_id % 11 <> 0 AND page_id % 17 <> 0 THEN 'Crag ' || page_id END AS name,
    CAST(CASE WHEN page_id % 11 = 0 OR page_id % 17 = 0 OR page_id % 13 = 0 THEN 0 ELSE 2 END AS INT) AS n_routes, CASE WHEN page_id % 11 = 0 THEN 'not JSON' WHEN page_id % 17 = 0 THEN 'no name' END AS rejected FROM pages""",
)
def landed_source(spark, sf_dir):
    """Every page lands; every eleventh line is cut off and every seventeenth place has no name: both come as rejects."""
    read = _landed(spark, _table_pages(spark, sf_dir), "route_table", "landed", F.col("page_id") % 11 == 0)
    return read.select("item", "name", F.size("routes").alias("n_routes"), F.substring_index("rejected", ":", 1).alias("rejected"))


@PLANS.plan(
    "src_20_route_table",
    """SELECT page_id, k AS no, CAST(page_id * 10 + k AS VARCHAR) AS source_id, 'Route ' || page_id || ' no ' || k AS name, CASE WHEN k = 1 THEN '6b+' END AS grade, CASE WHEN k = 1 THEN 'french' END AS grade_system,
    CASE WHEN k = 1 THEN 'by the stream ' || page_id ELSE '' END AS description FROM pages, (VALUES (1), (2)) AS t(k) WHERE page_id % 13 <> 0 AND page_id % 17 <> 0""",
)
def route_table(spark, sf_dir):
    """Links name routes, the first cell like a grade grades them, a note that looks like a grade isn't one."""
    read = adapters.parsed(_table_pages(spark, sf_dir), "route_table").where("rejected IS NULL")
    each = read.select(F.substring_index("item", "/", -1).cast("long").alias("page_id"), F.posexplode("routes").alias("no", "r"))
    return each.select("page_id", (F.col("no") + 1).alias("no"), "r.source_id", "r.name", "r.grade", "r.grade_system", "r.description")


@PLANS.plan(
    "src_22_route_register",
    """SELECT p_partkey, p_name AS name, CASE WHEN p_size % 3 <> 0 THEN 'E' || p_size || ' 6a' END AS grade, CAST(CASE WHEN p_size % 2 = 0 THEN p_size END AS INT) AS length_m,
    CAST(nullif(p_size % 4, 0) AS INT) AS stars, p_brand AS found_under FROM part WHERE p_size % 3 <> 0 OR p_size % 2 = 0""",
)
def route_register(spark, sf_dir):
    """Routes in bold with what follows them; a bold text without a grade or a length is a heading."""
    n = F.col("p_size")
    said = _text(F.when(n % 3 != 0, _text("E", n, " 6a")).otherwise(""), " ", F.when(n % 2 == 0, _text(n, "m")).otherwise("to the top"))
    page = _text("<p>About <i>", F.col("p_brand"), "</i></p><b>Approach</b> walk <script>E1 5m</script>up<p><b>", F.col("p_name"), F.repeat(F.lit("*"), (n % 4).cast("int")), "</b>", said, ". Then &amp; on.</p>")
    # The keys are dealt out before the pages are made: reading a page is the work, and a file of keys is few tasks.
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(8 * spark.sparkContext.defaultParallelism, "p_partkey")
    items = parts.select(F.lit("crag").alias("kind"), F.col("p_partkey").cast("string").alias("id"), F.lit("https://register.example").alias("url"), F.col("p_brand").alias("name"), page.alias("payload"))
    read = adapters.parsed(items, "route_register")
    each = read.select(F.regexp_replace("description", "^About ", "").alias("found_under"), F.explode("routes").alias("r"))
    return each.select(F.substring_index("r.source_id", "#", 1).cast("long").alias("p_partkey"), "r.name", "r.grade", "r.length_m", "r.stars", "found_under")


# A tree of areas with boxes


#: part as a tree: a parent is a sixth; each page has a box around a place that follows from its key. Fixed values.
TREE = {
    "id": "p_partkey",
    "lat": "CAST(p_partkey * 7919 % 120000 AS DOUBLE) / 1000 - 60",
    "lon": "CAST(p_partkey * 104729 % 360000 AS DOUBLE) / 1000 - 180",
    "leaf": "p_size % 5 < 2",
    "bare": "p_size % 7 = 0",
}
BOX = (-30.0, -120.0, 40.0, 90.0)


@PLANS.plan(
    "src_19_tree_walk",
    """WITH RECURSIVE p AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 % 120000 AS DOUBLE) / 1000 - 60 AS lat, CAST(p_partkey * 104729 % 360000 AS DOUBLE) / 1000 - 180 AS lon, p_size % 5 < 2 AS leaf, p_size % 7 = 0 AS bare, p_partkey // 6 AS parent FROM part),
    f AS (SELECT *, id % 3 = 0 AND NOT (lat + 20 < -30 OR 40 < lat - 20 OR lon + 40 < -120 OR 90 < lon - 40) OR id % 3 <> 0 AS meets FROM p),
    w AS (SELECT id, 0 AS depth FROM f WHERE parent = 0 AND id > 0 UNION ALL SELECT c.id, depth + 1 FROM w JOIN f ON f.id = w.id JOIN f c ON c.parent = w.id AND c.id <> w.id WHERE f.meets AND NOT f.leaf)
    SELECT 'https://tree.example/' || id AS url, min(depth) AS depth, bool_or(meets AND leaf AND (bare OR lat BETWEEN -30 AND 40 AND lon BETWEEN -120 AND 90)) AS kept FROM w JOIN f USING (id) GROUP BY id""",
)
def tree_walk(spark, sf_dir):
    """Pages of areas are landed and read; every third one has a box, some places have no point, and lists of ancestors don't count."""
    t = made(spark, sf_dir, "part", TREE)
    below = t.select(F.floor(F.col("id") / 6).alias("up"), "id").where("up <> id").groupBy("up").agg(F.array_sort(F.collect_list("id")).alias("below"))  # six at most
    t = t.join(below, t["id"] == below["up"], "left")
    corner = lambda x, y: _text("[", F.format_string("%.3f", x), ",", F.format_string("%.3f", y), "]")
    box = F.when(F.col("id") % 3 == 0, _text("<script>map({bbox: [", corner(F.col("lat") + 20, F.col("lon") - 40), ", ", corner(F.col("lat") - 20, F.col("lon") + 40), "]})</script>")).otherwise("")
    point = F.when(F.col("bare"), "").otherwise(_text('<meta property="place:location:latitude" content="', F.format_string("%.3f", F.col("lat")), '"><meta property="place:location:longitude" content="', F.format_string("%.3f", F.col("lon")), '">'))
    record = _text("{&quot;id&quot;: ", F.col("id"), ", &quot;name&quot;: &quot;R [&lt;]&quot;, &quot;gradeAtom&quot;: {&quot;grade&quot;: &quot;VS 4c&quot;}, &quot;styleStub&quot;: &quot;trad&quot;, &quot;stars&quot;: &quot;2&quot;}")
    routes = F.when(F.col("leaf"), _text('<div class="x route" data-route-tick="', record, '"><a href="/en/route/', F.col("id"), '">r</a></div>')).otherwise("")
    links = F.array_join(F.transform(F.coalesce("below", F.array().cast("array<bigint>")), lambda i: _text('<li><a data-nid="1" href="https://tree.example/', i, '#top"><span>area ', i, "</span></a></li>")), "")
    page = _text("<html><head><title>Area ", F.col("id"), ", somewhere</title>", point, "</head>", box, '<div class="regions__nav"><ul class="embed-menu"><li><a data-nid="0" href="https://tree.example/1"><span>up</span></a></li></ul><ul>', links, "</ul></div>", routes)
    items = t.select(F.lit("area").alias("kind"), F.lit(None).cast("string").alias("id"), _text("https://tree.example/", F.col("id")).alias("url"), F.lit("").alias("name"), page.alias("payload"))
    read = _landed(spark, items, "area_tree", "areas").where("rejected IS NULL")
    pages = read.select("url", "south", "west", "north", "east", "lat", "lon", F.size("routes").alias("n_routes"), F.col("next.url").alias("next"))
    roots = made(spark, sf_dir, "part", TREE).where("floor(id / 6) = 0 AND id > 0").select(_text("https://tree.example/", F.col("id")).alias("url"))
    return walk.pruned_walk(pages, roots, BOX)


# What scripts and attributes hold


@PLANS.plan("src_24_bracketed_json", """SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN page_id END AS first_id, CAST(CASE WHEN page_id % 7 <> 0 THEN 2 END AS INT) AS n, CASE WHEN page_id % 7 <> 0 THEN 'a ] "b" [' || page_id END AS name FROM pages""")
def bracketed(spark, sf_dir):
    """The array after a marker at the end of each whole page, with brackets and quotes in its strings; a page cut off within it has none."""
    n = F.col("page_id")
    data = _text('<script>x = "table_data = 3"; table_data = [{"id": ', n, ', "name": "a ] \\"b\\" [', n, "\", \"odd\": [[1], \"it's\"]}, {\"id\": 0, \"name\": \"'\"}]; track(0)</script>")
    cut = F.expr("substring(data, 1, length(data) - 45)")
    pages = load(spark, sf_dir, "pages").withColumn("data", data).select("page_id", F.concat("html", F.when(n % 7 == 0, cut).otherwise(F.col("data"))).alias("page"))
    found = pages.select("page_id", F.from_json(markup.bracketed_json(F.col("page"), "table_data = "), "array<struct<id: bigint, name: string>>").alias("found"))
    return found.select("page_id", F.get("found.id", F.lit(0)).alias("first_id"), F.when(F.col("found").isNotNull(), F.size("found")).alias("n"), F.get("found.name", F.lit(0)).alias("name"))


@PLANS.plan("src_25_attribute_json", "SELECT page_id, k AS no, page_id + k AS id, 'N <' || page_id || '> & \"' AS name, CASE WHEN k = 0 THEN '/fr/route/' || page_id END AS href FROM pages, (VALUES (0), (1)) AS t(k) WHERE page_id % 5 <> 4")
def attributes(spark, sf_dir):
    """Records in attributes put before each whole page's end; those that aren't JSON or of another class don't count."""
    n = F.col("page_id")
    record = lambda k: _text("{&quot;id&quot;: ", n + k, ", &quot;name&quot;: &quot;N &amp;lt;", n, "&gt; &amp;amp; \\&quot;&quot;}")
    first = _text('<div class="route wide" data-route-tick="', record(0), '"><div><a href="/other">o</a></div><a href="/fr/route/', n, '">r</a><a href="/fr/route/0">s</a></div>')
    second = _text("<div data-route-tick='", record(1), "' class=route>none</div><div class=route data-route-tick='{bad'>x</div><div class=router data-route-tick='{}'></div>")
    pages = load(spark, sf_dir, "pages").select("page_id", F.when(n % 5 == 4, F.col("html")).otherwise(F.concat("html", first, second)).alias("page"))
    each = pages.select("page_id", F.posexplode(markup.attribute_json(F.col("page"), "div", "route", "data-route-tick", "/route/")).alias("no", "r"))
    parsed = F.from_json("r.record", "struct<id: bigint, name: string>")
    return each.select("page_id", "no", parsed["id"].alias("id"), parsed["name"].alias("name"), "r.href")


# Spheroid


#: The inverse iteration from (54.6, -5.9), ten rounds for every venue.
_SPHEROID = f"""WITH RECURSIVE {_V}, c AS (SELECT 1 / 298.257223563 AS f, 6378137.0::DOUBLE AS a),
u AS (SELECT id, f, a, atan((1 - f) * tan(radians(lat))) AS u1, atan((1 - f) * tan(radians(54.6))) AS u2, radians((-5.9 - lon + 540) % 360 - 180) AS l FROM v, c WHERE lat IS NOT NULL),
i AS (SELECT id, f, a, u1, u2, l, l AS lam, 0 AS k, 0.0::DOUBLE AS m FROM u
UNION ALL SELECT id, f, a, u1, u2, l, l + (1 - cc) * f * sina * (sig + cc * ssig * (cm + cc * csig * (2 * cm * cm - 1))), k + 1,
  a * (1 - f) * (1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))) * (sig - bb * ssig * (cm + bb / 4 * (csig * (2 * cm * cm - 1) - bb / 6 * cm * (4 * ssig * ssig - 3) * (4 * cm * cm - 3))))
FROM (SELECT *, f / 16 * cos2 * (4 + f * (4 - 3 * cos2)) AS cc, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM (
  SELECT *, 1 - sina * sina AS cos2, csig - 2 * sin(u1) * sin(u2) / (1 - sina * sina) AS cm, (1 - sina * sina) * (1 / ((1 - f) * (1 - f)) - 1) AS uu FROM (
    SELECT *, atan2(ssig, csig) AS sig, cos(u1) * cos(u2) * sin(lam) / ssig AS sina FROM (
      SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ssig, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS csig FROM i WHERE k < 10)))))
"""


@PLANS.plan("fn_34_spheroid", f"{_SPHEROID} SELECT id, round(m / 1000, 2) AS km FROM i WHERE k = 10 AND m < 19000000")
def spheroid(spark, sf_dir):
    """Distances beyond 19,000 km are tested against published values instead, as this SQL's iteration needn't converge there."""
    v = made(spark, sf_dir, "customer", VENUES)
    metres = geo.geodesic(F.col("lat"), F.col("lon"), F.lit(54.6), F.lit(-5.9))
    return v.withColumn("m", metres).where("m < 19000000").select("id", F.round(F.col("m") / 1000, 2).alias("km"))


@PLANS.plan("jn_06_spheroid_radius", f"{_SPHEROID} SELECT id, round(m / 1000, 2) AS km FROM i WHERE k = 10 AND m <= 2500000")
def spheroid_radius(spark, sf_dir):
    return geo.within_spheroid(made(spark, sf_dir, "customer", VENUES), 54.6, -5.9, 2500).select("id", F.round("km", 2).alias("km"))


# Leases, hand-over


_LEASES = """WITH n AS (SELECT max(ts) AS now FROM events),
g AS (SELECT user_id AS id, count(*) FILTER (event_type = 'click' AND user_id % 3 <> 0) AS attempts, coalesce(bool_or(event_type = 'purchase' AND value > 80), false) AS done,
max(ts) FILTER (event_type = 'click' AND user_id % 3 <> 0) AS claimed, max(ts) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id)
SELECT id, attempts, CASE WHEN done THEN 'done' WHEN claimed > now - INTERVAL 30 MINUTE AND coalesce(failed < claimed, true) THEN 'claimed'
WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS status FROM g, n"""


def _log(spark, sf_dir):
    what = F.when((F.col("event_type") == "click") & (F.col("user_id") % 3 != 0), "claim").when((F.col("event_type") == "purchase") & (F.col("value") > 80), "done").when(F.col("event_type") == "error", "error").otherwise("seen")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), what.alias("what"))


def _lease_stream(spark, sf_dir):
    """The log lands in two halves by time; the stream stops after the first and goes on from its checkpoint with the second."""
    landed, target, checkpoint = (own_path(spark, what) for what in ("log", "changes", "leases"))
    log = _log(spark, sf_dir)
    with leases.state_store(spark):
        for late in (False, True):
            middle = F.lit("2024-01-16").cast("timestamp")
            log.where((F.col("ts") >= middle) if late else (F.col("ts") < middle)).write.mode("append").json(landed)
            stream = spark.readStream.schema("id long, ts timestamp, what string").json(landed)
            changes = leases.lease_changes(stream)
            changes.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(leases.CHANGES).parquet(target)


@PLANS.plan("pj_15_lease_stream", _LEASES)
def lease_stream(spark, sf_dir):
    """The stream's last change of each item is its state as of the watermark, the same as the whole log's as a batch."""
    return leases.last_changes(_lease_stream(spark, sf_dir)).select("id", "attempts", "status")


@PLANS.plan("pj_15_dead_letters", f"SELECT id, attempts FROM ({_LEASES}) WHERE status = 'failed'")
def dead(spark, sf_dir):
    return leases.dead_letters(_lease_stream(spark, sf_dir)).select("id", "attempts")


@PLANS.plan(
    "pj_28_resume",
    """WITH r AS (SELECT c_custkey AS run, c_mktsegment AS source, CASE c_custkey % 4 WHEN 0 THEN 'capped' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' ELSE 'running' END AS status, CAST(nullif(c_custkey % 7, 0) * 10 AS INT) AS max_pages, c_custkey % 50 AS pages, c_custkey % 3 AS pending FROM customer)
    SELECT run, source, CASE WHEN status IN ('capped', 'failed') THEN 'pending' ELSE status END AS status, CASE WHEN status = 'done' THEN 'kept' END AS capped, CAST(CASE WHEN run % 5 = 0 AND run % 10 <> 0 THEN 45 ELSE max_pages END AS INT) AS max_pages,
    CASE WHEN pending > 0 AND pages >= CASE WHEN run % 5 = 0 AND run % 10 <> 0 THEN 45 ELSE max_pages END THEN 'max_pages=' || CASE WHEN run % 5 = 0 AND run % 10 <> 0 THEN 45 ELSE max_pages END || ' hit with ' || pending || ' item(s) still pending' END AS stop FROM r""",
)
def resumed(spark, sf_dir):
    key = F.col("c_custkey")
    status = F.when(key % 4 == 0, "capped").when(key % 4 == 1, "failed").when(key % 4 == 2, "done").otherwise("running")
    runs = load(spark, sf_dir, "customer").select(
        key.alias("run"), F.col("c_mktsegment").alias("source"), status.alias("status"), F.when(key % 4 != 3, "kept").alias("capped"), F.when(key % 4 == 1, "e").alias("error"),
        (F.nullif(key % 7, F.lit(0)) * 10).cast("int").alias("max_pages"), F.lit(None).cast("int").alias("max_places"), (key % 50).alias("pages"), F.lit(0).alias("places"), (key % 3).cast("int").alias("pending"),
    )
    caps = runs.where("run % 5 = 0").select("run", F.when(F.col("run") % 10 != 0, 45).alias("max_pages"), F.lit(None).cast("int").alias("max_places"))
    ready = queues.resumed(runs, caps).join(runs.select("run", "pages", "places", "pending"), "run")
    return queues.over_cap(ready).select("run", "source", "status", "capped", "max_pages", "stop")


# Answers of a crawl


def _crawl(spark, sf_dir):
    key = F.col("o_orderkey")
    route = F.struct(
        _text("r", F.floor(key / 3)).alias("source_id"), _text("Route ", F.floor(key / 3)).alias("name"), F.when(key % 3 == 0, "HVS 5a").when(key % 3 == 1, "VS").otherwise("").alias("grade"), F.when(key % 5 != 0, (key % 90).cast("int")).alias("length_m"),
        F.when(key % 4 != 0, (key % 4).cast("int")).alias("pitches"), F.when(key % 2 == 0, "Trad").otherwise("sport").alias("style"), (key % 4).cast("int").alias("stars"), F.lit("u").alias("url"), F.when(key % 6 == 0, " ").when(key % 7 != 0, _text("S", key % 3)).alias("sector"),
    )
    routes = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(route)).alias("routes"))
    customer = load(spark, sf_dir, "customer")
    items = customer.select(F.col("c_custkey").alias("id"), F.lit("tree").alias("source"), F.col("c_name").alias("external_id"), (F.col("c_nationkey") + 1).alias("area_id"), F.concat(F.lit("N > "), "c_mktsegment").alias("path"))
    child = F.struct(_text("u", F.col("c_custkey") % 300).alias("url"), F.lit("below").alias("name"))
    pages = customer.join(routes, F.col("c_custkey") == F.col("k")).select(F.col("c_name").alias("item"), F.col("c_name").alias("name"), "routes", F.when(F.col("c_custkey") % 4 == 0, F.array(child)).alias("children"))
    nation = load(spark, sf_dir, "nation")
    there = nation.select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.col("n_name").alias("name"))
    sectors = nation.where("n_nationkey % 2 = 0").select((F.col("n_nationkey") + 101).cast("long").alias("id"), (F.col("n_nationkey") + 1).cast("long").alias("parent_id"), F.lit("S1").alias("name"))
    known = load(spark, sf_dir, "part").select(F.lit("tree").alias("source"), F.explode(F.array(_text("u", F.col("p_partkey") * 3), _text("r", F.col("p_partkey") * 2))).alias("external_id")).distinct()
    return crawl.insert_pages(pages, items, there.unionByName(sectors), known)


_CRAWL = """WITH o AS (SELECT o_orderkey AS k, o_custkey FROM orders),
r AS (SELECT c_custkey AS item, c_nationkey + 1 AS area_id, 'r' || k // 3 AS external_id, 'Route ' || k // 3 AS name, k % 3 AS g, CASE k % 3 WHEN 0 THEN 'HVS' WHEN 1 THEN 'VS' END AS trad_grade, CASE WHEN k % 3 = 0 THEN '5a' END AS tech_grade,
  CASE WHEN k % 6 <> 0 AND k % 7 <> 0 THEN 'S' || k % 3 END AS sector, CASE WHEN k % 5 <> 0 THEN k % 90 END AS length_m, nullif(k % 4, 0) AS pitches, k % 4 AS stars FROM o JOIN customer ON c_custkey = o_custkey
  WHERE c_custkey % 4 <> 0 AND k % 2 = 0 AND (coalesce(nullif(k % 4, 0), 0) >= 2 OR coalesce(CASE WHEN k % 5 <> 0 THEN k % 90 END, 0) >= 60)),
a AS (SELECT n_nationkey + 101 AS id, n_nationkey + 1 AS parent_id, 'S1' AS name FROM nation WHERE n_nationkey % 2 = 0),
m AS (SELECT DISTINCT area_id AS parent_id, sector AS name FROM r WHERE sector IS NOT NULL EXCEPT SELECT parent_id, name FROM a),
s AS (SELECT * FROM a UNION ALL SELECT (SELECT max(id) FROM (SELECT id FROM a UNION ALL SELECT n_nationkey + 1 FROM nation)) + row_number() OVER (ORDER BY parent_id, name), parent_id, name FROM m),
"""


@PLANS.plan("pj_15_crawl_work", _CRAWL + """w AS (SELECT 'u' || c_custkey % 300 AS external_id, 'area' AS kind, c_custkey AS item, 'N > ' || c_mktsegment || ' > below' AS path FROM customer WHERE c_custkey % 4 = 0 AND c_custkey IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT external_id, 'route', item, NULL FROM r)
SELECT external_id, kind, item AS parent_item, path, CASE kind WHEN 'area' THEN 'pending' ELSE 'done' END AS fetch, CASE kind WHEN 'area' THEN 'not_applicable' ELSE 'pending' END AS tag FROM w
WHERE external_id NOT IN (SELECT 'u' || p_partkey * 3 FROM part UNION ALL SELECT 'r' || p_partkey * 2 FROM part) QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY item, path) = 1""")
def crawl_work(spark, sf_dir):
    return _crawl(spark, sf_dir)["work"].select("external_id", "kind", "parent_item", "path", "fetch", "tag")


@PLANS.plan("pj_15_crawl_routes", _CRAWL + """f AS (SELECT r.*, coalesce(s.id, r.area_id) AS placed FROM r LEFT JOIN s ON s.parent_id = r.area_id AND s.name = r.sector)
SELECT external_id, min(name) AS name, first(trad_grade ORDER BY item, (g + 1) % 3) AS trad_grade, first(tech_grade ORDER BY item, (g + 1) % 3) AS tech_grade, first(placed ORDER BY item, (g + 1) % 3) AS area_id FROM f GROUP BY external_id""")
def crawl_routes(spark, sf_dir):
    """Routes of the first item that has them, under sectors that were there or are made."""
    found = _crawl(spark, sf_dir)
    return found["routes"].select("external_id", "name", "trad_grade", "tech_grade", "area_id")


# Seeds


_CANDIDATES = "c AS (SELECT 'id' || s_suppkey AS uuid, CASE s_suppkey % 3 WHEN 0 THEN 'Wall ' || s_suppkey % 40 WHEN 1 THEN 'wall ' || s_suppkey % 40 || ' North' ELSE 'The North Wall' END AS name, CASE WHEN s_nationkey % 3 = 0 THEN 'Union' ELSE 'N' || s_nationkey END AS country, s_suppkey % 10 AS climbs FROM supplier)"
_SOUGHT = "p AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN ' WALL ' || p_size % 40 WHEN 1 THEN 'north wall' WHEN 2 THEN '' ELSE 'Wall ' || p_size % 40 || '-north' END AS name, CASE WHEN p_partkey % 2 = 0 THEN 'Wales' ELSE 'N' || p_partkey % 25 END AS country FROM part)"
_WORDS = lambda e: f"list_filter(regexp_split_to_array(lower({e}), '[^a-z0-9]+'), lambda x: x <> '')"
_MATCHED = f"""{_CANDIDATES}, {_SOUGHT}, m AS (SELECT p.id, c.uuid, c.climbs, row_number() OVER (PARTITION BY p.id ORDER BY lower(trim(c.name)) <> lower(trim(p.name)), c.climbs DESC, c.uuid) AS n FROM p JOIN c ON c.climbs > 0 AND c.country = CASE p.country WHEN 'Wales' THEN 'Union' ELSE p.country END
AND len({_WORDS('p.name')}) > 0 AND list_has_all({_WORDS('c.name')}, {_WORDS('p.name')}))"""


def _matches(spark, sf_dir):
    key, n = F.col("s_suppkey"), F.col("p_partkey")
    offered = load(spark, sf_dir, "supplier").select(
        _text("id", key).alias("uuid"), F.when(key % 3 == 0, _text("Wall ", key % 40)).when(key % 3 == 1, _text("wall ", key % 40, " North")).otherwise("The North Wall").alias("name"),
        F.when(F.col("s_nationkey") % 3 == 0, "Union").otherwise(_text("N", F.col("s_nationkey"))).alias("country"), (key % 10).alias("climbs"),
    )
    name = F.when(n % 4 == 0, _text(" WALL ", F.col("p_size") % 40)).when(n % 4 == 1, "north wall").when(n % 4 == 2, "").otherwise(_text("Wall ", F.col("p_size") % 40, "-north"))
    sought = load(spark, sf_dir, "part").select(n.alias("id"), name.alias("name"), F.when(n % 2 == 0, "Wales").otherwise(_text("N", n % 25)).alias("country"))
    return crawl.best_matches(sought, offered, {"Wales": "Union"})


@PLANS.plan("jn_27_best_candidates", f"WITH {_MATCHED} SELECT id, uuid, climbs FROM m WHERE n = 1")
def best_candidates(spark, sf_dir):
    """Aliases of countries, an exact name first, then most climbs."""
    return _matches(spark, sf_dir)


@PLANS.plan("pj_24_seeded", f"WITH {_MATCHED}, f AS (SELECT 'open' AS source, 'id' || s_suppkey AS external_id, 'old' AS path FROM supplier WHERE s_suppkey % 5 = 0) SELECT * FROM f UNION ALL SELECT 'open', uuid, min('at ' || id) FROM m WHERE n = 1 AND uuid NOT IN (SELECT external_id FROM f) GROUP BY uuid")
def seeded(spark, sf_dir):
    """The work list after seeding twice: the second time adds nothing."""
    there = load(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").select(F.lit("open").alias("source"), _text("id", F.col("s_suppkey")).alias("external_id"), F.lit("old").alias("path"))
    found = _matches(spark, sf_dir).select("uuid", _text("at ", F.col("id")).alias("path"))
    once = crawl.seed(there, found, "open")
    return crawl.seed(once, found, "open")


# Validation


SCHEMA = crawl.RecordSchema(
    rules=(
        crawl.Rule("name", required=True, not_blank=True),
        crawl.Rule("status", required=True, one_of=("draft", "publish", "quarantined")),
        crawl.Rule("tagged_by", equals="human", when="status = 'publish'"),
        crawl.Rule("rock", one_of="rock"),
        crawl.Rule("stars", least=0, most=3),
        crawl.Rule("disciplines", one_of="discipline", items=True),
        crawl.Rule("hazards", one_of="hazard", items=True, field="code"),
        crawl.Rule("area_id", required=True, refers="area"),
    ),
    evidence=(("hazards", "code", "evidence", "critical"),),
    vocabularies={"rock": ("ECONOMY", "SMALL", "STANDARD"), "discipline": ("trad", "sport"), "hazard": ("tidal", "loose", "nesting"), "critical": ("tidal", "loose")},
)


@PLANS.plan(
    "pj_23_invalid_records",
    """WITH p AS (SELECT p_partkey AS id, p_partkey % 9 AS k, p_size AS n, p_type AS rock FROM part)
    SELECT id, 'name: is missing' AS problem FROM p WHERE k = 0 UNION ALL SELECT id, 'name: is blank' FROM p WHERE k = 1 UNION ALL SELECT id, 'status: unknown gone' FROM p WHERE k = 2
    UNION ALL SELECT id, 'tagged_by: is not human' FROM p WHERE k = 3 UNION ALL SELECT id, 'rock: unknown ' || rock FROM p WHERE rock NOT IN ('ECONOMY', 'SMALL', 'STANDARD')
    UNION ALL SELECT id, 'stars: is over 3' FROM p WHERE n % 6 - 1 > 3 UNION ALL SELECT id, 'stars: is under 0' FROM p WHERE n % 6 - 1 < 0
    UNION ALL SELECT id, 'disciplines: unknown ice, nothing' FROM p WHERE n % 5 = 0 UNION ALL SELECT id, 'hazards: unknown bees' FROM p WHERE n % 7 = 1
    UNION ALL SELECT id, 'hazards: no evidence for loose, tidal' FROM p WHERE n % 7 = 2 UNION ALL SELECT id, 'hazards: no evidence for tidal' FROM p WHERE n % 7 = 3
    UNION ALL SELECT id, 'area_id: is missing' FROM p WHERE n % 11 = 0 UNION ALL SELECT id, 'area_id: no area ' || (n + 60 * (id % 2)) FROM p WHERE n % 11 <> 0 AND n + 60 * (id % 2) NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 80)""",
)
def invalid(spark, sf_dir):
    """One scan finds all that a declared schema forbids; references go to the areas that there are."""
    k, n = F.col("p_partkey") % 9, F.col("p_size")
    hazard = lambda code, evidence: F.struct(F.lit(code).alias("code"), F.lit(evidence).cast("string").alias("evidence"))
    found = F.when(n % 7 == 1, F.array(hazard("bees", None))).when(n % 7 == 2, F.array(hazard("tidal", " "), hazard("loose", None), hazard("nesting", None))).when(n % 7 == 3, F.array(hazard("tidal", ""), hazard("loose", "seen")))
    routes = load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(k == 1, "  ").when(k > 1, F.col("p_name")).alias("name"), F.when(k == 2, "gone").when(k.isin(3, 4), "publish").otherwise("draft").alias("status"),
        F.when(k == 4, "human").otherwise("source").alias("tagged_by"), F.col("p_type").alias("rock"), (n % 6 - 1).alias("stars"),
        F.when(n % 5 == 0, F.array(F.lit("ice"), F.lit("trad"), F.lit(None), F.lit("ice"))).otherwise(F.array(F.lit("sport"))).alias("disciplines"), found.alias("hazards"),
        F.when(n % 11 != 0, n + 60 * (F.col("p_partkey") % 2)).alias("area_id"),
    )
    areas = load(spark, sf_dir, "supplier").where("s_suppkey < 80").select(F.col("s_suppkey").alias("id"))
    return crawl.invalid_records(routes, "id", SCHEMA, {"area": areas})


# Topos, documents, relocation


@PLANS.plan(
    "snk_05_topos",
    """WITH l AS (SELECT l_orderkey % 4000 AS topo, p_name AS name, s_name AS area, l_partkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = p_size WHERE l_partkey % 7 <> 0),
    t AS (SELECT c_custkey AS id, c_name AS title, c_nationkey AS media, n_name AS area_name FROM customer LEFT JOIN nation ON n_nationkey = c_custkey % 40 WHERE c_nationkey % 5 <> 0)
    SELECT t.title, t.area_name, 'm/' || t.media AS uri, count(l.topo) AS n_lines, min(l.name) AS first_route, coalesce(string_agg(l.name || '/' || coalesce(l.area, '') || '/' || l.l_linenumber, ';' ORDER BY l.name, l.area NULLS FIRST, l.l_linenumber), '') AS lines
    FROM t LEFT JOIN l ON l.topo = t.id GROUP BY ALL""",
)
def topos(spark, sf_dir):
    """Topos with their picture, area and lines by names, written as JSON and read again."""
    customer, nation = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    head = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("publish").alias("status"), F.lit(4).alias("belay_size"), F.col("c_nationkey").alias("media_id"), (F.col("c_custkey") % 40).alias("area_id"))
    media = nation.where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("id"), _text("m/", F.col("n_nationkey")).alias("uri"), F.lit("photo").alias("kind"), F.lit(800).alias("width_px"), F.lit(600).alias("height_px"), F.lit("2026-01-01").cast("date").alias("taken_at"))
    areas = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    lines = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 4000).alias("topo_id"), F.col("l_partkey").alias("route_id"), F.lit("[]").alias("line"), F.col("l_linenumber").alias("pitches"), F.lit("walk").alias("descent"), F.lit("s").alias("source_id"))
    routes = load(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") + 1000).alias("area_id"))
    sectors = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"))
    out = crawl.topo_export(head, media, areas.unionByName(sectors), lines, routes)
    path = own_path(spark, "topos")
    out.write.json(path)
    read = spark.read.json(path, schema=out.schema)
    line = lambda x: F.concat(x["route_name"], F.lit("/"), F.coalesce(x["route_area"], F.lit("")), F.lit("/"), x["pitches"].cast("string"))
    return read.select("title", "area_name", "uri", F.size(F.coalesce("lines", F.array())).cast("long").alias("n_lines"), F.get("lines.route_name", F.lit(0)).alias("first_route"), F.array_join(F.transform(F.coalesce("lines", F.array()), line), ";").alias("lines"))


_DOCUMENTS = """WITH o AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
c AS (SELECT user_id AS k, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), b AS (SELECT {bound} AS bound),
m AS (SELECT c_custkey AS k, c_name AS name, greatest(1, coalesce((SELECT max(ceil(n / bound)) FROM o, b WHERE o.k = c_custkey), 1), coalesce((SELECT max(ceil(n / bound)) FROM c, b WHERE c.k = c_custkey), 1)) AS pages FROM customer),
p AS (SELECT k, name, pages, unnest(generate_series(1, CAST(pages AS BIGINT))) AS page FROM m)
SELECT k AS venue, CAST(page AS INT) AS page, CAST(pages AS INT) AS pages, name, coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY n) FROM o, b WHERE o.k = p.k AND ceil(n / bound) = page), '') AS orders,
coalesce((SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY n) FROM c, b WHERE c.k = p.k AND ceil(n / bound) = page), '') AS events FROM p"""


@PLANS.plan("snk_08_documents", _DOCUMENTS.format(bound="8.0::DOUBLE"))
def documents(spark, sf_dir):
    """Venues with two child tables as documents of at most eight rows of each, written and read again; what is beyond goes to further pages."""
    venues = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("venue"), F.col("c_name").alias("name"))
    orders = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("venue"), "o_orderkey", F.col("o_orderdate").cast("string").alias("day"))
    told = load(spark, sf_dir, "events").select(F.col("user_id").alias("venue"), "event_id", "event_type")
    out = dashboard.nested_documents(venues, "venue", {"orders": (orders, ["day", "o_orderkey"]), "events": (told, ["event_id"])}, bound=8)
    path = own_path(spark, "documents")
    out.write.json(path)
    read = spark.read.json(path, schema=out.schema)
    listed = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x.cast("string")), ",")
    return read.select("venue", "page", "pages", "name", listed(F.col("orders.o_orderkey")).alias("orders"), listed(F.col("events.event_id")).alias("events"))


@PLANS.plan(
    "pj_30_relocated",
    f"""{_TREE}, c AS (SELECT up.id, up.k, b.name, {_KINDS.replace('id %', 'b.id %')} AS kind FROM up JOIN a b ON b.id = up.ancestor),
    g AS (SELECT id, arg_min(name, k) FILTER (kind = 'country') AS country, arg_min(name, k) FILTER (kind = 'region') AS region, arg_max(name, k) FILTER (kind IN ('sector', 'crag')) AS crag,
    arg_min(name, k) FILTER (kind IN ('sector', 'crag')) AS lowest, count(*) FILTER (kind IN ('sector', 'crag')) AS n FROM c GROUP BY id),
    r AS (SELECT o_orderkey AS id, 'Route ' || o_orderkey % 50 AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'own' END AS sector, o_custkey AS area_id FROM orders),
    q AS (SELECT r.id, coalesce({_SLUG('g.country')}, 'unknown') || '/' || coalesce({_SLUG('g.region')}, 'unsorted') || '/' || coalesce({_SLUG('coalesce(crag, region)')}, 'unknown') AS folder,
      'route-' || r.id % 50 AS slug, coalesce(r.sector, CASE WHEN n > 1 THEN lowest END) AS sector FROM r LEFT JOIN g ON g.id = r.area_id)
    SELECT id, folder || '/' || slug || CASE WHEN id <> min(id) OVER (PARTITION BY folder, slug) THEN '-' || id ELSE '' END || '.json' AS path, sector FROM q""",
)
def relocated(spark, sf_dir):
    """Routes under hierarchical keys as a new version of a tree that holds an older one, read through what is in place."""
    areas = made(spark, sf_dir, "part", AREAS).select("id", "parent_id", "name", F.expr(_KINDS).alias("kind"))
    key = F.col("o_orderkey")
    routes = load(spark, sf_dir, "orders").select(key.alias("id"), _text("Route ", key % 50).alias("name"), F.when(key % 5 == 0, "own").alias("sector"), F.col("o_custkey").alias("area_id"))
    root = own_path(spark, "record")
    versions.relocate(spark, routes.where("id % 2 = 0"), areas, root)
    versions.relocate(spark, routes, areas, root)
    read = versions.read_tree(spark, root, "id long, sector string, file string, country string, region string, crag string")
    return read.select("id", F.concat_ws("/", "country", "region", "crag", "file").alias("path"), "sector")
