"""Landed JSON payloads of route sources, weather archives, tides and lodging as tables; every schema is given, nothing is parsed in Python
but escaped texts.

Places come as (source, item, name, lat, lon, country, region, rock, routes): the routes' fields are those of ``adapters.ROUTE``
that the source states. A payload that isn't JSON gives a row with ``rejected`` and no name, so nothing is lost in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import geo, text

#: What sources call things, and the vocabulary's words. Fixed values.
GRADE_FIELDS = {"US": ("yds", "yds"), "FR": ("french", "french"), "UK": ("uiaa", "uiaa"), "AU": ("ewbank", "ewbank"), "ZA": ("ewbank", "ewbank")}
STYLES = ["trad", "sport", "bouldering", "alpine", "snow", "ice", "mixed", "aid", "tr", "deepwatersolo"]
SAFETY = {"G": "G", "PG": "PG", "PG13": "PG-13", "R": "R", "X": "X"}
ROCK_ALIASES = {"grit": "gritstone", "mica schist": "schist", "volcanic tuff": "volcanic", "tuff": "volcanic"}
ROCKS = [
    "andesite", "basalt", "chalk", "conglomerate", "dolerite", "dolomite", "gabbro", "gneiss", "granite", "gritstone", "limestone", "quartzite",
    "rhyolite", "sandstone", "schist", "slate", "volcanic",
]
FRENCH_ROCKS = {
    "calcaire": "limestone", "granit": "granite", "granite": "granite", "gneiss": "gneiss", "quartzite": "quartzite", "gres": "sandstone", "grès": "sandstone",
    "basalte": "basalt", "conglomerat": "conglomerate", "conglomérat": "conglomerate", "schiste": "schist", "dolomie": "dolomite",
    "calcaire_dolomitique": "dolomite", "andesite": "andesite", "rhyolite": "rhyolite",
}
LANGUAGES = ["en", "it", "fr", "de", "es"]
#: Farthest that a search by distance goes, and what a lodging may be.
FARTHEST_KM, LODGING_KM = 100, 15.0
LODGINGS = ["apartment", "chalet", "guest_house", "camp_site", "hotel", "hostel", "alpine_hut", "motel"]

_AREA = (
    "uuid string, areaName string, gradeContext string, pathTokens array<string>, metadata struct<lat: double, lng: double>, "
    "children array<struct<uuid: string, areaName: string, totalClimbs: int>>, "
    "climbs array<struct<uuid: string, name: string, length: int, boltsCount: int, safety: string, grades: map<string, string>, type: map<string, boolean>, "
    "pitches: array<struct<id: string>>, content: struct<description: string>>>"
)
_SEARCH = "success boolean, results array<struct<slug: string, name: string, osx: double, osy: double, nroutes: int, country_name: string, county_name: string, rocktype_name: string>>"
_LOCALES = "locales: array<struct<lang: string, title: string, summary: string, description: string>>"
_WAYPOINT = (
    f"waypoint struct<document_id: bigint, rock_types: array<string>, geometry: struct<geom: string>, {_LOCALES}>, "
    f"routes array<struct<document_id: bigint, rock_free_rating: string, global_rating: string, activities: array<string>, climbing_outdoor_type: string, height_diff_difficulties: int, {_LOCALES}>>"
)


def _mapped(value: Column, words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[value]


def _read(landed: DataFrame, schema: str) -> DataFrame:
    """``p``, a payload by its schema, null (with ``rejected``) where it isn't a JSON object.

    It comes out of a generator of one row, which filters and projections aren't moved through: else each would parse it again.
    """
    whole = F.coalesce(F.get_json_object("payload", "$").startswith("{"), F.lit(False))
    once = landed.withColumn("p", F.explode(F.array(F.when(whole, F.from_json("payload", schema)))))
    return once.withColumn("rejected", F.when(F.col("p").isNull(), "not a JSON object"))


def graph_areas(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, next items) of landed area answers (item, payload).

    The country is the path's first name, the region what lies between it and the area. A grade is that of the area's context
    (none known: the US one); US bouldering grades stand in the same field and begin with V. Lengths and bolts below 0, or no
    length, mean unknown. Only children with climbs go on.
    """
    p = _read(landed, _AREA)
    known = F.upper(F.coalesce("p.gradeContext", F.lit("")))
    fields = [F.coalesce(_mapped(known, {k: v[i] for k, v in GRADE_FIELDS.items()}), F.lit("yds")) for i in (0, 1)]
    p = p.withColumn("c", F.explode(F.array(F.struct(fields[0].alias("key"), fields[1].alias("system")))))  # once for an area, not for each climb
    key, system = F.col("c.key"), F.col("c.system")

    def route(c: Column) -> Column:
        grade = F.nullif(c["grades"][key], F.lit(""))
        named = F.when((system == "yds") & F.upper(grade).startswith("V"), "vscale").otherwise(system)
        return F.struct(
            c["uuid"].alias("source_id"), c["name"].alias("name"), grade.alias("grade"), F.when(grade.isNotNull(), named).alias("grade_system"),
            F.when(c["length"] > 0, c["length"]).alias("length_m"), F.nullif(F.size(F.coalesce(c["pitches"], F.array())), F.lit(0)).alias("pitches"),
            F.when(c["boltsCount"] >= 0, c["boltsCount"]).alias("bolts"), _mapped(F.upper(c["safety"]), SAFETY).alias("protection"),
            F.filter(F.array(*map(F.lit, STYLES)), lambda s: F.coalesce(c["type"][s], F.lit(False))).alias("disciplines"), F.coalesce(c["content"]["description"], F.lit("")).alias("description"),
        )

    path = F.coalesce("p.pathTokens", F.array().cast("array<string>"))
    region = F.nullif(F.array_join(F.slice(path, F.lit(2), F.greatest(F.size(path) - 2, F.lit(0))), " / "), F.lit(""))
    places = p.where("size(coalesce(p.climbs, array())) > 0 OR rejected IS NOT NULL").select(
        F.lit("graph").alias("source"), "item", F.col("p.areaName").alias("name"), F.col("p.metadata.lat").alias("lat"), F.col("p.metadata.lng").alias("lon"),
        F.get(path, F.lit(0)).alias("country"), region.alias("region"), F.transform(F.coalesce("p.climbs", F.array()), route).alias("routes"), "rejected",
    )
    child = p.drop("c").select("item", F.explode("p.children").alias("c")).where("c.totalClimbs > 0")
    return places, child.select(F.col("item").alias("parent"), F.col("c.uuid").alias("id"), F.col("c.areaName").alias("name"))


def search_radius_km(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Whole kilometres of a search that covers a box, at least 1 and at most what the source takes."""
    return F.least(F.greatest(F.lit(1), geo.covering_radius_km(south, west, north, east) + 1), F.lit(FARTHEST_KM)).cast("int")


def rock_word(name: Column) -> Column:
    """The vocabulary's word for a source's rock: brackets at its end don't count, some have other names, unknown ones are null."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"\s*\(.*\)$", "")
    word = F.coalesce(_mapped(low, ROCK_ALIASES), low)
    return F.when(word.isin(*ROCKS), word)


def search_results(landed: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Work items (id, name, lat, lon, country, region, rock) of landed search answers (item, payload) that lie in ``box``.

    An answer may stand in a viewer's page, between ``pre`` tags. Texts are escaped twice. A search's circle covers the box, so
    what lies in its corners goes. Answers that say no success, or aren't JSON, come as a row with ``rejected`` alone.
    """
    inner = F.regexp_extract("payload", r"(?s)<pre[^>]*>(.*?)</pre>", 1)
    bare = landed.withColumn("payload", F.trim(F.when(inner != "", inner).otherwise(F.col("payload"))))
    p = _read(bare, _SEARCH).withColumn("rejected", F.when(F.col("rejected").isNull() & ~F.coalesce("p.success", F.lit(False)), "no success").otherwise(F.col("rejected")))
    found = p.where("rejected IS NULL").select("item", F.explode("p.results").alias("r")).where(geo.in_box(F.col("r.osy"), F.col("r.osx"), *box))
    plain = lambda c: text.unescape(F.col(c))
    rows = found.select("item", F.col("r.slug").alias("id"), plain("r.name").alias("name"), F.col("r.osy").alias("lat"), F.col("r.osx").alias("lon"), plain("r.country_name").alias("country"), plain("r.county_name").alias("region"), plain("r.rocktype_name").alias("rock"))
    rows = rows.withColumn("rock", rock_word(F.col("rock"))).withColumn("rejected", F.lit(None).cast("string"))
    bad = p.where("rejected IS NOT NULL").select("item", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("item", "rejected")], "rejected")
    return rows.unionByName(bad)


def _title(locales: Column) -> Column:
    """The title in the first language that has one, else the first title, else a question mark."""
    listed = F.coalesce(locales, F.array())
    any_ = F.get(F.filter(F.transform(listed, lambda x: x["title"]), lambda t: t != ""), F.lit(0))
    return F.coalesce(*[_titled(listed, lang) for lang in LANGUAGES], any_, F.lit("?"))


def _titled(listed: Column, language: str) -> Column:
    return F.get(F.transform(F.filter(listed, lambda x: (x["lang"] == language) & (x["title"] != "")), lambda x: x["title"]), F.lit(0))


def waypoints(landed: DataFrame) -> DataFrame:
    """Places of landed waypoints with their routes (item, payload); points are in the web's Mercator projection.

    The rock is the first that the vocabulary knows. A route's grade is its free one or else the whole one's. Places without
    routes are left out.
    """
    p = _read(landed, _WAYPOINT)
    point = F.from_json("p.waypoint.geometry.geom", "coordinates array<double>")["coordinates"]
    lat, lon = geo.from_mercator(F.get(point, F.lit(0)), F.get(point, F.lit(1)))
    rock = F.get(F.array_compact(F.transform(F.coalesce("p.waypoint.rock_types", F.array()), lambda r: _mapped(F.lower(F.trim(r)), FRENCH_ROCKS))), F.lit(0))

    def route(c: Column) -> Column:
        grade = F.coalesce(F.nullif(c["rock_free_rating"], F.lit("")), F.nullif(c["global_rating"], F.lit("")))
        does = lambda a: F.coalesce(F.array_contains(c["activities"], a), F.lit(False))
        words = F.array_compact(F.array(F.when(does("ice_climbing"), "ice"), F.when(does("mountain_climbing"), "alpine"), F.when(c["climbing_outdoor_type"] == "multi", "multi-pitch")))
        summary = F.get(F.filter(F.transform(F.coalesce(c["locales"], F.array()), lambda x: x["summary"]), lambda s: s != ""), F.lit(0))
        return F.struct(
            c["document_id"].cast("string").alias("source_id"), _title(c["locales"]).alias("name"), grade.alias("grade"), F.when(grade.isNotNull(), "french").alias("grade_system"),
            c["height_diff_difficulties"].alias("length_m"), words.alias("disciplines"), F.coalesce(summary, F.lit("")).alias("description"),
        )

    return p.select(
        F.lit("waypoints").alias("source"), "item", _title(F.col("p.waypoint.locales")).alias("name"), lat.alias("lat"), lon.alias("lon"), rock.alias("rock"),
        F.transform(F.coalesce("p.routes", F.array()), route).alias("routes"), "rejected",
    ).where("size(routes) > 0 OR rejected IS NOT NULL")


ARCHIVE = {"temperature_2m_max": "double", "precipitation_sum": "double", "windspeed_10m_max": "double", "winddirection_10m_dominant": "double", "cloud_cover_mean": "double"}


def archive_days(landed: DataFrame) -> DataFrame:
    """(venue, time, values...) of landed archive answers (venue, payload); a value that an array lacks is null."""
    fields = "".join(f", {c}: array<{kind}>" for c, kind in ARCHIVE.items())
    p = landed.select("venue", F.from_json("payload", f"daily struct<time: array<string>{fields}>")["daily"].alias("d"))
    return p.select("venue", F.inline(F.arrays_zip(*[F.coalesce(F.col(f"d.{c}"), F.array().cast(f"array<{kind}>")).alias(c) for c, kind in {"time": "string", **ARCHIVE}.items()])))


def tide_hours(landed: DataFrame) -> DataFrame:
    """(venue, time, metres) of landed sea levels (venue, payload); hours beyond the model's reach are left out."""
    p = landed.select("venue", F.from_json("payload", "hourly struct<time: array<string>, sea_level_height_msl: array<double>>")["hourly"].alias("h"))
    each = p.select("venue", F.inline(F.arrays_zip("h.time", "h.sea_level_height_msl")))
    return each.where("sea_level_height_msl IS NOT NULL").select("venue", "time", F.col("sea_level_height_msl").alias("metres"))


def lodgings(landed: DataFrame, venues: DataFrame, km: float = LODGING_KM) -> DataFrame:
    """(venue, name, kind, km, web, pos) of landed map elements (venue, payload) within ``km`` of their venue (venue, lat, lon), nearest first.

    Elements without a name, a point of their own or a centre, or of another kind are left out. Equal distances to a tenth go by the
    element's place in the answer.
    """
    schema = "elements array<struct<lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    e = landed.select("venue", F.posexplode(F.from_json("payload", schema)["elements"]).alias("ord", "e"))
    lat, lon = F.coalesce("e.lat", "e.center.lat"), F.coalesce("e.lon", "e.center.lon")
    tag = lambda k: F.nullif(F.trim(F.col("e.tags")[k]), F.lit(""))
    rows = e.select("venue", "ord", tag("name").alias("name"), tag("tourism").alias("kind"), lat.alias("la"), lon.alias("lo"), F.coalesce(tag("website"), tag("contact:website"), F.lit("")).alias("web"))
    near = rows.where(F.col("kind").isin(*LODGINGS) & F.col("name").isNotNull()).join(venues.select("venue", "lat", "lon"), "venue")
    near = near.withColumn("km", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")), 1)).where(F.col("km") <= km)
    listed = near.groupBy("venue").agg(F.array_sort(F.collect_list(F.struct("km", "ord", "name", "kind", "web"))).alias("l"))  # an answer has 80 at most
    return listed.select("venue", F.posexplode("l").alias("pos", "s")).select("venue", "s.name", "s.kind", "s.km", "s.web", (F.col("pos") + 1).alias("pos"))


_FOUND = "organic_results array<struct<position: int, title: string, link: string, snippet: string, date: string>>"
#: How long ago units are, in days. Fixed values.
UNITS = {"minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30}


def published(raw: Column, today: Column) -> Column:
    """The date that a search states: so many minutes, hours, days, weeks or months (of 30 days) ago, or a date; null if neither."""
    ago = r"^(\d+)\s+(minute|hour|day|week|month)s?\s+ago"
    said = F.trim(raw)
    days = F.regexp_extract(said, ago, 1).try_cast("int") * _mapped(F.regexp_extract(said, ago, 2), UNITS)
    written = [F.try_to_timestamp(said, F.lit(f)).cast("date") for f in ("MMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd")]
    return F.when(said.rlike(ago), F.date_sub(today, days)).otherwise(F.coalesce(*written))


def search_queries(seeds: DataFrame, lenses: dict[str, str]) -> DataFrame:
    """(seed, lens, query) of the searches for each seed: one for each lens, whose text names the seed as ``{seed}``."""
    each = F.array(*[F.struct(F.lit(k).alias("lens"), F.lit(q).alias("q")) for k, q in lenses.items()])
    return seeds.select("seed", F.explode(each).alias("l")).select("seed", "l.lens", F.replace(F.col("l.q"), F.lit("{seed}"), F.col("seed")).alias("query"))


def mention_docs(landed: DataFrame, today: Column) -> DataFrame:
    """(seed, lens, query, position, title, url, site, snippet, published_at, published_raw) of landed answers (seed, lens, query, payload).

    Results without a link are left out; texts that are missing are empty; the site is the link's host as it stands.
    """
    r = landed.select("seed", "lens", "query", F.explode(F.from_json("payload", _FOUND)["organic_results"]).alias("r")).where("r.link <> ''")
    return r.select(
        "seed", "lens", "query", "r.position", F.coalesce("r.title", F.lit("")).alias("title"), F.col("r.link").alias("url"), F.regexp_extract("r.link", r"^[^/?#]*//([^/?#]*)", 1).alias("site"),
        F.coalesce("r.snippet", F.lit("")).alias("snippet"), published(F.col("r.date"), today).alias("published_at"), F.col("r.date").alias("published_raw"),
    )


def doc_counts(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """How many documents each search gave, those without any included."""
    found = docs.groupBy("seed", "lens").agg(F.count("*").alias("_n"))
    return queries.join(found, ["seed", "lens"], "left").select("seed", "lens", "query", F.coalesce("_n", F.lit(0)).alias("docs"))


def route_database(landed: DataFrame) -> DataFrame:
    """(id, name, lat, lon, grade, length_m, pitches) of the climbs of landed databases (payload); a payload without any gives none."""
    schema = "climbs array<struct<id: bigint, climbName: string, geoLocation: string, originalGrade: string, length: int, pitches: int>>"
    c = landed.select(F.explode(F.from_json("payload", schema)["climbs"]).alias("c"))
    at = lambda i: F.get(F.split("c.geoLocation", ","), F.lit(i)).try_cast("double")
    return c.select("c.id", F.col("c.climbName").alias("name"), at(0).alias("lat"), at(1).alias("lon"), F.nullif("c.originalGrade", F.lit("")).alias("grade"), F.col("c.length").alias("length_m"), "c.pitches")
