"""Rules, keys, names and daylight on small made inputs and against brute force."""

from __future__ import annotations

import difflib
import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import daylight
from weftline.operators import curation


def test_grades(spark):
    rows = [("FS", "6a+", None), ("FS", "VI", "not a grade of the system"), ("UIAA", "VI−", None), ("YDS", "5.10a", None), (None, "6a", "no system"), ("FS", "", "no grade"), ("FS", None, "no grade"), ("none", "what", None)]
    df = spark.createDataFrame(rows, "system string, grade string, want string")
    assert [r.got for r in df.select(curation.grade_problem(F.col("system"), F.col("grade")).alias("got")).collect()] == [w for *_, w in rows]


def test_ladder_range(spark):
    df = spark.createDataFrame([("a", "VDiff"), ("a", " E2 "), ("b", "Severe"), ("c", "6a"), ("d", None)], "g string, grade string").withColumn("place", curation.ladder_place(F.col("grade")))
    assert {r.g: r.r for r in df.groupBy("g").agg(curation.ladder_range(F.col("place")).alias("r")).collect()} == {"a": "VD–E2", "b": "S", "c": "", "d": ""}


def test_tags_and_hazards(spark):
    df = spark.createDataFrame([(["slab", "odd", None, "crack"], [("loose", "LOOSE rock"), ("tidal", "sea"), ("loose", " "), ("odd", "loose")], "Some loose rock here")], "tags array<string>, hazards array<struct<code:string,evidence:string>>, body string")
    kept, dropped = curation.repaired_tags(F.col("tags"), ["slab", "crack"])
    row = df.select(kept.alias("kept"), dropped.alias("dropped"), curation.supported_hazards(F.col("hazards"), F.col("body"), ["loose", "tidal"]).alias("h")).first()
    assert row.kept == ["slab", "crack"] and row.dropped == ["odd", None]
    assert [tuple(h) for h in row.h] == [("loose", "LOOSE rock")]


def test_reference_rules(spark):
    current = spark.createDataFrame([(1, "ukc", "x"), (1, "mp", "m"), (2, "ukc", "y")], "route int, source string, external string")
    new = spark.createDataFrame([(1, "ukc", "y"), (1, "mp", "n"), (2, "ukc", "y"), (3, "ukc", "z")], "route int, source string, external string")
    verdicts = curation.add_references(current, new)
    assert {(r.route, r.external): r.verdict for r in verdicts.collect()} == {(1, "y"): "taken", (1, "n"): "added", (2, "y"): "added", (3, "z"): "added"}
    after = {tuple(r) for r in curation.after_references(current, verdicts).select("route", "source", "external").collect()}
    assert after == {(1, "ukc", "x"), (1, "mp", "n"), (2, "ukc", "y"), (3, "ukc", "z")}


def test_key_notes(spark):
    rows = [("Italia", "Lazio / Roma", "Italy", "Marche"), (None, None, "United Kingdom", "Northern Ireland"), ("Northern Ireland", "Antrim", "United Kingdom", "Northern Ireland"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "country string, region string, geo_country string, geo_region string")
    got = [(r.key_country, r.key_region, r.notes) for r in curation.key_parts(df, ["northern-ireland", "italy"]).collect()]
    assert got == [
        ("Italy", "Lazio", ["region path cut", "country localized", "CONFLICT"]),
        ("Northern Ireland", None, ["country from coordinates"]),
        ("Northern Ireland", "Antrim", []),
        (None, None, []),
    ]


def test_frontier_takes_each_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (4, 5)], "parent long, child long")
    seeds = spark.createDataFrame([(1,), (1,)], "id long")
    assert {r.id: r.round for r in curation.frontier(seeds, edges, 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=6), st.lists(st.text("abcd", min_size=1, max_size=9), min_size=1, max_size=6))
def test_fuzzy_matches_as_by_all_pairs(spark, sheet, venues):
    got = curation.fuzzy_matches(spark.createDataFrame(list(enumerate(sheet)), "row long, name string"), spark.createDataFrame(list(enumerate(venues)), "venue long, name string"))
    want = {}
    for (v, venue), (r, name) in itertools.product(enumerate(venues), enumerate(sheet)):
        if difflib.SequenceMatcher(None, name, venue).ratio() >= 0.8:
            want.setdefault(v, r)
    assert {r.venue: r.row for r in got.collect()} == want


def test_fuzzy_matches_of_all_short_words(spark):
    words = ["".join(w) for n in (1, 2, 3, 4) for w in itertools.product("abc", repeat=n)]
    got = curation.fuzzy_matches(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "row long, name string").orderBy(F.desc("row")), spark.createDataFrame(list(enumerate(words)), "venue long, name string"))
    want = {v: min(r for r, w in enumerate(words) if difflib.SequenceMatcher(None, w, venue).ratio() >= 0.8) for v, venue in enumerate(words)}
    assert {r.venue: r.row for r in got.collect()} == want


def test_fuzzy_refuses_a_looser_limit(spark):
    one = spark.createDataFrame([(1, "a")], "row long, name string")
    with pytest.raises(ValueError):
        curation.fuzzy_matches(one, one.withColumnRenamed("row", "venue"), 0.5)


def test_daylight(spark):
    rows = [("equator", 0.0, 0.0, "2026-03-20"), ("belfast", 54.6, -5.9, "2026-07-20"), ("north", 78.0, 15.0, "2026-06-21"), ("dark", 78.0, 15.0, "2026-12-21"), ("none", None, 15.0, "2026-12-21")]
    df = spark.createDataFrame(rows, "name string, lat double, lon double, day string").withColumn("sun", daylight.sun_times(F.col("lat"), F.col("lon"), F.to_date("day")))
    got = {r.name: r.sun for r in df.collect()}
    assert abs(got["equator"].hours - 12.1) < 0.1 and abs(got["equator"].sunrise - 365) < 5
    assert 16.4 < got["belfast"].hours < 17.1 and 240 < got["belfast"].sunrise < 260  # 05:10 summer time
    assert got["north"].hours == 24.0 and got["north"].sunrise is None and got["dark"].hours == 0.0 and got["none"] is None
    told = df.where("name = 'belfast'").select(daylight.clock(F.lit(250.0), F.lit(1)).alias("t")).first()
    assert told.t == "05:10"


def test_trip_rules_and_guidebooks(spark):
    known = spark.createDataFrame([(4, "i1", "One"), (7, None, "Two")], "id long, isbn string, title string")
    new = spark.createDataFrame([(1, "i1", "Renamed"), (2, None, "Two"), (3, "i9", "New"), (4, "i9", "New again"), (5, None, " "), (6, None, "Other")], "ord long, isbn string, title string")
    assert {r.ord: (r.id, r.is_new) for r in curation.guidebook_ids(known, new).collect()} == {1: (4, False), 2: (7, False), 3: (8, True), 4: (8, True), 6: (9, True)}
    lines = spark.createDataFrame([("a", "x"), ("a", None), ("a", "y"), ("b", "x")], "name string, area string")
    gone = spark.createDataFrame([("a", "x")], "name string, area string")
    assert sorted(tuple(r) for r in curation.without_lines_of(lines, gone).collect()) == [("a", "y"), ("b", "x")]
