"""Payloads that are odd, tags off the vocabulary, countries of places against brute force."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import writeback
from weftline.sources import payloads


def landed(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item int, payload string")


def test_payloads_that_cannot_be_read_are_told(spark):
    odd = landed(spark, None, "", "<html>", "[1]", "{", "{}", '{"climbs": 3}')
    for got in (payloads.graph_areas(odd)[0], payloads.waypoints(odd)):
        rows = {r["item"]: r["rejected"] for r in got.collect()}
        assert {i for i, why in rows.items() if why} >= {0, 1, 2, 3}
    found = payloads.search_results(odd, (0.0, 0.0, 1.0, 1.0)).collect()
    assert {r["item"] for r in found} == set(range(7)) and all(r["rejected"] for r in found)
    assert payloads.graph_areas(odd)[1].count() == 0 and payloads.graph_areas(odd.limit(0))[0].count() == 0
    venues = spark.createDataFrame([(1, "x"), (2, None), (3, "{}"), (4, '{"daily": {"time": ["a", "b"], "precipitation_sum": [1.5]}}')], "venue int, payload string")
    assert [(r["time"], r["precipitation_sum"], r["cloud_cover_mean"]) for r in payloads.archive_days(venues).orderBy("time").collect()] == [("a", 1.5, None), ("b", None, None)]
    assert payloads.tide_hours(venues).count() == 0 and payloads.lodgings(venues, venues.select("venue", F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))).count() == 0


def test_titles_rocks_and_radii(spark):
    words = spark.createDataFrame([("Grit (hard)",), (" MICA SCHIST",), ("unknown",), (None,), ("Volcanic Tuff (soft)",)], "r string")
    assert [r[0] for r in words.select(payloads.rock_word(F.col("r"))).collect()] == ["gritstone", "schist", None, None, "volcanic"]
    locales = [("fr", "F"), ("en", "")], [("ca", "C"), ("xx", "X")], [("es", "S"), ("it", "I")], []
    pages = landed(spark, *[json.dumps({"waypoint": {"locales": [{"lang": a, "title": b} for a, b in some]}, "routes": [{"document_id": 1}]}) for some in locales])
    assert [r["name"] for r in payloads.waypoints(pages).orderBy("item").collect()] == ["F", "C", "I", "?"]
    box = spark.createDataFrame([(0.0, 0.0, 0.001, 0.001), (0.0, 0.0, 0.5, 0.5), (0.0, 0.0, 9.0, 9.0)], "s double, w double, n double, e double")
    radii = [r[0] for r in box.select(payloads.search_radius_km(F.col("s"), F.col("w"), F.col("n"), F.col("e"))).collect()]
    assert radii == [2, 41, 100]


def test_tags_of_nothing_and_of_unknown_routes(spark):
    kind = "id int, protection string, protection_style string, belays string, incline string, hazards array<struct<code: string, evidence: string>>, character array<string>, feature array<string>, flagged array<string>"
    vocabulary = {"protection": ["G"], "incline": ["slab"], "hazards": ["loose"], "character": ["crack"], "feature": ["roof"]}
    tags = spark.createDataFrame([(1, None, None, None, None, None, None, None, None), (2, "G", "none", "mixed", "slab", [("loose", "a"), ("loose", "b"), (None, "x")], ["crack", None], ["roof"], ["doubt"])], kind)
    checked = {r.id: r for r in writeback.checked_tags(tags, vocabulary).collect()}
    assert checked[1].protection == "UNSPECIFIED" and checked[1].flagged == ["protection"] and checked[1].hazards == []
    assert checked[2].flagged == ["doubt", "hazard:None", "character:None"] and checked[2].character == ["crack"] and checked[2].belays == "mixed"
    routes = spark.createDataFrame([(2, "R", None, None, None, "source", "kept")], "id int, protection string, protection_style string, belays string, incline string, tagged_by string, more string")
    hazards = spark.createDataFrame([], "id int, code string, evidence string")
    after, found, answers = writeback.write_back(routes, hazards, writeback.checked_tags(tags, vocabulary))
    assert [tuple(r) for r in after.collect()] == [(2, "G", "none", "mixed", "slab", "llm", "kept")]
    assert [tuple(r) for r in found.collect()] == [(2, "loose", "a")]
    assert {r.id: r.flags for r in answers.collect()} == {1: f"protection, {writeback.HUMAN}", 2: "doubt, hazard:None, character:None"}


def test_countries_of_places_match_a_plain_lookup(spark):
    r = random.Random(9)
    words = ["north", "wall", "big", "cove", "rock", "head", "Éire"]
    name = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 4)))
    places = sorted({name() for _ in range(60)})
    exact = [(p, "Exact") for p in places[::7]]
    sheet = [(i, name().upper() + r.choice(["", ", NI", "!"]), f"C{i}") for i in range(25)]
    df = spark.createDataFrame(sheet, "ord int, area string, country string")
    norm = {x.t: x.n for x in spark.createDataFrame([(t,) for t in {*places, *(a for _, a, _ in sheet)}], "t string").select("t", text.norm_name(F.col("t")).alias("n")).collect()}
    rows = {}
    for _, area, country in sheet:
        if norm[area].strip():
            rows[norm[area]] = country  # a later row of the same form takes its country, not its place

    def plain(place):
        if place in dict(exact):
            return "Exact"
        n = norm[place]
        if n in rows:
            return rows[n]
        own = set(n.split())
        return next((c for a, c in rows.items() if set(a.split()) <= own or own <= set(a.split())), "")

    got = {x.place: x.country for x in writeback.place_countries(spark.createDataFrame([(p,) for p in places], "place string"), spark.createDataFrame(exact, "name string, country string"), df, text.norm_name).collect()}
    assert got == {p: plain(p) for p in places}


def test_lines_and_pictures(spark):
    kind = "request int, topo int, route int, points array<array<double>>"
    asked = [(1, 1, 1, [[0.1234567, 0.5], [1.0, 0.0]]), (2, 1, 1, [[0.5, 0.5]]), (3, 1, 2, None), (4, 1, 3, [[0.0, 0.0], [0.5, None]]), (5, 1, 4, [[0.0], [1.0, 1.0]]), (6, 1, 5, []), (7, 1, 1, [[0.2, 0.2], [0.3, 0.3]])]
    there = spark.createDataFrame([(1, 2, [[0.0, 0.0], [1.0, 1.0]]), (1, 9, [[0.0, 0.0], [1.0, 1.0]])], "topo int, route int, points array<array<double>>")
    after, answers = writeback.put_lines(there, spark.createDataFrame(asked, kind))
    assert {(r.topo, r.route): r.points for r in after.collect()} == {(1, 1): [[0.2, 0.2], [0.3, 0.3]], (1, 9): [[0.0, 0.0], [1.0, 1.0]]}
    assert {r.request for r in answers.collect() if r.problem} == {2, 4, 5}


def test_flight_cells_spend_in_order(spark):
    from weftline.operators.flights import flight_cells

    r = random.Random(4)
    keys = [(f"o{i}", f"t{j}", "d") for i in range(3) for j in range(4)]
    cache, brings = {keys[0]: 10, keys[5]: 20}, {k: r.choice([None, n + 30]) for n, k in enumerate(keys)}
    asked = [(n, n % 9, "w", r.choice(["fly", "fly", "fly", "local", "drive", None]), *r.choice(keys)) for n in range(60)] + [(60, 1, "w", "fly", None, "t1", "d")]
    columns = "origin string, to string, dates string"
    for quota in (0, 1, 3, 99):
        cells, spent = flight_cells(
            spark.createDataFrame(asked, f"ord int, venue int, traveller string, mode string, {columns}"), spark.createDataFrame([(*k, p) for k, p in cache.items()], f"{columns}, price int"),
            spark.createDataFrame([(*k, p) for k, p in brings.items()], f"{columns}, price int"), quota,
        )
        known, left, want = dict(cache), quota, {}
        for n, _, _, mode, *key in asked:
            key = tuple(key)
            if mode in ("local", "drive"):
                want[n] = (mode, None)
            elif mode != "fly":
                want[n] = ("unknown", None)
            else:
                if key not in known and left > 0 and brings.get(key) is not None:
                    known[key], left = brings[key], left - 1
                want[n] = ("priced", known[key]) if key in known else ("link", None)
        assert {c.ord: (c.cell, c.price) for c in cells.collect()} == want
        assert {(s.origin, s.to, s.dates): s.price for s in spent.collect()} == {k: v for k, v in known.items() if k not in cache}


def test_mentions_and_their_dates(spark):
    import datetime as dt

    today = dt.date(2026, 3, 1)
    said = ["3 days ago", "1 week ago", "2 months ago", " 50 minutes ago", "Jul 15, 2026", "5 Jan 2026", "2026-02-28", "yesterday", "", None, "x days ago"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [r.d for r in rows.orderBy("i").select(payloads.published(F.col("s"), F.lit(today)).alias("d")).collect()]
    assert got == [dt.date(2026, 2, 26), dt.date(2026, 2, 22), dt.date(2025, 12, 31), today, dt.date(2026, 7, 15), dt.date(2026, 1, 5), dt.date(2026, 2, 28), None, None, None, None]
    answers = spark.createDataFrame([("s", "l", "q", t) for t in (None, "", "{}", '{"organic_results": [{"link": "https://a.b:1/c?d"}, {"title": "no link"}, {"link": ""}]}')], "seed string, lens string, query string, payload string")
    docs = [tuple(r) for r in payloads.mention_docs(answers, F.lit(today)).collect()]
    assert docs == [("s", "l", "q", None, "", "https://a.b:1/c?d", "a.b:1", "", None, None)]
    asked = payloads.search_queries(spark.createDataFrame([("A",), ("B",)], "seed string"), {"x": "{seed} and {seed}", "y": "z"})
    assert sorted(map(tuple, asked.collect())) == [("A", "x", "A and A"), ("A", "y", "z"), ("B", "x", "B and B"), ("B", "y", "z")]
    assert payloads.route_database(answers.select("payload")).count() == 0
