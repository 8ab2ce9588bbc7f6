"""Curators' requests, unique names, links between sources on small cases and against brute force."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import editing, mentions, proximity, records, slugs
from weftline.operators.graph import connected

KINDS = {"name": "text", "stars": "int", "tidal": "bool"}


def test_patches_are_whole_and_the_last_one_holds(spark):
    routes = spark.createDataFrame([(1, "a", 2, None, 0.0, 0.0, "k"), (2, None, None, True, None, None, "k")], "id int, name string, stars int, tidal boolean, lat double, lon double, other string")
    bodies = [
        (1, 1, {"stars": " 3 "}), (2, 1, {"stars": None, "name": "b"}), (3, 1, {"stars": "4", "lat": "91", "lon": "0"}), (4, 2, {"tidal": "No", "lat": "-90", "lon": "180"}),
        (5, 2, {"other": "x"}), (6, 2, {}), (7, 9, {"name": "x"}), (8, 2, {"lat": "nan", "lon": "1"}), (9, 2, {"stars": "1.5", "name": "z"}), (10, 2, {"lon": "1"}), (11, 2, {"name": None}),
    ]
    answered = editing.answer_patches(routes, spark.createDataFrame(bodies, "request int, id int, body map<string,string>"), KINDS)
    assert {r.request: r.problem for r in answered.collect()} == {
        1: None, 2: None, 3: "lat/lon out of range", 4: None, 5: "nothing to patch", 6: "nothing to patch", 7: "no such route", 8: "lat and lon must both be numbers",
        9: "stars must be a whole number", 10: "lat and lon must both be numbers", 11: None,
    }
    assert sorted(map(tuple, editing.apply_patches(routes, answered, KINDS).collect())) == [(1, "b", None, None, 0.0, 0.0, "k"), (2, None, None, False, -90.0, 180.0, "k")]


def test_names_of_new_routes_are_taken_in_order(spark):
    routes = spark.createDataFrame([(7, "Old One", 1)], "id long, name string, area_id long")
    areas = spark.createDataFrame([(1,), (2,)], "id long")
    asked = [(1, " old one", 1), (2, "New", 1), (3, "NEW", 1), (4, "new", 2), (5, None, 1), (6, "x", 3), (7, "y", None)]
    got = {r.request: (r.problem, r.id) for r in editing.create_routes(routes, areas, spark.createDataFrame(asked, "request long, name string, area_id long")).collect()}
    taken = "a route with that name exists in this area"
    assert got == {1: (taken, None), 2: (None, 8), 3: (taken, None), 4: (None, 9), 5: ("a new climb needs a name", None), 6: ("no such area", None), 7: ("no such area", None)}


def test_codes_of_words(spark):
    words = spark.createDataFrame([("rock", "slate", "m", None)], "family string, code string, meaning string, kind string")
    uses = spark.createDataFrame([("rock", "slate")], "family string, code string")
    asked = [(1, "rock", "sandstone", "add", "m", None), (2, "rock", "two words", "add", "m", None), (3, "rock", "a\\b", "add", "m", None), (4, "rock", "x" * 41, "add", "m", None), (5, "rock", "slate", "delete", None, None), (6, "rock", "a;b", "add", "m", None), (7, "rock", None, "add", "m", None)]
    answers, after = editing.change_vocabulary(words, uses, spark.createDataFrame(asked, "request int, family string, code string, what string, meaning string, kind string"))
    assert {r.request: r.problem for r in answers.collect()} == {1: None, 5: "used by 1", **dict.fromkeys((2, 3, 4, 6, 7), "code must be one token")}
    assert sorted(r.code for r in after.collect()) == ["sandstone", "slate"]


def plain_slugs(rows):
    taken, out = set(), {}
    for id_, base, up in rows:
        name = base
        if name in taken and up:
            name = f"{base}--{up}"
        n = 2
        while name in taken:
            name, n = f"{base}--{n}", n + 1
        taken.add(name)
        out[id_] = name
    return out


@pytest.mark.parametrize("seed", range(2))
def test_unique_slugs_match_choosing_one_by_one(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "a--b", "a--2", "b--a", "a--b--2", "a--3", "b--2"]
    rows = [(i, r.choice(names), r.choice([None, "a", "b", "2", ""])) for i in range(120)] + [(200 + i, "hot", None) for i in range(60)]
    r.shuffle(rows)
    # ``slug`` folds runs of dashes, so names that end in --2 are built as one with a parent of that name would be.
    from weftline.functions.text import slug

    df = spark.createDataFrame([(*x, n) for n, x in enumerate(rows)], "id int, name string, parent_name string, n int")
    bases = {x.id: (x.base or "", x.up) for x in df.select("id", slug(F.col("name")).alias("base"), F.when(F.col("parent_name") != "", slug(F.col("parent_name"))).alias("up")).collect()}
    got = {x.id: x.slug for x in slugs.unique_slugs(df, [F.col("n")]).collect()}
    assert got == plain_slugs([(i, *bases[i]) for i, _, _ in rows]) and len(set(got.values())) == len(rows)
    assert slugs.unique_slugs(df.limit(0), [F.col("n")]).count() == 0


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("seed", range(2))
def test_entity_links_connect_what_pairs_connect(spark, seed):
    r = random.Random(seed)
    places = [(i, r.choice(["Rock", "Wall", "Fell"]), r.choice("abc" if seed else "a"), *r.choice([(None, None), (10.0, None), (r.randrange(4) * 0.006, 5.0), (r.randrange(4) * 0.006, 5.0), (50.0, 60.0)])) for i in range(90)]
    df = spark.createDataFrame(places, "id long, name string, source string, lat double, lon double")
    one = df.select(F.col("id").alias("a"), F.col("id").alias("b"))
    same = records.place_pairs(df).where("verdict = 'same'").select("a", "b")
    want = {(a, b) for a, n, s, *p in places for b, m, t, *q in places if a < b and n == m and s != t and (None in p or None in q or km(p, q) < 1)}
    assert {tuple(x) for x in same.collect()} == want
    groups = lambda links: {x.node: x.root for x in connected(links.unionByName(one)).collect()}
    links = records.entity_links(df)
    assert groups(links) == groups(same)
    assert links.count() <= len(want) + len(places)


def test_ambiguous_places_against_all_pairs(spark):
    from difflib import SequenceMatcher

    r = random.Random(5)
    names = ["fair head", "fair heads", "fare head", "the fair head", "dalkey", "dalkey quarry"]
    places = [(i, r.choice(names), r.choice("ab"), r.randrange(6) * 0.003, 5.0) for i in range(60)]
    got = {(x.a, x.b) for x in records.place_pairs(spark.createDataFrame(places, "id long, name string, source string, lat double, lon double")).where("verdict = 'ambiguous'").collect()}
    alike = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    want = {(a, b) for a, n, s, *p in places for b, m, t, *q in places if a < b and s != t and n != m and km(p, q) < 0.5 and 0.55 <= alike(n, m) < 1}
    assert got == want and len(want) > 20


def test_nearest_distance_and_names_in_texts(spark):
    r = random.Random(8)
    a = [(i, r.uniform(-80, 80), r.uniform(-180, 180), i % 3) for i in range(40)] + [(99, None, 1.0, 0), (98, 1.0, 1.0, 7)]
    b = [(r.uniform(-80, 80), r.uniform(-180, 180), i % 3) for i in range(30)] + [(None, 0.0, 0)]
    da, db = spark.createDataFrame(a, "id int, lat double, lon double, k int"), spark.createDataFrame(b, "lat double, lon double, k int")
    got = {x.id: x.km for x in proximity.nearest_distance(da, db, "id", ["k"], 700.0).collect()}
    want = {i: min(km((y, x), (v, w)) for v, w, m in b if m == k and v is not None) for i, y, x, k in a if y is not None and k < 3}
    assert got == pytest.approx(want)
    assert proximity.nearest_distance(da, db.limit(0), "id").count() == 0
    docs = spark.createDataFrame([(1, "On the FAIR head, today"), (1, "no"), (2, "fair-head"), (3, "fairhead of"), (4, None), (5, "head fair the")], "doc int, text string")
    places = spark.createDataFrame([("p", "Fair Head"), ("q", "The fair"), ("r", "head"), ("s", "of"), ("t", "!!!!")], "place string, name string")
    assert sorted(map(tuple, mentions.named_places(docs, places).collect())) == [(1, "p"), (1, "q"), (1, "r"), (2, "p"), (2, "r"), (5, "r")]
