"""Joins on pairs make no more rows than their results need, and the same results as comparing everything."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.operators import crawl, curation, proximity, records
from weftline.plans import choices


def watched(monkeypatch, module):
    """What the module's distance join is given and gives, as lists of counts."""
    asked, met, own = [], [], module.within_km

    def count(a, b, *args, **kwargs):
        found = own(a, b, *args, **kwargs)
        asked.append(a.count())
        met.append(found.count())
        return found

    monkeypatch.setattr(module, "within_km", count)
    return asked, met


def most_joined(df):
    """The most rows that a join of the query has made."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        rows = node.metrics().get("numOutputRows")
        if "Join" in name and rows.isDefined():
            most = max(most, rows.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_same_routes_meet_as_kinds(spark, monkeypatch):
    asked, _ = watched(monkeypatch, records)
    rows = spark.range(200).selectExpr("id", "'Line' AS name", "id % 2 AS crag", "10.0D AS lat", "20.0D + 0.001D * (id % 2) AS lon", "array(struct(CAST(id % 2 AS STRING) AS source, concat('e', id % 60) AS external_id)) AS refs")
    # An id on two crags, told of one reference twice.
    rows = rows.union(spark.sql("SELECT 500L, 'Line', 7L, 10.0D, 20.0D, array(struct('7' AS source, 'x' AS external_id)) UNION ALL SELECT 500L, 'Line', 8L, 10.0D, 20.0D, array(struct('8' AS source, 'y' AS external_id))"))
    got = sorted(map(tuple, records.same_routes(rows).collect()))
    all_rows = rows.collect()
    want = {(a.id, r.source, r.external_id) for a in all_rows for b in all_rows for r in b.refs if a.crag != b.crag and r.source not in [x.source for x in a.refs]}
    assert got == sorted(want)
    assert asked == [4]


def test_routes_of_one_kind_are_many_tasks_work(spark, monkeypatch):
    asked, _ = watched(monkeypatch, records)
    spelt, crag = "IF(id % 2 = 0, 'Line', 'LÍNE!') AS name", "IF(id < 5000, 0, id % 8 + 1)"
    rows = spark.range(5040).selectExpr("id", spelt, f"{crag} AS crag", "10.0D AS lat", f"20.0D + 0.001D * {crag} AS lon", f"array(struct(CAST({crag} AS STRING) AS source, concat('e', id) AS external_id)) AS refs")
    found = records.same_routes(rows).withColumn("part", F.spark_partition_id()).cache()
    want = 2 * 5000 * 40 + 40 * 35
    assert found.count() == found.select("id", "source", "external_id").distinct().count() == want
    of = {r.id: r.crag for r in rows.collect()}
    assert all(of[r.id] != int(r.source) == of[int(r.external_id[1:])] for r in found.sample(0.02, 1).collect())
    assert asked == [9]
    # Half of all rows are the large kind's.
    assert found.groupBy("part").count().agg(F.max("count")).first()[0] < want / 2


@pytest.mark.parametrize("km", [40, 300])
def test_nearest_makes_few_pairs(spark, monkeypatch, km):
    points = spark.range(3000).selectExpr("id", "CASE WHEN id % 31 = 0 THEN NULL ELSE CAST(id % 1000 * 7919 % 120000 AS DOUBLE) / 6000 - 10 END AS lat", "CAST(id % 1000 * 104729 % 360000 AS DOUBLE) / 18000 - 10 AS lon", "id % 3 = 0 AS tidal").cache()
    every = proximity.within_km(points, points, km).cache()
    want = sorted((r.id, r.pos, r.b_id, r.b_tidal) for r in proximity.nearest(every, "id", "b_id").collect())
    asked, met = watched(monkeypatch, proximity)
    got = sorted((r.id, r.pos, r.b_id, r.b_tidal) for r in proximity.nearest_within(points, points, "id", "id", km).collect())
    assert got == want
    assert asked[0] == 1000
    assert sum(met) < every.count() / 2


@pytest.mark.parametrize("query", [choices.cards, choices.tidal])
def test_nearest_queries_make_few_pairs(spark, monkeypatch, tmp_path, query):
    spark.range(400).selectExpr("id * 360000 + 1 AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "'m' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id * 360000 + 1 AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "1 AS p_size", "'t' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    _, met = watched(monkeypatch, proximity)
    query(spark, str(tmp_path)).collect()
    assert sum(met) == 6


def test_within_measures_each_pair_of_points_once(spark, monkeypatch, tmp_path):
    spark.range(400).selectExpr("id * 360000 + 1 AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "'m' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id * 360000 + 1 AS p_partkey", "'n' AS p_name", "'b' AS p_brand", "1 AS p_size", "'t' AS p_type").write.parquet(f"{tmp_path}/part.parquet")
    _, met = watched(monkeypatch, proximity)
    got = choices.within(spark, str(tmp_path))
    there = sum(1 for i in range(400) if (i * 360000 + 1) % 31)
    assert got.count() == got.distinct().count() == there * 400
    assert met == [1]


def test_pairs_of_one_name_are_many_tasks_work(spark):
    rows = spark.range(2500).selectExpr("id", "IF(id % 5 = 0, 'other', 'one') AS name", "IF(id % 7 = 0, NULL, id % 4) AS kind").coalesce(1)
    found = records.name_pairs(rows, "id", "name", "kind").withColumn("part", F.spark_partition_id()).cache()
    plain = [(r.id, r.name, r.kind) for r in rows.collect() if r.kind is not None]
    want = sum(1 for a in plain for b in plain if a[0] < b[0] and a[1] == b[1] and a[2] != b[2])
    assert found.where("a < b").count() == found.select("a", "b").distinct().count() == want
    most = found.groupBy("part").count().agg(F.max("count")).first()[0]
    assert most < want / 2


def test_pairs_of_lists_are_dealt_evenly(spark):
    rows = spark.range(4000).selectExpr("id", "'one' AS name", "id % 8 AS kind")
    found = records.name_pairs(rows, "id", "name", "kind")
    want = 28 * 500 * 500
    n, once, most = found.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first()
    every = spark.range(4000).alias("a").join(spark.range(4000).alias("b"), F.expr("a.id < b.id AND a.id % 8 <> b.id % 8"))
    assert (n, once) == (want, every.agg(F.bit_xor(F.xxhash64("a.id", "b.id"))).first()[0])
    # The first of eight kinds alone makes a quarter of all pairs.
    assert most < want / 8


def test_best_matches_of_different_names_alone(spark):
    places = spark.range(600).selectExpr("id", "IF(id % 2 = 0, 'North Wall', ' wall') AS name", "IF(id % 3 = 0, 'Wales', 'Union') AS country")
    candidates = spark.range(300).selectExpr("concat('u', id) AS uuid", "IF(id % 3 = 0, 'Wall', 'the north wall') AS name", "'Union' AS country", "id % 50 AS climbs")
    found = crawl.best_matches(places, candidates, {"Wales": "Union"})
    assert most_joined(found) <= 600
    # Most climbs, then the smallest uuid; 'wall' prefers the equal name.
    assert {(r.id % 2, r.uuid, r.climbs) for r in found.collect()} == {(0, "u149", 49), (1, "u249", 49)}
    assert found.count() == 600


def test_fuzzy_matches_of_different_names_alone(spark):
    sheet = spark.range(60).selectExpr("id AS row", "concat('wal', chr(97 + id % 20), ' north') AS name")
    venues = spark.range(3000).selectExpr("id AS venue", "IF(id % 2 = 0, 'walla north', 'nothing') AS name")
    found = curation.fuzzy_matches(sheet, venues)
    assert most_joined(found) <= 3000
    assert {(r.venue % 2, r.row) for r in found.collect()} == {(0, 0)} and found.count() == 1500
