"""Operators that no query over the driver's tables covers, on small made inputs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import mentions, proximity, records, weather_rollups
from weftline.operators.search import check_words
from weftline.sources import files, sinks
from weftline.streaming import queues


def test_day_and_night_rain(spark):
    rows = [("v", "2026-07-24", 12, 1.5), ("v", "2026-07-24", 22, 2.0), ("v", "2026-07-25", 2, 3.0)]
    hours = spark.createDataFrame(rows, "venue string, d string, hr int, mm double").select("venue", F.to_date("d").alias("d"), "hr", "mm", F.lit(None).cast("double").alias("prob"), F.lit(None).cast("double").alias("dew"), F.lit(None).cast("double").alias("humid"))
    got = {str(r.d): r for r in weather_rollups.daily_signals(hours).collect()}
    assert (got["2026-07-24"].rain_day, got["2026-07-24"].wet_hours, got["2026-07-24"].rain_night) == (1.5, 1, 0.0)
    assert (got["2026-07-25"].rain_day, got["2026-07-25"].rain_night, got["2026-07-25"].wet_hours) == (0.0, 5.0, 0)
    assert set(got) == {"2026-07-24", "2026-07-25"}


def test_payloads(spark, tmp_path):
    payload = {"venue": "v", "daily": {"time": ["2026-07-01", "2026-07-02"], "weathercode": [1, None], "temperature_2m_max": [20.0, 21.0]}, "hourly": {"time": [], "precipitation": []}}
    (tmp_path / "f.json").write_text(json.dumps(payload))
    read = files.forecast(spark, str(tmp_path / "f.json"))
    days = weather_rollups.payload_rows(read, "daily", ["time", "weathercode", "temperature_2m_max"], ["venue"]).collect()
    assert [tuple(d) for d in days] == [("v", "2026-07-01", 1, 20.0), ("v", "2026-07-02", None, 21.0)]
    raw = spark.createDataFrame([("v", json.dumps({"time": ["d1"], "temperature_2m_max_member01": [3.0], "temperature_2m_max": [4.0], "precipitation_sum": [0.0]}))], "venue string, daily string")
    members = weather_rollups.member_rows(files.member_payload(raw), ["venue"], "temperature_2m_max")
    assert sorted(r.value for r in members.collect()) == [3.0, 4.0]


def test_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('"a\nheader",b,c\nnote,,\nFair Head,NI,big\n,skipped,\nMourne,NI\n')
    got = files.sheet(spark, str(tmp_path / "s.csv"), ["area", "country", "volume"]).collect()
    assert [tuple(r) for r in got] == [(3, "Fair Head", "NI", "big"), (5, "Mourne", "NI", "")]


def test_documents_and_registry(spark, tmp_path):
    for path in ("top.json", "uk/ni/crag/route.json", "uk/ni/short.json", "routes/old.json", "media/a/b/c.json"):
        (tmp_path / "r" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / path).write_text(json.dumps({"name": path}))
    (tmp_path / "r/uk/ni/crag/broken.json").write_text("{")
    got = files.documents(spark, str(tmp_path / "r"), "name string").collect()
    assert sorted(r.path for r in got) == ["routes/old.json", "uk/ni/crag/route.json"]
    (tmp_path / "trips.json").write_text(json.dumps({"trips": [{"slug": "a", "flex_days": 2}, {"slug": "b"}]}))
    assert [(r.ord, r.slug, r.flex_days) for r in files.registry(spark, str(tmp_path / "trips.json")).collect()] == [(0, "a", 2), (1, "b", None)]


def test_reports_and_sinks(spark, tmp_path):
    ranked = spark.createDataFrame([(1, "A", 80, 1, False), (2, "B", 70, None, True)], "rank int, name string, score int, rank_delta int, rank_new boolean")
    lines = sinks.report_lines(ranked)
    assert [tuple(r) for r in files.report_rows(lines).collect()] == [(1, "A", 80), (2, "B", 70)]
    sinks.write_tree(ranked, str(tmp_path / "t"), ["name"])
    assert spark.read.json(str(tmp_path / "t")).where("name = 'A'").count() == 1
    areas = spark.createDataFrame([(1, "x"), (2, "y")], "id int, title string")
    routes = spark.createDataFrame([(1, "b", "publish"), (1, "a", "draft")], "area_id int, name string, status string")
    docs = {r.id: json.loads(r.document) for r in sinks.nested_export(areas, routes).collect()}
    assert [x["name"] for x in docs[1]["routes"]] == ["a", "b"] and docs[2]["routes"] == []


def test_pairs_across_the_date_line_and_poles(spark):
    a = spark.createDataFrame([(1, 0.0, 179.99), (2, 89.95, 10.0), (3, None, None)], "id int, lat double, lon double")
    b = spark.createDataFrame([(1, 0.0, -179.99), (2, 89.95, -170.0), (3, 50.0, 0.0)], "id int, lat double, lon double")
    got = {(r.id, r.b_id) for r in proximity.within_km(a, b, 20).collect()}
    assert got == {(1, 1), (2, 2)}


def test_place_pairs(spark):
    rows = [(1, "Fair Head", "s1", 55.22, -6.15), (2, "fair  head", "s2", 55.221, -6.15), (3, "Fair Heads", "s3", 55.2202, -6.15), (4, "FAIR HEAD", "s4", None, None), (5, "Fair Head", "s2", 40.0, 1.0)]
    got = {(r.a, r.b): r.verdict for r in records.place_pairs(spark.createDataFrame(rows, "id int, name string, source string, lat double, lon double")).collect()}
    assert got == {(1, 2): "same", (1, 4): "same", (2, 4): "same", (4, 5): "same", (1, 3): "ambiguous", (2, 3): "ambiguous"}


def test_mentions(spark):
    row = spark.range(1)
    keep = lambda host, link, text: row.select(mentions.relevant(F.lit(host), F.lit(link), F.lit(text), F.lit("Fair Head"), ["bad.com"], [".shop"], {"ukc.": ["/logbook"]}, ["good.org"], ["climb"])).collect()[0][0]
    assert not keep("www.bad.com", "http://bad.com/", "Fair Head climb")
    assert keep("ukc.com", "http://ukc.com/logbook/1", "") and not keep("ukc.com", "http://ukc.com/shop", "Fair Head climb")
    assert keep("a.good.org", "http://a.good.org", "") and keep("x.com", "http://x.com", "We climb at Fair-Head!") and not keep("x.com", "http://x.com", "Fair Head walk")
    docs = spark.createDataFrame([(1, "At FAIR HEAD today"), (2, "fairhead"), (3, None)], "doc int, text string")
    places = spark.createDataFrame([(7, "Fair Head"), (8, "Aid")], "place int, name string")
    assert [tuple(r) for r in mentions.named_places(docs, places).collect()] == [(1, 7)]


def test_link_health(spark):
    rows = [("a", "2026-01-01", 404), ("b", "2026-01-01", 500), ("c", "2026-01-01", 500), ("c", "2026-01-02", 503), ("d", "2026-01-01", 500), ("d", "2026-01-02", 200), ("d", "2026-01-03", 500)]
    checks = spark.createDataFrame(rows, "url string, day string, status int").withColumn("day", F.to_date("day"))
    assert {r.url: r.dead for r in mentions.link_health(checks).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_off_dictionary_words_raise(spark):
    vocabulary = spark.createDataFrame([("discipline", "trad")], "family string, code string")
    check_words({"discipline": ["trad"]}, vocabulary)
    with pytest.raises(ValueError, match="sport"):
        check_words({"discipline": ["sport"]}, vocabulary)


def test_queue(spark):
    items = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    log = spark.createDataFrame(
        [(1, "2026-01-01 10:00:00", "claim"), (1, "2026-01-01 10:01:00", "done"), (2, "2026-01-01 10:00:00", "claim"), (3, "2026-01-01 09:00:00", "claim"), (4, "2026-01-01 10:05:00", "claim"), (4, "2026-01-01 10:06:00", "error")]
        + [(5, f"2026-01-01 0{h}:00:00", "claim") for h in (1, 2, 3)],
        "id int, ts string, what string",
    ).withColumn("ts", F.to_timestamp("ts"))
    state = queues.queue_state(items, log, "2026-01-01 10:10:00")
    assert {r.id: r.status for r in state.collect()} == {1: "done", 2: "claimed", 3: "pending", 4: "pending", 5: "failed", 6: "pending"}
    assert [r.id for r in queues.claim(state, 2).collect()] == [3, 4]


def test_streams_match_batches(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, f"2026-01-01 {i // 4:02d}:{i % 4 * 15:02d}:00", "a" if i % 2 else "b", float(i)) for i in range(60)], "user_id int, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = queues.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, queues.windowed_counts(events).collect()))


def test_follow_queue_resumes(spark, tmp_path):
    for folder in ("in", "out"):
        (tmp_path / folder).mkdir()
    go = lambda: queues.follow_queue(spark, str(tmp_path / "in"), "id int, url string", str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.withColumn("n", F.length("url"))).awaitTermination(60)
    (tmp_path / "in/1.json").write_text('{"id": 1, "url": "ab"}\n{"id": 1, "url": "ab"}\n')
    go()
    (tmp_path / "in/2.json").write_text('{"id": 2, "url": "abc"}\n')
    go()
    assert sorted((r.id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 2), (2, 3)]
