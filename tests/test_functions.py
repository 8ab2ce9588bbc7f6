"""Golden values of curves and scalar functions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import conditions, dates, geo, text, weather


def one(spark, *columns):
    row = spark.range(1).select(*columns).collect()[0]
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(("pct", "cost"), [(12, 0), (20, 10), (46, 51.5), (55, 76.25), (67, 109.25)])
def test_rain_penalty(spark, pct, cost):
    assert one(spark, conditions.rain_penalty(F.lit(pct))) == pytest.approx(cost)


@pytest.mark.parametrize(("t", "cost"), [(18, 0), (25, 14.5), (31, 65.5)])
def test_heat_penalty(spark, t, cost):
    assert one(spark, conditions.heat_penalty(F.lit(t))) == pytest.approx(cost)


def day(spark, **given):
    names = ("code", "mm", "prob", "ens_prob", "rain_day", "rain_night", "prob_day", "wet_hours", "all_hours", "gust", "wind_factor", "drying_factor", "sun", "dew", "felt")
    return one(spark, conditions.day_score({n: F.lit(given.get(n)).cast("int" if n == "code" else "double") for n in names}))


def test_rain_by_day_caps_the_score_and_rain_by_night_does_not(spark):
    assert day(spark, code=61, mm=4, prob=10, rain_day=4.0, wet_hours=3) <= 25
    assert day(spark, code=61, mm=4, prob=10, rain_day=0.0, rain_night=4.0, wet_hours=0) > 25
    assert day(spark, code=95, mm=1, prob=10, rain_day=2.0, wet_hours=2) <= 15


def test_nulls_cost_nothing(spark):
    assert day(spark, code=0, prob=0) == 100


def test_compass_and_codes(spark):
    assert one(spark, weather.compass(F.lit(350.0)), weather.compass(F.lit(22.5)), weather.compass(F.lit(None).cast("double"))) == ("N", "N", None)
    assert one(spark, weather.code_rain_prob(F.lit(None).cast("int")), weather.code_rain_prob(F.lit(96))) == (0, 90)


def test_sun_times(spark):
    t = weather.sun_times(F.lit(54.6), F.lit(-5.9), F.to_date(F.lit("2026-06-21")))
    rise, down, hours = one(spark, t["rise"], t["set"], t["daylight"])
    assert 220 < rise < 235 and 1255 < down < 1270 and 17 < hours < 17.5
    polar = weather.sun_times(F.lit(78.0), F.lit(15.0), F.to_date(F.lit("2026-06-21")))
    assert one(spark, polar["rise"], polar["daylight"]) == (None, 24.0)


def test_geo(spark):
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * 6371)
    lat, lon = geo.ewkb_point(F.lit("0101000020E6100000" + "0000000000002440" + "000000000000F0BF"))
    assert one(spark, lat, lon) == (-1.0, 10.0)
    assert one(spark, geo.parse_box(F.lit("1,2,3,4")).isNotNull(), geo.parse_box(F.lit("1,2,0,4")), geo.parse_box(F.lit("x"))) == (True, None, None)
    assert one(spark, *geo.vertex(F.lit(1.0), F.lit(2.0), F.lit(1.0))) == (0.0, 2.0)


def test_text(spark):
    assert one(spark, text.slug(F.lit("Großer Ödstein (Südwand)!")), text.slug(F.lit("!!"), default="route")) == ("gro-er-odstein-sudwand", "route")
    assert one(spark, text.norm_name(F.lit("  Ünder-Arch,  "))) == "under arch"
    assert one(spark, text.first_number(F.lit("3 days")), text.first_number(F.lit("none")), text.first_digit(F.lit("x"))) == (3, None, 9)
    assert one(spark, text.site_kind(F.lit("https://www.reddit.com/x"), ("reddit.com",), ("ukc.com",))) == "social"
    assert one(spark, text.unfence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    marks = one(spark, text.pitches(F.lit("[P1: 30m, 5a] Up. [P2: 25m, 4c] On.")))
    assert [(p.number, p.length_m, p.grade, p.words) for p in marks] == [(1, 30, "5a", "Up."), (2, 25, "4c", "On.")]


def test_similarity_and_pages(spark):
    rows = spark.createDataFrame([("under arch", "under arches", "a&amp;amp;b", 'x = {"a": "}]"};', "x = ")], "a string, b string, h string, page string, m string")
    got = rows.select(text.similarity("a", "b"), text.unescape("h"), text.balanced_json("page", "m")).collect()[0]
    assert got[0] == pytest.approx(20 / 22) and got[1] == "a&b" and got[2] == '{"a": "}]"}'


@pytest.mark.parametrize(("said", "age"), [("3 days ago", 3), ("2 settimane fa", 14), ("vor 2 Monaten", 60), ("2026-07-01", 9), ("gestern", 1), ("soon", None), (None, None)])
def test_days_ago(spark, said, age):
    assert one(spark, dates.days_ago(F.lit(said).cast("string"), F.to_date(F.lit("2026-07-10")))) == age


def test_flex_shifts(spark):
    assert one(spark, dates.flex_shifts(F.to_date(F.lit("2026-07-10")), 2, F.to_date(F.lit("2026-07-08")))) == [-1, 1, 2]
