"""Condition curves over days made from ``lineitem``: one row for each line, its numbers standing for a day's weather."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import conditions as c
from weftline.functions import weather as w
from weftline.plans.common import Plans, load, six

PLANS = Plans()

#: Expressions that both engines read alike.
DAY = {
    "k": "l_orderkey * 10 + l_linenumber",
    "t": "l_quantity - 10",
    "pct": "l_quantity * 2",
    "prob": "CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity * 2 END",
    "ens": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 101 AS DOUBLE) END",
    "code": "CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_partkey % 100 AS INT) END",
    "mm": "l_discount * 100",
    "rain_day": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_tax * 100 END",
    "rain_night": "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_discount * 50 END",
    "prob_day": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 101 AS DOUBLE) END",
    "wet_hours": "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END",
    "gust": "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE CAST(l_partkey % 80 AS DOUBLE) END",
    "sun": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity / 50 END",
    "dew": "CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE CAST(l_partkey % 25 AS DOUBLE) END",
    "felt": "l_quantity - 12",
    "wdir": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_partkey % 360 AS DOUBLE) END",
    "dry": "0.6 + l_discount * 10",
    "windf": "0.75 + l_tax * 5",
    "aspect": "CASE l_partkey % 9 WHEN 0 THEN 'N' WHEN 1 THEN 'ne' WHEN 2 THEN 'E' WHEN 3 THEN 'SE' WHEN 4 THEN 'S' WHEN 5 THEN 'SW' WHEN 6 THEN 'W' WHEN 7 THEN 'NW' ELSE NULL END",
    "coastal": "l_returnflag = 'R'",
    "tidal": "l_linestatus = 'F'",
    "drying": "CASE l_suppkey % 6 WHEN 0 THEN 'fast' WHEN 1 THEN 'slow' ELSE NULL END",
    "depth": "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity * 3 - 5 END",
    "course": "CASE l_partkey % 6 WHEN 0 THEN 'links' WHEN 1 THEN 'heathland' WHEN 2 THEN 'parkland' WHEN 3 THEN 'clay' ELSE NULL END",
}
_D = "WITH d AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in DAY.items()) + " FROM lineitem) SELECT k, {} FROM d"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in DAY.items()])


def _over(x: str, limit: float) -> str:
    return f"(CASE WHEN {x} > {limit} THEN {x} - {limit} ELSE 0 END)"


_HEAT = lambda t: f"({_over(t, 18)} * 1.5 + {_over(t, 24)} * 4 + {_over(t, 28)} * 6)"
_RAIN = lambda p: f"({_over(p, 12)} * 1.25 + {_over(p, 40)} * 1.5)"
_CODE = "(CASE WHEN code IS NULL THEN 0 WHEN code >= 95 THEN 90 WHEN code >= 80 THEN 75 WHEN code >= 71 THEN 80 WHEN code >= 61 THEN 80 WHEN code >= 51 THEN 60 WHEN code >= 45 THEN 40 WHEN code >= 1 THEN 20 ELSE 5 END)"
_CLAMP = lambda x: f"(CASE WHEN ({x}) < 0 THEN 0 WHEN ({x}) > 100 THEN 100 ELSE ({x}) END)"
_SHIFT = lambda other: f"(CASE upper(aspect) WHEN 'N' THEN -4 WHEN 'NE' THEN -3 WHEN 'NW' THEN -2 WHEN 'E' THEN -1 WHEN 'W' THEN 2 WHEN 'SE' THEN 3 WHEN 'SW' THEN 3 WHEN 'S' THEN 4 ELSE {other} END)"
_BEARING = "(CASE upper(aspect) WHEN 'N' THEN 0 WHEN 'NE' THEN 45 WHEN 'E' THEN 90 WHEN 'SE' THEN 135 WHEN 'S' THEN 180 WHEN 'SW' THEN 225 WHEN 'W' THEN 270 WHEN 'NW' THEN 315 END)"
_EXPOSURE = "(CASE WHEN course = 'links' OR coastal THEN 1.35 WHEN course = 'parkland' THEN 0.85 ELSE 1.0 END)"
_DRAIN = "(CASE WHEN drying = 'fast' THEN 0.6 WHEN drying = 'slow' THEN 1.5 ELSE CASE course WHEN 'links' THEN 0.5 WHEN 'heathland' THEN 0.8 WHEN 'parkland' THEN 1.3 WHEN 'clay' THEN 1.6 ELSE 1.0 END END)"
_GOLF_WIND = f"(CASE WHEN gust IS NULL THEN 0 ELSE ({_over('gust', 15)} * 1.2 + {_over('gust', 28)} * 2.0 + {_over('gust', 45)} * 3.0) END)"
_GOLF_TEMP = f"({_over('(10 - t)', 0)} * 2.5 + {_over('t', 30)} * 1.5)"
_THAW = f"({_over('t', 0)} * 3.0 + {_over('t', 6)} * 4.0)"
_TRAITS = (
    f"concat_ws(', ', CASE WHEN {_SHIFT(0)} <= -2 THEN 'shaded ' || upper(aspect) || ' face' WHEN {_SHIFT(0)} >= 3 THEN 'sunny ' || upper(aspect) || ' face' END, "
    "CASE WHEN coastal OR tidal THEN 'sea air' END, CASE WHEN drying IN ('fast', 'slow') THEN 'dries ' || drying || ' (curated)' END)"
)


def curve(name: str, sql: dict[str, str], build) -> None:
    """A query of one or more columns over the days, with each column's SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = days(spark, sf_dir)
        made: dict[str, Column] = build({n: F.col(n) for n in DAY})
        return d.select("k", *[(six(v) if sql[n].startswith("round(") else v).alias(n) for n, v in made.items()])

    PLANS.add(name, query, _D.format(", ".join(f"{e} AS {n}" for n, e in sql.items())))


def _r(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0"


curve("fn_01_heat", {"heat": _r(_HEAT("t"))}, lambda d: {"heat": c.heat_penalty(d["t"])})
curve("fn_02_rain", {"rain": _r(_RAIN("pct") + " / 1.2")}, lambda d: {"rain": c.rain_penalty(d["pct"], 1.2)})
curve("fn_03_day_rain", {"rain": _r(f"coalesce(prob, 0) * 0.8 + {_over('coalesce(prob, 0)', 50)} * 0.7")}, lambda d: {"rain": c.day_rain_penalty(d["prob"])})
_CLIMATE = lambda pct, t: _CLAMP(f"round_even(100 - {_RAIN(pct)} * (1 + (dry - 1) * 0.5) - {_over('(12 - ' + t + ')', 0)} * 2 - {_HEAT(t)}, 0)")
curve("fn_04_climate_score", {"score": _r(_CLIMATE("pct", "t"))}, lambda d: {"score": c.climate_score(d["pct"], d["t"], d["dry"])})
_NIGHT = "greatest(0.15, least(0.5, 0.25 * dry))"
_P = "(CASE WHEN rain_day IS NOT NULL THEN coalesce(prob_day, prob) ELSE prob END)"
_EFF = f"coalesce({_P}, ens, {_CODE})"
_START = f"(100.0 - ({_EFF} * 0.8 + {_over(_EFF, 50)} * 0.7) - CASE WHEN rain_day IS NOT NULL THEN rain_day * 6 + coalesce(rain_night, 0) * 6 * {_NIGHT} ELSE mm * 6 END)"
_WET = "(CASE WHEN rain_day IS NULL THEN TRUE ELSE rain_day >= 0.5 OR coalesce(wet_hours, 0) >= 1 END)"
_CAP = f"(CASE WHEN code IN (95, 96, 99) AND {_WET} THEN least({_START}, 15) WHEN code >= 61 AND {_WET} THEN least({_START}, 25) ELSE {_START} END)"
_DAYSCORE = _CLAMP(
    f"{_CAP} - CASE WHEN gust IS NULL THEN 0 ELSE {_over('gust', 30)} * 0.6 * windf END - CASE WHEN wet_hours IS NULL THEN 0 ELSE least(wet_hours, 12) * 0.8 * dry END"
    f" + coalesce((sun - 0.5) * 10, 0) - CASE WHEN dew IS NULL THEN 0 ELSE {_over('dew', 12)} * 1.2 END - {_HEAT('felt')} - {_over('(12 - felt)', 0)} * 2"
)
curve(
    "fn_05_day_score",
    {"score": _r(_DAYSCORE)},
    lambda d: {
        "score": c.day_score(
            {n: d[n] for n in ("code", "mm", "prob", "rain_day", "rain_night", "prob_day", "wet_hours", "gust", "sun", "dew", "felt")}
            | {"ens_prob": d["ens"], "all_hours": F.lit(None).cast("double"), "wind_factor": d["windf"], "drying_factor": d["dry"]}
        )
    },
)
curve("fn_06_night_weight", {"weight": _r(_NIGHT)}, lambda d: {"weight": c.night_weight(d["dry"])})
curve(
    "fn_07_wind_factor",
    {"factor": _r(f"1.0 + coalesce(0.25 * cos(radians(wdir - {_BEARING})), 0) + CASE WHEN coastal THEN 0.25 ELSE 0 END")},
    lambda d: {"factor": c.wind_factor(d["aspect"], d["wdir"], d["coastal"])},
)
curve(
    "fn_08_drying_factor",
    {"factor": _r(f"CASE WHEN drying = 'fast' THEN 0.7 WHEN drying = 'slow' THEN 1.4 ELSE greatest(0.6, least(1.6, 1.0 - {_SHIFT(1)} * 0.05 + CASE WHEN coastal OR tidal THEN 0.25 ELSE 0 END)) END")},
    lambda d: {"factor": c.drying_factor(d["drying"], d["aspect"], d["coastal"], d["tidal"])},
)
curve("fn_09_felt", {"felt_t": _r(f"t + {_SHIFT(1)} * CASE WHEN sun IS NULL THEN 0.7 ELSE least(1, greatest(0, sun)) END")}, lambda d: {"felt_t": c.felt_temperature(d["t"], d["aspect"], d["sun"])})
curve("fn_10_friction", {"label": "CASE WHEN dew < 8 THEN 'crisp' WHEN dew < 13 THEN 'good' WHEN dew < 17 THEN 'humid' WHEN dew IS NOT NULL THEN 'greasy' END"}, lambda d: {"label": c.friction_label(d["dew"])})
curve("fn_11_traits", {"traits": _TRAITS}, lambda d: {"traits": c.drying_traits(d["drying"], d["aspect"], d["coastal"], d["tidal"])})
curve("fn_12_rain_probability", {"by_code": _CODE, "effective": _r(f"coalesce(prob, ens, {_CODE})")}, lambda d: {"by_code": w.code_rain_prob(d["code"]), "effective": w.effective_rain_prob(d["prob"], d["ens"], d["code"])})
curve("fn_13_compass", {"point": "CASE WHEN wdir IS NOT NULL THEN ['N','NE','E','SE','S','SW','W','NW'][1 + (round_even(wdir / 45, 0)::INT % 8)] END"}, lambda d: {"point": w.compass(d["wdir"])})
_TYPICAL = "(CASE WHEN dew IS NULL THEN pct ELSE round_even(0.7 * pct + 0.3 * dew, 0) END)"
curve(
    "fn_14_blend",
    {"score": _r(f"CASE WHEN gust IS NOT NULL AND k % 7 + 1 >= 5 THEN gust WHEN gust IS NOT NULL THEN round_even((k % 7 + 1) / 5.0 * gust + (1 - (k % 7 + 1) / 5.0) * {_TYPICAL}, 0) ELSE {_TYPICAL} END")},
    lambda d: {"score": c.blend(d["gust"], (d["k"] % 7 + 1).cast("double"), F.lit(5.0), d["pct"], d["dew"])},
)
curve("fn_15_sunniness", {"sunny": _r("greatest(0.35, 1 - pct / 100)")}, lambda d: {"sunny": c.sunniness(d["pct"])})
curve(
    "fn_16_travel_fit",
    {"fit": _r("greatest(0, least(100, round_even(100 - 0.025 * (k % 5000), 0)))"), "fare": _r("round_even(40 + 0.08 * (k % 5000), 0)"), "cost": _r("greatest(0, least(100, 100 - (k % 500) / 4.0))")},
    lambda d: {"fit": c.signal(100 - (d["k"] % 5000) * 0.025), "fare": F.bround((d["k"] % 5000) * 0.08 + 40), "cost": c.clamp(100 - (d["k"] % 500) / 4)},
)
curve(
    "fn_17_trip_fit",
    {"trip": _r(f"greatest(0, 100 - 25 * {_over('(k % 12)', 5)})"), "coverage": _r("50 + least(50, 10 * (k % 9))")},
    lambda d: {"trip": c.clamp(100 - c.over(d["k"] % 12, 5) * 25), "coverage": (F.least(d["k"] % 9 * 10, F.lit(50)) + 50).cast("double")},
)
_LIVE = {
    "rain": _r(_CLAMP("round_even(100 - coalesce(prob, 0) * 0.8, 0)")),
    "heat": _r(_CLAMP(f"round_even(100 - {_HEAT('felt')} - {_over('(8 - felt)', 0)} * 2, 0)")),
    "wind": _r(f"CASE WHEN gust IS NOT NULL THEN {_CLAMP('round_even(100 - ' + _over('gust', 30) + ' * 0.6 * windf, 0)')} END"),
    "friction": _r(f"CASE WHEN dew IS NOT NULL THEN {_CLAMP('round_even(100 - ' + _over('dew', 12) + ' * 1.2, 0)')} END"),
    "drying": _r(f"CASE WHEN wet_hours IS NOT NULL THEN {_CLAMP('round_even(100 - least(wet_hours, 12) * 0.8 * dry, 0)')} END"),
}
curve("fn_19_live_dials", _LIVE, lambda d: c.live_dials(d["prob"], d["felt"], d["gust"], d["windf"], d["dew"], d["wet_hours"], d["dry"]))
curve(
    "fn_19_typical_dials",
    {
        "rain": _r(_CLAMP(f"round_even(100 - {_RAIN('pct')}, 0)")),
        "heat": _LIVE["heat"],
        "wind": _r("NULL"),
        "friction": _r("NULL"),
        "drying": _r(_CLAMP(f"round_even(100 - greatest(0, {_RAIN('pct')} * (dry - 1) * 0.5), 0)")),
    },
    lambda d: c.typical_dials(d["pct"], d["felt"], d["dry"]),
)
curve(
    "fn_21_golf",
    {
        "wind": _r(f"{_GOLF_WIND} * {_EXPOSURE}"),
        "drainage": _r(_DRAIN),
        "climate": _r(_CLAMP(f"round_even(100.0 - pct * 1.1 - {_GOLF_WIND} * {_EXPOSURE} - {_GOLF_TEMP}, 0)")),
        "day": _r(
            _CLAMP(
                f"(CASE WHEN code >= 95 THEN least(100.0 - coalesce(prob_day, prob, ens, {_CODE}) * 0.7 - coalesce(nullif(rain_day, 0), mm) * 5, 10) ELSE 100.0 - coalesce(prob_day, prob, ens, {_CODE}) * 0.7 - coalesce(nullif(rain_day, 0), mm) * 5 END)"
                f" - {_GOLF_WIND} * {_EXPOSURE} - {_GOLF_TEMP} - CASE WHEN wet_hours IS NULL THEN 0 ELSE least(wet_hours, 10) * 1.6 * {_DRAIN} END"
            )
        ),
    },
    lambda d: {
        "wind": c.golf_wind(d["gust"], c.golf_exposure(d["course"] == "links", d["coastal"], d["course"])),
        "drainage": c.golf_drainage(d["drying"], d["course"]),
        "climate": c.golf_climate(d["pct"], d["gust"], d["t"], c.golf_exposure(d["course"] == "links", d["coastal"], d["course"])),
        "day": c.golf_day(
            {n: d[n] for n in ("code", "mm", "prob", "prob_day", "rain_day", "gust", "wet_hours")}
            | {"ens_prob": d["ens"], "tmax": d["t"], "exposure": c.golf_exposure(d["course"] == "links", d["coastal"], d["course"]), "drainage": c.golf_drainage(d["drying"], d["course"])}
        ),
    },
)
_SKI_MM = "coalesce(nullif(rain_day, 0), mm)"
curve(
    "fn_22_ski",
    {
        "snow": _r("CASE WHEN depth >= 120 THEN 100 WHEN depth <= 0 THEN 0 WHEN depth >= 60 THEN round_even(70 + 30 * (depth - 60) / 60, 0) WHEN depth IS NOT NULL THEN round_even(70 * depth / 60, 0) END"),
        "fresh": _r("coalesce(least(depth, 40) * 0.5, 0)"),
        "climate": _r(_CLAMP(f"round_even(100 - {_THAW}, 0)")),
        "day": _r(_CLAMP(f"100.0 - {_THAW} - CASE WHEN t <= 0 THEN 0 ELSE least({_SKI_MM}, 20) * 5 END - coalesce({_over('gust', 60)} * 1.5, 0) + CASE WHEN code BETWEEN 71 AND 75 THEN 8 ELSE 0 END")),
    },
    lambda d: {"snow": c.ski_snow(d["depth"]), "fresh": c.ski_fresh(d["depth"]), "climate": c.ski_climate(d["t"]), "day": c.ski_day(d["code"], d["mm"], d["rain_day"], d["gust"], d["t"])},
)
curve("fn_23_wet_band", {"band": "CASE WHEN prob <= 30 THEN 'dry' WHEN prob > 55 THEN 'wet' ELSE 'mixed' END"}, lambda d: {"band": w.wet_band(d["prob"])})
curve(
    "fn_24_sky",
    {"sky": "CASE WHEN mm >= 2 THEN 'rain' WHEN prob < 25 THEN 'sunny' WHEN prob < 60 THEN 'sunny intervals' WHEN prob IS NOT NULL THEN 'cloudy' WHEN mm < 0.05 THEN 'sunny' WHEN mm < 0.5 THEN 'sunny intervals' ELSE 'cloudy' END"},
    lambda d: {"sky": w.sky_label(d["mm"], d["prob"])},
)
curve(
    "fn_26_uv",
    {"uv": _r("CASE WHEN cos(radians(abs(t * 2 - 23.44 * sin(radians((k % 365 + 1 + 284) / 365.0 * 360.0))))) <= 0 THEN 0 ELSE round_even(12.5 * pow(cos(radians(abs(t * 2 - 23.44 * sin(radians((k % 365 + 1 + 284) / 365.0 * 360.0))))), 2.42) * coalesce(1 - 0.5 * prob / 100, 1), 0) END")},
    lambda d: {"uv": w.uv_estimate(d["t"] * 2, d["k"] % 365 + 1, d["prob"])},
)
curve("fn_27_backtest", {"linear": _r("pct * 0.9"), "steep": _r(f"pct * 1.15 + {_over('pct', 45)} * 1.6")}, lambda d: c.backtest_penalties(d["pct"]))
