"""Weather roll-ups over readings made from ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import weather as w
from weftline.operators import weather_rollups as r
from weftline.plans.common import Plans, load, six

PLANS = Plans()

HOURS = {
    "venue": "user_id % 20",
    "d": "CAST(ts AS DATE)",
    "hr": "CAST(hour(ts) AS INT)",
    "mm": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) / 8 END",
    "prob": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 101 AS DOUBLE) END",
    "dew": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(user_id % 25 AS DOUBLE) END",
    "humid": "CAST(event_id % 100 AS DOUBLE)",
    "t": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 30 AS DOUBLE) END",
}
DAYS = {
    "venue": "o_custkey % 50",
    "d": "CAST(o_orderdate AS DATE)",
    "tmax": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 40 AS DOUBLE) END",
    "tmin": "CAST(o_orderkey % 20 AS DOUBLE)",
    "precip": "CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(o_orderkey % 9 AS DOUBLE) / 2 END",
    "wind": "CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) END",
    "cloud": "CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END",
    "wind_dir": "CASE WHEN o_custkey % 29 = 0 THEN NULL ELSE CAST((o_orderkey % 44) * 4 AS DOUBLE) END",
}
MEMBERS = {
    "venue": "l_suppkey % 40",
    "d": "CAST(l_shipdate AS DATE)",
    "member": "l_linenumber",
    "tmax": "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_quantity - 10 END",
    "precip": "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE CAST(l_partkey % 7 AS DOUBLE) END",
}
TRIP = {
    "venue": "l_suppkey % 40",
    "score": "l_quantity * 2",
    "tmax": "l_quantity - 10",
    "prob": "CAST(l_partkey % 101 AS DOUBLE)",
    "code": "CAST(l_partkey % 5 AS INT)",
    "gust": "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity + 10 END",
    "wet_hours": "CAST(l_linenumber AS DOUBLE)",
    "dew": "CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_quantity / 2 END",
    "am_dry": "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_returnflag = 'N' END",
}


def made(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return load(spark, sf_dir, table).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def cte(name: str, table: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {table})"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[six(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_H, _O, _M, _T = (cte(*x) for x in (("h", "events", HOURS), ("o", "orders", DAYS), ("m", "lineitem", MEMBERS), ("t", "lineitem", TRIP)))
_Z = lambda e: f"round(CAST({e} AS DOUBLE), 6) + 0.0"
_EVEN = lambda e: f"round_even({e}, 0) + 0.0"


def _signals(active: tuple[int, int]) -> str:
    a, b = active
    return f"""
WITH {_H},
own AS (SELECT venue, d, avg(dew) FILTER (hr BETWEEN 9 AND 18) AS dew, avg(humid) FILTER (hr BETWEEN 9 AND 18) AS humid,
  coalesce(sum(mm) FILTER (hr BETWEEN {a} AND {b}), 0) AS rain_day, coalesce(sum(mm) FILTER (hr < {a}), 0) AS dawn,
  count(*) FILTER (hr BETWEEN {a} AND {b} AND mm >= 0.2) AS wet_hours, max(prob) FILTER (hr BETWEEN {a} AND {b}) AS prob_day,
  count(*) FILTER (hr BETWEEN 7 AND 12 AND mm >= 0.2) = 0 AS am_dry FROM h GROUP BY venue, d),
eve AS (SELECT venue, d + 1 AS d, sum(mm) AS mm FROM h WHERE hr > {b} GROUP BY venue, d)
SELECT own.venue, own.d, {_Z('dew')} AS dew, {_Z('humid')} AS humid, {_Z('rain_day')} AS rain_day,
  {_Z('dawn + coalesce(eve.mm, 0)')} AS rain_night, wet_hours, prob_day, am_dry
FROM own LEFT JOIN eve ON own.venue = eve.venue AND own.d = eve.d"""


@PLANS.plan("ag_01_daily_signals", _signals((7, 19)))
def daily_signals(spark, sf_dir):
    return rounded(r.daily_signals(made(spark, sf_dir, "events", HOURS)))


@PLANS.plan("pj_02_golf_day_signals", _signals((8, 18)))
def golf_signals(spark, sf_dir):
    return rounded(r.daily_signals(made(spark, sf_dir, "events", HOURS), (8, 18)))


_MD = [f"07-{n:02d}" for n in range(5, 26)]


@PLANS.plan(
    "ag_02_climate",
    f"""WITH {_O} SELECT venue, {_EVEN('avg(tmax)')} AS tmax, {_EVEN('avg((coalesce(precip, 0) >= 3)::DOUBLE) * 100')} AS rain_pct,
    {_EVEN('avg(coalesce(wind, 0))')} AS wind, count(*) AS days
    FROM o WHERE tmax IS NOT NULL AND month(d) = 7 AND day(d) BETWEEN 5 AND 25 GROUP BY venue""",
)
def climate(spark, sf_dir):
    return rounded(r.climate(made(spark, sf_dir, "orders", DAYS), _MD))


_CIRCLE = lambda x: f"CASE WHEN count({x}) > 0 THEN round_even(CASE WHEN degrees(atan2(sum(sin(radians({x}))), sum(cos(radians({x}))))) < 0 THEN 360 ELSE 0 END + degrees(atan2(sum(sin(radians({x}))), sum(cos(radians({x}))))), 0) + 0.0 END"


@PLANS.plan(
    "ag_03_climate_series",
    f"""WITH {_O} SELECT venue, strftime(d, '%m-%d') AS md, {_Z('avg(tmax)')} AS tmax, {_Z('avg(coalesce(precip, 0))')} AS precip,
    {_Z('avg(coalesce(wind, 0))')} AS wind, {_Z('avg(cloud)')} AS cloud, {_CIRCLE('wind_dir')} AS dir FROM o WHERE tmax IS NOT NULL GROUP BY ALL""",
)
def climate_series(spark, sf_dir):
    return rounded(r.climate_series(made(spark, sf_dir, "orders", DAYS)))


@PLANS.plan(
    "ag_04_outlook",
    f"""WITH {_M}, d AS (SELECT venue, d, avg(tmax) AS t, coalesce(avg(precip), 0) AS p, count(DISTINCT member) AS members FROM m GROUP BY venue, d)
    SELECT venue, {_EVEN('avg(t)')} AS tmax, {_EVEN('avg((p >= 3)::DOUBLE) * 100')} AS rain_pct, {_Z('avg(p)')} AS precip, max(members) AS members
    FROM d WHERE t IS NOT NULL GROUP BY venue""",
)
def outlook(spark, sf_dir):
    return rounded(r.outlook(made(spark, sf_dir, "lineitem", MEMBERS)))


@PLANS.plan(
    "ag_05_ensemble",
    f"""WITH {_M} SELECT venue, d, {_EVEN('min(tmax)')} AS lo, {_EVEN('max(tmax)')} AS hi, {_EVEN('avg(tmax)')} AS mean, {_Z('stddev_pop(tmax)')} AS sd,
    count(tmax) AS members, {_EVEN('avg((precip >= 1)::DOUBLE) * 100')} AS p_rain FROM m GROUP BY venue, d HAVING count(tmax) > 0""",
)
def ensemble(spark, sf_dir):
    return rounded(r.ensemble(made(spark, sf_dir, "lineitem", MEMBERS)))


@PLANS.plan("ag_06_circular_mean", f"WITH {_O} SELECT venue, {_CIRCLE('wind_dir')} AS dir FROM o GROUP BY venue")
def circular(spark, sf_dir):
    return rounded(made(spark, sf_dir, "orders", DAYS).groupBy("venue").agg(w.circular_mean(F.col("wind_dir")).alias("dir")))


_NORMALS = f"""WITH {_O}, n AS (SELECT venue, CAST(month(d) AS INT) AS month, avg(tmax) AS tmax, avg(tmin) AS tmin, avg(wind) AS wind, count(*) FILTER (precip >= 1) AS precip_days FROM o GROUP BY ALL)"""


@PLANS.plan("ag_07_monthly_normals", f"{_NORMALS} SELECT venue, month, {_Z('tmax')} AS tmax, {_Z('tmin')} AS tmin, {_Z('wind')} AS wind, precip_days FROM n")
def normals(spark, sf_dir):
    return rounded(r.monthly_normals(made(spark, sf_dir, "orders", DAYS)))


@PLANS.plan(
    "ag_08_dry_warm_months",
    f"{_NORMALS}, c AS (SELECT *, min(precip_days) OVER (PARTITION BY venue) AS least FROM n WHERE tmax BETWEEN 8 AND 26) SELECT venue, month, precip_days FROM c WHERE precip_days <= least + 5",
)
def dry_warm(spark, sf_dir):
    return r.dry_warm_months(r.monthly_normals(made(spark, sf_dir, "orders", DAYS))).select("venue", "month", "precip_days")


@PLANS.plan(
    "ag_09_trip_rollup",
    f"""WITH {_T}, c AS (SELECT venue, code, row_number() OVER (PARTITION BY venue ORDER BY count(*) DESC, code) AS k FROM t GROUP BY venue, code)
    SELECT t.venue, {_EVEN('avg(score)')} AS score, {_EVEN('avg(tmax)')} AS tmax, max(prob) AS rain_prob, any_value(c.code) AS code, max(gust) AS gust_max,
    round(avg(wet_hours), 9) AS wet_hours, round(avg(dew), 9) AS dew, count(*) FILTER (am_dry) AS am_dry_days, count(am_dry) AS am_days
    FROM t JOIN c ON t.venue = c.venue AND c.k = 1 GROUP BY t.venue""",
)
def trip(spark, sf_dir):
    found = r.trip_rollup(made(spark, sf_dir, "lineitem", TRIP))
    return found.withColumns({c: F.round(c, 9) for c in ("wet_hours", "dew")} | {c: F.col(c) + 0.0 for c in ("score", "tmax")})


_LEVELS = "l AS (SELECT user_id % 50 AS venue, CAST(event_id AS BIGINT) AS ts, CAST((event_id * event_id) % 97 AS DOUBLE) / 10 AS level FROM events)"


@PLANS.plan(
    "wn_03_extremes",
    f"""WITH {_LEVELS}, n AS (SELECT *, lag(level) OVER g AS v0, lead(level) OVER g AS v2 FROM l WINDOW g AS (PARTITION BY venue ORDER BY ts))
    SELECT venue, ts, {_Z('CASE WHEN v0 - 2 * level + v2 <> 0 THEN (v0 - v2) / (2 * (v0 - 2 * level + v2)) ELSE 0 END')} AS offset_h,
    round(CASE WHEN v0 - 2 * level + v2 <> 0 THEN level - (v2 - v0) * (v2 - v0) / (8 * (v0 - 2 * level + v2)) ELSE level END, 9) + 0.0 AS height,
    CASE WHEN level >= v0 AND level > v2 THEN 'H' ELSE 'L' END AS kind
    FROM n WHERE v0 IS NOT NULL AND v2 IS NOT NULL AND ((level >= v0 AND level > v2) OR (level <= v0 AND level < v2))""",
)
def extremes(spark, sf_dir):
    levels = load(spark, sf_dir, "events").selectExpr("user_id % 50 AS venue", "event_id AS ts", "CAST((event_id * event_id) % 97 AS DOUBLE) / 10 AS level")
    found = r.extremes(levels)
    return found.withColumns({"height": F.round("height", 9) + 0.0, "offset_h": six(F.col("offset_h"))})


_ONCE = "first AS (SELECT venue, d, hr, max(t) AS t FROM h WHERE t IS NOT NULL GROUP BY ALL)"


@PLANS.plan("wn_07_hour_strip", f"WITH {_H}, {_ONCE} SELECT venue, d, " + ", ".join(f"max(t) FILTER (hr = {h}) AS h{h:02d}" for h in range(0, 24, 3)) + " FROM first GROUP BY venue, d")
def strip(spark, sf_dir):
    hours = made(spark, sf_dir, "events", HOURS).groupBy("venue", "d", "hr").agg(F.max("t").alias("t")).where("t IS NOT NULL")
    return r.hour_strip(hours, F.col("t")).select("venue", "d", *[F.col("hours")[h].alias(f"h{h:02d}") for h in range(0, 24, 3)])


@PLANS.plan(
    "jn_12_overlay",
    f"WITH {_O}, f AS (SELECT venue, d, tmax FROM o WHERE venue % 3 = 0 OR day(d) < 10) SELECT venue, d, tmax, 'fc' AS src FROM f UNION ALL SELECT venue, d, tmin, 'out' FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.venue = o.venue AND f.d = o.d)",
)
def overlay(spark, sf_dir):
    days = made(spark, sf_dir, "orders", DAYS)
    forecast = days.where("venue % 3 = 0 OR day(d) < 10").select("venue", "d", "tmax")
    return r.overlay(forecast, days.select("venue", "d", F.col("tmin").alias("tmax")))


@PLANS.plan(
    "jn_13_ensemble_merge",
    f"""WITH {_M}, {_O}, e AS (SELECT venue, d, round_even(avg((precip >= 1)::DOUBLE) * 100, 0) AS p FROM m GROUP BY venue, d HAVING count(tmax) > 0 AND count(precip) > 0)
    SELECT o.venue, o.d, o.tmax, e.p + 0.0 AS ens_prob FROM o LEFT JOIN e ON o.venue = e.venue AND o.d = e.d""",
)
def merge_ensemble(spark, sf_dir):
    spread = r.ensemble(made(spark, sf_dir, "lineitem", MEMBERS)).where("p_rain IS NOT NULL").select("venue", "d", F.col("p_rain").alias("ens_prob"))
    return made(spark, sf_dir, "orders", DAYS).select("venue", "d", "tmax").join(spread, ["venue", "d"], "left")


@PLANS.plan(
    "jn_14_night_before",
    f"""WITH {_H}, e AS (SELECT venue, d, sum(mm) FILTER (hr > 19) AS eve, sum(mm) FILTER (hr < 7) AS dawn FROM h GROUP BY venue, d)
    SELECT a.venue, a.d, {_Z('coalesce(b.eve, 0) + coalesce(a.dawn, 0)')} AS rain_night FROM e a LEFT JOIN e b ON a.venue = b.venue AND b.d = a.d - 1""",
)
def night_before(spark, sf_dir):
    return rounded(r.daily_signals(made(spark, sf_dir, "events", HOURS)).select("venue", "d", "rain_night"))


@PLANS.plan("ag_28_takeaway", f"WITH {_O} SELECT venue, count(*) FILTER (precip >= 3) AS wet_days, {_Z('avg(tmax)')} AS tmax, max(wind) AS wind FROM o WHERE d BETWEEN DATE '1995-06-01' AND DATE '1995-08-31' GROUP BY venue")
def takeaway(spark, sf_dir):
    days = made(spark, sf_dir, "orders", DAYS).where("d BETWEEN DATE '1995-06-01' AND DATE '1995-08-31'")
    return rounded(days.groupBy("venue").agg(F.count(F.when(F.col("precip") >= r.WET_DAY, 1)).alias("wet_days"), F.avg("tmax").alias("tmax"), F.max("wind").alias("wind")))
