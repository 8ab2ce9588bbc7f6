"""From hourly and daily readings to derived signals, normals and outlooks.

Inputs are tidy: a row for each place and hour, day or ensemble member. Local wall-clock times stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.geo import vertex
from weftline.functions.weather import circular_mean

#: Local hours, both included, of humidity means and of the morning; millimetres that make an hour wet.
DAYTIME, MORNING, WET_HOUR = (9, 18), (7, 12), 0.2
#: Millimetres that make a day wet: in the climate and in outlooks, and for an ensemble member.
WET_DAY, WET_MEMBER = 3.0, 1.0


def payload_rows(payload: DataFrame, part: str, columns: list[str], keys: list[str]) -> DataFrame:
    """Parallel arrays of a payload struct to a row for each time."""
    zipped = F.arrays_zip(*[F.col(f"{part}.{c}").alias(c) for c in columns])
    return payload.select(*keys, F.inline(zipped))


def member_rows(payload: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """A map of member series (name to array) to rows (keys, time, member, value), for names with a prefix."""
    members = F.map_filter("members", lambda name, _: name.startswith(prefix))
    each = payload.select(*keys, "time", F.explode(members).alias("member", "series"))
    return each.select(*keys, "member", F.inline(F.arrays_zip("time", F.col("series").alias("value"))))


def daily_signals(hours: DataFrame, active: tuple[int, int] = (7, 19)) -> DataFrame:
    """(venue, d, hr, mm, prob, dew, humid) to one row for each venue and day.

    rain_day and wet_hours count the active hours; rain_night is the evening before (by calendar, not by row) and this
    day's small hours; prob_day is the highest probability in the active hours; am_dry says that no morning hour was wet.
    One aggregation: an evening is counted for the day after by shifting its key before the shuffle.
    """
    h0, h1 = active
    hr = F.col("hr")
    in_hours = hr.between(h0, h1)
    own = hours.withColumns({"night": F.when(hr < h0, F.col("mm")), "late": F.lit(False)})
    evening = hours.where((hr > h1) & F.col("mm").isNotNull()).withColumns({"d": F.date_add("d", 1), "night": F.col("mm"), "late": F.lit(True)})
    both = own.unionByName(evening)
    mine = ~F.col("late")
    found = both.groupBy("venue", "d").agg(
        F.count(F.when(mine, 1)).alias("n"),
        F.avg(F.when(mine & hr.between(*DAYTIME), F.col("dew"))).alias("dew"),
        F.avg(F.when(mine & hr.between(*DAYTIME), F.col("humid"))).alias("humid"),
        F.coalesce(F.sum(F.when(mine & in_hours, F.col("mm"))), F.lit(0.0)).alias("rain_day"),
        F.coalesce(F.sum("night"), F.lit(0.0)).alias("rain_night"),
        F.count(F.when(mine & in_hours & (F.col("mm") >= WET_HOUR), 1)).alias("wet_hours"),
        F.max(F.when(mine & in_hours, F.col("prob"))).alias("prob_day"),
        (F.count(F.when(mine & hr.between(*MORNING) & (F.col("mm") >= WET_HOUR), 1)) == 0).alias("am_dry"),
    )
    return found.where("n > 0").drop("n")


def climate(days: DataFrame, month_days: list[str]) -> DataFrame:
    """(venue, d, tmax, precip, wind) over the years to means and the share of wet days on the given ``MM-dd`` days."""
    wanted = days.where(F.col("tmax").isNotNull() & F.date_format("d", "MM-dd").isin(month_days))
    wet = F.avg((F.coalesce("precip", F.lit(0.0)) >= WET_DAY).cast("double")) * 100
    return wanted.groupBy("venue").agg(F.bround(F.avg("tmax")).alias("tmax"), F.bround(wet).alias("rain_pct"), F.bround(F.avg(F.coalesce("wind", F.lit(0.0)))).alias("wind"), F.count("*").alias("days"))


def climate_series(days: DataFrame) -> DataFrame:
    """Means for each venue and calendar day, the wind's direction as a circular mean."""
    good = days.where("tmax IS NOT NULL").withColumn("md", F.date_format("d", "MM-dd"))
    return good.groupBy("venue", "md").agg(F.avg("tmax").alias("tmax"), F.avg(F.coalesce("precip", F.lit(0.0))).alias("precip"), F.avg(F.coalesce("wind", F.lit(0.0))).alias("wind"), F.avg("cloud").alias("cloud"), circular_mean(F.col("wind_dir")).alias("dir"))


def outlook(members: DataFrame) -> DataFrame:
    """(venue, d, member, tmax, precip) to the venue's mean and wet share; a day is wet by the mean of its members."""
    by_day = members.groupBy("venue", "d").agg(F.avg("tmax").alias("t"), F.coalesce(F.avg("precip"), F.lit(0.0)).alias("p"), F.countDistinct("member").alias("members")).where("t IS NOT NULL")
    wet = F.avg((F.col("p") >= WET_DAY).cast("double")) * 100
    return by_day.groupBy("venue").agg(F.bround(F.avg("t")).alias("tmax"), F.bround(wet).alias("rain_pct"), F.avg("p").alias("precip"), F.max("members").alias("members"))


def ensemble(members: DataFrame) -> DataFrame:
    """Spread of the members' highs and the share of wet members, for each venue and day with any high."""
    wet = F.avg(F.when(F.col("precip").isNotNull(), (F.col("precip") >= WET_MEMBER).cast("double"))) * 100
    found = members.groupBy("venue", "d").agg(
        F.bround(F.min("tmax")).alias("lo"),
        F.bround(F.max("tmax")).alias("hi"),
        F.bround(F.avg("tmax")).alias("mean"),
        F.stddev_pop("tmax").alias("sd"),
        F.count("tmax").alias("members"),
        F.bround(wet).alias("p_rain"),
    )
    return found.where("members > 0")


def monthly_normals(days: DataFrame) -> DataFrame:
    return days.groupBy("venue", F.month("d").alias("month")).agg(F.avg("tmax").alias("tmax"), F.avg("tmin").alias("tmin"), F.avg("wind").alias("wind"), F.count(F.when(F.col("precip") >= WET_MEMBER, 1)).alias("precip_days"))


def dry_warm_months(normals: DataFrame) -> DataFrame:
    """Months of 8 to 26 degrees with at most five more wet days than the venue's driest such month."""
    warm = normals.where(F.col("tmax").between(8, 26))
    return warm.withColumn("least", F.min("precip_days").over(Window.partitionBy("venue"))).where("precip_days <= least + 5").drop("least")


def trip_rollup(days: DataFrame) -> DataFrame:
    """(venue, score, tmax, prob, code, gust, wet_hours, dew, am_dry) of a trip's days to one row for each venue."""
    return days.groupBy("venue").agg(
        F.bround(F.avg("score")).alias("score"),
        F.bround(F.avg("tmax")).alias("tmax"),
        F.max("prob").alias("rain_prob"),
        F.mode("code", True).alias("code"),  # the smallest of the most frequent
        F.max("gust").alias("gust_max"),
        F.avg("wet_hours").alias("wet_hours"),
        F.avg("dew").alias("dew"),
        F.count(F.when(F.col("am_dry"), 1)).alias("am_dry_days"),
        F.count("am_dry").alias("am_days"),
    )


def extremes(levels: DataFrame) -> DataFrame:
    """(venue, ts, level) in equal steps of an hour to high and low waters, refined by a parabola through three readings."""
    along = Window.partitionBy("venue").orderBy("ts")
    near = levels.withColumns({"v0": F.lag("level").over(along), "v2": F.lead("level").over(along)}).where("v0 IS NOT NULL AND v2 IS NOT NULL AND level IS NOT NULL")
    high = (F.col("level") >= F.col("v0")) & (F.col("level") > F.col("v2"))
    low = (F.col("level") <= F.col("v0")) & (F.col("level") < F.col("v2"))
    offset, height = vertex(F.col("v0"), F.col("level"), F.col("v2"))
    return near.where(high | low).select("venue", "ts", offset.alias("offset_h"), height.alias("height"), F.when(high, "H").otherwise("L").alias("kind"))


def hour_strip(hours: DataFrame, value: Column) -> DataFrame:
    """A value for each hour as an array of 24 for each venue and day; hours without a temperature are null."""
    by_hour = F.map_from_entries(F.collect_list(F.struct("hr", value.alias("v"))))
    once = hours.where("t IS NOT NULL").dropDuplicates(["venue", "d", "hr"])
    found = once.groupBy("venue", "d").agg(by_hour.alias("m"))
    return found.select("venue", "d", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.col("m")[h]).alias("hours"))


def overlay(forecast: DataFrame, other: DataFrame) -> DataFrame:
    """(venue, d, ...) rows of the forecast, and of the other source for days that it lacks, with their source."""
    rest = other.join(forecast.select("venue", "d"), ["venue", "d"], "left_anti")
    return forecast.withColumn("src", F.lit("fc")).unionByName(rest.withColumn("src", F.lit("out")))
