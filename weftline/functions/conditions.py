"""Condition curves as column expressions: what weather costs an outdoor day, by sport.

Every function takes and returns columns, has no branches outside ``when`` and runs inside generated code. Missing signals
are null and cost nothing unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.weather import effective_rain_prob

# Degrees of felt temperature and bearing by the way a face looks.
ASPECT_SHIFT = {"N": -4, "NE": -3, "NW": -2, "E": -1, "W": 2, "SE": 3, "SW": 3, "S": 4}
ASPECT_BEARING = {"N": 0, "NE": 45, "E": 90, "SE": 135, "S": 180, "SW": 225, "W": 270, "NW": 315}
#: Temperatures at which climbing cold and heat begin to cost, and gusts in km/h.
COLD, WARM, HOT, BRUTAL, GUST = 12, 18, 24, 28, 30
NIGHT_WEIGHT = 0.25
#: Local hours, both included, in which a sport is out of doors.
ACTIVE_HOURS = {"climbing": (7, 19), "golf": (8, 18), "ski": (9, 16)}
# How fast a golf course's soil drains.
DRAINAGE = {"links": 0.5, "heathland": 0.8, "parkland": 1.3, "clay": 1.6}


def lookup(key: Column, table: dict, default=None) -> Column:
    """The table's value for a key; ``default`` for unknown and null keys."""
    found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def over(x: Column, limit: float) -> Column:
    """What x has above the limit, else 0."""
    return F.greatest(x - limit, F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def heat_penalty(t: Column) -> Column:
    return over(t, WARM) * 1.5 + over(t, HOT) * 4 + over(t, BRUTAL) * 6


def rain_penalty(pct: Column, tolerance: Column | float = 1.0) -> Column:
    p = F.coalesce(pct, F.lit(0)).cast("double")
    return (over(p, 12) * 1.25 + over(p, 40) * 1.5) / tolerance


def day_rain_penalty(prob: Column, tolerance: Column | float = 1.0) -> Column:
    p = F.coalesce(prob, F.lit(0)).cast("double")
    return (p * 0.8 + over(p, 50) * 0.7) / tolerance


def wind_factor(aspect: Column, direction: Column, exposed: Column) -> Column:
    bearing = lookup(F.upper(aspect), ASPECT_BEARING)
    facing = F.coalesce(F.cos(F.radians(direction - bearing)) * 0.25, F.lit(0.0))
    return 1.0 + facing + F.when(exposed, 0.25).otherwise(0.0)


def drying_factor(drying: Column, aspect: Column, coastal: Column, tidal: Column) -> Column:
    derived = 1.0 - lookup(F.upper(aspect), ASPECT_SHIFT, 1) * 0.05 + F.when(coastal | tidal, 0.25).otherwise(0.0)
    return F.when(F.lower(drying) == "fast", 0.7).when(F.lower(drying) == "slow", 1.4).otherwise(clamp(derived, 0.6, 1.6))


def drying_traits(drying: Column, aspect: Column, coastal: Column, tidal: Column) -> Column:
    """Why a place dries fast or slowly, in words; empty if nothing speaks for either."""
    face, shift = F.upper(F.coalesce(aspect, F.lit(""))), lookup(F.upper(aspect), ASPECT_SHIFT, 0)
    said = F.array(
        F.when(shift <= -2, F.concat(F.lit("shaded "), face, F.lit(" face"))).when(shift >= 3, F.concat(F.lit("sunny "), face, F.lit(" face"))),
        F.when(coastal | tidal, "sea air"),
        F.when(F.lower(drying).isin("fast", "slow"), F.concat(F.lit("dries "), F.lower(drying), F.lit(" (curated)"))),
    )
    return F.array_join(F.array_compact(said), ", ")


def felt_temperature(t: Column, aspect: Column, sun: Column) -> Column:
    share = F.when(sun.isNull(), 0.7).otherwise(clamp(sun, 0.0, 1.0))
    return t + lookup(F.upper(aspect), ASPECT_SHIFT, 1) * share


def friction_label(dew: Column) -> Column:
    return F.when(dew < 8, "crisp").when(dew < 13, "good").when(dew < 17, "humid").when(dew.isNotNull(), "greasy")


def climate_score(rain_pct: Column, t: Column, drying: Column | float = 1.0, rain_tolerance=1.0, heat_tolerance=1.0) -> Column:
    wet = rain_penalty(rain_pct, rain_tolerance) * (1 + (drying - 1) * 0.5)
    return clamp(F.bround(100 - wet - over(COLD - t, 0) * 2 - heat_penalty(t) / heat_tolerance), 0, 100)


def night_weight(drying: Column) -> Column:
    return F.greatest(F.lit(0.15), F.least(F.lit(0.5), F.coalesce(drying, F.lit(1.0)) * NIGHT_WEIGHT))


def day_score(d: dict[str, Column], rain_tolerance=1.0, heat_tolerance=1.0) -> Column:
    """0 to 100 for one forecast day, not rounded.

    ``d``: code, mm, prob, ens_prob, rain_day, rain_night, prob_day, wet_hours, all_hours, gust, wind_factor, drying_factor,
    sun, dew, felt. With rain_day the rain counts by when it falls, and the caps for rain and storm codes hold only if
    the active hours are wet.
    """
    split = d["rain_day"].isNotNull()
    factor = F.coalesce(d["drying_factor"], F.lit(1.0))
    probability = F.when(split, F.coalesce(d["prob_day"], d["prob"])).otherwise(d["prob"])
    by_time = d["rain_day"] * 6 + F.coalesce(d["rain_night"], F.lit(0.0)) * 6 * night_weight(d["drying_factor"])
    amount = F.when(split, by_time).otherwise(F.coalesce(d["mm"], F.lit(0.0)) * 6)
    start = 100.0 - day_rain_penalty(effective_rain_prob(probability, d["ens_prob"], d["code"]), rain_tolerance) - amount
    wet = F.when(split, (d["rain_day"] >= 0.5) | (F.coalesce(d["wet_hours"], F.lit(0)) >= 1)).otherwise(F.lit(True))
    capped = F.when((d["code"] >= 61) & wet, F.least(start, F.lit(25.0))).otherwise(start)
    capped = F.when(d["code"].isin(95, 96, 99) & wet, F.least(capped, F.lit(15.0))).otherwise(capped)
    hours = F.coalesce(d["wet_hours"].cast("double"), d["all_hours"].cast("double"))
    costs = [
        over(d["gust"], GUST) * 0.6 * F.coalesce(d["wind_factor"], F.lit(1.0)),
        F.least(hours, F.lit(12.0)) * 0.8 * factor,
        (0.5 - d["sun"]) * 10,
        over(d["dew"], 12) * 1.2,
        heat_penalty(d["felt"]) / heat_tolerance,
        over(COLD - d["felt"], 0) * 2,
    ]
    needs = [d["gust"], hours, d["sun"], d["dew"], d["felt"], d["felt"]]
    for cost, need in zip(costs, needs):
        capped = capped - F.when(need.isNotNull(), cost).otherwise(0.0)
    return clamp(capped)


def sunniness(rain_pct: Column) -> Column:
    return F.greatest(F.lit(0.35), 1 - rain_pct / 100)


def blend(forecast: Column, covered: Column, days: Column, climate: Column, outlook: Column) -> Column:
    """Forecast by the share of days it covers, the rest from the climate (70/30 with an outlook); -1 without any."""
    typical = F.when(outlook.isNotNull() & climate.isNotNull(), F.bround(climate * 0.7 + outlook * 0.3)).otherwise(climate)
    share = covered / days
    mixed = F.bround(share * forecast + (1 - share) * typical)
    return F.coalesce(F.when(forecast.isNotNull() & ((covered >= days) | typical.isNull()), forecast), F.when(forecast.isNotNull(), mixed), typical, F.lit(-1.0))


def golf_drainage(drainage: Column, course: Column) -> Column:
    return F.when(F.lower(drainage) == "fast", 0.6).when(F.lower(drainage) == "slow", 1.5).otherwise(lookup(F.lower(course), DRAINAGE, 1.0))


def golf_exposure(links: Column, coastal: Column, course: Column) -> Column:
    return F.when(links | coastal, 1.35).when(F.lower(course) == "parkland", 0.85).otherwise(1.0)


def golf_wind(kmh: Column, exposure: Column | float = 1.0) -> Column:
    cost = (over(kmh, 15) * 1.2 + over(kmh, 28) * 2.0 + over(kmh, 45) * 3.0) * exposure
    return F.when(kmh.isNotNull(), cost).otherwise(0.0)


def golf_temperature(t: Column) -> Column:
    return F.when(t.isNotNull(), over(10 - t, 0) * 2.5 + over(t, 30) * 1.5).otherwise(0.0)


def golf_course(wet_hours: Column, drainage: Column | float = 1.0) -> Column:
    return F.when(wet_hours.isNotNull(), F.least(wet_hours.cast("double"), F.lit(10.0)) * 1.6 * drainage).otherwise(0.0)


def golf_day(d: dict[str, Column]) -> Column:
    """``d``: code, mm, prob, prob_day, ens_prob, rain_day, gust, tmax, wet_hours, exposure, drainage."""
    p = effective_rain_prob(F.coalesce(d["prob_day"], d["prob"]), d["ens_prob"], d["code"])
    mm = F.when(F.coalesce(d["rain_day"], F.lit(0.0)) != 0, d["rain_day"]).otherwise(F.coalesce(d["mm"], F.lit(0.0)))
    dry = 100.0 - p * 0.7 - mm * 5
    storm = F.when(d["code"] >= 95, F.least(dry, F.lit(10.0))).otherwise(dry)
    return clamp(storm - golf_wind(d["gust"], d["exposure"]) - golf_temperature(d["tmax"]) - golf_course(d["wet_hours"], d["drainage"]))


def golf_climate(rain_pct: Column, wind: Column, t: Column, exposure: Column | float = 1.0) -> Column:
    return clamp(F.bround(100.0 - F.coalesce(rain_pct, F.lit(0)) * 1.1 - golf_wind(wind, exposure) - golf_temperature(t)))


def ski_snow(depth: Column) -> Column:
    """Base depth in cm to 0-100: 70 at 60 cm, full from 120."""
    return (
        F.when(depth >= 120, 100.0).when(depth <= 0, 0.0).when(depth >= 60, F.bround(70 + 30 * (depth - 60) / 60)).when(depth.isNotNull(), F.bround(70 * depth / 60))
    )


def ski_thaw(t: Column) -> Column:
    return F.when(t.isNotNull(), over(t, 0) * 3.0 + over(t, 6) * 4.0).otherwise(0.0)


def ski_rain(mm: Column, t: Column) -> Column:
    return F.when(mm.isNull() | F.coalesce(t <= 0, F.lit(False)), 0.0).otherwise(F.least(mm, F.lit(20.0)) * 5.0)


def ski_lift(gust: Column) -> Column:
    return F.when(gust.isNotNull(), over(gust, 60) * 1.5).otherwise(0.0)


def ski_fresh(cm: Column) -> Column:
    return F.coalesce(F.least(cm, F.lit(40.0)) * 0.5, F.lit(0.0))


def ski_day(code: Column, mm: Column, rain_day: Column, gust: Column, t: Column) -> Column:
    rain = F.when(F.coalesce(rain_day, F.lit(0.0)) != 0, rain_day).otherwise(mm)
    return clamp(100.0 - ski_thaw(t) - ski_rain(rain, t) - ski_lift(gust) + F.when(code.between(71, 75), 8.0).otherwise(0.0))


def ski_climate(t: Column) -> Column:
    return clamp(F.bround(100.0 - ski_thaw(t)))


def signal(x: Column) -> Column:
    """A dial: rounded, 0 to 100, null without a signal."""
    return clamp(F.bround(x))


def live_dials(rain_prob: Column, felt: Column, gust: Column, wind: Column, dew: Column, wet_hours: Column, drying: Column) -> dict[str, Column]:
    """Five dials while the forecast reaches the trip. Cold costs from 8 degrees here, not from COLD."""
    return {
        "rain": signal(100 - F.coalesce(rain_prob, F.lit(0)) * 0.8),
        "heat": signal(100 - heat_penalty(felt) - over(8 - felt, 0) * 2) if felt is not None else F.lit(None),
        "wind": F.when(gust.isNotNull(), signal(100 - over(gust, GUST) * 0.6 * wind)),
        "friction": F.when(dew.isNotNull(), signal(100 - over(dew, 12) * 1.2)),
        "drying": F.when(wet_hours.isNotNull(), signal(100 - F.least(wet_hours, F.lit(12.0)) * 0.8 * drying)),
    }


def typical_dials(rain_pct: Column, felt: Column, drying: Column) -> dict[str, Column]:
    """The same five before any forecast: wind and friction are still pending."""
    extra = over(rain_penalty(rain_pct) * (drying - 1) * 0.5, 0)
    return {
        "rain": signal(100 - rain_penalty(rain_pct)),
        "heat": signal(100 - heat_penalty(felt) - over(8 - felt, 0) * 2),
        "wind": F.lit(None).cast("double"),
        "friction": F.lit(None).cast("double"),
        "drying": signal(100 - extra),
    }


def backtest_penalties(pct: Column) -> dict[str, Column]:
    """Rain curves that a backtest compares: plain, and steep beyond 45 %."""
    p = F.coalesce(pct, F.lit(0)).cast("double")
    return {"linear": p * 0.9, "steep": p * 1.15 + over(p, 45) * 1.6}
