"""Weather codes, probabilities and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# WMO codes from which a probability of rain is guessed, highest first.
_LADDER = [(95, 90), (80, 75), (71, 80), (61, 80), (51, 60), (45, 40), (1, 20)]
_POINTS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def code_rain_prob(code: Column) -> Column:
    """Probability of rain by weather code; no code: 0."""
    out = F.when(code.isNull(), 0)
    for least, prob in _LADDER:
        out = out.when(code >= least, prob)
    return out.otherwise(5)


def effective_rain_prob(prob: Column, ensemble: Column, code: Column) -> Column:
    """The forecast's own probability, else the ensemble's, else the code's."""
    return F.coalesce(prob.cast("double"), ensemble.cast("double"), code_rain_prob(code).cast("double"))


def compass(bearing: Column) -> Column:
    """Nearest of eight points; halves go to the even one."""
    at = F.pmod(F.bround(bearing / 45).cast("int"), F.lit(8))
    return F.when(bearing.isNotNull(), F.get(F.array(*map(F.lit, _POINTS)), at))


def wet_band(pct: Column) -> Column:
    return F.when(pct <= 30, "dry").when(pct > 55, "wet").otherwise("mixed")


def sky_label(mm: Column, cloud: Column) -> Column:
    """A word for a day's sky from millimetres and cloud cover, by the millimetres alone where the cover is unknown."""
    wet = F.coalesce(mm, F.lit(0.0))
    known = F.when(cloud < 25, "sunny").when(cloud < 60, "sunny intervals").when(cloud.isNotNull(), "cloudy")
    return F.when(wet >= 2, "rain").otherwise(F.coalesce(known, F.when(wet < 0.05, "sunny").when(wet < 0.5, "sunny intervals").otherwise("cloudy")))


def circular_mean(bearing: Column) -> Column:
    """Aggregate: mean bearing, 0 to 359, null without any."""
    angle = F.degrees(F.atan2(F.sum(F.sin(F.radians(bearing))), F.sum(F.cos(F.radians(bearing)))))
    return F.bround(F.when(angle < 0, angle + 360).otherwise(angle))


def uv_estimate(lat: Column, day_of_year: Column, cloud_pct: Column) -> Column:
    """Midday UV index from the sun's height, halved at most by cloud; 0 without sun."""
    tilt = 23.44 * F.sin(F.radians((day_of_year + 284) / 365.0 * 360.0))
    up = F.cos(F.radians(F.abs(lat - tilt)))
    share = F.coalesce(1 - 0.5 * cloud_pct / 100.0, F.lit(1.0))
    return F.when(up <= 0, 0.0).otherwise(F.bround(12.5 * F.pow(F.greatest(up, F.lit(0.0)), F.lit(2.42)) * share))


def sun_times(lat: Column, lon: Column, date: Column) -> dict[str, Column]:
    """Minutes after UTC midnight of sunrise and sunset and hours of daylight, to about two minutes.

    In polar day and night there is neither; daylight is then 24 or 0.
    """
    n = F.datediff(date, F.to_date(F.lit("2000-01-01"))) + 0.0008
    noon = n - lon / 360.0
    anomaly = F.pmod(0.98560028 * noon + 357.5291, F.lit(360.0))
    m = F.radians(anomaly)
    centre = 1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)
    along = F.radians(F.pmod(anomaly + centre + 282.9372, F.lit(360.0)))
    transit = noon + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * along)
    tilt = F.sin(along) * F.sin(F.radians(F.lit(23.4397)))
    x = (F.sin(F.radians(F.lit(-0.833))) - F.sin(F.radians(lat)) * tilt) / (F.cos(F.radians(lat)) * F.cos(F.asin(tilt)))
    half = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))
    crosses = x.between(-1, 1)
    minutes = lambda t: F.when(crosses, F.pmod(t + 0.5, F.lit(1.0)) * 1440.0)
    hours = F.when(x < -1, 24.0).when(x > 1, 0.0).otherwise(half / 360.0 * 48.0)
    return {"rise": minutes(transit - half / 360.0), "set": minutes(transit + half / 360.0), "daylight": hours}
