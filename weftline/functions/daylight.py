"""Sunrise, sunset and hours of daylight as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 1970-01-01 to noon of 2000-01-01, less the correction for leap seconds. Fixed value.
_EPOCH = 10957.0 - 0.0008


def _turn(x: Column) -> Column:
    """Degrees in [0, 360)."""
    return x - F.floor(x / 360) * 360


def _minutes(days: Column) -> Column:
    """Minutes since midnight of a moment in days from noon."""
    x = days + 0.5
    return (x - F.floor(x)) * 1440


def sun_times(lat: Column, lon: Column, day: Column) -> Column:
    """Struct of sunrise and sunset (minutes since midnight UTC) and hours of daylight, within about two minutes.

    Where the sun doesn't cross the horizon both times are null and the hours are 24 or 0. The hours come from the sun's
    arc, not from the two times, which may lie on different days. Null inputs give a null struct.
    """
    noon = F.datediff(day, F.lit("1970-01-01").cast("date")) - _EPOCH - lon / 360
    sin = lambda degrees: F.sin(F.radians(degrees))
    anomaly = _turn(357.5291 + 0.98560028 * noon)
    centre = 1.9148 * sin(anomaly) + 0.02 * sin(2 * anomaly) + 0.0003 * sin(3 * anomaly)
    along = _turn(anomaly + centre + (180 + 102.9372))
    transit = noon + 0.0053 * sin(anomaly) - 0.0069 * sin(2 * along)
    tilt = sin(along) * sin(F.lit(23.4397))
    arc = (sin(F.lit(-0.833)) - sin(lat) * tilt) / (F.cos(F.radians(lat)) * F.cos(F.asin(tilt)))
    half = F.degrees(F.acos(F.when(arc.between(-1, 1), arc)))
    hours = F.when(arc < -1, 24.0).when(arc > 1, 0.0).otherwise(half / 360 * 48)
    known = lat.isNotNull() & lon.isNotNull() & day.isNotNull()
    return F.when(known, F.struct(_minutes(transit - half / 360).alias("sunrise"), _minutes(transit + half / 360).alias("sunset"), hours.alias("hours")))


def clock(minutes: Column, offset_hours: Column) -> Column:
    """``HH:mm`` of minutes since midnight UTC at an offset."""
    local = F.pmod(F.floor(minutes + offset_hours * 60), F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(local / 60), local % 60)
