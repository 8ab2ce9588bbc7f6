"""Distances, boxes and projections as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EARTH_KM = 6371.0
MERCATOR = 6378137.0
#: Kilometres in a degree of latitude, a little less than in truth, so that boxes made with it are never too small.
DEGREE_KM = 110.5


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the radius's unit."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))  # least() would skip a null


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a point lies in a box, borders included; points without coordinates don't."""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def boxes_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["south"] <= b["north"]) & (b["south"] <= a["north"]) & (a["west"] <= b["east"]) & (b["west"] <= a["east"])


def parse_box(text: Column) -> Column:
    """``south,west,north,east`` to a struct, null unless all four are numbers in range and in order."""
    part = lambda i: F.get(F.split(text, ","), i).try_cast("double")
    south, west, north, east = (part(i) for i in range(4))
    good = (F.size(F.split(text, ",")) == 4) & south.between(-90, 90) & north.between(-90, 90) & west.between(-180, 180) & east.between(-180, 180) & (south < north) & (west < east)
    return F.when(good, F.struct(south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east")))


def box_centre(south: Column, west: Column, north: Column, east: Column) -> tuple[Column, Column]:
    return (south + north) / 2, (west + east) / 2


def covering_radius_km(south: Column, west: Column, north: Column, east: Column) -> Column:
    """Whole kilometres from a box's centre that reach all of it."""
    lat, lon = box_centre(south, west, north, east)
    return F.ceil(F.greatest(haversine(lat, lon, north, east), haversine(lat, lon, south, west)))


def to_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon) * MERCATOR, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERCATOR


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon)"""
    return F.degrees(2 * F.atan(F.exp(y / MERCATOR)) - math.pi / 2), F.degrees(x / MERCATOR)


def cell(x: Column, size: float) -> Column:
    """Nearest multiple of ``size``, as the multiple's number."""
    return F.bround(x / size).cast("long")


def vertex(v0: Column, v1: Column, v2: Column) -> tuple[Column, Column]:
    """Offset (in steps) and height of the parabola's top through three neighbours."""
    bend = v0 - 2 * v1 + v2
    return F.when(bend != 0, (v0 - v2) / (2 * bend)).otherwise(0.0), F.when(bend != 0, v1 - F.pow(v2 - v0, F.lit(2)) / (8 * bend)).otherwise(v1)


def scaled_points(points: Column, width: Column, height: Column) -> Column:
    """Pixel points (arrays of x and y) to shares of the picture, five decimals."""
    return F.transform(points, lambda p: F.array(F.round(p[0] / width, 5), F.round(p[1] / height, 5)))


def ewkb_point(hexed: Column) -> tuple[Column, Column]:
    """(lat, lon) of a little-endian point in extended WKB hex with a reference system; null for anything else."""
    fits = hexed.rlike("^0101000020[0-9A-Fa-f]{40}$")

    def number(start: int) -> Column:
        """A double from sixteen hex digits, low byte first: sign, exponent and fraction put together."""
        digits = [F.substring(hexed, start + 2 * i, 2) for i in range(7, -1, -1)]
        high = F.conv(F.concat(*digits[:2]), 16, 10).cast("long")
        fraction = F.conv(F.concat(F.substring(F.concat(*digits[1:2]), 2, 1), *digits[2:]), 16, 10).cast("double")
        exponent = (F.pmod(F.floor(high / 16), F.lit(2048))).cast("int")
        size = F.when(exponent == 0, fraction / 2.0**52 * 2.0**-1022).otherwise((1 + fraction / 2.0**52) * F.pow(F.lit(2.0), exponent - 1023))
        return F.when(high >= 32768, -size).otherwise(size)

    return F.when(fits, number(35)), F.when(fits, number(19))


def parse_point(text: Column) -> tuple[Column, Column]:
    """(lat, lon) from ``lat,lon`` text; null where either is no number."""
    part = lambda i: F.get(F.split(text, ","), i).try_cast("double")
    both = part(0).isNotNull() & part(1).isNotNull()
    return F.when(both, part(0)), F.when(both, part(1))


#: The spheroid of 1984: larger half axis in metres, flattening. Fixed values.
AXIS, FLAT = 6378137.0, 1 / 298.257223563
#: Most by which a distance on the spheroid can differ from one on the sphere of EARTH_KM, as a share of it.
SPHEROID_SHARE = 0.0057
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def geodesic_metres(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Shortest distances on the spheroid; nan where a coordinate is missing or a latitude is out of range.

    The inverse iteration on the auxiliary sphere runs until all rows have converged. It doesn't for nearly antipodal points;
    for these the azimuth at which a geodesic meets the other longitude is found by bisection, as that longitude rises with
    the azimuth from 0 to half a turn (with the points mirrored so that the first is the southern and farther from the equator).
    """
    p1, p2 = np.radians(lat1), np.radians(lat2)
    turn = np.radians((lon2 - lon1 + 180) % 360 - 180)
    fine = (np.abs(lat1) <= 90) & (np.abs(lat2) <= 90) & np.isfinite(turn)
    out = np.full(len(turn), np.nan)
    u1, u2, l = np.arctan((1 - FLAT) * np.tan(p1[fine])), np.arctan((1 - FLAT) * np.tan(p2[fine])), np.abs(turn[fine])
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam, metres, done = l.copy(), np.zeros(len(l)), np.zeros(len(l), bool)
    for _ in range(60):
        cos_lam, sin_lam = np.cos(lam), np.sin(lam)
        sin_sigma = np.hypot(c2 * sin_lam, c1 * s2 - s1 * c2 * cos_lam)
        cos_sigma = s1 * s2 + c1 * c2 * cos_lam
        sigma = np.arctan2(sin_sigma, cos_sigma)
        sin_alpha = np.divide(c1 * c2 * sin_lam, sin_sigma, out=np.zeros(len(l)), where=sin_sigma > 0)
        cos2 = 1 - sin_alpha**2
        middle = cos_sigma - np.divide(2 * s1 * s2, cos2, out=np.zeros(len(l)), where=cos2 > 1e-15)
        middle = np.where(cos2 > 1e-15, middle, 0)
        c = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
        following = l + (1 - c) * FLAT * sin_alpha * (sigma + c * sin_sigma * (middle + c * cos_sigma * (2 * middle**2 - 1)))
        u = cos2 * (AXIS**2 / (AXIS * (1 - FLAT)) ** 2 - 1)
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        drift = b * sin_sigma * (middle + b / 4 * (cos_sigma * (2 * middle**2 - 1) - b / 6 * middle * (4 * sin_sigma**2 - 3) * (4 * middle**2 - 3)))
        now = (np.abs(following - lam) < 1e-12) & (following <= np.pi) & ~done
        metres = np.where(now, AXIS * (1 - FLAT) * a * (sigma - drift), metres)
        done |= now
        if done.all():
            break
        lam = np.where(done, lam, following)
    # Close to the antipode a fixed point of the iteration need not be the shortest way.
    far = ~done | (np.abs(u1 + u2) + np.abs(np.pi - l) < 0.02)
    if far.any():
        metres[far] = _by_azimuth(u1[far], u2[far], l[far])
    out[fine] = metres
    return out


def _by_azimuth(u1: np.ndarray, u2: np.ndarray, l: np.ndarray) -> np.ndarray:
    swap = np.abs(u2) > np.abs(u1)
    u1, u2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
    u1, u2 = -np.abs(u1), np.where(u1 > 0, -u2, u2)  # on the equator a negative zero, as leaving south counts
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

    def along(azimuth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(longitude reached, metres) of the geodesic that leaves with this azimuth."""
        sin_a, cos_a = np.sin(azimuth), np.cos(azimuth)
        sin0 = sin_a * c1
        cos2_a = np.sqrt(np.maximum(0, (cos_a * c1) ** 2 + (c2**2 - c1**2)))
        from_, to = np.arctan2(s1, cos_a * c1), np.arctan2(s2, cos2_a)
        turned = np.arctan2(sin0 * np.sin(to), np.cos(to)) - np.arctan2(sin0 * np.sin(from_), np.cos(from_))
        k2 = (1 - sin0**2) * (1 / (1 - FLAT) ** 2 - 1)
        half = (to - from_) / 2
        at = from_[:, None] + half[:, None] * (1 + _NODES)
        root = np.sqrt(1 + k2[:, None] * np.sin(at) ** 2)
        slow = ((2 - FLAT) / (1 + (1 - FLAT) * root) * _WEIGHTS).sum(axis=1) * half
        return turned - FLAT * sin0 * slow, AXIS * (1 - FLAT) * (root * _WEIGHTS).sum(axis=1) * half

    low, high = np.zeros(len(l)), np.full(len(l), np.pi)
    for _ in range(60):
        middle = (low + high) / 2
        short = along(middle)[0] < l
        low, high = np.where(short, middle, low), np.where(short, high, middle)
    # Along the equator any length leaves at a right angle: up to this longitude the equator itself is the way.
    level = (np.abs(u1) < 1e-9) & (np.abs(u2) < 1e-9) & (l <= np.pi * (1 - FLAT))
    return np.where(level, AXIS * l, along(high)[1])


@F.pandas_udf(DoubleType())
def geodesic(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Metres between two points on the spheroid; null without coordinates or with a latitude out of range."""
    found = geodesic_metres(*(x.to_numpy(dtype=float) for x in (lat1, lon1, lat2, lon2)))
    return pd.Series(found).where(np.isfinite(found), None)


def within_spheroid(rows: DataFrame, lat: float, lon: float, km: float) -> DataFrame:
    """Rows (lat, lon) within ``km`` of a point, with ``km``: boxes and the sphere leave few for the exact distance.

    The first bounds allow for the most by which the sphere can differ, so they lose nothing.
    """
    wide = km * (1 + 2 * SPHEROID_SHARE)
    near = rows.where(F.col("lat").between(lat - wide / DEGREE_KM, lat + wide / DEGREE_KM))
    near = near.where(haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= wide)
    metres = geodesic(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    return near.withColumn("km", metres / 1000).where(F.col("km") <= km)
