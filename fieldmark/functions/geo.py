"""Distances in space and time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius in km, and the speed that turns seconds into km. Fixed values.
EARTH_KM = 6367.0
KM_PER_SEC = 0.002


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points in degrees; null if any is null."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _sum(a: Column, b: Column) -> Column:
    """Sum of what is known; null if neither is."""
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def timespace_km(km: Column, seconds: Column, km_per_sec: float = KM_PER_SEC) -> Column:
    return _sum(km, F.abs(seconds) * km_per_sec)


def timespace_sec(km: Column, seconds: Column, km_per_sec: float = KM_PER_SEC) -> Column:
    return _sum(km / F.lit(km_per_sec), F.abs(seconds).cast("double"))


def speed_kmh(km: Column, hours: Column, slack_km: float = 0.5) -> Column:
    """km/hours; within no time, less than slack_km is no motion (0), more is infinite."""
    return F.when(hours != 0, km / F.nullif(hours, F.lit(0.0))).when(km < slack_km, 0.0).otherwise(F.lit(float("inf")))


def in_polygon(lat: Column, lon: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon of (lat, lon) corners, by the number of edges that a ray crosses."""
    crossed = F.lit(0)
    for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True):
        if b != d:
            hit = ((F.lit(b) > lon) != (F.lit(d) > lon)) & (lat < (lon - b) * ((c - a) / (d - b)) + a)
            crossed = crossed + F.coalesce(hit, F.lit(False)).cast("int")
    return crossed % 2 == 1
