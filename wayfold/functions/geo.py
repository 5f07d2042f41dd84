"""Distances and map arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def _angle(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    return half(lat1, lat2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2) ** 2


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(_angle(lat1, lng1, lat2, lng2))))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle kilometres by the arctangent form."""
    a = _angle(lat1, lng1, lat2, lng2)
    return F.lit(2 * EARTH_M / 1000) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def exp_decay(total: Column, scale: float = 1000.0) -> Column:
    return F.exp(-total / scale)


def gaussian_weight(dist: Column, sigma: float = 500.0) -> Column:
    return F.exp(-dist * dist / (2 * sigma * sigma))


def planar_trip(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> tuple[Column, Column, Column]:
    """The page's estimate: distance, whole minutes (halves up) and price."""
    dist = F.sqrt((lat2 - lat1) ** 2 + (lng2 - lng1) ** 2) * 100
    return dist, F.floor(dist * 3 + 0.5).cast("long"), dist * 1.5 + 3


def point_in_circle(lat: Column, lng: Column, radius_m: Column, u: Column, v: Column) -> tuple[Column, Column]:
    """Uniform point in a circle from two uniform numbers: spherical destination at radius sqrt(u) and bearing 2 pi v."""
    d, b = radius_m * F.sqrt(u) / EARTH_M, v * F.lit(2.0) * F.pi()
    la, lo = F.radians(lat), F.radians(lng)
    to = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b))
    east = lo + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(to))
    return F.degrees(to), F.pmod(F.degrees(east) + 180, F.lit(360.0)) - 180


def register(spark) -> None:
    """SQL functions of the same meaning, written in SQL so that they are inlined into plans."""
    half = "power(sin(radians({b} - {a}) / 2), 2)"
    angle = f"{half.format(a='lat1', b='lat2')} + cos(radians(lat1)) * cos(radians(lat2)) * {half.format(a='lng1', b='lng2')}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE) RETURNS DOUBLE RETURN 12742.0D * atan2(sqrt({angle}), sqrt(1 - ({angle})))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION exp_decay(total DOUBLE) RETURNS DOUBLE RETURN exp(-total / 1000)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION gaussian_weight(dist DOUBLE) RETURNS DOUBLE RETURN exp(-dist * dist / 500000)")
