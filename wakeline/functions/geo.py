"""Spherical and local-plane geometry as Column expressions; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_NM = 3440.065


def haversine_nm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_NM * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # not by least(), which passes over nulls


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Forward azimuth, 0 to 360; 0 for equal points."""
    d, p1, p2 = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360.0, F.lit(360.0))


def angular_delta(a: Column, b: Column) -> Column:
    """Smallest angle between two directions, 0 to 180."""
    return F.abs(F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0)


def direction_bin(bearing: Column) -> Column:
    """One of eight sectors of 45 degrees, the first centred on north."""
    return F.floor(F.pmod(bearing + 22.5, F.lit(360.0)) / 45.0).cast("int")


def plane(lon: Column, lat: Column, ref_lon: Column, ref_lat: Column) -> tuple[Column, Column]:
    return F.radians(lon - ref_lon) * F.cos(F.radians(ref_lat)) * EARTH_RADIUS_NM, F.radians(lat - ref_lat) * EARTH_RADIUS_NM


def norm(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def distance_nm(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in the tangent plane at the middle of two points."""
    mid_lon, mid_lat = (lon1 + lon2) / 2, (lat1 + lat2) / 2
    (x1, y1), (x2, y2) = plane(lon1, lat1, mid_lon, mid_lat), plane(lon2, lat2, mid_lon, mid_lat)
    return norm(x2 - x1, y2 - y1)


def velocity(sog: Column, course: Column) -> tuple[Column, Column]:
    return sog * F.sin(F.radians(course)), sog * F.cos(F.radians(course))


def propagate(lon: Column, lat: Column, sog: Column, course: Column, seconds: Column) -> tuple[Column, Column]:
    """Dead reckoning at constant velocity; the identity for 0 seconds."""
    h = seconds / 3600.0
    east, north = velocity(sog, course)
    new_lat = lat + F.degrees(north * h / EARTH_RADIUS_NM)
    scale = EARTH_RADIUS_NM * F.cos(F.radians(lat))
    new_lon = F.when(F.abs(scale) > 1e-12, lon + F.degrees(east * h / scale)).otherwise(lon)
    return F.when(seconds == 0, lon).otherwise(new_lon), F.when(seconds == 0, lat).otherwise(new_lat)
