"""Geometry of the sphere and of lattices, Column to Column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CONE_RAYS, EARTH_RADIUS_M, LENGTH_EPSILON, M_PER_DEG_GRID, MAX_STEPS, SAMPLE_STEP_M, VIEWPORT_DEFAULT_M, VIEWPORT_MAX_M, VIEWPORT_MIN_M, WINDS


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(a))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point, 0 (north) to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    angle = F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))
    return (angle * (180.0 / math.pi) + 360) % 360


def angular_within(bearing: Column, centre: Column, half: Column) -> Column:
    turn = F.abs(bearing - centre) % 360
    return F.when(turn > 180, 360 - turn).otherwise(turn) <= half


def covers(kind: Column, direction: Column, half_fov: Column, range_m: Column, lat: Column, lon: Column, plat: Column, plon: Column) -> Column:
    """A cone for fixed cameras with a direction, a disc for all others. Distances
    that are not numbers cover nothing."""
    d = haversine_m(lat, lon, plat, plon)
    cone = (kind == "FIXED") & direction.isNotNull()
    return ~F.isnan(d) & (d <= range_m) & (~cone | angular_within(bearing_deg(lat, lon, plat, plon), direction, half_fov))


def steps(length_m: Column) -> Column:
    """Sampling steps of an edge; null where the edge has no length."""
    bounded = F.least(F.greatest(F.ceil(length_m / SAMPLE_STEP_M), F.lit(1)), F.lit(MAX_STEPS)).cast("int")
    return F.when(~F.isnan(length_m) & (length_m > LENGTH_EPSILON), bounded)


def cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("long")


def lon_cell(metres: float, lat: float, per_degree: float = M_PER_DEG_GRID) -> float:
    """Width in degrees of a cell of so many metres at a latitude."""
    return metres / (per_degree * max(math.cos(math.radians(lat)), 0.01))


def compass_point(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WINDS)), (F.floor(degrees / 45 + 0.5) % 8).cast("int") + 1)


def offset(lat: Column, lon: Column, bearing: Column, metres: Column) -> Column:
    """The point so many metres away, on the flat."""
    b = F.radians(bearing)
    return F.struct((lat + metres * F.cos(b) / M_PER_DEG_GRID).alias("lat"), (lon + metres * F.sin(b) / (M_PER_DEG_GRID * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))).alias("lon"))


def disc_ring(lat: Column, lon: Column, radius_m: Column, n: int = CONE_RAYS) -> Column:
    """A closed ring of n + 1 points around a centre."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: offset(lat, lon, (i % n) * (360.0 / n), radius_m))


def viewport_radius(lat: Column, lon: Column, ne_lat: Column, ne_lon: Column) -> Column:
    reach = F.least(F.greatest(haversine_m(lat, lon, ne_lat, ne_lon), F.lit(VIEWPORT_MIN_M)), F.lit(VIEWPORT_MAX_M))
    return F.when(ne_lat.isNull() | ne_lon.isNull(), F.lit(VIEWPORT_DEFAULT_M)).otherwise(reach)


def no_negative(weight: Column) -> Column:
    """Weights below zero, and those that are not numbers, are zero."""
    return F.greatest(F.nanvl(weight, F.lit(0.0)), F.lit(0.0))
