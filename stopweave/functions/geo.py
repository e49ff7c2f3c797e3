"""Distances, angles and projections as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEG = math.pi * EARTH_M / 180
#: Metres by which a box is padded, for each degree.
PAD_M_PER_DEG = 83_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    b = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(a + b))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y of the spherical web projection, in metres."""
    r = F.lit(6_378_137.0)
    return r * F.radians(lon), r * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def turn_angle(cx: Column, cy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between the directions from c to a and from c to b; null where one has no length."""
    dot = (ax - cx) * (bx - cx) + (ay - cy) * (by - cy)
    size = F.sqrt((F.pow(ax - cx, 2) + F.pow(ay - cy, 2)) * (F.pow(bx - cx, 2) + F.pow(by - cy, 2)))
    return F.when(size > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size)))))


def line_length(points: Column) -> Column:
    """Metres along an array of structs with lat and lon."""
    steps = F.zip_with(
        F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]),
    )
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def cell(lat: Column, lon: Column, metres: float, at_lat: float) -> tuple[Column, Column]:
    """Column and row of a grid whose cells are at least ``metres`` wide wherever |latitude| <= at_lat."""
    step_lat = metres / M_PER_DEG
    step_lon = step_lat / max(math.cos(math.radians(at_lat)), 1e-6)
    return F.floor(lon / F.lit(step_lon)).cast("long"), F.floor(lat / F.lit(step_lat)).cast("long")


def wkt(points: Column) -> Column:
    """LINESTRING of an array of structs with lat and lon, seven digits."""
    pairs = F.transform(points, lambda p: F.format_string("%.7f %.7f", p["lon"], p["lat"]))
    return F.concat(F.lit("LINESTRING("), F.array_join(pairs, ","), F.lit(")"))
