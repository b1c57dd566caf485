"""Points, shapes and distances. A location is {type, coordinates: [lon, lat]} or an array [x, y]."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import type_of

EARTH_RADIUS_M = 6_378_100.0


def point(location: Any) -> tuple[Column, Column]:
    if isinstance(location, dict):
        location = location.get("$geometry", location)["coordinates"]
    if isinstance(location, (list, tuple)):
        return F.lit(float(location[0])), F.lit(float(location[1]))
    at = location["coordinates"] if isinstance(type_of(location), T.StructType) else location
    return F.get(at, F.lit(0)), F.get(at, F.lit(1))


def haversine(a: Any, b: Any, radius: float = EARTH_RADIUS_M) -> Column:
    (x0, y0), (x1, y1) = point(a), point(b)
    half = F.pow(F.sin(F.radians(y1 - y0) / 2), F.lit(2.0)) + F.cos(F.radians(y0)) * F.cos(F.radians(y1)) * F.pow(F.sin(F.radians(x1 - x0) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def planar(a: Any, b: Any) -> Column:
    (x0, y0), (x1, y1) = point(a), point(b)
    return F.sqrt(F.pow(x1 - x0, F.lit(2.0)) + F.pow(y1 - y0, F.lit(2.0)))


def in_polygon(x: Column, y: Column, ring: list) -> Column:
    """Even-odd rule over the edges of a ring."""
    out = F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y0 != y1:
            crosses = ((y > F.lit(float(y0))) != (y > F.lit(float(y1)))) & (x < (y - float(y0)) * (float(x1) - float(x0)) / (float(y1) - float(y0)) + float(x0))
            out = out != crosses
    return out


def in_shape(location: Any, shape: dict) -> Column:
    x, y = point(location)
    kind, at = shape["type"], shape["coordinates"]
    if kind == "Point":
        return (x == float(at[0])) & (y == float(at[1]))
    polygons = [at] if kind == "Polygon" else at if kind == "MultiPolygon" else None
    if polygons is None:
        raise ValueError(f"shape {kind!r} has no inside")
    found = F.lit(False)
    for rings in polygons:
        inside = in_polygon(x, y, rings[0])
        for hole in rings[1:]:
            inside = inside & ~in_polygon(x, y, hole)
        found = found | inside
    return found


def distance_of(location: Any, spec: Any) -> Column:
    near = spec.get("$geometry", spec) if isinstance(spec, dict) else spec
    return haversine(location, near) if isinstance(near, dict) else planar(location, near)


def geo_condition(name: str, spec: Any, location: Column, own: dict) -> Column:
    if name in ("$geoWithin", "$geoIntersects"):
        if "$geometry" in spec:
            return in_shape(location, spec["$geometry"])
        x, y = point(location)
        if "$box" in spec:
            (x0, y0), (x1, y1) = spec["$box"]
            return x.between(float(x0), float(x1)) & y.between(float(y0), float(y1))
        if "$polygon" in spec:
            return in_polygon(x, y, spec["$polygon"])
        if "$center" in spec:
            at, radius = spec["$center"]
            return planar(location, at) <= float(radius)
        if "$centerSphere" in spec:
            at, radius = spec["$centerSphere"]
            return haversine(location, at, 1.0) <= float(radius)
        raise ValueError("unknown geo shape")
    d = distance_of(location, spec)
    low = spec.get("$minDistance") if isinstance(spec, dict) else None
    high = spec.get("$maxDistance") if isinstance(spec, dict) else None
    low, high = low if low is not None else own.get("$minDistance"), high if high is not None else own.get("$maxDistance")
    out = d.isNotNull()
    if low is not None:
        out = out & (d >= float(low))
    return out & (d <= float(high)) if high is not None else out
