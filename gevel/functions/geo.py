"""Geography on columns of longitude and latitude in degrees (WGS84)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spheroid's equatorial radius in metres and its flattening (fixed values).
RADIUS, FLAT = 6378137.0, 1 / 298.257223563
#: Metres of a degree of latitude at the equator, where they are fewest, rounded down.
DEGREE = 110_500


def metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance on the spheroid, by the great circle between reduced latitudes and its correction of the first order in the flattening (Lambert): within 10 parts in a million for places of one country, 30 for places up to 120 degrees apart (tested); not for antipodes."""
    b1, b2 = (F.atan(F.lit(1 - FLAT) * F.tan(F.radians(x))) for x in (lat1, lat2))
    up = F.pow(F.sin((b2 - b1) / 2), F.lit(2.0))
    a = F.least(F.lit(1.0), up + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)))
    arc = F.lit(2.0) * F.asin(F.sqrt(a))
    middle = F.pow(F.sin((b1 + b2) / 2), F.lit(2.0))
    x = (arc - F.sin(arc)) * middle * (F.lit(1.0) - up) / F.nullif(F.lit(1.0) - a, F.lit(0.0))
    y = (arc + F.sin(arc)) * (F.lit(1.0) - middle) * up / F.nullif(a, F.lit(0.0))
    return F.when(a == 0, F.lit(0.0)).otherwise(F.lit(RADIUS) * (arc - F.lit(FLAT / 2) * (x + y)))


def metres_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    b1, b2 = (f"atan({number(1 - FLAT)} * tan(radians({x})))" for x in (lat1, lat2))
    up = f"pow(sin(({b2} - {b1}) / 2), 2.0)"
    a = f"least(1.0, {up} + cos({b1}) * cos({b2}) * pow(sin(radians({lon2} - {lon1}) / 2), 2.0))"
    arc = f"(2.0 * asin(sqrt({a})))"
    middle = f"pow(sin(({b1} + {b2}) / 2), 2.0)"
    x = f"({arc} - sin({arc})) * {middle} * (1.0 - {up}) / nullif(1.0 - {a}, 0.0)"
    y = f"({arc} + sin({arc})) * (1.0 - {middle}) * {up} / nullif({a}, 0.0)"
    return f"(CASE WHEN {a} = 0 THEN 0.0 ELSE {number(RADIUS)} * ({arc} - {number(FLAT / 2)} * ({x} + {y})) END)"


def degrees(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in the plane of degrees."""
    return F.hypot(lon2 - lon1, lat2 - lat1)


def near_box(lon: Column, lat: Column, at_lon: float, at_lat: float, radius: float) -> Column:
    """A box that holds the circle of radius metres: comparisons of plain columns, which reach the scan as filters."""
    up = radius / DEGREE
    side = up / max(0.01, math.cos(math.radians(min(89.0, abs(at_lat) + up))))
    return lon.between(at_lon - side, at_lon + side) & lat.between(at_lat - up, at_lat + up)


def snapped(x: Column, size: float) -> Column:
    """The number of the nearest grid line; a grid cell is a pair of these."""
    return F.rint(x / F.lit(size)).cast("long")


def snapped_sql(x: str, size: float) -> str:
    return f"CAST(round_even({x} / {number(size)}, 0) AS BIGINT)"


def cell_size(zoom: int) -> float:
    """Side in degrees of the cells that a map clusters by: half a tile."""
    return 360 / 2**zoom / 2


def tap_radius(zoom: int) -> float:
    """Degrees that 25 pixels of 256 a tile span."""
    return 25 * 360 / 2**zoom / 256


def tile_box(zoom: int, x: int, y: int) -> tuple[float, float, float, float]:
    """(west, south, east, north) of a Web-Mercator tile."""
    n = 2**zoom

    def lat(row: int) -> float:
        return math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / n))))

    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


def tile_at(zoom: int, lon: float, lat: float) -> tuple[int, int]:
    n = 2**zoom
    return int((lon + 180) / 360 * n), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)


def on_tile(lon: Column, lat: Column, box: tuple[float, float, float, float], extent: int = 4096) -> tuple[Column, Column]:
    """Whole tile coordinates, linear in degrees, y from the north."""
    west, south, east, north = box
    return F.floor((lon - west) / (east - west) * extent).cast("int"), F.floor((F.lit(north) - lat) / (north - south) * extent).cast("int")


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """The tile that holds a place."""
    n = 2**zoom
    return F.floor((lon + 180) / 360 * n).cast("int"), F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n).cast("int")


def on_own_tile(lon: Column, lat: Column, zoom: int, x: Column, y: Column, extent: int = 4096) -> tuple[Column, Column]:
    """As on_tile, for tiles that columns name."""
    n = 2**zoom
    parallel = lambda row: F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * row / F.lit(n)))))
    west, north, south = x / F.lit(n) * 360 - 180, parallel(y), parallel(y + 1)
    return F.floor((lon - west) / F.lit(360 / n) * extent).cast("int"), F.floor((north - lat) / (north - south) * extent).cast("int")


def on_tile_sql(lon: str, lat: str, box: tuple[float, float, float, float], extent: int = 4096) -> tuple[str, str]:
    west, south, east, north = box
    return (
        f"CAST(floor(({lon} - {number(west)}) / {number(east - west)} * {extent}) AS INTEGER)",
        f"CAST(floor(({number(north)} - {lat}) / {number(north - south)} * {extent}) AS INTEGER)",
    )


def number(x: float) -> str:
    """A double in SQL, exactly."""
    return f"CAST('{x!r}' AS DOUBLE)"


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / F.lit(float(10**digits))


def rounded_sql(x: str, digits: int) -> str:
    return f"floor({x} * {10**digits} + 0.5) / {number(float(10**digits))}"
