"""The Dutch national grid (oblique stereographic, on Bessel's ellipsoid) from and to longitude and latitude on WGS84, as column expressions.

The shift between the two ellipsoids has the signs that the map's aerial images are asked for with; two of its turns differ in sign from the official ones, which moves places by some 75 m.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Axes and flattenings of Bessel 1841 and WGS84; the grid's centre, scale and false origin; the shift from Bessel to WGS84 (metres, seconds of arc, parts in a million).
BESSEL, WGS84 = (6377397.155, 1 / 299.1528128), (6378137.0, 1 / 298.257223563)
LAT_0, LON_0, SCALE, X_0, Y_0 = 52.15616055555555, 5.387638888888889, 0.9999079, 155000.0, 463000.0
SHIFT, TURN, GROWTH = (565.2369, 50.0087, 465.658), (-0.40685, -0.35073, 1.87035), 4.0812

_A, _F = BESSEL
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)
_TURN = tuple(math.radians(s / 3600) for s in TURN)
_GROWTH = 1 + GROWTH / 1e6
_SIN, _COS2 = math.sin(math.radians(LAT_0)), math.cos(math.radians(LAT_0)) ** 2
#: The sphere that the ellipsoid is drawn on: its radius over the axis, the stretch of longitudes, the centre's latitude on it, and the factor that fits latitudes.
_RADIUS = math.sqrt(1 - _E2) / (1 - _E2 * _SIN**2)
_STRETCH = math.sqrt(1 + _E2 * _COS2**2 / (1 - _E2))
_CENTRE = math.asin(_SIN / _STRETCH)
_FIT = math.tan(_CENTRE / 2 + math.pi / 4) / (math.tan(math.radians(LAT_0) / 2 + math.pi / 4) ** _STRETCH * ((1 - _E * _SIN) / (1 + _E * _SIN)) ** (_STRETCH * _E / 2))
#: Turns after which latitudes no longer change.
TURNS = 6



def _half(x: Column) -> Column:
    return F.tan(x / 2 + math.pi / 4)


def _ratio(s: Column, power: float) -> Column:
    return F.pow((1 - _E * s) / (1 + _E * s), F.lit(power))


def _then(value: Column, step: Callable[[Column], Column]) -> Column:
    """step of a value, which is computed once however often step names it, also where a filter is pushed below it."""
    return F.transform(F.array(value), step)[0]


def _named(**parts: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def _in_space(p: Column, figure: tuple[float, float]) -> Column:
    """x, y, z of a place (lon, lat in radians) on an ellipsoid."""
    a, f = figure
    e2 = f * (2 - f)
    with_n = _then(p, lambda p: _named(lon=p["lon"], lat=p["lat"], n=a / F.sqrt(1 - e2 * F.sin(p["lat"]) * F.sin(p["lat"]))))
    return _then(with_n, lambda p: _named(x=p["n"] * F.cos(p["lat"]) * F.cos(p["lon"]), y=p["n"] * F.cos(p["lat"]) * F.sin(p["lon"]), z=p["n"] * (1 - e2) * F.sin(p["lat"])))


def _on_figure(q: Column, figure: tuple[float, float]) -> Column:
    """lon and lat (radians) of x, y, z."""
    a, f = figure
    e2 = f * (2 - f)
    v = _then(q, lambda q: _named(lon=F.atan2(q["y"], q["x"]), p=F.hypot(q["x"], q["y"]), z=q["z"], lat=F.atan2(q["z"], F.hypot(q["x"], q["y"]) * (1 - e2))))
    for _ in range(TURNS):
        v = _then(v, lambda v: _named(lon=v["lon"], p=v["p"], z=v["z"], s=F.sin(v["lat"])))
        v = _then(v, lambda v: _named(lon=v["lon"], p=v["p"], z=v["z"], lat=F.atan2(v["z"] + e2 * a / F.sqrt(1 - e2 * v["s"] * v["s"]) * v["s"], v["p"])))
    return v


def to_rd(lon: Column, lat: Column) -> Column:
    """A structure of the grid's x and y in metres, of a place in degrees; both null where the place is null."""
    (dx, dy, dz), (rx, ry, rz) = SHIFT, _TURN
    v = _in_space(_named(lon=F.radians(lon), lat=F.radians(lat)), WGS84)
    v = _then(v, lambda q: _named(x=(q["x"] - dx) / _GROWTH, y=(q["y"] - dy) / _GROWTH, z=(q["z"] - dz) / _GROWTH))
    v = _then(v, lambda q: _named(x=q["x"] + rz * q["y"] - ry * q["z"], y=-rz * q["x"] + q["y"] + rx * q["z"], z=ry * q["x"] - rx * q["y"] + q["z"]))
    v = _on_figure(v, BESSEL)
    v = _then(v, lambda p: _named(b=2 * F.atan(_FIT * F.pow(_half(p["lat"]), F.lit(_STRETCH)) * _ratio(F.sin(p["lat"]), _STRETCH * _E / 2)) - math.pi / 2, l=_STRETCH * (p["lon"] - math.radians(LON_0))))
    s0, c0 = math.sin(_CENTRE), math.cos(_CENTRE)
    v = _then(v, lambda p: _named(b=p["b"], l=p["l"], k=_A * SCALE * 2 * _RADIUS / (1 + s0 * F.sin(p["b"]) + c0 * F.cos(p["b"]) * F.cos(p["l"]))))
    return _then(v, lambda p: _named(x=p["k"] * F.cos(p["b"]) * F.sin(p["l"]) + X_0, y=p["k"] * (c0 * F.sin(p["b"]) - s0 * F.cos(p["b"]) * F.cos(p["l"])) + Y_0))


def to_degrees(x: Column, y: Column) -> Column:
    """A structure of lon and lat in degrees, of a place in the grid's metres; both null where the place is null."""
    s0, c0 = math.sin(_CENTRE), math.cos(_CENTRE)
    v = _then(_named(u=(x - X_0) / (_A * SCALE), v=(y - Y_0) / (_A * SCALE)), lambda p: _named(u=p["u"], v=p["v"], r=F.hypot(p["u"], p["v"])))
    v = _then(v, lambda p: _named(u=p["u"], v=p["v"], r=p["r"], c=2 * F.atan2(p["r"], F.lit(2 * _RADIUS))))
    # The sine over the distance, which is 0 at the centre: there the sine is 0 too.
    v = _then(v, lambda p: _named(u=p["u"], v=p["v"], c=F.cos(p["c"]), q=F.when(p["r"] == 0, 0.0).otherwise(F.sin(p["c"]) / p["r"])))
    v = _then(v, lambda p: _named(b=F.asin(p["c"] * s0 + p["v"] * p["q"] * c0), l=F.atan2(p["u"] * p["q"], c0 * p["c"] - p["v"] * s0 * p["q"])))
    v = _then(v, lambda p: _named(lon=p["l"] / _STRETCH + math.radians(LON_0), w=F.pow(_half(p["b"]) / _FIT, F.lit(1 / _STRETCH)), lat=p["b"]))
    for _ in range(TURNS):
        v = _then(v, lambda p: _named(lon=p["lon"], w=p["w"], lat=2 * F.atan(p["w"] * _ratio(F.sin(p["lat"]), -_E / 2)) - math.pi / 2))
    v = _in_space(v, BESSEL)
    (dx, dy, dz), (rx, ry, rz) = SHIFT, _TURN
    v = _then(v, lambda q: _named(x=_GROWTH * (q["x"] - rz * q["y"] + ry * q["z"]) + dx, y=_GROWTH * (rz * q["x"] + q["y"] - rx * q["z"]) + dy, z=_GROWTH * (-ry * q["x"] + rx * q["y"] + q["z"]) + dz))
    return _then(_on_figure(v, WGS84), lambda p: _named(lon=F.degrees(p["lon"]), lat=F.degrees(p["lat"])))


def with_rd(df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "rd_x", y: str = "rd_y") -> DataFrame:
    """df with the grid's metres of places in degrees; null where a place is null."""
    found = to_rd(F.col(lon), F.col(lat))
    return df.select("*", found.alias("_rd")).select(*df.columns, F.col("_rd.x").alias(x), F.col("_rd.y").alias(y))


def from_rd(df: DataFrame, x: str = "rd_x", y: str = "rd_y", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with degrees of places in the grid's metres; null where a place is null."""
    found = to_degrees(F.col(x), F.col(y))
    return df.select("*", found.alias("_at")).select(*df.columns, F.col("_at.lon").alias(lon), F.col("_at.lat").alias(lat))
