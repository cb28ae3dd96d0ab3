"""Geodesy as column expressions; distances in km on a sphere of radius 6371."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEG = 111.32
CELL_DEG = 10
CIRCLE_CELL_DEG = 5
RING_CELL_DEG = 2


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def js_round(x: Column) -> Column:
    """Half toward plus infinity, also below zero."""
    return F.floor(x + 0.5)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance."""
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))  # null stays null


def wrap_lon(lon) -> Column:
    """Into [-180, 180)."""
    return F.pmod(_col(lon) + 180.0, F.lit(360.0)) - 180.0


def destination_point(lat, lon, bearing_deg, km) -> Column:
    """struct<lon, lat>: where a bearing and a distance lead."""
    lat, lon, bearing, arc = F.radians(_col(lat)), F.radians(_col(lon)), F.radians(_col(bearing_deg)), _col(km) / EARTH_KM
    lat2 = F.asin(F.sin(lat) * F.cos(arc) + F.cos(lat) * F.sin(arc) * F.cos(bearing))
    lon2 = lon + F.atan2(F.sin(bearing) * F.sin(arc) * F.cos(lat), F.cos(arc) - F.sin(lat) * F.sin(lat2))
    return F.struct(wrap_lon(F.degrees(lon2)).alias("lon"), F.degrees(lat2).alias("lat"))


def _mercator_y(lat) -> Column:
    return F.log(F.tan(F.radians(lat) / 2 + 3.141592653589793 / 4))


def mercator_point(lat1, lon1, lat2, lon2, f) -> Column:
    """struct<lon, lat>: the fraction f along the straight line on a Web-Mercator map; no dateline wrap."""
    lat1, lon1, lat2, lon2, f = map(_col, (lat1, lon1, lat2, lon2, f))
    y = _mercator_y(lat1) + (_mercator_y(lat2) - _mercator_y(lat1)) * f
    return F.struct((lon1 + (lon2 - lon1) * f).alias("lon"), F.degrees(2 * F.atan(F.exp(y)) - 3.141592653589793 / 2).alias("lat"))


def great_circle_point(lat1, lon1, lat2, lon2, f) -> Column:
    """struct<lon, lat>: the fraction f along the great circle; equal ends give that point."""
    d = haversine_km(lat1, lon1, lat2, lon2) / EARTH_KM
    la1, lo1, la2, lo2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    f = _col(f)
    a, b = F.try_divide(F.sin((1 - f) * d), F.sin(d)), F.try_divide(F.sin(f * d), F.sin(d))
    x = a * F.cos(la1) * F.cos(lo1) + b * F.cos(la2) * F.cos(lo2)
    y = a * F.cos(la1) * F.sin(lo1) + b * F.cos(la2) * F.sin(lo2)
    z = a * F.sin(la1) + b * F.sin(la2)
    there = F.struct(F.degrees(F.atan2(y, x)).alias("lon"), F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"))
    return F.when(d == 0, F.struct(_col(lon1).alias("lon"), _col(lat1).alias("lat"))).otherwise(there)


def raster_cell(lon, lat, res: float = 0.1) -> Column:
    """struct<x, y>: the cell of a lon/lat grid; x wraps, y is clamped."""
    nx, ny = round(360 / res), round(180 / res)
    x = F.pmod(F.floor(F.pmod(_col(lon) + 180.0, F.lit(360.0)) / res), F.lit(nx))
    y = F.least(F.lit(ny - 1), F.greatest(F.lit(0), F.floor((_col(lat) + 90.0) / res)))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))


def cell_center(x, y, res: float = 0.1) -> Column:
    """struct<lon, lat> of a cell."""
    nx = round(360 / res)
    return F.struct((F.pmod(_col(x), F.lit(nx)) * res - 180.0 + res / 2).alias("lon"), (_col(y) * res - 90.0 + res / 2).alias("lat"))


def circle_box(lat, lon, radius_km) -> list[Column]:
    """min_lon, min_lat, max_lon, max_lat round a circle."""
    lat, lon = _col(lat), _col(lon)
    d_lat = _col(radius_km) / KM_PER_DEG
    d_lon = d_lat / F.greatest(F.cos(F.radians(lat)), F.lit(0.05))
    return [(lon - d_lon).alias("min_lon"), (lat - d_lat).alias("min_lat"), (lon + d_lon).alias("max_lon"), (lat + d_lat).alias("max_lat")]


def cell_grid(max_km: float) -> tuple[float, int]:
    """(width in degrees, columns) of the finest grid whose cells are at least max_km high and go round the globe without a rest."""
    columns = max(1, math.floor(360 * 111.0 / max_km))
    return 360 / columns, columns


def cell_reach(lat: Column, deg: float, columns: int) -> Column:
    """How many cells to either side may hold what is within a cell's height; near a pole, all of them."""
    top = F.abs(lat) + deg
    return F.when(top >= 89, columns // 2 + 1).otherwise(F.least(F.lit(columns // 2 + 1), F.ceil(1 / F.cos(F.radians(top))))).cast("int")
