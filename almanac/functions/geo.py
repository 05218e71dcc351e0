"""Distances, grid cells, and map projection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0
TILE_PX = 256


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(EARTH_KM * 2) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def unit_xyz(lat: Column, lon: Column) -> list[Column]:
    """Point on the unit sphere; straight-line distance there grows with great-circle distance."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


def chord(km: float) -> float:
    """Straight-line length between unit-sphere points ``km`` apart."""
    return 2 * math.sin(min(km / EARTH_KM, math.pi) / 2)


def grid_cell(lat: Column, lon: Column, cell_deg: float = 0.05) -> list[Column]:
    return [F.floor(lat / cell_deg).cast("bigint"), F.floor(lon / cell_deg).cast("bigint")]


def grid_points(
    spark: SparkSession,
    lat: tuple[float, float],
    lon: tuple[float, float],
    step: float,
    dense_boxes: Sequence[tuple[float, float, float, float]] = (),
    dense_step: float = 0.5,
) -> DataFrame:
    """Regular search grid; inside each dense box the finer grid replaces the coarse one.

    Boxes apply in order, as a later box also clears points of an earlier one.
    """

    def box(lo_lat: float, hi_lat: float, lo_lon: float, hi_lon: float, by: float, rank: int) -> DataFrame:
        n_lat, n_lon = int((hi_lat - lo_lat + 1e-9) / by) + 1, int((hi_lon - lo_lon + 1e-9) / by) + 1
        i = F.col("id")
        return spark.range(n_lat * n_lon).select(
            F.round(F.lit(lo_lat) + F.floor(i / n_lon) * by, 6).alias("lat"),
            F.round(F.lit(lo_lon) + (i % n_lon) * by, 6).alias("lon"),
            F.lit(rank).alias("rank"),
        )

    points = box(*lat, *lon, step, 0)
    for rank, b in enumerate(dense_boxes, 1):
        points = points.unionByName(box(*b, dense_step, rank))
    for rank, (a, b, c, d) in enumerate(dense_boxes, 1):
        inside = F.col("lat").between(a, b) & F.col("lon").between(c, d)
        points = points.where(~inside | (F.col("rank") >= rank))
    return points.select("lat", "lon").distinct()


def mercator_pixel(lat: Column, lon: Column, zoom: int) -> list[Column]:
    """Web-Mercator pixel position at an integer zoom."""
    world = float(TILE_PX * 2**zoom)
    x = (lon + 180.0) / 360.0
    y = 0.5 - F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) / (2 * math.pi)
    return [x * world, y * world]


def fit_zoom(width_px: int, height_px: int, lat: tuple[float, float], lon: tuple[float, float]) -> int:
    """Largest integer zoom at which the box fits into the picture."""

    def y(v: float) -> float:
        return 0.5 - math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) / (2 * math.pi)

    wide, high = (lon[1] - lon[0]) / 360.0, y(lat[0]) - y(lat[1])
    return math.floor(math.log2(min(width_px / (wide * TILE_PX), height_px / (high * TILE_PX))))
