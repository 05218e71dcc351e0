"""Points in polygons, search-grid assignment and nearest features."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.geo import EARTH_KM, haversine_km
from almanac.operators import quadtree
from almanac.operators.nearest import knn_join, nearest_edge_km
from almanac.session import join_counted, materialise

RINGS = "array<array<struct<x:double,y:double>>>"


def boundary_table(regions: DataFrame, known: DataFrame | None, region: str, rings: str) -> DataFrame:
    """Rings with their bounding box, limited to known region ids."""
    out = regions if known is None else regions.join(known.select(region), region, "left_semi")
    corners = F.flatten(F.col(rings))

    def side(pick, axis: str) -> Column:
        return pick(F.transform(corners, lambda p: p[axis]))

    return out.select(
        region, F.col(rings).alias("rings"),
        side(F.array_min, "x").alias("min_x"), side(F.array_max, "x").alias("max_x"),
        side(F.array_min, "y").alias("min_y"), side(F.array_max, "y").alias("max_y"),
    )


def inside_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd ray casting over all rings, so holes and multi-polygons need no special case."""

    def crossings(ring: Column) -> Column:
        edges = F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"), F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))

        def crosses(e: Column) -> Column:
            a, b = e["a"], e["b"]
            spans = (a["y"] > y) != (b["y"] > y)
            return spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

        return F.size(F.filter(edges, crosses))

    total = F.aggregate(rings, F.lit(0), lambda acc, r: acc + crossings(r))
    return total % 2 == 1


def _spots(points: DataFrame, lon: str, lat: str) -> DataFrame:
    """Distinct places of the points, numbered and written: a crowded spot is one place."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    there = points.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    return materialise(there.select(x.alias("x"), y.alias("y")).distinct().withColumn("id", F.monotonically_increasing_id()), "spots")


def _back(points: DataFrame, key: str, lon: str, lat: str, found: DataFrame) -> DataFrame:
    """The rows of the points with what was found for their place."""
    rows = points.select(key, F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y"))
    return join_counted(rows, found, ["x", "y"], "inner").drop("x", "y")


def point_in_region(points: DataFrame, boundaries: DataFrame, key: str, region: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """First (smallest) region that holds each point, as (key, region); points outside all are dropped.

    Distinct places meet the boundaries in the leaves of a quadtree (``quadtree.in_boxes``).
    """
    x, y = F.col("x"), F.col("y")
    # a region may come in several rows
    boxes = materialise(boundaries.withColumn("box", F.monotonically_increasing_id()).withColumn("_region", F.col(region)).select(
        "box", "_region", "rings", "min_x", "max_x", "min_y", "max_y"
    ), "boundaries")
    hits = quadtree.in_boxes(_spots(points, lon, lat), boxes).where(inside_rings(x, y, F.col("rings")))
    return _back(points, key, lon, lat, hits.groupBy("x", "y").agg(F.min("_region").alias(region)))


def ring_edges(boundaries: DataFrame, region: str) -> DataFrame:
    """Boundary edges (region, lat1, lon1, lat2, lon2)."""
    ring = F.col("ring")
    return (
        boundaries.select(region, F.explode("rings").alias("ring"))
        .select(region, F.explode(F.arrays_zip(F.slice(ring, F.lit(1), F.size(ring) - 1).alias("a"),
                                               F.slice(ring, F.lit(2), F.size(ring) - 1).alias("b"))).alias("e"))
        .select(region, F.col("e.a.y").alias("lat1"), F.col("e.a.x").alias("lon1"), F.col("e.b.y").alias("lat2"), F.col("e.b.x").alias("lon2"))
    )


def nearest_feature_km(
    entities: DataFrame,
    points: DataFrame,
    kinds: Sequence,
    kind: str,
    key: str = "id",
    lat: str = "lat",
    lon: str = "lon",
    polygons: DataFrame | None = None,
) -> DataFrame:
    """One column ``dist_<kind>`` per feature kind: km to the nearest point or polygon, infinity when none.

    ``polygons`` are boundary rows with the ``kind`` column; inside a polygon the distance is 0.
    """
    out = entities.select(key, lat, lon)
    for value in kinds:
        of_kind = points.where(F.col(kind) == value).select(F.col(key), lat, lon)
        found = knn_join(out, of_kind, key, lat, lon, 1).select(key, F.col("km"))
        if polygons is not None:
            shapes = polygons.where(F.col(kind) == value)
            edge = nearest_edge_km(out, ring_edges(shapes, kind), key, lat, lon)
            held = point_in_region(out, shapes, key, kind, lon, lat).select(key, F.lit(0.0).alias("km"))
            found = found.unionByName(edge).unionByName(held)
        best = found.groupBy(key).agg(F.min("km").alias(f"dist_{value}"))
        out = out.join(best, key, "left").na.fill({f"dist_{value}": math.inf})
    return out.drop(lat, lon)


def assign_to_grid(points: DataFrame, centres: DataFrame, key: str, lat: str, lon: str, radius_km: float = 50.0) -> DataFrame:
    """First grid centre in (lat, lon) order within the radius of each point; points out of reach are dropped.

    Distinct places meet the bounds of the circles in the leaves of a quadtree.
    """
    reach = math.degrees(radius_km / EARTH_KM)
    c_lat, c_lon = F.col("c_lat"), F.col("c_lon")
    # the widest longitude of a circle lies off its centre's parallel; a circle over a pole holds all longitudes
    wide = F.sin(F.lit(radius_km / EARTH_KM)) / F.greatest(F.cos(F.radians(c_lat)), F.lit(1e-9))
    width = F.when((F.abs(c_lat) + reach >= 90.0) | (wide >= 1.0), F.lit(360.0)).otherwise(F.degrees(F.asin(F.least(wide, F.lit(1.0)))) + 1e-9)
    boxes = centres.select(F.col("lat").cast("double").alias("c_lat"), F.col("lon").cast("double").alias("c_lon")).distinct()
    boxes = boxes.select(
        "c_lat", "c_lon", (c_lon - width).alias("min_x"), (c_lon + width).alias("max_x"),
        (c_lat - reach - 1e-9).alias("min_y"), (c_lat + reach + 1e-9).alias("max_y"),
    )
    # a circle over the date line is laid on both sides of it
    turned = F.explode(F.filter(F.array(*map(F.lit, (0.0, 360.0, -360.0))), lambda t: (t == 0) | ((t > 0) & (F.col("min_x") < -180)) | ((t < 0) & (F.col("max_x") > 180))))
    boxes = boxes.withColumn("_t", turned).withColumn("min_x", F.col("min_x") + F.col("_t")).withColumn("max_x", F.col("max_x") + F.col("_t"))
    boxes = boxes.drop("_t").withColumn("box", F.monotonically_increasing_id())
    near = quadtree.in_boxes(_spots(points, lon, lat), materialise(boxes, "circles"))
    near = near.where(haversine_km(c_lat, c_lon, F.col("y"), F.col("x")) <= radius_km)
    first = near.groupBy("x", "y").agg(F.min(F.struct("c_lat", "c_lon")).alias("c"))
    return _back(points, key, lon, lat, first).select(key, "c.*")
