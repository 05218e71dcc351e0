"""Nearest search with rules, segments and regions against brute force, in many small blocks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import nearest, quadtree, regions
from test_matching import hav


@pytest.mark.parametrize("rule", [None, "above", "other"])
def test_rules_equal_brute_force(spark, monkeypatch, rule):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 25)
    rnd = random.Random(5)
    pt = lambda i: (i, rnd.random(), rnd.random() ** 3, rnd.randrange(6))
    qs, ts = [pt(i) for i in range(60)], [pt(i) for i in range(80)]
    schema = "id long, x double, y double, attr long"
    q, t = spark.createDataFrame(qs, schema), spark.createDataFrame(ts, schema)
    k, reach = 2, 0.3
    got = {}
    for r in nearest.nearest(q, t, ["x", "y"], k, 0.0, 1.0, reach, rule, block=12).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other))
    allowed = {None: lambda a, b: True, "above": lambda a, b: b > a, "other": lambda a, b: b != a}[rule]
    for i, x, y, a in qs:
        near = sorted((math.hypot(x - u, y - v), j) for j, u, v, b in ts if allowed(a, b))
        want = [j for d, j in near if d <= reach][:k]
        assert [j for _, j in sorted(got.get(i, []))] == want


def test_empty_targets(spark):
    q = spark.createDataFrame([(1, 0.5, 0.5)], "id long, x double, y double")
    assert nearest.nearest(q, q.where("false"), ["x", "y"], 1, 0.0, 1.0).count() == 0


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y)]


def test_polygon_distance_and_membership(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 40)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 9)
    shapes = [(1, [square(0.0, 40.0, 2.0), square(0.5, 40.5, 1.0)]), (2, [square(5.0, 44.0, 0.3)]), (3, [square(1.8, 41.0, 1.0)])]
    df = spark.createDataFrame(shapes, f"region long, rings {regions.RINGS}")
    bounds = regions.boundary_table(df, None, "region", "rings")
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(39, 45), rnd.uniform(-1, 6)) for i in range(40)] + [(90, 41.0, 1.0), (91, 41.2, 1.9)]
    p = spark.createDataFrame(pts, "id long, lat double, lon double")

    def inside(rings, x, y):
        n = 0
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                n += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return n % 2 == 1

    got = {r.id: r.region for r in regions.point_in_region(p, bounds, "id", "region").collect()}
    want = {i: min(s for s, rings in shapes if inside(rings, lo, la)) for i, la, lo in pts if any(inside(rings, lo, la) for _, rings in shapes)}
    assert got == want and 90 not in got and got[91] == 1

    def edge_km(la, lo):
        best = math.inf
        for _, rings in shapes:
            for r in rings:
                for (ax, ay), (bx, by) in zip(r, r[1:]):
                    for s in range(401):
                        f = s / 400
                        best = min(best, hav((la, lo), (ay + (by - ay) * f, ax + (bx - ax) * f)))
        return best

    km = {r.id: r.km for r in nearest.nearest_edge_km(p, regions.ring_edges(bounds, "region"), "id", "lat", "lon").collect()}
    for i, la, lo in pts:
        assert km[i] == pytest.approx(edge_km(la, lo), abs=0.3)
    far = regions.nearest_feature_km(p, p.where("false").withColumn("kind", F.lit(1)), [1, 9], "kind", polygons=bounds.withColumn("kind", F.lit(1).cast("long")))
    out = {r.id: (r.dist_1, r.dist_9) for r in far.collect()}
    assert all(out[i][1] == math.inf and out[i][0] == (0.0 if i in want else km[i]) for i in out)


def test_grid_assignment_takes_first_centre(spark):
    centres = spark.createDataFrame([(40.0, -75.0), (40.0, -74.5), (40.5, -74.75)], "lat double, lon double")
    p = spark.createDataFrame([(1, 40.2, -74.7), (2, 50.0, 0.0)], "id long, lat double, lon double")
    got = regions.assign_to_grid(p, centres, "id", "lat", "lon", 60.0).collect()
    assert [(r.id, r.c_lat, r.c_lon) for r in got] == [(1, 40.0, -75.0)]


def test_grid_assignment_around_the_date_line_and_poles(spark):
    rnd = random.Random(8)
    centres = [(rnd.choice([-89.9, -60.0, 0.0, 89.7, 45.5]), rnd.uniform(-180, 180)) for _ in range(30)] + [(10.0, 179.9), (10.0, -179.9), (89.95, 3.0)]
    pts = [(i, rnd.choice([rnd.uniform(-90, 90), 89.9, 10.1]), rnd.choice([rnd.uniform(-180, 180), 179.95, -179.95])) for i in range(150)]
    pts += [(900 + i, 10.0, 180.0) for i in range(20)] + [(950, None, 1.0), (951, float("nan"), 1.0)]
    frame = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {r.id: (r.c_lat, r.c_lon) for r in regions.assign_to_grid(frame, spark.createDataFrame(centres, "lat double, lon double"), "id", "lat", "lon", 80.0).collect()}
    want = {}
    for i, la, lo in pts[:-2]:
        near = [c for c in centres if hav((la, lo), c) <= 80.0]
        if near:
            want[i] = min(near)
    assert got == want and len(want) > 20


def crowded(n, seed=5):
    """Nine points of ten in one small cell, the rest far and wide; copies too."""
    rnd = random.Random(seed)
    close = [(7.0 + rnd.random() * 0.01, 50.0 + rnd.random() * 0.01) for _ in range(int(n * 0.9))]
    wide = [(rnd.uniform(-20, 40), rnd.uniform(30, 70)) for _ in range(n - len(close))]
    return close + wide


def test_leaves_stay_small_in_a_crowd(spark):
    spots = crowded(6_000)
    places = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "id long, x double, y double")
    rnd = random.Random(1)
    rows = [(0, -180.0, 180.0, -90.0, 90.0), (1, 6.9, 7.1, 49.9, 50.1)]
    rows += [(2 + i, x, x + w, y, y + w) for i, (x, y, w) in enumerate((rnd.uniform(6.9, 7.02), rnd.uniform(49.9, 50.02), rnd.random() * 0.02) for _ in range(200))]
    boxes = spark.createDataFrame(rows, "box long, min_x double, max_x double, min_y double, max_y double")
    held = 0
    for part, laid in quadtree.leaves(places, boxes, 100, 20):
        sizes = [r["count"] for r in part.groupBy("i", "j").count().collect()]
        assert max(sizes, default=0) <= 100
        held += sum(sizes)
        cells = {(r.i, r.j) for r in part.collect()}
        assert {(r.i, r.j) for r in laid.collect()} <= cells  # boxes are copied to cells with places only
    assert held == len(spots)
    got = sorted((r.id, r.box) for r in quadtree.in_boxes(places, boxes.withColumn("name", boxes.box), 100, 20).collect())
    want = sorted((i, b[0]) for i, (x, y) in enumerate(spots) for b in rows if b[1] <= x <= b[2] and b[3] <= y <= b[4])
    assert got == want


def test_regions_of_a_crowd(spark):
    """Nine points of ten in one cell and a third of them on one spot: each region as the plain loop finds it."""
    spots = crowded(1_500) + [(7.004, 50.004)] * 700
    shapes = [(i, [square(7.0 + (i % 4) * 0.003, 50.0 + (i // 4) * 0.003, 0.0035)]) for i in range(16)] + [(99, [square(-20.0, 30.0, 35.0)])]
    bounds = regions.boundary_table(spark.createDataFrame(shapes, f"region long, rings {regions.RINGS}"), None, "region", "rings")
    p = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(spots)], "id long, lat double, lon double")
    want = {}
    for i, (x, y) in enumerate(spots):
        held = [s for s, rings in shapes if rings[0][0][0] < x < rings[0][2][0] and rings[0][0][1] < y < rings[0][2][1]]
        if held:
            want[i] = min(held)
    assert {r.id: r.region for r in regions.point_in_region(p, bounds, "id", "region").collect()} == want
    assert regions.point_in_region(p.where("false"), bounds, "id", "region").count() == 0
    assert regions.point_in_region(p, bounds.where("false"), "id", "region").count() == 0
