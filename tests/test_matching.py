"""Matching and nearest-place joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from almanac.operators import greedy as greedy_match
from almanac.operators import matching, nearest, ranks
from almanac.presets import FILL_STOP_WORDS


def hav(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 12742.0 * math.asin(math.sqrt(h))


def crowd(n, seed, copies=0.3):
    """Points of a small town, a share of them on one spot."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if rnd.random() < copies:
            out.append((i, 40.7, -74.0))
        else:
            out.append((i, 40.7 + rnd.gauss(0, 0.01), -74.0 + rnd.gauss(0, 0.01)))
    return out


@pytest.mark.parametrize("block", [2000, 16])
def test_knn_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 50)
    pts = crowd(120, 1)
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    original = nearest.nearest
    monkeypatch.setattr(nearest, "nearest", lambda *a, **k: original(*a, **{**k, "block": block}))
    got = {(r[0], r[3]): r[1] for r in nearest.knn_join(df, df, "id", "lat", "lon", 4, exclude_self=True).collect()}
    for i, la, lo in pts:
        want = sorted((round(hav((la, lo), (p[1], p[2])), 9), p[0]) for p in pts if p[0] != i)[:4]
        assert [got[(i, k + 1)] for k in range(4)] == [w[1] for w in want]


def greedy(left, right, max_km):
    pairs = sorted((hav(a[1:], b[1:]), a[0], b[0]) for a in left for b in right)
    used_l, used_r, out = set(), set(), set()
    for d, a, b in pairs:
        if d <= max_km and a not in used_l and b not in used_r:
            used_l.add(a)
            used_r.add(b)
            out.add((a, b))
    return out


def test_greedy_pairs_equal_sorted_loop(spark):
    left, right = crowd(26, 3), crowd(22, 4)
    schema = "id long, lat double, lon double"
    got = greedy_match.greedy_nearest_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert {(r.left_id, r.right_id) for r in got.collect()} == greedy(left, right, 1.0)


def test_greedy_contested_pair(spark):
    schema = "id long, lat double, lon double"
    left = spark.createDataFrame([(1, 10.0, 10.0), (2, 10.002, 10.0)], schema)
    right = spark.createDataFrame([(7, 10.0005, 10.0), (8, 10.004, 10.0)], schema)
    got = {(r.left_id, r.right_id) for r in greedy_match.greedy_nearest_pairs(left, right).collect()}
    assert got == {(1, 7), (2, 8)}


@pytest.mark.parametrize("seed", range(4))
def test_greedy_pairs_of_crowds_and_grids(spark, seed):
    """Equal distances, crowded spots and lists that run dry give the pairs of the sorted loop."""
    rng = random.Random(seed)
    spot = lambda: (round(10 + rng.randint(0, 3) * 0.002, 6), round(10 + rng.randint(0, 3) * 0.002, 6))
    left = [(i, *((10.0, 10.0) if rng.random() < 0.3 else spot())) for i in rng.sample(range(1000), 45)]
    right = [(i, *((10.002, 10.0) if rng.random() < 0.3 else spot())) for i in rng.sample(range(1000), 40)]
    schema = "id long, lat double, lon double"

    def chord(a, b):  # the order the search sees, in which mirrored grid distances are exactly equal or clearly apart
        xyz = lambda p: (
            math.cos(math.radians(p[0])) * math.cos(math.radians(p[1])),
            math.cos(math.radians(p[0])) * math.sin(math.radians(p[1])),
            math.sin(math.radians(p[0])),
        )
        return sum((u - v) ** 2 for u, v in zip(xyz(a[1:]), xyz(b[1:])))

    used_l, used_r, want = set(), set(), set()
    for _, a, b in sorted((chord(a, b), a[0], b[0]) for a in left for b in right if hav(a[1:], b[1:]) <= 1.0):
        if a not in used_l and b not in used_r:
            used_l.add(a)
            used_r.add(b)
            want.add((a, b))
    got = greedy_match.greedy_nearest_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    rows = [(r.left_id, r.right_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) == len(want)
    assert set(rows) == want


def test_greedy_chain_of_ten_thousand(spark):
    """Each place is contested by the next: one round decides what a loop of nearest pairs takes 5,000 rounds for."""
    at, places = 0.0, []
    for i in range(10_000):
        places.append((i, 0.0, at / 111.1949))
        at += 0.010 + i * 1e-6  # kilometres, ever farther apart
    schema = "id long, lat double, lon double"
    left = spark.createDataFrame([p for p in places if p[0] % 2 == 0], schema)
    right = spark.createDataFrame([p for p in places if p[0] % 2 == 1], schema)
    got = greedy_match.greedy_nearest_pairs(left, right, max_km=0.024, rounds=2).collect()
    assert {(r.left_id, r.right_id) for r in got} == {(i, i + 1) for i in range(0, 10_000, 2)}


def test_greedy_stops_loudly(spark):
    schema = "id long, lat double, lon double"
    left, right = (spark.createDataFrame(crowd(26, s), schema) for s in (3, 4))
    with pytest.raises(RuntimeError, match="places are left after 1 rounds"):
        greedy_match.greedy_nearest_pairs(left, right, rounds=1)
    empty = spark.createDataFrame([], schema)
    assert greedy_match.greedy_nearest_pairs(left, empty).count() == 0
    nowhere = spark.createDataFrame([(1, None, 2.0), (2, None, None)], schema)
    assert greedy_match.greedy_nearest_pairs(nowhere, right).count() == 0


def loop_merge(left, right):
    def tokens(s):
        return set(s.split()) - {"of", "the", "and", "a", "center", "community"}

    def same(a, b):
        ta, tb = tokens(a), tokens(b)
        return a == b if not ta or not tb else len(ta & tb) / max(len(ta), len(tb)) >= 0.65

    used, out = set(), set()
    for lid, lname, lstate, la, lo in left:
        best = None
        for rid, rname, rstate, a, o in right:
            if rid in used:
                continue
            d = hav((la, lo), (a, o))
            if d <= 0.2 or (d <= 1.0 and lstate.upper() == rstate.upper() and same(lname, rname)):
                if best is None or d < best[0]:
                    best = (d, rid)
        if best:
            used.add(best[1])
            out.add((lid, best[1]))
    return out


def test_merge_equals_sequential_loop(spark):
    rnd = random.Random(9)
    words = ["north", "hill", "river", "house", "garden"]

    def side(n, seed):
        return [
            (i, " ".join(rnd.sample(words, 3)), rnd.choice(["NY", "nj"]), la, lo)
            for i, la, lo in crowd(n, seed, 0.25)
        ]

    left, right = side(26, 11), side(22, 12)
    schema = "id long, name string, state string, lat double, lon double"
    frames = []
    for rows in (left, right):
        df = spark.createDataFrame(rows, schema)
        frames.append(df.withColumn("seq", df.id))
    got = {(r.left_id, r.right_id) for r in matching.merge_two_lists(*frames).collect()}
    assert got == loop_merge(left, right)


def test_merge_follows_a_chain_of_refusals_in_few_rounds(spark, monkeypatch):
    """Every row takes the place the next one asked for: refusal by refusal that would be a round per row."""
    km = 1 / 111.1949
    right = [(i, f"r{i}", "NY", 0.1 * i * km, 0.0) for i in range(40)]
    left = [(i, f"l{i}", "NJ", 0.1 * (i - 0.6) * km if i else 0.0, 0.0) for i in range(40)]
    schema = "id long, name string, state string, lat double, lon double"
    written = []
    monkeypatch.setattr(matching, "materialise", lambda df, name, old=matching.materialise: written.append(name) or old(df, name))
    frames = [spark.createDataFrame(rows, schema).withColumn("seq", F.col("id")) for rows in (left, right)]
    got = {(r.left_id, r.right_id) for r in matching.merge_two_lists(*frames).collect()}
    assert got == loop_merge(left, right) == {(i, i) for i in range(40)}
    assert len(written) < 40


def test_merge_does_not_depend_on_lists_and_tiles(spark, monkeypatch):
    """Lists that run out, rows that go from tile to tile, and tiles with too many rows for one task."""
    for name, value in (("LIST", 2), ("LONGEST", 3), ("TILE_UNITS", 5), ("TILE_ROWS", 6)):
        monkeypatch.setattr(matching, name, value)
    rnd = random.Random(4)
    side = lambda n, seed: [(i, rnd.choice(["hill house", "river garden"]), rnd.choice(["NY", "nj"]), la, lo) for i, la, lo in crowd(n, seed, 0.3)]
    left, right = side(40, 21), side(36, 22)
    schema = "id long, name string, state string, lat double, lon double"
    frames = [spark.createDataFrame(rows, schema).withColumn("seq", F.col("id")) for rows in (left, right)]
    got = {(r.left_id, r.right_id) for r in matching.merge_two_lists(*frames).collect()}
    assert got == loop_merge(left, right)


def test_first_match_fill_takes_first_fitting_record(spark):
    rows = spark.createDataFrame(
        [(1, "House of the Hill", "NY"), (2, "House of the Hill", ""), (3, "The Community Center", "NJ"), (4, "X", "TX")],
        "id long, name string, state string",
    )
    ref = spark.createDataFrame(
        [(1, "Hill House", "NJ", "a"), (2, "hill  hóuse", "NY", "b"), (3, "The Community Center", "NJ", "c"), (4, "X", "", "d")],
        "seq long, name string, state string, site string",
    )
    got = matching.first_match_fill(rows, ref, "id", "name", "state", "seq", ["site"], FILL_STOP_WORDS).collect()
    assert {r.id: r.site for r in got} == {1: "b", 2: "a", 3: "c"}


def test_sliced_row_numbers_and_ranks(spark):
    rnd = random.Random(2)
    vals = [(i, rnd.randrange(3), float(rnd.randrange(20))) for i in range(300)]
    df = spark.createDataFrame(vals, "id long, g int, v double")
    numbered = ranks.row_number_within(df, ["g"], "v", bounds=[3.0, 9.0, 15.0], ties=["id"]).collect()
    for g in range(3):
        want = {i: n for n, (i, _, _) in enumerate(sorted((t for t in vals if t[1] == g), key=lambda t: (t[2], t[0])), 1)}
        assert {r.id: r.nth for r in numbered if r.g == g} == want
    ranked = {r.v: r["rank"] for r in ranks.average_ranks(df, "v", bounds=[3.0, 9.0]).collect()}
    ordered = sorted(t[2] for t in vals)
    for v in set(ordered):
        at = [i + 1 for i, x in enumerate(ordered) if x == v]
        assert ranked[v] == sum(at) / len(at)


def test_merged_list_has_every_row_once(spark):
    left = spark.createDataFrame([(1, "a", ""), (2, "b", "x"), (3, None, "y")], "id long, name string, site string")
    right = spark.createDataFrame([(10, "z", "s", "addr"), (11, "", None, "here"), (12, "w", "t", None)], "id long, name string, site string, address string")
    pairs = spark.createDataFrame([(1, 10, 0.1), (3, 12, 0.2)], "left_id long, right_id long, km double")
    rule = (F.concat("l.site", F.lit("/"), "r.site"), F.col("l.site"), F.lit("only"))
    out = matching.merged_list(left, right, pairs, "id", {"name": "left", "address": "right"}, ("B", "L", "R"), {"both_sites": rule})
    assert out.columns == ["left_id", "right_id", "km", "both_sites", "name", "address", "source"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        (1, 10, 0.1, "/s", "a", "addr", "B"), (3, 12, 0.2, "y/t", "w", "", "B"), (2, None, None, "x", "b", "", "L"), (None, 11, None, "only", "", "here", "R"),
    ], key=repr)
    assert matching.merged_list(left, right, pairs.where("false"), "id", {"name": "left"}).count() == 6
