"""Exact nearest-neighbour joins that stay balanced on crowded places.

Queries and targets are laid along a space-filling curve in range partitions (slabs), and targets are cut there into
blocks of at most a few thousand distinct locations.  A query's distance to the targets beside it on the curve bounds
its answer.  Only the boxes of the slabs, as many as the root of the number of blocks, are on the driver: they say which
slabs reach into the bound, and a join with the frame of block boxes says which of their blocks do.  A visit compares one
block with one block of queries, so no task ever holds an unbounded group, no cell
emits all its pairs, and copies of one location are a single target.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.functions.geo import chord, haversine_km, unit_xyz
from almanac.session import join_counted, materialise

BLOCK, LEAST_BLOCK = 2_000, 32
QUERY_BLOCK = 20_000
SLAB_ROWS = 4_000_000  # of both sides


def _spread(v: Column, dims: int) -> Column:
    """Spread the low bits of ``v`` so that ``dims`` such values interleave."""
    steps = (
        ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
        if dims == 3
        else ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))
    )
    for shift, mask in steps:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def curve_key(coords: Sequence[Column], lo: float, hi: float) -> Column:
    """Position along the Z-order curve over the box [lo, hi]."""
    dims = len(coords)
    bits = 20 if dims == 3 else 30
    key = F.lit(0).cast("bigint")
    for i, c in enumerate(coords):
        cell = F.least(F.floor((c - lo) / (hi - lo) * float(2**bits)).cast("bigint"), F.lit(2**bits - 1))
        key = key.bitwiseOR(F.shiftleft(_spread(F.greatest(cell, F.lit(0).cast("bigint")), dims), i))
    return key


def block_rows(n: int) -> int:
    """Targets of a block: two thousand, fewer where that would make a few blocks only."""
    return min(BLOCK, max(LEAST_BLOCK, math.ceil(n / 16)))


def _laid(
    queries: DataFrame, targets: DataFrame, coords: Sequence[str], tails: Sequence[str], k: int, lo: float, hi: float, rule: str | None,
    block: int | None,
) -> DataFrame:
    """Both sides in order along the curve, written: coarse slab, block, and of queries a bound of their answer.

    A slab is a range partition, a block the next so many rows of one side in it.  The bound is the ``k``-th smallest
    distance to the targets that stand beside the query on the curve; infinity where there are too few.
    """
    c = [F.col(x) for x in coords]
    sizes = targets.select(F.lit(0).alias("_q")).unionByName(queries.select(F.lit(1).alias("_q"))).groupBy("_q").count().collect()
    n_targets, n_queries = (next((r["count"] for r in sizes if r["_q"] == side), 0) for side in (0, 1))
    size, most_queries = block or block_rows(n_targets), QUERY_BLOCK
    slabs = max(1, math.isqrt(math.ceil(n_targets / size)), math.ceil((n_targets + n_queries) / SLAB_ROWS))
    attr = ["attr"] if rule else []
    none = lambda df, column: F.lit(None).cast(df.schema[column].dataType)
    t = targets.select(
        F.lit(False).alias("_q"), F.col("id").alias("_t"), none(queries, "id").alias("_i"), *coords, *tails, *attr, curve_key(c, lo, hi).alias("_key")
    )
    q = queries.select(
        F.lit(True).alias("_q"), none(targets, "id").alias("_t"), F.col("id").alias("_i"), *coords,
        *[F.lit(None).cast("double").alias(x) for x in tails], *attr, curve_key(c, lo, hi).alias("_key"),
    )
    order = ["_key", "_q", "_t", "_i"]
    both = t.unionByName(q).repartitionByRange(slabs, *order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        seen_t = seen_q = 0
        beside = np.empty((0, len(coords)))  # the last k targets before this batch, and their attributes
        beside_attr = np.empty(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            is_query = batch.column("_q").to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(v).to_numpy(zero_copy_only=False) for v in coords], axis=1).astype(float)
            a = batch.column("attr").to_numpy(zero_copy_only=False) if rule else np.zeros(len(x))
            there = np.concatenate([beside, x[~is_query]])
            there_attr = np.concatenate([beside_attr, a[~is_query]])
            before = np.cumsum(~is_query)[is_query] + len(beside)
            bound = np.full(len(x), np.inf)
            at = before[:, None] + np.arange(-k, k)[None, :]
            inside = (at >= 0) & (at < len(there))
            at = np.where(inside, at, 0)
            if len(there) and at.size:
                d2 = ((there[at] - x[is_query][:, None, :]) ** 2).sum(axis=2)
                mine = a[is_query][:, None]
                if rule:
                    inside &= (there_attr[at] != mine) if rule == "other" else (there_attr[at] > mine)
                bound[is_query] = np.partition(np.where(inside, d2, np.inf), k - 1, axis=1)[:, k - 1]
            number_t, number_q = seen_t + np.cumsum(~is_query) - 1, seen_q + np.cumsum(is_query) - 1
            slot = np.where(is_query, number_q // most_queries, number_t // size)
            seen_t, seen_q = seen_t + int((~is_query).sum()), seen_q + int(is_query.sum())
            beside, beside_attr = there[-k:], there_attr[-k:]
            kept = [batch.column(n) for n in names]
            more = [pa.array(np.full(len(x), first, np.int64)), pa.array(first + slot.astype(np.int64)), pa.array(bound)]
            yield pa.RecordBatch.from_arrays([*kept, *more], [*names, "_slab", "_block", "_bound"])

    names = [n for n in both.columns if n != "_key"]
    schema = ", ".join(f"`{n}` {both.schema[n].dataType.simpleString()}" for n in names)
    return materialise(both.mapInArrow(number, f"{schema}, _slab bigint, _block bigint, _bound double"), "laid")


def _block_search(coords: Sequence[str], k: int, max_dist: float, rule: str | None, segments: bool):
    """The ``k`` best targets of one block for each query of one query block."""
    limit2 = max_dist * max_dist * (1 + 1e-9)

    def best(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        parts = []
        ts = ts.sort_values("id")
        tid, tx = ts["id"].to_numpy(), [ts[x].to_numpy(float) for x in coords]
        way = [ts[f"{x}2"].to_numpy(float) - v for x, v in zip(coords, tx)] if segments else []
        length2 = sum(w * w for w in way)[None, :] if segments else None
        rows = max(1, 1_000_000 // max(1, len(ts)))
        for at in range(0, len(qs), rows):
            b = qs.iloc[at : at + rows]
            d2 = np.zeros((len(b), len(ts)))
            along = np.zeros_like(d2) if segments else None
            if segments:
                for d, x in enumerate(coords):
                    along += (b[x].to_numpy(float)[:, None] - tx[d][None, :]) * way[d][None, :]
                along = np.clip(np.divide(along, length2, out=np.zeros_like(along), where=length2 > 0), 0, 1)
            for d, x in enumerate(coords):
                near = tx[d][None, :] + along * way[d][None, :] if segments else tx[d][None, :]
                d2 += (b[x].to_numpy(float)[:, None] - near) ** 2
            if rule:
                a, ta = b["attr"].to_numpy()[:, None], ts["attr"].to_numpy()[None, :]
                d2[~((ta != a) if rule == "other" else (ta > a))] = np.inf
            d2[d2 > limit2] = np.inf
            take = min(k, len(ts))
            # A stable sort keeps the smaller id first among equal distances.
            order = np.argsort(d2, axis=1, kind="stable")[:, :take]
            picked = np.take_along_axis(d2, order, axis=1)
            i, j = np.nonzero(np.isfinite(picked))
            parts.append(
                pd.DataFrame({"id": b["id"].to_numpy()[i], "other": tid[order[i, j]], "d2": picked[i, j]})
            )
        return pd.concat(parts) if parts else pd.DataFrame({"id": [], "other": [], "d2": []})

    return best


def _top(grouped, best, queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    id_type = queries.schema["id"].dataType.simpleString()
    other_type = targets.schema["id"].dataType.simpleString()
    found = grouped.applyInPandas(best, f"id {id_type}, other {other_type}, d2 double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    coords: Sequence[str],
    k: int,
    lo: float,
    hi: float,
    max_dist: float = math.inf,
    rule: str | None = None,
    segments: bool = False,
    block: int | None = None,
) -> DataFrame:
    """The ``k`` nearest targets of each query: (id, other, d2, rank), ties by target id.

    Both sides have ``id`` and the coordinate columns; target locations should be
    distinct.  ``rule`` restricts targets by the ``attr`` column of both sides:
    ``"other"`` wants a different value, ``"above"`` a larger one than the query's.
    With ``segments`` a target is the straight line from its coordinates to those
    in the columns of the same name with a 2.
    """
    tails = [f"{x}2" for x in coords] if segments else []
    laid = _laid(queries, targets, coords, tails, k, lo, hi, rule, block)
    t = laid.where("NOT _q").select(F.col("_t").alias("id"), *coords, *tails, *(["attr"] if rule else []), "_slab", F.col("_block").alias("_tb"))
    q = laid.where("_q").select(F.col("_i").alias("id"), *coords, *(["attr"] if rule else []), F.col("_block").alias("_qb"), "_bound")
    least, most = [], []
    for x in coords:
        less, more = (F.least(x, f"{x}2"), F.greatest(x, f"{x}2")) if segments else (F.col(x), F.col(x))
        least.append(F.min(less).alias(f"lo_{x}"))
        most.append(F.max(more).alias(f"hi_{x}"))
    if rule:
        least.append(F.min("attr").alias("lo_attr"))
        most.append(F.max("attr").alias("hi_attr"))
    boxes = t.groupBy("_slab", "_tb").agg(F.count("*").alias("n"), *least, *most)  # a scan of the written table, read twice
    up = [F.min(c).alias(c) for c in boxes.columns if c.startswith("lo_")] + [F.max(c).alias(c) for c in boxes.columns if c.startswith("hi_")]
    slabs = boxes.groupBy("_slab").agg(F.sum("n").alias("n"), *up).toPandas()  # the root of the number of blocks
    id_type = queries.schema["id"].dataType.simpleString()
    other_type = targets.schema["id"].dataType.simpleString()
    if slabs.empty:
        return queries.sparkSession.createDataFrame([], f"id {id_type}, other {other_type}, d2 double, rank int")
    limit2, slack = max_dist * max_dist * (1 + 1e-9), 1 + 1e-12
    routed = _routed(q, slabs, coords, k, rule, limit2)
    near2 = F.lit(0.0)
    for x in coords:
        near2 = near2 + F.pow(F.greatest(F.col(f"lo_{x}") - F.col(x), F.col(x) - F.col(f"hi_{x}"), F.lit(0.0)), 2)
    visits = routed.join(boxes, "_slab").where(near2 <= F.least(F.col("_bound") * slack, F.lit(limit2)))
    if rule:
        possible = ((F.col("lo_attr") != F.col("attr")) | (F.col("hi_attr") != F.col("attr"))) if rule == "other" else F.col("hi_attr") > F.col("attr")
        visits = visits.where(possible)
    visits = materialise(visits.select("id", *coords, *(["attr"] if rule else []), "_qb", "_tb"), "visits")
    wanted = visits.select(F.col("_tb").alias("_wt"), F.col("_qb").alias("_wq")).distinct()
    copies = t.drop("_slab").join(wanted, F.col("_tb") == F.col("_wt"))
    best = _block_search(coords, k, max_dist, rule, segments)
    return _top(visits.groupBy("_tb", "_qb").cogroup(copies.groupBy("_wt", "_wq")), best, queries, targets, k)


def _routed(q: DataFrame, slabs: pd.DataFrame, coords: Sequence[str], k: int, rule: str | None, limit2: float) -> DataFrame:
    """The queries once per slab they have to look into (``_slab``), with the bound that the slabs' boxes may lower."""
    low = np.stack([slabs[f"lo_{x}"].to_numpy(float) for x in coords])
    high = np.stack([slabs[f"hi_{x}"].to_numpy(float) for x in coords])
    sizes, names = slabs["n"].to_numpy(), slabs["_slab"].to_numpy()
    attr_lo, attr_hi = (slabs["lo_attr"].to_numpy(), slabs["hi_attr"].to_numpy()) if rule else (None, None)
    step = max(1, 2_000_000 // len(names))

    def reach(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        near2 = np.zeros((b.num_rows, len(names)))
        far2 = np.zeros_like(near2)
        for d, x in enumerate(coords):
            v = b.column(x).to_numpy(zero_copy_only=False)[:, None]
            near2 += np.maximum(np.maximum(low[d] - v, v - high[d]), 0) ** 2
            far2 += np.maximum(np.abs(v - low[d]), np.abs(high[d] - v)) ** 2
        possible = np.ones_like(near2, dtype=bool)
        if rule:
            a = b.column("attr").to_numpy(zero_copy_only=False)[:, None]
            if rule == "other":
                possible = (attr_lo != a) | (attr_hi != a)
                certain = (a < attr_lo) | (a > attr_hi)
            else:
                possible, certain = attr_hi > a, attr_lo > a
            far2 = np.where(certain, far2, np.inf)
        order = np.argsort(far2, axis=1)
        enough = np.cumsum(sizes[order], axis=1) >= k
        far = np.take_along_axis(far2, order, axis=1)[np.arange(b.num_rows), enough.argmax(axis=1)]
        bound = np.minimum(b.column("_bound").to_numpy(zero_copy_only=False), np.where(enough.any(axis=1), far, np.inf))
        return possible & (near2 <= np.minimum(bound * (1 + 1e-12), limit2)[:, None]), bound

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                looks, bound = reach(b)
                i, j = np.nonzero(looks)
                rows = b.take(pa.array(i))
                columns = [pa.array(bound[i]) if c == "_bound" else rows.column(c) for c in b.schema.names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(names[j])], [*b.schema.names, "_slab"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in q.schema.fields)
    return q.mapInArrow(route, f"{schema}, _slab bigint")


def locations(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """Distinct places with their smallest key as ``id``, the row count, and unit-sphere coordinates."""
    x, y, z = unit_xyz(F.col("lat"), F.col("lon"))
    return (
        df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        .groupBy(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
        .agg(F.min(key).alias("id"), F.count("*").alias("size"))
        .select("id", "size", "lat", "lon", x.alias("x"), y.alias("y"), z.alias("z"))
    )


def nearest_places(
    queries: DataFrame, targets: DataFrame, k: int, max_km: float | None = None, rule: str | None = None
) -> DataFrame:
    """``nearest`` on the sphere for frames made by ``locations``."""
    reach = math.inf if max_km is None else chord(max_km)
    return nearest(queries, targets, ["x", "y", "z"], k, -1.0, 1.0, reach, rule)


def knn_join(
    queries: DataFrame,
    targets: DataFrame,
    key: str,
    lat: str,
    lon: str,
    k: int,
    max_km: float | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """(key, neighbour, km, rank) of the ``k`` nearest targets, ties by target key."""
    want = k + 1 if exclude_self else k
    q_loc = materialise(locations(queries, key, lat, lon), "places")
    t_loc = q_loc if targets is queries else materialise(locations(targets, key, lat, lon), "places")
    pairs = nearest_places(q_loc, t_loc, want, max_km).select("id", "other")
    pairs = (
        pairs.join(q_loc.select(F.col("id"), F.col("lat").alias("_qlat"), F.col("lon").alias("_qlon")), "id")
        .join(t_loc.select(F.col("id").alias("other"), F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon")), "other")
        .withColumn("km", haversine_km(F.col("_qlat"), F.col("_qlon"), F.col("_tlat"), F.col("_tlon")))
    )
    at = Window.partitionBy("_tlat", "_tlon").orderBy("neighbour")
    members = (
        targets.select(F.col(key).alias("neighbour"), F.col(lat).cast("double").alias("_tlat"), F.col(lon).cast("double").alias("_tlon"))
        .withColumn("_nth", F.row_number().over(at))
        .where(F.col("_nth") <= want)
    )
    rows = queries.select(F.col(key), F.col(lat).cast("double").alias("_qlat"), F.col(lon).cast("double").alias("_qlon"))
    # Rank per query place first, so a crowded query place is ranked once and then only fanned out.
    place = Window.partitionBy("id").orderBy("km", "neighbour")
    ranked = (
        pairs.join(members, ["_tlat", "_tlon"])
        .withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= want)
        .select("_qlat", "_qlon", "neighbour", "km", "rank")
    )
    near = F.array_sort(F.collect_list(F.struct("rank", "neighbour", "km"))).alias("_near")
    ranked = ranked.groupBy("_qlat", "_qlon").agg(near)  # at most k + 1 neighbours per place
    out = join_counted(rows, ranked, ["_qlat", "_qlon"], "inner")
    kept = F.filter("_near", lambda n: n["neighbour"] != F.col(key)) if exclude_self else F.col("_near")
    out = out.select(key, F.posexplode(F.slice(kept, 1, k)).alias("_pos", "_n"))
    return out.select(key, "_n.neighbour", "_n.km", (F.col("_pos") + 1).alias("rank"))


def densify(edges: DataFrame, step_deg: float = 0.1) -> DataFrame:
    """Cut polygon edges (lat1, lon1, lat2, lon2) into pieces no longer than ``step_deg``."""
    longest = F.greatest(F.abs(F.col("lat2") - F.col("lat1")), F.abs(F.col("lon2") - F.col("lon1")))
    n = F.greatest(F.ceil(longest / step_deg), F.lit(1)).cast("int")
    i = F.col("_i")
    cut = edges.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a: str, b: str, t: Column) -> Column:
        return F.col(a) + (F.col(b) - F.col(a)) * t / F.col("_n")

    keep = [c for c in edges.columns if c not in ("lat1", "lon1", "lat2", "lon2")]
    return cut.select(
        *keep, at("lat1", "lat2", i).alias("lat1"), at("lon1", "lon2", i).alias("lon1"),
        at("lat1", "lat2", i + 1).alias("lat2"), at("lon1", "lon2", i + 1).alias("lon2"),
    )


def segment_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to the closest point of a short segment, found on a local plane."""
    shrink = F.cos(F.radians(lat))
    ax, ay = (lon1 - lon) * shrink, lat1 - lat
    dx, dy = (lon2 - lon1) * shrink, lat2 - lat1
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / len2))).otherwise(0.0)
    return haversine_km(lat, lon, lat1 + (lat2 - lat1) * t, lon1 + (lon2 - lon1) * t)


def nearest_edge_km(points: DataFrame, edges: DataFrame, key: str, lat: str, lon: str, step_deg: float = 0.1) -> DataFrame:
    """Distance to the nearest polygon edge per point (key, km).

    The nearest piece is found by straight-line distance on the unit sphere, on which a
    0.1 degree piece is within a few metres of its arc; its distance is then taken in place.
    """
    ends = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    pieces = densify(edges.select(*ends), step_deg).distinct()
    pieces = materialise(pieces.withColumn("id", F.concat_ws("|", *ends)), "pieces")
    head, tail = unit_xyz(ends[0], ends[1]), unit_xyz(ends[2], ends[3])
    t = pieces.select(
        "id", *[c.alias(n) for c, n in zip(head, "xyz")], *[c.alias(f"{n}2") for c, n in zip(tail, "xyz")]
    )
    places = materialise(locations(points, key, lat, lon), "places")
    hit = nearest(places, t, ["x", "y", "z"], 1, -1.0, 1.0, segments=True)
    at = places.select("id", "lat", "lon").join(hit.select("id", F.col("other")), "id")
    at = at.join(pieces.withColumnRenamed("id", "other"), "other")
    km = at.select("lat", "lon", segment_km(F.col("lat"), F.col("lon"), *ends).alias("km"))
    rows = points.select(key, F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return rows.join(km, ["lat", "lon"]).select(key, "km")
