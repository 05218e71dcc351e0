"""Sharding by a weighted hash tree: regions hold racks, racks hold shards.

At each level every child draws ``-ln(u) / weight`` from a hash of the id and of the child's
path, and the smallest draw wins, so a child gets its share of the weight and a changed weight
only moves ids to or from that child.  Weights of inner nodes are the sums of their shards.
A shard added in a region of its own changes no weight below the root's other children: ids
move into it and nowhere else.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import md5_number, same
from almanac.session import materialise

HEX = 13  # 52 bits of a digest, exact in a double


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, regions: int = 2, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """The first shards fill the given regions; each one beyond gets a region of its own."""
    full = regions * racks * per_rack
    inside = [Leaf(s // (racks * per_rack), s // per_rack % racks, s) for s in range(min(shards, full))]
    return inside + [Leaf(regions + s - full, 0, s) for s in range(full, shards)]


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (md5_number(F.concat(key, F.lit(f"/{path}")), HEX) + F.lit(0.5)) / F.lit(float(1 << (4 * HEX)))
    return -F.ln(u) / F.lit(float(weight))


def _winner(key: Column, children: Sequence[tuple[int, str, float]]) -> Column:
    """Number of the child with the smallest draw, ties to the smaller number; no draw for an only child."""
    alive = [c for c in children if c[2] > 0]
    if len(alive) == 1:
        return F.lit(alive[0][0])
    draws = [F.struct(_draw(key, path, weight).alias("d"), F.lit(number).alias("n")) for number, path, weight in alive]
    return F.array_min(F.array(*draws))["n"]


def _by(parent: Column, options: dict[int, Column]) -> Column:
    out = None
    for number, column in options.items():
        out = F.when(parent == number, column) if out is None else out.when(parent == number, column)
    return out


def assign(df: DataFrame, key: str, leaves: Sequence[Leaf], out: str = "shard") -> DataFrame:
    """Adds ``out``: the shard of each row.  A null key is drawn like the text ``null``; equal keys stay together."""
    used = [leaf for leaf in leaves if leaf.weight > 0]
    if not used:
        raise ValueError("no shard has a weight")
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    regions = sorted({leaf.region for leaf in used})
    total = lambda part: float(sum(leaf.weight for leaf in part))
    in_region = {r: [leaf for leaf in used if leaf.region == r] for r in regions}
    region = _winner(k, [(r, f"{r}", total(in_region[r])) for r in regions])
    racks, shards = {}, {}
    for r, part in in_region.items():
        numbers = sorted({leaf.rack for leaf in part})
        in_rack = {n: [leaf for leaf in part if leaf.rack == n] for n in numbers}
        racks[r] = _winner(k, [(n, f"{r}/{n}", total(in_rack[n])) for n in numbers])
        shards[r] = _by(
            F.col("_rack"), {n: _winner(k, [(x.shard, f"{r}/{n}/{x.shard}", x.weight) for x in p]) for n, p in in_rack.items()}
        )
    down = df.withColumn("_region", region).withColumn("_rack", _by(F.col("_region"), racks))
    return down.withColumn(out, _by(F.col("_region"), shards).cast("int")).drop("_region", "_rack")


def slots(df: DataFrame, shard: str, order: str, bits: int, ties: Sequence[str], rows: int, per_task: int = 100_000) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, by ``order`` (a number under ``2 ** bits``) and ``ties``.

    A shard is numbered in ranges of ``order`` of about ``per_task`` rows, so its rows never meet in one
    task; only the sizes of the ranges are summed per shard.
    """
    ranges = 1 << max(0, math.ceil(math.log2(max(1, rows / per_task))))
    cut = df.withColumn("_range", F.shiftright(F.col(order), bits - int(math.log2(ranges))).cast("int"))
    inside = Window.partitionBy(shard, "_range").orderBy(order, *ties)
    earlier = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(shard, "_range").agg(F.count("*").alias("_rows"))
    starts = sizes.select(shard, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    placed = same(cut.withColumn("_n", F.row_number().over(inside)), starts, [shard, "_range"])
    return placed.withColumn("slot", F.col("_start") + F.col("_n") - 1).drop("_range", "_n", "_start")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Where each document goes, now and with one shard more: the text is read once, the rest works on narrow rows.

    Law ``key``: id and number of shards decide, so equal texts under different ids are not kept together.
    Rows of equal id share a shard; a null text counts one byte.  Ids that are null share a shard as well.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        md5_number(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), HEX).alias("_order"),
    )
    now = assign(narrow, "doc_id", topology(shards))
    written = materialise(assign(now, "doc_id", topology(shards + 1), "grown_shard"), "shards")
    numbered = slots(written, "shard", "_order", 4 * HEX, ["doc_id", "text_crc32", "size"], written.count())
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
