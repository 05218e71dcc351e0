"""Seeded samples, cohorts and splits; a row's place in a sample depends only on its key and the seed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.operators.ranks import row_number_within
from almanac.session import materialise


def shuffle_key(key: str | Column, seed: int = 42) -> Column:
    """Repeatable pseudo-random order; md5 so that other engines can follow it."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f":{seed}")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: the smallest shuffle keys (a distributed top-n)."""
    return df.withColumn("_r", shuffle_key(key, seed)).orderBy("_r", key).limit(n).drop("_r")


GROUP_LIMIT = 1_000  # up to so many rows wanted, Spark cuts each group before the shuffle; the rows are the same either way


def hash_order(key: str, seed: int) -> Column:
    """The leading 52 bits of the shuffle key as a number, for slicing."""
    return F.conv(F.substring(shuffle_key(key, seed), 1, 13), 16, 10).cast("bigint")


def seeded_sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per group; small samples are cut before the shuffle, large ones numbered slice by slice."""
    if n <= GROUP_LIMIT:
        order = Window.partitionBy(group).orderBy("_r", key)
        ranked = df.withColumn("_r", shuffle_key(key, seed)).withColumn("_n", F.row_number().over(order))
        return ranked.where(F.col("_n") <= n).drop("_r", "_n")
    return _first_shuffled(df, [group], key, n, seed)


def _first_shuffled(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` smallest shuffle keys of each group, numbered slice by slice; all of the key decides."""
    keyed = df.withColumn("_r", hash_order(key, seed)).withColumn("_full", shuffle_key(key, seed))
    numbered = row_number_within(keyed, by, "_r", "_n", ties=["_full", key])
    return numbered.where(F.col("_n") <= n).drop("_r", "_full", "_n")


def seeded_order(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """First ``n`` rows in shuffled order with their position."""
    top = seeded_sample(df, key, n, seed)
    order = Window.orderBy(shuffle_key(key, seed), key)  # at most n rows are left here
    return top.withColumn("position", F.row_number().over(order))


def report_order(df: DataFrame, priority: Column, *columns: str) -> DataFrame:
    """Report sort: rows with a blank last, then by priority, then by the columns, lower-cased text."""
    return df.orderBy(priority, *columns)


def numbered_report(df: DataFrame, priority: Column, *columns: str) -> DataFrame:
    """All rows with their ``position`` in report order.

    The sorted parts are written; a row's position is the size of the parts before its own
    plus its place in it, so no task holds the report.  The joined table has a row per part.
    """
    sorted_rows = report_order(df, priority, *columns).withColumn("_at", F.monotonically_increasing_id())
    rows = materialise(sorted_rows, "report").withColumn("_part", F.shiftright("_at", 33))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + 1
    return rows.join(F.broadcast(before), "_part").select(*df.columns, position.alias("position"))


def cohort_sample(
    cohorts: Sequence[tuple[str, DataFrame]], sampled: str, n: int, excluded: DataFrame, key: str, url: str, seed: int = 42
) -> DataFrame:
    """Union of cohorts, one of them sampled after exclusions; a row in several cohorts lists them all."""
    parts = []
    for rank, (name, df) in enumerate(cohorts):
        if name == sampled:
            ids = df.select(key).distinct().join(excluded.select(key), key, "left_anti")
            df = df.join(seeded_sample(ids, key, n, seed), key, "left_semi")
        parts.append(df.select(key, url).withColumn("_c", F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"))))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = F.array_join(F.transform(F.array_sort(F.collect_set("_c")), lambda c: c["name"]), "+")
    return rows.groupBy(key, url).agg(names.alias("cohorts"), F.min("_c.rank").alias("priority"))


def stratified_split(df: DataFrame, label: str, key: str, parts: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """Adds ``split``: shuffled rows of each class cut at the cumulative shares.

    The class is numbered slice by slice along the shuffle key, as a class may hold most rows.
    """
    numbered = row_number_within(df.withColumn("_o", hash_order(key, seed)), [label], "_o", "_n", ties=[key])
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    share, split = 0.0, None
    for name, part in parts[:-1]:
        share += part
        inside = F.col("_n") <= F.floor(F.col("_size") * share + 1e-9)
        split = F.when(inside, name) if split is None else split.when(inside, name)
    return numbered.join(sizes, label).withColumn("split", split.otherwise(parts[-1][0])).drop("_o", "_n", "_size")


def undersample(df: DataFrame, label: str, key: str, positive_share: float = 0.1, seed: int = 42) -> DataFrame:
    """All positives and so many shuffled negatives that positives make up ``positive_share``."""
    n_pos = df.where(F.col(label) == 1).count()
    keep = math.floor(n_pos * (1 - positive_share) / positive_share + 1e-9)
    positives = df.where(F.col(label) == 1)
    negatives = _first_shuffled(df.where(F.col(label) == 0), [], key, keep, seed)
    return positives.unionByName(negatives)
