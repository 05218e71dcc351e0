"""Row numbers, running totals and average ranks that do not funnel one group through one task.

Rows are cut along the order column at literal bounds, so (group, slice) is a pure
function of the row.  Totals inside a slice come from a window over that slice, totals
of earlier slices from a small table of slice sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from almanac.session import join_counted, materialise

SLICE_ROWS, LEAST_SLICE = 2_000_000, 1_000


def order_bounds(df: DataFrame, order: str, slice_rows: int | None = None) -> list[float]:
    """Cut points along ``order`` for slices of at most about ``SLICE_ROWS`` rows, sixteen slices if there are rows enough.

    Only numbers are cut; along any other order a group stays in one slice.
    """
    if not isinstance(df.schema[order].dataType, NumericType):
        return []
    n = df.count()
    parts = math.ceil(n / (slice_rows or min(SLICE_ROWS, max(LEAST_SLICE, math.ceil(n / 16)))))
    if parts <= 1:
        return []
    at = [i / parts for i in range(1, parts)]
    return sorted(set(df.agg(F.percentile_approx(F.col(order).cast("double"), at, 10 * parts)).first()[0] or []))


def slice_of(order: Column, bounds: Sequence[float]) -> Column:
    """How many of the sorted bounds lie below the value: by blocks of bounds first, then inside one block."""
    if not bounds:
        return F.lit(0)

    def literal(values: Sequence[float]) -> Column:  # one folded text, however many bounds there are
        return F.split(F.lit(",".join(repr(float(b)) for b in values)), ",").cast("array<double>")

    def below(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda b: b < order.cast("double")))

    step = math.isqrt(len(bounds) - 1) + 1
    ends = bounds[step - 1 :: step]
    first = below(literal(ends)) * step if ends else F.lit(0)
    return first + below(F.slice(literal(bounds), first + 1, F.lit(step)))


def running_total(
    df: DataFrame, by: Sequence[str], order: str, value: Column, out: str, bounds: Sequence[float], ties: Sequence[str] = ()
) -> DataFrame:
    """Adds ``out``: sum of ``value`` over the rows before this one in its group."""
    sliced = df.withColumn("_slice", slice_of(F.col(order), bounds)).withColumn("_v", value)
    within = Window.partitionBy(*by, "_slice").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(sliced.schema["_v"].dataType)
    if not bounds:
        return sliced.withColumn(out, F.coalesce(F.sum("_v").over(within), zero)).drop("_slice", "_v")
    # One row per group and slice: small, and at most as many rows per group as there are slices.
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*by, "_slice").agg(F.sum("_v").alias("_t"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_t").over(earlier), zero)).drop("_t")
    matching = F.lit(True)
    for c in (*by, "_slice"):
        matching = matching & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    here = F.coalesce(F.sum("_v").over(within), zero)
    inside = sliced.withColumn("_here", here)
    joined = inside.alias("a").join(before.alias("b"), matching)
    return joined.select("a.*", (F.col("_here") + F.col("b._before")).alias(out)).drop("_slice", "_v", "_here")


def row_number_within(
    df: DataFrame, by: Sequence[str], order: str, out: str = "nth", bounds: Sequence[float] | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """Row number per group in ``order``; a crowded group is numbered slice by slice."""
    cuts = order_bounds(df, order) if bounds is None else bounds
    numbered = running_total(df, by, order, F.lit(1).cast("bigint"), out, cuts, ties)
    return numbered.withColumn(out, F.col(out) + 1)


def _histogram(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Written once, as the bounds, the totals and the ranks all read it."""
    return materialise(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), "histogram")


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = (), bounds: Sequence[float] | None = None) -> DataFrame:
    """Average rank per distinct value: (by, value, n, rank).

    Ranks come from the histogram of distinct values, so a value shared by a third
    of all rows is one row, and continuous values are ranked slice by slice.
    """
    hist = _histogram(df, value, by)
    cuts = order_bounds(hist, value) if bounds is None else bounds
    keyed = hist if by else hist.withColumn("_all", F.lit(0))
    groups = list(by) or ["_all"]
    before = running_total(keyed, groups, value, F.col("n"), "_before", cuts)
    rank = F.col("_before") + (F.col("n") + 1) / 2
    return before.withColumn("rank", rank).select(*by, value, "n", "rank")


def with_average_rank(df: DataFrame, value: str, out: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Every row with the average rank of its value."""
    ranks = average_ranks(df, value, by).drop("n").withColumnRenamed("rank", out)
    return join_counted(df, ranks, [*by, value], "inner")


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles by linear interpolation, one column per name in ``shares``.

    Read off the running totals of the value histogram, so no task holds all values.
    """
    hist = _histogram(df, value, by)
    keyed = hist if by else hist.withColumn("_all", F.lit(0))
    groups = list(by) or ["_all"]
    placed = running_total(keyed, groups, value, F.col("n"), "_before", order_bounds(hist, value))
    totals = keyed.groupBy(*groups).agg(F.sum("n").alias("_total"))
    upto, x = F.col("_before") + F.col("n"), F.col(value).cast("double")
    out = []
    for name, p in shares.items():
        at = (F.col("_total") - 1) * p
        low = F.min(F.when(upto > F.floor(at), x))
        high = F.min(F.when(upto > F.ceil(at), x))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return placed.join(totals, groups).groupBy(*groups).agg(*out).drop("_all")


def later_minimum(df: DataFrame, order: str, value: str, out: str, bounds: Sequence[float]) -> DataFrame:
    """Adds ``out``: the smallest ``value`` among this row and all rows after it."""
    sliced = df.withColumn("_slice", slice_of(F.col(order), bounds))
    rest = Window.partitionBy("_slice").orderBy(F.desc(order)).rangeBetween(Window.unboundedPreceding, 0)
    later = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    tails = sliced.groupBy("_slice").agg(F.min(value).alias("_m")).withColumn("_later", F.min("_m").over(later))
    joined = sliced.withColumn("_here", F.min(value).over(rest)).join(tails.select("_slice", "_later"), "_slice")
    return joined.withColumn(out, F.least("_here", "_later")).drop("_slice", "_here", "_later")
