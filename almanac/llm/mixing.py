"""Mixing sources to target weights by thresholds on a hash, found on nested histograms.

Every document has a 60-bit hash of its id.  A source that shall give ``rate`` times its words takes
each document ``floor(rate)`` times and once more where the hash lies under a threshold.  The
threshold comes from sums of sizes by source and hash bucket: the bucket in which the budget ends is
the only one that is cut finer, level by level, so nothing is sorted and a source with a third of all
rows is pre-aggregated before the shuffle.  Larger budgets keep what smaller ones took.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.common import WORD, md5_number, same
from almanac.session import materialise

HEX, LEVEL, LEVELS = 15, 10, 3  # 60 bits of a digest; 10 bits a level; the rest is exact
SMALL = 100_000  # sources up to this number are sent to the rows, as counted; beyond it they are joined


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(key: str) -> Column:
    return md5_number(F.coalesce(F.col(key).cast("string"), F.lit("null")), HEX)


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes.  A target
    stops at ``most`` times its source's size and the excess is shared again: along the order of size by
    weight the sources that stop come first, which gives the level at which the others end in closed form.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.withColumn("_n", rank).withColumn("_w", F.get(cycle, F.col("_n") % len(weights)))
    capped = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    by_ratio, every = Window.orderBy("_ratio", "_n"), Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    summed = capped.select(
        "*",
        (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_left"),
        (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_weights"),
    )
    stops = F.col("_cap") * F.col("_weights") <= F.col("_left") * F.col("_w")
    marked = summed.withColumn("_stops", stops)
    level_here = F.struct("_ratio", "_n", (F.col("_left") / F.col("_weights")).alias("level"))
    level = F.coalesce(F.min(F.when(~F.col("_stops"), level_here)).over(every)["level"], F.lit(0.0))
    return marked.withColumn("target", F.when(F.col("_stops"), F.col("_cap")).otherwise(level * F.col("_w"))).select(
        "source", "source_size", "target"
    )


def thresholds(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """Per source: base (whole takes) and threshold; a hash under it takes once more.

    ``rows``: source, size, draw; ``aims``: source, source_size, target.  The document in which the budget ends
    is taken if that comes nearer to the target.  Rows with equal hash (equal ids) stand or fall together.
    """
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = aims.withColumn("base", base)
    edge = plan.select("source", (F.col("target") - F.col("base") * F.col("source_size")).alias("_rest"))
    part, keys = rows.select("source", "size", "draw"), ["source"]
    for level in range(LEVELS):
        bucket = f"_b{level}"
        part = part.withColumn(bucket, F.shiftright("draw", 4 * HEX - LEVEL * (level + 1)).cast("int"))
        edge, part, keys = _edge(part, edge, keys, bucket)
    hashes = same(part.groupBy(*keys, "draw").agg(F.sum("size").alias("_size")), edge, keys)
    upto = Window.partitionBy(*keys).orderBy("draw")
    summed = hashes.withColumn("_after", F.sum("_size").over(upto)).where(F.col("_after") > F.col("_rest"))
    first = summed.groupBy("source").agg(F.min_by(F.struct("draw", "_size", "_after", "_rest"), "draw").alias("x"))
    over, under = F.col("x._after") - F.col("x._rest"), F.col("x._rest") - (F.col("x._after") - F.col("x._size"))
    cut = first.select("source", (F.col("x.draw") + F.when(over < under, 1).otherwise(0)).alias("threshold"))
    return same(plan, cut, ["source"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0)))


def _edge(part: DataFrame, edge: DataFrame, keys: list[str], bucket: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The bucket in which each budget ends, what is left of the budget there, and that bucket's rows."""
    sums = part.groupBy(*keys, bucket).agg(F.sum("size").alias("_size"))
    upto = Window.partitionBy(*keys).orderBy(bucket)
    placed = same(sums, edge, keys).withColumn("_after", F.sum("_size").over(upto))
    ends = placed.where(F.col("_after") > F.col("_rest")).groupBy(*keys)
    found = ends.agg(F.min_by(F.struct(bucket, (F.col("_rest") - F.col("_after") + F.col("_size")).alias("_rest")), bucket).alias("x"))
    written = materialise(found.select(*keys, f"x.{bucket}", "x._rest"), "edge")
    inside = same(part, _sent(written.drop("_rest")), [*keys, bucket])
    return written, inside, [*keys, bucket]


def _sent(small: DataFrame) -> DataFrame:
    """One narrow row per source: sent to the rows if there are few, so that a hot source does not move."""
    return F.broadcast(small) if small.count() <= SMALL else small


def takes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``takes`` (how often each row is taken), source_size and target."""
    aimed = same(rows, _sent(materialise(plan, "mix")), ["source"])
    return aimed.withColumn("takes", F.col("base") + (F.col("draw") < F.col("threshold")).cast("int")).drop("base", "threshold")


def plan_mix(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    return thresholds(rows, targets(sizes, weights, share, most))


def sized(docs: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, source, size in words (null text: 0), draw."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw("doc_id").alias("draw"))


def mix_report(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken.

    Empty texts have size 0 and are taken as often as their source says, at no words.  Equal ids
    share a draw.  A source without words has target 0; a null source is one of its own.
    """
    rows = materialise(sized(docs), "sized")
    mixed = takes(rows, plan_mix(rows))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("takes")).alias("taken"), "source", "takes")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents with the columns of ``docs``, whatever their names: a row comes once per take."""
    rows = materialise(sized(docs), "sized")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "source", draw("doc_id").alias("draw"))
    taken = takes(packed, plan_mix(rows)).where(F.col("takes") > 0)
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("takes"))).alias("copy")).select("doc.*")
