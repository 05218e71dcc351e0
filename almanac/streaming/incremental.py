"""Resumable ingestion as Structured Streaming: new files in, keyed epochs out.

The checkpoint is the list of files already seen; an epoch repeated after a failure
reads the state before it and writes the same folders again, so each page is taken exactly once.
State lies in hash buckets, and an epoch opens only the buckets of its own keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators import text
from almanac.operators.upsert import first_per_key, last_per_key
from almanac.session import materialise, scratch_path
from almanac.sources.buckets import BucketTable, replace_rows
from almanac.sources.snapshots import EpochTable


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all waiting files in epochs, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def file_stream(spark: SparkSession, path: str, schema: str, files_per_epoch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_epoch).parquet(path)


def new_ids(batch: DataFrame, epoch: int, key: str, order: Sequence[str], seen: BucketTable, keep_epochs: int | None = None) -> DataFrame:
    """The batch's first row (by ``order``) of every id not seen before; the ids are put down as seen.

    ``seen`` has the id and the ``epoch`` that last met it.  With ``keep_epochs`` an id not met for so many epochs is
    forgotten, which bounds the state; its next arrival counts as new.
    """
    first = materialise(first_per_key(batch.where(F.col(key).isNotNull()), [key], order), "arrived")
    known = seen.read(seen.touched(first), epoch)
    alive = known if keep_epochs is None else known.where(F.col("epoch") >= epoch - keep_epochs)
    fresh = materialise(first.join(alive.select(key), key, "left_anti"), "fresh")

    def merge(_: DataFrame, met: DataFrame) -> DataFrame:
        kept = alive.join(met.select(key), key, "left_anti").select(*seen.columns)
        return kept.unionByName(met.select(*seen.columns))

    seen.update(epoch, first.select(key).withColumn("epoch", F.lit(epoch)), merge)
    return fresh


def ingest_chunks(
    pages: DataFrame, key: str, body: str, table: EpochTable, seen: BucketTable, checkpoint: str, size: int = text.CHUNK_CHARS
) -> DataFrame:
    """Cut newly arrived pages into chunks; pages whose key is already stored are left alone.

    Of versions that arrive together the smallest by content is taken.  A page without a key is not stored.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c != key]
        table.write(epoch, text.fixed_chunks(new_ids(batch, epoch, key, rest, seen), key, body, size))

    run_available(pages, each, checkpoint)
    return table.history().drop("epoch")


def seen_once(
    stream: DataFrame, key: str, table: EpochTable, seen: BucketTable, checkpoint: str, keep_epochs: int | None = None
) -> DataFrame:
    """Keep the first arrival of each id across all epochs; of rows that arrive together the smallest by content."""

    def each(batch: DataFrame, epoch: int) -> None:
        table.write(epoch, new_ids(batch, epoch, key, [c for c in batch.columns if c != key], seen, keep_epochs))

    run_available(stream, each, checkpoint)
    return table.history().drop("epoch")


COUNTS = ("pages_with_hits", "total_pages", "spans")


def rolling_site_totals(
    pages: DataFrame, page: str, site: str, body: str, order: str, lexicon: str, parts: BucketTable, totals: BucketTable, checkpoint: str
) -> DataFrame:
    """Per-site rollup kept up to date, as if each page were there in its last version (largest ``order``) only.

    ``parts`` holds what each page contributes.  A page that arrives again takes its old counts back from the site it
    was on: the totals get signed differences.  A version older than the one held changes nothing.
    """
    keys = [page]

    def each(batch: DataFrame, epoch: int) -> None:
        hits = text.span_count(F.col(body), lexicon)
        counted = batch.select(page, site, order, hits.cast("bigint").alias("spans"))
        counted = counted.withColumn("pages_with_hits", (F.col("spans") > 0).cast("bigint")).withColumn("total_pages", F.lit(1).cast("bigint"))
        latest = materialise(last_per_key(counted, keys, [order, site, "spans"]).select(*parts.columns), "latest")
        held = parts.read(parts.touched(latest), epoch).select(*[F.col(c).alias(f"_o_{c}") for c in parts.columns])
        both = latest.join(held, F.col(page).eqNullSafe(F.col(f"_o_{page}")), "left")
        newer = F.col(f"_o_{order}").isNull() | (F.col(order) >= F.col(f"_o_{order}"))
        taken = materialise(both.where(newer), "taken")
        changed = taken.select(*parts.columns)
        more = changed.select(site, *COUNTS)
        less = taken.where(F.col("_o_total_pages").isNotNull()).select(F.col(f"_o_{site}").alias(site), *[(-F.col(f"_o_{c}")).alias(c) for c in COUNTS])
        deltas = materialise(more.unionByName(less).groupBy(site).agg(*[F.sum(c).alias(c) for c in COUNTS]), "deltas")
        parts.update(epoch, changed, replace_rows(keys))
        add = lambda old, new: old.unionByName(new.select(*old.columns)).groupBy(site).agg(*[F.sum(c).alias(c) for c in COUNTS])
        totals.update(epoch, deltas, add)

    run_available(pages, each, checkpoint)
    out = totals.read().where("total_pages <> 0")
    return out.withColumn("hit_rate", text.hit_rate(F.col("pages_with_hits"), F.col("total_pages")))


def judge_stream(
    work: DataFrame, key: str, body: str, scorer: Callable[[int, str], str], table: BucketTable, pending: EpochTable, checkpoint: str,
    retries: int = 1,
) -> DataFrame:
    """Score arriving items; those that failed come up again in the next epoch, beside the new ones.

    ``table`` has the key, label, error, attempts and judged_at (epoch of the last attempt); an item it holds is not taken
    from an arrival again.  ``pending`` has the key, the body and the attempts of what failed, a list of its own for every
    epoch, so an epoch reads the failures of the last one and not the whole table.  What still has an error when no more
    items arrive stays in both (``errored``), and is taken up when the next ones do.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        waiting = pending.history().where(F.col("epoch") == epoch - 1).select(key, body, "attempts")
        arrived = first_per_key(batch.select(key, body).where(F.col(key).isNotNull()), [key], [body])
        held = table.read(table.touched(arrived), epoch).select(key)
        new = arrived.join(held, key, "left_anti").withColumn("attempts", F.lit(0))
        todo = materialise(new.unionByName(waiting.select(*new.columns)), "pending")
        scored = text.score_rows(todo, body, lambda t: scorer(epoch, t), "rule", retries=retries)
        told = scored.withColumn("attempts", F.col("attempts") + 1).withColumn("judged_at", F.lit(epoch))
        told = materialise(told, "judged")
        table.update(epoch, told.select(*table.columns), replace_rows([key]))
        pending.write(epoch, errored(told).select(key, body, "attempts"))

    run_available(work, each, checkpoint)
    return table.read()


def errored(results: DataFrame, error: str = "error") -> DataFrame:
    """The rows without a successful result."""
    return results.where(F.coalesce(F.col(error), F.lit("")) != "")


def new_table(spark: SparkSession, name: str, schema: str, keys: list[str]) -> tuple[EpochTable, str]:
    """An empty epoch table and a checkpoint folder below the shared folder."""
    return EpochTable(spark, scratch_path(spark, name), schema, keys), scratch_path(spark, f"{name}-checkpoint")


def new_buckets(spark: SparkSession, name: str, schema: str, by: Sequence[str], buckets: int = 64) -> BucketTable:
    """An empty bucket table below the shared folder."""
    return BucketTable(spark, scratch_path(spark, name), schema, by, buckets)
