"""Keyed tables in hash buckets: an epoch reads and writes only the buckets its keys fall into.

Every bucket has one current snapshot, and a manifest per epoch says which epoch wrote it.  An epoch writes new snapshots
of the buckets it touches and a new manifest; nothing that a reader holds is changed.  An epoch that is repeated after
a failure starts from the manifest before it, so it gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class BucketTable:
    """Rows by key; ``by`` (the keys or some of them) decide the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.by, self.buckets = spark, path, schema, list(by), buckets
        self.columns = spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: at most as many numbers as the table has buckets."""
        return sorted(r["_b"] for r in rows.select(self.bucket().alias("_b")).distinct().collect())

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """Epoch of the current snapshot of each bucket, as of the last epoch (before the given one)."""
        try:
            found = self.spark.read.schema("bucket int, version int, epoch int").parquet(f"{self.path}/manifest")
        except AnalysisException:  # nothing written yet
            return {}
        found = found if before is None else found.where(F.col("epoch") < before)
        last = found.select(F.max("epoch")).first()[0]
        if last is None:
            return {}
        rows = found.where((F.col("epoch") == last) & (F.col("bucket") >= 0)).collect()  # a row per bucket
        return {r["bucket"]: r["version"] for r in rows}

    def read(self, buckets: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
        """The current rows (before an epoch), of some buckets only: other buckets' files are not opened."""
        held = {b: v for b, v in self.manifest(before).items() if buckets is None or b in set(buckets)}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.path}/rows/_epoch={v}/_bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def update(self, epoch: int, changes: DataFrame, merge: Merge) -> None:
        """Merge changes into the buckets they touch: ``merge(rows of these buckets, changes)`` gives their new rows."""
        before = self.manifest(epoch)
        touched = self.touched(changes)
        new = merge(self.read(touched, epoch), changes).select(*self.columns, self.bucket().alias("_bucket"))
        at = f"{self.path}/rows/_epoch={epoch}"
        new.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)
        written = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(at).select("_bucket").distinct().collect() if touched else []
        now = {b: v for b, v in before.items() if b not in set(touched)} | {r["_bucket"]: epoch for r in written}
        # a row of no bucket, so that an epoch without changes has a manifest too
        rows = self.spark.createDataFrame([(-1, epoch), *now.items()], "bucket int, version int").coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/manifest/epoch={epoch}")


def replace_rows(keys: Sequence[str]) -> Merge:
    """Changes take the place of rows of equal keys (nulls equal)."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        named = new.select(*keys).distinct().withColumnsRenamed({k: f"_n_{k}" for k in keys})
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys])
        return old.join(named, same, "left_anti").unionByName(new.select(*old.columns))

    return merge
