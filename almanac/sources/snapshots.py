"""Tables kept as epochs: each run appends its own folder, readers resolve the latest row per key.

An epoch folder is written whole and may be written again, so a repeated run changes
nothing; nothing that is being read is ever overwritten.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.operators.upsert import last_per_key


class EpochTable:
    """Append-only folder of epochs with keyed reads."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    def write(self, epoch: int, rows: DataFrame) -> None:
        """Write one epoch; the same epoch again replaces itself."""
        rows.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def history(self, before: int | None = None) -> DataFrame:
        """All rows with their epoch, optionally only of earlier epochs."""
        try:
            out = self.spark.read.schema(f"{self.schema}, epoch int").option("basePath", self.path).parquet(self.path)
        except AnalysisException:  # nothing written yet
            out = self.spark.createDataFrame([], f"{self.schema}, epoch int")
        return out if before is None else out.where(F.col("epoch") < before)

    def current(self, before: int | None = None) -> DataFrame:
        """Latest row per key."""
        return last_per_key(self.history(before), self.keys, ["epoch"]).drop("epoch")

    def compact(self, path: str) -> EpochTable:
        """The current rows as epoch 0 of a new folder, to be swapped in by the caller."""
        table = EpochTable(self.spark, path, self.schema, self.keys)
        table.write(0, self.current())
        return table


def full_refresh(df: DataFrame, path: str) -> DataFrame:
    """Clear and rebuild a table in a folder of its own."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
