"""What the operators share: tables, null-safe joins and the words of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is not inlined again by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def md5_number(value: Column, digits: int) -> Column:
    """The first hex digits (15 at most) of an md5 as a number; any SQL engine can follow it."""
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("bigint")


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls matching nulls; the keys come out once."""
    names = {k: f"_r_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for k, r in names.items():
        condition = condition & left[k].eqNullSafe(other[r])
    return left.join(other, condition, how).drop(*names.values())


BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def small_batches(df: DataFrame) -> None:
    """Texts reach Python a thousand rows at a time, as ten thousand whole documents fill a worker.

    Spark reads this setting when the plan runs, so it is put into the session; a smaller one stays.
    """
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_CONF)) > BATCH_ROWS:
        conf.set(BATCH_CONF, str(BATCH_ROWS))
