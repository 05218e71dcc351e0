"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(
    master: str = "local[8]", app: str = "almanac", shuffle_partitions: int = 8, shared: str | None = None
) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session in."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config(CHECKPOINT_CONF, shared or tempfile.mkdtemp(prefix="almanac-"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = context.getConf().get(CHECKPOINT_CONF) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="almanac-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never reused, so nothing is overwritten while read."""
    return os.path.join(shared_dir(spark), "almanac-scratch", f"{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage through a written table, so a lost executor re-reads files instead of recomputing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000


def join_counted(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """Join many or wide rows with a frame that is narrow and has one row per key.

    The narrow side is written and counted: up to ``BROADCAST_ROWS`` rows of together at most
    ``BROADCAST_BYTES`` it is sent to the rows, which then neither move nor pile up on a crowded
    key; beyond that the join is left to the optimizer and its skew handling.
    """
    side = materialise(small, "side")
    return big.join(F.broadcast(side) if _sendable(side) else side, on, how)


def _sendable(side: DataFrame) -> bool:
    if side.count() > BROADCAST_ROWS:
        return False
    written = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in side.columns]))))
    return (side.agg(written).first()[0] or 0) <= BROADCAST_BYTES


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a small scan whose few splits would leave cores idle.

    A large input has more splits than cores and is returned as it is, so no text is
    shuffled there.  For plain scans only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
