"""Which vectors of a table take part, shared by the operators on whole vector tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def whole(vectors: DataFrame) -> tuple[DataFrame, int | None]:
    """The rows whose embedding is not null and has finite components only, and the length of their embeddings.

    A table has one length; should it have several, the commonest (the longest of equally common ones) counts and
    rows of other lengths take no part.  Without any such row the length is None.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    kept = vectors.where(F.coalesce(finite, F.lit(False))).withColumn("embedding", x)
    lengths = kept.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if lengths is None:
        return kept, None
    return kept.where(F.size("embedding") == lengths["dim"]), lengths["dim"]


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column without nulls as a matrix; slices of larger batches included."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), dim) for c in chunks]
    return np.concatenate(parts) if parts else np.empty((0, dim))


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in 64 bits, or as Python integers where these do not do."""
    scaled = np.floor(x * float(scale))
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(scaled)
