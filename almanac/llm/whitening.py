"""Whitening components of a table of vectors by shifted CholeskyQR.

The centred rows A of the fit list are never decomposed as a whole and no covariance is diagonalised: a pass over
the rows adds up the Gram matrix of what the triangular solves so far have made of them, its Cholesky factor gives the
next solve, and the factors are composed to A = Q R.  The first factor is shifted, so that it exists however close to
singular A is; two more passes make Q orthogonal to rounding.  The singular values and right vectors of the small R are
those of A, without the loss of half the digits that forming the covariance costs.

Gram matrices are added up in a tree over the tasks; each has the size of a dimension squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.vectors import matrix, whole
from almanac.session import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
PASSES = 3
LARGEST = 2.0**40  # components of this size stop the job
LEAST_SHARE = 1e-10  # eigenvalues below this share of the largest are taken as zero
TREE_DEPTH = 3

SCHEMA = (
    "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)


@dataclass(frozen=True)
class Centre:
    """Number of vectors and exact sums, held as quotient and rest by the number: x - S/n = (x - quotient) - rest/n."""

    n: int
    quotient: np.ndarray
    rest: np.ndarray

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient).astype(float) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2 over the dimensions, null beyond 64 bits (arithmetic modulo 2^64 is exact below)."""
        about = (self.rows(x) ** 2).sum(axis=1) * float(self.n) ** 2
        with np.errstate(over="ignore"):
            exact = ((np.int64(self.n) * (x - self.quotient) - self.rest) ** 2).sum(axis=1)
        return [int(e) if a < 2.0**63 * (1 - 1e-6) else None for e, a in zip(exact, about, strict=True)]


def quantised(kept: DataFrame) -> DataFrame:
    """vec_id and x = floor(64 c) + 1000000 as longs."""
    whole_number = lambda v: F.when(F.abs(v) < LARGEST, F.floor(v * SCALE) + OFFSET).otherwise(
        F.raise_error(F.lit(f"whitening: a component is {LARGEST:.0f} or larger")).cast("bigint")
    )
    return kept.select("vec_id", F.transform("embedding", whole_number).alias("x"))


def _summed(rows: DataFrame, dim: int, of) -> list[np.ndarray]:
    """Sums of the arrays that ``of`` makes of a block of rows, added up in a tree over the tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(matrix(batch.column(0), dim))
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["part"])

    def loaded(row):
        import pickle

        return pickle.loads(row[0])

    parts: RDD = rows.select("x").mapInArrow(task, "part binary").rdd.map(loaded)
    return parts.treeReduce(lambda a, b: [v + w for v, w in zip(a, b, strict=True)], depth=TREE_DEPTH)


def forward_solve(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """A R1^-1 R2^-1 ...: for every upper triangular factor, solve Q R = A column by column."""
    for r in factors:
        q = np.empty_like(a)
        for j in range(r.shape[0]):
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        a = q
    return a


def cholesky(gram: np.ndarray, shifted: bool) -> np.ndarray:
    """Upper factor of the Gram matrix, with a shift of a few roundings of its norm where asked or needed."""
    d = len(gram)
    shift = 11 * d * (d + 1) * np.finfo(float).eps * float(np.trace(gram))
    add = shift if shifted else 0.0
    while True:
        try:
            return np.linalg.cholesky(gram + add * np.eye(d)).T
        except np.linalg.LinAlgError:  # not positive definite to rounding: a direction without spread
            add = max(shift, 10 * add)


def centre(fit_list: DataFrame, dim: int) -> Centre:
    """Exact number and sums; sums leave a block as Python integers, so they cannot overflow."""
    n, sums = _summed(fit_list, dim, lambda x: [np.array(len(x), object), x.astype(np.int64).sum(axis=0).astype(object)])
    quotient = [int(s) // int(n) for s in sums]
    rest = [int(s) - q * int(n) for s, q in zip(sums, quotient, strict=True)]
    return Centre(int(n), np.array(quotient, np.int64), np.array(rest, np.int64))


def triangular(fit_list: DataFrame, dim: int, middle: Centre, passes: int = PASSES) -> np.ndarray:
    """R of the centred rows A = Q R, composed of the factors of all passes; all zero without spread."""
    factors: list[np.ndarray] = []
    total = np.eye(dim)
    for n in range(passes):
        held = list(factors)

        def gram(x: np.ndarray, held: list[np.ndarray] = held) -> list[np.ndarray]:
            q = forward_solve(middle.rows(x), held)
            return [q.T @ q]

        (g,) = _summed(fit_list, dim, gram)
        if not np.trace(g) > 0:
            return np.zeros((dim, dim))
        factors.append(cholesky(g, shifted=n == 0))
        total = factors[-1] @ total
    return total


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per kept row of (vec_id, embedding) and component, as ``SCHEMA`` names them.

    Rows whose vector is null, holds null or non-finite components or has not the table's length (``vectors.whole``)
    are left out; repeated vectors count once in the fit list but each of their rows comes out, null ids too.
    Directions without spread have no component, so a table of one distinct vector, of vectors without a component, or
    without rows gives no rows.  A deviation beyond 64 bits is null.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = SCHEMA.format(dict(vectors.dtypes)["vec_id"])
    nothing = spark.createDataFrame([], schema)
    kept, dim = whole(vectors)
    if not dim:
        return nothing
    rows = quantised(kept)
    fit_list = materialise(rows.select("x").distinct(), "fit_list")
    middle = centre(fit_list, dim)
    r = triangular(fit_list, dim, middle)
    _, sizes, right = np.linalg.svd(r)
    number = int((sizes**2 > LEAST_SHARE * sizes[0] ** 2).sum()) if sizes[0] > 0 else 0
    number = min(number, components)
    if not number:
        return nothing
    project = right[:number].T * (np.sqrt(middle.n) / sizes[:number])  # over the roots of the eigenvalues
    explained = sizes[:number] ** 2 / float((r**2).sum())

    def moments(x: np.ndarray) -> list[np.ndarray]:
        w = middle.rows(x) @ project
        return [w.sum(axis=0), w.T @ w]

    total, products = _summed(fit_list, dim, moments)
    mean = total / middle.n
    identity_error = float(np.abs(products / middle.n - np.outer(mean, mean) - np.eye(number)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                x = matrix(part.column(1), dim)
                m = len(x)
                times = pa.array(np.repeat(np.arange(m), number))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(times),
                        pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * number, middle.n, np.int64)),
                        pa.array(middle.deviations(x), pa.int64()).take(times),
                        pa.array((middle.rows(x) @ project).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * number, identity_error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(out, schema)
