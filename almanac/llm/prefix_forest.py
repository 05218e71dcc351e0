"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a string of sign bits of random projections, taken from the middle of a
sample of the vectors.  A block of vectors keeps, per tree, its strings sorted.  A query finds in every
tree the longest prefix that some vector shares with it and descends there; then it ascends in all
trees together, one bit at a time, until it has enough candidates.  From these it learns how often a
bit agrees between it and a near neighbour, which tells how short the shared prefixes may get before the
chance to miss such a neighbour in all trees is small; it ascends to there and measures all candidates.
Nothing caps the candidates of a query, so copies of one vector are all measured.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.session import materialise

TREES, BITS = 64, 32
BLOCK_ROWS = 16_384  # vectors of a block, on average
QUERY_ROWS = 2_048  # queries that visit a block together, on average
SAMPLE_ROWS = 10_000  # vectors that fix the middle of the projections
MISS = 0.05  # chance to miss a neighbour that is as near as the k-th one found


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part: not null, not zero, all components finite.

    Vectors of another length than the queries' never meet them, as blocks are made by length.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    some = F.exists(x, lambda v: F.coalesce(v != 0, F.lit(False)))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite & some, F.lit(False)))
    return kept.select("vec_id", x.alias("embedding"), F.size("embedding").alias("dim"))


def _planes(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, TREES * BITS))


def _keys(x: np.ndarray, middle: np.ndarray, seed: int) -> np.ndarray:
    """[tree, row] strings as numbers whose leading bit is the first of the string."""
    out = np.empty((TREES, len(x)), np.uint32)
    planes = _planes(x.shape[1], seed)
    for at in range(0, len(x), 4096):
        bits = (x[at : at + 4096] - middle) @ planes > 0
        packed = np.packbits(bits.reshape(-1, TREES, BITS), axis=2).view(">u4")[:, :, 0]
        out[:, at : at + 4096] = packed.T
    return out


class Forest:
    """Sorted strings of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, middle: np.ndarray, seed: int) -> None:
        self.ids, self.x, self.middle, self.seed = ids, x, middle, seed
        self.keys = _keys(x, middle, seed)
        self.order = np.argsort(self.keys, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.keys, self.order, axis=1).astype(np.int64)

    def _ranges(self, keys: np.ndarray, depth: int) -> list[tuple[int, int]]:
        """Per tree the rows whose strings share the first ``depth`` bits."""
        width = BITS - depth
        low = (keys.astype(np.int64) >> width) << width
        return [tuple(np.searchsorted(s, (a, a + (1 << width)))) for s, a in zip(self.sorted, low, strict=True)]

    def search(self, query_id: int, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the k nearest found; ``own`` are the query's strings."""
        enough = min(len(self.ids), 20 * k)
        place = np.array([np.searchsorted(s, v) for s, v in zip(self.sorted, own.astype(np.int64), strict=True)])
        beside = [self.sorted[np.arange(TREES), np.clip(place + d, 0, len(self.ids) - 1)] for d in (-1, 0)]
        shared = BITS - np.frexp(np.minimum(*[(b ^ own.astype(np.int64)) for b in beside]).astype(float))[1]
        depth = int(shared.max())  # descend: the longest prefix over all trees
        while True:
            rows = self._rows(own, depth)
            rows = rows[self.ids[rows] != query_id]
            if len(rows) >= enough or depth == 0:
                break
            depth -= 1  # ascend in all trees at once
        found, distance = self._measure(rows, q, k)
        if len(found) and depth:
            # share of equal bits between the query and the farthest of those found, over all trees
            differ = np.bitwise_count(self.keys[:, found[-3:]] ^ own[:, None]).sum(axis=0, dtype=np.int64)
            p = min(1 - 1e-9, 1 - float(differ.mean()) / (TREES * BITS))
            goal = 1 - MISS ** (1 / TREES)
            needed = int(math.log(goal) / math.log(p)) if len(found) == k and p > 0 else 0
            if needed < depth:
                rows = self._rows(own, max(0, needed))
                found, distance = self._measure(rows[self.ids[rows] != query_id], q, k)
        return self.ids[found], distance

    def _rows(self, own: np.ndarray, depth: int) -> np.ndarray:
        if depth <= 0:
            return np.arange(len(self.ids))
        seen = np.zeros(len(self.ids), bool)
        for order, (low, high) in zip(self.order, self._ranges(own, depth), strict=True):
            seen[order[low:high]] = True
        return np.flatnonzero(seen)

    def _measure(self, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest rows, ties to the smaller id, by the exact distance in double precision."""
        distance = np.empty(len(rows))
        for at in range(0, len(rows), 4096):
            distance[at : at + 4096] = np.sqrt(((self.x[rows[at : at + 4096]] - q) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[rows], distance))[:k]
        return rows[best], distance[best]


def _middles(vectors: DataFrame, seed: int, sample_rows: int) -> dict[int, np.ndarray]:
    """Mean of a bounded sample of the vectors, by length (few lengths: one row each)."""
    rows = max(1, vectors.count())
    draw = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000))
    sample = vectors.where(draw < max(1, round(1_000_000 * min(1.0, sample_rows / rows))))
    means = sample.select("dim", F.posexplode("embedding").alias("i", "v")).groupBy("dim", "i").agg(F.avg("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in means.collect():
        out.setdefault(r["dim"], np.zeros(r["dim"]))[r["i"]] = r["v"]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query (rows of ``vectors``' columns), nearest first.

    The vectors are dealt into blocks by a hash of their id and place; every query block visits every block,
    each visit gives k rows a query, and the best of these are merged.  A vector id that repeats is a candidate
    each time it occurs, but never of a query of that id; of queries with one id the first by content counts.
    """
    all_rows = materialise(usable(vectors), "vectors")
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = materialise(asked.withColumn("dim", F.size("embedding")), "queries")
    blocks = max(1, math.ceil(all_rows.count() / block_rows))
    query_blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))
    middles = _middles(all_rows, seed, SAMPLE_ROWS)
    deal = lambda n, s, *more: F.pmod(F.xxhash64("vec_id", *more, F.lit(s)), F.lit(n)).cast("int")
    left = all_rows.withColumn("block", deal(blocks, 1, F.col("embedding")))
    left = left.withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = asked.withColumn("visit", deal(query_blocks, 2)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    keys = ["dim", "block", "visit"]

    def visit(part: pa.Table, query: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not part.num_rows or not query.num_rows:
            return empty
        dim = part["dim"][0].as_py()
        flat = lambda t: t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        middle = middles.get(dim, np.zeros(dim))
        forest = Forest(part["vec_id"].to_numpy(), flat(part), middle, seed)
        asked_x = flat(query)
        strings = _keys(asked_x, middle, seed)
        out = []
        for n, query_id in enumerate(query["vec_id"].to_pylist()):
            ids, distance = forest.search(query_id, asked_x[n], strings[:, n], k)
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": distance}))
        return pa.Table.from_pandas(pd.concat(out), preserve_index=False).select(names).cast(empty.schema)

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(visit, "query_id bigint, vec_id bigint, score double")

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # cut to k a task before the rows move
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
