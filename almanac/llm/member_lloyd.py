"""Codes of vectors by Lloyd's rounds over their parts, each part resident with the entry it belongs to.

Vectors are cut into consecutive parts, and every part position has a codebook.  The parts live in partitions by
(position, entry, salt): blocks of members that all belong to one entry, so its owners sum what they hold and send one
row per entry.  In the next round a block compares its members with the new codebook; those that stay never move, and
only parts that change their entry go through the shuffle to their new owners.  The union of the two keeps the
partitioning.  The salt bounds an entry's share of a partition, so an entry may hold all parts.

Everything is integer arithmetic: the same rows give the same codebooks in any order and after any retry.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.llm.common import same
from almanac.llm.vectors import floors, matrix, whole
from almanac.session import materialise, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
CELL_ROWS = 65_536  # vectors a salt stands for: no cell holds more parts than that, on average, whatever its entry
LEAST_SALTS = 64
PARTITION_PARTS = 500_000  # parts of a partition, on average
CHUNK_ROWS = 256  # vectors of a batch that share a salt
CHECKPOINT_ROUNDS = 2  # lineage is cut every so many rounds

Books = list[np.ndarray]  # by position: entries x width
Block = tuple[int, np.ndarray]  # cell, members


def edges(dim: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Begin and end of every part; equal where the parts divide the length."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower) and the squared distance of every row, exactly."""
    width = x.shape[1]
    top = max((int(abs(v).max()) for v in (x, book) if v.size), default=0)
    if 4 * top * top * max(1, width) < 2**53:  # doubles hold all terms
        a, b = x.astype(float), book.astype(float)
    else:
        fits = 4 * top * top * max(1, width) < 2**63
        a, b = (x.astype(np.int64), book.astype(np.int64)) if fits else (x.astype(object), book.astype(object))
    distance = np.stack([((a - entry) ** 2).sum(axis=1) for entry in b], axis=1)
    best = np.argmin(distance, axis=1)
    return best, distance[np.arange(len(x)), best]


def _packed(x: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds the values."""
    if x.dtype == object or not x.size:
        return x
    top = int(np.abs(x).max())
    return x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def _home(cell: int) -> int:
    """One function for all shuffles: partitionings by it are equal, so Spark unions them in place."""
    return cell


def _scatter(kept: DataFrame, dim: int, books: Books, salts: int, partitions: int) -> RDD:
    """Every part with its nearest entry, in blocks by cell; the only time that all parts move."""
    entries, cuts = len(books[0]), edges(dim)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId()
        for batch in batches:
            x = floors(matrix(batch.column(0), dim), SCALE)
            for at in range(0, len(x), CHUNK_ROWS):
                cells, found = [], []
                for p, (begin, end) in enumerate(cuts):
                    part = x[at : at + CHUNK_ROWS, begin:end]
                    entry, _ = nearest(part, books[p])
                    for e in np.unique(entry):
                        cells.append((p * entries + int(e)) * salts + salt % salts)
                        found.append(pickle.dumps(_packed(part[entry == e]), protocol=5))
                salt += 1
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(found, pa.binary())], ["cell", "block"])

    made = kept.select("embedding").mapInArrow(blocks, "cell bigint, block binary")
    dealt = made.rdd.map(lambda r: (r[0], pickle.loads(r[1]))).partitionBy(partitions, _home)
    return dealt.mapPartitions(_merged, preservesPartitioning=True)


def _merged(blocks: Iterator[Block]) -> Iterator[Block]:
    """One block per cell."""
    held: dict[int, list[np.ndarray]] = {}
    for cell, x in blocks:
        held.setdefault(cell, []).append(x)
    for cell in sorted(held):
        yield cell, np.concatenate(held.pop(cell))


def _migrate(members: RDD, books: Books, salts: int, partitions: int) -> RDD:
    """Members under the new codebooks: those that stay keep their partition, the others go to their new owner."""
    entries = len(books[0])

    def split(cell: int, x: np.ndarray) -> tuple[int, int, np.ndarray]:
        position, entry = divmod(cell // salts, entries)
        return position, entry, nearest(x, books[position])[0]

    def stay(blocks: Iterator[Block]) -> Iterator[Block]:
        for cell, x in blocks:
            _, entry, now = split(cell, x)
            if (now == entry).any():
                yield cell, x[now == entry]

    def leave(blocks: Iterator[Block]) -> Iterator[Block]:
        for cell, x in blocks:
            position, entry, now = split(cell, x)
            for e in np.unique(now[now != entry]):
                yield (position * entries + int(e)) * salts + cell % salts, x[now == e]

    moved = members.mapPartitions(leave).partitionBy(partitions, _home)
    rest = members.mapPartitions(stay, preservesPartitioning=True)
    return rest.union(moved).mapPartitions(_merged, preservesPartitioning=True)


def _updated(members: RDD, books: Books, salts: int) -> Books:
    """Floors of the members' means; an entry without members stays.  One row per entry reaches the driver."""
    entries = len(books[0])

    def owned(blocks: Iterator[Block]) -> Iterator[tuple[int, tuple[int, list[int]]]]:
        for cell, x in blocks:
            wide = x.dtype != object and x.size and int(np.abs(x.astype(np.int64)).max()) * len(x) < 2**63
            total = (x.astype(np.int64) if wide else x.astype(object)).sum(axis=0)
            yield cell // salts, (len(x), [int(v) for v in total])

    add = lambda a, b: (a[0] + b[0], [v + w for v, w in zip(a[1], b[1], strict=True)])
    sums = members.mapPartitions(owned).reduceByKey(add, max(1, min(entries * PARTS, members.getNumPartitions()))).collect()
    new = [b.astype(object) for b in books]
    for at, (n, total) in sums:
        position, entry = divmod(at, entries)
        new[position][entry] = [v // n for v in total]
    return [_packed(b.astype(np.int64)) if not b.size or max(abs(int(v)) for v in b.flat) < 2**62 else b for b in new]


def first_books(kept: DataFrame, dim: int, entries: int = ENTRIES) -> Books:
    """The parts of the rows of the smallest ids, ascending (nulls last, then by content)."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    x = floors(np.array([r[0] for r in rows], float).reshape(len(rows), dim), SCALE)
    return [x[:, begin:end] for begin, end in edges(dim)]


def fit(kept: DataFrame, dim: int, rounds: int = ROUNDS, entries: int = ENTRIES) -> Books:
    """Codebooks after the given rounds of assignment and update."""
    context = kept.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(kept.sparkSession))
    books = first_books(kept, dim, entries)
    rows = kept.count()
    salts = max(LEAST_SALTS, math.ceil(rows / CELL_ROWS))
    partitions = max(context.defaultParallelism, math.ceil(rows * PARTS / PARTITION_PARTS))
    members: RDD | None = None
    for turn in range(rounds):
        before = members
        members = _scatter(kept, dim, books, salts, partitions) if before is None else _migrate(before, books, salts, partitions)
        members = members.persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CHECKPOINT_ROUNDS == CHECKPOINT_ROUNDS - 1:
            members.checkpoint()
        books = _updated(members, books, salts)
        if before is not None:
            before.unpersist()
    if members is not None:
        members.unpersist()
    return books


def digest(books: Sequence[np.ndarray]) -> str:
    """sha256 of all entries' components by position, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for entry in b for v in entry).encode()).hexdigest()


def encode(kept: DataFrame, dim: int, books: Books) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distance over all parts) of every row.

    An error beyond 64 bits is null.
    """
    cuts = edges(dim)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = floors(matrix(batch.column(2), dim), SCALE)
            code, error = np.empty((len(x), len(cuts)), np.uint8), np.zeros(len(x), object)
            for p, (begin, end) in enumerate(cuts):
                code[:, p], distance = nearest(x[:, begin:end], books[p])
                error += np.frompyfunc(int, 1, 1)(distance)
            columns = [
                batch.column(0), batch.column(1), pa.array([row.tobytes().hex() for row in code], pa.string()),
                pa.array([v if v < 2**63 else None for v in error], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    rows = kept.select("vec_id", "label", "embedding")
    types = dict(rows.dtypes)
    return rows.mapInArrow(codes, f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint")


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of the rows of (vec_id, embedding, label).

    Rows whose vector is null, holds null or non-finite components or has not the table's length (``vectors.whole``)
    are left out.  Repeated ids and rows are rows of their own; null ids come last among the first entries, null
    labels are one label.  Fewer rows than entries make as many entries as rows.  An empty table gives no rows.
    Other columns are ignored.
    """
    kept, dim = whole(vectors)
    if dim is None:
        empty = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
        return empty.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.lit("")).where("false")
    books = fit(kept, dim)
    coded = materialise(encode(kept, dim, books), "codes")
    totals = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    return same(coded, totals, ["label"], "left").withColumn("codebooks_sha256", F.lit(digest(books)))
