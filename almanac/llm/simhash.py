"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint is 64 bits.  Two that differ in at most ``k`` bits agree on at least ``m - k`` of ``m``
blocks, so they share the key of one of the C(m, k) choices of ``m - k`` blocks.  ``m`` follows the
number of fingerprints, which keeps chance meetings in proportion to it and changes no result.

Equal fingerprints are one row.  A bucket of fingerprints that share a key gives the edges of a
spanning forest of its links, never its pairs.  A crowded bucket is cut into chunks, and every two
chunks meet in a task of their own, so no task holds more than two chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm.common import small_batches
from almanac.session import materialise

CHUNK = 4096  # fingerprints of a bucket that are compared at once
SENT = 500_000  # counted rows of 17 bytes up to which the rows to drop are sent to the texts
PIECE = 65_536  # shingles hashed at once, which bounds the memory for a very long text
BANDS, ROWS = 20, 4  # at similarity 0.8 a pair shares no key with probability (1 - 0.8^4)^20 = 0.00003
AGREE = 44  # of the 80 hashes; at 0.8 about 64 agree, with a deviation of 3.6
LOAD, ROW_LOAD = 1_000_000, 64  # shingles of a group that are compared at once; what a row counts besides its shingles
_DRAWS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
SALT, FACTOR = _DRAWS[0], _DRAWS[1] | np.uint64(1)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit by bit the majority of the XXH64 of all shingles, repeats included; 0 without words.

    A-Z are lower-cased; words are runs without ASCII white space, fewer words than a shingle are one.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    last = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, PIECE):
        stop = min(last, at + PIECE)
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), seed) for i in range(at, stop)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, columns: list[str], words: int = 4, seed: int = 42) -> DataFrame:
    """The columns and ``fp`` (bigint) of every document; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), words, seed) for t in b.column("_text")]
            kept = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps, pa.int64())], names=[*columns, "fp"])

    small_batches(docs)
    schema = docs.select(*columns).schema.add("fp", T.LongType())
    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, schema)


def block_count(rows: int, distance: int, bits: int = 64, spare: int = 2) -> int:
    """Smallest number of blocks whose keys have ``spare`` bits more than the number of rows needs."""
    need = min(bits - 16, math.log2(max(2, rows)) + spare)
    m = distance + 1
    while bits * (m - distance) / m < need:
        m += 1
    return m


def block_keys(fps: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(choice, key, fp): the bits of each choice of ``blocks - distance`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    chosen = [signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - distance)]
    keys = [F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for n, m in enumerate(chosen)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.choice", "k.key", "fp")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within ``distance``, found from one node to its unseen ones."""
    edges, rest = [], np.unique(fps)
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= distance
            if near.any():
                found = rest[near]
                edges += [(int(x), int(y)) for y in found]
                front += list(found)
                rest = rest[~near]
    return edges


def bucket_edges(fps: DataFrame, distance: int, rows: int, chunk: int = CHUNK) -> DataFrame:
    """Distinct edges (u < v) that connect all fingerprints linked within ``distance``."""
    keyed = block_keys(fps, distance, block_count(rows, distance))
    sizes = materialise(keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where(F.col("n") > 1), "buckets")
    met = keyed.join(sizes, ["choice", "key"])
    parts = F.ceil(F.col("n") / chunk).cast("int")
    cut = met.select("choice", "key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    # a chunk meets every chunk of its bucket, also itself: tile (i, j) with i <= j
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    tiled = cut.select("choice", "key", "fp", "part", F.explode(other).alias("with"))
    tiled = tiled.select("choice", "key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "fp")
    names = ["choice", "key", "i", "j"]
    dealt = tiled.repartition(*names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(part: np.ndarray) -> list[tuple[int, int]]:
            if len(part) == 2:
                x, y = part
                return [(int(x), int(y))] if x != y and (int(x) ^ int(y)).__and__((1 << 64) - 1).bit_count() <= distance else []
            return _forest(part, distance)

        left_keys, left = np.empty((0, 4), np.int64), np.empty(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
            keys, fp = np.concatenate([left_keys, keys]), np.concatenate([left, b.column("fp").to_numpy()])
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            out = [e for s, t in zip(starts[:-1], starts[1:], strict=True) for e in edges(fp[s:t])]
            left_keys, left = keys[starts[-1] :], fp[starts[-1] :]
            yield _pairs(out)
        yield _pairs(edges(left) if len(left) > 1 else [])

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    u = pa.array([min(e) for e in edges], pa.int64())
    return pa.RecordBatch.from_arrays([u, pa.array([max(e) for e in edges], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): large-star and small-star rounds until every tree is a star.

    Each round is two joins over narrow rows, written to the shared folder; the number of rounds grows with
    the logarithm of the longest chain.  A hub's neighbours are not gathered: its minimum is an aggregate, written
    before it is joined, as Spark splits a crowded key only where both sides of a join are plain exchanges.
    """
    now = materialise(edges, "edges")
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u")).toDF("x", "y")
        low = materialise(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m")), "low")
        # m <= x < y: every row points from the larger node to the smaller
        large = both.join(low, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = materialise(large.distinct(), "large")
        least = materialise(large.groupBy("x").agg(F.min("y").alias("m")), "least")
        small = large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        after = materialise(small.union(least.toDF("x", "y")).distinct().toDF("v", "u").select("u", "v"), "small")
        open_ends = after.join(after.select(F.col("v").alias("u")), "u", "left_semi")
        manifold = after.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
        now = after
        if open_ends.isEmpty() and manifold.isEmpty():
            break
    else:
        raise RuntimeError("components did not close; raise most_rounds")
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_groups(docs: DataFrame, key: str = "doc_id", words: int = 4, distance: int = 4) -> DataFrame:
    """(key, fp, component_id) of every row; component_id is the smallest key reachable over links, null if none has a key.

    Rows of equal fingerprint (copies, and all texts without words, whose fingerprint is zero) are linked.
    """
    found = materialise(with_fingerprint(docs, [key], words), "fingerprints")
    first = materialise(found.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    stars = components(bucket_edges(first.select("fp"), distance, first.count()))
    linked = materialise(stars, "stars")
    rooted = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = materialise(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return found.join(named, "fp")


def set_fingerprint(shingles: np.ndarray) -> int:
    """Bit by bit the majority of the distinct shingles; 0 for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), PIECE):
        ones += np.unpackbits(shingles[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<i8")[0])


def shingle_set(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct XXH64 of all shingles, sorted; words and short texts as in ``fingerprint``, empty without words."""
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    last = max(1, len(tokens) - words + 1) if tokens else 0
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), seed) for i in range(last)], np.uint64))


def set_class(shingles: np.ndarray) -> int:
    """Number of a shingle set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else 0


def sketch(shingles: np.ndarray) -> tuple[list[int], bytes]:
    """(keys, bytes): a key of each band of min-wise hashes, and the lowest byte of every hash."""
    if not len(shingles):
        return [], b""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[at : at + 4096] ^ SALT) * FACTOR).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist(), least.astype(np.uint8).tobytes()


def with_sketch(docs: DataFrame, columns: list[str], words: int) -> DataFrame:
    """The columns, ``cls``, ``fp``, the number ``n`` of distinct shingles, ``keys`` and ``sketch`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), words) for t in b.column("_text")]
            made = [sketch(s) for s in sets]
            found = [pa.array(map(f, sets), pa.int64()) for f in (set_class, set_fingerprint, len)]
            found += [pa.array([k for k, _ in made], pa.list_(pa.int64())), pa.array([x for _, x in made], pa.binary())]
            kept = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*columns, "cls", "fp", "n", "keys", "sketch"])

    small_batches(docs)
    schema = docs.select(*columns).schema.add("cls", T.LongType()).add("fp", T.LongType()).add("n", T.LongType())
    schema = schema.add("keys", T.ArrayType(T.LongType())).add("sketch", T.BinaryType())
    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(run, schema)


def _linked(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of 0 .. count - 1; ``near(x, rest)`` tells which of ``rest`` are linked to ``x``."""
    edges, rest = [], np.arange(count)
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            found = near(x, rest)
            if found.any():
                edges += [(x, y) for y in rest[found]]
                front += list(rest[found])
                rest = rest[~found]
    return edges


def _alike(sketches: list[bytes]) -> list[tuple[int, int]]:
    """Forest of the sketches that agree in ``AGREE`` hashes."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    return _linked(len(rows), lambda x, rest: np.count_nonzero(rows[rest] == rows[x], axis=1) >= AGREE)


def _similar(sets: list[bytes], least: Fraction) -> list[tuple[int, int]]:
    """Forest of the shingle sets whose shared part of their union is ``least`` or more; shared shingles are found by postings."""
    shingles = [np.frombuffer(s, np.uint64) for s in sets]
    sizes = np.array([len(s) for s in shingles])
    flat = np.concatenate(shingles)
    order = np.argsort(flat, kind="stable")
    owner, flat = np.repeat(np.arange(len(sets)), sizes)[order], flat[order]
    top, both = least.numerator, least.numerator + least.denominator

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        start = np.searchsorted(flat, shingles[x], "left")
        many = np.searchsorted(flat, shingles[x], "right") - start
        at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(owner[at], minlength=len(sets))[rest]
        return shared * both >= top * (sizes[rest] + sizes[x])  # shared / (a + b - shared) >= least

    return _linked(len(sets), near)


def _tile_edges(rows: DataFrame, group: str, load: str, links: Callable[[list[bytes]], list[tuple[int, int]]]) -> DataFrame:
    """Distinct edges (u < v) that ``links`` finds in every group of ``rows`` (group, parts, cls, load).

    A group is cut into ``parts`` chunks; a chunk meets every chunk of its group, also itself: tile (i, j) with i <= j.
    """
    cut = rows.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    other = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    tiled = cut.select(group, "cls", load, "part", F.explode(other).alias("with"))
    tiled = tiled.select(group, F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "cls", load)
    names = [group, "i", "j"]
    dealt = tiled.repartition(*names).sortWithinPartitions(*names)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
        now, ids, loads = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), b.num_rows]
            classes, values = b.column("cls").to_pylist(), b.column(load).to_pylist()
            for s, t in zip(starts[:-1], starts[1:], strict=True):
                if (key := tuple(keys[s])) != now:
                    if len(ids) > 1:
                        yield ids, loads
                    now, ids, loads = key, [], []
                ids += classes[s:t]
                loads += values[s:t]
        if len(ids) > 1:
            yield ids, loads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for ids, loads in groups(batches):
            out += [(ids[x], ids[y]) for x, y in links(loads) if ids[x] != ids[y]]
            if len(out) > CHUNK:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def fingerprint_edges(classes: DataFrame, distance: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Edges that connect all classes (cls, fp) whose fingerprints differ in ``distance`` bits or less, by pigeonhole blocks."""
    first = materialise(classes.groupBy("fp").agg(F.min("cls").alias("first")), "prints")
    equal = classes.join(first, "fp").where("cls <> first").select("first", "cls")
    near = bucket_edges(first.select("fp"), distance, first.count(), chunk)
    ends = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"_{name}"))
    linked = near.join(ends("u"), "u").join(ends("v"), "v").select("_u", "_v")
    both = linked.union(equal).toDF("u", "v")
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def candidate_edges(classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges that connect all classes (cls, keys, sketch) which share a key and agree in their sketches."""
    keyed = classes.select(F.explode("keys").alias("key"), "cls")
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = keyed.join(sizes, "key").select("key", "cls", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    return _tile_edges(met.join(classes.select("cls", "sketch"), "cls"), "key", "sketch", _alike)


def similar_edges(docs: DataFrame, chosen: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Edges that connect all classes of similarity ``least`` within a group of ``chosen`` (doc_id, tie, cls, root, parts).

    ``docs`` has doc_id, tie and text; the shingle sets are made where the text lies.
    """
    side = F.broadcast(chosen) if chosen.count() <= SENT else chosen
    wanted = side.withColumnsRenamed({"doc_id": "_id", "tie": "_tie"})
    rows = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a row that repeats in every column comes once a task
        for b in batches:
            new = []
            for at, cls in enumerate(b.column("cls").to_pylist()):
                if cls not in seen:
                    seen.add(cls)
                    new.append(at)
            sets = pa.array([shingle_set(b.column("text")[at].as_py(), words).tobytes() for at in new], pa.binary())
            kept = [b.column(c).take(pa.array(new, pa.int64())) for c in ("root", "parts", "cls")]
            yield pa.RecordBatch.from_arrays([*kept, sets], names=["root", "parts", "cls", "shingles"])

    small_batches(docs)
    made = rows.select("root", "parts", "cls", "text").mapInArrow(run, "root bigint, parts int, cls bigint, shingles binary")
    return _tile_edges(made, "root", "shingles", lambda sets: _similar(sets, least))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, load: int = LOAD, distance: int = 4) -> DataFrame:
    """One row of each group stays, with the columns of ``docs``: the smallest doc_id, of its rows the least by content.

    Candidates are texts whose SimHash fingerprints differ in ``distance`` bits or less.  At a similarity of 0.8 about ten of the
    64 bits differ, so texts that share a min-wise key are candidates too.  Every link is then verified on the whole
    sets: two texts are linked if their shingles share ``similarity`` of their union or more, texts without words among
    themselves.  Only candidates' texts are read again; the chosen ids come to them.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    tie = F.xxhash64(*columns)
    slim = docs.select("doc_id", "text", tie.alias("tie"))
    found = materialise(with_sketch(slim, ["doc_id", "tie"], words), "fingerprints")
    row = F.min(F.struct("doc_id", "tie")).alias("row")
    first = found.groupBy("cls").agg(row, *[F.first(c).alias(c) for c in ("fp", "n", "keys", "sketch")])
    first = materialise(first, "distinct")
    edges = fingerprint_edges(first.select("cls", "fp"), distance).union(candidate_edges(first))
    near = materialise(components(edges.distinct()), "near")
    near = near.union(near.select("root", "root").distinct()).toDF("cls", "root")
    near = materialise(near.join(first.select("cls", "row", "n"), "cls"), "candidates")
    loads = near.groupBy("root").agg(F.ceil(F.sum(F.col("n") + ROW_LOAD) / load).cast("int").alias("parts"))
    chosen = near.join(materialise(loads, "loads"), "root").select("row.doc_id", "row.tie", "cls", "root", "parts")
    stars = components(similar_edges(slim, materialise(chosen, "chosen"), words, Fraction(str(similarity))))
    rooted = first.select("cls").join(stars.withColumnRenamed("node", "cls"), "cls", "left")
    named = materialise(rooted.select("cls", F.coalesce("root", "cls").alias("root")), "classes")
    found = found.select("doc_id", "tie", "cls")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tie")
    rooted = materialise(found.join(named, "cls").groupBy("root", "doc_id", "tie").agg(F.count("*").alias("rows")), "rooted")
    # a row alone in its group is not touched, so only the other groups are looked up
    best = materialise(rooted.groupBy("root").agg(F.min(order).alias("b"), F.sum("rows").alias("n")).where("n > 1").drop("n"), "best")
    marked = rooted.join(best, "root").where((F.col("rows") > 1) | (order != F.col("b")))
    touched = materialise(marked.select("doc_id", "tie", (order == F.col("b")).alias("best")), "touched")
    return _without(docs, touched)


def _without(docs: DataFrame, touched: DataFrame) -> DataFrame:
    """``docs`` without the touched rows, those that are best in a group and repeat in every column once again."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("doc"), F.col("doc_id").alias("_id"), F.xxhash64(*columns).alias("_tie"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie"))
    few = touched.count() <= SENT
    side = F.broadcast(touched) if few else touched
    out = packed.join(side, same, "left_anti").select("doc.*")
    again = touched.where("best")
    if again.isEmpty():
        return out
    repeated = packed.join(F.broadcast(again) if few else again, same, "left_semi")
    return out.unionByName(repeated.groupBy("_id", "_tie").agg(F.first("doc").alias("doc")).select("doc.*"))
