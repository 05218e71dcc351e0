"""Token ids in wavelet matrices: one compressed file per shard, documents in ascending order.

A shard holds the ids of consecutive documents as bit-planes, most significant first.  After each
plane the ids are dealt stably, those with a zero bit in front.  A plane is kept in chunks that are compressed one by one,
each with its counts of ones per 512-bit block, and the file's directory has where each chunk lies and the ones before
it.  So ``access``, ``rank``, ``count`` and ``select`` inflate only the chunks their positions fall into, one or two a
plane, and nothing else of the file.

Files are written as Parquet rows (part, seq, counts, blob): Spark commits them, so a lost task
leaves nothing behind, and any store Spark writes to will do.  ``part`` is the range of document ids,
``seq`` the shard within it.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.llm.cache import Recent, gathered, held, numbered
from almanac.llm.common import small_batches
from almanac.session import scratch_path

MAGIC = b"WVM2"
SHARD_TOKENS = 1 << 20  # a shard closes behind the document that fills it
BLOCK = 64  # bytes of a plane to a rank count
CHUNK = 256 * BLOCK  # bytes of a plane that are compressed together
CHUNK_BITS = 8 * CHUNK
CACHED_WORDS = 500_000  # words of a younger and of an older half
JOINED_WORDS = 1_000  # words encoded in one call
PORTION = 12_000_000  # characters whose new words are encoded together
HEAD = struct.Struct("<4sBxxxQQQ")  # magic, planes, ids, documents, bytes of the part on documents


#: Masks of the bits of a block that lie before each place in it.
BEFORE = ((1 << np.clip(np.arange(8 * BLOCK + 1)[:, None] - 8 * np.arange(BLOCK)[None, :], 0, 8)) - 1).astype(np.uint8)


class Plane:
    """Bits in memory, with counts per block and chunk."""

    def __init__(self, bits: np.ndarray, size: int) -> None:
        self.bits, self.size = bits, size
        padded = np.pad(bits, (0, -len(bits) % CHUNK)).reshape(-1, CHUNK // BLOCK, BLOCK)
        ones = np.bitwise_count(padded).sum(axis=2, dtype=np.uint32)
        self.chunk_ones = ones.sum(axis=1, dtype=np.int64)
        self.blocks = np.cumsum(ones, axis=1, dtype=np.uint32) - ones  # ones of the chunk before each block
        self.before = np.cumsum(self.chunk_ones) - self.chunk_ones

    def chunk(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts per block and bytes of a chunk."""
        return self.blocks[number], self.bits[number * CHUNK : (number + 1) * CHUNK]

    def __len__(self) -> int:
        return len(self.before)


class PackedPlane:
    """Bits of a file: chunks are inflated as they are asked for; the last few stay."""

    KEPT = 8

    def __init__(self, file: memoryview, ends: np.ndarray, start: int, before: np.ndarray, size: int) -> None:
        self.file, self.ends, self.start, self.before, self.size = file, ends, start, before, size
        self.inflated = 0
        self._held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def chunk(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        if number not in self._held:
            low = self.start if number == 0 else int(self.ends[number - 1])
            raw = zstandard.decompress(self.file[low : int(self.ends[number])])
            self.inflated += 1
            blocks = np.frombuffer(raw, "<u4", CHUNK // BLOCK)
            while len(self._held) >= self.KEPT:
                self._held.pop(next(iter(self._held)))
            self._held[number] = blocks, np.frombuffer(raw, np.uint8, offset=blocks.nbytes)
        return self._held[number]

    def __len__(self) -> int:
        return len(self.before)


def ones_before(plane: Plane | PackedPlane, at: np.ndarray) -> np.ndarray:
    """Ones of a plane before each position."""
    out = np.empty(len(at), np.int64)
    number = np.minimum(at // CHUNK_BITS, len(plane) - 1)
    for n in np.unique(number).tolist():
        mine = number == n
        rest = at[mine] - n * CHUNK_BITS
        blocks, bits = plane.chunk(n)
        rows = (bits if len(bits) % BLOCK == 0 else np.pad(bits, (0, -len(bits) % BLOCK))).reshape(-1, BLOCK)
        block = np.minimum(rest // (8 * BLOCK), len(rows) - 1)
        inside = np.bitwise_count(rows[block] & BEFORE[rest - block * 8 * BLOCK])
        out[mine] = plane.before[n] + blocks[block] + inside.sum(axis=1, dtype=np.int64)
    return out


class WaveletMatrix:
    """Ids of one shard.  Positions count from 0; ``count`` and ``rank`` look at the ids before a position."""

    def __init__(self, planes: list[Plane | PackedPlane], zeros: list[int], size: int) -> None:
        self.planes, self.zeros, self.size = planes, zeros, size

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros = [], []
        for b in reversed(range(bits)):
            one = (now & now.dtype.type(1 << b)) != 0
            planes.append(Plane(np.packbits(one, bitorder="little"), len(ids)))
            low = np.flatnonzero(~one)
            zeros.append(len(low))
            now = np.concatenate((now.take(low), now.take(np.flatnonzero(one))))
        return cls(planes, zeros, len(ids))

    def ids(self) -> np.ndarray:
        """All ids at once, plane by plane from the last, undoing the dealing."""
        bits = len(self.planes)
        now = np.zeros(self.size, np.uint16 if bits <= 16 else np.uint32)
        for level in reversed(range(bits)):
            plane = self.planes[level]
            packed = np.concatenate([plane.chunk(n)[1] for n in range(len(plane))]) if len(plane) else np.zeros(0, np.uint8)
            one = np.unpackbits(packed, count=self.size, bitorder="little").view(bool)
            back = np.empty_like(now)
            zeros = self.zeros[level]
            back[np.flatnonzero(~one)] = now[:zeros]
            back[np.flatnonzero(one)] = now[zeros:] | now.dtype.type(1 << (bits - 1 - level))
            now = back
        return now

    def _rank1(self, level: int, at: int) -> int:
        return int(ones_before(self.planes[level], np.array([at]))[0]) if self.size else 0

    def _bit(self, level: int, at: int) -> int:
        _, bits = self.planes[level].chunk(at // CHUNK_BITS)
        return int(bits[at % CHUNK_BITS >> 3]) >> (at & 7) & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.size:
            raise IndexError(at)
        out = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, at), self._rank1(level, at)
            at = self.zeros[level] + ones if bit else at - ones
            out = out << 1 | bit
        return out

    def _ranges(self, token: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of a token in each [start, stop) lie after the last plane."""
        if token < 0 or token >> len(self.planes) or not self.size:
            return np.zeros_like(start), np.zeros_like(stop)
        for level in range(len(self.planes)):
            low, high = np.split(ones_before(self.planes[level], np.concatenate([start, stop])), 2)
            if token >> (len(self.planes) - 1 - level) & 1:
                start, stop = self.zeros[level] + low, self.zeros[level] + high
            else:
                start, stop = start - low, stop - high
        return start, stop

    def counts(self, token: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Occurrences of a token in each [start, stop)."""
        low, high = self._ranges(token, np.asarray(start, np.int64), np.asarray(stop, np.int64))
        return high - low

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        return int(self.counts(token, np.array([start]), np.array([self.size if stop is None else stop]))[0])

    def rank(self, token: int, at: int) -> int:
        return self.count(token, 0, at)

    def select(self, token: int, nth: int) -> int:
        """Position of the nth occurrence, from 0."""
        low, high = (int(v[0]) for v in self._ranges(token, np.array([0]), np.array([self.size])))
        if not 0 <= nth < high - low:
            raise IndexError(nth)
        at = low + nth
        for level in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _select(self, level: int, bit: int, nth: int) -> int:
        """Position of the nth bit of a kind in a plane: the chunk by the directory, then the block by its counts."""
        plane = self.planes[level]
        starts = np.arange(len(plane)) * CHUNK_BITS
        number = int(np.searchsorted(plane.before if bit else starts - plane.before, nth, "right")) - 1
        before = int(plane.before[number]) if bit else number * CHUNK_BITS - int(plane.before[number])
        blocks, bits = plane.chunk(number)
        spans = np.arange(CHUNK // BLOCK) * 8 * BLOCK
        inside = blocks.astype(np.int64) if bit else spans - blocks
        block = int(np.searchsorted(inside, nth - before, "right")) - 1
        of = np.unpackbits(bits[block * BLOCK : (block + 1) * BLOCK], bitorder="little")
        place = np.flatnonzero(of == bit)[nth - before - int(inside[block])]
        return number * CHUNK_BITS + block * 8 * BLOCK + int(place)

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, n) for n in range(self.count(token))]


def pack(matrix: WaveletMatrix, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file: a head, the compressed part on documents, the directory of chunks, the compressed chunks.

    The directory has, plane by plane, its zeros and of each chunk the ones before it and where it ends.
    """
    squeeze = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], bool)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    about = squeeze(b"".join([np.packbits(known).tobytes(), ids.tobytes(), lengths.astype("<u8").tobytes()]))
    chunks = -(-matrix.size // CHUNK_BITS)
    at = HEAD.size + len(about) + 8 * len(matrix.planes) * (1 + 2 * chunks)
    directory, body = [], []
    for plane, zeros in zip(matrix.planes, matrix.zeros, strict=True):
        ends = []
        for n in range(chunks):
            blocks, bits = plane.chunk(n)
            body.append(squeeze(blocks.astype("<u4").tobytes() + bits.tobytes()))
            at += len(body[-1])
            ends.append(at)
        directory += [np.array([zeros], "<u8").tobytes(), plane.before[:chunks].astype("<u8").tobytes(), np.array(ends, "<u8").tobytes()]
    return b"".join([HEAD.pack(MAGIC, len(matrix.planes), matrix.size, len(doc_ids), len(about)), about, *directory, *body])


def unpack(blob: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix over the file, whose chunks stay compressed until they are asked for, and its documents."""
    magic, bits, size, docs, length = HEAD.unpack_from(blob)
    if magic != MAGIC:
        raise ValueError("not a wavelet shard")
    file = memoryview(blob)
    about = zstandard.decompress(file[HEAD.size : HEAD.size + length])
    marks = -(-docs // 8)
    known = np.unpackbits(np.frombuffer(about, np.uint8, marks), count=docs)
    ids = np.frombuffer(about, "<i8", docs, marks).tolist()
    lengths = np.frombuffer(about, "<u8", docs, marks + 8 * docs).astype(np.int64)
    chunks = -(-size // CHUNK_BITS)
    directory = np.frombuffer(blob, "<u8", bits * (1 + 2 * chunks), HEAD.size + length).reshape(bits, -1).astype(np.int64)
    start = HEAD.size + length + 8 * directory.size
    planes = []
    for row in directory:
        planes.append(PackedPlane(file, row[1 + chunks :], start, row[1 : 1 + chunks], size))
        start = int(row[-1]) if chunks else start
    return WaveletMatrix(planes, directory[:, 0].tolist(), size), [d if k else None for d, k in zip(ids, known, strict=True)], lengths


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by the tokenizers library.

    The vocabulary's splitting drops white space and never joins across it, so a text is encoded as its words
    are.  Words a task has not met are encoded together, as one text whose tokens are told apart by their places.
    A-Z may be lower-cased before, as the tokenizer does so itself.  A text that holds the string of an added token, which
    the library takes for that token wherever it stands, is encoded as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # for words, which hold none: the library does not look for them
        self.known = Recent(CACHED_WORDS)
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.start = os.path.commonprefix(self.added)  # which few texts hold
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[n for piece, n in vocabulary.items() if piece.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        lower = pc.ascii_lower(pa.array(texts, pa.large_string()).cast(pa.string()))
        special = pc.match_substring(lower, self.start).to_numpy(zero_copy_only=False)
        if self.added and special.any():
            special &= np.any([pc.match_substring(lower, t).to_numpy(zero_copy_only=False) for t in self.added], axis=0)
        if self.added and special.any():
            plain = iter(self.encode([t for t, s in zip(texts, special, strict=True) if not s]))
            as_they_are = lambda t: np.array(self.plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            return [as_they_are(t) if s else next(plain) for t, s in zip(texts, special, strict=True)]
        words, number, offsets = numbered(pc.ascii_split_whitespace(lower))
        # a comma or full stop behind a letter is a token of its own, which the words before it share
        stops = [w[-1] if w[-1:] in (",", ".") and "a" <= w[-2:-1] <= "z" else "" for w in words]
        stems = [w[: len(w) - len(x)] for w, x in zip(words, stops, strict=True)]
        known = self.known.know({*stems, ",", ".", ""}, self._words)
        ids, ends = gathered([known[w] + known[x] for w, x in zip(stems, stops, strict=True)], number, offsets, "<u4")
        raw = ids.tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Runs of letters end with their only token that closes a word; other words are told apart by places."""
        out: dict[str, bytes] = {}
        letters = [w for w in words if w.isalpha()]
        for at in range(0, len(letters), JOINED_WORDS):
            part = letters[at : at + JOINED_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.r_[0, np.flatnonzero(self.closes[ids]) + 1]
            out.update(_cut(part, ids, cuts) if len(cuts) == len(part) + 1 and cuts[-1] == len(ids) else self._placed(part))
        others = [w for w in words if not w.isalpha()]
        for at in range(0, len(others), JOINED_WORDS):
            out.update(self._placed(others[at : at + JOINED_WORDS]))
        return [out[w] for w in words]

    def _placed(self, part: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        starts = np.cumsum([0, *(len(w) + 1 for w in part)])
        first = np.fromiter((o[0] for o in found.offsets), np.int64, len(ids))
        return _cut(part, ids, np.searchsorted(first, starts))


def _cut(words: list[str], ids: np.ndarray, cuts: np.ndarray) -> dict[str, bytes]:
    raw, at = ids.tobytes(), (4 * cuts).tolist()
    return {w: raw[i:j] for w, i, j in zip(words, at[:-1], at[1:], strict=True)}


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[str]]]:
    """Ids and texts of about ``PORTION`` characters, over the ends of batches; a longer text is a portion of its own."""
    keys, texts, size = [], [], 0
    for b in batches:
        for key, value in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            text = value.as_py()
            if texts and size + len(text) > PORTION:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(text)
            size += len(text)
    if texts:
        yield keys, texts


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards of ``docs`` (doc_id, text) and returns them as read: part, seq, n_docs, n_tokens, blob.

    Documents are range-partitioned by id, ties by text, and sorted within; a null id comes first, a null text
    is empty, every document ends with ``end_id``.  A task holds one shard and one batch of texts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.crc32(F.col("text").cast("binary"))]
    dealt = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = held(("words", tokenizer_path), lambda: WordEncoder(tokenizer_path)), np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        kept, lengths, doc_ids, total = [], [], [], 0

        def shard() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(kept), "<u4"))
            row = {"part": part, "seq": seq, "n_docs": len(doc_ids), "n_tokens": total}
            return pa.RecordBatch.from_pylist([row | {"blob": pack(matrix, doc_ids, np.array(lengths))}], SHARD_ARROW)

        for keys, texts in _portions(batches):
            for doc_id, ids in zip(keys, encoder.encode(texts), strict=True):
                kept += (ids, end)
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4 + 1)
                total += lengths[-1]
                if total >= shard_tokens:
                    yield shard()
                    kept, lengths, doc_ids, total, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield shard()

    small_batches(docs)
    path = scratch_path(spark, "wavelet")
    dealt.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


SHARD_SCHEMA = "part int, seq int, n_docs bigint, n_tokens bigint, blob binary"
SHARD_ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())]
)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, start): ids of all shards before; sums run within a part and over one row per part."""
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    own = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_own"))
    return own.join(before, "part").select("part", "seq", (F.col("_own") + F.col("_before")).alias("start"))


def read_documents(shards: DataFrame, end_id: int = 2) -> DataFrame:
    """Every document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, n_ends.

    ``n_ends`` counts ``end_id`` among the document's ids by rank in the planes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                matrix, doc_ids, lengths = unpack(b.column("blob")[row].as_py())
                ids = matrix.ids().astype("<u4")
                ends = np.cumsum(lengths)
                found = matrix.counts(end_id, ends - lengths, ends)
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b.column(c)[row].as_py()] * len(doc_ids), pa.int32()) if c else None
                        for c in ("part", "seq")
                    ]
                    + [pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()), pa.array(found)],
                    names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32", "n_ends"],
                )

    schema = "part int, seq int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint, n_ends bigint"
    read = shards.select("part", "seq", "blob").mapInArrow(run, schema)
    placed = read.join(shard_starts(shards), ["part", "seq"])
    return placed.select("doc_id", (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "n_ends")
