"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition.

A text is cut into the matches of a pattern.  Each distinct match is rows of (word, position, token),
at first one token per byte.  The recursive query joins neighbouring tokens with the merge table and
contracts, in every word, the leftmost pair of smallest rank, until no pair is left.  Texts are decoded
by a join with the vocabulary and an aggregation in order of position.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm.cache import Recent, held, portions
from almanac.llm.common import small_batches

CACHED_WORDS = 200_000  # words of a younger and of an older half
BATCH_WORDS = 25_000  # distinct words of a recursive query
BATCH_BYTES = 300_000  # and their bytes; a longer match is a query of its own
STEPS = 64  # contractions of a word in one query; what is not finished then goes into the next
PORTION = 2_000_000  # characters of text encoded and decoded together

#: Words whose last step found no pair are final; ``n`` counts the contractions of this query.
CONTRACT = f"""
WITH RECURSIVE step(w, pos, tok, n, live) AS (
  SELECT w, pos, tok, 0, true FROM held
  UNION ALL
  SELECT w, pos, tok, n, live FROM (
    WITH paired AS (
      SELECT w, pos, tok, n, lead(tok) OVER v AS next_tok, lag(pos) OVER v AS prev
      FROM step WHERE live AND n < {STEPS} WINDOW v AS (PARTITION BY w ORDER BY pos)),
    ranked AS (SELECT p.*, m.merged FROM paired p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.next_tok),
    best AS (SELECT w, min(merged::BIGINT * 4294967296 + pos) AS b FROM ranked WHERE merged IS NOT NULL GROUP BY w)
    SELECT r.w, r.pos, CASE WHEN r.pos = b.b % 4294967296 THEN (b.b // 4294967296)::INT ELSE r.tok END AS tok,
           r.n + 1 AS n, b.b IS NOT NULL AS live
    FROM ranked r LEFT JOIN best b ON r.w = b.w
    WHERE b.b IS NULL OR r.prev IS DISTINCT FROM b.b % 4294967296))
SELECT w, pos, tok, live FROM step WHERE NOT live OR n = {STEPS} ORDER BY w, pos
"""

DECODE = """
SELECT d, array_to_string(list(piece ORDER BY pos), '') AS text FROM ids JOIN vocabulary USING (id) GROUP BY d
"""


class Codec:
    """The vocabulary of a rank file (base64 of the bytes, rank) in a DuckDB of this process."""

    def __init__(self, path: str, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        with open(path, "rb") as lines:
            parts = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in parts}
        pairs = [
            (ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        merges = np.array(pairs, np.int32).reshape(-1, 3)
        self._table("merges", l=merges[:, 0], r=merges[:, 1], merged=merges[:, 2])
        # a byte is written as the character of that code point, so pieces that are no UTF-8 join as text
        self._table("vocabulary", id=np.array(list(ranks.values()), np.int32), piece=[t.decode("latin-1") for t in ranks])
        self.known = Recent(CACHED_WORDS)

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        lengths = np.array([len(w) for w in words])
        tok = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int64)
        out: list[bytes] = [b""] * len(words)
        while len(w):
            self.db.register("held", pa.table({"w": w, "pos": pos, "tok": tok}))
            found = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("held")
            w, pos, tok = (found[c].to_numpy() for c in ("w", "pos", "tok"))
            live = found["live"].to_numpy()
            done_w, done_tok = w[~live], tok[~live].astype("<u4")
            changes = np.flatnonzero(done_w[1:] != done_w[:-1]) + 1
            cuts = np.r_[0, changes, len(done_w)] if len(done_w) else np.zeros(1, np.int64)
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                out[done_w[s]] = done_tok[s:e].tobytes()
            w, pos, tok = w[live], pos[live], tok[live]
        return out

    def _learn(self, words: list[str]) -> list[bytes]:
        """Encodes words, sorted by length, in portions of bounded size."""
        out, part, size = [], [], 0
        for word in words:
            raw = word.encode("utf-8", "replace")
            if part and (len(part) >= BATCH_WORDS or size + len(raw) > BATCH_BYTES):
                out += self.contract(part)
                part, size = [], 0
            part.append(raw)
            size += len(raw)
        return out + self.contract(part)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, each match of the pattern encoded separately."""
        cut = [self.pattern.findall(t) for t in texts]
        place = self.known.know(set().union(*cut), self._learn).__getitem__
        return [b"".join(map(place, words)) for words in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        d = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids])
        self.db.register("ids", pa.table({"d": d, "pos": np.arange(len(flat)), "id": flat}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(ids)
        for n, text in zip(found["d"].to_pylist(), found["text"].to_pylist(), strict=True):
            out[n] = text.encode("latin-1")
        return out


def codec(path: str, pattern: str) -> Codec:
    return held(("bpe", path, pattern), lambda: Codec(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns (all but the text) and ``ids``, little-endian unsigned 32-bit integers; null and empty texts have none.

    One row in, one row out, in the scan's partitions; the time for one match of the pattern grows with the
    square of its length.
    """
    columns = [c for c in docs.columns if c != text] if columns is None else columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            ids = [x for texts in portions(b.column("_text"), PORTION) for x in own.encode(texts)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(ids, pa.binary())], names=[*columns, "ids"])

    small_batches(docs)
    schema = docs.select(*columns).schema.add("ids", T.BinaryType())
    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, columns: list[str]) -> DataFrame:
    """The columns and ``decoded``, the bytes of the row's ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            out, part, size = [], [], 0
            for x in b.column("ids"):
                part.append(x.as_py() or b"")
                size += len(part[-1])
                if size >= 2 * PORTION:
                    out += own.decode(part)
                    part, size = [], 0
            out += own.decode(part)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(out, pa.binary())], names=[*columns, "decoded"])

    small_batches(encoded)
    schema = encoded.select(*columns).schema.add("decoded", T.BinaryType())
    return encoded.select(*columns, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them, for every whole text.

    One pass: the ids of a portion are decoded where they were made.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            counts, ids_digests, digests = [], [], []
            for texts in portions(b.column("text"), PORTION):
                ids = own.encode(texts)
                counts += [len(x) // 4 for x in ids]
                ids_digests += [hashlib.sha256(x).hexdigest() for x in ids]
                digests += [hashlib.sha256(x).hexdigest() for x in own.decode(ids)]
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs)
    schema = docs.select("doc_id").schema.add("n_tokens", T.LongType())
    schema = schema.add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    return docs.select("doc_id", "text").mapInArrow(run, schema)
