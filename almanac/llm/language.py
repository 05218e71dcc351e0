"""Language identification by unigrams over a fixed vocabulary, all segmentations summed.

Each language has a probability for every piece of a public vocabulary.  The score of a word is the
forward sum over all ways to cut it into pieces; a text adds the logarithms of its words.  The
probabilities are learned by expectation-maximisation: expected uses of every piece, by language, from
the forward and backward sums over the distinct words of the training texts.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanac.llm.cache import Recent, held, numbered, portions, release
from almanac.llm.common import small_batches
from almanac.session import materialise

BETWEEN = r"[^\pL\pM]+"
FIT_ROWS = 20_000  # labelled rows the probabilities are learned on, spread over the languages; a hash of the id draws them
ROUNDS = 2
FLOOR = 1e-9  # probability of a character that the vocabulary does not have
CACHED_WORDS = 100_000  # words of a younger and of an older half
PORTION = 1_500_000  # characters whose new words are scored together
_PIECES: dict[str, dict[str, int]] = {}


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of lower-cased texts, the number of each word in order, and where each text begins and the last ends.

    A word is a run of letters and marks that has a letter; null has none.
    """
    lower = pc.utf8_lower(texts.fill_null(""))
    words, number, offsets = numbered(pc.split_pattern_regex(lower, BETWEEN))
    real = np.fromiter((bool(w) and any(map(str.isalpha, w)) for w in words), bool, len(words))
    kept = real[number]
    place = np.cumsum(real) - 1
    return [w for w, r in zip(words, real, strict=True) if r], place[number[kept]], np.r_[0, np.cumsum(kept)][offsets]


def pieces(path: str) -> dict[str, int]:
    """Number of each piece: the lower-case runs of letters among the vocabulary's entries (base64, rank)."""
    if path not in _PIECES:
        found: dict[str, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                raw = base64.b64decode(line.split()[0]) if line.strip() else b""
                try:
                    piece = raw.decode().removeprefix(" ")
                except UnicodeDecodeError:
                    continue
                if piece.isalpha() and piece == piece.lower():
                    found.setdefault(piece, len(found))
        _PIECES[path] = found
    return _PIECES[path]


class Trie:
    """The pieces as transitions (node, character) -> node, sorted so that many words are walked at once."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        letters = sorted(set().union(*vocabulary)) if vocabulary else []
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.base, self.other = len(letters) + 1, len(vocabulary)
        nodes = {p[:i] for p in vocabulary for i in range(1, len(p) + 1)}
        number = {"": 0} | {p: n for n, p in enumerate(sorted(nodes), 1)}
        self.piece = np.full(len(number) + 1, -1, np.int32)  # the last is where no transition leads
        self.piece[[number[p] for p in vocabulary]] = list(vocabulary.values())
        steps = sorted((number[p[:-1]] * self.base + int(self.code[ord(p[-1])]), number[p]) for p in nodes)
        self.keys, self.next = np.array(steps, np.int64).reshape(-1, 2).T.copy()

    def pieces_in(self, words: list[str]) -> np.ndarray:
        """[word, i, k]: the piece of k + 1 characters that ends at i, or -1, of words of equal length.

        k goes as far as any piece of the vocabulary does in these words.
        """
        length = len(words[0])
        code = self.code[np.array(words).view(np.uint32).reshape(len(words), length)]
        layers: list[np.ndarray] = []
        node = np.zeros((len(words), length), np.int64)
        for k in range(length):
            key = node[:, : length - k] * self.base + code[:, k:]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            known = (self.keys[at] == key) if len(self.keys) else np.zeros(key.shape, bool)
            if k and not known.any():
                break
            node = np.where(known, self.next[at] if len(self.keys) else -1, -1)
            layer = np.full((len(words), length), -1, np.int32)
            layer[:, k:] = self.piece[node]
            layers.append(layer)
        first = layers[0]
        first[first < 0] = self.other
        return np.stack(layers, axis=2)


_TRIES: dict[str, Trie] = {}


def _tables(words: list[str], path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of equal length together: their places and pieces; a character without one has the number after the last."""
    if path not in _TRIES:
        _TRIES[path] = Trie(pieces(path))
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        places, step = np.flatnonzero(lengths == length), max(1, 20_000 // length)
        for at in range(0, len(places), step):
            part = places[at : at + step]
            yield part, _TRIES[path].pieces_in([words[n] for n in part])


@dataclass
class Model:
    """Languages, log priors and log probabilities [language, piece], the last piece being any other character."""

    path: str
    languages: list[str]
    priors: np.ndarray
    logp: np.ndarray

    def _terms(self, ids: np.ndarray) -> np.ndarray:
        out = self.logp[:, np.maximum(ids, 0)]
        out[:, ids < 0] = -np.inf
        return out  # [language, word, i, k]

    def forward(self, ids: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Log sums [language, word, i] over all segmentations of the first i characters."""
        rows, length, longest = ids.shape
        out = np.full((len(self.languages), rows, length + 1), -np.inf)
        out[:, :, 0] = 0.0
        for i in range(length):
            reach = min(longest, i + 1)
            before = out[:, :, i + 1 - reach : i + 1][:, :, ::-1]
            out[:, :, i + 1] = _logsum(before + terms[:, :, i, :reach])
        return out

    def backward(self, ids: np.ndarray, terms: np.ndarray) -> np.ndarray:
        rows, length, longest = ids.shape
        out = np.full((len(self.languages), rows, length + 1), -np.inf)
        out[:, :, length] = 0.0
        for i in range(length - 1, -1, -1):
            reach = min(longest, length - i)
            steps = np.stack([terms[:, :, i + k, k] + out[:, :, i + k + 1] for k in range(reach)], axis=-1)
            out[:, :, i] = _logsum(steps)
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability [word, language]."""
        out = np.empty((len(words), len(self.languages)))
        for part, ids in _tables(words, self.path):
            out[part] = self.forward(ids, self._terms(ids))[:, :, -1].T
        return out

    def expected(self, words: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected uses of every piece in counted words of one language."""
        own = Model(self.path, [self.languages[language]], self.priors[[language]], self.logp[[language]])
        out = np.zeros(self.logp.shape[1])
        for part, ids in _tables(words, self.path):
            terms = own._terms(ids)
            a, b = own.forward(ids, terms), own.backward(ids, terms)
            total = a[0, :, -1]
            for k in range(ids.shape[2]):
                log_use = a[0, :, : ids.shape[1] - k] + terms[0, :, k:, k] + b[0, :, k + 1 :] - total[:, None]
                used = ids[:, k:, k]
                hit = used >= 0
                weight = np.exp(log_use) * counts[part][:, None]
                out += np.bincount(used[hit], weight[hit], len(out))
        return out


def _logsum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - safe).sum(axis=-1)) + safe[..., 0]


def quotas(sizes: dict[str, int], fit_rows: int) -> dict[str, int]:
    """Rows to learn from by language, ``fit_rows`` together: equal shares, what a rare language leaves goes to the others."""
    out: dict[str, int] = {}
    rest = fit_rows
    for at, (lang, n) in enumerate(sorted(sizes.items(), key=lambda item: (item[1], item[0]))):
        out[lang] = min(n, math.ceil(rest / (len(sizes) - at)))
        rest -= out[lang]
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) of the rows with a label that are not held out."""
    return docs.where(F.col("lang").isNotNull() & ~held_out("doc_id")).select("doc_id", "lang", "text")


def training_rows(known: DataFrame, sizes: dict[str, int], fit_rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text) of about ``quotas`` labelled rows per language, by a hash of the id; all rows of a rare one."""
    wanted = quotas(sizes, fit_rows)
    rates = [F.lit(v) for x in sorted(sizes) for v in (x, round(1_000_000 * wanted[x] / max(1, sizes[x])))]
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    return known.where(draw < F.create_map(*rates)[F.col("lang")]).select("lang", "text")


def held_out(key: str) -> Column:
    """True where crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, vocabulary_path: str, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS) -> Model:
    """Learns from ``docs`` (doc_id, lang, text) as ``training_rows`` says; the priors are of all labelled rows.

    Words are counted by language once and written; each round sums expected uses by language and piece, so
    what comes to the driver has a row per language and piece at most.
    """
    known = labelled(docs)
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    vocabulary = pieces(vocabulary_path)
    size = len(vocabulary) + 1
    if not languages:
        return Model(vocabulary_path, [], np.zeros(0), np.zeros((0, size)))
    priors = np.log(np.array([sizes[x] for x in languages], float) / sum(sizes.values()))

    rows = training_rows(known, sizes, fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array(b.column("lang").to_pylist(), object)
            words, number, offsets = words_of(b.column("text"))
            of = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            flat = []
            for x in set(lang.tolist()):
                uses = np.bincount(number[(lang == x)[of]], minlength=len(words))
                flat += [(x, words[i], int(uses[i])) for i in np.flatnonzero(uses)]
            names = ["lang", "word", "n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=names
            )

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    words = materialise(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    flat = np.full((len(languages), size), -np.log(size))
    flat[:, -1] = np.log(FLOOR)
    model = Model(vocabulary_path, languages, priors, flat)
    for _ in range(rounds):
        use = _expect(words, model).collect()
        counts = np.full((len(languages), size), 0.01)
        for r in use:
            counts[r["lang"], r["piece"]] += r["uses"]
        logp = np.log(counts / counts.sum(axis=1, keepdims=True))
        logp[:, -1] = np.maximum(logp[:, -1], np.log(FLOOR))
        model = Model(vocabulary_path, languages, priors, logp)
    return model


def _expect(words: DataFrame, model: Model) -> DataFrame:
    number = {x: n for n, x in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model.logp.shape)
        for b in batches:
            lang, word = np.array(b.column("lang").to_pylist(), object), b.column("word").to_pylist()
            n = b.column("n").to_numpy().astype(float)
            for x in set(lang.tolist()):
                own = np.flatnonzero(lang == x)
                total[number[x]] += model.expected([word[i] for i in own], n[own], number[x])
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total[at])], names=["lang", "piece", "uses"]
        )

    uses = words.mapInArrow(run, "lang int, piece int, uses double")
    return uses.groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))


class _Scored:
    """Scores of the words a worker process has met lately, for one model."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, Recent(CACHED_WORDS)

    def totals(self, texts: list[str]) -> list[np.ndarray | None]:
        """Summed scores of each text's words, the new words of all texts scored together; None without a word."""
        words, number, offsets = words_of(pa.array(texts, pa.string()))
        known = self.known.know(set(words), lambda new: [x.tobytes() for x in self.model.score(new)])
        wide = len(self.model.languages)
        scores = np.frombuffer(b"".join([known[w] for w in words])).reshape(-1, wide)
        spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        return [scores[number[i:j]].sum(axis=0) if j > i else None for i, j in spans]


def _told(scored: _Scored, texts: pa.Array) -> pa.StructArray:
    """lang_pred and score of texts: ``und`` and 0 without a letter."""
    languages = scored.model.languages
    labels, values = [], []
    for part in portions(texts, PORTION):
        for total in scored.totals(part) if languages else [None] * len(part):
            if total is None:
                labels.append("und")
                values.append(0.0)
                continue
            total += scored.model.priors
            odds = np.exp(total - total.max())
            best = int(odds.argmax())
            labels.append(languages[best])
            values.append(float(odds[best] / odds.sum()))
    return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(values, pa.float64())], ["lang_pred", "score"])


def predict(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The columns with lang_pred and score (posterior) of every whole text; ``und`` and 0 without a letter."""

    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = held(("language", token), lambda: _Scored(model))
        for b in batches:
            kept = [b.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *_told(scored, b.column("_text")).flatten()], names=[*columns, "lang_pred", "score"])
        release()

    small_batches(docs)
    schema = docs.select(*columns).schema.add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(run, schema)


def told(model: Model, text: Column) -> Column:
    """(lang_pred, score) of a text as a column: only the text goes to Python, the row stays where it is."""
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scored = held(("language", token), lambda: _Scored(model))
        for texts in batches:
            yield _told(scored, texts)
        release()

    return F.arrow_udf(run, "lang_pred string, score double")(text)


def identify(docs: DataFrame, vocabulary_path: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the labelled ones among them.

    Ties go to the first language by code point.  Repeated rows get equal results.  A table without
    labelled rows has nothing to learn: every text is ``und``.
    """
    model = learn(docs, vocabulary_path, fit_rows)
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary_path: str, min_score: float = 0.5) -> DataFrame:
    """The rows whose text has a language with at least ``min_score``, columns as they are."""
    model = learn(docs, vocabulary_path)
    small_batches(docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), told(model, F.col("text")).alias("told"))
    return packed.where((F.col("told.lang_pred") != "und") & (F.col("told.score") >= min_score)).select("doc.*")
