"""Full-text and vector filters over pages, and their comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanac.functions.stemming import stem_words
from almanac.operators.text import has_keyword, lexicon_pattern
from almanac.session import join_counted, materialise

WORD_SPLIT = r"(?U)[^\w]+"
MAX_SIM = 0.25
MEAN_SIM = 0.30
PHRASE_BLOCK, ROW_BLOCK = 1_024, 20_000  # phrases and rows whose products are made at a time
SENT_BYTES = 32_000_000  # phrases of up to so many bytes are sent to every task

# English stop words of the full-text configuration.
STOP_WORDS = tuple(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above below to from up down in out on
    off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don should now""".split()
)


def lexemes(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct lower-case words without stop words."""
    drop = F.array(F.lit(""), *[F.lit(w) for w in stop])
    return F.array_except(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SPLIT), drop)


def stemmed_index(df: DataFrame, key: str, text: str, stop: Sequence[str] = STOP_WORDS) -> DataFrame:
    """(lexeme, key) rows of English stems: the distinct words of the corpus are stemmed once and joined back by word."""
    words = materialise(df.select(F.col(key), F.explode(lexemes(F.col(text), stop)).alias("word")), "words")
    stems = materialise(stem_words(words.select("word").distinct()), "stems")
    return join_counted(words, stems, "word", "inner").select(F.col("stem").alias("lexeme"), key).distinct()


def with_any(index: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """Keys of rows that have any of the lexemes."""
    return index.where(F.col("lexeme").isin(*terms)).select(key).distinct()


def with_all(index: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """Keys of rows that have all of the lexemes."""
    found = index.where(F.col("lexeme").isin(*terms)).groupBy(key).agg(F.count_distinct("lexeme").alias("n"))
    return found.where(F.col("n") == len(set(terms))).select(key)


def matches_any(lex: Column, terms: Sequence[str]) -> Column:
    """OR query; evaluated inside the row, so no shuffle."""
    return F.arrays_overlap(lex, F.array(*[F.lit(t) for t in terms]))


def matches_all(lex: Column, terms: Sequence[str]) -> Column:
    """AND query."""
    return F.size(F.array_intersect(lex, F.array(*[F.lit(t) for t in terms]))) == len(set(terms))


def any_word(text: Column, terms: Sequence[str]) -> Column:
    """OR query over unstemmed words; one pattern, so the text is not cut into words."""
    return has_keyword(text, lexicon_pattern(terms))


def all_words(text: Column, terms: Sequence[str]) -> Column:
    """AND query over unstemmed words; stops at the first missing one."""
    out = has_keyword(text, lexicon_pattern(terms[:1]))
    for t in terms[1:]:
        out = out & has_keyword(text, lexicon_pattern([t]))
    return out


def inverted_index(df: DataFrame, key: str, lex: Column) -> DataFrame:
    """(lexeme, key) rows, for storing by lexeme."""
    return df.select(F.explode(lex).alias("lexeme"), key)


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: x / norm)


def mean_vector(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Renormalised mean vector, per group or overall; averages by position, so it combines map-side."""
    avg = (
        df.select(*by, F.posexplode(F.col(vector)))
        .groupBy(*by, "pos")
        .agg(F.avg(F.col("col").cast("double")).alias("m"))
    )
    cells = F.array_sort(F.collect_list(F.struct("pos", "m")))
    out = avg.groupBy(*by).agg(F.transform(cells, lambda c: c["m"]).alias(vector))
    return out.withColumn(vector, unit(F.col(vector)))


def _dense(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def _phrase_blocks(phrases: DataFrame, phrase: str, vector: str) -> list[tuple[list, np.ndarray]] | None:
    """The phrases in order of their names, cut into blocks, if together they are small enough to be sent to every task."""
    rows = phrases.where(F.col(phrase).isNotNull() & F.col(vector).isNotNull()).select(phrase, F.col(vector).cast("array<double>").alias(vector))
    size = rows.agg(F.sum(F.size(vector) * 8 + F.length(F.col(phrase).cast("string")) + 16)).first()[0] or 0
    if size > SENT_BYTES:
        return None
    found = sorted(rows.collect(), key=lambda r: r[0])  # bounded by the check above
    parts = [found[at : at + PHRASE_BLOCK] for at in range(0, len(found), PHRASE_BLOCK)]
    return [([r[0] for r in part], np.array([r[1] for r in part], dtype=float)) for part in parts]


def _met(df: DataFrame, carry: Sequence[str], vector: str, phrases: DataFrame, phrase: str, phrase_vector: str, of, schema: str) -> DataFrame:
    """``of(rows, names, matrix)`` of every block of rows with every block of phrases, both dealt out by hashes.

    A pair of blocks meets in one task of fixed size; a row moves once per block of phrases.
    """
    blocks = max(1, math.ceil(phrases.count() / PHRASE_BLOCK))
    parts = max(1, math.ceil(df.count() / ROW_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    left = df.select(*carry, F.col(vector).alias("_v"), dealt(parts, *carry).alias("_p")).withColumn("_b", every(blocks))
    right = phrases.select(F.col(phrase).alias("_n"), F.col(phrase_vector).alias("_w")).where("_n IS NOT NULL AND _w IS NOT NULL")
    right = right.withColumn("_b", dealt(blocks, "_n")).withColumn("_p", every(parts))

    def pair(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(block):
            return pd.DataFrame({c.split()[0].strip("`"): [] for c in schema.split(", ")})
        block = block.sort_values("_n")
        return of(rows, block["_n"].tolist(), _dense(block["_w"]))

    return left.groupBy("_p", "_b").cogroup(right.groupBy("_p", "_b")).applyInPandas(pair, schema)


def best_phrase(df: DataFrame, vector: str, phrases: DataFrame, phrase: str, phrase_vector: str) -> DataFrame:
    """Adds ``score`` (largest cosine over all phrases, however many) and ``phrase`` (of equal scores the first by name).

    Phrases that fit are sent to the rows, which then do not move; more meet the rows block by block.  Without phrases
    there are no rows.
    """
    keep = [f for f in df.schema.fields if f.name != vector]
    kind = phrases.schema[phrase].dataType.simpleString()
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], "score double", f"phrase {kind}"])
    sent = _phrase_blocks(phrases, phrase, phrase_vector)
    if sent is not None:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b) and sent:
                    x = _dense(b.pop(vector))
                    score, name = np.full(len(b), -np.inf), np.empty(len(b), object)
                    for names, matrix in sent:
                        sims = x @ matrix.T
                        best = sims.argmax(axis=1)
                        top = sims[np.arange(len(b)), best]
                        better = top > score
                        score[better], name[better] = top[better], [names[i] for i in best[better]]
                    b["score"], b["phrase"] = score, name
                    yield b

        return df.mapInPandas(run, schema)
    rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def best_of(block: pd.DataFrame, names: list, matrix: np.ndarray) -> pd.DataFrame:
        sims = _dense(block["_v"]) @ matrix.T
        best = sims.argmax(axis=1)
        return pd.DataFrame({"_row": block["_row"], "score": sims[np.arange(len(block)), best], "phrase": [names[i] for i in best]})

    found = _met(rows, ["_row"], vector, phrases, phrase, phrase_vector, best_of, f"_row bigint, score double, phrase {kind}")
    best = found.groupBy("_row").agg(F.min(F.struct((-F.col("score")).alias("minus"), "phrase")).alias("b"))
    best = best.select("_row", (-F.col("b.minus")).alias("score"), "b.phrase")
    return rows.drop(vector).join(best, "_row").drop("_row").select(*[f.name for f in keep], "score", "phrase")


def phrase_scores(df: DataFrame, key: str, vector: str, phrases: DataFrame, phrase: str, phrase_vector: str, at_least: float) -> DataFrame:
    """All (key, phrase, score) at or above a threshold; rows are made only for kept scores."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, phrase {phrases.schema[phrase].dataType.simpleString()}, score double"
    sent = _phrase_blocks(phrases, phrase, phrase_vector)

    def above(keys: pd.Series, x: np.ndarray, names: list, matrix: np.ndarray) -> pd.DataFrame:
        sims = x @ matrix.T
        i, j = np.nonzero(sims >= at_least)
        return pd.DataFrame({key: keys.to_numpy()[i], "phrase": [names[n] for n in j], "score": sims[i, j]})

    if sent is None:
        rows = df.select(key, vector)
        return _met(rows, [key], vector, phrases, phrase, phrase_vector, lambda b, n, m: above(b[key], _dense(b["_v"]), n, m), schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _dense(b[vector])
                for names, matrix in sent:
                    yield above(b[key], x, names, matrix)

    return df.select(key, vector).mapInPandas(run, schema)


def mean_query_vector(phrases: DataFrame, vector: str) -> np.ndarray:
    """Mean of the phrase vectors, scaled back to length one: one row, averaged where the phrases are."""
    return np.array(mean_vector(phrases, vector).first()[0], dtype=float)


def query_similarity(vector: Column, query: np.ndarray) -> Column:
    """Cosine of unit vectors against one fixed query, native."""
    q = F.array(*[F.lit(float(x)) for x in query])
    products = F.zip_with(vector, q, lambda a, b: a.cast("double") * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def filter_cells(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """Counts of pages by first filter only, second only, both and either."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    return df.select(a.alias("a"), b.alias("b")).agg(
        F.count_if(F.col("a") & ~F.col("b")).alias("first_only"),
        F.count_if(~F.col("a") & F.col("b")).alias("second_only"),
        F.count_if(F.col("a") & F.col("b")).alias("both"),
        F.count_if(F.col("a") | F.col("b")).alias("either"),
    )


def top_missed(scored: DataFrame, score: str, key: str, caught: Column, at_least: float, n: int) -> DataFrame:
    """The ``n`` best-scored pages the keyword filter did not catch."""
    return scored.where(~caught & (F.col(score) >= at_least)).orderBy(F.desc(score), key).limit(n)
