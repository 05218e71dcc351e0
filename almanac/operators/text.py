"""Keyword hits, span merging, context windows, fixed chunks and per-site text rollups.

A merged span is itself one regular expression (a hit, then further hits at most
``gap`` characters on), so counting spans and cutting windows happens inside the
row that holds the text: no explode, no shuffle and no join back to the text.
Offsets are needed only when hits or spans are listed; those rows are narrow.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from almanac.operators.ranks import percentiles
from almanac.session import materialise

MERGE_GAP = 15
WINDOW_PAD = 500
CHUNK_CHARS = 500
FOLD_ROWS = 10_000  # rows of a group's summaries that are merged in one task
BLANK = r"(?U)[\s\x1c-\x1f]"


def lexicon_pattern(exact: Sequence[str], prefixes: Sequence[str] = ()) -> str:
    """One pattern: exact words first, then word prefixes; earlier entries win.

    The word boundary and the first letter are tested once per place, before any entry.
    """
    stems = [p.rstrip("*") for p in prefixes]
    words = [re.escape(w) + r"\b" for w in exact] + [re.escape(p) + r"\w*\b" for p in stems]
    first = "".join(sorted({re.escape(w[0].lower()) for w in (*exact, *stems)}))
    return rf"(?iU)\b(?=[{first}])(?:" + "|".join(words) + ")"


def span_pattern(lexicon: str, gap: int = MERGE_GAP) -> str:
    """Pattern of a merged span; the possessive loop keeps the match iterative and linear."""
    return rf"(?s){lexicon}(?:.{{0,{gap}}}?{lexicon})*+"


def has_keyword(text: Column, lexicon: str) -> Column:
    return F.coalesce(text.rlike(lexicon), F.lit(False))


def distinct_keywords(text: Column, lexicon: str) -> Column:
    """Lower-cased keywords in order of first hit."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(lexicon), 0), lambda w: F.lower(w)))


@F.arrow_udf(ArrayType(LongType()))
def _running_sums(steps: pa.Array) -> pa.Array:
    """Running sum inside each list, for a whole batch of lists at once."""
    offsets = steps.offsets.to_numpy().astype(np.int64)
    total = np.r_[0, np.cumsum(steps.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)]
    offsets = offsets - offsets[0]
    sums = total[1:] - np.repeat(total[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(sums, pa.int64()))


def _offsets(df: DataFrame, key: str, text: str, pattern: str, carry: Sequence[str]) -> DataFrame:
    """One row per match with 0-based start and exclusive end.

    Lengths of the pieces between matches and of the matches add up to offsets inside the
    row, so nothing is shuffled; only the lengths pass through Arrow, the text does not.
    """
    gaps = F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g))
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
    steps = F.transform("_found", lambda h, i: F.get(F.col("_gaps"), i) + F.length(h))
    return (
        df.select(key, *carry, gaps.alias("_gaps"), hits.alias("_found"))
        .select(key, *carry, "_found", _running_sums(steps).alias("_ends"))
        .select(key, *carry, F.posexplode(F.arrays_zip("_found", "_ends")).alias("pos", "_m"))
        .select(key, *carry, "pos", F.col("_m._found").alias("found"), F.col("_m._ends").alias("end"))
        .withColumn("start", F.col("end") - F.length("found"))
        .select(key, *carry, "pos", "found", "start", "end")
    )


def keyword_hits(df: DataFrame, key: str, text: str, lexicon: str, carry: Sequence[str] = ()) -> DataFrame:
    """Every hit as (key, pos, keyword, start, end)."""
    hits = _offsets(df, key, text, lexicon, carry)
    return hits.withColumn("keyword", F.lower("found")).drop("found")


def keyword_occurrences(df: DataFrame, key: str, text: str, lexicon: str) -> DataFrame:
    """(key, keyword) per hit, without offsets: a narrow explode, no shuffle."""
    hits = F.regexp_extract_all(F.col(text), F.lit(lexicon), 0)
    return df.select(key, F.explode(hits).alias("keyword")).withColumn("keyword", F.lower("keyword"))


def merge_hits(hits: DataFrame, key: str, gap: int = MERGE_GAP, sep: str = ", ") -> DataFrame:
    """Merge listed hits closer than ``gap`` into spans (key, keywords, start, end).

    For hits that come from a table; for text at hand use ``keyword_spans``.
    """
    order = Window.partitionBy(key).orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.coalesce((F.col("start") - reach > gap).cast("int"), F.lit(0))
    island = F.sum("_break").over(order)
    grouped = hits.withColumn("_break", breaks).withColumn("_island", island).groupBy(key, "_island")
    words = F.array_sort(F.collect_list(F.struct("start", "keyword")))
    return grouped.agg(
        F.array_join(F.transform(words, lambda w: w["keyword"]), sep).alias("keywords"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
    ).drop("_island")


def keyword_spans(
    df: DataFrame, key: str, text: str, lexicon: str, gap: int = MERGE_GAP, carry: Sequence[str] = ()
) -> DataFrame:
    """Merged spans straight from text, as (key, pos, keywords, start, end)."""
    spans = _offsets(df, key, text, span_pattern(lexicon, gap), carry)
    words = F.transform(F.regexp_extract_all("found", F.lit(lexicon), 0), lambda w: F.lower(w))
    return spans.withColumn("keywords", F.array_join(words, ", ")).drop("found")


def span_count(text: Column, lexicon: str, gap: int = MERGE_GAP) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(span_pattern(lexicon, gap)), 0)), F.lit(0))


def context_windows(
    df: DataFrame,
    key: str,
    text: str,
    lexicon: str,
    pad: int = WINDOW_PAD,
    gap: int = MERGE_GAP,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Span text with up to ``pad`` characters on each side, at most half the way to a neighbour.

    All spans of a page take part, so a resumed run sees the same windows.
    """
    pattern = span_pattern(lexicon, gap)
    spans = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)

    def window(s: Column, i: Column) -> Column:
        left, right = F.get(F.col("_gaps"), i), F.get(F.col("_gaps"), i + 1)
        n_left, n_right = F.length(left), F.length(right)
        take_left = F.when(i == 0, F.least(n_left, F.lit(pad))).otherwise(
            F.least(F.floor(n_left / 2).cast("int"), F.lit(pad))
        )
        last = i == F.size(F.col("_gaps")) - 2
        take_right = F.when(last, F.least(n_right, F.lit(pad))).otherwise(
            F.least(F.floor(n_right / 2).cast("int"), F.lit(pad))
        )
        return F.concat(F.substring(left, n_left - take_left + 1, take_left), s, F.substring(right, F.lit(1), take_right))

    cut = df.select(key, *carry, F.split(F.col(text), pattern, -1).alias("_gaps"), spans.alias("_spans"))
    return cut.select(key, *carry, F.posexplode(F.transform("_spans", window)).alias("pos", "chunk_text"))


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_CHARS) -> DataFrame:
    """Windows of ``size`` characters snapped back to the last space, as (key, chunk_index, chunk_text).

    One pattern cuts the text: what is left if it fits, else up to the last space inside the
    window, else the whole window.  Pieces are trimmed, blank ones have no index.
    """
    snapped = rf"|.{{1,{size - 1}}}(?= )" if size > 1 else ""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"(?s).{{1,{size}}}\z{snapped}|.{{{size}}}"), F.lit(0))
    trimmed = F.transform(pieces, lambda p: F.regexp_replace(p, rf"\A{BLANK}+|{BLANK}+\z", ""))
    return df.select(key, F.posexplode(F.array_remove(trimmed, "")).alias("chunk_index", "chunk_text"))


def site_rollup(df: DataFrame, site: str, text: str, lexicon: str, gap: int = MERGE_GAP) -> DataFrame:
    """Pages, pages with a hit, spans and hit rate per site, in one pass over the text."""
    n = span_count(F.col(text), lexicon, gap)
    per_page = df.select(site, n.alias("_n"))
    out = per_page.groupBy(site).agg(
        F.count_if(F.col("_n") > 0).alias("pages_with_hits"),
        F.count("*").alias("total_pages"),
        F.sum(F.col("_n").cast("bigint")).alias("spans"),
    )
    return out.withColumn("hit_rate", hit_rate(F.col("pages_with_hits"), F.col("total_pages")))


def hit_rate(hits: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(hits, total), F.lit(0.0)).cast("decimal(6,5)")


def keyword_hit_rate(occurrences: DataFrame, keyword: str, is_hit: str) -> DataFrame:
    """Total, hits and rate per keyword, with the pooled and the median rate beside them."""
    per = occurrences.groupBy(keyword).agg(F.count("*").alias("total"), F.count_if(F.col(is_hit)).alias("hits"))
    # One row per keyword; written so that the two summary rates do not read the text again.
    per = materialise(per.withColumn("rate", F.col("hits") / F.col("total")), "keyword-rates")
    pooled = per.select(F.sum("hits") / F.sum("total")).scalar()
    middle = percentiles(per, "rate", {"median": 0.5}).scalar()
    return per.withColumn("pooled_rate", pooled).withColumn("median_rate", middle)


def budgeted_text(
    pages: DataFrame, group: str, key: str, text: str, score: Column, per_page: int = 4_000, total: int = 6_000, sep: str = "\n\n---\n\n"
) -> DataFrame:
    """One text per group from its best pages (numeric score, then key) until the character budget is used up.

    A budget summary, the best pages of a part of a group cut at the budget, is never longer than the budget, and
    summaries merge: every batch of pages makes one per group where it is read, and those of a crowded group are
    folded in as many parts and levels as its rows ask for.  Texts are read once.
    """
    cut = F.substring(F.col(text), 1, per_page)
    rows = pages.where(F.length(text) > 0).select(
        F.col(group).alias("_g"), F.col(key).alias("_k"), score.cast("double").alias("_score"), cut.alias("_t"), F.length(cut).alias("_len")
    )

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # nulls last by score, first by key, as the windows below have them
            keys = pa.table({"s": b.column("_score"), "n": b.column("_k").is_valid().cast(pa.int8()), "k": b.column("_k")})
            order = pc.sort_indices(keys, sort_keys=[("s", "descending"), ("n", "ascending"), ("k", "ascending")])
            b = b.take(order)
            lengths = pd.Series(b.column("_len").to_numpy())
            used = lengths.groupby(b.column("_g").to_pandas().to_numpy(), dropna=False, sort=False).cumsum() - lengths
            yield b.filter(pa.array((used < total).to_numpy()))

    def within_budget(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("_score"), "_k")
        before = F.sum("_len").over(order.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("_used", F.coalesce(before, F.lit(0))).where(F.col("_used") < total)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    kept = materialise(rows.mapInArrow(summaries, schema), "summaries")
    most = lambda df: df.groupBy("_g").count().agg(F.max("count")).first()[0] or 0
    level, crowd = 0, most(kept)
    while crowd > FOLD_ROWS:
        part = F.pmod(F.xxhash64("_k", "_t", F.lit(level)), F.lit(math.ceil(crowd / FOLD_ROWS)))
        kept = materialise(within_budget(kept.withColumn("_part", part), "_g", "_part").drop("_part", "_used"), "summaries")
        level, before, crowd = level + 1, crowd, most(kept)
        if 2 * crowd > before:  # pages of a few characters: the budget itself holds so many
            break
    chosen = within_budget(kept, "_g")
    piece = F.struct("_used", F.substring("_t", F.lit(1), F.least(F.col("_len"), (F.lit(total) - F.col("_used")).cast("int"))).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), sep)
    return chosen.groupBy(F.col("_g").alias(group)).agg(joined.alias("agg_text"), F.count("*").alias("pages_used"))


def label_distribution(sites: DataFrame, labelled: DataFrame, site: str, label: str) -> DataFrame:
    """Top label, ``label:count`` list by falling count and labelled pages; blanks for sites without labels."""
    counts = labelled.groupBy(site, label).agg(F.count("*").alias("_n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("label"))))
    per = counts.groupBy(site).agg(ranked.alias("_r"), F.sum("_n").alias("pages_labelled")).select(
        site,
        F.col("_r")[0]["label"].alias("top_label"),
        F.array_join(
            F.transform("_r", lambda r: F.concat(r["label"], F.lit(":"), (-r["n"]).cast("string"))), ","
        ).alias("distribution"),
        "pages_labelled",
    )
    return sites.select(site).distinct().join(per, site, "left").na.fill({"top_label": "", "distribution": ""})


Scorer = Callable[[str], str]


def score_rows(df: DataFrame, text: str, scorer: Scorer, model: str, retries: int = 3) -> DataFrame:
    """Run a text scorer over all rows; adds label, error and model.

    A failing row is tried again, then kept with the error text so the next run retries it.
    """

    def one(body: str) -> tuple[str | None, str | None]:
        problem = None
        for _ in range(retries):
            try:
                return scorer(body), None
            except Exception as e:  # any scorer failure becomes the row's error
                problem = f"{type(e).__name__}: {e}"
        return None, problem

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            scored = [one(x) for x in b[text]]
            b["label"], b["error"] = [s[0] for s in scored], [s[1] for s in scored]
            b["model"] = model
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, label string, error string, model string")


def pending_work(desired: DataFrame, done: DataFrame, keys: Sequence[str], error: str = "error") -> DataFrame:
    """Desired rows without a successful result; errored ones stay pending."""
    ok = done.where(F.coalesce(F.col(error), F.lit("")) == "").select(*keys)
    return desired.join(ok, list(keys), "left_anti")
