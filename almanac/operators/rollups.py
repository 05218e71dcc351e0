"""Per-key rollups used for flags and map layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almanac.functions.values import blank_to_null, merge_values
from almanac.session import join_counted


def duplicate_domains(sites: DataFrame, domain: str, owner: str, platforms: Sequence[str]) -> DataFrame:
    """Adds ``owners`` and the duplicate ``flag`` of each row's domain.

    The aggregate is one small row per domain, so the join back moves no pages twice.
    """
    per = sites.groupBy(domain).agg(F.countDistinct(owner).alias("owners"), F.count("*").alias("_rows"))
    d = F.col(domain)
    flag = (
        F.when(F.coalesce(d, F.lit("")) == "", "no")
        .when((d == "https:") | ~d.contains("."), "malformed")
        .when(d.isin(*platforms), "platform")
        .when(F.col("owners") > 1, "shared")
        .when(F.col("_rows") > 1, "variants")
        .otherwise("no")
    )
    return join_counted(sites, per, domain, "left").withColumn("flag", flag).drop("_rows")


def content_retag(
    rows: DataFrame,
    key: str,
    name_cols: Sequence[str],
    text_col: str,
    rules: Sequence[tuple[str, Sequence[str], Sequence[str]]],
) -> DataFrame:
    """Label per key by word lists over names and page text.

    ``rules`` are (label, words for names, words for text); a later rule overrides an
    earlier one, and a text hit overrides a name hit.
    """

    def any_word(cols: Sequence[str], words: Sequence[str]):
        hit = F.lit(False)
        for c in cols:
            low = F.lower(F.coalesce(F.col(c), F.lit("")))
            for w in words:
                hit = hit | low.contains(w)
        return F.coalesce(F.bool_or(hit), F.lit(False))

    flags = []
    for i, (_, in_name, in_text) in enumerate(rules):
        flags += [any_word(name_cols, in_name).alias(f"_n{i}"), any_word([text_col], in_text).alias(f"_t{i}")]
    per = rows.groupBy(key).agg(*flags)
    label, source = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for kind, prefix in (("content", "_t"), ("name", "_n")):
        for i in reversed(range(len(rules))):
            label = label.when(F.col(f"{prefix}{i}"), rules[i][0])
            source = source.when(F.col(f"{prefix}{i}"), kind)
    return per.select(key, label.alias("label"), source.alias("source"))


def map_points(
    df: DataFrame, lat: str, lon: str, label: str, unknown: str = "Unknown", merge: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows that can be drawn: coordinates and a known label present, label merged."""
    shown = F.col(lat).isNotNull() & F.col(lon).isNotNull() & blank_to_null(F.col(label)).isNotNull()
    return df.where(shown & (F.col(label) != unknown)).withColumn(label, merge_values(F.col(label), merge or {}))
